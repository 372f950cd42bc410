"""BPE with word ends: encoding by contiguous rank arrays, and decoding.

A text is cut at the strings of added tokens, normalised (NFC, lower case) and split by the vocabulary file's own pattern; the
bytes of each word are its first parts. Short words are merged side by side in numpy: a row holds a word's parts and the ranks
of its neighbouring pairs; each round finds every row's smallest rank, deletes the boundary in that pair and refreshes the
ranks on both sides. Words over SHORT bytes are merged one by one with a heap. Each distinct space-delimited piece of a slice is
encoded once.

Decoding joins the tokens' strings with a space, as a file without a decoder asks for. A null text is empty, an empty text has
no ids and decodes to an empty text; a null doc_id is kept; rows that repeat are encoded each; an empty table gives no rows; other columns are unused.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .byte_tokens import chunks
from .common import ship

#: Bytes of a short word, cells in a rank array, words that a worker remembers.
SHORT, CELLS, CACHED = 64, 2_000_000, 200_000
NONE = np.int32(2**31 - 1)
_WHITE = r"\t-\r\x20\x85\xa0  -     　"
_loaded: dict[str, WordBpe] = {}


def byte_alphabet() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = iter(range(0x100, 0x200))
    return [chr(b) if b in plain else chr(next(rest)) for b in range(256)]


class WordBpe:
    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, suffix = spec["model"], spec["model"]["end_of_word_suffix"]
        vocab: dict[str, int] = model["vocab"]
        self.added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.cut = regex.compile("(" + "|".join(map(regex.escape, sorted(self.added, key=len, reverse=True))) + ")")
        pattern = spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
        self.words = regex.compile(pattern.replace(r"[^\s", f"[^{_WHITE}"))
        self.tokens = [""] * (max([*vocab.values(), *self.added.values()]) + 1)
        for t, i in (vocab | self.added).items():
            self.tokens[i] = t
        letters = byte_alphabet()
        self.inner = np.array([vocab[c] for c in letters], np.int32)
        self.last = np.array([vocab[c + suffix] for c in letters], np.int32)
        pairs = [(m if isinstance(m, list) else m.split(" ")) for m in model["merges"]]
        keys = np.array([vocab[a] << 32 | vocab[b] for a, b in pairs], np.int64)
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks = keys[order], order.astype(np.int32)
        self.merged = np.array([vocab[a + b] for a, b in pairs], np.int32)
        self.cache: dict[str, bytes] = {}
        self.strings = pa.array(self.tokens, pa.string())

    @classmethod
    def load(cls, path: str) -> WordBpe:
        """One for each path and Python worker."""
        if path not in _loaded:
            _loaded[path] = cls(path)
        return _loaded[path]

    def _rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Rank of each pair of parts; NONE if it does not merge or a part is missing (-1)."""
        key = a.astype(np.int64) << 32 | b
        at = np.searchsorted(self.keys, key)
        at[at == len(self.keys)] = 0
        return np.where((self.keys[at] == key) & (a >= 0) & (b >= 0), self.ranks[at], NONE)

    def merge_short(self, words: list[bytes]) -> list[bytes]:
        """The ids (int32 bytes) of words of much the same length."""
        n, width = len(words), max(map(len, words))
        lens = np.fromiter(map(len, words), np.int64, n)
        raw = np.frombuffer(b"".join(w.ljust(width, b"\0") for w in words), np.uint8).reshape(n, width)
        spots = np.arange(width)
        parts = np.where(spots < lens[:, None], self.inner[raw], np.int32(-1))
        parts[np.arange(n), lens - 1] = self.last[raw[np.arange(n), lens - 1]]
        parts = np.concatenate([parts, np.full((n, 1), -1, np.int32)], axis=1)
        ranks = self._rank(parts[:, :-1].ravel(), parts[:, 1:].ravel()).reshape(n, width)
        out: list[bytes] = [b""] * n
        own = np.arange(n)
        while len(own):
            least = ranks.argmin(axis=1)
            rows = np.arange(len(own))
            best = ranks[rows, least]
            done = best == NONE
            if done.any():
                for k in np.flatnonzero(done).tolist():
                    out[own[k]] = parts[k][parts[k] >= 0].tobytes()
                keep = ~done
                own, parts, ranks, least, best = own[keep], parts[keep], ranks[keep], least[keep], best[keep]
                rows = np.arange(len(own))
                if not len(own):
                    break
            parts[rows, least] = self.merged[best]
            spots = np.arange(ranks.shape[1])
            parts = np.take_along_axis(parts, np.minimum(np.arange(parts.shape[1]) + (np.arange(parts.shape[1]) > least[:, None]), parts.shape[1] - 1), axis=1)
            ranks = np.take_along_axis(ranks, np.minimum(spots + (spots > least[:, None]), len(spots) - 1), axis=1)
            ranks[:, -1] = NONE
            ranks[rows, least] = self._rank(parts[rows, least], parts[rows, least + 1])
            left = np.flatnonzero(least > 0)
            ranks[left, least[left] - 1] = self._rank(parts[left, least[left] - 1], parts[left, least[left]])
        return out

    def merge_long(self, word: bytes) -> bytes:
        """The same for one long word, in n log n: a heap of pairs over a linked list."""
        parts = [*self.inner[np.frombuffer(word[:-1], np.uint8)].tolist(), int(self.last[word[-1]])]
        after, before = [*range(1, len(parts)), -1], [*range(-1, len(parts) - 1)]
        ranks = self._rank(np.array(parts[:-1]), np.array(parts[1:])).tolist()
        heap = [(r, k, parts[k], parts[k + 1]) for k, r in enumerate(ranks) if r != NONE]
        heapq.heapify(heap)
        while heap:
            r, k, a, b = heapq.heappop(heap)
            j = after[k]
            if parts[k] != a or j < 0 or parts[j] != b:
                continue
            parts[k], parts[j] = int(self.merged[r]), -1
            after[k] = after[j]
            if after[j] >= 0:
                before[after[j]] = k
            for x, y in ((before[k], k), (k, after[k])):
                if x >= 0 and y >= 0 and (new := int(self._rank(np.array([parts[x]]), np.array([parts[y]]))[0])) != NONE:
                    heapq.heappush(heap, (new, x, parts[x], parts[y]))
        return np.array([p for p in parts if p >= 0], np.int32).tobytes()

    def _words(self, words: list[str]) -> dict[str, bytes]:
        """The ids of distinct words."""
        found = {w: self.cache.get(w) for w in words}
        new = sorted((w for w, x in found.items() if x is None), key=len)
        raw = [w.encode() for w in new]
        at = 0
        by_size = sorted(range(len(raw)), key=lambda k: len(raw[k]))
        while at < len(by_size):
            if len(raw[by_size[at]]) > SHORT:
                found[new[by_size[at]]] = self.merge_long(raw[by_size[at]])
                at += 1
                continue
            stop = at
            while stop < len(by_size) and len(raw[by_size[stop]]) <= min(SHORT, len(raw[by_size[at]]) + 3) and (stop - at) * len(raw[by_size[stop]]) < CELLS:
                stop += 1
            part = by_size[at:stop]
            for k, ids in zip(part, self.merge_short([raw[k] for k in part]), strict=True):
                found[new[k]] = ids
            at = stop
        room = CACHED - len(self.cache)
        self.cache.update((w, found[w]) for w in new[: max(0, room)])
        return found

    def _normal(self, piece: str) -> str:
        if piece.isascii():
            return piece.lower()
        return "".join([c.lower() for c in unicodedata.normalize("NFC", piece)])  # by character: no final sigma

    def _plain(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Offsets and ids of texts without added tokens."""
        split = pc.split_pattern(pc.replace_substring(texts, "\n", " "), " ")
        rows = split.offsets.to_numpy().astype(np.int64)
        coded = split.flatten().dictionary_encode()
        findall, normal = self.words.findall, self._normal
        pieces = [findall(normal(p)) for p in coded.dictionary.to_pylist()]
        found = self._words([w for p in pieces for w in p])
        ids = [found[p[0]] if len(p) == 1 else b"".join([found[w] for w in p]) for p in pieces]
        lens = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
        flat = np.frombuffer(b"".join(ids), np.int32)
        starts = np.cumsum(lens) - lens
        index = coded.indices.to_numpy()
        ends = np.concatenate([[0], np.cumsum(lens[index])])
        out = np.empty(ends[-1], np.int32)
        for at in range(0, len(index), 400_000):  # in slices, for the memory of the gather
            part = index[at : at + 400_000]
            a, b = ends[at], ends[at + len(part)]
            out[a:b] = flat[np.repeat(starts[part] - ends[at : at + len(part)], lens[part]) + np.arange(a, b)]
        return ends[rows - rows[0]], out

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(offsets, ids): row i's ids are ids[offsets[i]:offsets[i + 1]]; a null text has none."""
        texts = pc.fill_null(texts, "")
        special = np.zeros(len(texts), bool)
        for t in self.added:
            special |= pc.match_substring(texts, t).to_numpy(zero_copy_only=False).astype(bool)
        if not special.any():
            return self._plain(texts)
        segments, owner, fixed = [], [], []
        for k, text in enumerate(texts.to_pylist()):
            for s in self.cut.split(text) if special[k] else [text]:
                segments.append("" if s in self.added else s)
                owner.append(k)
                fixed.append(self.added.get(s, -1))
        offsets, ids = self._plain(pa.array(segments, pa.string()))
        parts = [np.array([f], np.int32) if f >= 0 else ids[a:b] for f, a, b in zip(fixed, offsets[:-1], offsets[1:], strict=True)]
        sizes = np.bincount(owner, weights=list(map(len, parts)), minlength=len(texts)).astype(np.int64)
        return np.concatenate([[0], np.cumsum(sizes)]), np.concatenate(parts)

    def decode(self, offsets: np.ndarray, ids: np.ndarray) -> pa.Array:
        """The text of each row's ids."""
        strings = self.strings.take(pa.array(ids))
        return pc.binary_join(pa.ListArray.from_arrays(pa.array((offsets - offsets[0]).astype(np.int32)), strings), " ")


def encode_decode(docs: DataFrame, vocabulary: str) -> DataFrame:
    """doc_id, ids (array) and decoded (text) of every whole text."""
    return _run(docs, vocabulary, digests=False)


def report(docs: DataFrame, vocabulary: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of every whole text; the ids and texts stay in the workers."""
    return _run(docs, vocabulary, digests=True)


def _run(docs: DataFrame, vocabulary: str, digests: bool) -> DataFrame:
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = WordBpe.load(vocabulary)
        for batch in batches:
            for part in chunks(batch, most=12_000_000):
                offsets, ids = bpe.encode(part.column(1))
                at = 0
                while at < len(part):  # decoded in slices, for memory
                    stop = max(at + 1, int(np.searchsorted(offsets, offsets[at] + 400_000, side="right")) - 1)
                    cut = offsets[at : stop + 1]
                    own = ids[cut[0] : cut[-1]]
                    texts = bpe.decode(cut, own)
                    if digests:
                        raw = memoryview(own.astype("<u4")).cast("B")
                        ends = (4 * (cut - cut[0])).tolist()
                        hashes = [hashlib.sha256(raw[a:b]).hexdigest() for a, b in zip(ends[:-1], ends[1:], strict=True)]
                        decoded = [hashlib.sha256(t.as_buffer()).hexdigest() for t in texts]
                        yield pa.RecordBatch.from_arrays([part.column(0).slice(at, stop - at), pa.array(np.diff(cut)), pa.array(hashes), pa.array(decoded)], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])
                    else:
                        lists = pa.ListArray.from_arrays(pa.array((cut - cut[0]).astype(np.int32)), pa.array(own))
                        yield pa.RecordBatch.from_arrays([part.column(0).slice(at, stop - at), lists, texts], ["doc_id", "ids", "decoded"])
                    at = stop

    kind = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" if digests else "doc_id long, ids array<int>, decoded string"
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, kind)
