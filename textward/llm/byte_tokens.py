"""Byte-level BPE ids of whole texts with the tokenizers library, each distinct part of a slice of texts encoded once.

The pre-tokenizer never joins what stands before a single space with what follows it, nor a letter with a mark or digit after
it; so a text's ids are those of its pieces, each with its leading space, and a piece's those of its parts. Texts where a
space has white space before it and white space or the end after it, or that hold an added token's string or U+0000, are encoded
as a whole.
"""

from __future__ import annotations

import os

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_WS = r"[\s\v\x1c-\x1f\x{85}\p{Z}]"
#: Between a letter and an ASCII mark or digit; only letters that every version of Unicode has.
_BORDER = r"([A-Za-z\x{C0}-\x{D6}\x{D8}-\x{F6}\x{F8}-\x{24F}\x{410}-\x{44F}])([!-&(-@\[-`{-~])"
#: Parts that a worker remembers, the first that it sees; the common ones come early.
CACHED = 200_000
_loaded: dict[str, ByteEncoder] = {}


class ByteEncoder:
    """encode(texts) -> (offsets, ids): row i's ids are ids[offsets[i]:offsets[i + 1]]; a null text has none."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.size = self.tokenizer.get_vocab_size(with_added_tokens=True)
        added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        quoted = "|".join("".join(rf"\x{{{ord(c):x}}}" for c in t) for t in added)
        self.whole = rf"{_WS} ({_WS}|\z)|\x00" + (f"|{quoted}" if quoted else "")
        self.cache: dict[str, bytes] = {}
        #: Bytes of text behind each id: the byte-level alphabet has one character a byte.
        self.bytes_of = np.zeros(self.size, np.int64)
        for token, i in self.tokenizer.get_vocab(with_added_tokens=True).items():
            self.bytes_of[i] = len(token)

    @classmethod
    def load(cls, path: str) -> ByteEncoder:
        """One encoder for each path and Python worker."""
        if path not in _loaded:
            _loaded[path] = cls(path)
        return _loaded[path]

    def _ids(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _new(self, parts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Number of ids of each part, and all ids in order. Parts of a space and more are encoded in runs of some thousands and
        cut apart by the bytes of text behind each id; a call for each would take twice as long."""
        sizes = pc.binary_length(pa.array(parts, pa.string())).to_numpy()
        joint = np.fromiter((len(p) > 1 and p[0] == " " and not p[1].isspace() for p in parts), bool, len(parts))
        lens, flats, order = np.zeros(len(parts), np.int64), [], []
        spaced = np.flatnonzero(joint)
        runs = [spaced[at : at + 4000] for at in range(0, len(spaced), 4000)]
        for run, ids in zip(runs, self._ids(["".join([parts[k] for k in run.tolist()]) for run in runs]), strict=True):
            flat = np.array(ids, np.int32)
            ends = np.searchsorted(np.cumsum(self.bytes_of[flat]), np.cumsum(sizes[run])) + 1
            lens[run] = np.diff(ends, prepend=0)
            flats.append(flat)
            order.append(run)
        alone = np.flatnonzero(~joint)
        found = self._ids([parts[k] for k in alone.tolist()])
        lens[alone] = [len(x) for x in found]
        flats += [np.array(x, np.int32) for x in found]
        order = np.concatenate([*order, alone]) if len(parts) else alone
        starts = np.empty(len(parts), np.int64)
        starts[order] = np.cumsum(lens[order]) - lens[order]
        return lens, _gathered(np.concatenate([*flats, np.zeros(0, np.int32)]), starts, lens, np.arange(len(parts)))

    def _parts(self, parts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Start and number of ids of each part, and the ids."""
        known = list(map(self.cache.get, parts))
        old = [k for k, x in enumerate(known) if x is not None]
        new = [k for k, x in enumerate(known) if x is None]
        texts = [parts[k] for k in new]
        lens, starts = np.zeros(len(parts), np.int64), np.zeros(len(parts), np.int64)
        held = [known[k] for k in old]
        lens[old] = np.fromiter(map(len, held), np.int64, len(held)) // 4
        lens[new], flat = self._new(texts)
        starts[old] = np.cumsum(lens[old]) - lens[old]
        base = int(lens[old].sum())
        starts[new] = base + np.cumsum(lens[new]) - lens[new]
        room = max(0, CACHED - len(self.cache))
        for text, at, n in zip(texts[:room], (starts[new][:room] - base).tolist(), lens[new][:room].tolist(), strict=True):
            self.cache[text] = flat[at : at + n].tobytes()
        return starts, lens, np.concatenate([np.frombuffer(b"".join(held), np.int32), flat])

    def _pieces(self, pieces: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Start and number of ids of each piece, and the ids."""
        split = pc.split_pattern(pc.replace_substring_regex(pieces, _BORDER, "\\1\x00\\2"), "\x00")
        coded = split.flatten().dictionary_encode()
        starts, lens, flat = self._parts(coded.dictionary.to_numpy(zero_copy_only=False).tolist())
        index = coded.indices.to_numpy()
        ids = _gathered(flat, starts, lens, index)
        ends = np.concatenate([[0], np.cumsum(lens[index])])[split.offsets.to_numpy()]
        return ends[:-1], np.diff(ends), ids

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        texts = pc.fill_null(texts, "")
        n = len(texts)
        odd = pc.match_substring_regex(texts, self.whole).to_numpy(zero_copy_only=False).astype(bool)
        plain = np.flatnonzero(~odd)
        totals = np.zeros(n, np.int64)
        ids = np.zeros(0, np.int32)
        if len(plain):
            split = pc.split_pattern(texts.take(pa.array(plain)) if len(plain) < n else texts, " ")
            rows = split.offsets.to_numpy().astype(np.int64)
            rows -= rows[0]
            pieces = split.flatten()
            later, first = pieces.dictionary_encode(), pieces.take(pa.array(rows[:-1])).dictionary_encode()
            del split, pieces
            index = later.indices.to_numpy().copy()
            index[rows[:-1]] = len(later.dictionary) + first.indices.to_numpy()
            spaced = pc.binary_join_element_wise(pa.scalar(""), later.dictionary, " ")
            starts, lens, flat = self._pieces(pa.concat_arrays([spaced, first.dictionary]))
            totals[plain] = np.diff(np.concatenate([[0], np.cumsum(lens[index])])[rows])
            ids = _gathered(flat, starts, lens, index)
        if len(plain) == n:
            return np.concatenate([[0], np.cumsum(totals)]), ids
        whole = {i: np.array(self._ids([texts[i].as_py()])[0], np.int32) for i in np.flatnonzero(odd).tolist()}
        for i, x in whole.items():
            totals[i] = len(x)
        offsets = np.concatenate([[0], np.cumsum(totals)])
        out = np.empty(offsets[-1], np.int32)
        out[np.repeat(~odd, totals)] = ids
        for i, x in whole.items():
            out[offsets[i] : offsets[i + 1]] = x
        return offsets, out


def _gathered(flat: np.ndarray, starts: np.ndarray, lens: np.ndarray, index: np.ndarray) -> np.ndarray:
    """flat[starts[k] : starts[k] + lens[k]] for each k of index, one after another."""
    ends = np.concatenate([[0], np.cumsum(lens[index])])
    out = np.empty(ends[-1], flat.dtype)
    for at in range(0, len(index), 400_000):  # in slices, for the memory of the gather
        part = index[at : at + 400_000]
        a, b = ends[at], ends[at + len(part)]
        out[a:b] = flat[np.repeat(starts[part] - ends[at : at + len(part)], lens[part]) + np.arange(a, b)]
    return out


def chunks(batch: pa.RecordBatch, column: str = "text", most: int = 8_000_000):
    """Slices of a batch of at most that many bytes of text; a longer text is alone in its slice."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    ends = np.cumsum(sizes)
    at = 0
    while at < len(sizes):
        stop = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + most, side="right")))
        yield batch.slice(at, stop - at)
        at = stop
    pa.default_memory_pool().release_unused()
