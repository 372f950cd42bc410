import random
import zlib

import numpy as np
import public_tokenizers as P
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from textward.llm import packing, token_store, word_bpe
from textward.llm.byte_tokens import ByteEncoder

BYTE, WORD = P.path("byte_bpe_50k.json"), P.path("word_bpe_49k.json")
ODD = ["", None, "a  b", " a", "a ", "  ", "a\n b", "a \nb", "a \n b", "a\n \nb", "x <|endoftext|> y", "x\n <|endoftext|>", "<|startoftext|>A", "a\xa0 b", "a \xa0b", " 　 z", "it's we'll\t \tx", "é ü", "ΑΣ ΟΔΟΣ", "İ", "a\x1c!\x1c b", "日本語 12 ½", "a" * 300, "ab" * 3000, "\x00\x01", "😀‍b"]


def texts():
    rng = random.Random(1)
    alphabet = " \n\ta1.é'sxSΣ\xa0\x0b\x85<|>"
    return ODD + ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 14))) for _ in range(1500)]


def docs(spark, rows):
    return spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, start string")  # a clashing extra column


def test_byte_ids_are_the_librarys():
    own, plain = ByteEncoder.load(BYTE), Tokenizer.from_file(BYTE)
    offsets, ids = own.encode(pa.array(texts(), pa.string()))
    for k, t in enumerate(texts()):
        assert ids[offsets[k] : offsets[k + 1]].tolist() == plain.encode(t or "", add_special_tokens=False).ids, t


def test_word_ids_and_texts_are_the_librarys():
    own, plain = word_bpe.WordBpe.load(WORD), Tokenizer.from_file(WORD)
    offsets, ids = own.encode(pa.array(texts(), pa.string()))
    decoded = own.decode(offsets, ids).to_pylist()
    for k, t in enumerate(texts()):
        want = plain.encode(t or "", add_special_tokens=False).ids
        assert ids[offsets[k] : offsets[k + 1]].tolist() == want, t
        assert decoded[k] == plain.decode(want, skip_special_tokens=False)


@pytest.mark.parametrize("n", [1, 2, 5, 900, 40_000])
def test_code_is_complete_bounded_and_reversible(n):
    rng = np.random.default_rng(n)
    counts = np.zeros(n + 3, np.int64)
    counts[:n] = (1e6 / (1 + rng.permutation(n)) ** 1.4).astype(int) + 1
    lengths = token_store.code_lengths(counts)
    assert lengths.max() <= token_store.LONGEST and (lengths[counts == 0] == 0).all()
    used = lengths[lengths > 0].astype(float)
    assert n == 1 or (2.0**-used).sum() == pytest.approx(1)
    code, ids = token_store.Code(lengths), rng.choice(n, 5003, p=counts[:n] / counts.sum())
    assert (code.decode(*code.encode(ids), len(ids)) == ids).all()


def test_limited_lengths_are_optimal():
    def best(counts, longest):  # all nondecreasing length vectors that fill the tree
        def go(k, left, lo):
            if k == len(counts):
                return 0 if left >= 0 else float("inf")
            return min((c * counts[k] + go(k + 1, left - 2 ** (longest - c), c) for c in range(lo, longest + 1) if left - 2 ** (longest - c) >= 0), default=float("inf"))

        return go(0, 2**longest, 1)

    counts = np.array([100, 60, 20, 8, 3, 2, 1])
    for longest in (3, 4, 6):
        assert int((token_store.code_lengths(counts, longest) * counts).sum()) == best(counts.tolist(), longest)


def test_store_round_trip(spark):
    rows = [(7, "b b b"), (3, None), (5, ""), (1, "hello world"), (5, "again"), (None, "null id"), (2, "long " * 3000)]
    got = token_store.token_store(docs(spark, rows), BYTE, end=0, with_ids=True).collect()
    plain = Tokenizer.from_file(BYTE)
    want = sorted((i if i is not None else -1, plain.encode(t or "", add_special_tokens=False).ids + [0]) for i, t in rows)
    got = sorted(((r.doc_id if r.doc_id is not None else -1, r.start, r.n_tokens, r.ids_crc32, list(r.ids)) for r in got), key=lambda r: r[1])
    start = 0
    for (doc_id, ids), (g, s, n, crc, own) in zip(want, got, strict=True):
        assert (g, s, n, own) == (doc_id, start, len(ids), ids) and crc == zlib.crc32(np.array(ids, "<u4").tobytes())
        start += n


def test_empty_tables(spark):
    empty = docs(spark, [])
    assert token_store.token_store(empty, BYTE).count() == 0
    assert packing.pack(empty, BYTE).count() == 0
    assert word_bpe.report(empty, WORD).count() == 0


def test_plan_holds_every_piece_once_and_matches_large_ones():
    rng = np.random.default_rng(4)
    for _ in range(60):
        counts = {int(n): int(c) for n, c in zip(rng.integers(1, 1025, 80), rng.integers(0, 40, 80), strict=True)}
        found: dict[int, int] = {}
        for own, k in packing.plan(counts, 1024):
            assert k > 0 and sum(own) <= 1024 and sum(3 * n > 1024 for n in own) <= 2
            for n in own:
                found[n] = found.get(n, 0) + k
        assert found == {n: c for n, c in counts.items() if c}
    assert sum(k for _, k in packing.plan({600: 2, 424: 2, 300: 1, 724: 1}, 1024)) == 3


def test_packing(spark):
    rows = [(k, "word " * (k * 37 % 900)) for k in range(120)] + [(500, "x y " * 2000), (501, None), (502, ""), (502, "")]
    got = packing.pack(docs(spark, rows), BYTE).collect()
    plain = Tokenizer.from_file(BYTE)
    sequences: dict[int, list] = {}
    by_doc: dict[int, list] = {}
    for r in got:
        sequences.setdefault(r.sequence_id, []).append(r)
        by_doc.setdefault(r.doc_id, []).append(r)
    for own in sequences.values():
        at = 0
        for r in sorted(own, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 1024
    for i, t in rows[:-2]:
        ids, at = plain.encode(t or "", add_special_tokens=False).ids + [2], 0
        for k, r in enumerate(sorted(by_doc[i], key=lambda r: r.piece)):
            assert (r.piece, r.start) == (k, at) and (k == 0 or r.length == 1024)
            assert r.ids_crc32 == zlib.crc32(np.array(ids[at : at + r.length], "<u4").tobytes())
            at += r.length
        assert at == len(ids)
    assert len(by_doc[502]) == 2
    total = sum(r.length for r in got)
    assert len(sequences) <= 1.05 * total / 1024 + 1
