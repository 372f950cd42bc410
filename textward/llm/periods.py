"""Periodic runs of words, by Karp-Miller-Rosenberg naming.

Every stretch of 2**k words gets a number, equal for equal stretches, from the numbers of its two halves; positions whose stretch is
the only one of its kind are left out of the next level's sort. The longest common extension of two positions is then read by
descending the levels, for many pairs at once in numpy. A run of period q covers two neighbouring points of the grid 0, q, 2q, ...
with equal words at both and their successors, so for each q only pairs (i, i + q) of grid points are tried, n/q of them, and those whose
words differ, or whose stretch of half the needed length agrees on neither side, are dropped first. Each run is found at the first grid
point within it. Nothing is hashed and no suffixes are sorted.

A run is a stretch of words with smallest period q and a length of at least max(least, 2q) that no neighbouring word extends with
period q. Of stretches found with several periods the smallest counts; where both give the same stretch it divides the others.

Documents are independent; short ones are handled together, a slice of at most `SLICE` bytes of text at a time, each closed by a word
of its own, and a longer one alone. Memory: 4 bytes for each word and level, a level for each doubling of the longest repeated stretch.
A null or empty text has no words. A null doc_id is kept. Repeated rows are handled each. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .byte_tokens import chunks
from .common import ship

SLICE = 2_000_000
#: Pairs of grid points that are tried at once.
PAIRS = 1_000_000
OUT = "doc_id long, n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string"


def named(ids: np.ndarray) -> np.ndarray:
    """names[k, i]: the number of the 2**k words at i; of a stretch that ends beyond the words, a number of its own."""
    n = len(ids)
    levels = [ids.astype(np.int32)]
    often = np.bincount(ids)[ids] > 1 if n else np.zeros(0, bool)
    half = 1
    while often.any():
        pairs = np.zeros(n, bool)
        pairs[: n - half] = often[: n - half] & often[half:]
        at = np.flatnonzero(pairs)
        last = levels[-1]
        own, name, count = np.unique(last[at].astype(np.int64) * (int(last.max()) + 1) + last[at + half], return_inverse=True, return_counts=True)
        if len(own) == len(at):
            break
        level = np.arange(len(own), len(own) + n, dtype=np.int32)
        level[at] = name
        levels.append(level)
        often = np.zeros(n, bool)
        often[at] = count[name] > 1
        half *= 2
    return np.stack(levels)


def _extended(names: np.ndarray, i: np.ndarray, q: np.ndarray, back: bool) -> np.ndarray:
    """How many words from i on, or before i, equal those q further."""
    got = np.zeros(len(i), np.int64)
    for k in range(len(names) - 1, -1, -1):
        # a place before the first word counts from the end, where the last word is the only one of its kind
        at = i - got - (1 << k) if back else i + got
        got += (names[k, at] == names[k, at + q]).astype(np.int64) << k
    return got


def runs_of(ids: np.ndarray, begins: np.ndarray, lengths: np.ndarray, least: int = 12) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Document, start (in it), length and period of every run, by document, start and period. ids has a word after each document that
    stands nowhere else."""
    names = named(ids)
    most = lengths // 2
    doc = np.repeat(np.arange(len(lengths)), most)
    period = np.arange(1, len(doc) + 1) - np.repeat(np.cumsum(most) - most, most)
    long = lengths[doc] >= np.maximum(least, 2 * period)
    doc, period = doc[long], period[long]
    number = (lengths[doc] - 1) // period  # of pairs of grid points
    ends = np.cumsum(number)
    found: list[np.ndarray] = []
    at = 0
    while at < len(doc):
        stop = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + PAIRS, side="right")))
        n = number[at:stop]
        q = np.repeat(period[at:stop], n)
        step = np.arange(len(q)) - np.repeat(np.cumsum(n) - n, n)
        i = np.repeat(begins[doc[at:stop]], n) + step * q
        same = np.flatnonzero(ids[i] == ids[i + q])
        i, q, d = i[same], q[same], np.repeat(doc[at:stop], n)[same]
        need = np.maximum(q, least - q)  # words that have to equal those q further, half of them on one side of i at least
        k = np.log2((need + 1) // 2).astype(np.int64)
        size = np.left_shift(1, k)
        k = np.minimum(k, len(names) - 1)
        ahead = names[k, i] == names[k, i + q]
        behind = names[k, i - size] == names[k, i - size + q]
        some = np.flatnonzero((ahead | behind) & (size < 2 << (len(names) - 1)))
        i, q, d, need = i[some], q[some], d[some], need[some]
        back = _extended(names, i, q, back=True)
        some = np.flatnonzero(back < q)
        i, q, d, need, back = i[some], q[some], d[some], need[some], back[some]
        ahead = _extended(names, i, q, back=False)
        some = back + ahead >= need
        found.append(np.stack([d, i - back - begins[d], back + ahead + q, q])[:, some])
        at = stop
    d, start, length, q = np.concatenate(found, axis=1) if found else np.zeros((4, 0), np.int64)
    order = np.lexsort((q, length, start, d))
    d, start, length, q = d[order], start[order], length[order], q[order]
    first = np.ones(len(d), bool)
    first[1:] = (np.diff(d) != 0) | (np.diff(start) != 0) | (np.diff(length) != 0)
    d, start, length, q = d[first], start[first], length[first], q[first]
    order = np.lexsort((q, start, d))
    return d[order], start[order], length[order], q[order]


def _slice(ids: list[int | None], texts: list[str | None], prepare: Callable[[int | None, list[bytes]], list[bytes]] | None, least: int) -> tuple[list[int], list[list[dict]], list[str]]:
    words = [t.encode("utf-8", "surrogatepass").split() if t else [] for t in texts]
    if prepare is not None:
        words = [prepare(i, w) for i, w in zip(ids, words, strict=True)]
    lengths = np.array([len(w) for w in words], np.int64)
    begins = np.cumsum(lengths + 1) - lengths - 1
    known: dict[bytes, int] = {}
    flat = np.empty(int(lengths.sum()) + len(words), np.int64)
    for b, w in zip(begins.tolist(), words, strict=True):
        flat[b : b + len(w)] = [known.setdefault(x, len(known)) for x in w]
    flat[begins + lengths] = len(known) + np.arange(len(words))
    d, start, length, q = runs_of(flat, begins, lengths, least)
    depth = np.zeros(len(flat) + 1, np.int64)
    np.add.at(depth, begins[d] + start + q, 1)
    np.add.at(depth, begins[d] + start + length, -1)
    stays = np.cumsum(depth)[:-1] == 0
    runs: list[list[dict]] = [[] for _ in words]
    for k, a, n, p in zip(d.tolist(), start.tolist(), length.tolist(), q.tolist(), strict=True):
        runs[k].append({"start": a, "length": n, "period": p})
    collapsed = []
    for k, (b, w) in enumerate(zip(begins.tolist(), words, strict=True)):
        if runs[k]:
            own = stays[b : b + len(w)].tolist()
            w = [x for x, keep in zip(w, own, strict=True) if keep]
        collapsed.append(b" ".join(w).decode("utf-8", "surrogatepass"))
    return lengths.tolist(), runs, collapsed


def periodic_runs(docs: DataFrame, least: int = 12, prepare: Callable[[int | None, list[bytes]], list[bytes]] | None = None) -> DataFrame:
    """doc_id, n_words, the runs in order of start and period, and the text without the words that only repeat: those that a run
    holds after its first period. `prepare` may change a document's words first."""
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))
        for batch in batches:
            for part in chunks(batch, most=SLICE):
                n, runs, collapsed = _slice(part.column(0).to_pylist(), part.column(1).to_pylist(), prepare, least)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(n, pa.int64()), pa.array(runs, kind), pa.array(collapsed, pa.string())], ["doc_id", "n_words", "runs", "collapsed"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, OUT)


def repeated_tail(doc_id: int | None, words: list[bytes]) -> list[bytes]:
    """A trial: of every tenth document by crc32 of its id, the words from a place on repeat the first few of them."""
    import zlib

    n = len(words)
    if doc_id is None or not n:
        return words
    g, rest = divmod(zlib.crc32(str(doc_id).encode()), 10)
    if rest:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + (words[a : a + p] * (-(-(n - a) // p)))[: n - a]


def report(docs: DataFrame) -> DataFrame:
    """doc_id, the number of runs, the longest one, and digests of the runs and of the collapsed text."""
    key = lambda x: F.struct((-x["length"]).alias("n"), x["start"].alias("start"), x["period"].alias("period"))
    best = F.array_min(F.transform("runs", key))
    line = F.transform("runs", lambda x: F.concat(x["start"].cast("string"), F.lit(","), x["length"].cast("string"), F.lit(","), x["period"].cast("string"), F.lit("\n")))
    # array_min and array_join are empty for no runs: nulls, and the hash of the empty text
    found = periodic_runs(docs, prepare=repeated_tail).withColumn("best", best)
    return found.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), "best.start", (-F.col("best.n")).alias("length"), "best.period", F.expr("(-1000 * best.n) div best.period").alias("exponent_milli"),
        F.sha2(F.array_join(line, "").cast("binary"), 256).alias("runs_sha256"), F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"), "n_words",
    )
