"""Best-fit packing by large-item matching, planned on the histogram of lengths.

Pieces above a third of the capacity fit at most twice into a sequence, so they are matched greedily: the longest piece
takes the longest partner that still fits. Shorter pieces, longest first, go where the gap left is the smallest that holds
them. All pieces of a length are alike, so the plan is made on `capacity` counts, whatever the number of documents; the
pieces of a length then take its places in turn. A length's pieces are numbered by pre-aggregated counts of (partition,
length), never by gathering a length in one task.

A null text counts as empty (one piece: the end id). Rows that repeat a doc_id are packed each, and a null doc_id is kept. An empty
table gives no rows. Other columns, whatever their names, are not read.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .byte_tokens import ByteEncoder, chunks
from .common import ship, work_dir


def plan(counts: dict[int, int], capacity: int) -> list[tuple[list[int], int]]:
    """Sequences as (lengths in it, how many alike) for counts[length] pieces of each length."""
    left = {n: c for n, c in counts.items() if c}
    large = sorted(n for n in left if 3 * n > capacity)
    bins: list[tuple[list[int], int]] = []
    while large:
        n = large[-1]
        fits = bisect_left(large, capacity - n + 1) - 1
        if fits < 0 or (m := large[fits]) == n and left[n] == 1:
            m = large[fits - 1] if fits > 0 else None
        if m is None:
            k, own = left[n], [n]
        else:
            k, own = (left[n] // 2 if m == n else min(left[n], left[m])), [n, m]
        for x in own:
            left[x] -= k
        bins.append((own, k))
        large = [x for x in large if left[x]]
    gaps: list[int] = []
    at_gap: dict[int, list[tuple[list[int], int]]] = {}

    def put(own: list[int], k: int) -> None:
        if k:
            gap = capacity - sum(own)
            if gap not in at_gap:
                insort(gaps, gap)
            at_gap.setdefault(gap, []).append((own, k))

    for own, k in bins:
        put(own, k)
    for n in sorted((n for n in left if 3 * n <= capacity), reverse=True):
        c = left[n]
        while c:
            i = bisect_left(gaps, n)
            if i == len(gaps):
                fit = capacity // n
                put([n] * fit, c // fit)
                put([n] * (c % fit), 1 if c % fit else 0)
                break
            gap = gaps[i]
            own, k = at_gap[gap].pop()
            if not at_gap[gap]:
                del at_gap[gap]
                gaps.pop(i)
            fit = gap // n
            full = min(k, c // fit)
            put([*own, *[n] * fit], full)
            c -= full * fit
            k -= full
            if k and 0 < c < fit:
                put([*own, *[n] * c], 1)
                c, k = 0, k - 1
            put(own, k)
    return [x for same in at_gap.values() for x in same]


def places(bins: list[tuple[list[int], int]]) -> dict[int, list[np.ndarray]]:
    """For each length, runs of places: first rank, first sequence and offset of each run, in order."""
    runs: dict[int, list[tuple[int, int, int]]] = {}
    used: dict[int, int] = {}
    sequence = 0
    for own, k in bins:
        offset = 0
        for n in own:
            runs.setdefault(n, []).append((used.get(n, 0), sequence, offset))
            used[n] = used.get(n, 0) + k
            offset += n
        sequence += k
    return {n: [np.array(x, np.int64) for x in zip(*r, strict=True)] for n, r in runs.items()}


def pieces(docs: DataFrame, tokenizer: str, end: int, capacity: int) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32: every text's ids and the end id, cut where longer than the capacity; the first
    piece takes what the full ones leave."""
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = ByteEncoder.load(tokenizer)
        for batch in batches:
            for part in chunks(batch):
                offsets, ids = encoder.encode(part.column(1))
                raw = np.insert(ids, offsets[1:], end).astype("<u4")
                begins = offsets + np.arange(len(offsets))
                sizes = np.diff(begins)
                number = -(-sizes // capacity)
                row = np.repeat(np.arange(len(sizes)), number)
                piece = np.arange(len(row)) - np.repeat(np.cumsum(number) - number, number)
                head = (sizes - 1) % capacity + 1
                start = np.where(piece == 0, 0, head[row] + (piece - 1) * capacity)
                length = np.where(piece == 0, head[row], capacity)
                view = memoryview(raw).cast("B")
                first = (begins[row] + start).tolist()
                crc = [zlib.crc32(view[4 * a : 4 * (a + n)]) for a, n in zip(first, length.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(row)), pa.array(piece, pa.int32()), pa.array(start), pa.array(length), pa.array(crc, pa.int64())], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long")


def pack(docs: DataFrame, tokenizer: str, end: int = 2, capacity: int = 1024) -> DataFrame:
    """A row per piece with its sequence_id and offset in it."""
    spark = docs.sparkSession
    path = work_dir(spark, "pieces")
    pieces(docs, tokenizer, end, capacity).withColumn("part", F.spark_partition_id()).write.parquet(path)
    cut = spark.read.schema("doc_id long, piece int, start long, length long, ids_crc32 long, part int").parquet(path)
    by_part = cut.groupBy("part", "length").agg(F.count(F.lit(1)).alias("n"))
    counts = {r["length"]: r["n"] for r in by_part.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most `capacity` rows
    runs = places(plan(counts, capacity))
    before = by_part.withColumn("before", F.sum("n").over(Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)))
    within = F.row_number().over(Window.partitionBy("part", "length").orderBy("doc_id", "piece", "ids_crc32")) - 1
    ranked = cut.withColumn("within", within).join(before.select("part", "length", F.coalesce("before", F.lit(0)).alias("before")), ["part", "length"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = batch.column(3).to_numpy(), batch.column(5).to_numpy()
            sequence, offset = np.empty(len(batch), np.int64), np.empty(len(batch), np.int64)
            for n in np.unique(length).tolist():
                of = np.flatnonzero(length == n)
                first, at, inside = runs[n]
                k = np.searchsorted(first, rank[of], side="right") - 1
                sequence[of], offset[of] = at[k] + rank[of] - first[k], inside[k]
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(sequence), pa.array(offset)], ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    ranked = ranked.select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("within") + F.col("before")).alias("rank"))
    return ranked.mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
