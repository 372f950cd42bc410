"""Sharding on a consistent-hash ring with virtual nodes and bounded loads.

Each shard stands at `virtual` places of a ring of 64-bit hashes; a row belongs to the arc that ends at the next place clockwise.
A shard takes no more rows than its bound; rows of a full shard continue clockwise to the next place whose shard has room. With
`slack` 0 the bounds are the counts of an even split, so counts differ by one at most; with slack e, no shard takes more than 1 + e
times the mean, and fewer rows move when shards or rows are added.

The driver plans on the number of rows of each arc alone: shards * virtual numbers, whatever the input. Each shard fills up once, so
the plan has at most one block of rows more for each shard. Which rows of an arc go on is decided by their order on the ring: ranges
of the ring are dealt over tasks and written with their places; a row's rank in its arc is its place in the task and the counts of the
tasks before, so no arc is gathered. Texts are reduced to size and checksum before anything is moved.

Order, and so the result, does not depend on the number of tasks. Rows that repeat a doc_id stand at one place of the ring and are
told apart by checksum and size; rows alike in all three are interchangeable and counted each. A null doc_id has its place too, a null text no bytes.
An empty table gives no rows. Other columns are not read.
"""

from __future__ import annotations

from bisect import bisect_left

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import saved

#: Bytes that a row counts besides its text.
EXTRA = 8


def ring(spark: SparkSession, shards: int, virtual: int) -> tuple[list[int], list[int]]:
    """The places in order, and the shard of each."""
    nodes = spark.range(shards * virtual).select(F.xxhash64(F.lit("shard"), F.col("id") % shards, F.floor(F.col("id") / shards)).alias("at"), (F.col("id") % shards).cast("int").alias("shard"))
    rows = sorted(nodes.collect())  # shards * virtual rows
    return [r["at"] for r in rows], [r["shard"] for r in rows]


def bounds(rows: int, shards: int, slack: float) -> list[int]:
    """How many rows each shard may take."""
    if slack:
        return [-(-int(rows * (1 + slack)) // shards)] * shards
    return [rows // shards + (s < rows % shards) for s in range(shards)]


def plan(counts: list[int], owner: list[int], room: list[int]) -> list[tuple[int, int, int, int, int]]:
    """Blocks (arc, first rank, end, shard, first slot) that place every arc's rows. Arcs come to their own shard first, in the ring's
    order; then what is left of each goes on, in the same order."""
    room = list(room)
    used = [0] * len(room)
    blocks: list[tuple[int, int, int, int, int]] = []

    def place(arc: int, first: int, shard: int) -> int:
        n = min(counts[arc] - first, room[shard])
        if n:
            blocks.append((arc, first, first + n, shard, used[shard]))
            room[shard] -= n
            used[shard] += n
        return first + n

    reached = [place(arc, 0, owner[arc]) for arc in range(len(counts))]
    free = [k for k, s in enumerate(owner) if room[s]]
    for arc in range(len(counts)):
        while reached[arc] < counts[arc]:
            shard = owner[free[bisect_left(free, arc) % len(free)]]
            reached[arc] = place(arc, reached[arc], shard)
            if not room[shard]:
                free = [k for k in free if owner[k] != shard]
    return blocks


def assign(docs: DataFrame, shards: int = 24, virtual: int = 128, slack: float = 0.0) -> DataFrame:
    """doc_id, size, text_crc32, arc, home (the shard that the ring alone gives), shard and slot (gapless in each shard) of every row."""
    spark = docs.sparkSession
    places, owner = ring(spark, shards, virtual)

    @F.pandas_udf("int")
    def arc_of(at: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(np.array(places, np.int64), at.to_numpy(np.int64)) % len(places)).astype("int32")

    text = F.coalesce("text", F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (F.octet_length(text) + EXTRA).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
    rows = rows.withColumn("at", F.xxhash64("doc_id")).withColumn("arc", arc_of("at"))
    order = ["at", "doc_id", "text_crc32", "size"]
    dealt = saved(rows.repartitionByRange(*order).withColumn("part", F.spark_partition_id()), "ring")
    tasks = dealt.groupBy("part", "arc").agg(F.count(F.lit(1)).alias("n"))
    counts = [0] * len(places)
    for r in tasks.groupBy("arc").agg(F.sum("n").alias("n")).collect():  # at most shards * virtual rows
        counts[r["arc"]] = r["n"]
    blocks = plan(counts, owner, bounds(sum(counts), shards, slack))
    table = spark.createDataFrame([(*b, owner[b[0]]) for b in blocks], "arc int, first long, end long, shard int, slot long, home int")
    before = tasks.select("part", "arc", F.sum("n").over(Window.partitionBy("arc").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)).alias("before"))
    within = F.row_number().over(Window.partitionBy("part", "arc").orderBy(*order)) - 1
    ranked = dealt.withColumn("within", within).join(before, ["part", "arc"]).withColumn("rank", F.col("within") + F.coalesce("before", F.lit(0)))
    # shards * virtual + shards blocks at most
    found = ranked.join(F.broadcast(table), "arc").where((F.col("rank") >= F.col("first")) & (F.col("rank") < F.col("end")))
    return found.select("doc_id", "size", "text_crc32", "arc", "home", "shard", (F.col("slot") + F.col("rank") - F.col("first")).alias("slot"))


def report(docs: DataFrame) -> DataFrame:
    """Every document's shard among 24, with counts at most one apart."""
    out = assign(docs, shards=24, virtual=128, slack=0.0)
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "home")
