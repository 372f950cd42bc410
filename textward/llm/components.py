"""Connected components of a table of links: links are contracted where they lie, then alternating large-star and small-star
rounds join what is left.

The contraction replaces each stretch of links by a spanning forest of stars, so that copies of a link and long chains are gone
before the first shuffle and few rounds are needed. A round is two joins on nodes; minima are aggregated before the shuffle,
hubs are split by adaptive execution, and each round's links are written to the shared folder, in one job that also tells
whether the round changed a link. The driver sees only that.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from .common import saved, ship

#: Links that are contracted together.
STRETCH = 500_000


def forest(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each node but the smallest of its component, and that smallest."""
    nodes, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = at[: len(u)], at[len(u) :]
    root = np.arange(len(nodes))
    while len(a):
        x, y = root[a], root[b]
        apart = x != y
        a, b, x, y = a[apart], b[apart], x[apart], y[apart]
        np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
        while (root[root] != root).any():
            root = root[root]
    own = np.flatnonzero(root != np.arange(len(nodes)))
    return nodes[own], nodes[root[own]]


def _contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: list[tuple[np.ndarray, np.ndarray]] = []
    n = 0

    def flush() -> pa.RecordBatch:
        u, v = forest(*(np.concatenate(x) for x in zip(*held, strict=True)))
        return pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], ["u", "v"])

    for batch in batches:
        held.append((batch.column(0).to_numpy(), batch.column(1).to_numpy()))
        n += len(batch)
        if n >= STRETCH:
            yield flush()
            held, n = [], 0
    if n:
        yield flush()


def _stars(edges: DataFrame, large: bool) -> DataFrame:
    """One round over links (u, v) with u > v."""
    if large:
        both = edges.union(edges.select("v", "u"))
        least = both.groupBy("u").agg(F.min("v").alias("m"))
        joined = both.join(least, "u").withColumn("m", F.least("u", "m")).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        least = edges.groupBy("u").agg(F.min("v").alias("m"))
        joined = edges.join(least, "u").select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("e")).select("e.u", "e.v")
    return joined.where("u <> v").distinct()


def components(links: DataFrame) -> DataFrame:
    """node and component (the smallest node that links reach) for every node with a link to another; links has columns u and v
    (long). Links with a null end or to the node itself say nothing. Links that a Python function made should be saved first, so
    that a task does not need a second Python process."""
    ship(links.sparkSession)
    own = links.select("u", "v").where("u <> v").mapInArrow(_contract, "u long, v long")
    edges, before = _written(own.distinct())
    while before[0]:
        edges, after = _written(_stars(_stars(edges, large=True), large=False))
        if after == before:  # a round that changes no link ends it
            break
        before = after
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).union(edges.select("v", "v").distinct())


def _written(edges: DataFrame) -> tuple[DataFrame, tuple[int, int, int]]:
    """Cut the lineage; with the links' number and two sums of their hashes, which tell one set of links from another."""
    seen = Observation()
    half = lambda seed: F.sum(F.shiftright(F.xxhash64(F.lit(seed), "u", "v"), 24))
    out = saved(edges.observe(seen, F.count(F.lit(1)).alias("n"), half(1).alias("a"), half(2).alias("b")), "links")
    found = seen.get
    return out, (found.get("n") or 0, found.get("a") or 0, found.get("b") or 0)
