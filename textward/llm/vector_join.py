"""Embedding near-dedup: an exact metric range join of unit vectors.

Cosine t is the distance r = sqrt(2 - 2t) between unit vectors. Pivots, a bounded sample of the vectors, split the space: a
vector's home is the nearest pivot's cell. By the triangle inequality in its bisector form, a vector within r of some vector
at home in cell i lies at most r beyond the bisector of the two pivots, so it is copied to each such cell with a smaller
number than its own; then every close pair meets in exactly one cell. How many pivots is chosen by cost, estimated on a
sample, among those whose copies are few beside the pairs they save: where the data has no structure, replication would outgrow what
partitioning saves, and one cell with many blocks remains.

A cell's vectors are packed into blocks, one row each, those at home apart from the others, and written once. Blocks then meet
as the cross product of that table with itself, which reads the written blocks again and shuffles nothing: what is
written grows with the vectors, and only the compared pairs grow with their square. Block pairs that are both away from home are
left out. Products are in float32; what is near the threshold is decided in double precision. A block pair returns each
vector's number of links and a spanning forest, never all its pairs.

Equal vectors are first joined into one with a multiplicity, so that copies are counted, not paired. Vectors that are null,
zero or hold null or non-finite components link with nothing, and vectors of different lengths do not link. A null vec_id
links with nothing and has a null component. Rows that repeat a vec_id are vectors each and share a component. An empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import saved, ship
from .components import components

#: Most pivots, vectors in the sample for the choice, vectors and bytes in a block, the cost of copying a vector in compared pairs, and
#: most copies of a vector, on average, that save no pairs.
PIVOTS, SAMPLE, BLOCK, BYTES, COPY, COPIES = 256, 2_000, 4_096, 4 << 20, 2_000, 1.5
#: Most files of blocks, whose pairs of partitions are the tasks that compare.
FILES = 64
#: Products in float32 are surely right beyond this.
MARGIN = 2e-5


def _copies(units: np.ndarray, pivots: np.ndarray, radius: float) -> tuple[np.ndarray, np.ndarray]:
    """Each vector's home, and which cells it is in (its home included)."""
    near = units @ pivots.T
    home = near.argmax(axis=1)
    apart = np.sqrt(np.maximum(2 - 2 * (pivots @ pivots.T), 0))
    lag = near[np.arange(len(units)), home][:, None] - near
    inside = (lag <= radius * apart[home] + 1e-9) & (np.arange(len(pivots)) < home[:, None])
    inside[np.arange(len(units)), home] = True
    return home, inside


def choose_pivots(units: np.ndarray, n: int, radius: float) -> np.ndarray:
    """The pivots with the least estimated cost: compared pairs (of two at home, of one at home with one away), and copies in COPY
    pairs each. A vector has at most COPIES on average, or as many times more as there are fewer pairs than all."""
    best, found = math.inf, units[:1]
    k = 1
    while k <= min(PIVOTS, len(units)):
        home, inside = _copies(units, units[:k], radius)
        at_home, all_in = np.bincount(home, minlength=k) / len(units), inside.mean(axis=0)
        pairs, copies = float(at_home @ (all_in - at_home / 2)), float(all_in.sum())
        cost = n * n * pairs + COPY * n * copies
        if cost < best and copies * 2 * pairs <= COPIES:
            best, found = cost, units[:k]
        k *= 2
    return found


def _join_blocks(left: dict, right: dict | None, threshold: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """ids, number of links and root of every vector with a link. A block is ids, mult, unit, home (bool); without `right`, pairs
    within the block. Pairs that are both away from home belong to another cell."""
    other = left if right is None else right
    n = len(left["ids"])
    ids = np.concatenate([left["ids"], other["ids"]]) if right is not None else left["ids"]
    base = n if right is not None else 0
    mult = np.concatenate([left["mult"], other["mult"]]) if right is not None else left["mult"]
    links, root = np.zeros(len(ids), np.int64), np.arange(len(ids))

    def find(x: np.ndarray) -> np.ndarray:
        while True:
            up = root[x]
            if (root[up] == up).all():
                return up
            root[x] = root[up]
            x = up

    a32, b32 = left["unit"].astype(np.float32), other["unit"].astype(np.float32)
    for at in range(0, n, 512):
        close = a32[at : at + 512] @ b32.T
        i, j = np.nonzero(close >= threshold - MARGIN)
        doubt = close[i, j] < threshold + MARGIN
        i += at
        if right is None:
            keep = i < j
            i, j, doubt = i[keep], j[keep], doubt[keep]
        keep = left["home"][i] | other["home"][j]
        if doubt.any():
            keep[doubt] &= np.einsum("ij,ij->i", left["unit"][i[doubt]], other["unit"][j[doubt]]) >= threshold
        i, j = i[keep], j[keep] + base
        links += np.bincount(i, weights=mult[j], minlength=len(ids)).astype(np.int64)
        links += np.bincount(j, weights=mult[i], minlength=len(ids)).astype(np.int64)
        while len(i):  # unite: the larger root under the smaller, until no pair is apart
            x, y = find(i), find(j)
            apart = x != y
            i, j, x, y = i[apart], j[apart], x[apart], y[apart]
            np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
    some = np.flatnonzero(links)
    return ids[some], links[some], ids[find(some)]


def linked(vectors: DataFrame, threshold: float = 0.95) -> DataFrame:
    """vec_id, n_links, component_id and kept for every row of (vec_id, embedding)."""
    spark = vectors.sparkSession
    ship(spark)
    radius = math.sqrt(2 - 2 * threshold)
    e = F.col("embedding").cast("array<double>")
    norm = F.aggregate(e, F.lit(0.0), lambda s, x: s + x * x)
    finite = norm.isNotNull() & ~F.isnan(norm) & (norm > 0) & (norm < float("inf")) & F.col("vec_id").isNotNull()
    single = vectors.schema["embedding"].dataType.simpleString() == "array<float>"  # kept as they are, in half the bytes
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.when(finite, e).alias("e"))
    rows = rows.select("vec_id", "e", F.when(F.col("e").isNotNull(), F.xxhash64("e")).alias("a"), F.when(F.col("e").isNotNull(), F.xxhash64(F.lit(1), "e")).alias("b"))
    distinct = rows.where(F.col("e").isNotNull()).groupBy("a", "b").agg(F.min("vec_id").alias("id"), F.count(F.lit(1)).alias("mult"), F.first("e").cast("array<float>" if single else "array<double>").alias("e"))
    distinct = saved(distinct.withColumn("dim", F.size("e")), "vectors")
    # lengths with more vectors than a block have pivots each; the vectors of any other length are one block
    large = [r["dim"] for r in distinct.groupBy("dim").count().where(F.col("count") > BLOCK).select("dim").collect()]
    found = _small_dimensions(distinct.where(~F.col("dim").isin(large)) if large else distinct, threshold)
    for dim in large:
        found = found.unionByName(_one_dimension(distinct.where(F.col("dim") == dim), dim, threshold, radius))
    found = saved(found, "close")
    counts = found.groupBy("id").agg(F.sum("links").alias("links"))
    classes = components(found.select(F.col("id").alias("u"), F.col("root").alias("v")))
    known = distinct.select("a", "b", "id", "mult").join(counts, "id", "left").join(classes, F.col("id") == F.col("node"), "left")
    known = known.select("a", "b", (F.coalesce("links", F.lit(0)) + F.col("mult") - 1).alias("n_links"), F.coalesce("component", "id").alias("component_id"))
    out = rows.select("vec_id", "a", "b").join(known, ["a", "b"], "left")
    component = F.coalesce("component_id", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(False)).alias("kept"))


def _small_dimensions(distinct: DataFrame, threshold: float) -> DataFrame:
    """The join within each vector length, of at most BLOCK vectors."""

    def join(table: pa.Table) -> pa.Table:
        e = table["e"].combine_chunks()
        flat = e.flatten().to_numpy().astype(float).reshape(len(e), -1)
        block = {"ids": table["id"].to_numpy(), "mult": table["mult"].to_numpy(), "home": np.ones(len(e), bool), "unit": flat / np.linalg.norm(flat, axis=1, keepdims=True)}
        ids, links, root = _join_blocks(block, None, threshold)
        return pa.table({"id": ids, "links": links, "root": root})

    return distinct.select("dim", "id", "mult", "e").groupBy("dim").applyInArrow(join, "id long, links long, root long")


def _one_dimension(distinct: DataFrame, dim: int, threshold: float, radius: float) -> DataFrame:
    n = distinct.count()
    some = distinct.select("e", F.xxhash64(F.lit("pivot"), "a").alias("o")).orderBy("o").limit(SAMPLE).collect()  # a bounded sample
    units = np.array([r["e"] for r in some], float)
    units /= np.linalg.norm(units, axis=1, keepdims=True)
    pivots = choose_pivots(units, n, radius)

    kind = "<f4" if distinct.schema["e"].dataType.simpleString() == "array<float>" else "<f8"

    def units_of(raw: np.ndarray) -> np.ndarray:
        x = raw.reshape(-1, dim).astype(float)
        return x / np.linalg.norm(x, axis=1, keepdims=True)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            flat = batch.column(2).flatten().to_numpy()
            home, inside = _copies(units_of(flat), pivots, radius)
            at, cell = np.nonzero(inside)
            raw = flat.astype(kind).tobytes()
            size = len(raw) // max(len(batch), 1)
            yield pa.RecordBatch.from_arrays([pa.array(cell, pa.int32()), pa.array(home[at] == cell), batch.column(0).take(pa.array(at)), batch.column(1).take(pa.array(at)), pa.array([raw[size * k : size * (k + 1)] for k in at.tolist()], pa.binary())], ["cell", "home", "id", "mult", "e"])

    def pack(table: pa.Table) -> pa.Table:
        ids, mult = (table[c].to_numpy().astype("<i8").tobytes() for c in ("id", "mult"))
        return pa.table({"cell": table["cell"][:1], "home": table["home"][:1], "block": table["block"][:1], "ids": pa.array([ids], pa.binary()), "mult": pa.array([mult], pa.binary()), "e": pa.array([b"".join(table["e"].to_pylist())], pa.binary())})

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(len(batch)):
                at = {c: batch.column(k)[row] for k, c in enumerate(batch.schema.names)}

                def block(side: str, at: dict = at) -> dict:
                    part = lambda c, t: np.frombuffer(at[side + c].as_buffer(), t)
                    ids = part("ids", "<i8")
                    return {"ids": ids, "mult": part("mult", "<i8"), "home": np.full(len(ids), at[side + "home"].as_py()), "unit": units_of(part("e", kind))}

                ids, links, root = _join_blocks(block("x_"), None if at["same"].as_py() else block("y_"), threshold)
                yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(links), pa.array(root)], ["id", "links", "root"])

    dealt = distinct.select("id", "mult", "e").mapInArrow(deal, "cell int, home boolean, id long, mult long, e binary")
    size = max(1, min(BLOCK, BYTES // (8 * dim)))
    sizes = {(r["cell"], r["home"]): -(-r["n"] // size) for r in dealt.groupBy("cell", "home").agg(F.count(F.lit(1)).alias("n")).collect()}  # at most 2 * PIVOTS rows
    blocks = F.element_at(F.create_map(*[F.lit(x) for (c, h), m in sizes.items() for x in (2 * c + h, m)]), 2 * F.col("cell") + F.col("home").cast("int"))
    own = dealt.withColumn("block", F.pmod(F.xxhash64("id"), blocks).cast("int"))
    # many files, so that many tasks read them: the cross product has a task for each two of a table's partitions
    own = own.repartition(min(sum(sizes.values()), FILES), "cell", "home", "block").groupBy("cell", "home", "block")
    packed = saved(own.applyInArrow(pack, "cell int, home boolean, block int, ids binary, mult binary, e binary"), "blocks")
    x, y = (packed.select(*[F.col(c).alias(side + c) for c in packed.columns]) for side in ("x_", "y_"))
    # both at home: each pair of blocks once; one at home: that one is x
    ordered = F.when(F.col("y_home"), F.col("x_block") <= F.col("y_block")).otherwise(True)
    met = x.where("x_home").join(y.hint("shuffle_replicate_nl"), (F.col("x_cell") == F.col("y_cell")) & ordered)
    same = F.col("y_home") & (F.col("x_block") == F.col("y_block"))
    return met.select(same.alias("same"), "x_home", "x_ids", "x_mult", "x_e", "y_home", "y_ids", "y_mult", "y_e").mapInArrow(join, "id long, links long, root long")


#: The same result in DuckDB, by comparing all pairs.
SQL = """
WITH RECURSIVE v AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS x FROM embeddings),
g AS (SELECT vec_id, x FROM v WHERE x IS NOT NULL AND len(x) > 0 AND len(list_filter(x, lambda y: y IS NULL OR NOT isfinite(y))) = 0 AND len(list_filter(x, lambda y: y <> 0)) > 0),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM g a JOIN g b ON a.vec_id <> b.vec_id AND len(a.x) = len(b.x) WHERE list_cosine_similarity(a.x, b.x) >= 0.95),
r AS (SELECT vec_id AS a, vec_id AS b FROM v UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a),
c AS (SELECT a, min(b) AS component_id FROM r GROUP BY a), n AS (SELECT a, count(*) AS n FROM l GROUP BY a)
SELECT vec_id, coalesce(n, 0) AS n_links, component_id, vec_id = component_id AS kept FROM v JOIN c ON v.vec_id = c.a LEFT JOIN n ON n.a = v.vec_id
"""
