"""Toxicity: FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

A word is lower-cased and without punctuation at its ends; its stem is its first STEM letters, as one abusive stem may have many
endings. Features of a text, each present or not, hashed into 2^BITS buckets: its words, its stems, pairs of neighbouring stems,
and pairs with one word between. Weights are learned with per-coordinate rates and an L1 term that leaves most at exactly
zero; only (bucket, weight) pairs other than zero leave the task that learns, at most 2^BITS of them. Toxic rows are few, so the
bias that is learned leaves many of them just below one half; lifted() corrects it by folds of the rows learned from.

The classifier is fitted in one task on at most max_rows labelled rows, those with the smallest hashes of doc_id; this bound
is the `max_rows` parameter. Features are made where the rows are. Scoring reads every whole text. A null or empty text has
no features and gets the bias alone. Rows without a label, or with a null doc_id, are not learned from; a doc_id with labels
of both kinds counts as toxic. Where the labelled rows are none or all of one kind there is no classifier: every score is 0.
Repeated rows are scored each; other columns are not used. An empty table gives an empty result. Neither the order of rows
nor their partitions matter.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .byte_tokens import chunks
from .common import ship

BITS = 20
MASK = (1 << BITS) - 1
MAX_ROWS = 8_000
STEM, EPOCHS, ALPHA, BETA, L1, L2 = 5, 6, 2.0, 1.0, 8.0, 1.0
#: How the edge between clean and toxic is chosen; see lifted().
FOLDS, FALSE = 3, 0.015
EDGES = ".,;:!?\"'()[]{}*#$%&|<>-_/\\~`^+=@"


def stem(word: str) -> bytes:
    return word.lower().strip(EDGES)[:STEM].encode()


def _mix(a: np.ndarray, b: np.ndarray, kind: int) -> np.ndarray:
    x = (a.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) ^ (b.astype(np.uint64) + np.uint64(kind)) * np.uint64(0xC2B2AE3D27D4EB4F)
    return (x >> np.uint64(40)).astype(np.int64) & MASK


def features(texts: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(row, bucket) arrays, one pair for each kind of feature; a feature that a text repeats is repeated."""
    split = pc.utf8_split_whitespace(pc.fill_null(texts, ""))
    rows = np.repeat(np.arange(len(split), dtype=np.int32), pc.list_value_length(split).to_numpy(zero_copy_only=False))
    coded = split.flatten().dictionary_encode()
    known = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
    number = lambda words: np.fromiter((zlib.crc32(x) if x else -1 for x in words), np.int64, len(known))[coded.indices.to_numpy()]
    word, full = number(map(stem, known)), number(w.lower().strip(EDGES).encode() for w in known)
    some = word >= 0
    rows, word, full = rows[some], word[some], full[some]
    yield rows, _mix(word, word, 1)
    yield rows, _mix(full, full, 2)
    for gap in (1, 2):
        same = rows[gap:] == rows[:-gap]
        yield rows[gap:][same], _mix(word[:-gap][same], word[gap:][same], 3 + gap)


def _feature_sets(docs: DataFrame) -> DataFrame:
    """place, label and the distinct buckets (binary int32) of every row of (text, place, label)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch, most=4_000_000):
                both = np.unique(np.concatenate([(r.astype(np.int64) << BITS) | b for r, b in features(part.column(0))]))
                cuts = np.searchsorted(both >> BITS, np.arange(len(part) + 1))
                buckets = (both & MASK).astype(np.int32)
                sets = [buckets[a:b].tobytes() for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([part.column(1), part.column(2), pa.array(sets, pa.binary())], ["place", "label", "buckets"])

    return docs.select("text", "place", F.col("label").cast("int").alias("label")).mapInArrow(run, "place long, label int, buckets binary")


def ftrl(sets: list[np.ndarray], labels: np.ndarray) -> tuple[np.ndarray, float]:
    """Weights by bucket, and the bias."""
    z, n = np.zeros(1 << BITS), np.zeros(1 << BITS)
    bias, bias_n = 0.0, 1.0
    order = np.random.default_rng(7)
    for _ in range(EPOCHS):
        for k in order.permutation(len(sets)):
            at = sets[k]
            zs, ns = z[at], n[at]
            ws = np.where(np.abs(zs) <= L1, 0.0, (np.sign(zs) * L1 - zs) / ((BETA + np.sqrt(ns)) / ALPHA + L2))
            g = 1.0 / (1.0 + math.exp(-max(-35.0, min(35.0, bias + ws.sum())))) - labels[k]
            more = np.sqrt(ns + g * g)
            z[at] = zs + g - (more - np.sqrt(ns)) / ALPHA * ws
            n[at] = ns + g * g
            bias_n += g * g
            bias -= ALPHA / math.sqrt(bias_n) * g
    return np.where(np.abs(z) <= L1, 0.0, (np.sign(z) * L1 - z) / ((BETA + np.sqrt(n)) / ALPHA + L2)), bias


def lifted(sets: list[np.ndarray], labels: np.ndarray) -> float:
    """What to add to the bias, as toxic rows are few. The rows are scored by classifiers learned on the other FOLDS - 1 folds; of the
    values that flag at most FALSE of the clean ones, the one with the fewest mistakes, both kinds of rows weighing the same in all; of
    equal ones the middle of the first stretch. 0 where a fold's other rows are all of one kind."""
    logits = np.zeros(len(sets))
    fold = np.arange(len(sets)) % FOLDS
    for f in range(FOLDS):
        rest = np.flatnonzero(fold != f)
        if len(set(labels[rest].tolist())) < 2:
            return 0.0
        w, bias = ftrl([sets[k] for k in rest], labels[rest])
        for k in np.flatnonzero(fold == f):
            logits[k] = bias + w[sets[k]].sum()
    toxic, clean = np.sort(logits[labels == 1]), np.sort(logits[labels == 0])
    lifts = np.arange(0.0, 4.01, 0.05)
    missed = np.searchsorted(toxic, -lifts)  # logits below the lift's edge
    flagged = len(clean) - np.searchsorted(clean, -lifts)
    cost = np.where((flagged <= FALSE * len(clean)) | (lifts == 0), missed * (len(clean) / len(toxic)) + flagged, np.inf)
    best = np.flatnonzero(cost == cost.min())
    stretch = best[: int(np.argmax(np.append(np.diff(best) > 1, True))) + 1]
    return float(lifts[stretch[(len(stretch) - 1) // 2]])


#: Buckets and their weights, ascending, none of them zero; and the bias.
Weights = tuple[np.ndarray, np.ndarray, float]


def sample_of(labelled: DataFrame, max_rows: int) -> DataFrame:
    """text, place (a hash of doc_id) and label of the rows with the smallest places, about nine tenths of max_rows or all."""
    usable = labelled.where(F.col("label").isNotNull() & F.col("doc_id").isNotNull()).select("text", "label", F.xxhash64(F.lit("sample"), F.col("doc_id")).alias("place"))
    n = usable.count()
    # a tenth less than the bound, for the spread of the hash
    return usable if n <= max_rows else usable.where(F.col("place") < -(2**63) + 2**64 * 9 * max_rows // (10 * n))


def learn(labelled: DataFrame, max_rows: int = MAX_ROWS) -> Weights | None:
    """The classifier, or None where the sample of (doc_id, text, label) does not have labels of both kinds."""
    ship(labelled.sparkSession)

    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sets, labels = [], []
        for batch in batches:  # in order of place; no more than max_rows, whatever doc_ids repeat
            for label, x in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                if len(sets) < max_rows:
                    sets.append(np.frombuffer(x, np.int32))
                    labels.append(label)
        if len(set(labels)) < 2:
            return
        w, bias = ftrl(sets, np.array(labels, float))
        bias += lifted(sets, np.array(labels, float))
        at = np.flatnonzero(w)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(at, -1), pa.int32()), pa.array(np.append(w[at], bias))], ["bucket", "weight"])

    sets = _feature_sets(sample_of(labelled, max_rows)).repartition(1).sortWithinPartitions("place", "label", "buckets")
    found = sets.mapInArrow(fit, "bucket int, weight double").toArrow()  # the weights other than zero, at most 2^BITS
    if not len(found):
        return None
    bucket, weight = found["bucket"].to_numpy(), found["weight"].to_numpy()
    return bucket[:-1], weight[:-1], float(weight[-1])


def score(docs: DataFrame, weights: Weights | None, keep: list[str]) -> DataFrame:
    """The `keep` columns and `score` of every row; the weights go along with the code."""
    if weights is None:
        return docs.select(*keep, F.lit(0.0).alias("score"))
    ship(docs.sparkSession)
    spots, own, bias = weights

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        dense = np.zeros(1 << BITS)
        dense[spots] = own
        live = dense != 0
        for batch in batches:
            for part in chunks(batch, column="text", most=3_000_000):
                found = []
                for rows, buckets in features(part.column("text")):
                    hit = live[buckets]
                    found.append((rows[hit].astype(np.int64) << BITS) | buckets[hit])
                both = np.unique(np.concatenate(found))
                total = bias + np.bincount(both >> BITS, weights=dense[both & MASK], minlength=len(part))
                scores = 1.0 / (1.0 + np.exp(-np.clip(total, -700, 700)))
                kept = [part.column(c) for c in keep]
                yield pa.RecordBatch.from_arrays([*kept, pa.array(scores)], [*keep, "score"])

    fields = docs.select(*keep).schema.add("score", "double")
    return docs.select(*keep, *([] if "text" in keep else ["text"])).mapInArrow(run, fields)


def held_out(doc_id: Column) -> Column:
    """The fifth of documents that is never learned from."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(5)) == 0, F.lit(False))


def _labelled(docs: DataFrame, labels: DataFrame) -> DataFrame:
    marks = labels.select("doc_id", F.col("toxic").alias("label")).where(~held_out(F.col("doc_id"))).dropna().groupBy("doc_id").agg(F.max("label").alias("label"))
    return docs.select("doc_id", "text").join(marks, "doc_id")


def report(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS) -> DataFrame:
    """doc_id, held_out, score and predicted of every document."""
    weights = learn(_labelled(docs, labels), max_rows)
    ids = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    scored = score(ids, weights, ["doc_id"])
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def keep_clean(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS) -> DataFrame:
    """The documents with a score below 0.5, with their own columns; all of them where labels are too few for a classifier."""
    weights = learn(_labelled(docs, labels), max_rows)
    names = docs.columns
    plain = [f"c{k}" for k in range(len(names))]  # whatever the columns are called
    inner = docs.select(*[docs[c].alias(p) for c, p in zip(names, plain, strict=True)]).withColumn("text", F.col(plain[names.index("text")]))
    scored = score(inner, weights, plain)
    return scored.where(F.col("score") < 0.5).select(*[F.col(p).alias(c) for p, c in zip(plain, names, strict=True)])
