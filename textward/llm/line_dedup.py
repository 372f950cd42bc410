"""Line dedup: drop lines that many documents share, keep them in one document, and put the rest together by position.

A line's key is the line without ASCII white space at both ends and with A-Z lower-cased; keys shorter than min_chars code
points are left alone. Keys are 128 bits of xxhash64 with two seeds. A key in at least min_docs documents is dropped
everywhere but in the largest doc_id that holds it.

Two passes over the lines: each document gives every key once, counted with partial aggregation before the shuffle; then the
positions of all lines join the frequent keys. Keys with a share of 1 / HOT or more of all frequent keys' documents, HOT keys at
most, are told to all tasks, which deal their lines over SALTS joins each. No group's rows are gathered: a document's dropped positions are the longest list. Only DataFrame functions are used.

A null or empty text is one empty line. Each row is a document; rows that repeat a doc_id count each, and all rows with the
largest doc_id keep their lines. A null doc_id is smaller than any other. Other columns are kept as they are; an empty table
gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE_CHARS, ascii_lower, saved

#: Keys that count as hot at most, and the parts that the lines of a hot key are dealt in.
HOT, SALTS = 1_000, 32
NEWLINE = "\n"


def _key(line: Column) -> Column:
    """128 bits of a line's key."""
    low = ascii_lower(line)
    return F.struct(F.xxhash64(low).alias("a"), F.xxhash64(F.lit(1), low).alias("b"))


def _bare(line: Column) -> Column:
    return F.btrim(line, F.lit(SPACE_CHARS))


def dropped_lines(docs: DataFrame, min_chars: int = 40, min_docs: int = 5) -> DataFrame:
    """doc_id, text_hash and positions (array) of the lines to drop, for those documents that lose any."""
    rows = docs.select(F.col("doc_id").alias("id"), F.coalesce("text", F.lit("")).alias("text"))
    lines = F.split("text", NEWLINE)
    long = F.filter(F.transform(lines, _bare), lambda x: F.length(x) >= min_chars)
    keys = rows.select("id", F.explode(F.array_distinct(F.transform(long, _key))).alias("k"))
    frequent = keys.groupBy("k.a", "k.b").agg(F.count(F.lit(1)).alias("n"), F.max("id").alias("last")).where(F.col("n") >= min_docs)
    frequent = saved(frequent.select("a", "b", "n", "last"), "lines")
    total = frequent.agg(F.sum("n")).first()[0] or 0
    hot = F.broadcast(frequent.where(F.col("n") * HOT >= total).select(F.col("a").alias("hot_a"), F.col("b").alias("hot_b")))
    salts = F.sequence(F.lit(0), F.when(F.col("n") * HOT >= total, SALTS - 1).otherwise(0))
    frequent = frequent.select("a", "b", "last", F.explode(salts).alias("salt"))
    each = rows.select("id", F.xxhash64("text").alias("text_hash"), F.posexplode(lines).alias("pos", "line"))
    each = each.withColumn("line", _bare(F.col("line"))).where(F.length("line") >= min_chars)
    each = each.select("id", "text_hash", "pos", _key(F.col("line")).alias("k")).select("id", "text_hash", "pos", "k.a", "k.b")
    salt = F.when(F.col("hot_a").isNotNull(), F.pmod(F.xxhash64("id", "text_hash", "pos"), F.lit(SALTS))).otherwise(0).cast("int")
    each = each.join(hot, (F.col("a") == F.col("hot_a")) & (F.col("b") == F.col("hot_b")), "left").withColumn("salt", salt)
    hits = each.join(frequent, ["a", "b", "salt"]).where(~F.col("id").eqNullSafe(F.col("last")))
    return hits.groupBy("id", "text_hash").agg(F.collect_set("pos").alias("positions"))


def drop_repeated_lines(docs: DataFrame, min_chars: int = 40, min_docs: int = 5) -> DataFrame:
    """The documents with `text` less its dropped lines: row (struct of docs' columns, as they were), text, n_lines, n_dropped."""
    drops = dropped_lines(docs, min_chars, min_docs)
    rows = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"))
    rows = rows.withColumn("t", F.coalesce("row.text", F.lit("")))
    joined = rows.join(drops.hint("shuffle_hash"), F.col("row.doc_id").eqNullSafe(F.col("id")) & (F.xxhash64("t") == F.col("text_hash")), "left")

    def rest(x: Column) -> Column:
        places = F.array_except(F.sequence(F.lit(0), F.size(x["lines"]) - 1), x["positions"])
        return F.array_join(F.transform(places, lambda i: F.get(x["lines"], i)), NEWLINE)

    # the one-element array binds the split lines once for the whole row
    kept = F.transform(F.array(F.struct(F.split("t", NEWLINE).alias("lines"), "positions")), rest)[0]
    return joined.select(
        "row",
        F.when(F.col("positions").isNull(), F.col("t")).otherwise(kept).alias("text"),
        (F.length("t") - F.length(F.replace("t", F.lit(NEWLINE), F.lit(""))) + 1).cast("long").alias("n_lines"),
        F.when(F.col("positions").isNull(), F.lit(0)).otherwise(F.size("positions")).cast("long").alias("n_dropped"),
    )


def report(docs: DataFrame, min_chars: int = 40, min_docs: int = 5) -> DataFrame:
    """doc_id, n_lines, n_dropped and the hash of the text that is kept."""
    return drop_repeated_lines(docs, min_chars, min_docs).select("row.doc_id", "n_lines", "n_dropped", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


#: The same result in DuckDB.
SQL = r"""
WITH d AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
l AS (SELECT doc_id, unnest(ls) AS line, generate_subscripts(ls, 1) AS pos FROM d),
k AS (SELECT doc_id, pos, line, translate(trim(line, concat(' ', chr(9), chr(10), chr(11), chr(12), chr(13))), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
f AS (SELECT key, max(doc_id) AS last FROM k WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT doc_id) >= 5),
m AS (SELECT k.*, coalesce(f.last <> k.doc_id, false) AS drop_it FROM k LEFT JOIN f ON k.key = f.key)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (drop_it) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT drop_it), '')) AS kept_sha256
FROM m GROUP BY doc_id
"""
