"""Quality rules: base rules of each document, then a verdict on its host.

Base rules: fewer than min_words words, or more than repeat_percent of them in repeated 5-word windows. Hosts: failures are
summed by host, a beta prior is fitted to all hosts' counts by the beta-binomial method of moments, each host's rate is shrunk to the
prior's mean, and hosts whose shrunk rate is above host_limit lose their documents. Hosts weigh as much as they have documents, and
the spread that chance alone gives hosts of their size is taken off: alike hosts give a strong prior however small they are, and
hosts that differ a weak one. Counts are pre-aggregated, so that a hot
host is a row from each task; only the prior's five sums reach the driver. Only DataFrame functions are used.

Words are [^\\x20\\x09-\\x0D]+. A null text has none and fails. A null doc_id is kept, a null host is a host of its own. Repeated rows count each.
An empty table gives an empty result. Other columns are not needed.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE_CHARS, saved, words_of

WINDOW = 5
SYMBOLS = r"[#*$%&|<>]"
MIN_WORDS, REPEAT_PERCENT, HOST_LIMIT = 10, 20, 0.5
#: Strength of the prior where nothing can be told of how hosts differ, and its bounds.
PRIOR, PRIOR_LEAST, PRIOR_MOST = 100.0, 1.0, 10_000.0


def let(value: Column, f: Callable[[Column], Column]) -> Column:
    """f(value) with value computed once, though f names it many times."""
    return F.transform(F.array(value), f)[0]


def repeated_words(words: Column) -> Column:
    """Words that stand in a 5-word window found twice or more. Windows are compared by 64-bit hashes within the text; only a
    text that has equal ones sorts them."""

    def windows(h: Column) -> Column:
        spot = F.sequence(F.lit(0), F.size(h) - WINDOW)
        return F.when(F.size(h) >= WINDOW, F.transform(spot, lambda i: F.xxhash64(*[F.get(h, i + k) for k in range(WINDOW)]))).otherwise(F.array().cast("array<bigint>"))

    def covered(w: Column) -> Column:
        pairs = F.sort_array(F.transform(w, lambda x, i: F.struct(x.alias("h"), i.alias("at"))))

        def twice(s: Column) -> Column:
            same = lambda e, i: F.coalesce(F.get(s, i)["h"] == e["h"], F.lit(False))
            return F.filter(s, lambda e, i: same(e, i - 1) | same(e, i + 1))

        spots = F.sort_array(F.transform(let(pairs, twice), lambda e: e["at"]))
        start = F.struct(F.lit(0).alias("n"), F.lit(-WINDOW).alias("last"))
        step = lambda acc, at: F.struct((acc["n"] + F.least(F.lit(WINDOW), at - acc["last"])).alias("n"), at.alias("last"))
        return F.aggregate(spots, start, step, lambda acc: acc["n"])

    hashes = F.transform(words, lambda x: F.xxhash64(x))
    return let(hashes, lambda h: let(windows(h), lambda w: F.when(F.size(F.array_distinct(w)) == F.size(w), F.lit(0)).otherwise(covered(w))))


def base_rules(docs: DataFrame, host: str = "source", min_words: int = MIN_WORDS, repeat_percent: int = REPEAT_PERCENT) -> DataFrame:
    """doc_id, text_hash, host, the counts and base_failed of every document."""
    text = F.coalesce(F.col("text"), F.lit(""))
    lines = lambda t: F.filter(F.split(t, "\n"), lambda x: F.length(F.btrim(x, F.lit(SPACE_CHARS))) > 0)

    def counts(w: Column) -> Column:
        return F.struct(F.size(w).cast("long").alias("n_words"), F.length(F.array_join(w, "")).cast("long").alias("word_chars"), repeated_words(w).cast("long").alias("n_repeat_words"))

    found = docs.select(
        "doc_id", F.xxhash64(text).alias("text_hash"), F.col(host).alias("host"),
        let(words_of(F.col("text")), counts).alias("w"),
        F.regexp_count(text, F.lit(SYMBOLS)).cast("long").alias("n_symbols"),
        let(lines(text), lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
    )
    found = found.select("doc_id", "text_hash", "host", "w.n_words", "w.word_chars", "n_symbols", "n_dup_lines", "w.n_repeat_words")
    return found.withColumn("base_failed", (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > repeat_percent * F.col("n_words")))


def prior(hosts: int, n: float, failed: float, squares: float, spread: float) -> tuple[float, float]:
    """Mean and strength of the beta prior, from the number of hosts, the sums of their documents n, failures f, n * n and f * f / n."""
    mean = failed / n if n else 0.0
    own = mean * (1 - mean)
    rest = n - squares / n - (hosts - 1) if n else 0.0
    if own <= 0 or rest <= 0:
        return mean, PRIOR
    # the share of the spread that is between hosts; by chance alone the first term is hosts - 1
    alike = ((spread - n * mean * mean) / own - (hosts - 1)) / rest
    return mean, min(PRIOR_MOST, max(PRIOR_LEAST, 1 / alike - 1)) if alike > 0 else PRIOR_MOST


def bad_hosts(rules: DataFrame, host_limit: float = HOST_LIMIT) -> DataFrame:
    """Hosts whose shrunk rate of failures is above the limit: host, rate."""
    hosts = rules.groupBy("host").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("base_failed").cast("long")).alias("failed"))
    n, failed = F.col("n").cast("double"), F.col("failed").cast("double")
    sums = hosts.agg(F.count(F.lit(1)).alias("hosts"), F.sum(n).alias("n"), F.sum(failed).alias("failed"), F.sum(n * n).alias("squares"), F.sum(failed * failed / n).alias("spread")).first()
    mean, strength = prior(sums["hosts"], sums["n"] or 0.0, sums["failed"] or 0.0, sums["squares"] or 0.0, sums["spread"] or 0.0)
    shrunk = (F.col("failed") + F.lit(mean * strength)) / (F.col("n") + F.lit(strength))
    return hosts.select("host", shrunk.alias("rate")).where(F.col("rate") > host_limit)


def judge(docs: DataFrame, host: str = "source", min_words: int = MIN_WORDS, repeat_percent: int = REPEAT_PERCENT, host_limit: float = HOST_LIMIT) -> DataFrame:
    """base_rules() of every document, with kept. The counts are written to the shared folder, as they are used twice."""
    rules = saved(base_rules(docs, host, min_words, repeat_percent), "rules")
    bad = bad_hosts(rules, host_limit).select(F.col("host").alias("bad_host"), F.lit(True).alias("bad"))
    joined = rules.join(bad, F.col("host").eqNullSafe(F.col("bad_host")), "left")
    return joined.withColumn("kept", ~F.col("base_failed") & F.col("bad").isNull()).drop("bad", "bad_host")


def report(docs: DataFrame) -> DataFrame:
    return judge(docs).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def keep_good(docs: DataFrame, host: str = "source") -> DataFrame:
    """The documents that the rules keep, with their own columns."""
    lost = judge(docs, host).where(~F.col("kept")).select(F.col("doc_id").alias("lost_id"), F.col("text_hash").alias("lost_hash"), F.col("host").alias("lost_host")).distinct()
    same = docs["doc_id"].eqNullSafe(F.col("lost_id")) & (F.xxhash64(F.coalesce(docs["text"], F.lit(""))) == F.col("lost_hash")) & docs[host].eqNullSafe(F.col("lost_host"))
    return docs.join(lost.hint("shuffle_hash"), same, "left_anti")


#: The same result in DuckDB.
SQL = r"""
WITH d AS (SELECT doc_id, source AS host, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
g AS (SELECT doc_id, i, w[i] || chr(10) || w[i + 1] || chr(10) || w[i + 2] || chr(10) || w[i + 3] || chr(10) || w[i + 4] AS gram
      FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS i FROM d WHERE len(w) >= 5)),
r AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, gram) AS n FROM g) WHERE n >= 2),
p AS (SELECT doc_id, count(DISTINCT spot) AS n_repeat_words FROM (SELECT doc_id, unnest(range(i, i + 5)) AS spot FROM r) GROUP BY doc_id),
b AS (SELECT d.doc_id, host, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars,
             length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS n_symbols,
             len(list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')))
               - len(list_distinct(list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')))) AS n_dup_lines,
             coalesce(n_repeat_words, 0) AS n_repeat_words
      FROM d LEFT JOIN p USING (doc_id)),
e AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM b),
h AS (SELECT host, count(*) AS n, count(*) FILTER (base_failed) AS failed FROM e GROUP BY host),
m AS (SELECT count(*)::DOUBLE AS k, sum(n)::DOUBLE AS n, sum(failed)::DOUBLE / sum(n) AS mean, sum(n::DOUBLE * n) AS squares, sum(failed::DOUBLE * failed / n) AS spread FROM h),
o AS (SELECT mean, n - squares / n - (k - 1) AS rest, CASE WHEN mean > 0 AND mean < 1 AND n - squares / n - (k - 1) > 0 THEN ((spread - n * mean * mean) / (mean * (1 - mean)) - (k - 1)) / (n - squares / n - (k - 1)) END AS alike FROM m),
s AS (SELECT mean, CASE WHEN alike IS NULL THEN 100 WHEN alike <= 0 THEN 10000 ELSE least(10000, greatest(1, 1 / alike - 1)) END AS strength FROM o),
x AS (SELECT host, (failed + mean * strength) / (n + strength) AS rate FROM h, s)
SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols, n_dup_lines::BIGINT AS n_dup_lines,
       n_repeat_words::BIGINT AS n_repeat_words, base_failed, NOT base_failed AND rate <= 0.5 AS kept
FROM e JOIN x ON e.host IS NOT DISTINCT FROM x.host
"""
