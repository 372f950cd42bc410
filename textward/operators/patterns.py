"""Pattern layer: an ordered catalogue of regular expressions with an early stop.

A pattern that may take more than config.patterns.step_budget steps on a text is not tried on it: it is timed out, which counts with a
confidence of its own and as a signal of the heuristics. The estimate depends on pattern and text alone, so verdicts are the same
whatever the partitions and the machine. Patterns that no text of config.max_length characters can bring over the budget, as all but
two of the built-in ones, cost nothing for it.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from textward import catalog
from textward.config import Config
from textward.functions.repetition import COPIES, SHORTEST, repetition
from textward.functions.regexes import literals, over_budget
from textward.functions.text import any_match, contains_any, fold, found_in, let, matches, texts, valid
from textward.shipping import ship

#: id, name, severity, category, regular expression and, if one likes, a description
Pattern = tuple[str, ...]


def active(config: Config, more: Iterable[Pattern] = ()) -> list[Pattern]:
    """The catalogue in order, with the user's patterns after the built-in ones, less those disabled or not compiling."""
    own = config.patterns
    off = {d.lower() for d in own.disabled}
    rows = [*(catalog.PATTERNS if own.built_in else []), *more]
    return [p for p in rows if p[0].lower() not in off and valid([p[4]])]


def catalog_table(spark: SparkSession, rows: Sequence[Pattern]) -> DataFrame:
    return spark.createDataFrame([(k, *r[:5], r[5] if len(r) > 5 else None) for k, r in enumerate(rows)], "ord int, id string, name string, severity string, category string, pattern string, description string")


def catalog_changes(old: DataFrame, new: DataFrame) -> DataFrame:
    """id and change (added, removed, modified) between two catalogue tables."""
    a, b = old.select("id", F.struct("pattern", "severity", "category").alias("was")), new.select("id", F.struct("pattern", "severity", "category").alias("now"))
    change = F.when(F.col("was").isNull(), "added").when(F.col("now").isNull(), "removed").when(F.col("was") != F.col("now"), "modified")
    return a.join(b, "id", "full_outer").select("id", change.alias("change")).where("change is not null")


def hit(text: Column, pattern: Pattern, repeated: Column | None = None, low: Column | None = None) -> Column:
    """Whether the pattern is found. `repeated` is the column that with_repetition() adds, instead of the one back-reference;
    `low` is fold(text), where it is at hand."""
    if pattern[0] != catalog.REPETITION:
        return matches(text, pattern[4]) if low is None else found_in(low, text, pattern[4])
    if repeated is not None:
        return F.coalesce(repeated, F.lit(False))
    # A block and ten copies take eleven times the block, so a text of n characters holds none longer than n / 11: the group's
    # upper bound by classes of length keeps the back-reference from trying lengths that cannot fit.
    found = F.lit(False)
    bounds = [110, 1_100, 2_200, 4_400, 8_800, 17_600, 35_200, 70_400]
    for least, most in zip(bounds[:-1], bounds[1:], strict=True):
        found = F.when((F.length(text) >= least) & (F.length(text) < most), matches(text, rf"(.{{10,{most // 11}}})\1{{10}}")).otherwise(found)
    return F.when(F.length(text) >= bounds[-1], matches(text, r"(.{10,})\1{10}")).otherwise(found)


def with_repetition(df: DataFrame, text: str, name: str) -> DataFrame:
    """df with a column that tells whether the text holds the catalogue's repetition; much faster than the back-reference. Texts too
    short for it do not reach Python."""
    ship(df.sparkSession)
    return df.withColumn(name, repetition()(F.when(F.length(text) >= SHORTEST * COPIES, F.col(text))))


def late(text: Column, pattern: Pattern, config: Config, low: Column) -> Column | None:
    """Whether the pattern is given up on the text; None if it never is."""
    if pattern[0] == catalog.REPETITION:
        return None  # found in n log n steps, or within bounds of its own
    over = over_budget(low, text, pattern[4], config.patterns.step_budget, config.max_length)
    some = literals(pattern[4])
    return contains_any(low, some) & over if over is not None and some else over


def places(text: Column, rows: Sequence[Pattern], config: Config, repeated: Column | None = None) -> Column:
    """Array of the places in the catalogue of the patterns found, up to the first whose adjusted confidence reaches the exit threshold;
    -1 less the place for those given up."""

    def outcome(k: int, p: Pattern, low: Column) -> Column:
        over = late(text, p, config, low)
        found = F.when(hit(text, p, repeated, low), k)
        return found if over is None else F.when(over, -1 - k).otherwise(found)

    every = let(fold(text), lambda low: F.array_compact(F.array(*[outcome(k, p, low) for k, p in enumerate(rows)])))
    ends = [k for k, p in enumerate(rows) if _level(p, config) >= config.patterns.exit_threshold]
    stops = F.expr(f"array({', '.join(map(str, ends))})") if ends else F.array().cast("array<int>")

    def cut(e: Column) -> Column:
        last = F.coalesce(F.array_min(F.array_intersect(e, stops)), F.lit(len(rows)))
        return F.filter(e, lambda x: F.greatest(x, -1 - x) <= last)

    return let(every, cut)


def _level(pattern: Pattern, config: Config) -> float:
    return min(1.0, catalog.SEVERITY_CONFIDENCE.get(pattern[2], 0.6) * config.patterns.multiplier)


def hits(found: Column, rows: Sequence[Pattern], config: Config) -> Column:
    """The patterns found among places()."""
    columns = {"id": texts(p[0] for p in rows), "name": texts(p[1] for p in rows), "confidence": F.expr(f"array({', '.join(f'{_level(p, config)!r}D' for p in rows)})"), "severity": texts(p[2] for p in rows), "category": texts(p[3] for p in rows)}
    return F.transform(F.filter(found, lambda k: k >= 0), lambda k: F.struct(k.alias("ord"), *[F.get(values, k).alias(c) for c, values in columns.items()]))


def layer(text: Column, config: Config, rows: Sequence[Pattern] | None = None, repeated: Column | None = None) -> Column:
    """The layer's struct."""
    own = config.patterns
    rows = active(config) if rows is None else rows
    kind = "struct<layer:string,was_executed:boolean,status:string,confidence:double,is_threat:boolean,matched:array<string>,matched_ids:array<string>,category:string,severity:string,pattern_count:int,disabled_count:int,sensitivity:string,timed_out:array<string>,timeout_count:int>"
    counts = [F.lit(len(rows)).alias("pattern_count"), F.lit(len(own.disabled)).alias("disabled_count"), F.lit(own.sensitivity).alias("sensitivity")]
    nothing = F.array().cast("array<string>")
    on_time = [nothing.alias("timed_out"), F.lit(0).alias("timeout_count")]
    if not own.enabled:
        return F.struct(F.lit("PatternMatching").alias("layer"), F.lit(False).alias("was_executed"), F.lit("disabled").alias("status"), F.lit(None).cast("double").alias("confidence"), F.lit(None).cast("boolean").alias("is_threat"), nothing.alias("matched"), nothing.alias("matched_ids"), F.lit(None).cast("string").alias("category"), F.lit(None).cast("string").alias("severity"), *counts, *on_time).cast(kind)

    if not rows:
        return F.struct(F.lit("PatternMatching").alias("layer"), F.lit(True).alias("was_executed"), F.lit("analyzed").alias("status"), F.lit(0.0).alias("confidence"), F.lit(False).alias("is_threat"), nothing.alias("matched"), nothing.alias("matched_ids"), F.lit(None).cast("string").alias("category"), F.lit(None).cast("string").alias("severity"), *counts, *on_time).cast(kind)
    names = texts(p[1] for p in rows)

    def build(x: Column) -> Column:
        h, lost = x["h"], x["lost"]
        first_lost = F.coalesce(-F.array_max(lost) - 1, F.lit(len(rows)))
        # the earliest of the patterns with the largest confidence; one that comes after a lost pattern has to exceed its confidence
        told = F.filter(h, lambda y: (y["ord"] < first_lost) | (y["confidence"] > own.timeout_contribution))
        key = lambda y: F.struct(y["confidence"].alias("c"), (-y["ord"]).alias("o"), y["category"].alias("category"), y["severity"].alias("severity"))
        best = F.struct(F.array_max(F.transform(h, key)).alias("any"), F.array_max(F.transform(told, key)).alias("told"))
        return let(best, lambda best: F.struct(
            F.lit("PatternMatching").alias("layer"), F.lit(True).alias("was_executed"), F.lit("analyzed").alias("status"),
            F.greatest(F.coalesce(best["any"]["c"], F.lit(0.0)), F.when(F.size(lost) > 0, own.timeout_contribution).otherwise(0.0)).alias("confidence"), (F.size(h) > 0).alias("is_threat"),
            F.transform(h, lambda y: y["name"]).alias("matched"), F.transform(h, lambda y: y["id"]).alias("matched_ids"),
            F.coalesce(best["told"]["category"], F.when(F.size(h) > 0, catalog.THREAT_CATEGORY)).alias("category"), F.coalesce(best["told"]["severity"], F.when(F.size(h) > 0, "Low")).alias("severity"), *counts,
            F.transform(F.reverse(lost), lambda k: F.get(names, -1 - k)).alias("timed_out"), F.size(lost).alias("timeout_count"),
        ))

    # -1 less the place: the earliest is the largest
    out = let(places(text, rows, config, repeated), lambda e: let(F.struct(hits(e, rows, config).alias("h"), F.sort_array(F.filter(e, lambda k: k < 0)).alias("lost")), build)).cast(kind)
    if not own.allowed:
        return out
    free = F.struct(F.lit("PatternMatching").alias("layer"), F.lit(True).alias("was_executed"), F.lit("allowlisted").alias("status"), F.lit(0.0).alias("confidence"), F.lit(False).alias("is_threat"), nothing.alias("matched"), nothing.alias("matched_ids"), F.lit(None).cast("string").alias("category"), F.lit(None).cast("string").alias("severity"), *counts, *on_time).cast(kind)
    return F.when(any_match(text, own.allowed, own.step_budget, config.max_length), free).otherwise(out)


def long_form(df: DataFrame, text: str, rows: Sequence[Pattern], config: Config) -> DataFrame:
    """A row for each row and pattern found: the columns of df with ord, id, name, confidence, severity and category. The
    catalogue is part of the projection, so nothing is joined."""
    t = F.col(text)

    def row(k: int, p: Pattern, low: Column) -> Column:
        over = late(t, p, config, low)
        found = hit(t, p, None, low) if over is None else F.when(~over, hit(t, p, None, low)).otherwise(False)
        return F.when(found, F.struct(F.lit(k).alias("ord"), F.lit(p[0]).alias("pattern_id"), F.lit(p[1]).alias("pattern_name"), F.lit(_level(p, config)).alias("pattern_confidence")))

    every = let(fold(t), lambda low: F.array_compact(F.array(*[row(k, p, low) for k, p in enumerate(rows)])))
    return df.select("*", F.explode(every).alias("h")).select(*df.columns, "h.*")
