"""A catalogue of regular expressions as a table, joined with texts through the literals that their matches hold.

One expression for each pattern, as the pattern layer has them, can be planned for some dozens; a table takes hundreds of thousands. Every
match of a pattern holds one of its literals, and a literal holds all its grams of three characters. So each literal is listed under one
gram, the one that a part of the texts holds least often; a text meets only the patterns listed under its own grams, and of these the
expression runs where the literal is found. Nothing is tried pair by pair but patterns without a literal, which have to see every
text: they are put into the plan in blocks, as a set of queries.

The list of grams is counted first. Up to `BROADCAST` entries it is told to all tasks, and texts are neither copied nor moved: grams,
lookup and expression are one pass. A longer list is joined on the gram with the texts' keys alone, where adaptive execution splits frequent
grams, and the pairs that meet are joined with the texts.

Patterns that do not compile in the JVM, and null ones, find nothing. A null text holds nothing. A text's rows are told apart by the key;
rows that repeat a key are taken as one text's, and a pattern counts once for them. Patterns that repeat an id count once for it.
Versions: with `valid_from` and `valid_to` columns and the texts' time, a pattern sees the texts of its interval only, the beginning
included; a null time sees no version, a null beginning or end is open.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textward.config import Config
from textward.functions import regexes
from textward.functions.text import fold
from textward.shipping import ship

GRAM = 3
#: Entries of the list that is told to all tasks: a gram, a literal and an expression each, some hundred bytes.
BROADCAST = 200_000
#: Grams that are told in the plan; the texts' others are then dropped before a text is copied for each of its grams.
NAMED = 2_000
#: Patterns without literals that are tried in one pass over the texts.
BLOCK = 200
#: One text in so many is asked how frequent grams are; this chooses among a literal's grams and changes no result.
ASKED = 16
READ = "literals array<string>, kind string, scan double, chain double, factor double, alphabet string, heads array<string>, worst double"


def understood(patterns: DataFrame, config: Config) -> DataFrame:
    """The patterns that compile, with what their expressions tell: literals and how work grows."""
    ship(patterns.sparkSession)
    most = config.max_length

    @F.pandas_udf(READ)
    def told(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for some in batches:
            rows = []
            for p in some:
                b = regexes.bound(p)
                rows.append((regexes.literals(p), b.kind, float(b.scan), float(b.chain), b.factor, b.alphabet, list(b.heads), regexes.worst(p, most)))
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in READ.split(", ")])

    compiled = F.try_reflect(F.lit("java.util.regex.Pattern"), F.lit("compile"), F.concat(F.lit("(?iud)"), F.col("pattern")))
    return patterns.where(F.col("pattern").isNotNull()).where(compiled.isNotNull()).withColumn("told", told("pattern")).select(*patterns.columns, "told.*")


def grams(low: Column) -> Column:
    """Every stretch of three characters."""
    return F.regexp_extract_all(low, F.lit(f"(?s)(?=({'.' * GRAM}))"), 1)


def _over(low: Column, text: Column, budget: float) -> Column:
    """regexes.over_budget() with the pattern's values in columns."""
    n = F.length(text).cast("double")
    stretches = F.regexp_extract_all(text, F.concat(F.lit("(?iud)(["), F.col("alphabet"), F.lit("]+)")), 1)
    m = F.when(F.col("alphabet") == "", n).otherwise(F.coalesce(F.array_max(F.transform(stretches, lambda x: F.length(x))), F.lit(0)).cast("double"))
    one = lambda a, h: a + (F.length(low) - F.length(F.replace(low, h, F.lit("")))) / F.length(h)
    begins = F.when(F.size("heads") == 0, n).otherwise(F.aggregate("heads", F.lit(0.0), one))
    exponential = n + begins * F.col("factor") * F.pow(F.lit(2.0), F.least(m, F.lit(900.0)))
    steps = n * F.pow(m, F.col("scan") - 1) + F.col("factor") * F.least(n * F.pow(m, F.greatest(F.lit(0.0), F.col("chain") - 1)), begins * F.pow(F.greatest(m, F.lit(1.0)), F.col("chain")))
    return F.when(F.col("worst") <= budget, False).otherwise(F.when(F.col("kind") == "exponential", exponential).otherwise(steps) > budget)


def _outcome(low: Column, text: Column, config: Config) -> Column:
    """match, timed_out or null."""
    found = F.regexp_like(text, F.concat(F.lit("(?iud)"), F.col("pattern")))
    return F.when(_over(low, text, config.patterns.step_budget), "timed_out").when(found, "match")


def listed(patterns: DataFrame, texts: DataFrame, text: str) -> DataFrame:
    """A row for each literal of the patterns that have them, with its rarest gram as `gram`. `patterns` comes from understood()."""
    each = patterns.where((F.size("literals") > 0) & (F.array_min(F.transform("literals", lambda x: F.length(x))) >= GRAM))
    each = each.withColumn("literal", F.explode("literals")).drop("literals")
    own = each.select("literal").distinct().withColumn("gram", F.explode(F.array_distinct(grams(F.col("literal")))))
    asked = texts.where(F.pmod(F.xxhash64(text), F.lit(ASKED)) == 0).select(F.explode(F.array_distinct(grams(fold(F.col(text))))).alias("gram"))
    often = asked.groupBy("gram").agg(F.count(F.lit(1)).alias("often"))
    best = own.join(often, "gram", "left").groupBy("literal").agg(F.min(F.struct(F.coalesce("often", F.lit(0)).alias("often"), "gram"))["gram"].alias("gram"))
    return each.join(best, "literal")


def hits(texts: DataFrame, key: str, text: str, patterns: DataFrame, config: Config | None = None, at: str | None = None, broadcast: int = BROADCAST) -> DataFrame:
    """key, pattern_id and outcome (match or timed_out) of every text and pattern that meet. `patterns` has id and pattern; with `at`,
    the texts' time, also valid_from and valid_to."""
    config = config or Config()
    wanted = ["id", "pattern", *(["valid_from", "valid_to"] if at else [])]
    rows = understood(patterns.select(*wanted).distinct(), config).cache()
    given = texts.select(F.col(key).alias("_key"), F.col(text).alias("_text"), *([F.col(at).alias("_at")] if at else [])).where(F.col("_text").isNotNull())
    entries = listed(rows, given, "_text").cache()
    n = entries.count()
    low = fold(F.col("_text"))
    valid = F.lit(True)
    if at:
        valid = F.col("_at").isNotNull() & (F.col("valid_from").isNull() | (F.col("_at") >= F.col("valid_from"))) & (F.col("valid_to").isNull() | (F.col("_at") < F.col("valid_to")))
    holds = F.contains(F.col("_low"), F.col("literal"))
    given = given.withColumn("_low", low)
    held = grams(F.col("_low"))
    named = [r["gram"] for r in entries.select("gram").distinct().limit(NAMED + 1).collect()]
    if len(named) <= NAMED:  # few grams are told in the plan, so that a text is copied for those alone
        held = F.filter(held, lambda g: g.isin(named)) if named else F.array().cast("array<string>")
    own = given.withColumn("gram", F.explode(F.array_distinct(held)))
    if n <= broadcast:
        met = own.join(F.broadcast(entries), "gram").where(valid & holds)
    else:
        pairs = own.drop("_text", "_low").join(entries.select("gram", "id", "pattern", *wanted[2:]).distinct(), "gram").where(valid).select("_key", "id", "pattern").distinct()
        met = given.join(pairs, "_key").join(entries.drop("gram"), ["id", "pattern"]).where(valid & holds)
    found = met.select("_key", "id", _outcome(F.col("_low"), F.col("_text"), config).alias("outcome"))
    bare = rows.where((F.size("literals") == 0) | (F.array_min(F.transform("literals", lambda x: F.length(x))) < GRAM)).drop("literals").orderBy("id", "pattern")
    dense = bare.collect()  # of the catalogue, those without literals
    for base in range(0, len(dense), BLOCK):
        structs = [F.struct(*[_literal(r[c]).cast(t).alias(c) for c, t in bare.dtypes]) for r in dense[base : base + BLOCK]]
        block = given.withColumn("_p", F.explode(F.array(*structs))).select("_key", "_text", "_low", *(["_at"] if at else []), "_p.*").where(valid)
        found = found.union(block.select("_key", "id", _outcome(F.col("_low"), F.col("_text"), config).alias("outcome")))
    return found.where(F.col("outcome").isNotNull()).groupBy("_key", "id").agg(F.min("outcome").alias("outcome")).select(F.col("_key").alias(key), F.col("id").alias("pattern_id"), "outcome")


def _literal(value: object) -> Column:
    return F.array(*map(F.lit, value)) if isinstance(value, list) else F.lit(value)


def intervals(changes: DataFrame) -> DataFrame:
    """id, pattern, valid_from and valid_to of every version, from changes (id, pattern, at): each holds until the id's next change, and a
    null pattern removes. Of changes at one time the last by `seq`, a column of the changes, holds."""
    later = Window.partitionBy("id").orderBy("at", "seq")
    out = changes.withColumn("valid_to", F.lead("at").over(later))
    return out.where(F.col("pattern").isNotNull() & (F.col("valid_to").isNull() | (F.col("valid_to") > F.col("at")))).select("id", "pattern", F.col("at").alias("valid_from"), "valid_to")


def kinds_of_change(changes: DataFrame) -> DataFrame:
    """id, at, seq and change of every entry that changes something: added, removed or modified."""
    was = F.lag("pattern").over(Window.partitionBy("id").orderBy("at", "seq"))
    kind = F.when(F.col("was").isNull() & F.col("pattern").isNotNull(), "added").when(F.col("was").isNotNull() & F.col("pattern").isNull(), "removed").when(F.col("was") != F.col("pattern"), "modified")
    return changes.withColumn("was", was).select("id", "at", "seq", kind.alias("change")).where("change is not null")
