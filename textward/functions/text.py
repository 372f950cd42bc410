"""Small text expressions that the operators share."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable

from pyspark import SparkContext
from pyspark.errors import IllegalArgumentException, PySparkException
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from textward.functions.regexes import literals, over_budget


def let(value: Column, f: Callable[[Column], Column]) -> Column:
    """f(value) with value in the plan, and computed, once, though f names it many times."""
    return F.transform(F.array(value), f)[0]


def matches(text: Column, pattern: str) -> Column:
    """Whether the regular expression is found, whatever the case; the dot matches all but a newline."""
    return text.rlike("(?iud)" + pattern)


#: Characters other than ASCII letters that match one whatever the case: long s, dotless and dotted i, the kelvin sign.
_ODD, _PLAIN = "\u017f\u0131\u0130\u212a", "siik"


def fold(text: Column) -> Column:
    """Lower case, with every character that a regular expression takes for an ASCII letter as that letter."""
    return F.lower(F.when(F.octet_length(text) == F.length(text), text).otherwise(F.translate(text, _ODD, _PLAIN)))


def found_in(low: Column, text: Column, pattern: str) -> Column:
    """matches(text, pattern), where low is fold(text): texts without any of the pattern's literals are settled by plain search,
    which costs a small part of the regular expression's time."""
    some = literals(pattern)
    return contains_any(low, some) & matches(text, pattern) if some and min(map(len, some)) >= 2 else matches(text, pattern)


def any_match(text: Column, patterns: Iterable[str], budget: float | None = None, length: int = 0) -> Column:
    """Whether one of the expressions is found; those that may take more than `budget` steps on a text, of up to `length` characters,
    are not found in it."""
    found = F.lit(False)
    for p in valid(patterns):
        over = over_budget(fold(text), text, p, budget, length) if budget is not None else None
        found = found | (matches(text, p) if over is None else F.when(~over, matches(text, p)).otherwise(False))
    return found


def valid(patterns: Iterable[str]) -> list[str]:
    """Without those that do not compile in the engine that runs them."""
    return [p for p in patterns if _compiles(p)]


def _compiles(pattern: str) -> bool:
    context = SparkContext._active_spark_context
    if context is not None:
        try:
            context._jvm.java.util.regex.Pattern.compile("(?iud)" + pattern)
        except IllegalArgumentException:  # what a PatternSyntaxException is in Python
            return False
        return True
    session = SparkSession.getActiveSession()  # of a remote session
    if session is None:
        raise RuntimeError("patterns are checked by the session's own regex engine; start a session first")
    try:
        session.range(1).select(matches(F.concat(F.col("id").cast("string"), F.lit("")), pattern)).collect()
    except PySparkException:
        return False
    return True


def contains_any(text: Column, phrases: Iterable[str]) -> Column:
    found = F.lit(False)
    for p in phrases:
        found = found | text.contains(p)
    return found


def count_of(text: Column, chars: str) -> Column:
    """How many characters of the text are among chars."""
    return F.length(text) - F.length(F.translate(text, chars, ""))


def occurrences(text: Column, phrases: Iterable[str]) -> Column:
    """Sum over the phrases of how often each occurs, without overlaps of its own."""
    total = F.lit(0)
    for p in phrases:
        total = total + F.regexp_count(text, F.lit(re.escape(p)))
    return total


def texts(values: Iterable[str]) -> Column:
    """A constant array, as one expression."""
    return F.expr("array(" + ", ".join("'" + v.replace("\\", "\\\\").replace("'", "\\'") + "'" for v in values) + ")")


def clamp(value: Column) -> Column:
    return F.least(F.greatest(value, F.lit(0.0)), F.lit(1.0))


def blank(text: Column) -> Column:
    return text.isNull() | text.rlike(r"(?U)^\s*$")


def severity_of(confidence: Column) -> Column:
    from textward.catalog import CONFIDENCE_SEVERITY

    out = F.lit("Low")
    for least, name in reversed(CONFIDENCE_SEVERITY):
        out = F.when(confidence >= least, name).otherwise(out)
    return out


def percent(confidence: Column) -> Column:
    return F.format_string("%.0f%%", confidence * 100)
