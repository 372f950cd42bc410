"""Heuristic layer: signals with contributions, their score and the definitive flags."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from textward import catalog
from textward.config import Config
from textward.functions.text import any_match, clamp, count_of, fold, found_in, let, valid

SIGNAL = "struct<name:string,contribution:double,description:string>"


def _signal(name: str, fires: Column, contribution: Column | float, config: Config | None) -> Column:
    value = contribution if isinstance(contribution, Column) else F.lit(float(contribution))
    if config is not None:
        value = clamp(value * F.lit(config.heuristics.multiplier))
    return F.when(fires, F.struct(F.lit(name).alias("name"), value.cast("double").alias("contribution"), F.lit(name.replace("_", " ")).alias("description"))).cast(SIGNAL)


def length_signal(text: Column, config: Config) -> Column:
    least = config.max_length * 0.1
    return _signal("excessive_length", F.length(text) > least, F.least(F.lit(1.0), (F.length(text) - least) / (config.max_length * 0.5)), config)


def alphanumeric_signal(text: Column, config: Config) -> Column:
    share = F.length(F.regexp_replace(text, r"[^\p{L}\p{Nd}]", "")) / F.length(text)
    return _signal("special_char_ratio", (F.length(text) > 0) & (share < config.heuristics.alphanumeric), 1.0 - share, config)


def punctuation_signal(text: Column, config: Config) -> Column:
    limit = config.heuristics.punctuation
    share = count_of(text, catalog.HEURISTIC_DELIMITERS) / F.length(text)
    return _signal("delimiter_injection", (F.length(text) > 0) & (share > limit), F.least(F.lit(1.0), share / (limit * 2)), config)


def _compound(text: Column, rows: Sequence[tuple[str, float]], name: str, step: float, most: float, config: Config) -> Column:
    found = let(fold(text), lambda low: F.array_compact(F.array(*[F.when(found_in(low, text, p), F.lit(w)) for p, w in rows])))

    def build(f: Column) -> Column:
        return _signal(name, F.size(f) > 0, F.least(F.lit(1.0), F.array_max(f) + F.least(F.lit(most), F.size(f) * F.lit(step))), config)

    return let(found, build)


def directive_signal(text: Column, config: Config) -> Column:
    if config.heuristics.compound:
        return _compound(text, catalog.DIRECTIVES, "instruction_language", 0.02, 0.1, config)
    skip = {x.lower() for x in config.heuristics.exclusions}
    n = _phrases(text, [w for w in catalog.DIRECTIVE_WORDS if w not in skip])
    return _signal("instruction_language", n >= config.heuristics.directive_threshold, F.least(F.lit(1.0), n / 5.0), config)


def role_signal(text: Column, config: Config) -> Column:
    if config.heuristics.compound:
        return _compound(text, catalog.ROLES, "role_switching", 0.05, 0.15, config)
    n = _phrases(text, catalog.ROLE_PHRASES)
    return _signal("role_switching", n > 0, F.least(F.lit(1.0), F.lit(0.6) + n * 0.2), config)


def _phrases(text: Column, phrases: Sequence[str]) -> Column:
    return let(F.lower(text), lambda low: sum((low.contains(p).cast("int") for p in phrases), F.lit(0)))


def _pair(name: str, first: Column, second: Column, a: float, b: float, both: float, config: Config) -> Column:
    return _signal(name, first | second, F.when(first & second, both).when(first, a).otherwise(b), config)


def structure_signal(text: Column, config: Config) -> Column:
    return _pair("anomalous_structure", text.rlike(catalog.REPEATED_DELIMITERS), let(F.lower(text), lambda low: found_in(low, text, catalog.STRUCTURE_MARKERS)), 0.65, 0.85, 0.85, config)


def encoding_signal(text: Column, config: Config) -> Column:
    return _pair("encoding_patterns", text.rlike(catalog.BASE64_RUN), text.rlike(catalog.HEX_RUN), 0.7, 0.7, 0.85, config)


def unicode_signal(text: Column, config: Config) -> Column:
    other = F.octet_length(text) != F.length(text)  # ASCII has none
    zero, bidi = other & text.rlike(f"[{catalog.ZERO_WIDTH}]"), other & text.rlike(f"[{catalog.BIDI}]")
    name = F.when(zero & bidi, "suspicious_unicode").when(bidi, "bidirectional_override").otherwise("invisible_characters")
    out = _signal("suspicious_unicode", zero | bidi, F.when(zero & bidi, 0.9).when(bidi, 0.8).otherwise(0.6), config)
    return F.when(out.isNotNull(), out.withField("name", name)).cast(SIGNAL)


def blocklist_signal(text: Column, config: Config) -> Column:
    return _signal("custom_blocklist", any_match(text, valid(config.heuristics.blocked)), 0.9, config)


def timeout_signal(timeouts: Column) -> Column:
    """Of a pattern layer with that many timeouts; not scaled by the sensitivity."""
    return _signal("pattern_timeout", timeouts > 0, F.least(F.lit(1.0), F.lit(0.4) + timeouts * 0.1), None)


SIGNALS: list[Callable[[Column, Config], Column]] = [blocklist_signal, length_signal, alphanumeric_signal, punctuation_signal, directive_signal, role_signal, structure_signal, encoding_signal, unicode_signal]


def signals(text: Column, config: Config) -> Column:
    """Array of the signals that fire, in order."""
    used = SIGNALS if config.heuristics.blocked else SIGNALS[1:]
    found = F.array_compact(F.array(*[f(text, config) for f in used]))
    if not config.heuristics.allowed:
        return found
    return F.when(any_match(text, config.heuristics.allowed), F.array().cast(f"array<{SIGNAL}>")).otherwise(found)


def score(found: Column) -> Column:
    """The largest contribution and a fifth of the mean, at most 1; 0 without signals."""
    values = lambda f: F.transform(f, lambda x: x["contribution"])
    total = lambda f: F.aggregate(values(f), F.lit(0.0), lambda a, x: a + x)
    return F.when(F.size(found) == 0, 0.0).otherwise(F.least(F.lit(1.0), F.array_max(values(found)) + total(found) / F.size(found) * 0.2))


def top(found: Column, k: int = 5) -> Column:
    """The k signals with the largest contributions; equal ones stay in order."""
    keyed = F.transform(found, lambda x, i: F.struct((-x["contribution"]).alias("c"), i.alias("i"), x.alias("s")))
    return F.slice(F.transform(F.sort_array(keyed), lambda x: x["s"]), 1, k)


def layer(text: Column, config: Config, analyzers: Sequence[Callable[[Column], Column]] = (), timeouts: Column | None = None) -> Column:
    """The layer's struct. Further analyzers map the text to a struct of score and signals; scores are averaged, and an analyzer
    that gives null counts as failed. `timeouts` is how many patterns the pattern layer gave up."""
    own = config.heuristics
    kind = f"struct<layer:string,was_executed:boolean,confidence:double,is_threat:boolean,is_definitive:boolean,early_exit:string,signals:array<{SIGNAL}>,top_signals:array<{SIGNAL}>>"
    if not own.enabled:
        return F.struct(F.lit("Heuristics").alias("layer"), F.lit(False).alias("was_executed"), F.lit(None).cast("double").alias("confidence"), F.lit(None).cast("boolean").alias("is_threat"), F.lit(False).alias("is_definitive"), F.lit(None).cast("string").alias("early_exit"), F.array().cast(f"array<{SIGNAL}>").alias("signals"), F.array().cast(f"array<{SIGNAL}>").alias("top_signals")).cast(kind)

    def build(f: Column) -> Column:
        more = [a(text) for a in analyzers]
        scores = [score(f), *[m["score"] for m in more]]
        n = sum((s.isNotNull().cast("int") for s in scores), F.lit(0))
        mean = sum((F.coalesce(s, F.lit(0.0)) for s in scores), F.lit(0.0)) / n
        every = f
        for m in more:
            every = F.concat(every, F.coalesce(m["signals"], F.array().cast(f"array<{SIGNAL}>")))

        def full(c: Column) -> Column:
            early = F.when(c >= own.definitive_threat, "definitive_threat").when(c <= own.definitive_safe, "definitive_safe")
            return F.struct(F.lit("Heuristics").alias("layer"), F.lit(True).alias("was_executed"), c.alias("confidence"), (c >= 0.5).alias("is_threat"), early.isNotNull().alias("is_definitive"), early.alias("early_exit"), every.alias("signals"), top(every).alias("top_signals"))

        return let(F.coalesce(mean, F.lit(0.0)), full)

    found = signals(text, config)
    if timeouts is not None:
        late = F.array_compact(F.array(timeout_signal(timeouts)))
        found = F.concat(found, late if not own.allowed else F.when(any_match(text, own.allowed), F.array().cast(f"array<{SIGNAL}>")).otherwise(late))
    return let(found, build).cast(kind)
