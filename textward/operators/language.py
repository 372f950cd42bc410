"""Language detection by script and marker words, and the gate."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from textward import catalog
from textward.config import ALLOW, WARN, Config
from textward.functions.text import blank, let, texts

#: Between tokens, as it stands inside a regex class.
_DELIMITERS = r""" \t\n\r.,!?;:"'()\[\]{}"""


def tokens(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), f"[{_DELIMITERS}]"), lambda x: x != "")


def token_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(f"[^{_DELIMITERS}]+"))


def marker_count(lower: Column, markers: list[str]) -> Column:
    """How many tokens of a lower-cased text are markers: whole runs between delimiters."""
    return F.regexp_count(lower, F.lit(f"(?<![^{_DELIMITERS}])(?:{'|'.join(markers)})(?![^{_DELIMITERS}])"))


def script_count(text: Column, chars: str) -> Column:
    return F.length(text) - F.length(F.regexp_replace(text, f"[{chars}]", ""))


def _result(code: Column | str, script: Column | str, confidence: Column | float, reliable: Column | bool) -> Column:
    lit = lambda x: x if isinstance(x, Column) else F.lit(x)
    return F.struct(lit(code).alias("code"), lit(script).alias("script"), lit(confidence).cast("double").alias("confidence"), lit(reliable).alias("reliable"))


def _script_rule(code: str, script: str, base: float) -> Callable[[Column], Column]:
    def result(share: Column) -> Column:
        confidence = F.least(F.lit(base) * (F.lit(0.5) + share), F.lit(0.99))
        return F.when(share >= 0.10, _result(code, script, confidence, (confidence >= 0.7) & (share >= 0.3)))

    return result


def by_script(text: Column) -> Column:
    """The first script with a tenth of the characters; null if there is none."""
    options = [let(script_count(text, chars) / F.length(text), _script_rule(code, script, base)) for chars, code, script, base in catalog.SCRIPTS]
    # plain Latin text, the common case, has no character of any script
    some = text.rlike("[" + "".join(s[0] for s in catalog.SCRIPTS) + "]")
    return F.when(some, F.coalesce(*options))


def _among(words: list[str]) -> Callable[[Column], Column]:
    return lambda w: w.isin(list(words))


def by_words(text: Column) -> Column:
    def ratios(r: Column) -> Column:
        n = F.least(r["n"], F.lit(100))
        return F.struct(r["n"].alias("n"), *[(r[c] / n).alias(c) for c in ("en", "de", "fr", "es")])

    def pick(r: Column) -> Column:
        most = F.greatest(r["en"], r["de"], r["fr"], r["es"])
        code = F.when(r["en"] >= most * 0.9, "en").when(r["de"] == most, "de").when(r["fr"] == most, "fr").when(r["es"] == most, "es").otherwise("en")
        confidence = F.least(F.lit(0.5) + most * 2, F.lit(0.95))
        known = F.when(most < 0.05, _result("und", "Latn", 0.3, False)).otherwise(_result(code, "Latn", confidence, (confidence >= 0.7) & (r["n"] >= 10)))
        return F.when(r["n"] == 0, _result("und", "Zzzz", 0.0, False)).otherwise(known)

    named = [("en", catalog.ENGLISH), ("de", catalog.GERMAN), ("fr", catalog.FRENCH), ("es", catalog.SPANISH)]
    every = sorted({w for _, m in named for w in m})

    # token_count() and marker_count() of each language, from one pass over the text
    def counts(x: Column) -> Column:
        return F.struct(x["n"].alias("n"), *[F.size(F.filter(x["marked"], _among(m))).alias(c) for c, m in named])

    found = F.regexp_extract_all(F.lower(text), F.lit(f"[^{_DELIMITERS}]+"), 0)
    marked = let(found, lambda t: F.struct(F.size(t).alias("n"), F.filter(t, _among(every)).alias("marked")))
    return let(let(let(marked, counts), ratios), pick)


def detect(text: Column) -> Column:
    """Struct of code, script, confidence and reliable."""
    return F.when(blank(text), _result("und", "Zzzz", 0.0, False)).otherwise(F.coalesce(by_script(text), by_words(text)))


def _name(code: Column, names: dict[str, str]) -> Column:
    pairs = F.map_from_arrays(texts(names), texts(names.values()))
    return F.try_element_at(pairs, code)


def language_name(code: Column) -> Column:
    return F.coalesce(_name(code, catalog.LANGUAGES), F.concat(F.lit("Unknown ("), code, F.lit(")")))


def script_name(script: Column) -> Column:
    return F.coalesce(_name(script, catalog.SCRIPT_NAMES), script)


def _behave(behavior: str, reason: Column) -> Column:
    proceed = behavior in (ALLOW, WARN)
    message = F.concat(reason, F.lit(". Detection may be less effective.")) if behavior == WARN else reason
    return F.struct(F.lit(proceed).alias("proceed"), F.lit(not proceed).alias("blocked"), F.lit(behavior == WARN).alias("warning"), message.alias("message"))


def gate(text: Column, found: Column, config: Config) -> Column:
    """The layer's struct: was_executed, the detection, proceed, blocked, warning, message and confidence (0.9 if blocked)."""
    own = config.language
    free = F.struct(F.lit(True).alias("proceed"), F.lit(False).alias("blocked"), F.lit(False).alias("warning"), F.lit(None).cast("string").alias("message"))

    def full(x: Column) -> Column:
        r, step = x["r"], x["s"]
        return F.struct(
            F.lit("LanguageFilter").alias("layer"), F.lit(own.enabled).alias("was_executed"), r["code"].alias("code"), language_name(r["code"]).alias("name"), r["script"].alias("script"), script_name(r["script"]).alias("script_name"),
            r["confidence"].alias("detection_confidence"), r["reliable"].alias("reliable"), (r["script"] == "Latn").alias("is_latin"), (r["code"] == "en").alias("is_english"), step["proceed"].alias("proceed"), step["blocked"].alias("blocked"), step["warning"].alias("warning"), step["message"].alias("message"),
            F.when(step["blocked"], 0.9).otherwise(0.0).alias("confidence"),
        )

    if not own.enabled:
        nothing = F.lit(None).cast("struct<code:string,script:string,confidence:double,reliable:boolean>")
        return let(F.struct(nothing.alias("r"), free.alias("s")), full)
    short = F.length(text) < own.min_length

    def decide(r: Column) -> Column:
        names = F.concat(F.lit("Language '"), language_name(r["code"]), F.lit("' is not supported. Supported: [" + ", ".join(own.supported) + "]"))
        step = (
            F.when(short, _behave(own.on_short, F.lit("Text too short for reliable language detection")))
            .when(r["confidence"] < own.min_confidence, _behave(own.on_low_confidence, F.lit("Language detection confidence too low")))
            .when(F.lower(r["code"]).isin([s.lower() for s in own.supported]), free)
            .otherwise(_behave(own.on_unsupported, names))
        )
        return F.struct(r.alias("r"), step.alias("s"))

    result = F.when(short, _result("und", "Zzzz", 0.0, False)).otherwise(found)
    return let(let(result, decide), full)
