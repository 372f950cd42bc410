"""The 48 features of a text as expressions; five that need its characters one by one come from one Arrow function."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from textward import catalog
from textward.functions.text import contains_any, count_of, occurrences

CHAR_FIELDS = "struct<entropy:double,trigrams:double,compression:double,brackets:double,depth:int>"
_OPEN, _CLOSE = "([{<", ")]}>"
_PAIRS = dict(zip(_CLOSE, _OPEN, strict=True))


def char_statistics(text: str) -> tuple[float, float, float, float, int]:
    """Entropy, trigram diversity, compression estimate, bracket imbalance and nesting depth of one text, from its code points."""
    if not text:
        return 0.0, 0.0, 0.0, 0.0, 0
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    n = len(points)
    share = np.unique(points, return_counts=True)[1] / n
    entropy = min(float(-(share * np.log2(share)).sum()) / 7.0, 1.0)
    trigrams = 0.0
    if n >= 3:
        grams = (points[:-2] << np.uint64(42)) | (points[1:-1] << np.uint64(21)) | points[2:]
        trigrams = len(np.unique(grams)) / min(n - 2, 26**3)
    compression = 0.0
    if n >= 10:
        upper = "".join([u if len(u := c.upper()) == 1 else c for c in text])
        points = np.frombuffer(upper.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
        mixed = (points + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
        mixed ^= mixed >> np.uint64(31)
        window, repeated = mixed.copy(), 0
        for size in range(2, min(10, n // 2) + 1):
            # the hash of each substring of `size` characters from that of its first size - 1
            window = (window[:-1] * np.uint64(0xBF58476D1CE4E5B9)) + mixed[size - 1 :]
            if size >= 3:
                repeated += len(window) - len(np.unique(window))
        compression = min(repeated / (n * 2), 1.0)
    stack: list[str] = []
    mismatches = depth = deepest = 0
    for c in text:
        if c in _OPEN:
            stack.append(c)
            depth += 1
            deepest = max(deepest, depth)
        elif c in _PAIRS:
            if not stack or stack.pop() != _PAIRS[c]:
                mismatches += 1
            depth = max(0, depth - 1)
    return entropy, trigrams, compression, min((mismatches + len(stack)) / 20, 1.0), deepest


def char_features():
    """The Arrow function; a null text gives a null."""

    @F.pandas_udf(CHAR_FIELDS)
    def statistics(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            rows = [char_statistics(t) if t is not None else (None,) * 5 for t in texts]
            yield pd.DataFrame(rows, columns=["entropy", "trigrams", "compression", "brackets", "depth"])

    # called nondeterministic, so that the optimizer neither repeats it nor moves it into the expressions that use it
    return statistics.asNondeterministic()


def _ratio(a: Column, b: Column) -> Column:
    return F.when(b > 0, a / b).otherwise(0.0)


def _one(a: Column) -> Column:
    return F.least(a, F.lit(1.0))


def _flag(a: Column) -> Column:
    return a.cast("double")


def statistical(t: Column, s: Column | None) -> dict[str, Column]:
    words = F.filter(F.split(t, r"[ \t\n\r]"), lambda x: x != "")
    n, length = F.size(words), F.length(t)
    lines = F.regexp_count(t, F.lit("\n")) + 1
    enders = F.regexp_count(t, F.lit("[.!?]"))
    distinct = F.size(F.array_distinct(F.transform(words, F.lower)))
    out = {
        "Length": F.when(length > 0, F.log10(length + 1) / 5).otherwise(0.0),
        "WordCount": _one(n / 500),
        "AvgWordLength": _one(_ratio(F.length(F.regexp_replace(t, r"[ \t\n\r]", "")), n) / 15),
        "LineCount": _one(lines / 100),
        "AvgLineLength": _one(length / lines / 200),
        "UniqueWordRatio": _ratio(distinct, n),
        "SentenceCount": _one(enders / 50),
        "AvgSentenceLength": _one(F.when(enders > 0, n / enders).otherwise(n.cast("double")) / 30),
        "WhitespaceRatio": _ratio(length - F.length(F.regexp_replace(t, r"(?U)\s", "")), length),
    }
    if s is not None:
        out |= {"Entropy": s["entropy"], "TrigramDiversity": s["trigrams"], "CompressionRatio": s["compression"]}
    return out


def character(t: Column, s: Column | None) -> dict[str, Column]:
    length = F.length(t)
    share = lambda p: _ratio(length - F.length(F.regexp_replace(t, p, "")), length)
    out = {
        "LowercaseRatio": share(r"\p{Ll}"),
        "UppercaseRatio": share(r"\p{Lu}"),
        "DigitRatio": share(r"\p{Nd}"),
        "PunctuationRatio": share(r"\p{P}"),
        "SymbolRatio": share(r"[\p{S}\p{P}]"),
        "ControlCharRatio": share(r"[\p{Cc}&&[^\n\r\t]]"),
        "HighUnicodeRatio": share(r"[^\x00-\x7F]"),
        "ZeroWidthChars": _one(count_of(t, catalog.ZERO_WIDTH) / 10),
        "BidiOverrides": _one(count_of(t, catalog.BIDI) / 5),
        "DelimiterRatio": _ratio(count_of(t, catalog.FEATURE_DELIMITERS), length),
        "QuoteDensity": _one(_ratio(count_of(t, "\"'`"), length) * 10),
    }
    if s is not None:
        out["BracketBalance"] = s["brackets"]
    return out


def lexical(t: Column) -> dict[str, Column]:
    low = F.lower(t)
    words = F.filter(F.split(low, r"[ \t\n\r]"), lambda x: x != "")
    n = F.greatest(F.size(words), F.lit(1))
    verbs = F.size(F.filter(words, lambda x: x.isin(catalog.IMPERATIVES)))
    per_word = lambda phrases: _one(occurrences(low, phrases) / n * 10)
    return {
        "InjectionKeywords": per_word(catalog.INJECTION_WORDS),
        "CommandKeywords": per_word(catalog.COMMAND_WORDS),
        "RoleKeywords": per_word(catalog.ROLE_WORDS),
        "ImperativeMood": _one(_ratio(verbs, F.size(words)) * 5),
        "QuestionDensity": _one(count_of(t, "?") / n * 5),
        "ExclamationDensity": _one(count_of(t, "!") / n * 5),
        "IgnorePattern": _flag(contains_any(low, catalog.IGNORE_PHRASES)),
        "NewInstructionsPattern": _flag(contains_any(low, catalog.INSTRUCTION_PHRASES)),
        "PersonaSwitchPattern": _flag(contains_any(low, catalog.PERSONA_PHRASES)),
        "SystemPromptRef": _flag(contains_any(low, catalog.PROMPT_PHRASES)),
        "CodeIndicators": _flag(contains_any(low, catalog.CODE_PHRASES)),
        "SocialEngineering": sum((low.contains(p).cast("int") for p in catalog.SOCIAL_PHRASES), F.lit(0)) / 5,
    }


def structural(t: Column, s: Column | None) -> dict[str, Column]:
    trimmed = F.regexp_replace(t, r"(?U)^\s+|\s+$", "")
    runs = F.transform(F.regexp_extract_all(t, F.lit(r"(?s)((.)\2*)"), 1), F.length)
    sections = F.least(F.lit(20.0), F.lit(1) + occurrences(t, catalog.SECTION_MARKS))
    special = F.length(F.regexp_replace(t, r"(?U)[\p{L}\p{Nd}\s]", ""))
    out = {
        "RepeatedDelimiters": _flag(t.rlike(catalog.LONG_DELIMITERS)),
        "XmlTags": _flag(t.rlike(catalog.XML_TAG)),
        "JsonStructure": _flag((trimmed.startswith("{") & trimmed.endswith("}")) | (trimmed.startswith("[") & trimmed.endswith("]")) | t.contains('":')),
        "MarkdownHeaders": _one(F.regexp_count(t, F.lit("(?dm)^#")) / 10),
        "Base64Content": _flag(t.rlike(catalog.FEATURE_BASE64)),
        "HexContent": _flag(t.rlike(catalog.FEATURE_HEX)),
        "UrlPresence": _flag(contains_any(t, ["http://", "https://", "www."])),
        "EmailPresence": _flag(t.rlike(catalog.EMAIL)),
        "ConsecutiveSameChar": _one(F.coalesce(F.array_max(runs), F.lit(0)) / 20),
        "TemplatePlaceholders": _flag(contains_any(t, catalog.PLACEHOLDERS)),
        "SectionCount": _one(sections / 10),
    }
    if s is not None:
        mixed = F.when(contains_any(t, ["```", "def ", "function"]), 0.2).otherwise(0.0) + F.when(contains_any(t, ["##", "**", "__"]), 0.15).otherwise(0.0) + F.when(contains_any(t, ["</", "/>"]), 0.2).otherwise(0.0)
        out["StructuralComplexity"] = F.when(F.length(t) == 0, 0.0).otherwise(_one(F.least(s["depth"] / 10, F.lit(0.3)) + mixed + F.least(_ratio(special, F.length(t)), F.lit(0.15))))
    return out


def features(t: Column, s: Column | None) -> dict[str, Column]:
    """Name to value in the fixed order; s is char_features() of the text, without which five are missing."""
    found = statistical(t, s) | character(t, s) | lexical(t) | structural(t, s)
    return {name: found[name] for name in catalog.FEATURES if name in found}


