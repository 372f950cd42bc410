"""Validation of requests: errors decide, warnings are only told."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from textward.catalog import SUSPICIOUS
from textward.config import Config
from textward.functions.text import blank


def suspicious(text: Column) -> Column:
    """The distinct suspicious characters in order of appearance, as U+XXXX."""
    found = F.array_distinct(F.regexp_extract_all(text, F.lit(f"([{SUSPICIOUS}])"), 1))
    code = lambda c: F.concat(F.lit("U+"), F.lpad(F.hex(F.ascii(c)), 4, "0"))
    return F.transform(found, code)


def validation(text: Column, config: Config, system_prompt: Column | None = None) -> Column:
    """Struct of is_valid, errors and warnings."""
    most = config.max_length
    chars = suspicious(text)
    tail = F.when(F.size(chars) > 5, F.concat(F.lit(" and "), (F.size(chars) - 5).cast("string"), F.lit(" more"))).otherwise("")
    warning = F.concat(F.lit("PROMPT_SUSPICIOUS_CHARS: "), F.array_join(F.slice(chars, 1, 5), ", "), tail)
    found = [F.when(F.length(text) > most, F.lit(f"PROMPT_TOO_LONG: more than {most} characters")), F.when(F.instr(text, "\0") > 0, F.lit("PROMPT_INVALID_CHARS: forbidden characters"))]
    if system_prompt is not None:
        found.append(F.when(F.length(system_prompt) > most, F.lit(f"PROMPT_TOO_LONG: system prompt of more than {most} characters")))
    errors = F.when(blank(text), F.array(F.lit("PROMPT_REQUIRED: prompt is missing or blank"))).otherwise(F.array_compact(F.array(*found)))
    warnings = F.when(~blank(text) & (F.size(chars) > 0), F.array(warning)).otherwise(F.array().cast("array<string>"))
    return F.struct((F.size(errors) == 0).alias("is_valid"), errors.alias("errors"), warnings.alias("warnings"))
