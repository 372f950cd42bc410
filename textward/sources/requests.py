"""Prompts from request bodies, and the answers to blocked requests."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from textward import catalog
from textward.config import CLOSED, OPEN
from textward.functions.text import blank


def json_value(body: Column, path: str) -> Column:
    """The text at a dotted path; `a[*].b` joins the non-blank texts of an array with newlines. Null if there is none."""
    if "[*]" in path:
        before, after = path.split("[*]", 1)
        item = F.get_json_object(body, f"$.{before}")
        rows = F.from_json(item, "array<string>")
        inner = after.lstrip(".")
        values = F.transform(rows, lambda x: F.get_json_object(x, f"$.{inner}")) if inner else rows
        texts = F.filter(values, lambda x: x.isNotNull() & ~x.rlike(r"(?U)^\s*$"))
        return F.when(F.size(texts) > 0, F.array_join(texts, "\n"))
    return F.get_json_object(body, f"$.{path}")


def prompt_of_json(body: Column, paths: Sequence[str] = tuple(catalog.PROMPT_PATHS)) -> Column:
    """The first non-blank text among the paths, as it stands."""
    options = [json_value(body, p) for p in paths]
    return F.coalesce(*[F.when(~blank(o), o) for o in options])


def prompt_of_body(content_type: Column, body: Column, limit: int = catalog.BODY_LIMIT) -> Column:
    """The prompt of a request: null over the limit and for blank bodies; text/plain as it stands, otherwise from JSON."""
    plain = F.lower(F.trim(F.split_part(content_type, F.lit(";"), F.lit(1)))) == "text/plain"
    return F.when((F.octet_length(body) <= limit) & ~blank(body), F.when(plain, body).otherwise(prompt_of_json(body)))


def problem(verdict: Column, analysis_id: Column, status: int = 400, details: bool = False, kind: str = "about:blank#threat-detected", on_error: str = CLOSED) -> Column:
    """The answer to a request that does not pass, as problem JSON; null for those that pass. `details` adds category and confidence to
    the answers to threats."""
    info = verdict["threat_info"]
    fields = [F.lit(kind).alias("type"), F.lit("Request Blocked").alias("title"), F.lit(status).alias("status"), F.coalesce(info["user_facing_message"], F.lit("Your request was blocked due to security concerns.")).alias("detail"), analysis_id.alias("analysisId")]
    if details:
        fields += [info["owasp_category"].alias("owaspCategory"), verdict["confidence"].alias("confidence")]
    failed = [F.lit("about:blank#analysis-failed").alias("type"), F.lit("Security Analysis Failed").alias("title"), F.lit(500).alias("status"), F.lit("Unable to complete security analysis. Request blocked for safety.").alias("detail")]
    what = action(verdict, on_error)
    return F.when(what == "error", F.to_json(F.struct(*failed))).when(what == "block", F.to_json(F.struct(*fields)))


def blocked_message(verdict: Column, analysis_id: Column) -> Column:
    """The text of a blocking error; null for those that pass."""
    info = verdict["threat_info"]
    share = F.format_string("%.0f%%", verdict["confidence"] * 100)
    full = F.format_string("Prompt injection detected: %s (AnalysisId: %s, OWASP: %s, Confidence: %s, Severity: %s)", info["threat_type"], analysis_id, info["owasp_category"], share, info["severity"])
    return F.when(verdict["is_threat"], F.when(info.isNull(), F.format_string("Potential prompt injection detected (AnalysisId: %s, Confidence: %s)", analysis_id, share)).otherwise(full))


def action(verdict: Column, on_error: str = CLOSED) -> Column:
    """pass, block or error. Texts that are invalid or whose analysis failed are errors, and pass where errors are to fail open."""
    failed = verdict["status"].isin("invalid", "error", "fail_open") | verdict["status"].isNull()
    return F.when(failed, "pass" if on_error == OPEN else "error").when(verdict["is_threat"], "block").otherwise("pass")
