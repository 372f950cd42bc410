"""Request routing: which requests are analysed, by method, content type and path."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from textward import catalog


def path_matches(path: Column, pattern: str) -> Column:
    """A pattern that ends in * matches by what stands before it (less a final /); any other matches a whole path."""
    if pattern.endswith("*"):
        return F.lower(path).startswith(pattern.rstrip("*").rstrip("/").lower())
    return F.lower(path) == pattern.lower()


def should_analyze(method: Column, content_type: Column, path: Column, protected: Sequence[str] = (), excluded: Sequence[str] = tuple(catalog.EXCLUDED_PATHS), methods: Sequence[str] = tuple(catalog.METHODS), types: Sequence[str] = tuple(catalog.CONTENT_TYPES)) -> Column:
    def any_path(patterns: Sequence[str]) -> Column:
        found = F.lit(False)
        for p in patterns:
            found = found | path_matches(path, p)
        return found

    kind = F.lower(F.trim(F.split_part(F.coalesce(content_type, F.lit("")), F.lit(";"), F.lit(1))))
    reached = F.lit(True) if not protected else any_path(protected)
    return F.upper(method).isin(list(methods)) & kind.isin(list(types)) & ~any_path(excluded) & reached


def metadata(source: Column, correlation: Column, properties: dict[str, Column]) -> Column:
    """The request's metadata struct, with properties as a map."""
    pairs = F.create_map(*[x for k, v in properties.items() for x in (F.lit(k), v.cast("string"))])
    return F.struct(source.alias("source"), correlation.alias("correlation_id"), pairs.alias("properties"))
