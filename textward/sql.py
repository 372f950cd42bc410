"""For SQL: the table function scan_signals(text), and views over whole tables with the analysis's columns."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from textward import catalog
from textward.functions.repetition import repeats

_FLAGS = 2  # re.IGNORECASE


def register(spark: SparkSession) -> None:
    """scan_signals gives a row for every catalogue and heuristic pattern found; screened_view() makes views of whole tables."""

    @F.udtf(returnType="kind string, name string, weight double")
    class ScanSignals:
        def __init__(self) -> None:
            import re

            rows = [("pattern", p[1], catalog.SEVERITY_CONFIDENCE[p[2]], p[4].replace("(?i)", "")) for p in catalog.PATTERNS if p[0] != catalog.REPETITION]
            for kind, table in (("directive", catalog.DIRECTIVES), ("role", catalog.ROLES)):
                rows += [(kind, f"{kind}-{k + 1}", w, p) for k, (p, w) in enumerate(table)]
            self.rows = [(k, n, w, re.compile(p, _FLAGS)) for k, n, w, p in rows]
            self.repetition = [("pattern", p[1], catalog.SEVERITY_CONFIDENCE[p[2]]) for p in catalog.PATTERNS if p[0] == catalog.REPETITION]

        def eval(self, text: str) -> Iterator[tuple[str, str, float]]:
            for kind, name, weight, pattern in self.rows:
                if text is not None and pattern.search(text):
                    yield kind, name, weight
            if text is not None and repeats(text):
                yield from self.repetition

    spark.udtf.register("scan_signals", ScanSignals)


def screened_view(spark: SparkSession, table: str, view: str, text: str = "text") -> None:
    """A view over a table with the analysis's columns."""
    from textward.plans.cascade import analyze

    analyze(spark.table(table), text).createOrReplaceTempView(view)
