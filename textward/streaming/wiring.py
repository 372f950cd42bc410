"""The same analysis over streams: it keeps no state, so batch and stream share the plan."""

from __future__ import annotations

import logging
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener
from pyspark.sql.types import StructType

from textward.config import Config
from textward.operators.patterns import Pattern
from textward.plans.cascade import analyze
from textward.telemetry import lifecycle, observed


def read_texts(spark: SparkSession, path: str, schema: StructType | str, files_per_batch: int = 64) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def verdicts(stream: DataFrame, text: str = "text", config: Config | None = None) -> DataFrame:
    return analyze(stream, text, config)


def threat_rate(stream: DataFrame, ts: str, window: str = "5 minutes", slide: str | None = None, late: str = "10 minutes") -> DataFrame:
    """Analyses and threats in windows of event time; state is dropped behind the watermark."""
    w = F.window(ts, window, slide) if slide else F.window(ts, window)
    return stream.withWatermark(ts, late).groupBy(w.alias("w")).agg(F.count(F.lit(1)).alias("analyses"), F.count_if("verdict.is_threat").alias("threats")).select("w.start", "w.end", "analyses", "threats")


Handler = Callable[[DataFrame, int], None]


def each_batch(stream: DataFrame, handlers: Sequence[Handler], checkpoint: str, text: str = "text", config: Config | None = None, patterns: Callable[[], Sequence[Pattern]] | None = None, failures: str | None = None, name: str = "analysis") -> StreamingQuery:
    """Analyse each micro-batch and hand it to the handlers in order. `patterns` is asked anew for every batch, so that a catalogue
    can change while the stream runs.

    A handler's error does not stop the others. It is logged and, where `failures` names a folder, kept there: batch, handler, place, error;
    failed() reads them, so that what is missing can be done again. A batch that is run again after a crash replaces what it left, as do handlers that
    key what they write by the batch's number, like event_sink(). Counters are observed under `name`, for counted() to collect, unless telemetry is off."""
    config = config or Config()

    def step(batch: DataFrame, number: int) -> None:
        found = observed(analyze(batch, text, config, more_patterns=patterns() if patterns else ()), name, text, config.telemetry)
        found.persist()
        wrong: list[tuple[int, str, int, str]] = []
        try:
            for k, handle in enumerate(handlers):
                try:
                    handle(found, number)
                except Exception as error:  # noqa: BLE001  handlers are the user's
                    own = getattr(handle, "__name__", type(handle).__name__)
                    LOG.warning("handler %s failed on batch %s: %s", own, number, error)
                    wrong.append((number, own, k, f"{type(error).__name__}: {error}"))
            if failures is not None:
                batch.sparkSession.createDataFrame(wrong, FAILED).write.mode("overwrite").parquet(f"{failures}/of_batch={number}")
        finally:
            found.unpersist()

    return stream.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).start()


LOG = logging.getLogger(__name__)
FAILED = "batch long, handler string, place int, error string"


def failed(spark: SparkSession, failures: str) -> DataFrame:
    """What each_batch() has kept of handlers' errors."""
    return spark.read.schema(FAILED).parquet(failures).drop("of_batch")


def event_sink(path: str, key: str, config: Config | None = None) -> Handler:
    """A handler that writes lifecycle events, each once: a batch has its own folder below path and replaces it when it is run again. Nothing is written
    where logging is off."""
    on = (config or Config()).telemetry.logging

    def events(found: DataFrame, number: int) -> None:
        if on:
            lifecycle(found, key).write.mode("overwrite").parquet(f"{path}/of_batch={number}")

    return events


def events(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """The events that event_sink() has written, with the number of their batch."""
    return spark.read.schema(schema).option("basePath", path).parquet(f"{path}/of_batch=*").withColumnRenamed("of_batch", "batch")


class Counted(StreamingQueryListener):
    """Gathers the counters observed under a name, by query and batch, so that a batch that is run again counts once."""

    def __init__(self, name: str = "analysis") -> None:
        self.name, self.batches = name, {}

    def onQueryStarted(self, event) -> None:  # noqa: ANN001, N802
        pass

    def onQueryProgress(self, event) -> None:  # noqa: ANN001, N802
        row = event.progress.observedMetrics.get(self.name)
        if row is not None:
            self.batches[str(event.progress.id), event.progress.batchId] = row.asDict()

    def onQueryIdle(self, event) -> None:  # noqa: ANN001, N802
        pass

    def onQueryTerminated(self, event) -> None:  # noqa: ANN001, N802
        pass

    def totals(self) -> dict[str, int]:
        """Sums of the counters; of the length, the largest."""
        out: dict[str, int] = {}
        for row in self.batches.values():
            for c, n in row.items():
                out[c] = max(out.get(c, 0), n or 0) if c == "longest" else out.get(c, 0) + (n or 0)
        return out
