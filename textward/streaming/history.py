"""Requests with their conversation: each turn with the turns before it, so that an attack split over turns is seen whole.

A turn sees the `turns` turns before it, so that what is kept of a conversation is bounded however long it gets. Over a table a window
gives them; over a stream a conversation's last turns are its state, dropped when the watermark has passed them by `idle`. No turn
is joined with another table of turns.

Turns are ordered by `order`, ties by text. A null text is an empty turn. A null conversation is one. In a stream, turns of a batch are
ordered within it, and a turn that comes later than its successors is put behind them.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import ArrayType, StringType, StructType

from textward.shipping import ship


def with_history(df: DataFrame, conversation: str, order: str, text: str, turns: int = 10) -> DataFrame:
    """df with `history`, an array of the texts of up to `turns` turns before, oldest first."""
    before = Window.partitionBy(conversation).orderBy(order, text).rowsBetween(-turns, -1) if turns else None
    said = F.coalesce(F.col(text), F.lit(""))
    return df.withColumn("history", F.collect_list(said).over(before) if before is not None else F.array().cast("array<string>"))


def whole(history: Column, text: Column, separator: str = "\n") -> Column:
    """The turn behind what was said before, as one text to screen."""
    return F.array_join(F.concat(history, F.array(F.coalesce(text, F.lit("")))), separator)


class LastTurns(StatefulProcessor):
    """history_of_stream()'s state for each conversation."""

    def __init__(self, names: list[str], order: str, text: str, turns: int, idle: float) -> None:
        self.names, self.order, self.text, self.turns, self.idle = names, order, text, turns, idle

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "said array<string>, at long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:  # noqa: N802, N803, ANN001
        said, at = self.last.get() if self.last.exists() else ([], 0)
        said = list(said)
        for row in sorted(rows, key=lambda r: (r[self.order], r[self.text] or "")):  # of one batch
            yield Row(**{c: row[c] for c in self.names}, history=list(said))
            said = [*said, row[self.text] or ""][-self.turns :]
            at = max(at, row["_at"])
        self.last.update((said, at))
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        self.handle.registerTimer(at // 1000 + int(self.idle * 1000))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:  # noqa: N802, N803, ANN001
        self.last.clear()
        return iter(())

    def close(self) -> None:
        pass


def history_of_stream(stream: DataFrame, conversation: str, order: str, text: str, at: str, turns: int = 10, late: str = "10 minutes", idle: float = 3600.0) -> DataFrame:
    """The stream with `history`. `at`: event time, null ones are dropped; `idle`: seconds behind the watermark after which a conversation is forgotten.
    Needs the RocksDB state store."""
    ship(stream.sparkSession)
    names = [c for c in stream.columns if c != "history"]
    own = stream.where(F.col(at).isNotNull()).withWatermark(at, late).select(*names, F.col(conversation).alias("_key"), F.unix_micros(F.col(at)).alias("_at"))
    schema = StructType([stream.schema[c] for c in names]).add("history", ArrayType(StringType()))
    return own.groupBy("_key").transformWithState(LastTurns(names, order, text, turns, idle), schema, "Append", "EventTime")
