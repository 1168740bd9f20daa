"""Event-time windows over streams: tumbling and sliding windows, and sessions, with late rows dropped by a rule.

Each has a batch form over the same rows with the number of the micro-batch that each came
in, and a stream that is replayed gives the batch form's rows. Watermarks are in whole
milliseconds, as in Spark: the greatest time of rows seen, less the delay.

Windows: the stream is Spark's own aggregation, combined before the shuffle, so a key that
holds a third of all rows is no task's burden. It drops a row from a window that has ended
by the watermark of the batch before the last. Batches without data would move that rule;
for a replay to be exact, spark.sql.streaming.noDataMicroBatches.enabled is to be false.

Sessions: a stateful operator keeps the open sessions of a key. It drops rows that are not
after the watermark of the batches before, whatever batches without data come in between,
and closes sessions that end by it. So a row that is not dropped never belongs to a session
already closed. Needs the RocksDB state store (see STATE_STORE).

Rows with a null time or key are in no window. Rows that repeat count each time.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StructType

STATE_STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")

#: Seconds of a key's time that the batch form of sessions sorts at once.
SLICE = 86_400


def event_stream(spark: SparkSession, folder: str, schema: StructType, files: int | None = None) -> DataFrame:
    """Rows of the Parquet files that come into a folder, in the order of the files' times; `files` of them in a micro-batch at most."""
    reader = spark.readStream.schema(schema)
    return (reader if files is None else reader.option("maxFilesPerTrigger", files)).parquet(folder)


def _windows(events: DataFrame, time: str, width: str, slide: str | None) -> DataFrame:
    return events.withColumn("__w", F.window(time, width, slide or width))


def _named(made: DataFrame) -> DataFrame:
    return made.select(F.col("__w.start").alias("start"), F.col("__w.end").alias("end"), *[c for c in made.columns if c != "__w"])


def windowed_stream(events: DataFrame, time: str, by: list[str], measures: list[Column], width: str, delay: str, slide: str | None = None) -> DataFrame:
    """start, end, by, measures of each window and key, once the watermark has passed its end."""
    seen = _instants(events, by, time).withWatermark(time, delay)
    return _named(_windows(seen, time, width, slide).groupBy("__w", *by).agg(*measures))


def _instants(events: DataFrame, by: list[str], time: str) -> DataFrame:
    """Events with a time and key; times without a zone are of the session's."""
    whole = F.col(time).isNotNull()
    for b in by:
        whole = whole & F.col(b).isNotNull()
    return events.where(whole).withColumn(time, F.col(time).cast("timestamp"))


def with_watermark(rows: DataFrame, time: str, batch: str, delay_s: int, lag: int) -> DataFrame:
    """rows with __watermark, in milliseconds: of all batches up to `lag` before the row's own; null before there is any.

    One row for each batch is sorted in one task, and joined back by batch.
    """
    tops = rows.groupBy(F.col(batch).alias("__b")).agg((F.floor(F.unix_micros(F.max(time)) / 1000) - 1000 * delay_s).alias("__top"))
    ahead = Window.orderBy("__b").rangeBetween(Window.unboundedPreceding, -lag)
    marks = tops.select("__b", F.max("__top").over(ahead).alias("__watermark"))
    return rows.join(marks, F.col(batch) == F.col("__b")).drop("__b")


def windowed_batches(events: DataFrame, time: str, by: list[str], measures: list[Column], width: str, delay_s: int, batch: str, slide: str | None = None) -> DataFrame:
    """As windowed_stream gives it for the batches numbered by `batch` without gaps, and the windows still open."""
    marked = with_watermark(_instants(events, by, time), time, batch, delay_s, 2)
    rows = _windows(marked, time, width, slide)
    in_time = F.coalesce(F.unix_micros("__w.end") > F.col("__watermark") * 1000, F.lit(True))
    return _named(rows.where(in_time).groupBy("__w", *by).agg(*measures))


_SESSION = "first long, last long, n long, total long"


class _Sessions(StatefulProcessor):
    """Open sessions of a key: first and last time in microseconds, rows, total."""

    def __init__(self, key: str, gap_s: int):
        self.key, self.gap = key, gap_s * 1_000_000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open = handle.getListState("open", _SESSION)

    def _ends(self, last: int) -> int:
        return -(-(last + self.gap) // 1000)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        mark = timerValues.getCurrentWatermarkInMs()
        held = [list(s) for s in self.open.get()] if self.open.exists() else []
        for batch in rows:
            micros, amounts = batch.iloc[:, 2], batch.iloc[:, 3]  # Spark renames computed columns of a group
            fresh = micros // 1000 > mark
            held += [[t, t, 1, a] for t, a in zip(micros[fresh].tolist(), amounts[fresh].tolist(), strict=True)]
            held = self._merged(held)
        if held:
            for s in held:
                self.handle.registerTimer(self._ends(s[1]))
            self.open.put([tuple(s) for s in held])
        return iter([])

    def _merged(self, sessions: list[list[int]]) -> list[list[int]]:
        out: list[list[int]] = []
        for s in sorted(sessions):
            if out and s[0] < out[-1][1] + self.gap:
                out[-1][1] = max(out[-1][1], s[1])
                out[-1][2] += s[2]
                out[-1][3] += s[3]
            else:
                out.append(s)
        return out

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        """A timer of a session that has grown since finds it open and leaves it to its later timer."""
        mark = timerValues.getCurrentWatermarkInMs()
        held = [tuple(s) for s in self.open.get()] if self.open.exists() else []
        closed = [s for s in held if self._ends(s[1]) <= mark]
        if not closed:
            return
        left = [s for s in held if self._ends(s[1]) > mark]
        if left:
            self.open.put(left)
        else:
            self.open.clear()
        yield pd.DataFrame([(key[0], *s) for s in closed], columns=[self.key, "first", "last", "n", "total"])

    def close(self) -> None:
        pass


def session_stream(events: DataFrame, time: str, by: str, amount: str, gap_s: int, delay: str) -> DataFrame:
    """by, start, end, n, total of each session: a key's rows with less than gap_s seconds between neighbours; end is the last row's time and the gap.

    amount is a column of whole numbers. A key's rows of one micro-batch are one task's.
    """
    whole = F.coalesce(F.col(amount).cast("long"), F.lit(0).cast("long"))
    rows = _instants(events, [by], time).withWatermark(time, delay).select(by, time, F.unix_micros(time), whole)
    kind = events.schema[by].dataType.simpleString()
    made = rows.groupBy(by).transformWithStateInPandas(_Sessions(by, gap_s), f"`{by}` {kind}, {_SESSION}", "Append", "EventTime")
    return made.select(by, F.timestamp_micros("first").alias("start"), F.timestamp_micros(F.col("last") + gap_s * 1_000_000).alias("end"), "n", "total")


def _islands(rows: DataFrame, keys: list[str], gap: int) -> DataFrame:
    """Rows (keys, __first, __last, n, total) whose times, in microseconds, are less than a gap apart, as one."""
    order = Window.partitionBy(*keys).orderBy("__first", "__last")
    reach = F.max("__last").over(order.rowsBetween(Window.unboundedPreceding, -1))
    fresh = F.coalesce(F.col("__first") >= reach + gap, F.lit(True))
    numbered = rows.withColumn("__new", fresh.cast("int")).withColumn("__no", F.sum("__new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return numbered.groupBy(*keys, "__no").agg(F.min("__first").alias("__first"), F.max("__last").alias("__last"), F.sum("n").alias("n"), F.sum("total").alias("total"))


def session_batches(events: DataFrame, time: str, by: str, amount: str, gap_s: int, delay_s: int, batch: str, slice_s: int = SLICE) -> DataFrame:
    """As session_stream gives it for the batches numbered by `batch`, and the sessions still open.

    Sessions are found in slices of a key's time first, which are many tasks for a key of many
    rows, and joined across slices then.
    """
    marked = with_watermark(_instants(events, [by], time), time, batch, delay_s, 1)
    micros = F.unix_micros(time)
    in_time = F.coalesce(F.floor(micros / 1000) > F.col("__watermark"), F.lit(True))
    rows = marked.where(in_time).select(by, F.floor(micros / (slice_s * 1_000_000)).alias("__slice"), micros.alias("__first"), micros.alias("__last"), F.lit(1).cast("long").alias("n"), F.coalesce(F.col(amount).cast("long"), F.lit(0).cast("long")).alias("total"))
    gap = gap_s * 1_000_000
    found = _islands(_islands(rows, [by, "__slice"], gap).drop("__no"), [by], gap)
    return found.select(by, F.timestamp_micros("__first").alias("start"), F.timestamp_micros(F.col("__last") + gap).alias("end"), "n", "total")
