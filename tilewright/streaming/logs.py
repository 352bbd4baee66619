"""Build logs and events as streams.

The same expressions parse a log in batch and as a stream; state is needed only to hold a run's last
duration until the run ends, and to report a percentage when it changes.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..functions.text import log_event


def read_log_stream(spark: SparkSession, *folders: str) -> DataFrame:
    """Lines of new files in one or more folders (column ``value``), merged in the order of arrival."""
    out = None
    for folder in folders:
        lines = spark.readStream.text(folder)
        out = lines if out is None else out.union(lines)
    return out


def parsed(lines: DataFrame, column: str = "value") -> DataFrame:
    """Stateless: every line becomes an event; lines of no known shape are of kind log."""
    return lines.select("*", log_event(F.col(column)).alias("_e")).select("*", "_e.*").drop("_e")


def tail(lines: DataFrame, order: str = "line_no", keep: int = 400, show: int = 25) -> DataFrame:
    """The last ``show`` of the last ``keep`` lines, in order."""
    return lines.orderBy(F.desc(order)).limit(min(keep, show)).orderBy(order)


#: Lines that are looked at together for what is held before each.
_RUN = 10_000


def held_durations(events: DataFrame, order: str = "line_no") -> DataFrame:
    """``(order, took)`` of each end of a run: the duration that the last end of a phase since the end before gave, else null.

    Found in blocks of lines, and over the blocks by the last of each, so no task sorts the whole log.
    """
    mark = F.when(F.col("event").isin("phase_end", "run_end"), F.struct("event", "took"))
    rows = events.select(order, "event", "took", mark.alias("mark"), F.floor(F.col(order) / _RUN).alias("block"))
    lasts = rows.groupBy("block").agg(F.max_by("mark", F.when(F.col("mark").isNotNull(), F.col(order))).alias("last"))
    before = Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = lasts.select("block", F.last("last", ignorenulls=True).over(before).alias("first"))
    inside = Window.partitionBy("block").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    held = rows.join(blocks, "block").withColumn("held", F.coalesce(F.last("mark", ignorenulls=True).over(inside), F.col("first")))
    return held.where("event = 'run_end'").select(order, F.when(F.col("held.event") == "phase_end", F.col("held.took")).alias("took"))


class _HeldDuration(StatefulProcessor):
    """The duration of a run's last ended phase, until the run ends or nothing has come for a while."""

    def __init__(self, order: str, idle_ms: int):
        self.order, self.idle_ms = order, idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getValueState("held", "took string")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        before = self.held.get()
        held = before[0] if before else None
        for line in sorted(rows, key=lambda r: r[self.order]):
            if line["event"] == "phase_end":
                held = line["took"]
            else:
                yield Row(**{"run": key[0], self.order: line[self.order], "took": held})
                held = None
        if before:  # there is a timer while something is held
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer)
        if held is not None:
            self.held.update((held,))
            self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.idle_ms)
        elif before:
            self.held.clear()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        self.held.clear()
        return iter([])

    def close(self) -> None:
        pass


class _Changes(StatefulProcessor):
    """The last percentage of a stage; a row for each that differs from the one before."""

    def __init__(self, order: str):
        self.order = order

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", "percent int")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        known = self.last.get()
        before = last = known[0] if known else None
        for line in sorted(rows, key=lambda r: r[self.order]):
            if line["percent"] != last:
                last = line["percent"]
                yield Row(**{"run": key[0], "stage": key[1], self.order: line[self.order], "percent": last})
        if last != before:
            self.last.update((last,))

    def close(self) -> None:
        pass


def _with_state(spark: SparkSession) -> None:
    """State of processors is kept in RocksDB; the setting is the session's."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def run_durations(events: DataFrame, run: str = "path", order: str = "offset", idle_ms: int = 86_400_000) -> DataFrame:
    """Streaming: ``(run, order, took)`` at each end of a run, with the duration its last ended phase gave.

    One duration is held for a run; it is given out and forgotten at the end, and forgotten after ``idle_ms`` without a
    line. Lines of a run have to come in order, batch after batch; inside a batch they are sorted by ``order``.
    """
    _with_state(events.sparkSession)
    ended = events.where("event IN ('phase_end', 'run_end')").select(F.col(run).cast("string").alias("run"), F.col(order).cast("long").alias(order), "event", "took")
    return ended.groupBy("run").transformWithState(_HeldDuration(order, idle_ms), f"run string, {order} long, took string", "append", "ProcessingTime")


def percent_changes(events: DataFrame, run: str = "path", order: str = "offset") -> DataFrame:
    """Streaming: ``(run, stage, order, percent)`` of the progress lines whose percentage is not that of the stage's line before."""
    _with_state(events.sparkSession)
    own = events.where("event = 'progress'").select(F.col(run).cast("string").alias("run"), "stage", F.col(order).cast("long").alias(order), "percent")
    return own.groupBy("run", "stage").transformWithState(_Changes(order), f"run string, stage string, {order} long, percent int", "append", "None")


def windowed_counts(events: DataFrame, width: str = "1 day", late: str = "2 days", slide: str | None = None) -> DataFrame:
    """Events (ts, event_type, value) counted and summed in event-time windows; later ones than ``late`` are left out of closed windows."""
    window = F.window("ts", width, slide) if slide else F.window("ts", width)
    out = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late).groupBy(window, "event_type").agg(F.count(F.lit(1)).alias("events"), F.sum("value").alias("total"))
    return out.select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), "event_type", "events", "total")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "2 hours") -> DataFrame:
    """Events of each user in sessions that end with a gap."""
    out = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late).groupBy(F.session_window("ts", gap), "user_id").agg(F.count(F.lit(1)).alias("events"))
    return out.select("user_id", F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "events")


def pairs_within(first: DataFrame, second: DataFrame, within: str = "1 hour", late: str = "2 hours", by: str = "user_id") -> DataFrame:
    """``(by, first_id, second_id, first_ts, second_ts)``: each event of ``second`` that follows one of ``first`` of the same user in time.

    Two streams of events (event_id, user_id, ts): both have a watermark, and the interval says how long a row has to be
    kept for the other side, so state is dropped as time goes on. Rows later than the watermark find no partner that is gone.
    """
    a = first.select(F.col(by), F.col("event_id").alias("first_id"), F.col("ts").cast("timestamp").alias("first_ts")).withWatermark("first_ts", late)
    b = second.select(F.col(by).alias("_by"), F.col("event_id").alias("second_id"), F.col("ts").cast("timestamp").alias("second_ts")).withWatermark("second_ts", late)
    near = (F.col("second_ts") >= F.col("first_ts")) & (F.col("second_ts") <= F.col("first_ts") + F.expr(f"INTERVAL {within}"))
    return a.join(b, (F.col(by) == F.col("_by")) & near).where("first_id <> second_id").drop("_by")
