"""Streaming: ingest once, segment trials with state, and rates over windows (section T)."""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle


def events_stream(spark: SparkSession, path: str, schema: T.StructType, files_at_once: int | None = 1) -> DataFrame:
    """New Parquet files below a path, as they come: so many a batch, or (None) all that are there.

    A batch moves the watermark, so files that are not read at once must lie no further apart in time, in the order in
    which they were written, than the lateness that a query allows.
    """
    reader = spark.readStream.schema(schema)
    return (reader.option("maxFilesPerTrigger", files_at_once) if files_at_once else reader).parquet(path)


def session_for(spark: SparkSession, partitions: int | None = None) -> SparkSession:
    """A session of the same application for stateful streams: state in RocksDB, which transformWithState needs, and one
    partition of state a core unless told otherwise, as the number stays with the checkpoint. The caller's session keeps
    its settings."""
    own = spark.newSession()
    own.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    own.conf.set("spark.sql.shuffle.partitions", str(partitions or spark.sparkContext.defaultParallelism))
    own.conf.set("spark.sql.session.timeZone", spark.conf.get("spark.sql.session.timeZone"))
    return own


def deliver(df: DataFrame, time: str, folder: str, parts: int) -> Iterator[str]:
    """df as a recording comes in: folder/<k> holds the files of a range of time, written when it is asked for.

    Ranges are cut at quantiles of time, so a part is a like share of the rows, written by as many tasks as hold it. Each
    of its files may reach over the whole range, so a stream must read a part in one batch, before the next part comes.
    Rows without a time are in no part, as no watermark can place them.
    """
    known = df.where(F.col(time).isNotNull())
    cuts = known.agg(F.percentile_approx(F.unix_micros(F.col(time).cast("timestamp")), [k / parts for k in range(1, parts)], 1000)).first()[0] or []
    part = sum((F.unix_micros(F.col(time).cast("timestamp")) > c).cast("int") for c in cuts) if cuts else F.lit(0)
    for k in range(len(cuts) + 1):
        known.where(part == k).write.parquet(f"{folder}/{k}")
        yield f"{folder}/{k}"


def feed(df: DataFrame, time: str, folder: str, parts: int) -> list[str]:
    """The folders of all parts that ``deliver`` writes."""
    return list(deliver(df, time, folder, parts))


def _run(writer, checkpoint: str) -> dt.datetime | None:
    query = writer.option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    seen = [p["eventTime"]["max"] for p in query.recentProgress if "max" in p["eventTime"]]
    return max((dt.datetime.fromisoformat(x) for x in seen), default=None)


def drain(stream: DataFrame, out: str, checkpoint: str, mode: str = "append") -> dt.datetime | None:
    """Handle all that is there, append it to a Parquet table, and stop; a later call goes on from the checkpoint.
    Returns the latest event time of the rows that came, if any had one."""
    return _run(stream.writeStream.format("parquet").option("path", out).outputMode(mode), checkpoint)


def end_marker(spark: SparkSession, folder: str, schema: T.StructType, time: str, after: dt.datetime, by: dt.timedelta) -> None:
    """A row of nothing but an event time, so much after the last row of a recording, as a new file of its stream: the
    watermark follows it, so that the stream settles and forgets all that it still keeps."""
    row = tuple(after.astimezone(dt.timezone.utc).replace(tzinfo=None) + by if f.name == time else None for f in schema)
    free = T.StructType([T.StructField(f.name, T.TimestampNTZType() if f.name == time else f.dataType) for f in schema])
    spark.createDataFrame([row], free).write.mode("append").parquet(folder)


def upsert(result: DataFrame, out: str, checkpoint: str, mode: str = "update") -> dt.datetime | None:
    """Handle all that is there; each micro-batch writes the rows that it changed under its own number, then itself into
    the ledger. A batch that is run again writes the same place, and none touches what earlier ones wrote."""

    def write(rows: DataFrame, batch: int) -> None:
        rows.write.mode("overwrite").parquet(f"{out}/rows/batch={batch}")
        rows.sparkSession.range(1).select(F.lit(batch).cast("long").alias("done"), F.current_timestamp().alias("at")).write.mode("overwrite").parquet(f"{out}/ledger/batch={batch}")

    return _run(result.writeStream.foreachBatch(write).outputMode(mode), checkpoint)


def latest(spark: SparkSession, out: str, keys: list[str]) -> DataFrame:
    """What ``upsert`` has written: of each key the row of the last batch that the ledger holds."""
    rows = spark.read.parquet(f"{out}/rows")
    done = spark.read.parquet(f"{out}/ledger").select(F.col("done").alias("batch"))
    kept = rows.withColumn("batch", F.col("batch").cast("long")).join(done, "batch", "left_semi")
    values = [c for c in rows.columns if c not in (*keys, "batch")]
    last = kept.groupBy(*keys).agg(F.max_by(F.struct(*values), "batch").alias("_x"))
    return last.select(*keys, "_x.*")


def ingest(stream: DataFrame, key: str, time: str, lateness: str) -> DataFrame:
    """Each event once, repeats within the allowed lateness dropped; older state is forgotten."""
    return stream.withWatermark(time, lateness).dropDuplicatesWithinWatermark([key])


class Segmenter(StatefulProcessor):
    """A session's marks until the watermark has passed them, and its open start until it is stopped or too old.

    Marks are only put in order and paired when a timer wakes the session at the earliest time that it waits for: a mark
    that the watermark passes, or the last moment at which the open start could still be stopped. A session that waits
    for nothing keeps no state.
    """

    def __init__(self, key: str, start: int, stop: int, longest: int):
        self.key, self.start, self.stop, self.longest = key, start, stop, longest

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.marks = handle.getListState("marks", "ms long, time long, seq long, code int")
        self.open = handle.getValueState("open", "ms long, time long")
        self.wake = handle.getValueState("wake", "ms long")

    def _wait(self, until: int | None) -> None:
        if self.wake.exists():
            before = self.wake.get()[0]
            if before == until:
                return
            self.handle.deleteTimer(before)
        if until is None:
            self.wake.clear()
        else:
            self.wake.update((until,))
            self.handle.registerTimer(until)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        came = [m for x in rows for m in zip(*(x[c].tolist() for c in ("ms", "time", "seq", "code")))]
        self.marks.appendList(came)
        first = min(m[0] for m in came)
        if not self.wake.exists() or first < self.wake.get()[0]:
            self._wait(first)
        return iter(())

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        passed = timerValues.getCurrentWatermarkInMs()
        marks, found = sorted(self.marks.get(), key=lambda m: m[1:]), []
        open_ = self.open.get() if self.open.exists() else None
        for ms, time, _, code in (m for m in marks if m[0] <= passed):
            if open_ and (code == self.start or ms - open_[0] > self.longest):
                found.append((open_[1], None))
                open_ = None
            if code == self.start:
                open_ = (ms, time)
            elif open_:
                found.append((open_[1], time))
                open_ = None
        if open_ and open_[0] + self.longest <= passed:
            found.append((open_[1], None))
            open_ = None
        rest = [m for m in marks if m[0] > passed]
        if rest:
            self.marks.put(rest)
        else:
            self.marks.clear()
        if open_:
            self.open.update(open_)
        else:
            self.open.clear()
        self.wake.clear()  # the timer that fired is gone
        waits = [m[0] for m in rest] + ([open_[0] + self.longest] if open_ else [])
        self._wait(min(waits, default=None))
        if found:
            yield pd.DataFrame({self.key: [key[0]] * len(found), "start": [a for a, _ in found], "stop": pd.array([b for _, b in found], "Int64"), "complete": [b is not None for _, b in found]})


def segment(stream: DataFrame, key: str, event_time: str, time: str, seq: str, code: str, start: int, stop: int, lateness: str, longest: dt.timedelta) -> DataFrame:
    """(key, start, stop, complete) of trials: from a start to the first stop after it. A start that another start follows
    first, or no stop within longest of event time, is an incomplete trial without a stop.

    event_time is a timestamp, time a long that grows with it, and seq a long that orders equal times. Rows may come in
    any order within the lateness; later ones are dropped, as by any watermark. A trial leaves the stream in the batch
    whose watermark has passed its end, an incomplete one when its next start or its longest time is passed; then its
    state goes. Rows of other codes, and of a null key, only move the watermark. The stream's session must keep its state
    in RocksDB (``session_for``).
    """
    kind = stream.schema[key].dataType.simpleString()
    # a condition that names the event time stays above the watermark, which all rows move
    wanted = F.when(F.col(event_time).isNotNull(), F.col(code).isin(start, stop) & F.col(key).isNotNull())
    marks = stream.withWatermark(event_time, lateness).where(wanted)
    columns = {"ms": F.unix_millis(event_time), "time": F.col(time).cast("long"), "seq": F.col(seq).cast("long"), "code": F.col(code).cast("int")}
    marks = marks.select(key, F.col(event_time).alias("_event_time"), *[c.alias(n) for n, c in columns.items()])
    own = Segmenter(key, start, stop, int(longest.total_seconds() * 1000))
    return marks.groupBy(key).transformWithStateInPandas(own, f"{key} {kind}, start long, stop long, complete boolean", "append", "EventTime")


def rates(stream: DataFrame, time: str, window: str, lateness: str, by: list[str], slide: str | None = None) -> DataFrame:
    """Events by window of time, overlapping if it slides, and group. In update or append mode a window's state goes when
    the watermark has passed its end. Rows without a time are in no window."""
    return stream.withWatermark(time, lateness).groupBy(F.window(time, window, slide).alias("w"), *by).agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("window_start"), *by, "n")


def burst_rates(stream: DataFrame, time: str, gap: str, lateness: str, by: list[str]) -> DataFrame:
    """Events by burst and group: a burst ends when its group has no event for so long. In append mode it leaves the
    stream, and its state goes, when the watermark has passed its end."""
    return stream.withWatermark(time, lateness).groupBy(F.session_window(time, gap).alias("w"), *by).agg(F.count(F.lit(1)).alias("n")).select(*by, F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "n")
