"""Sequences of codes of two recorders, aligned by a sub-sequence or by session markers (section C9)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..staging import written
from .scans import HOT_ROWS, scan

#: Positions of a sequence that are searched by one task at once.
CHUNK = 1 << 16
_BASE = np.uint64(0x9E3779B97F4A7C15)
# Codes that begin and end a session; codes of the log, and of the recording, that are looked for.
SESSION_START, SESSION_END = 992, 993
LOG_KEY, RECORD_KEY = 6, 100


def places_of(codes: np.ndarray, key: np.ndarray) -> np.ndarray:
    """Where key begins in codes: by a rolling polynomial hash, modulo 2**64, whose hits are held against the codes."""
    n, k = len(codes), len(key)
    if not 0 < k <= n:
        return np.empty(0, np.int64)
    powers = np.concatenate(([np.uint64(1)], np.cumprod(np.full(n, _BASE))))
    sums = np.concatenate(([np.uint64(0)], np.cumsum(codes.astype(np.uint64) * powers[:n])))
    wanted = (key.astype(np.uint64) * powers[:k]).sum(dtype=np.uint64)
    hits = np.flatnonzero(sums[k:] - sums[:-k] == wanted * powers[: n - k + 1])
    return hits[[bool((codes[h : h + k] == key).all()) for h in hits]] if len(hits) else hits


def with_position(df: DataFrame, on: list[str], order: list[str], pos: str = "pos", hot_rows: int = HOT_ROWS) -> DataFrame:
    """df with each row's place in its session, from 0; sessions of any size."""
    return scan(df, on, order, hot_rows, **{pos: ("before", F.lit(1).cast("long"))})


def key_of(rows: DataFrame, on: list[str], length: int, pos: str = "pos", code: str = "code") -> DataFrame:
    """(on, key): the first codes of each session, at most so many."""
    return rows.where(F.col(pos) < length).groupBy(*on).agg(F.array_sort(F.collect_list(F.struct(pos, code))).alias("_k")).select(*on, F.col("_k").getField(code).alias("key"))


def occurrences(rows: DataFrame, keys: DataFrame, on: list[str], longest: int, pos: str = "pos", code: str = "code", chunk: int = CHUNK) -> DataFrame:
    """(on, at): the positions at which a session's key, of at most longest codes, occurs in its rows.

    Positions number a session's rows without gaps. They are dealt to chunks, each of which also gets the next one's first
    rows, so that keys across its end are found, once.
    """
    if chunk < longest:
        raise ValueError("a chunk must be at least as long as the keys")
    home = F.floor(F.col(pos) / chunk)
    homes = F.when((F.col(pos) % chunk < longest - 1) & (home > 0), F.array(home, home - 1)).otherwise(F.array(home))
    dealt = rows.select(*on, F.col(pos).alias("pos"), F.col(code).cast("long").alias("code"), F.explode(homes).alias("_chunk"))
    packed = dealt.groupBy(*on, "_chunk").agg(F.array_sort(F.collect_list(F.struct("pos", "code"))).alias("_rows"))
    both = packed.select(*on, (F.col("_chunk") * chunk).alias("_from"), F.col("_rows.code").alias("_codes")).join(keys.select(*on, F.col("key").cast("array<bigint>").alias("_key")), on)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(len(batch)):
                start, codes, key = (batch.column(len(on) + k)[row] for k in range(3))
                at = places_of(np.asarray(codes.values), np.asarray(key.values))
                at = at[at < chunk] + start.as_py()
                if len(at):
                    same = pa.array(np.full(len(at), row))
                    yield pa.RecordBatch.from_arrays([*(batch.column(k).take(same) for k in range(len(on))), pa.array(at, pa.int64())], [*on, "at"])

    return both.mapInArrow(run, f"{rows.select(*on).schema.simpleString()[len('struct<') : -1]}, at bigint")


def align_to_log(record: DataFrame, log: DataFrame, on: list[str], log_key: int = LOG_KEY, record_key: int = RECORD_KEY, chunk: int = CHUNK) -> tuple[DataFrame, DataFrame]:
    """(rows, report): every code of a log with the recording's time, by position.

    record: on, pos, time, code; log: on, pos, code and more; pos counts a session's rows from 0. The log's first codes
    are looked for in the recording. If they occur once, rows are paired from there; if nowhere, the recording began late,
    and its own first codes are looked for in the log. Log rows that the recording doesn't cover have a null time.

    report has a row a session of the log: status aligned, late, none (neither key occurs, or the late one not just once),
    many (the log's key occurs more than once) or differ (paired codes are not all equal); offset (position in the
    recording less that in the log), and how many rows are paired, missing and different. rows hold the sessions that are
    aligned or late. Sessions or codes that are null are aligned with nothing.
    """
    sessions = log.select(*on).distinct()
    ahead = occurrences(record, key_of(log, on, log_key), on, log_key, chunk=chunk).groupBy(*on).agg(F.count(F.lit(1)).alias("_n"), F.min("at").alias("_at"))
    found = written(sessions.join(ahead, on, "left").withColumn("_n", F.coalesce("_n", F.lit(0))))
    lost = found.where("_n = 0").select(*on)
    back = occurrences(log.join(lost, on, "left_semi"), key_of(record.join(lost, on, "left_semi"), on, record_key), on, record_key, chunk=chunk)
    back = back.groupBy(*on).agg(F.count(F.lit(1)).alias("_m"), F.min("at").alias("_back"))
    found = found.join(back, on, "left")
    offset = F.when(F.col("_n") == 1, F.col("_at")).when((F.col("_n") == 0) & (F.col("_m") == 1), -F.col("_back"))
    status = F.when(F.col("_n") == 1, "aligned").when(F.col("_n") > 1, "many").when(F.col("_m") == 1, "late").otherwise("none")
    placed = found.select(*on, status.alias("status"), offset.alias("offset"))
    own = record.select(*on, F.col("pos").alias("_pos"), "time", F.col("code").alias("_code"))
    rows = written(log.join(placed.where("offset IS NOT NULL"), on).withColumn("_pos", F.col("pos") + F.col("offset")).join(own, [*on, "_pos"], "left"))
    counts = rows.groupBy(*on).agg(F.count("_code").alias("paired"), (F.count(F.lit(1)) - F.count("_code")).alias("missing"), F.count_if(F.col("_code") != F.col("code")).alias("differing"))
    report = placed.join(counts, on, "left").withColumn("status", F.when(F.col("differing") > 0, "differ").otherwise(F.col("status")))
    good = report.where(F.col("status").isin("aligned", "late")).select(*on)
    return rows.join(good, on, "left_semi").select(*log.columns, "time"), report


def _marked(record: DataFrame, log: DataFrame, on: list[str]) -> DataFrame:
    """(on, st, stop, log_st, log_stop): the rows between a recording's session markers and their counterparts in the log;
    null where the markers give none, or spans of other lengths."""
    code, pos = F.col("code"), F.col("pos")
    ends = F.min(F.when(code == SESSION_END, pos))
    a = record.groupBy(*on).agg(
        F.count(F.lit(1)).alias("n"), F.min_by("code", "pos").alias("first"), F.max_by("code", "pos").alias("final"),
        F.min(F.when(code == SESSION_START, pos)).alias("s0"), ends.alias("e0"), F.count_if(code == SESSION_END).alias("n_ends"),
    )
    later = record.where(code == SESSION_END).join(a.select(*on, "e0"), on).where("pos > e0").groupBy(*on).agg(F.min("pos").alias("e1"))
    a = a.join(later, on, "left")
    none_end, none_start = F.col("e0").isNull(), F.col("s0").isNull()
    in_order, one_end = F.col("e0") > F.col("s0"), F.col("n_ends") == 1
    cut_short, begun_late = one_end & (F.col("e0") < F.col("n") / 2), one_end & (F.col("e0") >= F.col("n") / 2)
    span = lambda st, stop, begin, end: F.struct(st.cast("long").alias("st"), stop.cast("long").alias("stop"), begin.cast("long").alias("begin"), end.cast("long").alias("end"))
    start, stop = F.lit(SESSION_START), F.lit(SESSION_END)
    to_end = span(F.col("s0"), F.col("n") - 1, start, F.col("final"))
    from_first = span(F.lit(0), F.col("e0"), F.col("first"), stop)
    chosen = (
        F.when(none_end, F.when(~none_start, to_end)).when(none_start, from_first).when(in_order, span(F.col("s0"), F.col("e0"), start, stop))
        .when(cut_short, to_end).when(begun_late, from_first).when(F.col("e1") > F.col("s0"), span(F.col("s0"), F.col("e1"), start, stop))
    )
    a = a.withColumn("_s", chosen).select(*on, "_s.*")
    x = log.join(a.select(*on, "begin", "end"), on)
    b = x.groupBy(*on).agg(F.min(F.when(code == F.col("begin"), pos)).alias("log_st"), F.max(F.when(code == F.col("end"), pos)).alias("log_stop"))
    return a.join(b, on).where(F.col("stop") - F.col("st") == F.col("log_stop") - F.col("log_st"))


def align_to_screen(record: DataFrame, log: DataFrame, on: list[str], rate: float, chunk: int = CHUNK) -> tuple[DataFrame, DataFrame]:
    """(rows, report): on, sample, screen_sample, screen_time and code of the rows between a recording's session markers.

    record: on, pos, time (in samples), code; log: on, pos, code, log_time, screen_time (in a unit that rate turns into
    samples). The span goes from the first start marker to the end marker after it, the end left out. A recording that has
    no end marker, or one that only the session before put there, ends before its last row; one without a start marker
    begins with its first row. Where the markers give no span, or one of another length than in the log, the recording is
    first aligned by ``align_to_log``, whose rows, missing times null, then count as the recording.

    report: on, status: markers, log (by way of the log), differ (codes in the span are not all equal) or what
    ``align_to_log`` or the second look for markers could not do (none, many, unmarked). rows hold the first two.
    """
    keep = [*on, "pos", "time", "code"]
    direct = written(_marked(record, log, on))
    sessions = log.select(*on).distinct()
    lost = sessions.join(direct, on, "left_anti")
    again, why = align_to_log(record.join(lost, on, "left_semi"), log.join(lost, on, "left_semi"), on, chunk=chunk)
    again = again.select(keep)
    second = written(_marked(again, log.join(lost, on, "left_semi"), on))
    spans = direct.withColumn("_by", F.lit("markers")).unionByName(second.withColumn("_by", F.lit("log")))
    rows_in = record.select(keep).join(lost, on, "left_anti").unionByName(again)
    own = rows_in.join(spans, on).where("pos >= st AND pos < stop").select(*on, (F.col("pos") - F.col("st") + F.col("log_st")).alias("pos"), "time", "code", "_by")
    pairs = written(own.join(log.select(*on, "pos", F.col("code").alias("_code"), "log_time", "screen_time"), [*on, "pos"]))
    checked = pairs.groupBy(*on).agg(F.count_if(F.col("code") != F.col("_code")).alias("_bad"))
    report = sessions.join(spans.select(*on, "_by"), on, "left").join(checked, on, "left").join(why.select(*on, F.col("status").alias("_why")), on, "left")
    status = F.when(F.col("_bad") > 0, "differ").when(F.col("_by").isNotNull(), F.col("_by")).when(F.col("_why").isin("aligned", "late"), "unmarked").otherwise(F.col("_why"))
    report = report.select(*on, status.alias("status"))
    good = report.where(F.col("status").isin("markers", "log")).select(*on)
    screen: Column = F.col("time") + (F.col("screen_time") - F.col("log_time")) * rate
    return pairs.join(good, on, "left_semi").select(*on, F.col("time").alias("sample"), screen.alias("screen_sample"), "screen_time", "code"), report
