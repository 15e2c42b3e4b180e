"""Interval, as-of, nearest and sequence joins (section C).

As-of joins put both sides into one ordered sequence and carry values along it, so that they shuffle each side once on
its keys and never compare pairs; interval joins build on them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .scans import HOT_ROWS, Scan, scan


def attach_state(trials: DataFrame, states: DataFrame, shift: int = 1000, trial: str = "trial_code") -> DataFrame:
    """Trials with their state, joined on the trial number that is left of a code less its base."""
    return trials.withColumn("trial", F.col(trial) - shift).join(states, ["session", "trial"])


def _in_sequence(left: DataFrame, right: DataFrame, on: list[str], left_time: str, right_time: str, values: list[str], forward: bool) -> tuple[DataFrame, DataFrame, list[str]]:
    """Both sides as rows of one sequence (_left or _right is null), and its order: right rows stand before equal left
    rows looking back, and after them looking ahead; equal right rows follow by their values."""
    side = F.lit(1 if forward else 0)
    kept = [c for c in left.columns if c not in on]
    ranks = [f"_rank{k}" for k in range(len(values))]
    found = F.struct(right_time, *values)
    a = left.select(*on, F.col(left_time).alias("_t"), (1 - side).alias("_side"), *[F.lit(None).cast(right.schema[v].dataType).alias(r) for v, r in zip(values, ranks)], F.struct(*kept).alias("_left"), F.lit(None).cast(right.select(found).schema[0].dataType).alias("_right"))
    known = right.where(F.col(right_time).isNotNull())
    b = known.select(*on, F.col(right_time).alias("_t"), side.alias("_side"), *[F.col(v).alias(r) for v, r in zip(values, ranks)], F.lit(None).cast(a.schema["_left"].dataType).alias("_left"), found.alias("_right"))
    return a, b, ["_t", "_side", *ranks]


def _asof(left: DataFrame, right: DataFrame, on: list[str], left_time: str, right_time: str, values: list[str], forward: bool, hot_rows: int = HOT_ROWS) -> DataFrame:
    a, b, order = _in_sequence(left, right, on, left_time, right_time, values, forward)
    x = Scan(a.unionByName(b), on, order, hot_rows).carry(_found=("next" if forward else "last", F.col("_right"))).done().where("_left IS NOT NULL")
    return x.select(*on, "_left.*", F.col(f"_found.{right_time}").alias(f"{right_time}_found"), *[F.col(f"_found.{v}").alias(f"{v}_found") for v in values])


def asof_backward(left: DataFrame, right: DataFrame, on: list[str], left_time: str, right_time: str, values: list[str], or_first: bool = False, hot_rows: int = HOT_ROWS) -> DataFrame:
    """left with the time and values of the last right row at or before each row's time (of equal times the greatest by
    value), in columns ending in _found. Before the first right row these are null, or the first row's if or_first."""
    x = _asof(left, right, on, left_time, right_time, values, False, hot_rows)
    if not or_first:
        return x
    names = [right_time, *values]
    known = right.where(F.col(right_time).isNotNull())
    first = known.groupBy(*on).agg(F.min_by(F.struct(*names), F.struct(*names)).alias("_first"))
    x = x.join(first, on, "left") if on else x.crossJoin(F.broadcast(first))  # one row
    none = F.col(f"{right_time}_found").isNull() & F.col(left_time).isNotNull()
    return x.withColumns({f"{v}_found": F.when(none, F.col(f"_first.{v}")).otherwise(F.col(f"{v}_found")) for v in names}).drop("_first")


def asof_forward(left: DataFrame, right: DataFrame, on: list[str], left_time: str, right_time: str, values: list[str], hot_rows: int = HOT_ROWS) -> DataFrame:
    """left with the first right row at or after each row's time (of equal times the least by value)."""
    return _asof(left, right, on, left_time, right_time, values, True, hot_rows)


def nearest(left: DataFrame, right: DataFrame, on: list[str], left_time: str, right_time: str, value: str, tolerance: float | None = None, hot_rows: int = HOT_ROWS) -> DataFrame:
    """left with the right row of least time difference, the earlier of equals; beyond the tolerance nothing is found."""
    a, b, order = _in_sequence(left, right, on, left_time, right_time, [value], False)
    # a right row of equal time stands before the left one: looking back finds it, with a difference of none
    both = Scan(a.unionByName(b), on, order, hot_rows).carry(_b=("last", F.col("_right")), _f=("next", F.col("_right"))).done().where("_left IS NOT NULL")
    both = both.select(*on, "_left.*", *[F.col(f"_{side}.{c}").alias(f"_{side}{k}") for side in "bf" for c, k in ((right_time, "t"), (value, "v"))])
    db, df = F.col(left_time) - F.col("_bt"), F.col("_ft") - F.col(left_time)
    early = F.col("_ft").isNull() | (F.col("_bt").isNotNull() & (db <= df))
    gap = F.when(early, db).otherwise(df)
    ok = gap <= tolerance if tolerance is not None else F.lit(True)
    found = F.when(early, F.col("_bv")).otherwise(F.col("_fv"))
    return both.withColumn("gap", F.when(ok, gap)).withColumn("nearest", F.when(ok, found)).drop("_bt", "_bv", "_ft", "_fv")


def span_join(rows: DataFrame, spans: DataFrame, at: str, low: str, high: str, on: list[str] = ()) -> DataFrame:
    """rows with the spans that hold their place, low and high included (whole numbers).

    The line is cut into buckets of a span's mean length; a span goes to each bucket it touches and a row to its own,
    so the join is one of equal buckets. Buckets over all spans are at most their number and the line's length over
    the mean.
    """
    width = spans.agg(F.floor(F.avg(F.col(high) - F.col(low) + 1)).cast("long")).first()[0] or 1
    width = max(1, width)
    b = lambda c: F.floor(F.col(c) / width).cast("long")
    cut = spans.where(F.col(low) <= F.col(high)).withColumn("_bucket", F.explode(F.sequence(b(low), b(high))))
    return rows.withColumn("_bucket", b(at)).join(cut, [*on, "_bucket"]).where(F.col(at).between(F.col(low), F.col(high))).drop("_bucket")


def interval_join(events: DataFrame, trials: DataFrame, on: list[str], time: str, start: str, end: str, trial: str) -> DataFrame:
    """events with the trial that last started at or before them, if it has not ended by then, else -1."""
    found = asof_backward(events, trials, on, time, start, [trial, end])
    inside = F.col(time) <= F.col(f"{end}_found")
    return found.withColumn("in_trial", F.when(inside, F.col(f"{trial}_found")).otherwise(F.lit(-1))).drop(f"{start}_found", f"{trial}_found", f"{end}_found")


def first_in_window(trials: DataFrame, events: DataFrame, on: list[str], start: str, end: str, time: str, code: str, longest: float) -> DataFrame:
    """Of each trial the first event within [start, end] (start + longest if the end is missing): its code and latency,
    and how many there are. Windows may overlap: an event counts in each that holds it."""
    spans = trials.withColumn("_end", F.coalesce(F.col(end), F.col(start) + longest))
    windows = spans.select(*on, F.col(start).alias("_start"), "_end").distinct()
    joined = span_join(events, windows, time, "_start", "_end", on)
    per = joined.groupBy(*on, F.col("_start").alias(start), "_end").agg(F.min_by(code, F.struct(time, code)).alias("first_code"), F.min(time).alias("_first"), F.count(F.lit(1)).alias("hits"))
    return spans.join(per, [*on, start, "_end"], "left").withColumn("latency", F.col("_first") - F.col(start)).withColumn("hits", F.coalesce("hits", F.lit(0))).drop("_first", "_end")


def align_sequences(a: DataFrame, b: DataFrame, pos: str, code: str, key: int, chunk: int = 1 << 16) -> DataFrame:
    """(offset, matches): the places in a where b's first key codes occur, as differences of positions, and how many
    places there are: an alignment is certain if that is one; no row means that b lies nowhere in a.

    pos numbers rows without gaps. Rows are dealt to chunks of positions; the first rows of a chunk also go to the one
    before it, so that sequences cross its end.
    """
    home = F.floor(F.col(pos) / chunk)
    homes = F.when(F.col(pos) % chunk < key - 1, F.array(home, home - 1)).otherwise(F.array(home))
    dealt = a.select(pos, code, F.explode(homes).alias("_chunk"))
    w = Window.partitionBy("_chunk").orderBy(pos).rowsBetween(0, key - 1)
    grams = dealt.select(F.col(pos).alias("pa"), "_chunk", F.collect_list(code).over(w).alias("gram")).where(F.floor(F.col("pa") / chunk) == F.col("_chunk"))
    low = b.agg(F.min(pos).alias("_low"))
    head = b.join(F.broadcast(low), F.col(pos) < F.col("_low") + key)  # one row
    head = head.agg(F.array_sort(F.collect_list(F.struct(pos, code))).alias("h")).select(F.col("h").getField(code).alias("gram"), F.col("h")[0][pos].alias("pb"))
    found = grams.join(F.broadcast(head), "gram").where(F.size("gram") == key).select((F.col("pa") - F.col("pb")).alias("offset"))  # one row
    return found.crossJoin(F.broadcast(found.agg(F.count(F.lit(1)).alias("matches"))))


def segment(events: DataFrame, on: list[str], order: list[str], time: str, code: str, start: Column, trigger: Column, stop: Column, hot_rows: int = HOT_ROWS) -> DataFrame:
    """(on, start, trigger, stop, offset) of trials: a start whose next stop precedes the next start, with the last
    trigger between them; offset is start less trigger."""
    kind = F.when(start, "a").when(stop, "z").when(trigger, "t")
    marks = events.withColumn("_k", kind).where("_k IS NOT NULL")
    marks = scan(marks, on, order, hot_rows, _g=("upto", (F.col("_k") == "a").cast("int"))).where("_g > 0")
    per = marks.groupBy(*on, "_g").agg(
        F.min(F.when(F.col("_k") == "a", F.col(time))).alias("start"),
        F.min(F.when(F.col("_k") == "z", F.struct(*order))).alias("_z"),
        F.array_sort(F.collect_list(F.when(F.col("_k") == "t", F.struct(*order, F.col(time).alias("_time"))))).alias("_ts"),
        F.min(F.when(F.col("_k") == "z", F.col(time))).alias("stop"),
    ).where("_z IS NOT NULL")
    before = F.filter("_ts", lambda x: F.struct(*[x[o] for o in order]) < F.struct(*[F.col(f"_z.{o}") for o in order]))
    per = per.withColumn("trigger", F.try_element_at(before, F.lit(-1))["_time"])
    return per.select(*on, "start", "trigger", "stop", (F.col("start") - F.col("trigger")).alias("offset"))


def pairs(df: DataFrame, key: str) -> DataFrame:
    """All unordered pairs of the distinct values of a small label column."""
    x = df.select(key).distinct()
    return x.select(F.col(key).alias("first")).join(x.select(F.col(key).alias("second")), F.col("first") < F.col("second"))


def neighbour_join(trials: DataFrame, on: list[str], trial: str, k: int, values: list[str]) -> DataFrame:
    """Trials with values of the trial whose number is k higher, in columns ending in _next; inner join."""
    other = trials.select(*on, (F.col(trial) - k).alias(trial), *[F.col(v).alias(f"{v}_next") for v in values])
    return trials.join(other, [*on, trial])


def event_window(df: DataFrame, anchors: DataFrame, on: list[str], pos: str, before: int, after: int) -> DataFrame:
    """df's rows around each anchor position, with their offset from it; places that don't exist are left out."""
    x = anchors.select(*on, F.col(pos).alias("anchor"), F.explode(F.sequence(F.lit(-before), F.lit(after))).alias("offset"))
    return x.withColumn(pos, F.col("anchor") + F.col("offset")).join(df, [*on, pos])


def clock_offset(a: DataFrame, b: DataFrame, on: list[str], time: str, marker: Column) -> DataFrame:
    """First marker in a less the first in b, by session."""
    x = a.where(marker).groupBy(*on).agg(F.min(time).alias("_a"))
    y = b.where(marker).groupBy(*on).agg(F.min(time).alias("_b"))
    return x.join(y, on).select(*on, (F.col("_a") - F.col("_b")).alias("clock_offset"))


def common_points(df: DataFrame, group: str, point: str) -> DataFrame:
    """Rows at the points that every group has."""
    groups = df.agg(F.count_distinct(group).alias("_all"))
    have = df.groupBy(point).agg(F.count_distinct(group).alias("_n")).join(groups, F.col("_n") == F.col("_all"))
    return df.join(have, point, "left_semi")


def keep_groups_with_any(df: DataFrame, group: str, member: Column) -> DataFrame:
    """All rows of the groups that have at least one row for which member holds."""
    return df.join(df.where(member).select(group).distinct(), group, "left_semi")
