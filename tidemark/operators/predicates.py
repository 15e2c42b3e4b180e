"""Selecting trials, samples and channels (section B)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .quantiles import exact_quantiles, join_groups
from .scans import HOT_ROWS


def select_trials(df: DataFrame, conditions: list[str]) -> DataFrame:
    """Rows for which all of ``Key``, ``~Key``, ``Key=X`` and ``~Key=X`` hold; values compare as strings, a bare key must
    be true; no conditions keep all rows."""

    def one(text: str) -> Column:
        bare = text.removeprefix("~")
        key, eq, value = bare.partition("=")
        hit = F.coalesce(F.col(key).cast("string") == value if eq else F.col(key).cast("boolean"), F.lit(False))
        return ~hit if text.startswith("~") else hit

    return df.where(reduce(lambda a, b: a & b, map(one, conditions))) if conditions else df


def classify_codes(events: DataFrame, ranges: DataFrame, by: list[str], order: list[str], code: str = "code") -> DataFrame:
    """(by, field, value): of each closed code range (lo, hi, field) the last code of a group that falls in it."""
    hit = events.join(F.broadcast(ranges), F.col(code).between(F.col("lo"), F.col("hi")))
    return hit.groupBy(*by, "field").agg(F.max_by(code, F.struct(*order)).alias("value"))


def difficulty(code: Column) -> Column:
    """Easy for 30 and 70, hard for 49 and 51, else unknown."""
    return F.when(code.isin(30, 70), "easy").when(code.isin(49, 51), "hard").otherwise("unknown")


def difficulty_of_set(codes: Column) -> Column:
    """Easy if the distinct codes are exactly 30 and 70, hard if exactly 49 and 51."""
    found = F.array_sort(F.array_distinct(codes))
    return F.when(found == F.array(F.lit(30), F.lit(70)), "easy").when(found == F.array(F.lit(49), F.lit(51)), "hard").otherwise("unknown")


def map_values(c: Column, values: dict) -> Column:
    """A dictionary's value for each key; null for those that it lacks."""
    return F.create_map(*[F.lit(x) for kv in values.items() for x in kv])[c]


def drop_all_missing(sig: DataFrame, trial: str = "trial", channel: str = "channel", value: str = "value") -> DataFrame:
    """Without trials that are missing throughout, and then without channels that are in what is left; trials keep
    their numbers."""
    known = sig.where(F.col(value).isNotNull() & ~F.isnan(value))
    trials = known.select(trial).distinct()
    kept = sig.join(trials, trial, "left_semi")
    channels = known.select(channel).distinct()
    return kept.join(channels, channel, "left_semi")


def mask_bad(sig: DataFrame, trials: DataFrame, channels: DataFrame, value: str = "value") -> DataFrame:
    """Values of listed trials and of listed channels become null; a channel's row may limit it to samples (lo, hi)."""
    t = trials.select(F.col("trial"), F.lit(True).alias("_t")).distinct()
    c = channels.groupBy("channel").agg(F.collect_list(F.struct("lo", "hi")).alias("_c"))
    x = sig.join(t, "trial", "left").join(c, "channel", "left")
    inside = F.exists("_c", lambda r: r["lo"].isNull() | F.col("sample").between(r["lo"], r["hi"]))
    return x.withColumn(value, F.when(F.col("_t").isNull() & ~F.coalesce(inside, F.lit(False)), F.col(value))).drop("_t", "_c")


def crop(sig: DataFrame, low: float, high: float, by: list[str], t: str = "t", require_cover: bool = True) -> DataFrame:
    """Samples within [low, high]; groups that don't reach both ends are dropped when cover is required."""
    if require_cover:
        w = Window.partitionBy(*by)
        sig = sig.withColumn("_a", F.min(t).over(w)).withColumn("_b", F.max(t).over(w)).where((F.col("_a") <= low) & (F.col("_b") >= high)).drop("_a", "_b")
    return sig.where(F.col(t).between(low, high))


def best_window(trials: DataFrame, starts: list[float], ends: list[float], alpha: float, start: str = "start", end: str = "end") -> DataFrame:
    """The window (a, b) that maximises valid + 100 * alpha * (b - a), the first of equals; valid trials span it.

    The grid is a literal of the plan; trials are aggregated for all of its windows in one pass.
    """
    grid = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a in starts for b in ends if a < b])
    spans = trials.groupBy(start, end).agg(F.count(F.lit(1)).alias("_n"))
    x = spans.select(start, end, "_n", F.explode(grid).alias("g"))
    ok = (F.col(start) <= F.col("g.a")) & (F.col(end) >= F.col("g.b"))
    scored = x.groupBy("g.a", "g.b").agg(F.sum(F.when(ok, F.col("_n")).otherwise(F.lit(0))).alias("valid"), F.sum("_n").alias("total"))
    scored = scored.withColumn("score", F.col("valid") + 100 * alpha * (F.col("b") - F.col("a")))
    return scored.orderBy(F.col("score").desc(), "a", "b").limit(1)


def crop_around(sig: DataFrame, anchors: DataFrame, by: list[str], pre: float, post: float, fs: float, least: int = 10) -> DataFrame:
    """Samples within [anchor - pre, anchor + post], at most round((pre + post) * fs) of them from the first on; groups
    with fewer than that or than least samples are dropped; t_zeroed is time from the anchor."""
    n = max(least, round((pre + post) * fs))
    x = sig.join(anchors, by).where(F.col("t").between(F.col("anchor") - pre, F.col("anchor") + post))
    group = Window.partitionBy(*by, "channel")
    x = x.withColumn("_k", F.row_number().over(group.orderBy("sample"))).withColumn("_n", F.count(F.lit(1)).over(group))
    return x.where((F.col("_n") >= n) & (F.col("_k") <= n)).withColumn("t_zeroed", F.col("t") - F.col("anchor")).drop("_k", "_n")


def trial_outcome(correct: Column, wrong: Column, miss: Column, leaves: Column) -> Column:
    """Correct before wrong before miss before other; with _end for trials that leave a block, but plain other if such
    a trial has no outcome."""
    base = F.when(correct, "correct").when(wrong, "wrong").when(miss, "miss").otherwise("other")
    return F.when(leaves & (base != "other"), F.concat(base, F.lit("_end"))).otherwise(base)


def likelihood_box(pose: DataFrame, x: str, y: str, likelihood: str, by: list[str], least: float = 0.9, buffer: float = 0.2, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Box between the smallest and largest medians of confident coordinates of each part, grown by a share of its
    size and not below zero."""
    sure = F.col(likelihood) > least
    median = lambda c, name: exact_quantiles(pose.select(*by, "part", F.when(sure, F.col(c)).alias("_m")), [*by, "part"], "_m", {name: 0.5}, hot_rows)
    parts = join_groups(median(x, "mx"), median(y, "my"), [*by, "part"])
    box = parts.groupBy(*by).agg(F.min("mx").alias("x0"), F.max("mx").alias("x1"), F.min("my").alias("y0"), F.max("my").alias("y1"))
    dx, dy = (F.col("x1") - F.col("x0")) * buffer, (F.col("y1") - F.col("y0")) * buffer
    zero = F.lit(0.0)
    return box.select(*by, F.greatest(zero, F.col("x0") - dx).alias("x0"), (F.col("x1") + dx).alias("x1"), F.greatest(zero, F.col("y0") - dy).alias("y0"), (F.col("y1") + dy).alias("y1"))
