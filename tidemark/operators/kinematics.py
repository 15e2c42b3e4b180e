"""Decisions and reactions read from paths (sections E11, E12 and E18)."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .quantiles import exact_quantiles
from .windows import sliding_fit, smooth


def decision_point(df: DataFrame, by: list[str], pos: str, cues: dict[str, Column], reach: int, width: float, least: int = 30) -> DataFrame:
    """The sample of highest score of each trial: every cue spreads a bump around its samples (overlapping bumps of one
    cue count with their maximum), cues add up, later samples weigh less and the first 5 % are out. Trials of at most
    least samples have none; of equal scores the first sample."""
    w = Window.partitionBy(*by)
    x = df.withColumn("_n", F.count(F.lit(1)).over(w)).where(F.col("_n") > least)
    kernel = F.array(*[F.struct(F.lit(k).alias("k"), F.lit(math.exp(-k * k / width)).alias("h")) for k in range(-reach, reach + 1)])
    marks = F.array_compact(F.array(*[F.when(c > 0, F.struct(F.lit(n).alias("cue"), c.cast("double").alias("s"))) for n, c in cues.items()]))
    bumps = x.select(*by, pos, "_n", F.explode(marks).alias("m")).select(*by, pos, "_n", "m", F.explode(kernel).alias("b"))
    bumps = bumps.withColumn(pos, F.col(pos) + F.col("b.k")).where((F.col(pos) >= 0) & (F.col(pos) < F.col("_n")))
    each = bumps.groupBy(*by, pos, "_n", F.col("m.cue").alias("cue")).agg(F.max(F.col("m.s") * F.col("b.h")).alias("s"))
    total = each.groupBy(*by, pos, "_n").agg(F.sum("s").alias("s"))
    place = F.col(pos) / F.col("_n")
    scored = total.withColumn("score", F.when(place < 0.05, F.col("s") - 50).otherwise(F.col("s") * (1 - place)))
    return scored.groupBy(*by).agg(F.max_by(pos, F.struct(F.round("score", 9), -F.col(pos))).alias("decision"), F.max("score").alias("score"))


def reaction_time(df: DataFrame, by: list[str], pos: str, value: str, windows: list[int], least: float = 0.001, share: float = 0.05, taps: list[float] | None = None) -> DataFrame:
    """The sample at which a path departs most from straight lines: over several window lengths the sum of 1 - R
    squared, weighted by what is left of the trial, and its first maximum; null if that is below least or below the
    given percentile of all trials' maxima. With taps the path is smoothed first."""
    x = df.select(*by, pos, value)
    if taps:
        x = smooth(x, by, [pos], value, taps, None)  # trials
    for k in windows:
        x = sliding_fit(x, k, by, [pos], value, hot_rows=None).withColumnRenamed("r2", f"_r{k}").drop("slope")
    w = Window.partitionBy(*by)
    left = 1 - F.col(pos) / F.count(F.lit(1)).over(w)
    x = x.withColumn("_s", F.round(sum((1 - F.col(f"_r{k}") for k in windows), F.lit(0.0)) * left, 6))
    best = x.groupBy(*by).agg(F.max("_s").alias("score"), F.max_by(pos, F.struct("_s", -F.col(pos))).alias("_at"))
    low = exact_quantiles(best, [], "score", {"_low": share})
    got = best.crossJoin(F.broadcast(low))  # one row
    return got.select(*by, "score", F.when((F.col("score") >= least) & (F.col("score") >= F.col("_low")), F.col("_at")).alias("reaction"))


def median_subsample(left: DataFrame, right: DataFrame, on: list[str], left_time: str, right_time: str, value: str, gap: int) -> DataFrame:
    """Median of the right values within half a gap of each left time. Times are put into buckets of one gap, so that a
    row meets only its own bucket and the next ones to either side."""
    half = gap / 2
    a = left.withColumn("_b", F.explode(F.array(*[F.floor(F.col(left_time) / gap) + k for k in (-1, 0, 1)])))
    b = right.select(*on, F.col(right_time).alias("_rt"), F.col(value).alias("_rv"), F.floor(F.col(right_time) / gap).alias("_b"))
    hit = a.join(b, [*on, "_b"]).where(F.abs(F.col(left_time) - F.col("_rt")) <= half)
    return hit.groupBy(*left.columns).agg(F.median("_rv").alias("median"), F.count(F.lit(1)).alias("n"))
