"""Group-wise summaries of states, trials, signals and points (section D)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..staging import numbered
from .quantiles import exact_quantiles, join_groups
from .scans import HOT_ROWS, Scan, scan


def state_summary(df: DataFrame, value: str = "value", by: str = "state", **rates: Column) -> DataFrame:
    """Mean, sample deviation and non-null count of a value, and the rate of each named condition, by state."""
    return df.groupBy(by).agg(
        F.avg(value).alias("mean"), F.stddev_samp(value).alias("sd"), F.count(value).alias("n"), *[F.avg(c.cast("double")).alias(k) for k, c in rates.items()]
    )


def run_lengths(df: DataFrame, session: str = "session", pos: str = "pos", state: str = "state", hot_rows: int = HOT_ROWS) -> DataFrame:
    """(session, start, state, length) of each run of equal states; nulls are equal to each other. The last row before a
    change of state gives its run's length, so runs are never grouped."""
    x = Scan(df.select(session, pos, state), [session], [pos], hot_rows).carry(_before=("lag", F.struct(state)), _rows=("before", F.lit(1).cast("long")))
    new = F.col("_before").isNull() | ~F.col(f"_before.{state}").eqNullSafe(F.col(state))
    starts = x.where(new).carry(_next=("lead", F.col("_rows"))).done()
    total = df.groupBy(F.col(session).alias("_s")).agg(F.count(F.lit(1)).alias("_n"))
    got = starts.where("_next IS NOT NULL").withColumn("length", F.col("_next") - F.col("_rows"))
    last = starts.where("_next IS NULL").join(total, F.col(session).eqNullSafe(F.col("_s"))).withColumn("length", F.col("_n") - F.col("_rows"))
    columns = [session, F.col(pos).alias("start"), state, "length"]
    return got.select(*columns).unionByName(last.select(*columns))


def transition_matrix(df: DataFrame, session: str = "session", pos: str = "pos", state: str = "state", pooled: bool = False, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Counts and row shares of (state, next state); pooled runs all sessions together, in session order, and then also
    counts the step from one session to the next."""
    pairs = scan(df.select(session, pos, state), [session], [pos], hot_rows, b=("lead", F.col(state))).select(F.col(state).alias("a"), "b").where("b IS NOT NULL")
    if pooled:  # the step over a session's end needs only its last and first state
        ends = numbered(df.groupBy(session).agg(F.min_by(state, pos).alias("first"), F.max_by(state, pos).alias("last")), [session], "_k")
        after = ends.select((F.col("_k") - 1).alias("_k"), F.col("first").alias("b"))
        pairs = pairs.unionByName(ends.join(after, "_k").select(F.col("last").alias("a"), "b").where("b IS NOT NULL"))
    counts = pairs.groupBy("a", "b").agg(F.count(F.lit(1)).alias("n"))
    return counts.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy("a")))


def shares(df: DataFrame, by: str) -> DataFrame:
    """Count and share of each value."""
    counts = df.groupBy(by).agg(F.count(F.lit(1)).alias("n"))
    return counts.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy(F.lit(1))))


def rates(df: DataFrame, by: list[str], **conditions: Column) -> DataFrame:
    """Rows and the rate of each named condition, by group; a condition that is null doesn't count."""
    return df.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), *[F.avg(c.cast("double")).alias(k) for k, c in conditions.items()])


def histogram(df: DataFrame, value: str, low: float, high: float, bins: int, density: bool = False) -> DataFrame:
    """Counts in equal-width bins; the last one includes its right edge and values outside are left out."""
    width = (high - low) / bins
    at = F.least(F.floor((F.col(value) - low) / width), F.lit(bins - 1)).cast("int")
    counts = df.where(F.col(value).between(low, high)).groupBy(at.alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    counts = counts.withColumn("left_edge", low + F.col("bin") * width)
    if density:
        counts = counts.withColumn("density", F.col("n") / (F.sum("n").over(Window.partitionBy(F.lit(1))) * width))
    return counts


def length_profile(df: DataFrame, value: str, by: str, width: float, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Mean, median, 10th, 15th and 20th percentile (interpolated), most frequent bin, and rows at or above the 10th."""
    q = join_groups(df.groupBy(by).agg(F.avg(value).alias("mean")), exact_quantiles(df, [by], value, {"median": 0.5, "p10": 0.1, "p15": 0.15, "p20": 0.2}, hot_rows), [by])
    bins = df.groupBy(by, F.floor(F.col(value) / width).alias("bin")).agg(F.count(F.lit(1)).alias("k"))
    mode = bins.groupBy(by).agg(F.max_by("bin", F.struct("k", -F.col("bin"))).alias("modal_bin"))
    over = df.join(q.select(by, "p10"), by).where(F.col(value) >= F.col("p10")).groupBy(by).agg(F.count(F.lit(1)).alias("over_p10"))
    return q.join(mode, by).join(over, by)


def evoked_average(sig: DataFrame, by: list[str], value: str = "value") -> DataFrame:
    """Mean over trials with its standard error (population deviation over root n) and the population variance."""
    return sig.groupBy(*by).agg(F.avg(value).alias("mean"), (F.stddev_pop(value) / F.sqrt(F.count(value))).alias("sem"), F.var_pop(value).alias("variance"), F.count(value).alias("n"))


def grand_average(sig: DataFrame, value: str = "value") -> DataFrame:
    """Mean over trials, then over an array's channels, then mean and standard error over sessions."""
    trials = sig.groupBy("state", "session", "array_id", "channel", "sample").agg(F.avg(value).alias("v"))
    arrays = trials.groupBy("state", "session", "array_id", "sample").agg(F.avg("v").alias("v"))
    return arrays.groupBy("state", "array_id", "sample").agg(F.avg("v").alias("mean"), (F.stddev_pop("v") / F.sqrt(F.count("v"))).alias("sem"))


def evoked_by_condition(sig: DataFrame, conditions: list[str], keep: list[str], value: str = "value") -> DataFrame:
    """Averages for each value of each condition in one pass; the column condition names which one a row is of."""
    stacked = sig.withColumn("_c", F.explode(F.array(*[F.struct(F.lit(c).alias("condition"), F.col(c).cast("string").alias("level")) for c in conditions])))
    return stacked.groupBy("_c.condition", "_c.level", *keep).agg(F.avg(value).alias("mean"), F.count(value).alias("n"))


def multi_membership(probs: DataFrame, key: str, values: str, threshold: float = 0.25) -> DataFrame:
    """(key, state, p): a row joins every state of which its share exceeds the threshold."""
    return probs.select(key, F.posexplode(values).alias("state", "p")).where(F.col("p") > threshold)


def membership_overlap(members: DataFrame, key: str) -> DataFrame:
    """Rows shared by each pair of states."""
    a, b = members.alias("a"), members.alias("b")
    return a.join(b, (F.col(f"a.{key}") == F.col(f"b.{key}")) & (F.col("a.state") < F.col("b.state"))).groupBy(F.col("a.state").alias("s1"), F.col("b.state").alias("s2")).agg(F.count(F.lit(1)).alias("n"))


def probability_bins(probs: DataFrame, p: str, width: float, by: str, least: int = 5) -> DataFrame:
    """Half-open bins [lo, hi) of a probability, so that 1 falls in none; bins of fewer rows are left out."""
    return probs.where(F.col(p) < 1).groupBy(by, F.floor(F.col(p) / width).alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.avg(p).alias("mean_p")).where(F.col("n") >= least)


def weighted_mean(df: DataFrame, value: str, weight: str, by: list[str], skip_missing: bool = False, least_n: float = 0.0) -> DataFrame:
    """Weighted mean and effective number (sum of w squared over sum of w*w); missing values count as 0 with their
    weight, or are skipped altogether."""
    w = F.when(F.col(value).isNotNull(), F.col(weight)) if skip_missing else F.col(weight)
    got = df.groupBy(*by).agg((F.sum(F.coalesce(F.col(value) * w, F.lit(0.0))) / F.sum(w)).alias("mean"), (F.sum(w) * F.sum(w) / F.sum(w * w)).alias("effective_n"))
    return got.where(F.col("effective_n") >= least_n)


def channel_groups(channels: DataFrame, channel: str = "channel", groups: int = 6) -> DataFrame:
    """Contiguous, nearly equal groups of channels; the first ones take the remainder."""
    return channels.select(channel).distinct().withColumn("group_id", F.ntile(groups).over(Window.orderBy(channel)))


def majority_vote(df: DataFrame, by: list[str], choice: str, order: list[str]) -> DataFrame:
    """The most frequent of the given choices in each group; of equals the one listed first."""
    votes = F.array(*[F.count_if(F.col(choice) == c) for c in order])
    return df.groupBy(*by).agg(votes.alias("votes")).select(*by, F.element_at(F.array(*map(F.lit, order)), F.array_position("votes", F.array_max("votes")).cast("int")).alias("winner"), F.array_max("votes").alias("n_votes"))


def inside_share(df: DataFrame, by: list[str], inside: Column, windows: dict[str, Column]) -> DataFrame:
    """Percentage of points inside, overall and within each named window, in one scan."""
    hit = inside.cast("double")
    return df.groupBy(*by).agg((100 * F.avg(hit)).alias("overall"), *[(100 * F.avg(F.when(w, hit))).alias(n) for n, w in windows.items()])


def band_significance(spectrum: DataFrame, bands: dict[str, tuple[float, float]], by: list[str], freq: str = "freq", sig: str = "sig") -> DataFrame:
    """Percentage of significant frequencies in each band, both edges included; a shared edge counts in both bands."""
    named = F.filter(F.array(*[F.when(F.col(freq).between(a, b), F.lit(n)) for n, (a, b) in bands.items()]), lambda x: x.isNotNull())
    return spectrum.withColumn("band", F.explode(named)).groupBy(*by, "band").agg((100 * F.avg(F.col(sig).cast("double"))).alias("percent"))


def psth(spikes: DataFrame, by: list[str], t: str, low: float, high: float, bins: int) -> DataFrame:
    """Counts in every bin of every group, zero where there are none; the last bin includes its right edge."""
    counts = histogram_by(spikes, by, t, low, high, bins)
    grid = spikes.select(*by).distinct().select(*by, F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin"))
    return grid.join(counts, [*by, "bin"], "left").select(*by, "bin", F.coalesce("n", F.lit(0)).alias("n"))


def histogram_by(df: DataFrame, by: list[str], value: str, low: float, high: float, bins: int) -> DataFrame:
    at = F.least(F.floor((F.col(value) - low) * (bins / (high - low))), F.lit(bins - 1)).cast("int")
    return df.where(F.col(value).between(low, high)).groupBy(*by, at.alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def mark_bursts(spikes: DataFrame, by: list[str], order: list[str], t: str, n: int, dt: float) -> DataFrame:
    """Rows with burst true where n or more points lie within dt: each window of n neighbours that spans at most dt
    marks all of them."""
    over = Window.partitionBy(*by).orderBy(*order)
    starts = (F.lead(t, n - 1).over(over) - F.col(t)) <= dt
    marked = spikes.withColumn("_s", F.coalesce(starts, F.lit(False)).cast("int"))
    return marked.withColumn("burst", F.max("_s").over(over.rowsBetween(-(n - 1), 0)) == 1).drop("_s")


def best_of(df: DataFrame, by: list[str], score: str, order: list[str]) -> DataFrame:
    """The row of highest score in each group; of equals the first in the given order."""
    rank = F.row_number().over(Window.partitionBy(*by).orderBy(F.col(score).desc(), *order))
    return df.withColumn("_r", rank).where("_r = 1").drop("_r")


def common_median_reference(sig: DataFrame, by: list[str], value: str = "value") -> DataFrame:
    """Each value less the median of its group (the channels of one sample)."""
    return sig.withColumn("referenced", F.col(value) - F.median(value).over(Window.partitionBy(*by)))


def block_id(df: DataFrame, session: str = "session", pos: str = "pos", is_exit: str = "is_exit", hot_rows: int = HOT_ROWS) -> DataFrame:
    """df with block: the number of exits before each row; an exit ends its own block."""
    return scan(df, [session], [pos], hot_rows, block=("before", F.col(is_exit).cast("long")))


def block_table(df: DataFrame, session: str = "session", pos: str = "pos", state: str = "state") -> DataFrame:
    """Of each block: rows in order, how many, and the distinct states joined in order."""
    return block_id(df, session, pos).groupBy(session, "block").agg(
        F.count(F.lit(1)).alias("n"), F.min(pos).alias("first_pos"), F.concat_ws(",", F.array_sort(F.collect_set(state))).alias("states"), F.max("is_exit").alias("closed")
    )


def energy(sig: DataFrame, by: list[str], value: str = "value") -> DataFrame:
    """Root of the summed squared deviations from the mean."""
    return sig.groupBy(*by).agg(F.sqrt(F.var_pop(value) * F.count(value)).alias("energy"))


def contingency(df: DataFrame, a: str, b: str) -> DataFrame:
    """Observed and expected counts and each cell's share of chi squared; missing cells count as zero."""
    cells = df.groupBy(a, b).agg(F.count(F.lit(1)).alias("n"))
    grid = cells.select(a).distinct().crossJoin(cells.select(b).distinct())  # as many as distinct values of two labels
    full = grid.join(cells, [a, b], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    every = Window.partitionBy(F.lit(1))
    expected = F.sum("n").over(Window.partitionBy(a)) * F.sum("n").over(Window.partitionBy(b)) / F.sum("n").over(every)
    return full.withColumn("expected", expected).withColumn("chi2", F.pow(F.col("n") - F.col("expected"), 2) / F.col("expected"))


def quantile_summary(df: DataFrame, value: str, by: list[str], shares: dict[str, float], hot_rows: int = HOT_ROWS) -> DataFrame:
    """Mean, population deviation and named quantiles of each group, these interpolated."""
    got = df.groupBy(*by).agg(F.avg(value).alias("mean"), F.stddev_pop(value).alias("sd"))
    return join_groups(got, exact_quantiles(df, by, value, shares, hot_rows), by)


def circular_summary(df: DataFrame, angle: str, by: list[str]) -> DataFrame:
    """Circular mean and deviation of angles in radians, with the resultant length."""
    s, c = F.avg(F.sin(angle)), F.avg(F.cos(angle))
    got = df.groupBy(*by).agg(s.alias("_s"), c.alias("_c"))
    length = F.sqrt(F.col("_s") * F.col("_s") + F.col("_c") * F.col("_c"))
    return got.select(*by, F.atan2("_s", "_c").alias("mean_angle"), length.alias("resultant"), F.sqrt(-2 * F.log(length)).alias("sd_angle"))
