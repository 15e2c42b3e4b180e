"""Positions, moving statistics and gaps within ordered sequences (section E)."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .aggregates import block_id
from .kernels import apply_kernel
from .scans import HOT_ROWS, Scan, chunked, scan


def normalized_position(df: DataFrame, bins: int = 10, session: str = "session", pos: str = "pos") -> DataFrame:
    """df with block, place in it from 0 to below 1 and its bin; blocks of one row are left out."""
    x = block_id(df, session, pos)
    own = Window.partitionBy(session, "block")
    x = x.withColumn("_k", F.row_number().over(own.orderBy(pos)) - 1).withColumn("block_len", F.count(F.lit(1)).over(own)).where("block_len >= 2")
    return x.withColumn("place", F.col("_k") / F.col("block_len")).withColumn("bin", F.least(F.floor(F.col("place") * bins), F.lit(bins - 1)).cast("int")).drop("_k")


def first_last(df: DataFrame, percent: float = 10, session: str = "session", pos: str = "pos") -> DataFrame:
    """Rows of a block's first (after an exit) and last (up to an exit) percent of rows, at least one; the rows before
    the first exit have no first part, and those after the last exit no last part."""
    x = block_id(df, session, pos)
    own = Window.partitionBy(session, "block")
    x = x.withColumn("_n", F.count(F.lit(1)).over(own)).withColumn("_k", F.row_number().over(own.orderBy(pos))).withColumn("_closed", F.max("is_exit").over(own))
    few = F.greatest(F.lit(1), F.ceil(F.col("_n") * percent / 100))
    part = F.array_compact(F.array(F.when((F.col("_k") <= few) & (F.col("block") > 0), F.lit("post")), F.when((F.col("_k") > F.col("_n") - few) & F.col("_closed"), F.lit("pre"))))
    return x.withColumn("part", F.explode(part)).drop("_n", "_k", "_closed")


def early_late(df: DataFrame, k: int, by: list[str], order: list[str]) -> DataFrame:
    """Rows of the first and the last of k contiguous splits."""
    x = df.withColumn("_s", F.ntile(k).over(Window.partitionBy(*by).orderBy(*order))).where(F.col("_s").isin(1, k))
    return x.withColumn("split", F.when(F.col("_s") == 1, "early").otherwise("late")).drop("_s")


def _framed(df: DataFrame, by: list[str], order: list[str], before: int, after: int, hot_rows: int | None, work) -> DataFrame:
    """work(rows, window) over groups, or over their chunks with what the frame reaches of the others; hot_rows None means
    groups that are known to be short, such as trials."""
    if hot_rows is None:
        return work(df, Window.partitionBy(*by).orderBy(*order))
    x = work(chunked(df, by, order, before, after, hot_rows), Window.partitionBy(*by, "_chunk").orderBy(*order))
    return x.where("_own").drop("_pos", "_chunk", "_own")


def moving_average(df: DataFrame, n: int, by: list[str], order: list[str], value: Column, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Mean of the last n rows, from the n-th on."""
    mean = lambda x, w: x.withColumn("moving", F.avg(value).over(w.rowsBetween(-(n - 1), 0))).where(F.col("_pos") >= n - 1)
    return _framed(df, by, order, n - 1, 0, hot_rows, mean)


def rolling_variance(df: DataFrame, n: int, by: list[str], order: list[str], value: str, still: float = 1.0, pad: float = 100.0, hot_rows: int | None = HOT_ROWS) -> DataFrame:
    """Population variance of the n rows from each on, pad where fewer are left, and whether it is below still."""

    def work(x: DataFrame, w) -> DataFrame:
        f = w.rowsBetween(0, n - 1)
        var = F.when(F.count(F.lit(1)).over(f) == n, F.var_pop(value).over(f)).otherwise(F.lit(pad))
        return x.withColumn("variance", var).withColumn("still", F.col("variance") < still)

    return _framed(df, by, order, 0, n - 1, hot_rows, work)


def sliding_fit(df: DataFrame, n: int, by: list[str], order: list[str], value: str, flat: float = 1e-12, hot_rows: int | None = HOT_ROWS) -> DataFrame:
    """Slope and R squared of the straight line through the n rows from each on, by their place; a tail of fewer rows
    or a window without variance has R squared 1 and no slope in the tail."""
    return _framed(df, by, order, 0, n - 1, hot_rows, lambda x, w: _fit_lines(x, w, n, value, flat))


def _fit_lines(x: DataFrame, w, n: int, value: str, flat: float) -> DataFrame:
    x = x.withColumn("_i", F.row_number().over(w).cast("double"))
    f = w.rowsBetween(0, n - 1)
    k = float(n)
    sx, sy = F.sum("_i").over(f), F.sum(value).over(f)
    x = x.withColumns({"_sx": sx, "_sy": sy, "_sxx": F.sum(F.col("_i") * F.col("_i")).over(f), "_syy": F.sum(F.col(value) * F.col(value)).over(f), "_sxy": F.sum(F.col("_i") * F.col(value)).over(f), "_n": F.count(F.lit(1)).over(f)})
    cxx, cyy, cxy = (F.col(f"_s{a}{b}") - F.col(f"_s{a}") * F.col(f"_s{b}") / k for a, b in ("xx", "yy", "xy"))
    full = F.col("_n") == n
    slope = F.when(full, cxy / cxx)
    r2 = F.when(full & (cyy / k > flat), cxy * cxy / (cxx * cyy)).otherwise(F.lit(1.0))
    return x.withColumns({"slope": slope, "r2": r2}).drop("_i", "_sx", "_sy", "_sxx", "_syy", "_sxy", "_n")


def gradient(df: DataFrame, by: list[str], order: list[str], value: str, out: str = "gradient", hot_rows: int | None = HOT_ROWS) -> DataFrame:
    """Central differences, one-sided at the ends."""
    return _framed(df, by, order, 1, 1, hot_rows, lambda x, w: _differences(x, w, value, out))


def _differences(x: DataFrame, w, value: str, out: str) -> DataFrame:
    up, down = F.lead(value).over(w), F.lag(value).over(w)
    return x.withColumn(out, F.when(down.isNull(), up - F.col(value)).when(up.isNull(), F.col(value) - down).otherwise((up - down) / 2))


def _prominences(v: np.ndarray) -> np.ndarray:
    """Of each value its height over the higher of the lowest points between it and the next higher value, or the end,
    on either side: one walk each way with a stack of values still to be exceeded."""

    def lowest(x: np.ndarray) -> np.ndarray:
        out, stack = np.empty(len(x)), []
        for k, value in enumerate(x.tolist()):
            low = value
            while stack and stack[-1][0] <= value:
                low = min(low, stack.pop()[1])
            out[k] = low
            stack.append((value, low))
        return out

    return v - np.maximum(lowest(v), lowest(v[::-1])[::-1])


def peaks(df: DataFrame, by: list[str], order: str, value: str, prominence: float, distance: float = 0.0, kind: str = "max") -> DataFrame:
    """(by, order, value, prominence, kind) of strict local maxima (or minima, or both) of at least the prominence; of
    two of one kind nearer than the distance, in order, the higher one stays, the earlier of equals."""
    if kind not in ("max", "min", "both"):
        raise ValueError("kind must be max, min or both")

    def find(x: dict) -> dict | None:
        at, v = x[order], x[value].astype(float)
        keep = ~np.isnan(v)
        at, v = at[keep], v[keep]
        found = []
        for name, sign in (("max", 1.0), ("min", -1.0)):
            if kind not in (name, "both") or len(v) < 3:
                continue
            w = v * sign
            top = np.flatnonzero((w[1:-1] > w[:-2]) & (w[1:-1] > w[2:])) + 1
            high = _prominences(w)
            top = top[high[top] >= prominence]
            if distance > 0:
                gone = np.zeros(len(top), bool)
                for k in np.argsort(-w[top], kind="stable"):
                    if not gone[k]:
                        near = np.abs(at[top] - at[top[k]]) < distance
                        near[k] = False
                        gone |= near
                top = top[~gone]
            found += [(at[k], v[k], high[k], name) for k in top]
        if not found:
            return None
        return dict(zip((order, value, "prominence", "kind"), map(np.array, zip(*found))))

    name = {"bigint": "long"}.get(df.schema[order].dataType.simpleString(), df.schema[order].dataType.simpleString())
    return apply_kernel(df, by, [order], [value], find, f"{order} {name}, {value} double, prominence double, kind string")


def path_kinematics(df: DataFrame, by: list[str], order: list[str], x: str, y: str, epsilon: float = 1e-5, hot_rows: int = HOT_ROWS) -> DataFrame:
    """df with the motion along a path, all by central differences of its rows: dx, dy, speed, the unit tangent and its
    change (tangent_x, tangent_y, turn_x, turn_y), the unit normal (normal_x, normal_y), ddx, ddy, along (the change of
    speed) and curvature. Speeds and turns of zero count as epsilon where they divide."""

    w = Window.partitionBy(*by, "_chunk").orderBy(*order)

    def add(frame: DataFrame, **of: str) -> DataFrame:
        for out, value in of.items():
            frame = _differences(frame, w, value, out)
        return frame

    length = lambda a, b: F.sqrt(F.col(a) * F.col(a) + F.col(b) * F.col(b))
    some = lambda c: F.when(c == 0, F.lit(epsilon)).otherwise(c)
    # differences of differences of differences reach three rows
    got = add(chunked(df, by, order, 3, 3, hot_rows), dx=x, dy=y).withColumn("speed", some(length("dx", "dy")))
    got = got.withColumns({"tangent_x": F.col("dx") / F.col("speed"), "tangent_y": F.col("dy") / F.col("speed")})
    got = add(got, turn_x="tangent_x", turn_y="tangent_y", ddx="dx", ddy="dy", along="speed").withColumn("_l", some(length("turn_x", "turn_y")))
    got = got.where("_own").drop("_pos", "_chunk", "_own")
    bend = F.abs(F.col("ddx") * F.col("dy") - F.col("dx") * F.col("ddy")) / F.pow("speed", F.lit(3))
    return got.withColumns({"normal_x": F.col("turn_x") / F.col("_l"), "normal_y": F.col("turn_y") / F.col("_l"), "curvature": bend}).drop("_l")


def path_candidates(paths: DataFrame, by: list[str], pos: str) -> DataFrame:
    """Of each path of ``path_kinematics`` the first rows at which its tangent, its pull to the side, its acceleration
    and its curvature change or are greatest: tangent, normal, acceleration, curvature."""
    side = F.col("curvature") * F.col("speed") * F.col("speed")
    what = {"tangent": F.abs("turn_y"), "normal": F.greatest(side * F.col("normal_x"), side * F.col("normal_y")), "acceleration": F.abs("ddy"), "curvature": F.col("curvature")}
    most = lambda c: F.max_by(pos, F.when(c.isNotNull(), F.struct(F.round(c, 9), -F.col(pos))))
    return paths.groupBy(*by).agg(*[most(c).alias(n) for n, c in what.items()])


def smooth(df: DataFrame, by: list[str], order: list[str], value: str, taps: list[float], hot_rows: int | None = HOT_ROWS) -> DataFrame:
    """df with value replaced by the weighted mean of its neighbours, an odd number of taps around the row; beyond the
    ends, and where values are missing, the other taps count alone."""
    half = len(taps) // 2
    return _framed(df, by, order, half, half, hot_rows, lambda x, w: _weighted(x, w, value, taps))


def _weighted(x: DataFrame, w, value: str, taps: list[float]) -> DataFrame:
    half = len(taps) // 2
    near = [(F.lag(value, half - k).over(w) if k < half else F.lead(value, k - half).over(w), t) for k, t in enumerate(taps)]
    total = sum((F.coalesce(c * t, F.lit(0.0)) for c, t in near), F.lit(0.0))
    weight = sum((F.when(c.isNotNull(), F.lit(t)).otherwise(0.0) for c, t in near), F.lit(0.0))
    return x.withColumn(value, F.try_divide(total, weight))


def words_at_strobes(df: DataFrame, by: list[str], time: str, word: str, rising: Column, repair: str | None = None) -> DataFrame:
    """(by, time, word): the code word that stands before each rising strobe bit, in order of time.

    The first row of a group is no strobe. A group without strobes gives its rows, those of equal time and word once.
    Words above 2^15 hold the strobe bit. repair says what becomes of them: None leaves them; "strobe" takes, if a group
    has any, all its words from the strobe rows, less 2^15; "shift" takes the word one row earlier, and of a group's
    first strobe less 2^15 if that one holds the bit too. Words that can't be repaired are null.
    """
    if repair not in (None, "strobe", "shift"):
        raise ValueError("repair must be None, strobe or shift")
    top = 32768
    w, own = Window.partitionBy(*by).orderBy(time, word), Window.partitionBy(*by)
    x = df.select(*by, time, word, F.coalesce(rising, F.lit(False)).alias("_s"))
    x = x.withColumns({"_t": F.lag(time).over(w), "_w": F.lag(word).over(w), "_w2": F.lag(word, 2).over(w), "_k": F.row_number().over(w)})
    x = x.withColumn("_s", F.col("_s") & (F.col("_k") > 1))
    x = x.withColumns({"_any": F.max("_s").over(own), "_wrong": F.max(F.col("_s") & (F.col("_w") > top)).over(own), "_first": F.min(F.when(F.col("_s"), F.col("_k"))).over(own)})
    at, got = F.col("_t"), F.col("_w")
    if repair == "strobe":
        at, got = F.when(F.col("_wrong"), F.col(time)).otherwise(at), F.when(F.col("_wrong"), F.col(word) - top).otherwise(got)
    elif repair == "shift":
        earlier = F.when((F.col("_w2") > top) & (F.col("_k") == F.col("_first")), F.col("_w2") - top).otherwise(F.col("_w2"))
        got = F.when(got > top, F.when(earlier <= top, earlier)).otherwise(got)
    strobed = x.where("_s").select(*by, at.alias(time), got.alias(word))
    plain = x.where("NOT _any").select(*by, time, word).dropDuplicates()
    return strobed.unionByName(plain)


def detrend(df: DataFrame, by: list[str], order: list[str], value: str, alpha: float = 0.0) -> DataFrame:
    """Value less its straight line over the group's rows; alpha draws the line's slope towards zero (ridge)."""
    x = df.withColumn("_i", (F.row_number().over(Window.partitionBy(*by).orderBy(*order)) - 1).cast("double"))
    own = Window.partitionBy(*by)
    mx, my = F.avg("_i").over(own), F.avg(value).over(own)
    ridge = F.lit(float(alpha)) / F.count(value).over(own)
    slope = F.coalesce(F.try_divide(F.covar_pop("_i", value).over(own), F.var_pop("_i").over(own) + ridge), F.lit(0.0))
    return x.withColumn("detrended", F.col(value) - (my + slope * (F.col("_i") - mx))).drop("_i")


def rezero(df: DataFrame, by: list[str], order: list[str], values: list[str]) -> DataFrame:
    """Each value less the group's first one."""
    w = Window.partitionBy(*by).orderBy(*order)
    return df.withColumns({f"{v}_zeroed": F.col(v) - F.first(v).over(w) for v in values})


def fill_linear(df: DataFrame, by: list[str], frame: str, value: str, hot_rows: int = HOT_ROWS) -> DataFrame:
    """All frame numbers from a group's first to its last; missing ones get the straight line between neighbours and
    filled true."""
    ends = df.groupBy(*by).agg(F.min(frame).alias("_a"), F.max(frame).alias("_b"))
    grid = ends.select(*by, F.explode(F.sequence("_a", "_b")).alias(frame))
    x = grid.join(df.select(*by, frame, value), [*by, frame], "left")
    known = F.when(F.col(value).isNotNull(), F.struct(F.col(frame).alias("f"), F.col(value).alias("v")))
    x = scan(x, by, [frame], hot_rows, _p=("last", known), _n=("next", known))
    line = F.col("_p.v") + (F.col("_n.v") - F.col("_p.v")) * (F.col(frame) - F.col("_p.f")) / (F.col("_n.f") - F.col("_p.f"))
    return x.withColumn("filled", F.col(value).isNull()).withColumn(value, F.coalesce(F.col(value), line)).drop("_p", "_n")


def carry_forward(df: DataFrame, by: list[str], order: list[str], values: list[str], hot_rows: int = HOT_ROWS) -> DataFrame:
    """Nulls replaced by the last known value before."""
    return scan(df, by, order, hot_rows, **{v: ("last", F.col(v)) for v in values}).select(df.columns)


def threshold_events(sig: DataFrame, by: list[str], sample: str, q: float, refractory: int, keep_first: bool = False, value: str = "value", hot_rows: int = HOT_ROWS) -> DataFrame:
    """Samples beyond q population deviations of their channel that lie more than the refractory time after the last
    such sample; a channel's first is dropped unless kept by option."""
    sd = sig.groupBy(*by).agg(F.stddev_pop(value).alias("_sd"))
    over = sig.join(sd, by).where(F.abs(value) > q * F.col("_sd")).select(sig.columns)
    x = scan(over, by, [sample], hot_rows, _g=("lag", F.col(sample)))
    return x.withColumn("_g", F.col(sample) - F.col("_g")).where((F.col("_g") > refractory) | (F.col("_g").isNull() & F.lit(keep_first))).drop("_g")


def burst_sessions(df: DataFrame, by: list[str], t: str, order: list[str], gap: float, least: int, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Runs of rows no further than gap apart that hold at least so many: start, end and number of each."""
    x = Scan(df, by, order, hot_rows).carry(_b=("lag", F.col(t)))
    new = F.coalesce((F.col(t) - F.col("_b")) > gap, F.lit(True))
    x = x.with_columns({"_new": new.cast("int")}).carry(_run=("upto", F.col("_new"))).done()
    return x.groupBy(*by, "_run").agg(F.min(t).alias("start"), F.max(t).alias("end"), F.count(F.lit(1)).alias("n")).where(F.col("n") >= least).drop("_run")


def split_at_bursts(df: DataFrame, by: list[str], t: str, order: list[str], gap: float, least: int) -> DataFrame:
    """df with part, from 0: which recording a row belongs to, each one beginning with a run of at least so many rows
    no further than gap apart. Rows before the first such run are left out."""
    w = Window.partitionBy(*by).orderBy(*order)
    up_to = w.rowsBetween(Window.unboundedPreceding, 0)
    new = F.coalesce((F.col(t) - F.lag(t).over(w)) > gap, F.lit(True))
    x = df.withColumn("_new", new).withColumn("_run", F.sum(F.col("_new").cast("int")).over(up_to))
    long_enough = F.count(F.lit(1)).over(Window.partitionBy(*by, "_run")) >= least
    x = x.withColumn("_start", F.col("_new") & long_enough)
    return x.withColumn("part", F.sum(F.col("_start").cast("int")).over(up_to) - 1).where("part >= 0").drop("_new", "_run", "_start")


def closest_part(parts: DataFrame, by: list[str], expected: DataFrame, tolerance: float = 0.2, strict: bool = False) -> DataFrame:
    """(by, part, n, expected, agrees): of each recording's parts the one whose number of rows is closest to what its
    log expects, the earlier of equals; agrees says whether it is off by no more than the tolerance. Strict makes a part
    that doesn't agree an error. expected: by, expected."""
    counts = parts.groupBy(*by, "part").agg(F.count(F.lit(1)).alias("n")).join(expected, by)
    off = F.abs(F.col("n") - F.col("expected"))
    best = counts.groupBy(*by).agg(F.min_by(F.struct("part", "n", "expected"), F.struct(off, "part")).alias("b")).select(*by, "b.*")
    agrees = F.coalesce(F.try_divide(F.abs(F.col("n") - F.col("expected")), F.col("expected")) <= tolerance, F.lit(False))
    if strict:
        agrees = F.when(agrees, True).otherwise(F.raise_error(F.lit("a part's rows don't agree with its log")).cast("boolean"))
    return best.withColumn("agrees", agrees)


def zscore(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """Population z within each group; null where nothing varies."""
    w = Window.partitionBy(*by)
    return df.withColumn("z", F.try_divide(F.col(value) - F.avg(value).over(w), F.nullif(F.stddev_pop(value).over(w), F.lit(0.0))))


def progress_profile(df: DataFrame, by: list[str], order: list[str], along: str, value: str, bins: int, split: str) -> DataFrame:
    """Mean and deviation of a value in bins of progress (along over its last value; strictly between 0 and 1)."""
    whole = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    x = df.withColumn("_p", F.try_divide(F.col(along), F.last(along).over(whole))).where("_p > 0 AND _p < 1")
    return x.groupBy(split, F.floor(F.col("_p") * bins).cast("int").alias("bin")).agg(F.avg(value).alias("mean"), F.stddev_pop(value).alias("sd"), F.count(F.lit(1)).alias("n"))


def natural_key(name: Column) -> Column:
    """The number in names like trial_12, to sort by."""
    return F.regexp_extract(name, r"(\d+)", 1).try_cast("long")


def stitch(df: DataFrame, by: list[str], trial: str, order: list[str]) -> DataFrame:
    """A running sample number over the trials of each group, in trial order."""
    return df.withColumn("stitched", (F.row_number().over(Window.partitionBy(*by).orderBy(trial, *order)) - 1).cast("long"))
