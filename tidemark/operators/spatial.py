"""Spatial responses: sweeps over a grid, surfaces, outlines and overlaps (sections C11, C12, D22, D24 and N)."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geometry as G
from .joins import asof_backward
from .quantiles import join_groups


#: A point of the unit sphere at columns az and el (degrees), and the cube of a grid that a point lies in.
_ON_SPHERE = "named_struct('x', cos(radians({az})) * cos(radians({el})), 'y', sin(radians({az})) * cos(radians({el})), 'z', sin(radians({el})))"
_CUBE = "named_struct('i', cast(floor({p}.x / {h}D) as int), 'j', cast(floor({p}.y / {h}D) as int), 'k', cast(floor({p}.z / {h}D) as int))"


def coverage(cells: DataFrame, sweeps: DataFrame, half_width: float) -> DataFrame:
    """(cell, direction, bin) where a cell lies nearer than half the width to a sweep's great circle.

    cells: cell, az, el; sweeps: direction, bin, az1, el1, az2, el2. The unit sphere is laid in cubes of twice the half
    width. A cell has its own cube; a sweep has those around points of its circle that lie twice the half width apart, so
    a cell near the circle shares a cube with it, once. Only such pairs are measured.
    """
    w = math.radians(half_width)
    h, n = 2 * w + 1e-9, max(4, math.ceil(math.pi / w))
    own = cells.withColumn("_p", F.expr(_ON_SPHERE.format(az="az", el="el"))).withColumn("_cube", F.expr(_CUBE.format(p="_p", h=repr(h)))).drop("_p")
    # the circle through the first point that sets out towards the second: cos(a) * point + sin(a) * heading
    heading = "named_struct('x', -sin(radians(el1)) * cos(radians(az1)) * cos(_b) - sin(radians(az1)) * sin(_b), 'y', -sin(radians(el1)) * sin(radians(az1)) * cos(_b) + cos(radians(az1)) * sin(_b), 'z', cos(radians(el1)) * cos(_b))"
    point = "named_struct('x', _p.x * cos(a) + _t.x * sin(a), 'y', _p.y * cos(a) + _t.y * sin(a), 'z', _p.z * cos(a) + _t.z * sin(a))"
    shift = "named_struct('i', q.i + d div 9 - 1, 'j', q.j + d div 3 % 3 - 1, 'k', q.k + d % 3 - 1)"
    around = f"transform(transform(sequence(0, {n - 1}), m -> m * {2 * math.pi / n!r}D), a -> {_CUBE.format(p='s', h=repr(h)).replace('s.', f'({point}).')})"
    x = sweeps.withColumn("_b", F.radians(G.bearing(F.col("az1"), F.col("el1"), F.col("az2"), F.col("el2"))))
    x = x.withColumns({"_p": F.expr(_ON_SPHERE.format(az="az1", el="el1")), "_t": F.expr(heading)}).withColumn("_q", F.array_distinct(F.expr(around)))
    x = x.withColumn("_cube", F.explode(F.array_distinct(F.expr(f"flatten(transform(_q, q -> transform(sequence(0, 26), d -> {shift})))")))).drop("_b", "_p", "_t", "_q")
    off = G.cross_track(F.col("az"), F.col("el"), F.col("az1"), F.col("el1"), F.col("az2"), F.col("el2"))
    return own.join(x, "_cube").where(F.abs(off) < half_width).select("cell", "direction", "bin")


#: Shares of the cells that keys are paired with apart.
SHARES = 32


def grid_activity(rates: DataFrame, covered: DataFrame, cells: DataFrame, keys: list[str]) -> DataFrame:
    """Mean activity of each cell over directions: of a direction the mean over the bins whose sweep covers the cell, or,
    where none does, the spontaneous level (mean over directions of the median over bins). rates: keys, direction, bin,
    rate; rows without a value of a key are left out.

    Directions that don't cover a cell count as the spontaneous level without a row of their own: only covered ones are
    summed, and the others added by their number. The result has every cell for every key; both are dealt to shares of the cells for that.
    """
    per = rates.join(covered, ["direction", "bin"]).groupBy(*keys, "cell", "direction").agg(F.avg("rate").alias("a"))
    quiet = rates.groupBy(*keys, "direction").agg(F.median("rate").alias("m")).groupBy(*keys).agg(F.avg("m").alias("quiet"), F.count(F.lit(1)).alias("_n"))
    seen = per.groupBy(*keys, "cell").agg(F.sum("a").alias("_s"), F.sum(F.col("a") * F.col("a")).alias("_ss"), F.count(F.lit(1)).alias("_m"))
    share = F.pmod(F.xxhash64("cell"), F.lit(SHARES)).cast("int")
    every = quiet.withColumn("_share", F.explode(F.sequence(F.lit(0), F.lit(SHARES - 1)))).join(cells.select("cell").withColumn("_share", share), "_share")
    rest, q = F.col("_n") - F.col("_m"), F.col("quiet")
    mean, square = (F.col("_s") + rest * q) / F.col("_n"), (F.col("_ss") + rest * q * q) / F.col("_n")
    x = every.join(seen, [*keys, "cell"], "left")
    sd = F.sqrt(F.greatest(F.lit(0.0), square - mean * mean))
    return x.select(*keys, "cell", F.coalesce(mean, q).alias("activity"), F.coalesce(sd, F.lit(0.0)).alias("sd"))


def bar_map(spikes: DataFrame, covered: DataFrame, cells: DataFrame, delays: list[int], bins: int, bin_col: str = "bin") -> DataFrame:
    """Activity of each (channel, delay, cell): bins moved back by the delay, counted, and mapped by grid_activity.
    spikes: channel, direction, bin. Delay is one more key, so all delays are one job."""
    x = spikes.withColumn("delay", F.explode(F.array(*map(F.lit, delays)))).withColumn("bin", F.col(bin_col) - F.col("delay")).where("bin >= 0")
    counts = x.groupBy("channel", "delay", "direction", "bin").agg(F.count(F.lit(1)).alias("n"))
    grid = x.select("channel", "delay", "direction").distinct().withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))))
    rates = grid.join(counts, ["channel", "delay", "direction", "bin"], "left").withColumn("rate", F.coalesce("n", F.lit(0)).cast("double"))
    return grid_activity(rates, covered, cells, ["channel", "delay"])


def sparse_map(responses: DataFrame, lit: DataFrame, by: list[str]) -> DataFrame:
    """Mean, deviation and z over cells of the responses to the trials that lit a cell: responses (by, trial, value),
    lit (trial, cell, polarity)."""
    got = responses.join(lit, "trial").groupBy(*by, "cell", "polarity").agg(F.avg("value").alias("mean"), F.stddev_pop("value").alias("sd"), F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy(*by, "polarity")
    return got.withColumn("z", F.try_divide(F.col("mean") - F.avg("mean").over(w), F.nullif(F.stddev_pop("mean").over(w), F.lit(0.0))))


def gaussian_search(cells: DataFrame, by: list[str], centres: list[tuple[float, float]], sigmas: list[float], weight: Column | None = None) -> DataFrame:
    """Of all stated centres and widths the Gaussian with the least squared error, with its amplitude and offset.

    cells: by, x, y, z; cells without any of x, y and z don't count. For a given shape the best amplitude and offset
    follow from sums, and a Gaussian is a product of one along x and one along y. So the sums are taken along x for every
    row of cells and place in x first, and only these along y: a cell meets the places in x, not every candidate.
    """
    number = lambda c: F.lit(float(c))
    place = lambda name, values: F.explode(F.array(*map(number, sorted(set(values))))).alias(name)
    known = cells.where("x IS NOT NULL AND y IS NOT NULL AND z IS NOT NULL").withColumn("_w", weight if weight is not None else F.lit(1.0)).select(*by, "x", "y", "z", "_w")
    w, z = F.col("_w"), F.col("z")
    total = known.groupBy(*by).agg(F.sum(w).alias("n"), F.sum(w * z).alias("sz"), F.sum(w * z * z).alias("szz"))
    bell = lambda at, centre: F.exp(-(F.col(at) - F.col(centre)) * (F.col(at) - F.col(centre)) / (2 * F.col("sigma") * F.col("sigma")))
    across = known.select("*", place("sigma", sigmas)).select("*", place("cx", [a for a, _ in centres])).withColumn("_g", bell("x", "cx"))
    g = F.col("_g")
    rows = across.groupBy(*by, "y", "sigma", "cx").agg(F.sum(w * g).alias("_a"), F.sum(w * g * z).alias("_b"), F.sum(w * g * g).alias("_c"))
    up = rows.select("*", place("cy", [b for _, b in centres]))
    if len(set(centres)) < len({a for a, _ in centres}) * len({b for _, b in centres}):
        up = up.where(F.array_contains(F.array(*[F.struct(number(a).alias("cx"), number(b).alias("cy")) for a, b in sorted(set(centres))]), F.struct("cx", "cy")))
    g = F.col("_g")
    x = up.withColumn("_g", bell("y", "cy")).groupBy(*by, "cx", "cy", "sigma").agg(F.sum(g * F.col("_a")).alias("sg"), F.sum(g * F.col("_b")).alias("sgz"), F.sum(g * g * F.col("_c")).alias("sgg"))
    x = join_groups(x, total, by)
    cgg, cgz, czz = F.col("sgg") - F.col("sg") * F.col("sg") / F.col("n"), F.col("sgz") - F.col("sg") * F.col("sz") / F.col("n"), F.col("szz") - F.col("sz") * F.col("sz") / F.col("n")
    x = x.withColumn("amplitude", F.try_divide(cgz, cgg)).withColumn("sse", czz - F.coalesce(F.col("amplitude") * cgz, F.lit(0.0))).withColumn("sse0", czz)
    x = x.withColumn("base", (F.col("sz") - F.col("amplitude") * F.col("sg")) / F.col("n"))
    c = F.struct("cx", "cy", "sigma")
    best = x.groupBy(*by).agg(F.min_by(F.struct(c.alias("c"), "amplitude", "base", "sse", "sse0"), F.struct(F.round("sse", 9), c)).alias("b"))
    return best.select(*by, "b.c.cx", "b.c.cy", "b.c.sigma", "b.amplitude", "b.base", "b.sse", (1 - F.try_divide(F.col("b.sse"), F.col("b.sse0"))).alias("r2"))


def curve_search(points: DataFrame, by: list[str], centres: list[float], sigmas: list[float], weight: Column | None = None) -> DataFrame:
    """gaussian_search along one axis: points by, x, z; of all stated centres and widths the best curve with its amplitude
    and offset. Points without x or z don't count."""
    flat = points.where("x IS NOT NULL AND z IS NOT NULL").withColumn("y", F.lit(0.0))
    return gaussian_search(flat, by, [(c, 0.0) for c in centres], sigmas, weight).drop("cy")


def log_spaced(low: float, high: float, n: int) -> list[float]:
    """n widths from low to high, each the same multiple of the one before."""
    return [low * (high / low) ** (k / (n - 1)) for k in range(n)]


def bootstrap_weight(boot: Column, key: Column) -> Column:
    """A Poisson-like weight from 0 to 4 of each row in each resample, from a hash of both."""
    u = F.conv(F.substring(F.md5(F.concat_ws("#", boot.cast("string"), key.cast("string"))), 1, 4), 16, 10).cast("double") / 65536
    return F.when(u < 0.3679, 0.0).when(u < 0.7358, 1.0).when(u < 0.9197, 2.0).when(u < 0.981, 3.0).otherwise(4.0)


def bootstrap_search(cells: DataFrame, by: list[str], key: str, n: int, centres: list[tuple[float, float]], sigmas: list[float]) -> DataFrame:
    """gaussian_search on n resamples of the cells; one row each."""
    x = cells.withColumn("boot", F.explode(F.sequence(F.lit(1), F.lit(n))))
    return gaussian_search(x, [*by, "boot"], centres, sigmas, bootstrap_weight(F.col("boot"), F.col(key)))


def circles(fields: DataFrame) -> DataFrame:
    """Cartesian centre and chord radius of receptive fields (az, el, r in degrees): the chord to az + r + 1."""
    one = F.lit(1.0)
    a, b = G.sphere_to_cartesian(F.col("az"), F.col("el"), one), G.sphere_to_cartesian(F.col("az") + F.col("r") + 1, F.col("el"), one)
    d = G.add(a, G.scale(b, F.lit(-1.0)))
    return fields.withColumn("centre", a).withColumn("radius", F.sqrt(G.dot(d, d)))


def overlaps(pairs: DataFrame, least: float = 0.01) -> DataFrame:
    """pairs of circles (x, y, radius) and two polygons (a, b) with flags whether each overlaps the circle by the share
    least of the smaller area; if either polygon is collapsed both flags are true; a null radius has null flags."""

    def hit(p: str) -> Column:
        area = G.polygon_area(F.col(p))
        shared = G.circle_polygon_area(F.col("x"), F.col("y"), F.col("radius"), F.col(p))
        smaller = F.least(area, F.lit(3.141592653589793) * F.col("radius") * F.col("radius"))
        return F.coalesce(F.try_divide(shared, smaller) >= least, F.lit(False))

    flat = G.is_collapsed(F.col("a")) | G.is_collapsed(F.col("b"))
    known = F.col("radius").isNotNull()
    return pairs.withColumns({"collapsed": flat, "inside_a": F.when(known, flat | hit("a")), "inside_b": F.when(known, flat | hit("b"))})


def overlap_role(target: str, reached: str, collapsed: str = "collapsed", inside_a: str = "inside_a", inside_b: str = "inside_b") -> Column:
    """What a circle overlaps at a time: target, distractor or neither.

    target and reached name columns of 'A' or 'B'. Over both stimuli the target counts; where the stimuli are collapsed,
    the one that was reached decides. An unknown target, or a collapse that nothing was reached in, is neither; circles
    without flags (no radius) have null.
    """
    t, r = F.col(target), F.col(reached)
    own, other = F.when(t == "A", F.col(inside_a)).otherwise(F.col(inside_b)), F.when(t == "A", F.col(inside_b)).otherwise(F.col(inside_a))
    seen = F.when(own, "target").when(other, "distractor").otherwise("neither")
    fallen = F.when(r == t, "target").when(r.isin("A", "B"), "distractor").otherwise("neither")
    known = F.col(inside_a).isNotNull() & F.col(inside_b).isNotNull()
    return F.when(known, F.when(t.isin("A", "B"), F.when(F.col(collapsed), fallen).otherwise(seen)).otherwise("neither"))


def _extent(polygon: Column) -> list[Column]:
    """x0, x1, y0 and y1 of the box around a polygon."""
    return [f(polygon.getField(c)) for c in "xy" for f in (F.array_min, F.array_max)]


def _cells(x0: Column, x1: Column, y0: Column, y1: Column, size: float) -> Column:
    """The cells of a square grid that a box touches, as structs (i, j)."""
    at = lambda c: F.floor(c / size).cast("long")
    return F.flatten(F.transform(F.sequence(at(x0), at(x1)), lambda i: F.transform(F.sequence(at(y0), at(y1)), lambda j: F.struct(i.alias("i"), j.alias("j")))))


def shared_areas(corners: np.ndarray, px: np.ndarray, py: np.ndarray, x: np.ndarray, y: np.ndarray, radius: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(area, area common with its circle) of each simple polygon, as ``polygon_area`` and ``circle_polygon_area`` give them.

    corners: how many corners, three at least, of px and py each polygon has in turn. A missing number makes its areas NaN.
    """
    of = np.repeat(np.arange(len(corners)), corners)
    ends = np.cumsum(corners)
    after = np.arange(1, len(px) + 1)
    after[ends - 1] = ends - corners
    area = np.abs(np.bincount(of, px * py[after] - px[after] * py, len(corners))) / 2
    r2, ax, ay = (radius * radius)[of], px - x[of], py - y[of]
    bx, by = ax[after], ay[after]
    dx, dy = bx - ax, by - ay
    aa, bb, cc = dx * dx + dy * dy, ax * dx + ay * dy, ax * ax + ay * ay - r2
    disc = bb * bb - aa * cc

    def sector(ax: np.ndarray, ay: np.ndarray, bx: np.ndarray, by: np.ndarray) -> np.ndarray:
        return r2 * np.arctan2(ax * by - ay * bx, ax * bx + ay * by) / 2

    with np.errstate(divide="ignore", invalid="ignore"):
        root = np.sqrt(np.maximum(0.0, disc))
        lo, hi = np.maximum(0.0, (-bb - root) / aa), np.minimum(1.0, (-bb + root) / aa)
    qx, qy, wx, wy = ax + lo * dx, ay + lo * dy, ax + hi * dx, ay + hi * dy
    inside = sector(ax, ay, qx, qy) + (qx * wy - qy * wx) / 2 + sector(wx, wy, bx, by)
    part = np.where(aa == 0, 0.0, np.where((disc <= 0) | (lo >= hi), sector(ax, ay, bx, by), inside))
    return area, np.abs(np.bincount(of, part, len(corners)))


def overlap_votes(points: DataFrame, fields: DataFrame, key: list[str], areas: list, size: float, least: float = 0.01) -> DataFrame:
    """(key, area, n_target, n_distractor, n_fields): how many fields of each of the stated areas overlap the target or the distractor at
    each point, by ``overlap_role``.

    points: key (unique), target, reached, a and b (polygons); fields: area, x, y, radius (null: the field doesn't count).
    Boxes of polygons and circles are laid on a grid of cells of a stated size and meet where they share a cell; areas
    are only computed for such pairs, once a pair: in the cell of the lower left corner of what their boxes share. Fields
    that share no cell overlap neither. A point whose stimuli are collapsed needs no pair at all.
    """
    known = fields.where(F.col("radius").isNotNull())
    sizes = known.groupBy("area").agg(F.count(F.lit(1)).alias("n_fields"))
    flat = G.is_collapsed(F.col("a")) | G.is_collapsed(F.col("b"))
    x = points.withColumn("collapsed", F.coalesce(flat, F.lit(False)))
    decides = F.col("target").isin("A", "B") & ~F.col("collapsed")
    each = x.where(decides).select(*key, "target", F.explode(F.array(*[F.struct(F.lit(n).alias("name"), F.col(c).alias("polygon")) for n, c in (("A", "a"), ("B", "b"))])).alias("_p"))
    each = each.select(*key, "target", "_p.*").where(F.size("polygon") >= 3)
    each = each.withColumns(dict(zip(("px0", "px1", "py0", "py1"), _extent(F.col("polygon"))))).withColumn("cell", F.explode(_cells(*map(F.col, ("px0", "px1", "py0", "py1")), size)))
    r = F.col("radius")
    round_ = known.withColumn("field", F.monotonically_increasing_id()).withColumns({"cx0": F.col("x") - r, "cx1": F.col("x") + r, "cy0": F.col("y") - r, "cy1": F.col("y") + r})
    round_ = round_.withColumn("cell", F.explode(_cells(*map(F.col, ("cx0", "cx1", "cy0", "cy1")), size)))
    met = each.join(round_, "cell").where("px0 <= cx1 AND cx0 <= px1 AND py0 <= cy1 AND cy0 <= py1")
    corner = lambda c, p, f: F.floor(F.greatest(p, f) / size).cast("long") == F.col(f"cell.{c}")
    met = met.where(corner("i", F.col("px0"), F.col("cx0")) & corner("j", F.col("py0"), F.col("cy0")))
    met = met.select(*key, "area", "field", (F.col("name") == F.col("target")).alias("own"), F.col("polygon.x").alias("_px"), F.col("polygon.y").alias("_py"), "x", "y", "radius")
    kept = met.columns[:-5]

    def overlapping(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            px, py = batch.column(len(kept)), batch.column(len(kept) + 1)
            numbers = [c.cast(pa.float64()).to_numpy(zero_copy_only=False) for c in (px.flatten(), py.flatten(), *batch.columns[len(kept) + 2 :])]
            area, shared = shared_areas(px.value_lengths().to_numpy(zero_copy_only=False), *numbers)
            smaller = np.minimum(area, math.pi * numbers[4] ** 2)
            with np.errstate(divide="ignore", invalid="ignore"):
                hit = (smaller > 0) & (shared / smaller >= least)
            yield batch.select(kept).filter(pa.array(hit))

    # numpy over Arrow batches: as expressions, a pair's areas are lambdas outside generated code
    schema = met.select(*kept).schema
    hits = met.mapInArrow(overlapping, schema).groupBy(*key, "area", "field").agg(F.bool_or("own").alias("own"))
    votes = hits.groupBy(*key, "area").agg(F.count_if("own").alias("_t"), F.count_if(~F.col("own")).alias("_d"))
    grid = x.select(*key, "target", "reached", "collapsed", F.explode(F.array(*map(F.lit, areas))).alias("area"))
    got = grid.join(sizes, "area").join(votes, [*key, "area"], "left")
    fallen = F.col("collapsed") & F.col("target").isin("A", "B")
    to_target, to_other = F.col("reached") == F.col("target"), F.col("reached").isin("A", "B") & (F.col("reached") != F.col("target"))
    count = lambda c, seen: F.when(fallen, F.when(F.coalesce(c, F.lit(False)), F.col("n_fields")).otherwise(0)).otherwise(F.coalesce(seen, F.lit(0)))
    return got.select(*key, "area", count(to_target, "_t").alias("n_target"), count(to_other, "_d").alias("n_distractor"), "n_fields")


def vote_states(votes: DataFrame, by: list[str]) -> DataFrame:
    """(by, state): of each group of ``overlap_votes`` rows what most fields have: neither, target or distractor, of
    equals the first of these."""
    t, d = F.sum("n_target"), F.sum("n_distractor")
    n = F.sum("n_fields") - t - d
    state = F.when((n >= t) & (n >= d), "neither").when(t >= d, "target").otherwise("distractor")
    return votes.groupBy(*by).agg(state.alias("state"))


def overlap_raster(trials: DataFrame, states: DataFrame, by: list[str], areas: list, ticks: list, longest: float, gap_rows: int = 2) -> DataFrame:
    """(by, area, row, trial, outcome, tick, state): states of areas over time, a row of the raster a trial.

    trials: by, trial (their order), block, end (when the reward came, from the onset), outcome; states: by, trial, area,
    t, state. A tick has the last state at or before it, ticks before the first have the first, and trials without any
    have neither; after the trial's end states are null. Trials without an end or with one later than longest take no row.
    Where the block changes, also at a trial without a row, gap_rows rows without trial and state stand between.
    """
    in_order = Window.partitionBy(*by).orderBy("trial")
    before = in_order.rowsBetween(Window.unboundedPreceding, -1)
    shown = F.col("end").isNotNull() & (F.col("end") <= longest)
    x = trials.select(*by, "trial", "block", "end", "outcome", shown.alias("_shown")).withColumn("_new", F.coalesce(F.col("block") != F.lag("block").over(in_order), F.lit(False)))
    x = x.withColumns({"_rows": F.coalesce(F.sum(F.col("_shown").cast("int")).over(before), F.lit(0)), "_gaps": F.sum(F.col("_new").cast("int")).over(in_order)})
    per_area = F.explode(F.array(*map(F.lit, areas))).alias("area")
    lines = x.where("_shown").select(*by, "trial", "end", "outcome", (F.col("_rows") + gap_rows * F.col("_gaps")).alias("row"), per_area)
    grid = lines.withColumn("tick", F.explode(F.array(*map(F.lit, ticks))))
    found = asof_backward(grid, states, [*by, "trial", "area"], "tick", "t", ["state"], or_first=True)
    state = F.when(F.col("tick") <= F.col("end"), F.coalesce("state_found", F.lit("neither")))
    kept = found.select(*by, "area", "row", "trial", "outcome", "tick", state.alias("state"))
    first = F.col("_rows") + gap_rows * (F.col("_gaps") - 1)
    gaps = x.where("_new").select(*by, first.alias("_first"), per_area).withColumn("row", F.explode(F.sequence(F.col("_first"), F.col("_first") + gap_rows - 1)))
    gaps = gaps.withColumn("tick", F.explode(F.array(*map(F.lit, ticks))))
    none = lambda c: F.lit(None).cast(kept.schema[c].dataType).alias(c)
    return kept.unionByName(gaps.select(*by, "area", "row", none("trial"), F.lit("gap").alias("outcome"), "tick", none("state")))


def gaze_centred(stimuli: DataFrame, x: str, y: str, width: float, height: float, gaze_x: str, gaze_y: str, eye: tuple[float, float, float], radius: float = 60.0) -> DataFrame:
    """stimuli with polygon: the corners of each one's box on the dome as directions (x, y, z) from an eye that looks
    along its gaze. Null positions or gazes have null corners."""
    at = F.struct(*[F.lit(v).alias(n) for n, v in zip("xyz", eye)])

    def seen(corner: Column) -> Column:
        r = G.dome_to_eye(corner["x"], corner["y"], F.col(gaze_x), F.col(gaze_y), at, radius)
        return G.let(r, lambda a: G.retinal_to_cartesian(a["eccentricity"], a["polar"]))

    return stimuli.withColumn("polygon", F.transform(G.corners(F.col(x), F.col(y), F.lit(width), F.lit(height)), seen))


def stimulus_slots(stimuli: DataFrame, by: list[str], order: list[str], size: int = 5) -> DataFrame:
    """stimuli with slot, their place from 0 among the size stimuli of a round, and round, both in order."""
    k = F.row_number().over(Window.partitionBy(*by).orderBy(*order)) - 1
    return stimuli.withColumns({"slot": (k % size).cast("int"), "round": F.floor(k / size).cast("int")})


def warp_outline(polygons: DataFrame, outline: DataFrame, quad: str) -> DataFrame:
    """Every outline point (point, u, v) mapped into every quadrilateral; the outline is one stated shape."""
    x = polygons.crossJoin(F.broadcast(outline))
    return x.withColumn("_p", G.square_to_quad(F.col("u"), F.col("v"), F.col(quad))).withColumns({"x": F.col("_p.x"), "y": F.col("_p.y")}).drop("_p")
