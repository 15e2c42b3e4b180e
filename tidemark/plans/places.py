"""Queries of spatial operators (C11, C12, D22, D24, N), of paths (E11, E12, E18) and of streams (T)."""

from __future__ import annotations

import datetime as dt
import math

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..operators import aggregates as A
from ..operators import joins as J
from ..operators import kinematics as K
from ..operators import spatial as S
from ..staging import new_dir
from ..streaming import jobs as T
from .measures import _EYE as EYE
from .measures import retinal_sql
from .registry import query, r6

_CELLS = "(SELECT DISTINCT (p_size % 12) * 100 + p_partkey % 10 AS cell, (p_size % 12) * 3.0::DOUBLE AS az, (p_partkey % 10) * 3.0::DOUBLE AS el FROM part)"
_SWEEPS = "(SELECT DISTINCT p_size % 4 AS direction, p_partkey % 10 AS bin, CASE WHEN p_size % 2 = 0 THEN (p_partkey % 10) * 4.0 ELSE 0 END::DOUBLE AS az1, CASE WHEN p_size % 2 = 0 THEN 0 ELSE (p_partkey % 10) * 3.0 END::DOUBLE AS el1, CASE WHEN p_size % 2 = 0 THEN (p_partkey % 10) * 4.0 ELSE 40 END::DOUBLE AS az2, CASE WHEN p_size % 2 = 0 THEN 40 ELSE (p_partkey % 10) * 3.0 END::DOUBLE AS el2 FROM part)"


def _cells(t):
    s, k = F.col("p_size") % 12, F.col("p_partkey") % 10
    return t("part").select((s * 100 + k).alias("cell"), (s * 3.0).alias("az"), (k * 3.0).alias("el")).distinct()


def _sweeps(t):
    even, k = F.col("p_size") % 2 == 0, F.col("p_partkey") % 10
    at = lambda a, b: F.when(even, a).otherwise(b).cast("double")
    return t("part").select((F.col("p_size") % 4).alias("direction"), k.alias("bin"), at(k * 4.0, F.lit(0)).alias("az1"), at(F.lit(0), k * 3.0).alias("el1"), at(k * 4.0, F.lit(40)).alias("az2"), at(F.lit(40), k * 3.0).alias("el2")).distinct()


def _gc(a1: str, e1: str, a2: str, e2: str) -> str:
    return f"(2 * asin(least(1.0, sqrt(pow(sin(radians({e2} - {e1}) / 2), 2) + cos(radians({e1})) * cos(radians({e2})) * pow(sin(radians({a2} - {a1}) / 2), 2)))))"


def _br(a1: str, e1: str, a2: str, e2: str) -> str:
    return f"atan2(sin(radians({a2} - {a1})) * cos(radians({e2})), cos(radians({e1})) * sin(radians({e2})) - sin(radians({e1})) * cos(radians({e2})) * cos(radians({a2} - {a1})))"


_COVER = f"(SELECT cell, direction, bin FROM {_CELLS}, {_SWEEPS} WHERE abs(degrees(asin(greatest(-1.0, least(1.0, sin({_gc('az1', 'el1', 'az', 'el')}) * sin({_br('az1', 'el1', 'az', 'el')} - {_br('az1', 'el1', 'az2', 'el2')})))))) < 1.7)"


@query("C11_grid_sweep_join", f"SELECT direction, bin, count(*) AS cells FROM {_COVER} GROUP BY direction, bin")
def _(t):
    return S.coverage(_cells(t), _sweeps(t), 1.7).groupBy("direction", "bin").agg(F.count(F.lit(1)).alias("cells"))


def _points(t):
    return t.spk.select("channel", (F.col("part") % 4).cast("int").alias("direction"), F.least(F.floor(F.col("t") * 10), F.lit(9)).alias("bin"))


def _map_sql(delays: str) -> str:
    return f"""WITH cover AS {_COVER}, cells AS (SELECT cell FROM {_CELLS}),
p AS (SELECT channel, part % 4 AS direction, least(floor(t * 10), 9)::BIGINT - delay AS bin, delay FROM spk, (VALUES {delays}) d(delay)),
g AS (SELECT DISTINCT channel, delay, direction FROM p WHERE bin >= 0),
r AS (SELECT g.*, b.bin, coalesce(n, 0)::DOUBLE AS rate FROM g CROSS JOIN range(10) b(bin) LEFT JOIN (SELECT channel, delay, direction, bin, count(*) AS n FROM p WHERE bin >= 0 GROUP BY ALL) c ON g.channel = c.channel AND g.delay = c.delay AND g.direction = c.direction AND b.bin = c.bin),
a AS (SELECT channel, delay, cell, direction, avg(rate) AS a FROM r JOIN cover USING (direction, bin) GROUP BY channel, delay, cell, direction),
q AS (SELECT channel, delay, avg(m) AS quiet FROM (SELECT channel, delay, direction, median(rate) AS m FROM r GROUP BY channel, delay, direction) GROUP BY channel, delay)
SELECT channel, delay, cell, avg(coalesce(a, quiet)) AS activity, stddev_pop(coalesce(a, quiet)) AS sd FROM g JOIN q USING (channel, delay) CROSS JOIN cells LEFT JOIN a USING (channel, delay, cell, direction) GROUP BY channel, delay, cell"""


@query("D22_grid_activity", f"SELECT channel, cell, round(activity, 5) AS activity, round(sd, 5) AS sd FROM ({_map_sql('(0)')})")
def _(t):
    cells = _cells(t)
    x = S.bar_map(_points(t), S.coverage(cells, _sweeps(t), 1.7), cells, [0], 10)
    return x.select("channel", "cell", F.round("activity", 5).alias("activity"), F.round("sd", 5).alias("sd"))


@query("N1_rf_bar_map", f"SELECT channel, delay::INT AS delay, cell, round(activity, 5) AS activity FROM ({_map_sql('(0), (1), (2), (3)')}) QUALIFY row_number() OVER (PARTITION BY channel ORDER BY round(activity, 5) DESC, delay, cell) = 1")
def _(t):
    cells = _cells(t)
    x = S.bar_map(_points(t), S.coverage(cells, _sweeps(t), 1.7), cells, [0, 1, 2, 3], 10)
    x = x.select("channel", "delay", "cell", F.round("activity", 5).alias("activity"))
    return A.best_of(x, ["channel"], "activity", ["delay", "cell"])


@query("D24_sparse_map", """WITH lit AS (SELECT DISTINCT p_partkey AS part, p_size % 20 AS cell, CASE WHEN p_partkey % 2 = 0 THEN 'on' ELSE 'off' END AS polarity FROM part),
g AS (SELECT channel, cell, polarity, avg(t) AS mean, stddev_pop(t) AS sd, count(*) AS n FROM spk JOIN lit USING (part) GROUP BY channel, cell, polarity)
SELECT channel, cell, polarity, round(mean, 9) AS mean, round(sd, 6) AS sd, n, round((mean - avg(mean) OVER w) / nullif(stddev_pop(mean) OVER w, 0), 6) AS z FROM g WINDOW w AS (PARTITION BY channel, polarity)""")
def _(t):
    lit = t("part").select(F.col("p_partkey").alias("trial"), (F.col("p_size") % 20).alias("cell"), F.when(F.col("p_partkey") % 2 == 0, "on").otherwise("off").alias("polarity"))
    x = S.sparse_map(t.spk.select("channel", F.col("part").alias("trial"), F.col("t").alias("value")), lit, ["channel"])
    return x.withColumns({"mean": F.round("mean", 9), "sd": r6("sd"), "z": r6("z")})


_CENTRES, _SIGMAS = [(x, y) for x in (1, 3, 5) for y in (1, 3, 5)], [1.0, 2.0, 4.0]
_GRID = "(VALUES " + ", ".join(f"({x}.0::DOUBLE, {y}.0::DOUBLE, {s}::DOUBLE)" for x, y in _CENTRES for s in _SIGMAS) + ") c(cx, cy, sigma)"
_SURF = "(SELECT channel, sample AS key, (sample % 8)::DOUBLE AS x, (sample // 8)::DOUBLE AS y, avg(value) AS z FROM sig GROUP BY channel, sample)"


def _surface(t):
    x = t.sig.groupBy("channel", F.col("sample").alias("key")).agg(F.avg("value").alias("z"))
    return x.select("channel", "key", (F.col("key") % 8).cast("double").alias("x"), F.floor(F.col("key") / 8).cast("double").alias("y"), "z")


def _fit_sql(source: str, by: str) -> str:
    return f"""SELECT {by}, cx, cy, sigma, round(amp, 5) AS amplitude, round(sse, 5) AS sse FROM (SELECT *, szz - sz * sz / n - coalesce(amp * (sgz - sg * sz / n), 0) AS sse FROM (SELECT *, (sgz - sg * sz / n) / nullif(sgg - sg * sg / n, 0) AS amp FROM (
  SELECT {by}, cx, cy, sigma, sum(w) AS n, sum(w * g) AS sg, sum(w * z) AS sz, sum(w * g * g) AS sgg, sum(w * g * z) AS sgz, sum(w * z * z) AS szz FROM (SELECT *, exp(-((x - cx) * (x - cx) + (y - cy) * (y - cy)) / (2 * sigma * sigma)) AS g FROM {source}, {_GRID}) GROUP BY {by}, cx, cy, sigma)))
QUALIFY row_number() OVER (PARTITION BY {by} ORDER BY round(sse, 9), cx, cy, sigma) = 1"""


@query("N2_gaussian_surface", _fit_sql(f"(SELECT *, 1.0::DOUBLE AS w FROM {_SURF})", "channel"))
def _(t):
    x = S.gaussian_search(_surface(t), ["channel"], _CENTRES, _SIGMAS)
    return x.select("channel", "cx", "cy", "sigma", (F.round("amplitude", 5) + F.lit(0.0)).alias("amplitude"), F.round("sse", 5).alias("sse"))


_ALONG, _WIDTHS = [4.0 * k for k in range(16)], S.log_spaced(1.0, 32.0, 6)


@query("N2_gaussian_curve", f"""SELECT channel, cx, round(sigma, 6) AS sigma, amplitude, sse FROM ({_fit_sql("(SELECT channel, sample::DOUBLE AS x, 0.0::DOUBLE AS y, avg(value) AS z, 1.0::DOUBLE AS w FROM sig GROUP BY channel, sample)", "channel").replace(_GRID, "(VALUES " + ", ".join(f"({c!r}::DOUBLE, 0.0::DOUBLE, {s!r}::DOUBLE)" for c in _ALONG for s in _WIDTHS) + ") c(cx, cy, sigma)")})""")
def _(t):
    """The Gaussian over time that fits each channel's mean best."""
    x = t.sig.groupBy("channel", "sample").agg(F.avg("value").alias("z")).select("channel", F.col("sample").cast("double").alias("x"), "z")
    got = S.curve_search(x, ["channel"], _ALONG, _WIDTHS)
    return got.select("channel", "cx", r6("sigma").alias("sigma"), (F.round("amplitude", 5) + F.lit(0.0)).alias("amplitude"), F.round("sse", 5).alias("sse"))


_BOOT = f"(SELECT *, CASE WHEN u < 0.3679 THEN 0 WHEN u < 0.7358 THEN 1 WHEN u < 0.9197 THEN 2 WHEN u < 0.981 THEN 3 ELSE 4 END::DOUBLE AS w FROM (SELECT *, ('0x' || substr(md5(boot || '#' || key), 1, 4))::INT / 65536 AS u FROM {_SURF}, range(1, 501) b(boot)))"


@query("N3_bootstrap_params", f"SELECT channel, round(avg(cx), 6) AS mean_cx, round(quantile_cont(sigma, 0.5), 6) AS median_sigma, count(*) AS n FROM ({_fit_sql(_BOOT, 'channel, boot')}) GROUP BY channel")
def _(t):
    x = S.bootstrap_search(_surface(t), ["channel"], "key", 500, _CENTRES, _SIGMAS)
    return x.groupBy("channel").agg(F.round(F.avg("cx"), 6).alias("mean_cx"), F.round(F.median("sigma"), 6).alias("median_sigma"), F.count(F.lit(1)).alias("n"))


@query("N4_rf_circles", "SELECT c_custkey, round(2 * cos(radians(el)) * sin(radians(r + 1) / 2), 6) AS radius, round(sin(radians(el)), 6) AS z FROM (SELECT c_custkey, (c_custkey % 80)::DOUBLE AS el, (1 + c_custkey % 5)::DOUBLE AS r FROM customer)")
def _(t):
    k = F.col("c_custkey")
    x = S.circles(t("customer").select("c_custkey", (k % 360).cast("double").alias("az"), (k % 80).cast("double").alias("el"), (1 + k % 5).cast("double").alias("r")))
    return x.select("c_custkey", r6("radius").alias("radius"), r6(F.col("centre.z")).alias("z"))


@query("N5_gaze_centred_polygons", "SELECT e.session, e.seq, round(e.value - g.value - 2, 6) AS left_x, round(e.value - g.value + 2, 6) AS right_x FROM (SELECT * FROM ev WHERE code = 3011) e ASOF JOIN (SELECT * FROM ev WHERE code = 1) g ON e.session = g.session AND e.us >= g.us")
def _(t):
    stimuli = t.ev.where("code = 3011").select("session", "us", "seq", "value")
    gaze = t.ev.where("code = 1").select("session", "us", F.col("value").alias("gaze"))
    x = J.asof_backward(stimuli, gaze, ["session"], "us", "us", ["gaze"]).where("gaze_found IS NOT NULL")
    q = G.corners(F.col("value") - F.col("gaze_found"), F.lit(0.0), F.lit(4.0), F.lit(3.0))
    return x.withColumn("q", q).select("session", "seq", r6(F.col("q")[2]["x"]).alias("left_x"), r6(F.col("q")[0]["x"]).alias("right_x"))


_SEEN = """(SELECT session, seq, us, k, value / 4 + [2, 2, -2, -2][k] AS ax, value / 8 + [-1.5, 1.5, 1.5, -1.5][k] AS ay, gx, gy FROM (
  SELECT e.session, e.seq, e.us, e.value, g.value / 5 AS gx, g.value / 9 AS gy, unnest([1, 2, 3, 4]) AS k FROM (SELECT * FROM ev WHERE code = 3011) e ASOF JOIN (SELECT * FROM ev WHERE code = 1) g ON e.session = g.session AND e.us <= g.us))"""


@query("N5_retinal_polygons", f"""SELECT p.session, p.seq, slot::INT AS slot, round::INT AS round, k::INT AS corner, round(x, 5) AS x, round(y, 5) AS y, round(z, 5) AS z FROM ({retinal_sql(_SEEN, 'session, seq, k')}) p
JOIN (SELECT session, seq, (row_number() OVER w - 1) % 5 AS slot, (row_number() OVER w - 1) // 5 AS round FROM ev WHERE code = 3011 WINDOW w AS (PARTITION BY session ORDER BY us, seq)) USING (session, seq)""")
def _(t):
    """Corners of every stimulus as the eye sees them under the next gaze, with the stimulus's slot among five."""
    stimuli = S.stimulus_slots(t.ev.where("code = 3011").select("session", "us", "seq", (F.col("value") / 4).alias("x"), (F.col("value") / 8).alias("y")), ["session"], ["us", "seq"])
    gaze = t.ev.where("code = 1").select("session", "us", (F.col("value") / 5).alias("gx"), (F.col("value") / 9).alias("gy"))
    seen = J.asof_forward(stimuli, gaze, ["session"], "us", "us", ["gx", "gy"]).where("us_found IS NOT NULL")
    polygons = S.gaze_centred(seen, "x", "y", 4.0, 3.0, "gx_found", "gy_found", EYE)
    x = polygons.select("session", "seq", "slot", "round", F.posexplode("polygon").alias("k", "p"))
    return x.select("session", "seq", "slot", "round", (F.col("k") + 1).alias("corner"), *[(F.round(f"p.{c}", 5) + F.lit(0.0)).alias(c) for c in "xyz"])


@query("N6_warp_outline", "SELECT p_partkey, n_nationkey AS point, round(u * p_size, 6) AS x, round(v * 3.0 + u * 2.0, 6) AS y FROM part, (SELECT n_nationkey, n_nationkey / 25 AS u, (n_nationkey * 7 % 25) / 25 AS v FROM nation)")
def _(t):
    s = F.col("p_size").cast("double")
    pt = lambda x, y: F.struct(x.alias("x"), F.lit(y).alias("y"))
    quad = F.array(pt(s * 0, 0.0), pt(s, 2.0), pt(s, 5.0), pt(s * 0, 3.0))
    outline = t("nation").select(F.col("n_nationkey").alias("point"), (F.col("n_nationkey") / 25).alias("u"), (F.col("n_nationkey") * 7 % 25 / 25).alias("v"))
    return S.warp_outline(t("part").select("p_partkey", quad.alias("q")), outline, "q").select("p_partkey", "point", r6("x").alias("x"), r6("y").alias("y"))


@query("C12_spatial_overlap", """SELECT p_partkey, p_size < 10 AS collapsed, p_size < 10 OR d < 1.5 AND 2.25 * acos(d / 1.5) - d * sqrt(2.25 - d * d) >= 0.1 * pi() * 2.25 AS inside_a, p_size < 10 AS inside_b
FROM (SELECT p_partkey, p_size, least((p_partkey % 16) / 10.0, 1.5) AS d FROM part)""")
def _(t):
    s = F.col("p_size").cast("double")
    box = lambda x: F.array(*[F.struct(F.lit(a).alias("x"), b.alias("y")) for a, b in ((x, s * 0), (x + 9.0, s * 0), (x + 9.0, s), (x, s))])
    x = t("part").select("p_partkey", (-(F.col("p_partkey") % 16) / 10).alias("x"), (s / 2).alias("y"), F.lit(1.5).alias("radius"), box(0.0).alias("a"), box(50.0).alias("b"))
    return S.overlaps(x, 0.1).select("p_partkey", "collapsed", "inside_a", "inside_b")


@query("N7_state_votes", """WITH g AS (SELECT session, min(us) + unnest(range(20)) * 86400000000 AS tick FROM ev GROUP BY session),
s AS (SELECT g.session, g.tick, coalesce(e.event_type, 'neither') AS kind FROM g ASOF LEFT JOIN ev e ON g.session = e.session AND g.tick >= e.us),
c AS (SELECT day, session % 6 AS area, count_if(kind NOT IN ('view', 'click')) AS n0, count_if(kind = 'view') AS n1, count_if(kind = 'click') AS n2 FROM (SELECT *, row_number() OVER (PARTITION BY session ORDER BY tick)::INT - 1 AS day FROM s) GROUP BY day, session % 6)
SELECT area, day, CASE WHEN n0 >= n1 AND n0 >= n2 THEN 'neither' WHEN n1 >= n2 THEN 'view' ELSE 'click' END AS winner FROM c""")
def _(t):
    starts = t.ev.groupBy("session").agg(F.min("us").alias("a"))
    grid = starts.select("session", F.posexplode(F.transform(F.sequence(F.lit(0), F.lit(19)), lambda k: F.col("a") + k * F.lit(86_400_000_000))).alias("day", "tick"))
    seen = J.asof_backward(grid, t.ev.select("session", "us", "event_type"), ["session"], "tick", "us", ["event_type"])
    kind = F.when(F.col("event_type_found").isin("view", "click"), F.col("event_type_found")).otherwise("neither")
    x = seen.withColumn("kind", kind).withColumn("area", F.col("session") % 6)
    return A.majority_vote(x, ["area", "day"], "kind", ["neither", "view", "click"]).select("area", "day", "winner")


_AREAS, _TICKS, _LONGEST, _GAP = [0, 1, 2, 3, 4], [6.0 * k for k in range(8)], 48.0, 2


@query("N7_overlap_raster", f"""WITH v AS (SELECT session, us, seq, code, sum((code = 3000)::INT) OVER w AS trial, sum((code = 3091)::INT) OVER w AS blocks FROM ev WINDOW w AS (PARTITION BY session ORDER BY us, seq)),
tr AS (SELECT session, trial, min(us) AS onset, min(blocks) AS block, CASE WHEN min(seq) % 11 <> 0 THEN CASE WHEN min(seq) % 2 = 0 THEN 'A' ELSE 'B' END END AS target,
  (min(us) FILTER (code = 1) - min(us)) / 3.6e9 AS "end", CASE WHEN min(us) FILTER (code = 2) < min(us) FILTER (code = 1) THEN 'wrong' ELSE 'correct' END AS outcome FROM v WHERE trial > 0 GROUP BY session, trial),
p AS (SELECT session, us, seq, trial FROM v WHERE code = 3011 AND trial > 0), h AS (SELECT session, us, CASE code WHEN 1 THEN 'A' ELSE 'B' END AS which FROM ev WHERE code IN (1, 2)),
n AS (SELECT p.*, CASE WHEN f.us IS NULL OR p.us - b.us <= f.us - p.us THEN b.which ELSE f.which END AS reached FROM p ASOF LEFT JOIN h b ON p.session = b.session AND p.us >= b.us ASOF LEFT JOIN h f ON p.session = f.session AND p.us <= f.us),
c AS (SELECT n_regionkey AS area, n_nationkey % 9 - 4 AS x, 1 + n_nationkey % 3 * 0.5::DOUBLE AS r FROM nation WHERE n_nationkey % 8 <> 7),
d AS (SELECT n.*, area, r, least(greatest(seq % 7 - 3 - x, -r), r) AS da, least(greatest(x - (seq % 5 - 2), -r), r) AS db, seq % 4 = 0 AS flat FROM n, c),
f AS (SELECT *, r * r * acos(da / r) - da * sqrt(r * r - da * da) >= 0.01 * pi() * r * r AS ia, r * r * acos(db / r) - db * sqrt(r * r - db * db) >= 0.01 * pi() * r * r AS ib FROM d),
o AS (SELECT f.*, (f.us - onset) / 3.6e9 AS t, CASE WHEN target IS NULL THEN 'neither' WHEN flat THEN CASE WHEN reached = target THEN 'target' WHEN reached IS NOT NULL THEN 'distractor' ELSE 'neither' END
  WHEN CASE target WHEN 'A' THEN ia ELSE ib END THEN 'target' WHEN ia OR ib THEN 'distractor' ELSE 'neither' END AS role FROM f JOIN tr USING (session, trial)),
s AS (SELECT session, trial, area, t, CASE WHEN count_if(role = 'neither') >= greatest(count_if(role = 'target'), count_if(role = 'distractor')) THEN 'neither' WHEN count_if(role = 'target') >= count_if(role = 'distractor') THEN 'target' ELSE 'distractor' END AS state FROM o GROUP BY session, trial, area, t),
k AS (SELECT *, coalesce("end" <= {_LONGEST}, false) AS shown, coalesce(block <> lag(block) OVER (PARTITION BY session ORDER BY trial), false) AS fresh FROM tr),
l AS (SELECT *, coalesce(sum(shown::INT) OVER (PARTITION BY session ORDER BY trial ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before, sum(fresh::INT) OVER (PARTITION BY session ORDER BY trial) AS gaps FROM k),
g AS (SELECT l.*, a.area, q.tick FROM l, (SELECT unnest({_AREAS}) AS area) a, (SELECT unnest({_TICKS})::DOUBLE AS tick) q),
first AS (SELECT session, trial, area, arg_min(state, t) AS state FROM s GROUP BY session, trial, area)
SELECT g.session, g.area, (before + {_GAP} * gaps)::BIGINT AS "row", g.trial::BIGINT AS trial, outcome, tick, CASE WHEN tick <= "end" THEN coalesce(s.state, first.state, 'neither') END AS state
FROM g ASOF LEFT JOIN s ON g.session = s.session AND g.trial = s.trial AND g.area = s.area AND g.tick >= s.t LEFT JOIN first ON g.session = first.session AND g.trial = first.trial AND g.area = first.area WHERE shown
UNION ALL SELECT session, area, (before + {_GAP} * (gaps - 1) + k.k)::BIGINT, NULL, 'gap', tick, NULL FROM g, range({_GAP}) k(k) WHERE fresh""")
def _(t):
    """Views are the time points at which 25 receptive fields (nations, in areas) meet two boxes; clicks and errors
    reach for A and B, and the first click is a trial's reward."""
    in_order = Window.partitionBy("session").orderBy("us", "seq")
    count = lambda code: F.sum((F.col("code") == code).cast("int")).over(in_order)
    v = t.ev.select("session", "us", "seq", "code", count(3000).alias("trial"), count(3091).alias("blocks")).where("trial > 0")
    hit = lambda code: F.min(F.when(F.col("code") == code, F.col("us")))
    target = F.when(F.min("seq") % 11 != 0, F.when(F.min("seq") % 2 == 0, "A").otherwise("B"))
    trials = v.groupBy("session", "trial").agg(
        F.min("us").alias("onset"), F.min("blocks").alias("block"), target.alias("target"), ((hit(1) - F.min("us")) / 3.6e9).alias("end"), F.when(hit(2) < hit(1), "wrong").otherwise("correct").alias("outcome")
    )
    reaches = t.ev.where("code in (1, 2)").select("session", "us", F.when(F.col("code") == 1, "A").otherwise("B").alias("which"))
    points = J.nearest(v.where("code = 3011").select("session", "us", "seq", "trial"), reaches, ["session"], "us", "us", "which").withColumnRenamed("nearest", "reached")
    points = points.join(trials.select("session", "trial", "onset", "target"), ["session", "trial"])
    k = F.col("n_nationkey")
    fields = t("nation").select(F.col("n_regionkey").alias("area"), (k % 9 - 4).cast("double").alias("x"), F.lit(0.0).alias("y"), F.when(k % 8 != 7, 1 + k % 3 * 0.5).alias("radius"))
    half = F.when(F.col("seq") % 4 == 0, 2.5).otherwise(30.0)
    left, right = (F.col("seq") % 7 - 3).cast("double"), (F.col("seq") % 5 - 2).cast("double")
    box = lambda a, b: F.array(*[F.struct(x.alias("x"), y.alias("y")) for x, y in ((a, -half), (b, -half), (b, half), (a, half))])
    points = points.withColumns({"t": (F.col("us") - F.col("onset")) / 3.6e9, "a": box(left, left + 40), "b": box(right - 40, right)})
    votes = S.overlap_votes(points, fields, ["session", "trial", "t", "seq"], _AREAS, 20.0)
    return S.overlap_raster(trials, S.vote_states(votes, ["session", "trial", "area", "t"]), ["session"], _AREAS, _TICKS, _LONGEST, _GAP)


_KERNEL = "(VALUES " + ", ".join(f"({k}, {math.exp(-k * k / 4)!r}::DOUBLE)" for k in range(-3, 4)) + ") k(k, h)"


@query("E11_decision_point", f"""WITH s AS (SELECT *, count(*) OVER (PARTITION BY session) AS n FROM seq), m AS (SELECT session, pos, n, 'click' AS cue, 1.0 AS s FROM s WHERE state = 'click' AND n > 30 UNION ALL SELECT session, pos, n, 'value', value / 100 FROM s WHERE value > 0 AND n > 30),
b AS (SELECT session, pos + k AS pos, n, cue, max(s * h) AS s FROM m, {_KERNEL} WHERE pos + k >= 0 AND pos + k < n GROUP BY session, pos + k, n, cue),
t AS (SELECT session, pos, CASE WHEN pos / n < 0.05 THEN sum(s) - 50 ELSE sum(s) * (1 - pos / n) END AS score FROM b GROUP BY session, pos, n)
SELECT session, pos AS decision, round(score, 6) AS score FROM t QUALIFY row_number() OVER (PARTITION BY session ORDER BY round(score, 9) DESC, pos) = 1""")
def _(t):
    cues = {"click": (F.col("state") == "click").cast("int"), "value": F.col("value") / 100}
    return K.decision_point(t.seq, ["session"], "pos", cues, 3, 4).withColumn("score", r6("score"))


def _r2(k: int) -> str:
    return f"""SELECT session, pos, CASE WHEN n = {k} AND cyy / {k} > 1e-12 THEN cxy * cxy / (cxx * cyy) ELSE 1 END AS r2 FROM (
  SELECT session, pos, count(*) OVER w AS n, sum(i * i) OVER w - pow(sum(i) OVER w, 2) / {k} AS cxx, sum(value * value) OVER w - pow(sum(value) OVER w, 2) / {k} AS cyy, sum(i * value) OVER w - sum(i) OVER w * sum(value) OVER w / {k} AS cxy
  FROM (SELECT *, (pos + 1)::DOUBLE AS i FROM seq) WINDOW w AS (PARTITION BY session ORDER BY pos ROWS BETWEEN CURRENT ROW AND {k - 1} FOLLOWING))"""


@query("E12_reaction_time", f"""WITH a AS ({_r2(5)}), b AS ({_r2(9)}), s AS (SELECT a.session, a.pos, round((1 - a.r2 + 1 - b.r2) * (1 - a.pos / count(*) OVER (PARTITION BY a.session)), 6) AS s FROM a JOIN b USING (session, pos)),
m AS (SELECT session, s AS score, pos FROM s QUALIFY row_number() OVER (PARTITION BY session ORDER BY s DESC, pos) = 1)
SELECT session, score, CASE WHEN score >= 0.001 AND score >= (SELECT quantile_cont(score, 0.05) FROM m) THEN pos END AS reaction FROM m""")
def _(t):
    return K.reaction_time(t.seq, ["session"], "pos", "value", [5, 9])


_TAPS = [0.25, 0.5, 0.25]


@query("E12_smoothed_reaction", "WITH seq AS (SELECT * REPLACE ((0.25 * coalesce(lag(value) OVER w, 0) + 0.5 * value + 0.25 * coalesce(lead(value) OVER w, 0)) / (CASE WHEN lag(value) OVER w IS NULL THEN 0 ELSE 0.25 END + 0.5 + CASE WHEN lead(value) OVER w IS NULL THEN 0 ELSE 0.25 END) AS value) FROM (SELECT session, row_number() OVER (PARTITION BY session ORDER BY us, seq) - 1 AS pos, value FROM ev) WINDOW w AS (PARTITION BY session ORDER BY pos)), " + f"""a AS ({_r2(5)}), b AS ({_r2(9)}), s AS (SELECT a.session, a.pos, round((1 - a.r2 + 1 - b.r2) * (1 - a.pos / count(*) OVER (PARTITION BY a.session)), 6) AS s FROM a JOIN b USING (session, pos)),
m AS (SELECT session, s AS score, pos FROM s QUALIFY row_number() OVER (PARTITION BY session ORDER BY s DESC, pos) = 1)
SELECT session, score, CASE WHEN score >= 0.001 AND score >= (SELECT quantile_cont(score, 0.05) FROM m) THEN pos END AS reaction FROM m""")
def _(t):
    return K.reaction_time(t.seq, ["session"], "pos", "value", [5, 9], taps=_TAPS)


@query("E18_median_subsample", "SELECT a.session, a.seq, round(median(b.value), 6) AS median, count(*) AS n FROM (SELECT * FROM ev WHERE code = 3011) a JOIN (SELECT * FROM ev WHERE code <> 3011) b ON a.session = b.session AND abs(a.us - b.us) <= 43200000000 GROUP BY a.session, a.seq")
def _(t):
    left = t.ev.where("code = 3011").select("session", "us", "seq")
    x = K.median_subsample(left, t.ev.where("code != 3011").select("session", "us", "value"), ["session"], "us", "us", "value", 86_400_000_000)
    return x.select("session", "seq", r6("median").alias("median"), "n")


class _Recording:
    """The events as they would come in: consecutive days one after another, a folder for the marker that ends the
    recording, and a stream over both, in a session of its own, that takes what is there at once."""

    def __init__(self, t, parts: int = 2):
        self.out = new_dir(t.spark, "stream")
        self.spark = T.session_for(t.spark)
        self.schema = t("events").schema
        self.parts = T.deliver(t("events"), "ts", f"{self.out}/feed", parts)
        t("events").limit(0).write.parquet(f"{self.out}/feed/end")
        self.stream = T.events_stream(self.spark, f"{self.out}/feed/*", self.schema, None).withColumn("ts", F.col("ts").cast("timestamp"))
        self.checkpoint = f"{self.out}/checkpoint"

    def end(self, after: dt.datetime | None, by: dt.timedelta) -> None:
        if after:
            T.end_marker(self.spark, f"{self.out}/feed/end", self.schema, "ts", after, by)


_DAY = dt.timedelta(days=1)


def _drained(t, result, lateness: dt.timedelta, run=T.drain) -> str:
    """What a stream of the recording gives, in its sink, when all of it came and its end was marked."""
    own = _Recording(t)
    sink = f"{own.out}/sink"
    seen = [run(result(own.stream), sink, own.checkpoint) for _ in own.parts]
    own.end(max(filter(None, seen), default=None), lateness)
    run(result(own.stream), sink, own.checkpoint)
    return sink


@query("T1_stream_ingest", "SELECT event_id, user_id, event_type FROM events WHERE ts IS NOT NULL")
def _(t):
    """Days that come in three runs, the last with those delivered before: each event is kept once."""
    own = _Recording(t)
    once = T.ingest(own.stream, "event_id", "ts", "3 days").select("event_id", "user_id", "event_type")
    for part in own.parts:
        T.drain(once, f"{own.out}/sink", own.checkpoint)
    t.spark.read.schema(own.schema).parquet(part).write.parquet(f"{own.out}/feed/again")
    T.drain(once, f"{own.out}/sink", own.checkpoint)
    return t.spark.read.schema("event_id bigint, user_id bigint, event_type string").parquet(f"{own.out}/sink")


def _trials(t, longest: dt.timedelta):
    code = F.when(F.col("event_type") == "signup", 3000).when(F.col("event_type") == "purchase", 3091).otherwise(0)
    us = F.unix_micros(F.col("ts")) - F.lit(1_704_067_200_000_000)

    def result(stream):
        x = stream.select(F.col("user_id").alias("session"), "ts", us.alias("us"), F.col("event_id").alias("seq"), code.alias("code"))
        return T.segment(x, "session", "ts", "us", "seq", "code", 3000, 3091, "1 day", longest)

    return t.spark.read.schema("session long, start long, stop long, complete boolean").parquet(_drained(t, result, 2 * _DAY + longest))


@query("T2_stream_segment", """WITH m AS (SELECT *, sum((code = 3000)::INT) OVER (PARTITION BY session ORDER BY us, seq) AS g FROM ev WHERE code IN (3000, 3091))
SELECT session, min(CASE WHEN code = 3000 THEN us END) AS "start", min(CASE WHEN code = 3091 THEN us END) AS "stop" FROM m WHERE g > 0 GROUP BY session, g HAVING count_if(code = 3091) > 0""")
def _(t):
    return _trials(t, 60 * _DAY).where("complete").drop("complete")


@query("T2_stream_trials", """SELECT session, us AS "start", CASE WHEN closed THEN stop END AS "stop", closed AS complete FROM (SELECT *, coalesce(after = 3091 AND stop // 1000 - us // 1000 <= 172800000, false) AS closed FROM (
  SELECT *, lead(code) OVER w AS after, lead(us) OVER w AS stop FROM ev WHERE code IN (3000, 3091) WINDOW w AS (PARTITION BY session ORDER BY us, seq)) WHERE code = 3000)""")
def _(t):
    """All trials, those that no stop followed within two days or before the next start as incomplete ones."""
    return _trials(t, 2 * _DAY)


_HOUR = "yyyy-MM-dd HH"


def _rates(t, slide: str | None):
    keys = ["window_start", "event_type"]
    sink = _drained(t, lambda x: T.rates(x, "ts", "6 hours", "1 day", ["event_type"], slide), 2 * _DAY, T.upsert)
    # the marker's own window has no group
    return T.latest(t.spark, sink, keys).where("event_type IS NOT NULL").withColumn("window_start", F.date_format("window_start", _HOUR))


@query("T3_stream_rate", "SELECT strftime(time_bucket(INTERVAL 6 HOURS, ts), '%Y-%m-%d %H') AS window_start, event_type, count(*) AS n FROM events GROUP BY ALL")
def _(t):
    return _rates(t, None)


@query("T3_sliding_rate", "SELECT strftime(time_bucket(INTERVAL 2 HOURS, ts) - to_hours(2 * k), '%Y-%m-%d %H') AS window_start, event_type, count(*) AS n FROM events, range(3) r(k) GROUP BY ALL")
def _(t):
    return _rates(t, "2 hours")


@query("T3_burst_rate", """SELECT user_id, round(epoch(min(ts)))::BIGINT AS begins, round(epoch(max(ts)))::BIGINT + 14400 AS ends, count(*) AS n FROM (SELECT *, sum(f) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS run FROM (
  SELECT *, coalesce(ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) > INTERVAL 4 HOURS, true)::INT AS f FROM events)) GROUP BY user_id, run""")
def _(t):
    """Bursts leave the stream once each, when the watermark has passed them; the end marker's own is never passed."""
    sink = _drained(t, lambda x: T.burst_rates(x, "ts", "4 hours", "1 day", ["user_id"]), 2 * _DAY)
    at = lambda c: F.round(F.unix_millis(c) / 1000).cast("long")
    kept = t.spark.read.schema("user_id long, window_start timestamp, window_end timestamp, n long").parquet(sink)
    return kept.select("user_id", at("window_start").alias("begins"), at("window_end").alias("ends"), "n")
