"""Queries of sections H (scalar functions) and I (statistics)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import geometry as G
from ..functions import scalars as X
from ..operators import aggregates as A
from ..operators import joins as J
from ..operators import statistics as S
from ..operators import windows as W
from .registry import query, r6

_AE = "SELECT c_custkey AS id, (c_custkey * 7 % 360 - 180)::DOUBLE AS az, (c_custkey * 13 % 170 - 85)::DOUBLE AS el, 1 + c_custkey % 3 AS r FROM customer"


def _ae(t):
    k = F.col("c_custkey")
    return t("customer").select(k.alias("id"), (k * 7 % 360 - 180).cast("double").alias("az"), (k * 13 % 170 - 85).cast("double").alias("el"), (1 + k % 3).alias("r"))


_XYZ = f"SELECT id, az, el, r, r * cos(radians(el)) * cos(radians(az)) AS x, r * cos(radians(el)) * sin(radians(az)) AS y, r * sin(radians(el)) AS z FROM ({_AE})"


@query("H1_spherical", f"SELECT id, round(x, 6) AS x, round(y, 6) AS y, round(z, 6) AS z, round(degrees(asin(z / sqrt(x*x + y*y + z*z))), 6) AS elevation, CASE WHEN el >= 0 THEN 90 - el ELSE -90 - el END AS folded FROM ({_XYZ})")
def _(t):
    p = G.sphere_to_cartesian(F.col("az"), F.col("el"), F.col("r"))
    x = _ae(t).withColumn("p", p)
    return x.select("id", *[r6(F.col(f"p.{c}")).alias(c) for c in "xyz"], r6(G.cartesian_to_sphere(F.col("p"))["elevation"]).alias("elevation"), G.relative_elevation(F.col("el")).alias("folded"))


@query("H2_sphere_intersect", f"""SELECT id, round(0.1 + s * x / r, 6) AS x, round(0.2 + s * y / r, 6) AS y, round(s * z / r, 6) AS z FROM (SELECT *, (-b + sqrt(b * b - 4 * (0.05 - 4))) / 2 AS s FROM (SELECT *, 2 * (0.1 * x / r + 0.2 * y / r) AS b FROM ({_XYZ})))""")
def _(t):
    d = G.normalize(G.sphere_to_cartesian(F.col("az"), F.col("el"), F.col("r")))
    o = F.struct(F.lit(0.1).alias("x"), F.lit(0.2).alias("y"), F.lit(0.0).alias("z"))
    x = _ae(t).withColumn("p", G.sphere_intersect(o, d, F.lit(2.0)))
    return x.select("id", *[r6(F.col(f"p.{c}")).alias(c) for c in "xyz"])


@query("H3_rotation", f"""SELECT id, round(x * cos(radians(30)) - y * sin(radians(30)), 6) AS x, round(x * sin(radians(30)) + y * cos(radians(30)), 6) AS y, round(z, 6) AS z FROM ({_XYZ})""")
def _(t):
    p = G.sphere_to_cartesian(F.col("az"), F.col("el"), F.col("r"))
    axis = F.struct(F.lit(0.0).alias("x"), F.lit(0.0).alias("y"), F.lit(1.0).alias("z"))
    x = _ae(t).withColumn("p", G.rotate(p, axis, F.lit(30.0)))
    return x.select("id", *[r6(F.col(f"p.{c}")).alias(c) for c in "xyz"])


_EYE = (1.5, 2.9, -13.8)
_DOME = f"SELECT id, az / 2 AS ax, el / 2 AS ay, az / 9 AS gx, el / 5 AS gy FROM ({_AE})"


def _dome(t):
    return _ae(t).select("id", (F.col("az") / 2).alias("ax"), (F.col("el") / 2).alias("ay"), (F.col("az") / 9).alias("gx"), (F.col("el") / 5).alias("gy"))


def _eye():
    return F.struct(*[F.lit(v).alias(n) for n, v in zip("xyz", _EYE)])


@query("H1_relative_elevation", f"SELECT id, el AS elevation, CASE WHEN el >= 0 THEN 90 - el ELSE -90 - el END AS folded FROM ({_AE})")
def _(t):
    x = _ae(t).withColumn("folded", G.relative_elevation(F.col("el")))
    return x.select("id", G.from_relative_elevation(F.col("folded")).alias("elevation"), "folded")


@query("H2_dome_transforms", f"""WITH p AS (SELECT *, 60 * cos(radians(ay)) * sin(radians(ax)) AS x, 60 * sin(radians(ay)) AS y, 60 * cos(radians(ay)) * cos(radians(ax)) AS z FROM ({_DOME})),
r AS (SELECT *, tan(radians(gx)) * 73.8 AS dx, tan(radians(gy)) * 73.8 AS dy FROM p), n AS (SELECT *, sqrt(dx * dx + dy * dy + 73.8 * 73.8) AS l FROM r),
b AS (SELECT *, dx / l AS ux, dy / l AS uy, 73.8 / l AS uz, 2 * ({_EYE[0]} * dx + {_EYE[1]} * dy + {_EYE[2]} * 73.8) / l AS b FROM n),
s AS (SELECT *, (-b + sqrt(b * b - 4 * ({_EYE[0] ** 2 + _EYE[1] ** 2 + _EYE[2] ** 2!r} - 3600))) / 2 AS s FROM b)
SELECT id, round(x, 6) AS x, round(y, 6) AS y, round(z, 6) AS z, round(ax, 6) AS back_x, round(ay, 6) AS back_y, CASE WHEN abs(ax) < 89 THEN round(x * 40 / z, 6) END AS plane_x, CASE WHEN abs(ax) < 89 THEN round(y * 40 / z, 6) END AS plane_y,
  round(degrees(atan(x / z)), 6) AS flat_x, round(90 - degrees(atan2({_EYE[2]} + s * uz, {_EYE[0]} + s * ux)), 6) AS seen_x, round(degrees(asin(({_EYE[1]} + s * uy) / 60)), 6) AS seen_y FROM s""")
def _(t):
    p, plane = F.col("p"), F.col("plane")
    x = _dome(t).withColumn("p", G.dome_to_cartesian(F.col("ax"), F.col("ay"))).withColumn("plane", F.when(F.abs("ax") < 89, G.project_to_plane(F.col("p"), 40.0)))
    x = x.withColumns({"back": G.cartesian_to_dome(p), "flat": G.flat_angles(p), "seen": G.eye_to_dome(F.col("gx"), F.col("gy"), _eye())})
    return x.select("id", *[r6(p[c]).alias(c) for c in "xyz"], *[r6(F.col(f"{n}.{c}")).alias(f"{n}_{c}") for n in ("back", "seen") for c in "xy"], r6(plane["x"]).alias("plane_x"), r6(plane["y"]).alias("plane_y"), r6("flat.x").alias("flat_x"))


def retinal_sql(source: str, keep: str) -> str:
    """Directions (x, y, z) and retinal angles of the dome's points (ax, ay) of a source under its gazes (gx, gy)."""
    ex, ey, ez = _EYE
    return f"""SELECT {keep}, rx AS x, ry AS y, rz AS z, 90 - degrees(asin(greatest(-1, least(1, rz)))) AS eccentricity, degrees(atan2(ry, rx)) AS polar FROM (
  SELECT *, CASE WHEN hk = 0 THEN vx ELSE vx * c + ky * vz * s + kx * (kx * vx + ky * vy) * (1 - c) END AS rx, CASE WHEN hk = 0 THEN vy ELSE vy * c - kx * vz * s + ky * (kx * vx + ky * vy) * (1 - c) END AS ry, CASE WHEN hk = 0 THEN vz ELSE vz * c + (kx * vy - ky * vx) * s END AS rz FROM (
  SELECT *, ux / u AS vx, uy / u AS vy, uz / u AS vz, hy / nullif(hk, 0) AS kx, -hx / nullif(hk, 0) AS ky, hz AS c, sqrt(1 - hz * hz) AS s FROM (
  SELECT *, sqrt(ux * ux + uy * uy + uz * uz) AS u, sqrt(hx * hx + hy * hy) AS hk FROM (
  SELECT *, 60 * cos(radians(ay)) * sin(radians(ax)) - {ex} AS ux, 60 * sin(radians(ay)) - {ey} AS uy, 60 * cos(radians(ay)) * cos(radians(ax)) - {ez} AS uz,
    cos(radians(gy)) * sin(radians(gx)) AS hx, sin(radians(gy)) AS hy, cos(radians(gy)) * cos(radians(gx)) AS hz FROM {source}))))"""


@query("H3_retinal_transforms", f"SELECT id, round(eccentricity, 5) AS eccentricity, round(polar, 4) AS polar, round(x, 5) AS x, round(y, 5) AS y, round(z, 5) AS z FROM ({retinal_sql(f'({_DOME})', 'id')})")
def _(t):
    x = _dome(t).withColumn("r", G.dome_to_eye(F.col("ax"), F.col("ay"), F.col("gx"), F.col("gy"), _eye()))
    x = x.withColumn("p", G.retinal_to_cartesian(F.col("r.eccentricity"), F.col("r.polar")))
    return x.select("id", F.round("r.eccentricity", 5).alias("eccentricity"), (F.round("r.polar", 4) + F.lit(0.0)).alias("polar"), *[(F.round(f"p.{c}", 5) + F.lit(0.0)).alias(c) for c in "xyz"])


@query("H4_stimulus_corners", "SELECT p_partkey, (p_size - 2.0)::DOUBLE AS x0, (p_retailprice / 100 + 1.5)::DOUBLE AS y1, (p_size + 2.0)::DOUBLE AS x2 FROM part")
def _(t):
    q = G.reorder(G.corners(F.col("p_size").cast("double"), F.col("p_retailprice") / 100, F.lit(4.0), F.lit(3.0)))
    return t("part").withColumn("q", q).select("p_partkey", F.col("q")[0]["x"].alias("x0"), F.col("q")[2]["y"].alias("y1"), F.col("q")[1]["x"].alias("x2"))


_HAV = "degrees(2 * asin(least(1.0, sqrt(pow(sin(radians(b.el - a.el) / 2), 2) + cos(radians(a.el)) * cos(radians(b.el)) * pow(sin(radians(b.az - a.az) / 2), 2)))))"


@query("H5_great_circle", f"SELECT a.id, round({_HAV}, 5) AS distance, round(degrees(atan2(sin(radians(b.az - a.az)) * cos(radians(b.el)), cos(radians(a.el)) * sin(radians(b.el)) - sin(radians(a.el)) * cos(radians(b.el)) * cos(radians(b.az - a.az)))), 5) AS bearing FROM ({_AE}) a JOIN ({_AE}) b ON b.id = a.id + 1")
def _(t):
    a = _ae(t)
    b = a.select((F.col("id") - 1).alias("id"), F.col("az").alias("az2"), F.col("el").alias("el2"))
    args = [F.col(c) for c in ("az", "el", "az2", "el2")]
    return a.join(b, "id").select("id", F.round(G.great_circle(*args), 5).alias("distance"), (F.round(G.bearing(*args), 5) + F.lit(0.0)).alias("bearing"))


@query("H6_polygon_area", "SELECT p_partkey, round((p_size * 3.0 + p_size * 0.5)::DOUBLE, 6) AS area, p_size < 10 AS collapsed FROM part")
def _(t):
    s = F.col("p_size").cast("double")
    pt = lambda x, y: F.struct(x.alias("x"), y.alias("y"))
    quad = F.array(pt(F.lit(0.0), F.lit(0.0)), pt(F.lit(3.0), F.lit(0.0)), pt(F.lit(4.0), s), pt(F.lit(0.0), s))
    return t("part").withColumn("q", quad).select("p_partkey", r6(G.polygon_area(F.col("q"))).alias("area"), G.is_collapsed(F.col("q")).alias("collapsed"))


@query("H6_circle_in_square", "SELECT p_partkey, round(pi() * pow(least(p_size, 45) / 10.0, 2) / 4, 5) AS quarter FROM part")
def _(t):
    r = F.least(F.col("p_size"), F.lit(45)) / 10
    pt = lambda x, y: F.struct(F.lit(x).alias("x"), F.lit(y).alias("y"))
    quad = F.array(pt(0.0, 0.0), pt(9.0, 0.0), pt(9.0, 9.0), pt(0.0, 9.0))
    return t("part").select("p_partkey", F.round(G.circle_polygon_area(F.lit(0.0), F.lit(0.0), r, quad), 5).alias("quarter"))


@query("H7_code_words", "SELECT l_orderkey, l_linenumber, count(*) AS n, max((l_suppkey % 256) * 256 + l_partkey % 256)::BIGINT AS word, max((l_partkey + 32768) % 32768)::BIGINT AS stripped FROM lineitem GROUP BY ALL")
def _(t):
    x = t("lineitem")
    word = X.combine_words(F.col("l_suppkey"), F.col("l_partkey"))
    return x.groupBy("l_orderkey", "l_linenumber").agg(F.count(F.lit(1)).alias("n"), F.max(word).alias("word"), F.max(X.strip_strobe(F.col("l_partkey") + 32768)).alias("stripped"))


_STROBES = """WITH w AS (SELECT l_orderkey, l_linenumber, min((l_suppkey % 256) * 256 + l_partkey % 256) AS word, bool_or(l_quantity > 25) AS s FROM lineitem GROUP BY ALL),
x AS (SELECT *, lag(l_linenumber) OVER o AS t1, lag(word) OVER o AS w1, lag(word, 2) OVER o AS w2, row_number() OVER o AS k FROM w WINDOW o AS (PARTITION BY l_orderkey ORDER BY l_linenumber)),
y AS (SELECT *, s AND k > 1 AS hit FROM x), z AS (SELECT *, bool_or(hit) OVER p AS any_hit, bool_or(hit AND w1 > 32768) OVER p AS wrong, min(CASE WHEN hit THEN k END) OVER p AS first FROM y WINDOW p AS (PARTITION BY l_orderkey))"""


def _strobes(t, repair):
    word = X.combine_words(F.col("l_suppkey"), F.col("l_partkey"))
    x = t("lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.min(word).alias("word"), F.max(F.col("l_quantity") > 25).alias("s"))
    return W.words_at_strobes(x, ["l_orderkey"], "l_linenumber", "word", F.col("s"), repair)


@query("H7_strobe_words", f"{_STROBES} SELECT l_orderkey, CASE WHEN hit AND wrong THEN l_linenumber WHEN hit THEN t1 ELSE l_linenumber END AS l_linenumber, CASE WHEN hit AND wrong THEN word - 32768 WHEN hit THEN w1 ELSE word END AS word FROM z WHERE hit OR NOT any_hit")
def _(t):
    """Words with the strobe bit make their group take the words of the strobe rows."""
    return _strobes(t, "strobe")


@query("H7_shifted_words", f"{_STROBES}, e AS (SELECT *, CASE WHEN w2 > 32768 AND k = first THEN w2 - 32768 ELSE w2 END AS w3 FROM z) SELECT l_orderkey, CASE WHEN hit THEN t1 ELSE l_linenumber END AS l_linenumber, CASE WHEN hit AND w1 > 32768 THEN CASE WHEN w3 <= 32768 THEN w3 END WHEN hit THEN w1 ELSE word END AS word FROM e WHERE hit OR NOT any_hit")
def _(t):
    """Words with the strobe bit are taken one row earlier."""
    return _strobes(t, "shift")


@query("H8_iso_dates", "SELECT o_orderkey, strftime(o_orderdate, '%Y%m%d') AS day, strftime(o_orderdate, '%H%M%S') AS time, strftime(o_orderdate, '%Y_%m_%d') AS dashed FROM orders")
def _(t):
    iso = F.concat(F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss"), F.lit("Z"))
    x = t("orders").select("o_orderkey", X.iso_parts(iso).alias("p"))
    return x.select("o_orderkey", "p.day", "p.time", X.dashed_day(F.col("p.day")).alias("dashed"))


@query("H9_grids", "SELECT n_nationkey, round(list_sum(list_transform(range(5), lambda k: n_nationkey + (10.0 - n_nationkey) * k / 4)), 6) AS total, 12::INT AS cells, (n_nationkey + 3) // 3 + CASE WHEN (n_nationkey + 3) % 3 > 0 THEN 1 ELSE 0 END AS first_part FROM nation")
def _(t):
    n = F.col("n_nationkey")
    total = F.aggregate(X.linspace(n.cast("double"), F.lit(10.0), 5), F.lit(0.0), lambda a, b: a + b)
    mesh = X.meshgrid(F.sequence(F.lit(1), F.lit(4)), F.sequence(F.lit(1), F.lit(3)))
    parts = X.array_split(F.sequence(F.lit(1), n + 3), 3)
    return t("nation").select("n_nationkey", r6(total).alias("total"), F.size(mesh).alias("cells"), F.size(parts[0]).alias("first_part"))


@query("H10_json", "SELECT event_id, (props->>'k')::INT AS k FROM events")
def _(t):
    return t("events").select("event_id", F.from_json("props", "k int")["k"].alias("k"))


@query("H11_math", "SELECT event_id, CASE WHEN value > 0 THEN round(10 * log10(value), 6) END AS db, least(greatest(value, 10.0), 60.0) AS clipped, round(exp(-pow((value - 50) / 20, 2) / 2) / (20 * 2.5066282746310002), 6) AS density, round(value / 200 + 0.5, 6) AS rescaled FROM events")
def _(t):
    v = F.col("value")
    return t("events").select("event_id", r6(X.decibel(v)).alias("db"), X.clip(v, 10.0, 60.0).alias("clipped"), r6(X.normal_density(v, F.lit(50.0), F.lit(20.0))).alias("density"), r6(X.rescale(v, F.lit(0.0), F.lit(100.0))).alias("rescaled"))


def _perm_sql(n: int, units: str, family: str) -> str:
    """units: a query of (family, trial, sample, own, v)."""
    f = f"{family}, " if family else ""
    return f"""WITH u AS ({units}),
l AS (SELECT {f}trial, bool_or(own) AS own FROM u GROUP BY {f}trial),
n AS (SELECT *, count_if(own) OVER ({f"PARTITION BY {family}" if family else ""}) AS n1 FROM l),
p AS (SELECT {f}trial, perm, CASE WHEN perm = 0 THEN own ELSE row_number() OVER (PARTITION BY {f}perm ORDER BY md5(perm || '#' || trial), trial) <= n1 END AS one FROM n, range({n + 1}) r(perm)),
d AS (SELECT {f}perm, sample, avg(CASE WHEN one THEN v END) - avg(CASE WHEN NOT one THEN v END) AS diff FROM u JOIN p USING ({f}trial) GROUP BY {f}perm, sample),
e AS (SELECT {f}perm, max(diff) AS hi, min(diff) AS lo FROM d WHERE perm > 0 GROUP BY {f}perm),
m AS (SELECT {f}quantile_cont(hi, 0.975) AS upper, quantile_cont(lo, 0.025) AS lower FROM e {f"GROUP BY {family}" if family else ""})
SELECT {f}sample, round(diff, 6) AS diff, round(upper, 6) AS upper, round(lower, 6) AS lower, diff > upper OR diff < lower AS significant FROM d {f"JOIN m USING ({family})" if family else ", m"} WHERE perm = 0"""


@query("I1_permutation_test", _perm_sql(1000, "SELECT trial, sample, any_value(state) = 0 AS own, avg(value) AS v FROM sig_nan GROUP BY trial, sample HAVING avg(value) IS NOT NULL", ""))
def _(t):
    """State 0 against all others, all channels together."""
    units = t.sig_nan.groupBy("trial", "sample").agg(F.max("state").alias("state"), F.avg("value").alias("v"))
    x = S.permutation_test(units, F.col("state") == 0, "trial", "sample", "v", 1000)
    return x.withColumns({n: r6(n) for n in ("diff", "upper", "lower")})


_FAMILY = """SELECT level, area, s1, s2, trial, sample, state = s1 AS own, v FROM (
  SELECT level, area, trial, sample, any_value(state) AS state, avg(value) AS v FROM (
    SELECT *, unnest(['channel', 'array', 'merged']) AS level, unnest([channel::VARCHAR, array_id::VARCHAR, CASE WHEN array_id <= 2 THEN 'fovea' ELSE 'periphery' END]) AS area FROM sig_nan)
  GROUP BY level, area, trial, sample HAVING avg(value) IS NOT NULL)
JOIN (SELECT a.state AS s1, b.state AS s2 FROM (SELECT DISTINCT state FROM sig) a JOIN (SELECT DISTINCT state FROM sig) b ON a.state < b.state) ON state IN (s1, s2)"""


@query("I2_permutation_family", _perm_sql(1000, _FAMILY, "level, area, s1, s2"))
def _(t):
    """Every pair of states, in every channel, array and merged area."""
    levels = {"channel": F.col("channel").cast("string"), "array": F.col("array_id").cast("string"), "merged": F.when(F.col("array_id") <= 2, "fovea").otherwise("periphery")}
    rows = t.sig_nan.withColumn("_a", F.explode(F.array(*[F.struct(F.lit(n).alias("level"), c.alias("area")) for n, c in levels.items()])))
    units = rows.groupBy("_a.level", "_a.area", "trial", "sample").agg(F.max("state").alias("state"), F.avg("value").alias("v"))
    pairs = J.pairs(t.sig, "state").select(F.col("first").alias("s1"), F.col("second").alias("s2"), F.explode(F.array("first", "second")).alias("state"))
    x = S.permutation_test(units.join(pairs, "state"), F.col("state") == F.col("s1"), "trial", "sample", "v", 1000, family=["level", "area", "s1", "s2"])
    return x.withColumns({n: r6(n) for n in ("diff", "upper", "lower")})


_UPPER = "t * (0.254829592 + t * (-0.284496736 + t * (1.421413741 + t * (-1.453152027 + t * 1.061405429)))) * exp(-x * x) / 2"


@query("I3_mann_whitney_pairs", f"""WITH s AS (SELECT state, count(rt) AS n FROM tr GROUP BY state), pr AS (SELECT a.state AS g1, a.n AS n1, b.state AS g2, b.n AS n2 FROM s a JOIN s b ON a.state < b.state WHERE a.n > 3 AND b.n > 3),
x AS (SELECT g1, n1, g2, n2, state, rank() OVER w + (count(*) OVER (PARTITION BY g1, g2, rt) - 1) / 2 AS rk FROM pr JOIN tr ON state IN (g1, g2) WINDOW w AS (PARTITION BY g1, g2 ORDER BY rt)),
u AS (SELECT g1, n1, g2, n2, sum(CASE WHEN state = g1 THEN rk END) - n1 * (n1 + 1) / 2 AS u FROM x GROUP BY g1, n1, g2, n2),
z AS (SELECT *, (u - n1 * n2 / 2) / sqrt(n1 * n2 * (n1 + n2 + 1) / 12) AS z, count(*) OVER () AS m FROM u),
q AS (SELECT *, abs(z) / 1.4142135623730951 AS x, 1 / (1 + 0.3275911 * abs(z) / 1.4142135623730951) AS t FROM z)
SELECT g1, n1::BIGINT AS n1, g2, n2::BIGINT AS n2, u, round(z, 6) AS z, round(least(1.0, 2 * {_UPPER} * m), 6) AS p, least(1.0, 2 * {_UPPER} * m) < 0.05 AS significant FROM q""")
def _(t):
    x = S.mann_whitney(t.tr, "state", "rt")
    return x.withColumns({n: r6(n) for n in ("z", "p")})


@query("I3_exact_pairs", f"""WITH RECURSIVE w AS (SELECT 0 AS i, 0 AS size, 0 AS s, 1.0::DOUBLE AS ways UNION ALL SELECT i + 1, size, s, sum(ways) FROM (SELECT i, size, s, ways FROM w WHERE i < 38 UNION ALL SELECT i, size + 1, s + i + 1, ways FROM w WHERE i < 38 AND size < 19) GROUP BY i, size, s),
a AS (SELECT s_nationkey AS g, s_acctbal AS v FROM supplier), c AS (SELECT g, count(v) AS n FROM a GROUP BY g), pr AS (SELECT a.g AS g1, a.n AS n1, b.g AS g2, b.n AS n2 FROM c a JOIN c b ON a.g < b.g WHERE a.n > 3 AND b.n > 3),
x AS (SELECT g1, n1, g2, n2, g, count(*) OVER (PARTITION BY g1, g2, v) AS k, rank() OVER o + (count(*) OVER (PARTITION BY g1, g2, v) - 1) / 2 AS rk FROM pr JOIN a ON g IN (g1, g2) WINDOW o AS (PARTITION BY g1, g2 ORDER BY v)),
u AS (SELECT g1, n1, g2, n2, max(k) AS tied, sum(CASE WHEN g = g1 THEN rk END) - n1 * (n1 + 1) / 2 AS u FROM x GROUP BY g1, n1, g2, n2),
z AS (SELECT *, (u - n1 * n2 / 2) / sqrt(n1 * n2 * (n1 + n2 + 1) / 12) AS z, count(*) OVER () AS m FROM u),
e AS (SELECT g1, g2, 2 * least(sum(CASE WHEN s - n1 * (n1 + 1) / 2 <= u THEN ways ELSE 0 END), sum(CASE WHEN s - n1 * (n1 + 1) / 2 >= u THEN ways ELSE 0 END)) / sum(ways) AS exact FROM z JOIN w ON i = n1 + n2 AND size = n1 WHERE n1 < 20 AND n2 < 20 AND tied = 1 GROUP BY g1, g2),
q AS (SELECT z.*, least(exact, 1.0) AS exact, abs(z) / 1.4142135623730951 AS x, 1 / (1 + 0.3275911 * abs(z) / 1.4142135623730951) AS t FROM z LEFT JOIN e USING (g1, g2))
SELECT g1, n1::BIGINT AS n1, g2, n2::BIGINT AS n2, u, round(least(1.0, coalesce(exact, 2 * {_UPPER}) * m), 6) AS p FROM q""")
def _(t):
    """Nations' suppliers by balance, with the exact law where both nations have fewer than 20."""
    x = S.mann_whitney(t("supplier").select(F.col("s_nationkey").alias("g"), "s_acctbal"), "g", "s_acctbal", exact_below=20)
    return x.select("g1", "n1", "g2", "n2", "u", r6("p").alias("p"))


def _z_sql(source: str, group: str, hit: str, n: int) -> str:
    z = lambda k: f"(({k}) * (n - n1 - (k - ({k}))) - (n1 - ({k})) * (k - ({k}))) / 2 / nullif(sqrt(n1 * (n - n1) * (n + 1) / 12), 0)"
    return f"""WITH s AS (SELECT *, sum(n1) OVER () AS n, sum(k1) OVER () AS k FROM (SELECT {group} AS g, count(*) AS n1, sum(({hit})::INT) AS k1 FROM {source} GROUP BY ALL)),
b AS (SELECT g, n1::DOUBLE AS n1, k::DOUBLE AS k, n::DOUBLE AS n, abs({z("k1")}) AS z, n1 * k / n AS mean, 12 * sqrt(n1 * k / n * (n - k) / n * (n - n1) / greatest(n - 1, 1)) + 1 AS wide FROM s WHERE {z("k1")} IS NOT NULL),
c AS (SELECT *, greatest(n1 + k - n, 0, floor(mean - wide))::BIGINT AS low, least(n1, k, ceil(mean + wide))::BIGINT AS high FROM b),
j AS (SELECT *, unnest(range(low, high + 1)) AS j FROM c),
l AS (SELECT *, sum(CASE WHEN j = low THEN 0.0::DOUBLE ELSE ln((k - j + 1) * (n1 - j + 1) / (j * (n - k - n1 + j))) END) OVER (PARTITION BY g ORDER BY j ROWS UNBOUNDED PRECEDING) AS l FROM j),
w AS (SELECT *, exp(l - max(l) OVER (PARTITION BY g)) AS w, {z("j")} AS zj FROM l),
t AS (SELECT g, sum(CASE WHEN zj <= -z THEN w ELSE 0 END) / sum(w) AS lo, sum(CASE WHEN zj >= z THEN w ELSE 0 END) / sum(w) AS hi FROM w GROUP BY g),
p AS (SELECT g, avg((u < lo OR u >= 1 - hi)::INT) AS p FROM (SELECT *, ('0x' || substr(md5(perm || '#' || g), 1, 13))::BIGINT / 4503599627370496 AS u FROM t, range(1, {n + 1}) q(perm)) GROUP BY g)
SELECT g AS {group}, n1::BIGINT AS n1, k1::BIGINT AS k1, round({z("k1")}, 6) AS z, round(p, 6) AS p FROM s LEFT JOIN p USING (g)"""


PERMS = 10_000


@query("I4_rank_z_vs_rest", _z_sql("tr", "state", "outcome = 'F'", PERMS))
def _(t):
    x = S.rank_z_vs_rest(t.tr, "state", F.col("outcome") == "F", PERMS)
    return x.withColumns({n: r6(n) for n in ("z", "p")})


_POS = """(SELECT least(floor((row_number() OVER (PARTITION BY session, block ORDER BY pos) - 1) / n * 10), 9)::INT AS bin, state FROM (
  SELECT *, count(*) OVER (PARTITION BY session, block) AS n FROM (SELECT *, coalesce(sum(is_exit::INT) OVER (PARTITION BY session ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS block FROM seq)) WHERE n >= 2)"""


@query("I5_position_effect", _z_sql(_POS, "bin", "state = 'view'", PERMS))
def _(t):
    x = W.normalized_position(t.seq)
    return S.rank_z_vs_rest(x, "bin", F.col("state") == "view", PERMS).withColumns({n: r6(n) for n in ("z", "p")})


_OFF = """(SELECT (s.pos - a.pos)::INT AS "offset", s.state FROM seq a JOIN seq s ON a.session = s.session AND s.pos BETWEEN a.pos - 5 AND a.pos + 5 WHERE a.is_exit)"""


@query("I6_transition_effect", f"""SELECT z.*, round(z.k1 / z.n1 / b.share, 6) AS ratio FROM ({_z_sql(_OFF, '"offset"', "state = 'error'", PERMS)}) z, (SELECT avg((state = 'error')::INT) AS share FROM seq) b WHERE z.n1 >= 5""")
def _(t):
    x = J.event_window(t.seq, t.seq.where("is_exit"), ["session"], "pos", 5, 5)
    z = S.rank_z_vs_rest(x, "offset", F.col("state") == "error", PERMS).where("n1 >= 5")
    base = A.shares(t.seq, "state").where("state = 'error'").select("share")
    # one row
    return z.crossJoin(F.broadcast(base)).withColumn("ratio", F.col("k1") / F.col("n1") / F.col("share")).drop("share").withColumns({n: r6(n) for n in ("z", "p", "ratio")})


@query("I7_normality_profile", "SELECT state, round(mean, 4) AS mean, round(sd, 4) AS sd, round(sk, 6) AS skewness, round(ku, 6) AS kurtosis, n, round(n / 6 * (sk * sk + ku * ku / 4), 4) AS jarque_bera FROM (SELECT state, avg(rt) AS mean, stddev_pop(rt) AS sd, count(rt) AS n, avg(pow((rt - m) / s, 3)) AS sk, avg(pow((rt - m) / s, 4)) - 3 AS ku FROM tr JOIN (SELECT state, avg(rt) AS m, stddev_pop(rt) AS s FROM tr GROUP BY state) USING (state) GROUP BY state)")
def _(t):
    x = S.normality(t.tr, "state", "rt")
    return x.withColumns({"jarque_bera": F.round("jarque_bera", 4), "mean": F.round("mean", 4), "sd": F.round("sd", 4), "skewness": r6("skewness"), "kurtosis": r6("kurtosis")})


@query("I7_density", """WITH l AS (SELECT state, avg(rt) AS m, stddev_pop(rt) AS s, min(rt) AS lo, max(rt) AS hi, count(rt) AS c FROM tr GROUP BY state), x AS (SELECT state, m, s, lo, (hi - lo) / 12 AS w, c, least(floor((rt - lo) / ((hi - lo) / 12)), 11)::INT AS bin FROM tr JOIN l USING (state) WHERE hi > lo)
SELECT state, bin, round(lo + (bin + 0.5) * w, 6) AS centre, count(*) AS n, round(1000 * count(*) / (c * w), 6) AS density, round(1000 * exp(-pow((lo + (bin + 0.5) * w - m) / s, 2) / 2) / (s * 2.5066282746310002), 6) AS normal FROM x GROUP BY state, bin, m, s, lo, w, c""")
def _(t):
    x = S.density_profile(t.tr, "state", "rt", 12)
    return x.select("state", "bin", r6("centre").alias("centre"), "n", r6(F.col("density") * 1000).alias("density"), r6(F.col("normal") * 1000).alias("normal"))


@query("I7_quantiles", " UNION ALL ".join(f"SELECT state, {p!r}::DOUBLE AS share, round(quantile_cont(rt, {p!r}), 6) AS observed, round(avg(rt) + stddev_pop(rt) * {z!r}, 4) AS normal FROM tr GROUP BY state" for p, z in S.normal_quantiles(20)))
def _(t):
    x = S.quantile_pairs(t.tr, "state", "rt", 20)
    return x.select("state", "share", F.round("observed", 6).alias("observed"), F.round("normal", 4).alias("normal"))


@query("I8_p_from_z", f"SELECT event_id, round(CASE WHEN z >= 0 THEN {_UPPER} ELSE 1 - {_UPPER} END, 6) AS p FROM (SELECT *, abs(z) / 1.4142135623730951 AS x, 1 / (1 + 0.3275911 * (abs(z) / 1.4142135623730951)) AS t FROM (SELECT event_id, (value - 50) / 20 AS z FROM events))")
def _(t):
    return t("events").select("event_id", r6(X.upper_tail((F.col("value") - 50) / 20)).alias("p"))
