"""Queries of sections D (aggregations) and E (windows)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators import aggregates as A
from ..operators import windows as X
from .registry import query, r6


def _round(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: r6(n) for n in names})


@query("D1_state_summary", "SELECT state, round(avg(value), 6) AS mean, round(stddev_samp(value), 6) AS sd, count(value) AS n, round(avg(is_exit::INT), 6) AS exit_rate FROM seq GROUP BY state")
def _(t):
    return _round(A.state_summary(t.seq, exit_rate=F.col("is_exit")), "mean", "sd", "exit_rate")


@query("D2_run_lengths", """SELECT session, min(pos) AS start, any_value(state) AS state, count(*) AS length FROM (
  SELECT *, sum(f) OVER (PARTITION BY session ORDER BY pos) AS run FROM (
    SELECT *, CASE WHEN state IS DISTINCT FROM lag(state) OVER (PARTITION BY session ORDER BY pos) THEN 1 ELSE 0 END AS f FROM seq))
GROUP BY session, run""")
def _(t):
    return A.run_lengths(t.seq)


_PAIRS = "SELECT state AS a, lead(state) OVER (PARTITION BY session ORDER BY pos) AS b FROM seq"


@query("D3_transition_matrix", f"SELECT a, b, count(*) AS n, round(count(*) / sum(count(*)) OVER (PARTITION BY a), 6) AS share FROM ({_PAIRS}) WHERE b IS NOT NULL GROUP BY a, b")
def _(t):
    return _round(A.transition_matrix(t.seq), "share")


@query("D3_transition_matrix_pooled", "SELECT a, b, count(*) AS n, round(count(*) / sum(count(*)) OVER (PARTITION BY a), 6) AS share FROM (SELECT state AS a, lead(state) OVER (ORDER BY session, pos) AS b FROM seq) WHERE b IS NOT NULL GROUP BY a, b")
def _(t):
    return _round(A.transition_matrix(t.seq, pooled=True), "share")


@query("D4_baseline_share", "SELECT state, count(*) AS n, round(count(*) / sum(count(*)) OVER (), 6) AS share FROM seq GROUP BY state")
def _(t):
    return _round(A.shares(t.seq, "state"), "share")


@query("D5_rate_by", "SELECT state, count(*) AS n, round(avg((outcome = 'F')::INT), 6) AS correct, round(avg((outcome = 'O')::INT), 6) AS wrong FROM tr GROUP BY state")
def _(t):
    return _round(A.rates(t.tr, ["state"], correct=F.col("outcome") == "F", wrong=F.col("outcome") == "O"), "correct", "wrong")


@query("D6_histogram", """SELECT bin::INT AS bin, n, round(bin * 5.0::DOUBLE, 6) AS left_edge, round(n / (sum(n) OVER () * 5), 6) AS density FROM (
  SELECT least(floor(value / 5.0), 19) AS bin, count(*) AS n FROM events WHERE value BETWEEN 0 AND 100 GROUP BY 1)""")
def _(t):
    return _round(A.histogram(t("events"), "value", 0.0, 100.0, 20, density=True), "left_edge", "density")


@query("D7_length_profile", """WITH q AS (SELECT state, avg(rt) AS mean, quantile_cont(rt, 0.5) AS median, quantile_cont(rt, 0.1) AS p10, quantile_cont(rt, 0.15) AS p15, quantile_cont(rt, 0.2) AS p20 FROM tr GROUP BY state),
b AS (SELECT state, floor(rt / 10000)::BIGINT AS bin, count(*) AS k FROM tr GROUP BY ALL),
m AS (SELECT state, bin AS modal_bin FROM b QUALIFY row_number() OVER (PARTITION BY state ORDER BY k DESC, bin) = 1),
o AS (SELECT tr.state, count(*) AS over_p10 FROM tr JOIN q USING (state) WHERE rt >= p10 GROUP BY tr.state)
SELECT state, round(mean, 4) AS mean, round(median, 4) AS median, round(p10, 4) AS p10, round(p15, 4) AS p15, round(p20, 4) AS p20, modal_bin, over_p10 FROM q JOIN m USING (state) JOIN o USING (state)""")
def _(t):
    x = A.length_profile(t.tr, "rt", "state", 10000)
    return x.withColumns({n: F.round(n, 4) for n in ("mean", "median", "p10", "p15", "p20")})


@query("D8_evoked_average", "SELECT state, channel, sample, round(avg(value), 6) AS mean, round(stddev_pop(value) / sqrt(count(value)), 6) AS sem, count(value) AS n FROM sig_nan GROUP BY ALL")
def _(t):
    return _round(A.evoked_average(t.sig_nan, ["state", "channel", "sample"]).drop("variance"), "mean", "sem")


@query("D9_variance_time", "SELECT channel, sample, round(var_pop(value), 6) AS variance FROM sig GROUP BY ALL")
def _(t):
    return _round(A.evoked_average(t.sig, ["channel", "sample"]).select("channel", "sample", "variance"), "variance")


@query("D10_grand_average", """SELECT state, array_id, sample, round(avg(v), 6) AS mean, round(stddev_pop(v) / sqrt(count(v)), 6) AS sem FROM (
  SELECT state, session, array_id, sample, avg(v) AS v FROM (
    SELECT state, session, array_id, channel, sample, avg(value) AS v FROM sig GROUP BY ALL) GROUP BY ALL) GROUP BY ALL""")
def _(t):
    return _round(A.grand_average(t.sig), "mean", "sem")


@query("D11_evoked_by_condition", """SELECT 'session' AS condition, session::VARCHAR AS level, array_id, round(avg(value), 6) AS mean, count(value) AS n FROM sig GROUP BY ALL
UNION ALL SELECT 'state', state::VARCHAR, array_id, round(avg(value), 6), count(value) FROM sig GROUP BY ALL""")
def _(t):
    return _round(A.evoked_by_condition(t.sig, ["session", "state"], ["array_id"]), "mean")


_PROBS = "SELECT vec_id, generate_subscripts(p, 1) - 1 AS state, unnest(p) / list_sum(p) AS p FROM (SELECT vec_id, list_transform(embedding[1:4], lambda x: exp(x::DOUBLE)) AS p FROM embeddings)"


def _probs(t) -> DataFrame:
    e = F.transform(F.slice("embedding", 1, 4), lambda x: F.exp(x.cast("double")))
    x = t("embeddings").select("vec_id", e.alias("e"))
    return x.select("vec_id", F.transform("e", lambda v: v / F.aggregate("e", F.lit(0.0), lambda a, b: a + b)).alias("p"))


@query("D12_multi_membership", f"WITH m AS (SELECT * FROM ({_PROBS}) WHERE p > 0.25) SELECT a.state::INT AS s1, b.state::INT AS s2, count(*) AS n FROM m a JOIN m b ON a.vec_id = b.vec_id AND a.state < b.state GROUP BY ALL")
def _(t):
    return A.membership_overlap(A.multi_membership(_probs(t), "vec_id", "p"), "vec_id")


@query("D12_prob_bins", f"SELECT state::INT AS state, floor(p / 0.05)::BIGINT AS bin, count(*) AS n, round(avg(p), 6) AS mean_p FROM ({_PROBS}) WHERE p < 1 GROUP BY ALL HAVING count(*) >= 5")
def _(t):
    x = _probs(t).select(F.posexplode("p").alias("state", "p"))
    return _round(A.probability_bins(x, "p", 0.05, "state"), "mean_p")


_W = "SELECT *, abs(t) + 0.5 AS w FROM sig_nan"


@query("D13_weighted_mean", f"SELECT state, channel, round(sum(coalesce(value * w, 0)) / sum(w), 6) AS mean, round(sum(w) * sum(w) / sum(w * w), 6) AS effective_n FROM ({_W}) GROUP BY ALL HAVING sum(w) * sum(w) / sum(w * w) >= 5")
def _(t):
    x = t.sig_nan.withColumn("w", F.abs("t") + 0.5)
    return _round(A.weighted_mean(x, "value", "w", ["state", "channel"], least_n=5), "mean", "effective_n")


@query("D13_weighted_mean_skipping", f"SELECT state, channel, round(sum(coalesce(value * w, 0)) / sum(w), 6) AS mean, round(sum(w) * sum(w) / sum(w * w), 6) AS effective_n FROM ({_W} WHERE value IS NOT NULL) GROUP BY ALL")
def _(t):
    x = t.sig_nan.withColumn("w", F.abs("t") + 0.5)
    x = A.weighted_mean(x, "value", "w", ["state", "channel"], skip_missing=True).where("mean IS NOT NULL")
    return _round(x, "mean", "effective_n")


@query("D14_channel_arrays", "SELECT channel, ntile(3) OVER (ORDER BY channel)::INT AS group_id FROM (SELECT DISTINCT channel FROM sig)")
def _(t):
    return A.channel_groups(t.sig, groups=3)


@query("D15_merge_groups", "SELECT CASE WHEN array_id <= 2 THEN 'fovea' ELSE 'periphery_' || array_id END AS area, sample, round(avg(value), 6) AS mean FROM sig GROUP BY ALL")
def _(t):
    area = F.when(F.col("array_id") <= 2, "fovea").otherwise(F.concat(F.lit("periphery_"), F.col("array_id").cast("string")))
    return _round(t.sig.groupBy(area.alias("area"), "sample").agg(F.avg("value").alias("mean")), "mean")


@query("D16_majority_vote", """SELECT session, CASE WHEN a >= b AND a >= c THEN 'view' WHEN b >= c THEN 'click' ELSE 'error' END AS winner, greatest(a, b, c) AS n_votes FROM (
  SELECT session, count_if(event_type = 'view')::BIGINT AS a, count_if(event_type = 'click')::BIGINT AS b, count_if(event_type = 'error')::BIGINT AS c FROM ev GROUP BY session)""")
def _(t):
    return A.majority_vote(t.ev, ["session"], "event_type", ["view", "click", "error"])


@query("D17_inside_share", """SELECT channel, round(100 * avg((unit <= 3)::INT), 6) AS overall, round(100 * avg(CASE WHEN t <= 0.6 THEN (unit <= 3)::INT END), 6) AS stimulus,
  round(100 * avg(CASE WHEN abs(t - 0.5) <= 0.45 THEN (unit <= 3)::INT END), 6) AS anchor FROM spk GROUP BY channel""")
def _(t):
    x = A.inside_share(t.spk, ["channel"], F.col("unit") <= 3, {"stimulus": F.col("t") <= 0.6, "anchor": F.abs(F.col("t") - 0.5) <= 0.45})
    return _round(x, "overall", "stimulus", "anchor")


_SPEC = "SELECT channel, sample AS freq, abs(avg(value)) > 0.1 AS sig_flag FROM sig GROUP BY ALL"


def _spec(t) -> DataFrame:
    return t.sig.groupBy("channel", F.col("sample").alias("freq")).agg((F.abs(F.avg("value")) > 0.1).alias("sig_flag"))


@query("D18_band_significance", f"SELECT channel, band, round(100 * avg(sig_flag::INT), 6) AS percent FROM ({_SPEC}) JOIN (VALUES ('theta', 4, 8), ('alpha', 8, 12), ('beta', 12, 30), ('gamma', 30, 63)) b(band, lo, hi) ON freq BETWEEN lo AND hi GROUP BY ALL")
def _(t):
    bands = {"theta": (4, 8), "alpha": (8, 12), "beta": (12, 30), "gamma": (30, 63)}
    return _round(A.band_significance(_spec(t), bands, ["channel"], sig="sig_flag"), "percent")


@query("D19_significance_matrix", f"SELECT channel, max(CASE WHEN freq = 0 THEN sig_flag::INT END) AS f0, max(CASE WHEN freq = 1 THEN sig_flag::INT END) AS f1, max(CASE WHEN freq = 2 THEN sig_flag::INT END) AS f2 FROM ({_SPEC}) GROUP BY channel")
def _(t):
    x = _spec(t).where("freq < 3").groupBy("channel").pivot("freq", [0, 1, 2]).agg(F.max(F.col("sig_flag").cast("int")))
    return x.toDF("channel", "f0", "f1", "f2")


@query("D20_psth", """SELECT g.channel, g.unit, g.bin::INT AS bin, coalesce(n, 0) AS n FROM (SELECT DISTINCT channel, unit, bin FROM spk, range(10) r(bin)) g
LEFT JOIN (SELECT channel, unit, least(floor(t * 10), 9)::INT AS bin, count(*) AS n FROM spk WHERE t BETWEEN 0 AND 1 GROUP BY ALL) c ON g.channel = c.channel AND g.unit = c.unit AND g.bin = c.bin""")
def _(t):
    return A.psth(t.spk, ["channel", "unit"], "t", 0.0, 1.0, 10)


@query("D21_burst_artifacts", """SELECT channel, count(*) AS n, count_if(burst)::BIGINT AS marked FROM (
  SELECT channel, max(s) OVER (PARTITION BY channel ORDER BY t, trial, unit, part ROWS BETWEEN 5 PRECEDING AND CURRENT ROW) = 1 AS burst FROM (
    SELECT *, coalesce(lead(t, 5) OVER (PARTITION BY channel ORDER BY t, trial, unit, part) - t <= 0.0005, false)::INT AS s FROM (SELECT DISTINCT channel, t + trial / 1000 AS t, trial, unit, part FROM spk)))
GROUP BY channel""")
def _(t):
    x = t.spk.select("channel", (F.col("t") + F.col("trial") / 1000).alias("t"), "trial", "unit", "part").distinct()
    x = A.mark_bursts(x, ["channel"], ["t", "trial", "unit", "part"], "t", 6, 0.0005)
    return x.groupBy("channel").agg(F.count(F.lit(1)).alias("n"), F.count_if("burst").alias("marked"))


@query("D23_best_of", "SELECT l_suppkey, l_orderkey, l_linenumber, l_extendedprice FROM (SELECT DISTINCT l_suppkey, l_orderkey, l_linenumber, l_extendedprice FROM lineitem) QUALIFY row_number() OVER (PARTITION BY l_suppkey ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber) = 1")
def _(t):
    x = t("lineitem").select("l_suppkey", "l_orderkey", "l_linenumber", "l_extendedprice").distinct()
    return A.best_of(x, ["l_suppkey"], "l_extendedprice", ["l_orderkey", "l_linenumber"])


@query("D27_median_reference", "SELECT trial, channel, sample, round(value - median(value) OVER (PARTITION BY trial, sample), 6) AS referenced FROM sig")
def _(t):
    x = A.common_median_reference(t.sig, ["trial", "sample"])
    return x.select("trial", "channel", "sample", r6("referenced").alias("referenced"))


_BLOCKS = "SELECT *, coalesce(sum(is_exit::INT) OVER (PARTITION BY session ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS block FROM seq"


@query("D28_block_table", f"SELECT session, block, count(*) AS n, min(pos) AS first_pos, array_to_string(list_sort(list_distinct(list(state))), ',') AS states, max(is_exit) AS closed FROM ({_BLOCKS}) GROUP BY session, block")
def _(t):
    return A.block_table(t.seq)


@query("D32_trial_energy", "SELECT trial, channel, round(sqrt(var_pop(value) * count(value)), 6) AS energy FROM sig WHERE t BETWEEN 0 AND 0.5 GROUP BY ALL")
def _(t):
    return _round(A.energy(t.sig.where("t BETWEEN 0 AND 0.5"), ["trial", "channel"]), "energy")


@query("D33_group_id", "SELECT DISTINCT state, outcome, dense_rank() OVER (ORDER BY state, outcome)::INT AS id FROM (SELECT DISTINCT state, outcome FROM tr)")
def _(t):
    x = t.tr.select("state", "outcome").distinct()
    return x.withColumn("id", F.dense_rank().over(Window.orderBy("state", "outcome")))


@query("D34_contingency", """WITH c AS (SELECT a.state, b.outcome, coalesce(n, 0) AS n FROM (SELECT DISTINCT state FROM tr) a CROSS JOIN (SELECT DISTINCT outcome FROM tr) b LEFT JOIN (SELECT state, outcome, count(*) AS n FROM tr GROUP BY ALL) USING (state, outcome)),
e AS (SELECT *, sum(n) OVER (PARTITION BY state) * sum(n) OVER (PARTITION BY outcome) / sum(n) OVER () AS expected FROM c)
SELECT state, outcome, n, round(expected, 6) AS expected, round(pow(n - expected, 2) / expected, 6) AS chi2 FROM e""")
def _(t):
    return _round(A.contingency(t.tr, "state", "outcome"), "expected", "chi2")


@query("D35_circular_summary", """SELECT event_type, round(atan2(s, c), 6) AS mean_angle, round(sqrt(s * s + c * c), 6) AS resultant, round(sqrt(-2 * ln(sqrt(s * s + c * c))), 6) AS sd_angle FROM (
  SELECT event_type, avg(sin(value / 50)) AS s, avg(cos(value / 50)) AS c FROM events GROUP BY event_type)""")
def _(t):
    x = t("events").withColumn("a", F.col("value") / 50)
    return _round(A.circular_summary(x, "a", ["event_type"]), "mean_angle", "resultant", "sd_angle")


_SHARES = {"q025": 0.025, "q250": 0.25, "q500": 0.5, "q750": 0.75, "q975": 0.975}


@query("D35_quantile_summary", "SELECT event_type, round(avg(value), 6) AS mean, round(stddev_pop(value), 6) AS sd, " + ", ".join(f"round(quantile_cont(value, {q}), 6) AS {n}" for n, q in _SHARES.items()) + " FROM events GROUP BY event_type")
def _(t):
    return _round(A.quantile_summary(t("events"), "value", ["event_type"], _SHARES), "mean", "sd", *_SHARES)


@query("E1_block_id", f"SELECT session, pos, block FROM ({_BLOCKS})")
def _(t):
    return A.block_id(t.seq).select("session", "pos", "block")


@query("E2_normalized_position", f"""SELECT session, pos, round(place, 6) AS place, least(floor(place * 10), 9)::INT AS bin FROM (
  SELECT *, (row_number() OVER (PARTITION BY session, block ORDER BY pos) - 1) / count(*) OVER (PARTITION BY session, block) AS place, count(*) OVER (PARTITION BY session, block) AS n FROM ({_BLOCKS})) WHERE n >= 2""")
def _(t):
    return _round(X.normalized_position(t.seq).select("session", "pos", "place", "bin"), "place")


@query("E3_first_last", f"""WITH x AS (SELECT *, count(*) OVER o AS n, row_number() OVER (PARTITION BY session, block ORDER BY pos) AS k, max(is_exit) OVER o AS closed FROM ({_BLOCKS}) WINDOW o AS (PARTITION BY session, block)),
y AS (SELECT *, greatest(1, ceil(n * 10.0 / 100)) AS few FROM x)
SELECT session, pos, 'post' AS part FROM y WHERE k <= few AND block > 0 UNION ALL SELECT session, pos, 'pre' FROM y WHERE k > n - few AND closed""")
def _(t):
    return X.first_last(t.seq).select("session", "pos", "part")


@query("E3_early_late", "SELECT session, pos, CASE WHEN s = 1 THEN 'early' ELSE 'late' END AS split FROM (SELECT *, ntile(4) OVER (PARTITION BY session ORDER BY pos) AS s FROM seq) WHERE s IN (1, 4)")
def _(t):
    return X.early_late(t.seq, 4, ["session"], ["pos"]).select("session", "pos", "split")


@query("E4_moving_average", "SELECT session, pos, round(m, 6) AS moving FROM (SELECT session, pos, avg((state = 'click')::INT) OVER (PARTITION BY session ORDER BY pos ROWS BETWEEN 9 PRECEDING AND CURRENT ROW) AS m FROM seq) WHERE pos >= 9")
def _(t):
    x = X.moving_average(t.seq, 10, ["session"], ["pos"], (F.col("state") == "click").cast("int"))
    return _round(x.select("session", "pos", "moving"), "moving")


@query("E5_rolling_var", """SELECT session, pos, round(CASE WHEN n = 5 THEN v ELSE 100 END, 6) AS variance, CASE WHEN n = 5 THEN v ELSE 100 END < 300 AS still FROM (
  SELECT session, pos, count(*) OVER w AS n, var_pop(value) OVER w AS v FROM seq WINDOW w AS (PARTITION BY session ORDER BY pos ROWS BETWEEN CURRENT ROW AND 4 FOLLOWING))""")
def _(t):
    x = X.rolling_variance(t.seq, 5, ["session"], ["pos"], "value", still=300)
    return _round(x.select("session", "pos", "variance", "still"), "variance")


_FIT = """SELECT session, pos, CASE WHEN n = 6 THEN cxy / cxx END AS slope, CASE WHEN n = 6 AND cyy / 6 > 1e-12 THEN cxy * cxy / (cxx * cyy) ELSE 1 END AS r2 FROM (
  SELECT session, pos, count(*) OVER w AS n, sum(i * i) OVER w - pow(sum(i) OVER w, 2) / 6 AS cxx, sum(value * value) OVER w - pow(sum(value) OVER w, 2) / 6 AS cyy, sum(i * value) OVER w - sum(i) OVER w * sum(value) OVER w / 6 AS cxy
  FROM (SELECT *, (pos + 1)::DOUBLE AS i FROM seq) WINDOW w AS (PARTITION BY session ORDER BY pos ROWS BETWEEN CURRENT ROW AND 5 FOLLOWING))"""


@query("E6_sliding_r2", f"SELECT session, pos, round(r2, 5) AS r2 FROM ({_FIT})")
def _(t):
    return X.sliding_fit(t.seq, 6, ["session"], ["pos"], "value").select("session", "pos", (F.round("r2", 5)).alias("r2"))


@query("E7_sliding_slope", f"SELECT session, pos, round(slope, 5) AS slope, (slope > 0) = (last_value(value) OVER (PARTITION BY session ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) > value) AS agrees FROM ({_FIT}) JOIN seq USING (session, pos)")
def _(t):
    x = X.sliding_fit(t.seq, 6, ["session"], ["pos"], "value")
    end = F.last("value").over(Window.partitionBy("session").orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    x = x.withColumn("agrees", (F.col("slope") > 0) == (end > F.col("value")))
    return x.select("session", "pos", (F.round("slope", 5) + F.lit(0.0)).alias("slope"), "agrees")


@query("E8_gradient", """SELECT session, pos, round(CASE WHEN d IS NULL THEN u - value WHEN u IS NULL THEN value - d ELSE (u - d) / 2 END, 6) AS gradient FROM (
  SELECT session, pos, value, lead(value) OVER w AS u, lag(value) OVER w AS d FROM seq WINDOW w AS (PARTITION BY session ORDER BY pos))""")
def _(t):
    return _round(X.gradient(t.seq, ["session"], ["pos"], "value").select("session", "pos", "gradient"), "gradient")


def _gradient_sql(source: str, **of: str) -> str:
    g = lambda v: f"CASE WHEN lag({v}) OVER w IS NULL THEN lead({v}) OVER w - {v} WHEN lead({v}) OVER w IS NULL THEN {v} - lag({v}) OVER w ELSE (lead({v}) OVER w - lag({v}) OVER w) / 2 END"
    return f"SELECT *, {', '.join(f'{g(v)} AS {n}' for n, v in of.items())} FROM {source} WINDOW w AS (PARTITION BY session ORDER BY pos)"


_PATH = f"""WITH g AS ({_gradient_sql('(SELECT session, pos, value, (seq % 97)::DOUBLE AS y FROM (SELECT session, row_number() OVER (PARTITION BY session ORDER BY us, seq) - 1 AS pos, value, seq FROM ev))', dx='value', dy='y')}),
s AS (SELECT *, CASE WHEN sqrt(dx * dx + dy * dy) = 0 THEN 1e-5 ELSE sqrt(dx * dx + dy * dy) END AS speed FROM g), d AS (SELECT *, dx / speed AS tx, dy / speed AS ty FROM s),
k AS ({_gradient_sql('d', turn_x='tx', turn_y='ty', ddx='dx', ddy='dy')}), l AS (SELECT *, CASE WHEN sqrt(turn_x * turn_x + turn_y * turn_y) = 0 THEN 1e-5 ELSE sqrt(turn_x * turn_x + turn_y * turn_y) END AS l FROM k),
p AS (SELECT *, turn_x / l AS nx, turn_y / l AS ny, abs(ddx * dy - dx * ddy) / pow(speed, 3) AS curvature FROM l)"""


def _path(t):
    path = t.ev.select("session", (F.row_number().over(Window.partitionBy("session").orderBy("us", "seq")) - 1).cast("long").alias("pos"), "value", (F.col("seq") % 97).cast("double").alias("y"))
    return X.path_kinematics(path, ["session"], ["pos"], "value", "y")


@query("E8_path_kinematics", f"{_PATH} SELECT session, pos, round(speed, 6) AS speed, round(tx, 6) AS tangent_x, round(ty, 6) AS tangent_y, round(nx, 6) AS normal_x, round(ny, 6) AS normal_y, round(curvature, 5) AS curvature FROM p")
def _(t):
    x = _path(t).select("session", "pos", "speed", "tangent_x", "tangent_y", "normal_x", "normal_y", "curvature")
    return _round(x, "speed", "tangent_x", "tangent_y", "normal_x", "normal_y").withColumn("curvature", F.round("curvature", 5))


_FIRST = lambda c, n: f"first(pos ORDER BY round({c}, 9) DESC NULLS LAST, pos) AS {n}"


@query("E8_path_candidates", f"{_PATH}, c AS (SELECT session, count(*) AS n, {_FIRST('abs(turn_y)', 'tangent')}, {_FIRST('greatest(curvature * speed * speed * nx, curvature * speed * speed * ny)', 'normal')}, {_FIRST('abs(ddy)', 'acceleration')}, {_FIRST('curvature', 'curvature')} FROM p GROUP BY session) SELECT session, CASE WHEN n > 1 THEN tangent END AS tangent, CASE WHEN n > 1 THEN normal END AS normal, CASE WHEN n > 1 THEN acceleration END AS acceleration, CASE WHEN n > 1 THEN curvature END AS curvature FROM c")
def _(t):
    return X.path_candidates(_path(t), ["session"], "pos")


@query("E9_peaks", """WITH x AS (SELECT session, pos, value, lag(value) OVER w AS d, lead(value) OVER w AS u FROM seq WINDOW w AS (PARTITION BY session ORDER BY pos)),
c AS (SELECT * FROM x WHERE value > d AND value > u),
l AS (SELECT c.session, c.pos, c.value, coalesce(max(CASE WHEN s.value > c.value AND s.pos < c.pos THEN s.pos END), -1) AS a, coalesce(min(CASE WHEN s.value > c.value AND s.pos > c.pos THEN s.pos END), 1000000000) AS b FROM c JOIN seq s USING (session) GROUP BY ALL),
p AS (SELECT l.session, l.pos, l.value, l.value - greatest(min(CASE WHEN s.pos BETWEEN a + 1 AND l.pos THEN s.value END), min(CASE WHEN s.pos BETWEEN l.pos AND b - 1 THEN s.value END)) AS prominence FROM l JOIN seq s USING (session) GROUP BY l.session, l.pos, l.value)
SELECT session, pos, round(prominence, 6) AS prominence FROM p WHERE prominence >= 20""")
def _(t):
    return _round(X.peaks(t.seq, ["session"], "pos", "value", 20.0).select("session", "pos", "prominence"), "prominence")


@query("E10_detrend", """SELECT session, pos, round(value - (avg(value) OVER s + covar_pop(pos, value) OVER s / var_pop(pos) OVER s * (pos - avg(pos) OVER s)), 6) AS detrended FROM seq WINDOW s AS (PARTITION BY session)""")
def _(t):
    return _round(X.detrend(t.seq, ["session"], ["pos"], "value").select("session", "pos", "detrended"), "detrended")


@query("E10_detrend_ridge", """SELECT session, pos, round(value - (avg(value) OVER s + covar_pop(pos, value) OVER s / (var_pop(pos) OVER s + 50 / count(*) OVER s) * (pos - avg(pos) OVER s)), 6) AS detrended FROM seq WINDOW s AS (PARTITION BY session)""")
def _(t):
    return _round(X.detrend(t.seq, ["session"], ["pos"], "value", alpha=50).select("session", "pos", "detrended"), "detrended")


@query("E13_rezero", "SELECT session, pos, us - first_value(us) OVER w AS us_zeroed, round(value - first_value(value) OVER w, 6) AS value_zeroed FROM seq WINDOW w AS (PARTITION BY session ORDER BY pos)")
def _(t):
    return _round(X.rezero(t.seq, ["session"], ["pos"], ["us", "value"]).select("session", "pos", "us_zeroed", "value_zeroed"), "value_zeroed")


@query("E14_fill_linear", """WITH s AS (SELECT session, pos, value FROM seq WHERE pos % 7 <> 3), g AS (SELECT session, unnest(range(min(pos), max(pos) + 1)) AS pos FROM s GROUP BY session),
j AS (SELECT session, pos, value FROM g LEFT JOIN s USING (session, pos)),
k AS (SELECT *, last_value(CASE WHEN value IS NOT NULL THEN pos END IGNORE NULLS) OVER b AS p, last_value(value IGNORE NULLS) OVER b AS pv, first_value(CASE WHEN value IS NOT NULL THEN pos END IGNORE NULLS) OVER a AS n, first_value(value IGNORE NULLS) OVER a AS nv FROM j
  WINDOW b AS (PARTITION BY session ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), a AS (PARTITION BY session ORDER BY pos ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))
SELECT session, pos, round(coalesce(value, pv + (nv - pv) * (pos - p) / (n - p)), 6) AS value, value IS NULL AS filled FROM k""")
def _(t):
    x = X.fill_linear(t.seq.where("pos % 7 != 3"), ["session"], "pos", "value")
    return _round(x.select("session", "pos", "value", "filled"), "value")


@query("E15_locf", "SELECT session, pos, last_value(CASE WHEN state = 'view' THEN value END IGNORE NULLS) OVER (PARTITION BY session ORDER BY pos) AS last_view FROM seq")
def _(t):
    x = t.seq.withColumn("last_view", F.when(F.col("state") == "view", F.col("value")))
    return X.carry_forward(x, ["session"], ["pos"], ["last_view"]).select("session", "pos", "last_view")


@query("E16_threshold_events", """SELECT trial, channel, sample FROM (SELECT *, sample - lag(sample) OVER (PARTITION BY trial, channel ORDER BY sample) AS g FROM (
  SELECT *, stddev_pop(value) OVER (PARTITION BY trial, channel) AS sd FROM sig) WHERE abs(value) > 1.5 * sd) WHERE g > 3""")
def _(t):
    return X.threshold_events(t.sig, ["trial", "channel"], "sample", 1.5, 3).select("trial", "channel", "sample")


@query("E17_burst_sessions", """SELECT session, min(us) AS "start", max(us) AS "end", count(*) AS n FROM (
  SELECT *, sum(f) OVER (PARTITION BY session ORDER BY us, pos) AS run FROM (SELECT *, coalesce(us - lag(us) OVER (PARTITION BY session ORDER BY us, pos) > 14400000000, true)::INT AS f FROM seq))
GROUP BY session, run HAVING count(*) >= 4""")
def _(t):
    return X.burst_sessions(t.seq, ["session"], "us", ["us", "pos"], 14_400_000_000, 4)


_PARTS = """WITH r AS (SELECT *, sum(f) OVER (PARTITION BY session ORDER BY us, pos) AS run FROM (SELECT *, coalesce(us - lag(us) OVER (PARTITION BY session ORDER BY us, pos) > 14400000000, true)::INT AS f FROM seq)),
s AS (SELECT *, f = 1 AND count(*) OVER (PARTITION BY session, run) >= 3 AS begins FROM r), p AS (SELECT *, sum(begins::INT) OVER (PARTITION BY session ORDER BY us, pos) - 1 AS part FROM s)"""


@query("E17_split_at_bursts", f"{_PARTS} SELECT session, pos, part::INT AS part FROM p WHERE part >= 0")
def _(t):
    return X.split_at_bursts(t.seq, ["session"], "us", ["us", "pos"], 14_400_000_000, 3).select("session", "pos", F.col("part").cast("int").alias("part"))


@query("E17_closest_part", f"""{_PARTS}, e AS (SELECT session, count_if(state = 'view')::BIGINT AS expected FROM seq GROUP BY session), c AS (SELECT session, part, count(*) AS n FROM p WHERE part >= 0 GROUP BY session, part)
SELECT session, part::INT AS part, n, expected, coalesce(abs(n - expected) / nullif(expected, 0) <= 0.2, false) AS agrees FROM c JOIN e USING (session) QUALIFY row_number() OVER (PARTITION BY session ORDER BY abs(n - expected), part) = 1""")
def _(t):
    parts = X.split_at_bursts(t.seq, ["session"], "us", ["us", "pos"], 14_400_000_000, 3)
    expected = t.seq.groupBy("session").agg(F.count_if(F.col("state") == "view").alias("expected"))
    return X.closest_part(parts, ["session"], expected).withColumn("part", F.col("part").cast("int"))


@query("E19_zscore", "SELECT session, pos, round((value - avg(value) OVER s) / nullif(stddev_pop(value) OVER s, 0), 6) AS z FROM seq WINDOW s AS (PARTITION BY state)")
def _(t):
    return _round(X.zscore(t.seq, ["state"], "value").select("session", "pos", "z"), "z")


@query("E20_progress_profile", """SELECT state, floor(p * 10)::INT AS bin, round(avg(value), 9) AS mean, round(stddev_pop(value), 6) AS sd, count(*) AS n FROM (
  SELECT *, pos / nullif(max(pos) OVER (PARTITION BY session), 0) AS p FROM seq) WHERE p > 0 AND p < 1 GROUP BY ALL""")
def _(t):
    x = X.progress_profile(t.seq, ["session"], ["pos"], "pos", "value", 10, "state")
    return x.withColumns({"mean": F.round("mean", 9), "sd": F.round("sd", 6)})


@query("E21_ranking", "SELECT n_name, regexp_extract(n_name, '(\\d+)', 1)::BIGINT AS natural, row_number() OVER (ORDER BY regexp_extract(n_name, '(\\d+)', 1)::BIGINT)::INT AS place FROM nation")
def _(t):
    x = t("nation").withColumn("natural", X.natural_key(F.col("n_name")))
    return x.select("n_name", "natural", F.row_number().over(Window.orderBy("natural")).alias("place"))


@query("E22_concat_block_signal", "SELECT trial, channel, sample, row_number() OVER (PARTITION BY state, channel ORDER BY trial, sample) - 1 AS stitched FROM sig")
def _(t):
    return X.stitch(t.sig, ["state", "channel"], "trial", ["sample"]).select("trial", "channel", "sample", "stitched")
