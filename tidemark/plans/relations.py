"""Queries of sections B (predicates), C (joins), F (ordering) and G (sets)."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import joins as J
from ..operators import predicates as P
from ..operators import sequences as Q
from ..staging import numbered, written
from .registry import query, r6


@query("B1_select_trials", "SELECT trial, state, outcome FROM tr WHERE outcome = 'F' AND NOT state = '5-LOW' AND (rt > 100000)")
def _(t):
    x = t.tr.withColumn("long", F.col("rt") > 100000)
    return P.select_trials(x, ["outcome=F", "~state=5-LOW", "long"]).select("trial", "state", "outcome")


_RANGES = "(VALUES (1, 2, 'reward'), (3000, 3010, 'start'), (3011, 3090, 'stimulus')) r(lo, hi, field)"


@query("B2_classify_codes", f"SELECT session, max(CASE WHEN field = 'reward' THEN value END) AS reward, max(CASE WHEN field = 'start' THEN value END) AS start, max(CASE WHEN field = 'stimulus' THEN value END) AS stimulus FROM (SELECT session, field, arg_max(code, us * 1000000 + seq) AS value FROM ev JOIN {_RANGES} ON code BETWEEN lo AND hi GROUP BY ALL) GROUP BY session")
def _(t):
    ranges = t.spark.createDataFrame([(1, 2, "reward"), (3000, 3010, "start"), (3011, 3090, "stimulus")], "lo int, hi int, field string")
    found = P.classify_codes(t.ev, ranges, ["session"], ["us", "seq"])
    return found.groupBy("session").pivot("field", ["reward", "start", "stimulus"]).agg(F.max("value"))


@query("B3_difficulty_label", "SELECT p_partkey, CASE WHEN p_size IN (30, 70) THEN 'easy' WHEN p_size IN (49, 51) THEN 'hard' ELSE 'unknown' END AS difficulty FROM part")
def _(t):
    return t("part").select("p_partkey", P.difficulty(F.col("p_size")).alias("difficulty"))


@query("B3_block_difficulty", "SELECT p_brand, CASE WHEN s = [30, 70] THEN 'easy' WHEN s = [49, 51] THEN 'hard' ELSE 'unknown' END AS difficulty FROM (SELECT p_brand, list_sort(list_distinct(list(CASE WHEN p_size < 25 THEN 49 ELSE 51 END))) AS s FROM part GROUP BY p_brand)")
def _(t):
    code = F.when(F.col("p_size") < 25, 49).otherwise(51)
    return t("part").groupBy("p_brand").agg(P.difficulty_of_set(F.collect_set(code)).alias("difficulty"))


@query("B4_map_values", "SELECT trial, CASE state WHEN '1-URGENT' THEN 1 WHEN '2-HIGH' THEN 2 WHEN '5-LOW' THEN 5 END AS level FROM tr")
def _(t):
    return t.tr.select("trial", P.map_values(F.col("state"), {"1-URGENT": 1, "2-HIGH": 2, "5-LOW": 5}).alias("level"))


@query("B5_drop_all_nan", "SELECT trial, channel, sample, value FROM sig_nan WHERE trial IN (SELECT trial FROM sig_nan WHERE value IS NOT NULL) AND channel IN (SELECT channel FROM sig_nan WHERE value IS NOT NULL)")
def _(t):
    return P.drop_all_missing(t.sig_nan).select("trial", "channel", "sample", "value")


@query("B6_drop_all_nan_positions", "SELECT session, trial, dense_rank() OVER (PARTITION BY session ORDER BY trial)::INT - 1 AS place FROM (SELECT DISTINCT session, trial FROM sig_nan WHERE value IS NOT NULL)")
def _(t):
    kept = P.drop_all_missing(t.sig_nan).select("session", "trial").distinct()
    return kept.withColumn("place", F.dense_rank().over(Window.partitionBy("session").orderBy("trial")) - 1)


@query("B7_mask_bad", "SELECT trial, channel, sample, CASE WHEN NOT (trial IN (3, 8) OR channel = 2 OR (channel = 5 AND sample BETWEEN 10 AND 20)) THEN value END AS value FROM sig")
def _(t):
    trials = t.spark.createDataFrame([(3,), (8,)], "trial long")
    channels = t.spark.createDataFrame([(2, None, None), (5, 10, 20)], "channel long, lo long, hi long")
    return P.mask_bad(t.sig, trials, channels).select("trial", "channel", "sample", "value")


@query("B8_crop", "SELECT trial, channel, sample, t FROM (SELECT * FROM sig WHERE NOT (trial % 3 = 0 AND sample > 30)) QUALIFY t BETWEEN -0.1 AND 0.5 AND min(t) OVER (PARTITION BY trial, channel) <= -0.1 AND max(t) OVER (PARTITION BY trial, channel) >= 0.5")
def _(t):
    x = t.sig.where("NOT (trial % 3 = 0 AND sample > 30)")
    return P.crop(x, -0.1, 0.5, ["trial", "channel"]).select("trial", "channel", "sample", "t")


@query("B9_best_window", """WITH s AS (SELECT -(trial % 10) / 10.0::DOUBLE AS "start", (trial % 7) / 5.0::DOUBLE AS "end" FROM tr),
g AS (SELECT a::DOUBLE AS a, b::DOUBLE AS b FROM (VALUES (-0.8), (-0.5), (-0.2)) x(a), (VALUES (0.2), (0.6), (1.0)) y(b) WHERE a < b)
SELECT a, b, count_if("start" <= a AND "end" >= b)::BIGINT AS valid, count(*) AS total, round(count_if("start" <= a AND "end" >= b) + 1200.0 * (b - a), 6) AS score FROM s, g GROUP BY a, b ORDER BY score DESC, a, b LIMIT 1""")
def _(t):
    x = t.tr.select((-(F.col("trial") % 10) / 10).alias("start"), ((F.col("trial") % 7) / 5).alias("end"))
    return P.best_window(x, [-0.8, -0.5, -0.2], [0.2, 0.6, 1.0], 12).withColumn("score", r6("score"))


@query("B10_crop_around", """WITH a AS (SELECT DISTINCT trial, (trial % 5) / 10.0 AS anchor FROM sig),
x AS (SELECT sig.*, anchor FROM sig JOIN a USING (trial) WHERE t BETWEEN anchor - 0.2 AND anchor + 0.3),
y AS (SELECT *, row_number() OVER (PARTITION BY trial, channel ORDER BY sample) AS k, count(*) OVER (PARTITION BY trial, channel) AS n FROM x)
SELECT trial, channel, sample, round(t - anchor, 6) AS t_zeroed FROM y WHERE n >= 32 AND k <= 32""")
def _(t):
    anchors = t.sig.select("trial").distinct().withColumn("anchor", (F.col("trial") % 5) / 10)
    x = P.crop_around(t.sig, anchors, ["trial"], 0.2, 0.3, 64)
    return x.select("trial", "channel", "sample", r6("t_zeroed").alias("t_zeroed"))


@query("B11_trial_outcome", """SELECT session, CASE WHEN c > 12 THEN 'correct' WHEN w > 12 THEN 'wrong' WHEN v > 12 THEN 'miss' ELSE 'other' END || CASE WHEN x > 12 AND (c > 12 OR w > 12 OR v > 12) THEN '_end' ELSE '' END AS outcome FROM (
  SELECT session, count_if(code = 1) AS c, count_if(code = 2) AS w, count_if(code = 3011) AS v, count_if(code = 3091) AS x FROM ev GROUP BY session)""")
def _(t):
    x = t.ev.groupBy("session").agg(*[F.count_if(F.col("code") == k).alias(f"n{k}") for k in (1, 2, 3011, 3091)])
    many = [F.col(f"n{k}") > 12 for k in (1, 2, 3011, 3091)]
    return x.select("session", P.trial_outcome(*many).alias("outcome"))


@query("B12_outlier_filter", "SELECT session, count(*) AS n FROM tr WHERE rt / 10000 <= 30 GROUP BY session")
def _(t):
    return t.tr.where("rt / 10000 <= 30").groupBy("session").agg(F.count(F.lit(1)).alias("n"))


@query("B13_likelihood_box", """WITH p AS (SELECT l_returnflag, l_linenumber AS part, median(CASE WHEN l_discount > 0.05 THEN l_quantity END) AS mx, median(CASE WHEN l_discount > 0.05 THEN l_extendedprice END) AS my FROM lineitem GROUP BY ALL),
b AS (SELECT l_returnflag, min(mx) AS x0, max(mx) AS x1, min(my) AS y0, max(my) AS y1 FROM p GROUP BY ALL)
SELECT l_returnflag, round(greatest(0, x0 - (x1 - x0) * 0.2), 4) AS x0, round(x1 + (x1 - x0) * 0.2, 4) AS x1, round(greatest(0, y0 - (y1 - y0) * 0.2), 4) AS y0, round(y1 + (y1 - y0) * 0.2, 4) AS y1 FROM b""")
def _(t):
    x = t("lineitem").withColumn("part", F.col("l_linenumber"))
    x = P.likelihood_box(x, "l_quantity", "l_extendedprice", "l_discount", ["l_returnflag"], least=0.05)
    return x.withColumns({c: F.round(c, 4) for c in ("x0", "x1", "y0", "y1")})


@query("B14_drop_long_trials", "SELECT trial, rt FROM tr WHERE outcome = 'F' AND rt <= 200000")
def _(t):
    return t.tr.where("outcome = 'F' AND rt <= 200000").select("trial", "rt")


@query("C1_attach_state", "SELECT DISTINCT o.session, o.trial, s.state FROM (SELECT o_custkey AS session, l_orderkey AS trial FROM lineitem JOIN orders ON l_orderkey = o_orderkey) o JOIN (SELECT session, trial, state FROM tr) s USING (session, trial)")
def _(t):
    # lines are the coded trials: every line's order, and the session it belongs to
    lines = t("lineitem").select(F.col("l_orderkey").alias("trial")).distinct()
    coded = lines.join(t.tr.select("session", "trial"), "trial").select("session", (F.col("trial") + 1000).alias("trial_code"))
    return J.attach_state(coded, t.tr.select("session", "trial", "state")).select("session", "trial", "state")


@query("C2_keep_trials", "SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_quantity > 45)")
def _(t):
    return t("orders").join(t("lineitem").where("l_quantity > 45").select(F.col("l_orderkey").alias("o_orderkey")), "o_orderkey", "left_semi").select("o_orderkey", "o_orderstatus")


@query("C3_anti_join", "SELECT o_orderkey FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey)")
def _(t):
    return t("orders").select("o_orderkey").join(t("lineitem").select(F.col("l_orderkey").alias("o_orderkey")), "o_orderkey", "left_anti")


_TRIALS = """(SELECT session, us AS start_us, seq AS trial, least(us + 86400000000, coalesce(lead(us) OVER (PARTITION BY session ORDER BY us, seq), us + 86400000000)) AS end_us FROM ev WHERE code = 3000)"""


def _trials(t):
    """Trials from one start marker to the next, or a day."""
    w = Window.partitionBy("session").orderBy("us", "seq")
    day = F.col("us") + F.lit(86_400_000_000)
    return t.ev.where("code = 3000").select("session", F.col("us").alias("start_us"), F.col("seq").alias("trial"), F.least(day, F.coalesce(F.lead("us").over(w), day)).alias("end_us"))


@query("C4_interval_join", f"SELECT e.session, e.seq, coalesce(CASE WHEN e.us <= t.end_us THEN t.trial END, -1) AS in_trial FROM ev e ASOF LEFT JOIN {_TRIALS} t ON e.session = t.session AND e.us >= t.start_us")
def _(t):
    return J.interval_join(t.ev.select("session", "us", "seq"), _trials(t), ["session"], "us", "start_us", "end_us", "trial").select("session", "seq", "in_trial")


@query("C5_first_in_window", f"""SELECT t.session, t.trial, arg_min(e.code, e.us) AS first_code, min(e.us) - any_value(t.start_us) AS latency, count(e.us) AS hits FROM {_TRIALS} t
LEFT JOIN (SELECT * FROM ev WHERE code IN (1, 2)) e ON e.session = t.session AND e.us BETWEEN t.start_us AND t.end_us GROUP BY t.session, t.trial""")
def _(t):
    hits = t.ev.where("code IN (1, 2)").select("session", "us", "code")
    return J.first_in_window(_trials(t), hits, ["session"], "start_us", "end_us", "us", "code", 5e6).select("session", "trial", "first_code", "latency", "hits")


@query("C6_asof_backward", """SELECT e.session, e.seq, coalesce(v.us, f.us) AS us_found, CASE WHEN v.us IS NULL THEN f.value ELSE v.value END AS value_found FROM (SELECT * FROM ev WHERE code <> 3011) e ASOF LEFT JOIN (SELECT * FROM ev WHERE code = 3011) v ON e.session = v.session AND e.us >= v.us
LEFT JOIN (SELECT session, min(us) AS us, arg_min(value, us) AS value FROM ev WHERE code = 3011 GROUP BY session) f ON f.session = e.session""")
def _(t):
    left = t.ev.where("code != 3011").select("session", "us", "seq")
    return J.asof_backward(left, t.ev.where("code = 3011").select("session", "us", "value"), ["session"], "us", "us", ["value"], or_first=True).select("session", "seq", "us_found", "value_found")


@query("C7_asof_forward", "SELECT e.session, e.seq, v.us AS us_found, v.value AS value_found FROM (SELECT * FROM ev WHERE code <> 3011) e ASOF LEFT JOIN (SELECT * FROM ev WHERE code = 3011) v ON e.session = v.session AND e.us <= v.us")
def _(t):
    left = t.ev.where("code != 3011").select("session", "us", "seq")
    return J.asof_forward(left, t.ev.where("code = 3011").select("session", "us", "value"), ["session"], "us", "us", ["value"]).select("session", "seq", "us_found", "value_found")


@query("C8_nearest_join", """SELECT e.session, e.seq, CASE WHEN g <= 36000000000 THEN g END AS gap, CASE WHEN g <= 36000000000 THEN v END AS nearest FROM (
  SELECT e.session, e.seq, min(abs(e.us - v.us)) AS g, arg_min(v.seq, abs(e.us - v.us) * 2 + (v.us > e.us)::INT) AS v FROM (SELECT * FROM ev WHERE code = 2) e JOIN (SELECT * FROM ev WHERE code = 1) v USING (session) GROUP BY ALL) e""")
def _(t):
    left = t.ev.where("code = 2").select("session", "us", "seq")
    right = t.ev.where("code = 1").select("session", F.col("us").alias("at"), F.col("seq").alias("near"))
    return J.nearest(left, right, ["session"], "us", "at", "near", 36_000_000_000).select("session", "seq", "gap", "nearest")


_TOP = "(SELECT row_number() OVER (ORDER BY us, seq) - 1 AS p, code FROM ev)"


@query("C9_align_sequences", f"""WITH a AS {_TOP}, b AS (SELECT p - 37 AS p, code FROM a WHERE p >= 37), k AS (SELECT list(code ORDER BY p) AS h FROM b WHERE p < 12),
g AS (SELECT p, list(code) OVER (ORDER BY p ROWS BETWEEN CURRENT ROW AND 11 FOLLOWING) AS gram FROM a) SELECT p AS "offset", count(*) OVER () AS matches FROM g, k WHERE gram = h""")
def _(t):
    a = numbered(t.ev.select("us", "seq", "code"), ["us", "seq"], "p")
    b = a.where("p >= 37").withColumn("p", F.col("p") - 37)
    return J.align_sequences(a, b, "p", "code", 12)


_CODED = "(SELECT session, us, seq, code + 100 * (seq % 7) AS code, row_number() OVER (PARTITION BY session ORDER BY us, seq) - 1 AS pos, count(*) OVER (PARTITION BY session) AS n FROM ev)"
# sessions whose recording is whole, ends early, begins late, or repeats what their log begins with
_TAKEN = "CASE session % 4 WHEN 1 THEN pos < n - 5 WHEN 2 THEN pos >= 4 ELSE true END"


def _coded(t):
    x = Q.with_position(t.ev.select("session", "us", "seq", (F.col("code") + 100 * (F.col("seq") % 7)).alias("code")), ["session"], ["us", "seq"])
    return written(x.join(x.groupBy("session").agg(F.count(F.lit(1)).alias("n")), "session"))


_LATE = f"""c AS {_CODED}, l AS (SELECT session, pos, code FROM c),
r AS (SELECT session, us, code, row_number() OVER (PARTITION BY session ORDER BY part, pos) - 1 AS pos FROM (SELECT session, us, code, pos, 1 AS part FROM c WHERE {_TAKEN} UNION ALL SELECT session, us, code, pos, 0 FROM c WHERE session % 4 = 3 AND pos < 6)),
ka AS (SELECT session, list(code ORDER BY pos) AS key FROM l WHERE pos < 6 GROUP BY session), kb AS (SELECT session, list(code ORDER BY pos) AS key FROM r WHERE pos < 100 GROUP BY session),
a AS (SELECT g.session, count(*) AS n, min(pos) AS at FROM (SELECT session, pos, list(code) OVER (PARTITION BY session ORDER BY pos ROWS BETWEEN CURRENT ROW AND 5 FOLLOWING) AS gram FROM r) g JOIN ka ON g.session = ka.session AND gram = key GROUP BY g.session),
b AS (SELECT g.session, count(*) AS n, min(pos) AS at FROM (SELECT session, pos, list(code) OVER (PARTITION BY session ORDER BY pos ROWS BETWEEN CURRENT ROW AND 99 FOLLOWING) AS gram FROM l) g JOIN kb ON g.session = kb.session AND gram[:len(key)] = key GROUP BY g.session),
o AS (SELECT s.session, CASE WHEN a.n = 1 THEN 'aligned' WHEN a.n > 1 THEN 'many' WHEN b.n = 1 THEN 'late' ELSE 'none' END AS status, CASE WHEN a.n = 1 THEN a.at WHEN a.n IS NULL AND b.n = 1 THEN -b.at END AS shift FROM (SELECT DISTINCT session FROM l) s LEFT JOIN a USING (session) LEFT JOIN b USING (session)),
p AS (SELECT l.session, l.pos, l.code, r.us, r.code AS other, status, shift FROM l JOIN o USING (session) LEFT JOIN r ON r.session = l.session AND r.pos = l.pos + shift)"""


def _recorded(t):
    """A log, and its recording with its own positions."""
    c = _coded(t)
    taken = F.when(F.col("session") % 4 == 1, F.col("pos") < F.col("n") - 5).when(F.col("session") % 4 == 2, F.col("pos") >= 4).otherwise(True)
    twice = c.where("session % 4 = 3 AND pos < 6").withColumn("part", F.lit(0))
    r = c.where(taken).withColumn("part", F.lit(1)).unionByName(twice).withColumn("_order", F.col("part") * 1_000_000_000_000 + F.col("pos")).drop("pos")
    return Q.with_position(r, ["session"], ["_order"]).select("session", "pos", F.col("us").alias("time"), "code"), c.select("session", "pos", "code")


@query("C9_align_to_log", f"WITH {_LATE} SELECT session, pos, code, us AS time FROM p WHERE shift IS NOT NULL")
def _(t):
    return Q.align_to_log(*_recorded(t), ["session"])[0]


@query("C9_alignment_report", f"""WITH {_LATE} SELECT session, status, any_value(shift) AS "offset", CASE WHEN any_value(shift) IS NOT NULL THEN count(other) END AS paired, CASE WHEN any_value(shift) IS NOT NULL THEN count(*) - count(other) END AS missing, CASE WHEN any_value(shift) IS NOT NULL THEN count_if(other <> code)::BIGINT END AS differing FROM p GROUP BY session, status""")
def _(t):
    return Q.align_to_log(*_recorded(t), ["session"])[1]


@query("C9_align_to_screen", f"""WITH c AS (SELECT * REPLACE (CASE WHEN pos = 0 THEN 992 WHEN pos = n - 1 THEN 993 ELSE code END AS code) FROM {_CODED})
SELECT session, CASE WHEN session % 5 = 4 AND pos = 0 THEN NULL ELSE us * 0.03::DOUBLE END AS sample, CASE WHEN session % 5 = 4 AND pos = 0 THEN NULL ELSE us * 0.03::DOUBLE + 16000 * 0.03::DOUBLE END AS screen_sample, us + 16000 AS screen_time, code FROM c
WHERE pos < n - CASE session % 5 WHEN 1 THEN 2 ELSE 1 END AND pos >= CASE session % 5 WHEN 2 THEN 1 ELSE 0 END""")
def _(t):
    """Recordings with both session markers, without the last or the first row, with the end of the session before, and
    without either marker (these by way of the log, so that their first row has no time)."""
    k, p = F.col("session") % 5, F.col("pos")
    c = _coded(t).withColumn("code", F.when(p == 0, 992).when(p == F.col("n") - 1, 993).otherwise(F.col("code")).cast("long"))
    log = c.select("session", "pos", "code", F.col("us").alias("log_time"), (F.col("us") + 16_000).alias("screen_time"))
    taken = F.when(k == 1, p < F.col("n") - 1).when(k == 2, p > 0).when(k == 4, (p > 0) & (p < F.col("n") - 1)).otherwise(True)
    r = c.where(taken).withColumn("pos", F.when(k.isin(2, 4), p - 1).when(k == 3, p + 1).otherwise(p))
    before = c.where((k == 3) & (p == 0)).withColumn("code", F.lit(993).cast("long"))
    r = r.unionByName(before).select("session", "pos", (F.col("us") * 0.03).alias("time"), "code")
    x = Q.align_to_screen(r, log, ["session"], 0.03)[0]
    return x


@query("C10_segment", """WITH m AS (SELECT *, sum((code = 3000)::INT) OVER (PARTITION BY session ORDER BY us, seq) AS g FROM ev WHERE code IN (3000, 3011, 3091)),
z AS (SELECT session, g, min(CASE WHEN code = 3000 THEN us END) AS "start", min(CASE WHEN code = 3091 THEN us END) AS "stop", min(CASE WHEN code = 3091 THEN us * 1000000 + seq END) AS zk FROM m WHERE g > 0 GROUP BY ALL HAVING zk IS NOT NULL)
SELECT z.session, "start", max(CASE WHEN code = 3011 AND m.us * 1000000 + seq < zk THEN m.us END) AS "trigger", "stop", "start" - max(CASE WHEN code = 3011 AND m.us * 1000000 + seq < zk THEN m.us END) AS "offset" FROM z JOIN m USING (session, g) GROUP BY z.session, "start", "stop" """)
def _(t):
    c = F.col("code")
    return J.segment(t.ev, ["session"], ["us", "seq"], "us", "code", c == 3000, c == 3011, c == 3091)


@query("C13_pairs", "SELECT a.state AS first, b.state AS second FROM (SELECT DISTINCT state FROM sig) a JOIN (SELECT DISTINCT state FROM sig) b ON a.state < b.state")
def _(t):
    return J.pairs(t.sig, "state")


@query("C14_neighbour_join", "SELECT a.outcome, b.outcome AS outcome_next, count(*) AS n FROM tr a JOIN tr b ON b.trial = a.trial + 2 GROUP BY ALL")
def _(t):
    x = J.neighbour_join(t.tr.select("trial", "outcome"), [], "trial", 2, ["outcome"])
    return x.groupBy("outcome", "outcome_next").agg(F.count(F.lit(1)).alias("n"))


@query("C15_event_window", 'SELECT a.session, a.pos AS anchor, (s.pos - a.pos)::INT AS "offset", s.state FROM seq a JOIN seq s ON a.session = s.session AND s.pos BETWEEN a.pos - 5 AND a.pos + 5 WHERE a.is_exit')
def _(t):
    x = J.event_window(t.seq, t.seq.where("is_exit"), ["session"], "pos", 5, 5)
    return x.select("session", "anchor", "offset", "state")


@query("C16_clock_offset", "SELECT session, min(us) - min(us - 1500 * session - 7) AS clock_offset FROM ev WHERE code = 3000 GROUP BY session")
def _(t):
    other = t.ev.withColumn("us", F.col("us") - 1500 * F.col("session") - 7)
    return J.clock_offset(t.ev, other, ["session"], "us", F.col("code") == 3000)


@query("C17_keep_groups_with_any", "SELECT session, trial FROM tr WHERE session IN (SELECT session FROM tr WHERE rt > 450000)")
def _(t):
    return J.keep_groups_with_any(t.tr, "session", F.col("rt") > 450000).select("session", "trial")


@query("F1_top_per_group", "SELECT session, trial, rt FROM tr QUALIFY row_number() OVER (PARTITION BY session ORDER BY rt DESC, trial) = 1")
def _(t):
    w = Window.partitionBy("session").orderBy(F.col("rt").desc(), "trial")
    return t.tr.withColumn("r", F.row_number().over(w)).where("r = 1").select("session", "trial", "rt")


@query("F2_first_distinct", "SELECT trial, state FROM tr WHERE state IN (SELECT DISTINCT state FROM tr ORDER BY state LIMIT 2)")
def _(t):
    first = t.tr.select("state").distinct().orderBy("state").limit(2)
    return t.tr.join(first, "state", "left_semi").select("trial", "state")


@query("F3_limit_per_group", "SELECT session, trial FROM tr QUALIFY row_number() OVER (PARTITION BY session ORDER BY trial) <= 3")
def _(t):
    return t.tr.withColumn("r", F.row_number().over(Window.partitionBy("session").orderBy("trial"))).where("r <= 3").select("session", "trial")


@query("F4_sort_spikes", "SELECT channel, min(t) AS first_t, max(t) AS last_t, count(*) AS n FROM spk GROUP BY channel ORDER BY channel")
def _(t):
    x = t.spk.repartitionByRange("channel", "t").sortWithinPartitions("channel", "t")
    return x.groupBy("channel").agg(F.min("t").alias("first_t"), F.max("t").alias("last_t"), F.count(F.lit(1)).alias("n")).orderBy("channel")


@query("F5_sorted_lists", "SELECT session, array_to_string(list_sort(list_distinct(list(event_type))), ',') AS kinds FROM ev GROUP BY session ORDER BY session")
def _(t):
    return t.ev.groupBy("session").agg(F.concat_ws(",", F.array_sort(F.collect_set("event_type"))).alias("kinds")).orderBy("session")


@query("G1_union_common", """WITH s AS (SELECT *, sample - session AS aligned FROM sig), c AS (SELECT aligned FROM s GROUP BY aligned HAVING count(DISTINCT session) = (SELECT count(DISTINCT session) FROM s))
SELECT session, trial, channel, aligned, value FROM s WHERE aligned IN (SELECT aligned FROM c)""")
def _(t):
    # sessions begin at other times: their samples overlap in part only
    x = t.sig.select("session", "trial", "channel", (F.col("sample") - F.col("session")).alias("aligned"), "value")
    return J.common_points(x, "session", "aligned")


@query("G2_intersect", "SELECT trial FROM tr WHERE outcome = 'F' INTERSECT SELECT l_orderkey FROM lineitem WHERE l_discount > 0.09")
def _(t):
    return t.tr.where("outcome = 'F'").select("trial").intersect(t("lineitem").where("l_discount > 0.09").select(F.col("l_orderkey").alias("trial")))


@query("G3_symmetric_difference", "(SELECT trial FROM tr WHERE rt > 200000 EXCEPT SELECT trial FROM tr WHERE outcome = 'O') UNION (SELECT trial FROM tr WHERE outcome = 'O' EXCEPT SELECT trial FROM tr WHERE rt > 200000)")
def _(t):
    a, b = t.tr.where("rt > 200000").select("trial"), t.tr.where("outcome = 'O'").select("trial")
    return a.exceptAll(b).unionByName(b.exceptAll(a))


@query("G4_first_occurrence", "SELECT session, code, min(us) AS first_us FROM ev GROUP BY session, code")
def _(t):
    return t.ev.groupBy("session", "code").agg(F.min("us").alias("first_us"))
