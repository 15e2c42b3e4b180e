"""Queries of section A (event logs, signals, tables) and the trial tables of section D that are read from logs."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import emitters as M
from ..operators import trials as R
from ..sources import eventlog as E
from ..sources import recordings as V
from ..sources import signals as S
from ..sources import tables as B
from ..staging import new_dir, numbered
from .registry import query, r6

#: Events as log lines: each event a marker line, clicks followed by a description, other kinds by further lines.
_LOG = """SELECT session, ln AS line_no, line FROM (
  SELECT user_id AS session, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id, part) AS ln, line FROM (
    SELECT user_id, ts, event_id, 0 AS part, (event_id / 8)::VARCHAR || ',[' || (event_id % 9) || '],LogTypes::Eventmarker,' || (event_id % 100) || ',' || (event_id * 2) AS line FROM events
    UNION ALL SELECT user_id, ts, event_id, 1, CASE event_type WHEN 'click' THEN (event_id / 8)::VARCHAR || ',[' || (event_id % 9) || '],LogTypes::Description,said ' || event_id
      WHEN 'view' THEN (event_id / 8)::VARCHAR || ',[' || (event_id % 9) || '],LogTypes::Location,X=' || event_id || ' Y=nan? Z=' || (event_id % 7)
      WHEN 'error' THEN 'broken line' WHEN 'signup' THEN (event_id / 8)::VARCHAR || ',[' || (event_id % 9) || '],LogTypes::Guid,state_' || (event_id % 5)
      ELSE (event_id / 8)::VARCHAR || ',[' || (event_id % 9) || '],LogTypes::Rotation,X=1 Y=2 Z=' || (event_id % 3) END FROM events))"""


def _lines(t) -> DataFrame:
    e = t("events")
    i = F.col("event_id")
    head = F.concat((i / 8).cast("string"), F.lit(",["), (i % 9).cast("string"), F.lit("],LogTypes::"))
    kind = F.col("event_type")
    second = (
        F.when(kind == "click", F.concat(head, F.lit("Description,said "), i.cast("string")))
        .when(kind == "view", F.concat(head, F.lit("Location,X="), i.cast("string"), F.lit(" Y=nan? Z="), (i % 7).cast("string")))
        .when(kind == "error", F.lit("broken line"))
        .when(kind == "signup", F.concat(head, F.lit("Guid,state_"), (i % 5).cast("string")))
        .otherwise(F.concat(head, F.lit("Rotation,X=1 Y=2 Z="), (i % 3).cast("string")))
    )
    first = F.concat(head, F.lit("Eventmarker,"), (i % 100).cast("string"), F.lit(","), (i * 2).cast("string"))
    both = e.select(F.col("user_id").alias("session"), "ts", "event_id", F.posexplode(F.array(first, second)).alias("part", "value"))
    return both.withColumn("line_no", F.row_number().over(Window.partitionBy("session").orderBy("ts", "event_id", "part")).cast("long"))


def _log(t) -> DataFrame:
    return E.parse_lines(_lines(t), "value", "session", "line_no")


_PARSED = f"""SELECT session, line_no, regexp_extract(line, '^([^,]*),', 1)::DOUBLE AS ts, regexp_extract(line, '\\[(\\d+)\\]', 1)::BIGINT AS object_id,
  regexp_extract(line, 'LogTypes::(\\w+)', 1) AS kind, regexp_extract(line, 'LogTypes::\\w+,(.*)$', 1) AS payload FROM ({_LOG}) WHERE line <> 'broken line'"""


@query("A1_read_event_log", f"SELECT session, line_no, ts, object_id, kind, payload FROM ({_PARSED})")
def _(t):
    return _log(t).withColumn("payload", F.array_join("payload", ","))


_HEAD = """SELECT user_id AS session, rn, CASE WHEN rn = 1 THEN 'map_' || event_id % 3 || ' loaded at 10:' || event_id % 60 WHEN event_type = 'error' THEN 'Res:X: ' || event_id || ',Y: ' || event_id % 5
  WHEN event_type = 'purchase' AND event_id % 11 = 0 THEN '' ELSE event_type || ': ' || event_id END AS line FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn FROM events)"""


@query("A2_read_log_header", f"""WITH l AS ({_HEAD}), k AS (SELECT session, rn, string_split(line, ':') AS p FROM (SELECT *, min(CASE WHEN rn > 1 AND line = '' THEN rn END) OVER (PARTITION BY session) AS stop FROM l) WHERE rn BETWEEN 2 AND 41 AND (stop IS NULL OR rn < stop)),
f AS (SELECT session, rn, p[1] AS k, trim(p[2]) AS v FROM k WHERE len(p) = 2 UNION ALL SELECT session, rn, p[1] || p[2], trim(split_part(p[3], ',', 1)) FROM k WHERE len(p) = 4 UNION ALL SELECT session, rn, p[1] || split_part(p[3], ',', 2), trim(p[4]) FROM k WHERE len(p) = 4),
g AS (SELECT session, k, arg_max(v, rn) AS v FROM f GROUP BY session, k)
SELECT session, split_part(line, ' ', 1) AS level, split_part(line, ' ', 4) AS start_time, max(CASE WHEN k = 'view' THEN v END) AS view, max(CASE WHEN k = 'ResX' THEN v END) AS res_x, max(CASE WHEN k = 'ResY' THEN v END) AS res_y, nullif(count(k), 0) AS fields FROM l LEFT JOIN g USING (session) WHERE rn = 1 GROUP BY session, line""")
def _(t):
    rn, i, kind = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")), F.col("event_id"), F.col("event_type")
    line = (
        F.when(F.col("n") == 1, F.concat(F.lit("map_"), (i % 3).cast("string"), F.lit(" loaded at 10:"), (i % 60).cast("string")))
        .when(kind == "error", F.concat(F.lit("Res:X: "), i.cast("string"), F.lit(",Y: "), (i % 5).cast("string")))
        .when((kind == "purchase") & (i % 11 == 0), F.lit(""))
        .otherwise(F.concat_ws(": ", kind, i))
    )
    x = E.header(t("events").withColumn("n", rn).select(F.col("user_id").alias("session"), "n", line.alias("value")), "session", "n")
    field = lambda k, n: F.try_element_at("fields", F.lit(k)).alias(n)
    return x.select("session", "level", "start_time", field("view", "view"), field("ResX", "res_x"), field("ResY", "res_y"), F.when(F.col("fields").isNotNull(), F.size("fields")).cast("long").alias("fields"))


@query("A3_event_markers", f"""SELECT session, line_no, ts, code, device_ts, description FROM (SELECT *, split_part(payload, ',', 1)::BIGINT AS code, split_part(payload, ',', 2)::DOUBLE AS device_ts,
  CASE WHEN lead(kind) OVER w = 'Description' THEN lead(payload) OVER w END AS description FROM ({_PARSED}) WINDOW w AS (PARTITION BY session ORDER BY line_no)) WHERE kind = 'Eventmarker'""")
def _(t):
    return E.event_markers(_log(t))


@query("A1_log_source", f"SELECT session::VARCHAR AS session, line_no, ts, object_id, kind, payload FROM ({_PARSED}) WHERE ts >= 20")
def _(t):
    """Logs written as files, read through their own data source with a bound on time."""
    folder = new_dir(t.spark, "logs")
    V.write_log(_lines(t), folder, "session", ["line_no"], "value")
    V.register(t.spark)
    log = t.spark.read.format("trial_log").load(folder).where("ts >= 20.0")
    return log.withColumn("payload", F.array_join("payload", ","))


@query("A10_signal_source", "SELECT session::VARCHAR AS session, trial, channel, sample, round(session * 10 + sample / 64, 6)::DOUBLE AS t, value FROM sig WHERE session * 10 + sample / 64 <= 30.5")
def _(t):
    folder = new_dir(t.spark, "signals")
    meta = t.sig.select("session").distinct().select("session", F.lit(64.0).alias("sample_rate"), (F.col("session") * 10.0).alias("starting_time"))
    V.write_signal(t.sig, folder, "session", meta)
    V.register(t.spark)
    x = t.spark.read.format("trial_signal").load(folder).where("t <= 30.5")
    return x.withColumn("t", r6("t"))


@query("P13_segments", """SELECT session, us AS "start", CASE WHEN after = 3091 THEN stop END AS "stop" FROM (SELECT *, lead(code) OVER w AS after, lead(us) OVER w AS stop FROM ev WHERE code IN (3000, 3091) WINDOW w AS (PARTITION BY session ORDER BY us, seq)) WHERE code = 3000""")
def _(t):
    """A table function over sessions, called in SQL."""
    M.register(t.spark)
    marks = t.ev.select("session", "us", "seq", "code")
    return t.spark.sql("SELECT * FROM segments(TABLE({marks}) PARTITION BY session ORDER BY (us, seq), 3000, 3091)", marks=marks)


@query("P13_kgrams", """SELECT session, pos, array_to_string(gram, ',') AS gram FROM (SELECT session, row_number() OVER (PARTITION BY session ORDER BY us, seq) - 1 AS pos, list(code) OVER (PARTITION BY session ORDER BY us, seq ROWS BETWEEN CURRENT ROW AND 4 FOLLOWING) AS gram FROM ev) WHERE len(gram) = 5""")
def _(t):
    return M.kgrams(t.ev.select("session", "us", "seq", F.col("code").cast("long").alias("code")), ["us", "seq"], 5).withColumn("gram", F.array_join(F.col("gram").cast("array<string>"), ","))


_REG = f"""SELECT session, object_id, row_number() OVER w - 1 AS "repeat", payload AS name, line_no AS "start", lead(line_no) OVER w - 1 AS "end" FROM ({_PARSED}) WHERE kind = 'Guid' WINDOW w AS (PARTITION BY session, object_id ORDER BY line_no)"""


@query("A4_state_times", f"""SELECT l.session, l.object_id, "repeat"::INT AS "repeat", l.ts, l.line_no FROM ({_PARSED}) l JOIN ({_REG}) r ON l.session = r.session AND l.object_id = r.object_id AND l.line_no BETWEEN r."start" AND coalesce(r."end", 9223372036854775807) WHERE kind = 'Eventmarker' AND name LIKE 'state_2%'""")
def _(t):
    log = _log(t)
    return E.state_times(log, E.object_registry(log), "state_2", "Eventmarker")


@query("A5_object_registry", f'SELECT session, object_id, "repeat"::INT AS "repeat", name, "start", "end" FROM ({_REG})')
def _(t):
    return E.object_registry(_log(t))


@query("A5_named_objects", """SELECT user_id AS session, event_id % 9 AS object_id, row_number() OVER w - 1 AS "repeat", (event_id % 3)::INT AS type, event_type || '_' || event_id % 5 AS name, event_id * 2 AS "start", lead(event_id * 2) OVER w - 1 AS "end" FROM events WINDOW w AS (PARTITION BY user_id, event_id % 9 ORDER BY event_id)""".replace("row_number() OVER w - 1", "(row_number() OVER w - 1)::INT"))
def _(t):
    """Every event an object: a Guid row and the row that names it, by one of three kinds."""
    i = F.col("event_id")
    kinds = ["ObjectName", "StateName", "SourceName"]
    born = F.struct(F.lit("Guid").alias("kind"), F.array(F.lit("0")).alias("payload"))
    named = F.struct(F.element_at(F.array(*map(F.lit, kinds)), (i % 3 + 1).cast("int")).alias("kind"), F.array(F.lit("x"), F.concat("event_type", F.lit("_"), (i % 5).cast("string"), F.lit(" "))).alias("payload"))
    log = t("events").select(F.col("user_id").alias("session"), (i % 9).alias("object_id"), "event_id", F.posexplode(F.array(born, named)).alias("_p", "x")).select("session", "object_id", (F.col("event_id") * 2 + F.col("_p")).alias("line_no"), "x.kind", "x.payload")
    return E.named_objects(log, kinds)


_PARAM = """SELECT user_id AS session, event_id % 9 AS object_id, ts, event_id, props, value, event_type FROM events"""


@query("A6_typed_params", """SELECT session, object_id, (event_id / 8)::DOUBLE AS value_ts, name, 'Float' AS type, CASE name WHEN 'k' THEN k WHEN 'v' THEN value END AS number, NULL::BOOLEAN AS flag, NULL::VARCHAR AS string FROM (
  SELECT user_id AS session, event_id % 9 AS object_id, event_id, value, (props->>'k')::DOUBLE AS k, unnest(['k', 'v', 'w']) AS name FROM events)""")
def _(t):
    return E.typed_params(_param_log(t)).drop("vector")


@query("A6_all_types", """SELECT session, object_id, value_ts, type, name, CASE type WHEN 'Int' THEN n WHEN 'Float' THEN value END AS number, CASE WHEN type = 'Bool' THEN n % 3 > 0 END AS flag,
  CASE WHEN type = 'Vector' THEN value END AS x, CASE WHEN type = 'Vector' THEN n END AS z, CASE WHEN type = 'String' THEN event_type END AS string FROM (
  SELECT user_id AS session, event_id % 9 AS object_id, event_id / 8 AS value_ts, value, event_type, (event_id % 50)::DOUBLE AS n, ['Int', 'Bool', 'Vector', 'String', 'Float'][event_id % 5 + 1] AS type, unnest(['a', 'b']) AS name FROM events)""")
def _(t):
    """Parameters of the five types, their value lines of the headers' own kinds."""
    i = F.col("event_id")
    kind = F.element_at(F.array(*map(F.lit, ("Int", "Bool", "Vector", "String", "Float"))), (i % 5 + 1).cast("int"))
    base = t("events").select(F.col("user_id").alias("session"), (i % 9).alias("object_id"), (i / 8).alias("ts"), i.alias("event_id"), kind.alias("type"), (i % 50).cast("string").alias("n"), F.col("value").cast("string").alias("v"), "event_type")
    text = F.when(F.col("type") == "Int", F.col("n")).when(F.col("type") == "Bool", (F.col("n").cast("long") % 3).cast("string")).when(F.col("type") == "Vector", F.concat(F.lit("X="), "v", F.lit(" Y=none Z="), "n")).when(F.col("type") == "String", F.concat("event_type", F.lit(" "))).otherwise(F.col("v"))
    head = F.struct(F.concat("type", F.lit("ParameterHeader")).alias("kind"), F.array(F.lit("a"), F.lit("b")).alias("payload"))
    vals = F.struct(F.concat("type", F.lit("Parameter")).alias("kind"), F.array(text, text).alias("payload"))
    log = base.select("session", "object_id", "ts", "event_id", F.posexplode(F.array(head, vals)).alias("_p", "x")).select("session", "object_id", "ts", (F.col("event_id") * 2 + F.col("_p")).alias("line_no"), "x.kind", "x.payload")
    return E.typed_params(log).select("session", "object_id", "value_ts", "type", "name", "number", "flag", "vector.x", "vector.z", "string")


@query("A6_initial_params", """SELECT session, object_id, value_ts, name, CASE name WHEN 'k' THEN k WHEN 'v' THEN value END AS number FROM (
  SELECT user_id AS session, event_id % 9 AS object_id, (event_id / 8)::DOUBLE AS value_ts, value, (props->>'k')::DOUBLE AS k, unnest(['k', 'v', 'w']) AS name FROM events
  QUALIFY event_id = min(event_id) OVER (PARTITION BY user_id, event_id % 9))""")
def _(t):
    return E.initial_only(E.typed_params(_param_log(t))).select("session", "object_id", "value_ts", "name", "number")


@query("A6_param_history", """SELECT session, object_id, name, count(*)::INT AS changes, round(sum(coalesce(number, 0)), 6) AS total, arg_max(ts, ts) AS last_ts FROM (
  SELECT *, lag(number) OVER w AS b, row_number() OVER w AS n FROM (SELECT user_id AS session, event_id % 9 AS object_id, (event_id / 8)::DOUBLE AS ts, name, CASE name WHEN 'k' THEN (props->>'k')::DOUBLE WHEN 'v' THEN value END AS number FROM events, (VALUES ('k'), ('v'), ('w')) v(name))
  WINDOW w AS (PARTITION BY session, object_id, name ORDER BY ts)) WHERE n = 1 OR number IS DISTINCT FROM b GROUP BY ALL""")
def _(t):
    x = E.param_history(E.typed_params(_param_log(t)))
    total = F.aggregate(F.transform("history", lambda h: F.coalesce(h["number"], F.lit(0.0))), F.lit(0.0), lambda a, b: a + b)
    return x.select("session", "object_id", "name", F.size("history").alias("changes"), r6(total).alias("total"), F.element_at("history", -1)["ts"].alias("last_ts"))


def _param_log(t) -> DataFrame:
    i = F.col("event_id")
    base = t("events").select(F.col("user_id").alias("session"), (i % 9).alias("object_id"), (i / 8).alias("ts"), i.alias("event_id"), F.get_json_object("props", "$.k").alias("k"), F.col("value").cast("string").alias("v"))
    head = F.struct(F.lit("FloatParameterHeader").alias("kind"), F.array(F.lit("k"), F.lit("v"), F.lit("w")).alias("payload"))
    vals = F.struct(F.lit("ParameterValues").alias("kind"), F.array("k", "v", F.lit("none")).alias("payload"))
    log = base.select("session", "object_id", "ts", "event_id", F.posexplode(F.array(head, vals)).alias("_p", "x")).select("session", "object_id", "ts", (F.col("event_id") * 2 + F.col("_p")).alias("line_no"), "x.kind", "x.payload")
    return log


@query("A7_object_track", f"""WITH l AS (SELECT session, object_id, ts, payload FROM ({_PARSED}) WHERE kind = 'Location'), r AS (SELECT session, object_id, ts, payload FROM ({_PARSED}) WHERE kind = 'Rotation')
SELECT session, object_id, ts, regexp_extract(l.payload, 'X=(\\S+)', 1)::DOUBLE AS x, TRY_CAST(nullif(regexp_extract(l.payload, 'Y=(\\S+)', 1), '') AS DOUBLE) AS y, regexp_extract(l.payload, 'Z=(\\S+)', 1)::DOUBLE AS z, regexp_extract(r.payload, 'Z=(\\S+)', 1) AS rz FROM l FULL JOIN r USING (session, object_id, ts)""".replace("regexp_extract(l.payload, 'X=(\\S+)', 1)::DOUBLE", "TRY_CAST(regexp_extract(l.payload, 'X=(\\S+)', 1) AS DOUBLE)").replace("regexp_extract(l.payload, 'Z=(\\S+)', 1)::DOUBLE", "TRY_CAST(regexp_extract(l.payload, 'Z=(\\S+)', 1) AS DOUBLE)").replace("regexp_extract(r.payload, 'Z=(\\S+)', 1) AS rz", "TRY_CAST(regexp_extract(r.payload, 'Z=(\\S+)', 1) AS DOUBLE) AS rz"))
def _(t):
    x = E.object_track(_log(t))
    return x.select("session", "object_id", "ts", "location.x", "location.y", "location.z", F.col("rotation.z").alias("rz"))


@query("A8_kind_rows", f"SELECT session, ts, split_part(payload, ',', 1)::INT AS code, split_part(payload, ',', 2)::BIGINT AS device FROM ({_PARSED}) WHERE kind = 'Eventmarker'")
def _(t):
    return E.kind_rows(_log(t), "Eventmarker", [("code", "int"), ("device", "long")], "session")


@query("A9_grep_lines", """WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS n FROM documents)
SELECT h.doc_id, h.n AS hit, l.n, l.line FROM l h JOIN l ON h.doc_id = l.doc_id AND l.n BETWEEN h.n + 1 AND h.n + 2 WHERE contains(h.line, 'License')""")
def _(t):
    lines = t("documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("n", "line")).withColumn("n", F.col("n").cast("long"))
    return E.lines_after(lines, "doc_id", "n", "line", "License", 1, 2).select("doc_id", "hit", "n", "line")


@query("A9_count_matches", "SELECT doc_id, ((length(text) - length(replace(text, 'the', ''))) // 3)::BIGINT AS n FROM documents")
def _(t):
    return t("documents").select("doc_id", E.count_matches(F.col("text"), "the").alias("n"))


@query("A10_signal_round_trip", "SELECT trial, channel, sample, value FROM sig")
def _(t):
    return S.unpack(S.pack(t.sig, ["trial", "channel"]), ["trial", "channel"])


@query("A10_signal_files", "SELECT channel, 'ch' || channel AS name, session, min(sample / 64.0)::DOUBLE AS t0, max(sample / 64.0)::DOUBLE AS t1, count(*) AS n, round(sum(value), 4) AS total FROM sig GROUP BY ALL")
def _(t):
    """Samples, trials and channels written as files and read back, with times by the channels' own sample rate."""
    path = new_dir(t.spark, "signal")
    channels = t.sig.select("channel").distinct().select("channel", F.concat(F.lit("ch"), F.col("channel").cast("string")).alias("name"), F.lit(64.0).alias("sample_rate"))
    S.write_signal(t.sig, t.sig.select("session", "trial").distinct().withColumn("starting_time", F.lit(0.0)), path, channels=channels)
    back, _ = S.read_signal(t.spark, path)
    x = back.join(S.read_channels(t.spark, path), "channel").withColumn("t", F.col("sample") / F.col("sample_rate"))
    x = x.groupBy("channel", "name", F.col("session").cast("long").alias("session")).agg(F.min("t").alias("t0"), F.max("t").alias("t1"), F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
    return x.withColumn("total", F.round("total", 4) + F.lit(0.0))


@query("A11_trial_time_vector", "SELECT o_orderkey AS trial, i::INT AS sample, (i - 3) / 64 AS t FROM (SELECT o_orderkey, unnest(range(o_orderkey % 6)) AS i FROM orders)")
def _(t):
    x = t.tr.select("trial", (F.col("trial") % 6).alias("n"), F.lit(-3).alias("offset"))
    return S.trial_time(x, 64).select("trial", "sample", "t")


@query("A12_codes_round_trip", "SELECT session, list_sum(list(code))::BIGINT AS total, count(*)::INT AS n FROM ev GROUP BY session")
def _(t):
    x = t.ev.groupBy("session").agg(B.codes_to_text(F.collect_list("code")).alias("text"))
    codes = B.text_to_codes(F.col("text"))
    return x.select("session", F.aggregate(codes, F.lit(0).cast("long"), lambda a, b: a + b).alias("total"), F.size(codes).alias("n"))


@query("A12_event_lists", "SELECT session, array_to_string(list(code ORDER BY us, seq), ',') AS codes FROM ev GROUP BY session")
def _(t):
    """Each session's codes as text, written as a delimited file, read back, taken apart and joined again."""
    path = new_dir(t.spark, "codes")
    listed = t.ev.groupBy("session").agg(F.array_sort(F.collect_list(F.struct("us", "seq", "code"))).getField("code").alias("codes"))
    listed.select("session", B.codes_to_text(F.col("codes")).alias("codes")).write.csv(path, header=True, sep=";")
    back = B.read_delimited(t.spark, path, "session long, codes string", separator=";")
    return back.select("session", B.codes_to_text(B.text_to_codes(F.col("codes"))).alias("codes"))


@query("A13_slice_by_index", "SELECT 'S' || session || '_' || 20240100 + session AS session_id, (20240100 + session)::VARCHAR AS date, count(*) AS n FROM (SELECT (row_number() OVER (ORDER BY us, seq) - 1) // 500 AS session FROM ev) GROUP BY session")
def _(t):
    ranked = numbered(t.ev.select("us", "seq"), ["us", "seq"])
    last = ranked.agg(F.floor(F.max("pos") / 500).alias("m"))
    entry = lambda k: F.struct(F.concat(F.lit("S"), k.cast("string"), F.lit("_"), (F.lit(20240100) + k).cast("string")).alias("session_id"), (k * 500).alias("start_idx"), (k * 500 + 499).alias("end_idx"))
    index = last.select(F.to_json(F.transform(F.sequence(F.lit(0).cast("long"), "m"), entry)).alias("text"))
    return B.slice_by_index(ranked, index, "text", "pos").groupBy("session_id", "date").agg(F.count(F.lit(1)).alias("n"))


@query("A14_session_from_path", "SELECT page_id, nullif(split_part(url, '/', 4), '') AS lang, regexp_extract(split_part(url, '/', 5), '^(\\d+)', 1) AS number FROM pages")
def _(t):
    host = F.split_part("url", F.lit("/"), F.lit(3))
    x = t("pages").withColumn("host", host)
    parts = F.split("url", "/")
    return x.select("page_id", F.nullif(F.get(parts, F.lit(3)), F.lit("")).alias("lang"), F.regexp_extract(F.coalesce(F.get(parts, F.lit(4)), F.lit("")), r"^(\d+)", 1).alias("number"))


@query("A14_path_fields", """SELECT doc_id, coalesce(source, 'none') AS project, coalesce(lang, 'none') AS subject, (20240100 + doc_id % 28)::VARCHAR AS day, CASE WHEN doc_id % 3 > 0 THEN lpad((doc_id % 1000000)::VARCHAR, 6, '0') END AS tag FROM documents""")
def _(t):
    i = F.col("doc_id")
    name = F.when(i % 3 > 0, F.concat(F.lit("b_events"), F.lpad((i % 1000000).cast("string"), 6, "0"), F.lit(".npy"))).otherwise("b_words.npy")
    path = F.concat_ws("/", F.lit("/data/projects"), F.coalesce("source", F.lit("none")), F.coalesce("lang", F.lit("none")), (20240100 + i % 28).cast("string"), name)
    x = t("documents").select("doc_id", path.alias("path"))
    return x.select("doc_id", *B.path_fields(F.col("path"), "projects", ["project", "subject", "day"]), B.alignment_tag(F.col("path")).alias("tag"))


@query("A15_new_results_only", "SELECT DISTINCT session, state FROM tr WHERE (session, state) NOT IN (SELECT session, state FROM tr WHERE outcome = 'F')")
def _(t):
    known = t.tr.where("outcome = 'F'").select("session", "state")
    return B.without_known(t.tr.select("session", "state"), known, ["session", "state"])


@query("A16_append_new", "SELECT c_custkey AS session FROM customer UNION ALL SELECT user_id FROM (SELECT DISTINCT user_id FROM events) WHERE user_id NOT IN (SELECT c_custkey FROM customer)")
def _(t):
    old, new = t("customer").select(F.col("c_custkey").alias("session")), t("events").select(F.col("user_id").alias("session"))
    return B.append_new(old, new, ["session"])


@query("A17_session_inventory", "SELECT o_custkey, count(*) AS trials, array_to_string(list_sort(list_distinct(list(o_orderpriority))), ',') AS tasks FROM orders WHERE o_orderdate >= TIMESTAMP '1996-01-01' GROUP BY o_custkey HAVING list_contains(list(o_orderpriority), '2-HIGH')")
def _(t):
    return B.session_inventory(t("orders"), "o_custkey", "o_orderdate", "o_orderpriority", "1996-01-01 00:00:00", "2-HIGH")


@query("D25_typical_bins", """WITH f AS (SELECT session, us, row_number() OVER (PARTITION BY session ORDER BY us, seq) AS k, count(*) OVER (PARTITION BY session) AS n, us - lag(us) OVER (PARTITION BY session ORDER BY us, seq) AS gap FROM ev),
ok AS (SELECT session FROM f GROUP BY session HAVING max(gap) < 200000000000), m AS (SELECT mode(n) AS n FROM (SELECT session, any_value(n) AS n FROM f WHERE session IN (SELECT session FROM ok) GROUP BY session)),
b AS (SELECT n, count(*) AS c FROM (SELECT session, any_value(n) AS n FROM f WHERE session IN (SELECT session FROM ok) GROUP BY session) GROUP BY n ORDER BY c DESC, n LIMIT 1)
SELECT k::INT AS k, round(avg(us - s0) / 1000000, 3) AS t FROM (SELECT f.*, min(us) OVER (PARTITION BY session) AS s0 FROM f WHERE session IN (SELECT session FROM ok)) WHERE n = (SELECT n FROM b) GROUP BY k""")
def _(t):
    x = R.typical_bins(t.ev, ["session"], ["us", "seq"], "us", 200_000_000_000)
    return x.select("k", F.round(F.col("mean_time") / 1_000_000, 3).alias("t"))


@query("D26_bar_info", "SELECT direction, snapped, count(*) AS n, count(DISTINCT speed) = 1 AS consistent FROM (SELECT p_partkey, (p_size * 7 % 360) / 10.0 AS direction, (round((p_size * 7 % 360) / 10.0 / 12) * 12)::DOUBLE AS snapped, p_size % 3 AS speed FROM part) GROUP BY ALL")
def _(t):
    x = R.bar_info(t("part").withColumn("code", 5000 + F.col("p_size") * 7 % 360).withColumn("speed", F.col("p_size") % 3), "code", 5000, 30, "speed")
    return x


_RUN = "SELECT *, sum((code = 3000)::INT) OVER (PARTITION BY session ORDER BY us, seq) AS trial FROM ev"


@query("D29_trial_info", f"""WITH r AS (SELECT *, max(trial) OVER (PARTITION BY session) AS final FROM ({_RUN}))
SELECT session, trial::INT AS trial, min(us) AS start_us, bool_or(code = 1) AS correct, bool_or(code = 2) AS wrong, bool_or(code = 3091) AS leaves, count(*) AS events,
  list(code ORDER BY us, seq) FILTER (WHERE code IN (1, 2))[1] AS first_choice, list(code ORDER BY us, seq) FILTER (WHERE code IN (1, 2))[2] AS second_choice FROM r WHERE trial > 0 AND trial < final GROUP BY session, trial""")
def _(t):
    return R.trial_info(t.ev, ["session"], ["us", "seq"], "code", 3000, {"correct": 1, "wrong": 2, "leaves": 3091}, [1, 2]).withColumnRenamed("start_time", "start_us")


_RICH = """(SELECT session, us, seq, k, code FROM (SELECT session, us, seq, unnest(codes) AS code, unnest(range(len(codes))) AS k FROM (SELECT session, us, seq, CASE event_type
  WHEN 'signup' THEN CASE WHEN seq % 3 = 0 THEN [10 + seq % 40, 3000] ELSE [3000] END WHEN 'view' THEN [3006, 10000 + seq % 50, 50 + seq % 50, 3400 + seq % 101] WHEN 'click' THEN [1] WHEN 'error' THEN [2, 100 + seq % 40]
  ELSE [3101, 7, 10000 + seq % 90, 4000 + seq % 7, 10000 + seq % 20, 3090] END AS codes FROM ev)))"""
_TABLE = f"""WITH c AS (SELECT * FROM {_RICH}), m AS (SELECT *, sum((code = 3000)::INT) OVER w AS trial, last_value(CASE WHEN code BETWEEN 10 AND 49 THEN code - 10 END IGNORE NULLS) OVER w AS block, row_number() OVER w AS o,
  lead(code, 1) OVER v AS n1, lead(code, 2) OVER v AS n2, lead(code, 3) OVER v AS n3, lead(code, 4) OVER v AS n4 FROM c WINDOW v AS (PARTITION BY session ORDER BY us, seq, k), w AS (PARTITION BY session ORDER BY us, seq, k ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
g AS (SELECT session, trial::BIGINT AS trial, min(us) AS start_time, min(us) FILTER (code = 3090) AS ended, bool_or(code = 1) AS correct, bool_or(code = 2) AS wrong, coalesce(arg_max(code - 100, o) FILTER (code BETWEEN 101 AND 139 AND code % 10 BETWEEN 3 AND 7), 0) AS error,
  list(code ORDER BY o) FILTER (code BETWEEN 50 AND 99) AS cs, list(code ORDER BY o) FILTER (code BETWEEN 3400 AND 3500) AS ms, coalesce(arg_max(n1 - 10000, o) FILTER (code = 3006), 0) AS placeholder_distance,
  coalesce(arg_max(n2 - 10000, o) FILTER (code = 3101), 0) AS distance, coalesce(arg_max(CASE WHEN n3 % 10 = 4 THEN n4 - 10000 ELSE 10000 - n4 END, o) FILTER (code = 3101), 0) AS "offset",
  coalesce(bool_or(n3 % 10 = 4) FILTER (code = 3101), false) AS "right", coalesce(bool_or(n3 % 10 <> 4) FILTER (code = 3101), false) AS "left", arg_min(coalesce(block, -1), o) AS block FROM m WHERE trial > 0 GROUP BY session, trial),
t AS (SELECT * EXCLUDE (cs, ms, block), coalesce(cs[1] - 50, 0) AS condition_target, CASE WHEN len(cs) > 1 THEN cs[-1] - 50 ELSE 0 END AS condition_distractor, coalesce(ms[1] - 3400, 0) AS morph_target, CASE WHEN len(ms) > 1 THEN ms[-1] - 3400 ELSE 0 END AS morph_distractor,
  CASE WHEN block >= 0 THEN block END AS base_block, lead(start_time) OVER (PARTITION BY session ORDER BY trial) AS end_time FROM g)"""


def _rich(t):
    s, kind = F.col("seq"), F.col("event_type")
    array = lambda *x: F.array(*[(c if not isinstance(c, int) else F.lit(c)).cast("long") for c in x])
    codes = (
        F.when(kind == "signup", F.when(s % 3 == 0, array(10 + s % 40, 3000)).otherwise(array(3000))).when(kind == "view", array(3006, 10000 + s % 50, 50 + s % 50, 3400 + s % 101))
        .when(kind == "click", array(1)).when(kind == "error", array(2, 100 + s % 40)).otherwise(array(3101, 7, 10000 + s % 90, 4000 + s % 7, 10000 + s % 20, 3090))
    )
    return t.ev.select("session", "us", "seq", F.posexplode(codes).alias("k", "code"))


@query("D29_trial_table", f"{_TABLE} SELECT * EXCLUDE (ended) FROM t WHERE end_time IS NOT NULL")
def _(t):
    return R.trial_table(_rich(t), ["session"], ["us", "seq", "k"], "code", 3000)


@query("D29_trials_to_end", f"{_TABLE} SELECT session, trial, start_time, ended AS end_time, distance, base_block FROM t WHERE end_time IS NOT NULL AND ended IS NOT NULL")
def _(t):
    """Trials that hold an end marker, up to it."""
    return R.trial_table(_rich(t), ["session"], ["us", "seq", "k"], "code", 3000, start_at=3000, end_at=3090).select("session", "trial", "start_time", "end_time", "distance", "base_block")


@query("D30_trial_payloads", f"""SELECT session, trial::INT AS trial, array_to_string(list(code ORDER BY us, seq), ',') AS codes, max(us) - min(us) AS span FROM ({_RUN}) WHERE trial > 0 GROUP BY session, trial""")
def _(t):
    x = R.trial_payloads(t.ev, ["session"], ["us", "seq"], "code", 3000)
    return x.select("session", "trial", F.array_join(F.transform(F.col("events").getField("code"), lambda c: c.cast("string")), ",").alias("codes"), F.array_max(F.col("events").getField("t")).alias("span"))


@query("D30_trial_tracks", f"""WITH s AS (SELECT session, trial::INT AS trial, us FROM ({_RUN}) WHERE code = 3000), v AS (SELECT e.session, s.trial, e.us, e.value FROM ev e ASOF JOIN s ON e.session = s.session AND e.us >= s.us WHERE e.code = 3011),
o AS (SELECT e.session, s.trial, count(*)::INT AS n FROM ev e ASOF JOIN s ON e.session = s.session AND e.us >= s.us WHERE e.code = 2 GROUP BY e.session, s.trial),
z AS (SELECT session, trial, count(*)::INT AS n_track, round(sum(value - first), 6) AS moved FROM (SELECT *, first_value(value) OVER (PARTITION BY session, trial ORDER BY us, value) AS first FROM v) GROUP BY session, trial)
SELECT s.session, s.trial, n_track, moved, o.n AS n_objects FROM s LEFT JOIN z USING (session, trial) LEFT JOIN o USING (session, trial)""")
def _(t):
    """Each trial's track, counted from its first place, and the objects that appear in it."""
    starts = R.trial_number(t.ev, ["session"], ["us", "seq"], "code", 3000).where("code = 3000").select("session", "trial", F.col("us").alias("start"))
    x = R.attach_payloads(starts, ["session"], "trial", "start", {"track": (t.ev.where("code = 3011"), "us", ["value"], ["value"]), "objects": (t.ev.where("code = 2"), "us", ["seq"], [])})
    moved = F.aggregate(F.col("track").getField("value"), F.lit(0.0), lambda a, b: a + b)
    size = lambda c: F.when(F.col(c).isNotNull(), F.size(c))
    return x.select("session", "trial", size("track").alias("n_track"), r6(moved).alias("moved"), size("objects").alias("n_objects"))


@query("D31_paired_identity", "SELECT p_partkey, coalesce(a, m[b]) || ' ' || coalesce(b, m[a]) AS identity FROM (SELECT p_partkey, CASE WHEN p_size % 3 > 0 THEN [30, 49, 51, 70][p_size % 4 + 1] END AS a, CASE WHEN p_size % 3 = 0 THEN [30, 49, 51, 70][p_size % 4 + 1] END AS b, MAP {30: 70, 70: 30, 49: 51, 51: 49} AS m FROM part)")
def _(t):
    code = F.element_at(F.array(*map(F.lit, (30, 49, 51, 70))), F.col("p_size") % 4 + 1)
    x = t("part").select("p_partkey", F.when(F.col("p_size") % 3 > 0, code).alias("a"), F.when(F.col("p_size") % 3 == 0, code).alias("b"))
    return x.select("p_partkey", R.paired_identity(F.col("a"), F.col("b"), {30: 70, 49: 51}).alias("identity"))
