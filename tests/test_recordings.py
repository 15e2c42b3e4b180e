"""Data sources of recordings: pruned files, bounds of time, broken lines, missing metadata; and table functions."""

import json

import pytest
from pyspark.sql import functions as F

from tidemark.functions import emitters as M
from tidemark.sources import recordings as V


@pytest.fixture
def logs(spark, tmp_path):
    lines = [("a", 1, "0.5,[1],LogTypes::Guid,x,y"), ("a", 2, "broken"), ("a", 3, "nan?,[1],LogTypes::Guid,x"), ("a", 4, "7.5,[2],LogTypes::Eventmarker"), ("b/ä", 1, "1.0,[3],LogTypes::Location,X=1 Y=2\r"), ("c", 1, "")]
    df = spark.createDataFrame(lines, "session string, n int, value string")
    V.write_log(df, f"file://{tmp_path}/logs", "session", ["n"], "value")
    V.register(spark)
    return spark.read.format("trial_log").load(f"file://{tmp_path}/logs")


def planned(reader, *filters):
    left = list(reader.pushFilters(list(filters)))
    return [p.session for p in reader.partitions()], left


def test_log_lines(spark, logs):
    got = sorted(tuple(r) for r in logs.collect())
    assert got == [("a", 1, 0.5, 1, "Guid", ["x", "y"]), ("a", 4, 7.5, 2, "Eventmarker", [""]), ("b/ä", 1, 1.0, 3, "Location", ["X=1 Y=2"])]
    assert logs.where("session = 'a' AND ts > 0.5").collect() == [r for r in logs.collect() if r.ts == 7.5]
    assert logs.where("session IN ('b/ä', 'none') AND object_id = 3").count() == 1 and logs.where("session = 'none'").count() == 0
    assert logs.where("session = 'a'").rdd.getNumPartitions() == 1 and logs.rdd.getNumPartitions() == 3


def test_filters_choose_files(spark, logs, tmp_path):
    path = {"path": f"file://{tmp_path}/logs"}
    one = planned(V.LogReader(path), V.EqualTo(("session",), "a"), V.GreaterThan(("ts",), 1.0))
    assert one == (["a"], [V.GreaterThan(("ts",), 1.0)])
    assert planned(V.LogReader(path), V.In(("session",), ("a", "c")), V.EqualTo(("session",), "c"))[0] == ["c"]
    assert sorted(planned(V.LogReader(path), V.EqualTo(("kind",), "Guid"))[0]) == ["a", "b/ä", "c"]
    plan = logs.where("session = 'a' AND ts > 1")._jdf.queryExecution().executedPlan().toString()
    assert "session" in plan and "isnotnull(session" not in plan.replace(" ", "").lower() or "BatchScan" in plan
    with pytest.raises(ValueError):
        V.LogReader({})


def test_signal_times_and_metadata(spark, tmp_path):
    folder = f"file://{tmp_path}/signals"
    sig = spark.range(1000).select((F.col("id") % 2).alias("session"), F.floor(F.col("id") / 100).alias("trial"), F.lit(1).alias("channel"), F.floor(F.col("id") / 2).cast("int").alias("sample"), (F.col("id") * 1.5).alias("value"))
    V.write_signal(sig, folder, "session", spark.createDataFrame([(0, 10.0, 0.0), (1, 100.0, 50.0)], "session long, sample_rate double, starting_time double"))
    V.register(spark)
    x = spark.read.format("trial_signal").load(folder)
    assert x.count() == 1000 and x.where("session = '1'").agg(F.min("t"), F.max("t")).first()[:] == (50.0, 54.99)
    late = x.where("t > 52.5").collect()
    assert {r.session for r in late} == {"1"} and len(late) == 249 and all(r.t == 50.0 + r["sample"] / 100 for r in late)
    none = V.SignalReader({"path": folder})
    assert len(list(none.pushFilters([V.GreaterThan(("t",), 1e9)]))) == 1 and not [b for p in none.partitions() for b in none.read(p)]
    meta = tmp_path / "signals" / "session=0" / V.META
    meta.write_text(json.dumps({"sample_rate": 10.0}))
    with pytest.raises(Exception, match="starting_time"):
        x.collect()
    assert x.where("session = '1'").count() == 500


def test_table_functions(spark):
    rows = [(1, 1, 0, 9), (1, 2, 1, 1), (1, 3, 2, 1), (1, 4, 3, 5), (1, 5, 4, 9), (1, 5, 5, 1), (2, 1, 0, 1), (2, 2, 1, 9), (None, 1, 0, 1)]
    df = spark.createDataFrame(rows, "session long, us long, seq long, code long")
    want = [(None, 1, None), (1, 2, None), (1, 3, 5), (1, 5, None), (2, 1, 2)]
    assert sorted(map(tuple, M.segments(df, ["us", "seq"], 1, 9).collect()), key=str) == sorted(want, key=str)
    M.register(spark)
    sql = spark.sql("SELECT * FROM segments(TABLE({t}) PARTITION BY session ORDER BY (us, seq), 1, 9)", t=df)
    assert sorted(map(tuple, sql.collect()), key=str) == sorted(want, key=str)
    grams = {(r.session, r.pos): r.gram for r in M.kgrams(df, ["us", "seq"], 3).collect()}
    assert grams == {(1, 0): [9, 1, 1], (1, 1): [1, 1, 5], (1, 2): [1, 5, 9], (1, 3): [5, 9, 1]}
    assert M.kgrams(df.limit(0), ["us", "seq"], 3).count() == 0
    with pytest.raises(Exception, match="at least 1"):
        M.kgrams(df, ["us", "seq"], 0).collect()


def test_many_sessions_are_read_several_at_a_time(spark, tmp_path):
    folder = f"file://{tmp_path}/many"
    lines = spark.range(1200).select((F.col("id") % 600).alias("session"), "id", F.concat(F.col("id").cast("string"), F.lit(".5,[1],LogTypes::Guid,x")).alias("value"))
    V.write_log(lines, folder, "session", ["id"], "value")
    V.register(spark)
    log = spark.read.format("trial_log").load(folder)
    parts = V.LogReader({"path": folder}).partitions()
    assert len(parts) <= V.PARTITIONS and sum(1 + len(p.more) for p in parts) == 600
    got = sorted((int(r.session), r.line_no, r.ts) for r in log.collect())
    assert got == [(s, n, s + 600 * (n - 1) + 0.5) for s in range(600) for n in (1, 2)]
    odd = spark.createDataFrame([(None, 1), ("", 1), ("..", 1), ("a=b c", 2)], "session string, n int").withColumn("value", F.lit("1.0,[1],LogTypes::Guid,x"))
    V.write_log(odd, f"file://{tmp_path}/odd", "session", ["n"], "value")
    names = sorted(r.session for r in spark.read.format("trial_log").load(f"file://{tmp_path}/odd").collect())
    assert names == ["..", "__HIVE_DEFAULT_PARTITION__", "__HIVE_DEFAULT_PARTITION__", "a=b c"]
