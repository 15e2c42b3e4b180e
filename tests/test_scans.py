"""Values carried along groups that are cut into parts, against plain loops."""

import random

import pytest
from pyspark.sql import functions as F

from tidemark.operators import aggregates as A
from tidemark.operators import joins as J
from tidemark.operators import scans as S
from tidemark.operators import trials as R
from tidemark.operators import windows as W


def events(spark, n=900):
    """A session with two thirds of the rows, a null session, small ones; times with ties and nulls, values with nulls."""
    rng = random.Random(3)
    rows = []
    for k in range(n):
        session = rng.choice([1, 1, 1, 1, None, 2, 3])
        rows.append((session, None if k % 90 == 7 else rng.randrange(n // 3), k, rng.choice([None, 1, 2, 5]), rng.choice("ab")))
    return rows, spark.createDataFrame(rows, "session int, t int, seq long, v int, state string")


def loops(rows):
    out = set()
    for session in {r[0] for r in rows}:
        own = sorted((r for r in rows if r[0] == session), key=lambda r: (r[1] is not None, r[1] or 0, r[2]))
        known = [r[3] for r in own]
        for i, r in enumerate(own):
            before = sum(x or 0 for x in known[:i])
            last = next((x for x in reversed(known[: i + 1]) if x is not None), None)
            following = next((x for x in known[i:] if x is not None), None)
            out.add((*r, before, before + (r[3] or 0), last, following, known[i - 1] if i else None, known[i + 1] if i + 1 < len(own) else None))
    return out


@pytest.mark.parametrize("hot_rows", [5, 100, S.HOT_ROWS])
def test_scan_by_loops(spark, hot_rows):
    rows, df = events(spark)
    v = F.col("v")
    got = S.scan(df, ["session"], ["t", "seq"], hot_rows, **{k: (k, v) for k in S.KINDS})
    assert {tuple(r) for r in got.select(*df.columns, *S.KINDS).collect()} == loops(rows)
    assert got.count() == len(rows) and S.scan(df.limit(0), ["session"], ["t"], hot_rows, x=("last", v)).count() == 0


def test_scan_of_all_rows_as_one_group(spark):
    rows, df = events(spark)
    got = S.scan(df.drop("session"), [], ["t", "seq"], 50, **{k: (k, F.col("v")) for k in S.KINDS})
    assert {tuple(r) for r in got.select("t", "seq", "v", "state", *S.KINDS).collect()} == {r[1:] for r in loops([(1, *r[1:]) for r in rows])}


def test_a_hot_session_spreads_over_tasks(spark):
    """No part of a session of 200,000 rows holds a twentieth of them, and no part of the plan sorts it whole."""
    df = spark.range(200_000).select(F.lit(1).alias("session"), (F.col("id") * 7919 % 200_000).alias("t"), F.lit(1).alias("v"))
    cut = S.cut_hot(df, ["session"], "t", 10_000)
    sizes = [r["count"] for r in cut.groupBy("_part").count().collect()]
    assert len(sizes) == S.PARTS and max(sizes) < 10_000
    x = S.scan(df, ["session"], ["t"], 10_000, total=("upto", F.col("v")))
    assert x.where("total != t + 1").count() == 0
    assert "_part" in x._jdf.queryExecution().executedPlan().toString()


def test_operators_on_cut_sessions_equal_whole_ones(spark):
    rows, df = events(spark, 600)
    df = df.where("t IS NOT NULL").withColumn("is_exit", F.col("v").eqNullSafe(5)).withColumn("pos", F.col("t") * 1000 + F.col("seq"))
    c = F.col("v")
    cases = [
        lambda n: A.run_lengths(df, pos="pos", hot_rows=n),
        lambda n: A.block_id(df, pos="pos", hot_rows=n),
        lambda n: A.transition_matrix(df, pos="pos", hot_rows=n).drop("share"),
        lambda n: J.segment(df, ["session"], ["t", "seq"], "t", "v", c == 1, c == 2, c == 5, n),
        lambda n: R.trial_number(df, ["session"], ["t", "seq"], "v", 1, n),
        lambda n: W.carry_forward(df, ["session"], ["t", "seq"], ["v"], n),
        lambda n: W.fill_linear(df.where("session IS NOT NULL").groupBy("session", "t").agg(F.max("v").cast("double").alias("v")), ["session"], "t", "v", n),
        lambda n: W.burst_sessions(df, ["session"], "t", ["t", "seq"], 2, 2, n),
        lambda n: W.threshold_events(df.where("session IS NOT NULL").withColumn("value", F.col("v").cast("double")), ["session"], "pos", 0.1, 3, hot_rows=n),
    ]
    for case in cases:
        few, many = case(20), case(S.HOT_ROWS)
        assert few.columns == many.columns
        assert sorted(map(str, few.collect())) == sorted(map(str, many.collect()))
        assert many.count() > 3


def test_only_the_largest_groups_are_cut(spark, monkeypatch):
    monkeypatch.setattr(S, "MOST_CUT", 1)
    rows, df = events(spark)
    cut = S.cut_hot(df, ["session"], "t", 5).where("_part >= 0").select("session").distinct().collect()
    assert [r[0] for r in cut] == [1]
    got = S.scan(df, ["session"], ["t", "seq"], 5, **{k: (k, F.col("v")) for k in S.KINDS})
    assert {tuple(r) for r in got.select(*df.columns, *S.KINDS).collect()} == loops(rows)


def test_framed_windows_on_cut_sessions_equal_whole_ones(spark):
    """Frames that cross the ends of chunks, and groups that end within one."""
    rng = random.Random(9)
    df = spark.createDataFrame([(s, k, rng.gauss(0, 1), rng.gauss(0, 1)) for s, n in (("a", 230), ("b", 7), ("c", 1), (None, 60)) for k in range(n)], "session string, t int, v double, w double")
    on, order = ["session"], ["t"]
    cases = [
        lambda n: W.moving_average(df, 5, on, order, F.col("v"), n), lambda n: W.rolling_variance(df, 6, on, order, "v", hot_rows=n), lambda n: W.sliding_fit(df, 9, on, order, "v", hot_rows=n),
        lambda n: W.gradient(df, on, order, "v", hot_rows=n), lambda n: W.smooth(df, on, order, "v", [0.1, 0.2, 0.4, 0.2, 0.1], n), lambda n: W.path_kinematics(df, on, order, "v", "w", hot_rows=n),
    ]
    for case in cases:
        whole = {(r["session"], r["t"]): r for r in case(S.HOT_ROWS).collect()}
        for n in (9, 10, 64):
            got = case(n).collect()
            assert len(got) == len(whole) > 200
            for r in got:
                assert all(x == y or abs(x - y) < 1e-9 for x, y in zip(r, whole[r["session"], r["t"]])), (n, r)
    with pytest.raises(ValueError):
        W.sliding_fit(df, 9, on, order, "v", hot_rows=5)
