"""Exact quantiles and rank tests over parts of groups, and permutations of several numbers in one session."""

import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import aggregates as A
from tidemark.operators import predicates as P
from tidemark.operators import quantiles as Q
from tidemark.operators import scans
from tidemark.operators import statistics as I


@pytest.mark.parametrize("hot_rows", [3, 40, scans.HOT_ROWS])
def test_exact_quantiles_by_numpy(spark, hot_rows):
    """Ties, negative values, a group of one value, of nulls only, of null key, and one that holds most rows."""
    rng = random.Random(6)
    rows = [("big", rng.choice([rng.uniform(-5, 5), 1.5, -0.0])) for _ in range(400)] + [("one", 7.0)] + [("none", None)] * 3 + [(None, float(k)) for k in range(10)] + [("two", 1.0), ("two", 2.0), ("two", None)]
    df = spark.createDataFrame(rows, "g string, v double")
    shares = {"q0": 0.0, "q1": 0.1, "q2": 0.333, "q3": 0.5, "q4": 1.0}
    got = {r.g: [r[n] for n in shares] for r in Q.exact_quantiles(df, ["g"], "v", shares, hot_rows).collect()}
    for g in ("big", "one", "none", None, "two"):
        own = [v for k, v in rows if k == g and v is not None]
        want = np.quantile(own, list(shares.values())).tolist() if own else [None] * 5
        assert got[g] == (pytest.approx(want, abs=1e-12) if own else want)
    assert len(got) == 5
    whole = Q.exact_quantiles(df, [], "v", {"m": 0.5}, hot_rows).first().m
    assert whole == pytest.approx(np.median([v for _, v in rows if v is not None]), abs=1e-12)


def test_users_of_quantiles_on_cut_groups(spark):
    rng = random.Random(7)
    df = spark.createDataFrame([(rng.choice("aab"), rng.choice("xy"), rng.uniform(0, 9), rng.uniform(0, 9), rng.random()) for _ in range(500)], "g string, part string, v double, w double, l double")
    for case in (
        lambda n: A.length_profile(df, "v", "g", 1.0, n), lambda n: A.quantile_summary(df, "v", ["g"], {"a": 0.25, "b": 0.9}, n),
        lambda n: I.quantile_pairs(df, "g", "v", 5, n), lambda n: P.likelihood_box(df, "v", "w", "l", ["g"], 0.3, hot_rows=n), lambda n: I.mann_whitney(df, "g", "v", hot_rows=n),
    ):
        few, many = case(20), case(scans.HOT_ROWS)
        key = lambda r: [str(x) if not isinstance(x, float) else f"{x:.9f}" for x in r]
        assert sorted(map(key, few.collect())) == sorted(map(key, many.collect())) and many.count() > 0


def test_exact_rank_test_by_all_orders(spark):
    law = {(a, b, u): p for a, b, u, p in I.rank_sum_tails(6)}
    for a, b in ((3, 4), (5, 5), (1, 2), (5, 1)):
        us = [sum(c) - a * (a + 1) // 2 for c in itertools.combinations(range(1, a + b + 1), a)]
        for u in range(a * b + 1):
            want = min(1.0, 2 * min(sum(x <= u for x in us), sum(x >= u for x in us)) / len(us))
            assert law[a, b, u] == pytest.approx(want, abs=1e-12)
    df = spark.createDataFrame([("a", 1.0), ("a", 2.0), ("a", 3.0), ("a", 4.5), ("b", 4.0), ("b", 5.0), ("b", 6.0), ("b", 7.0), ("c", 1.0), ("c", 2.0), ("c", 8.0), ("c", 9.0)], "g string, v double")
    plain = {(r.g1, r.g2): r for r in I.mann_whitney(df, "g", "v").collect()}
    exact = {(r.g1, r.g2): r for r in I.mann_whitney(df, "g", "v", exact_below=6).collect()}
    assert exact["a", "b"].p == pytest.approx(min(1.0, 3 * law_of(4, 4, exact["a", "b"].u)), abs=1e-12) != plain["a", "b"].p
    assert exact["a", "c"].p == plain["a", "c"].p  # tied


def law_of(a, b, u):
    return {(x, y, z): p for x, y, z, p in I.rank_sum_tails(max(a, b) + 1)}[a, b, int(u)]


def test_permutations_of_another_number_in_one_session(spark):
    """What a worker keeps of a unit's hashes is of one number of permutations."""
    units = spark.range(20).select(F.col("id").cast("string").alias("u"), F.explode(F.array(F.lit(0), F.lit(1))).alias("x"), (F.col("id") % 7).cast("double").alias("v"))
    runs = [I.permutation_test(units, F.col("u").cast("int") < 10, "u", "x", "v", n).orderBy("x").collect() for n in (50, 100, 50)]
    assert runs[0] == runs[2] and len(runs[1]) == 2
    assert [len(I._unit_hashes("a", n)) for n in (50, 100)] == [50, 100]
