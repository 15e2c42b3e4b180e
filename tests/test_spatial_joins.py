"""Cells near sweeps, and fields under stimuli, by shared cells: against all pairs."""

import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.functions import geometry as G
from tidemark.operators import spatial as S

SWEEPS = "direction int, bin int, az1 double, el1 double, az2 double, el2 double"


def unit(az, el):
    az, el = np.radians(az), np.radians(el)
    return np.array([np.cos(az) * np.cos(el), np.sin(az) * np.cos(el), np.sin(el)])


@pytest.mark.parametrize("half_width", [0.4, 1.7, 30.0])
def test_coverage_by_all_pairs(spark, half_width):
    """Random circles, meridians over the poles, the equator and circles across the date line."""
    rng = random.Random(3)
    sweeps = [(k, 0, rng.uniform(-180, 180), rng.uniform(-89, 89), rng.uniform(-180, 180), rng.uniform(-89, 89)) for k in range(12)]
    sweeps += [(20, 0, 0.0, 0.0, 0.0, 40.0), (21, 0, 10.0, 0.0, 50.0, 0.0), (22, 0, 170.0, 10.0, -170.0, 20.0), (23, 0, 5.0, 89.5, 100.0, 80.0)]
    cells = [(k, rng.uniform(-180, 180), float(np.degrees(np.arcsin(rng.uniform(-1, 1))))) for k in range(1500)] + [(2000, 0.0, 90.0), (2001, 33.0, -90.0)]
    got = S.coverage(spark.createDataFrame(cells, "cell int, az double, el double"), spark.createDataFrame(sweeps, SWEEPS), half_width)
    assert "NestedLoop" not in got._jdf.queryExecution().executedPlan().toString()
    have = sorted((r.cell, r.direction) for r in got.collect())
    poles = {d: np.cross(unit(a, b), unit(c, e)) for d, _, a, b, c, e in sweeps}
    off = {(c, d): np.degrees(np.arcsin(abs(unit(az, el) @ (p / np.linalg.norm(p))))) for c, az, el in cells for d, p in poles.items()}
    assert all(abs(x - half_width) > 1e-7 for x in off.values())
    assert have == sorted(k for k, x in off.items() if x < half_width)


def test_coverage_of_a_fine_grid(spark):
    """60,000 cells and 40 sweeps."""
    cells = spark.range(60_000).select(F.col("id").alias("cell"), (F.col("id") % 300 * 0.1).alias("az"), (F.floor(F.col("id") / 300) * 0.1).alias("el"))
    sweeps = spark.createDataFrame([(d, b, 3.0 * b if d % 2 else 0.0, 0.0 if d % 2 else 2.0 * b, 3.0 * b if d % 2 else 40.0, 20.0 if d % 2 else 2.0 * b) for d in range(4) for b in range(10)], SWEEPS)
    at = time.time()
    n = S.coverage(cells, sweeps, 0.5).count()
    assert n > 10_000 and time.time() - at < 60


def test_grid_activity_by_loops(spark):
    """A direction covers a cell by several bins, by one, or not at all; a cell that nothing covers is spontaneous."""
    rng = random.Random(4)
    rates = [(k, d, b, float(rng.randrange(9))) for k in "ab" for d in range(3 if k == "a" else 2) for b in range(4)]
    covered = [(c, d, b) for c in range(5) for d in range(3) for b in range(4) if rng.random() < 0.3 and c != 4]
    got = S.grid_activity(spark.createDataFrame(rates, "key string, direction int, bin int, rate double"), spark.createDataFrame(covered, "cell int, direction int, bin int"), spark.range(5).select(F.col("id").cast("int").alias("cell")), ["key"])
    have = {(r.key, r.cell): (r.activity, r.sd) for r in got.collect()}
    assert len(have) == 10
    for key in "ab":
        own = {(d, b): r for k, d, b, r in rates if k == key}
        directions = sorted({d for d, _ in own})
        quiet = np.mean([np.median([r for (e, _), r in own.items() if e == d]) for d in directions])
        for c in range(5):
            seen = [[own[d, b] for x, e, b in covered if x == c and e == d] for d in directions]
            values = [np.mean(v) if v else quiet for v in seen]
            assert have[key, c] == pytest.approx((np.mean(values), np.std(values)), abs=1e-9)


def test_overlap_votes_by_all_pairs(spark):
    """Polygons of any shape, collapsed and missing ones, unknown targets, fields without radius, cells of several sizes."""
    rng = random.Random(5)

    def shape():
        x, y, n = rng.uniform(-9, 9), rng.uniform(-9, 9), rng.choice([3, 4, 6])
        return [(float(x + rng.uniform(2, 12) * np.cos(2 * np.pi * k / n)), float(y + rng.uniform(6, 12) * np.sin(2 * np.pi * k / n))) for k in range(n)]

    flat = [(0.0, 0.0), (5.0, 0.0), (5.0, 3.0), (0.0, 3.0)]
    points = [(k, rng.choice(["A", "B", None]), rng.choice(["A", "B", None]), flat if k % 7 == 0 else shape(), shape()) for k in range(60)] + [(99, "A", "A", None, shape())]
    fields = [(k, k % 3, rng.uniform(-12, 12), rng.uniform(-12, 12), rng.uniform(0.5, 3) if k % 5 else None) for k in range(30)]
    xy = "array<struct<x:double,y:double>>"
    p = spark.createDataFrame(points, f"id int, target string, reached string, a {xy}, b {xy}")
    f = spark.createDataFrame(fields, "field int, area int, x double, y double, radius double")
    pairs = S.overlaps(p.where("a IS NOT NULL").crossJoin(f.where("radius IS NOT NULL")), 0.01).withColumn("role", S.overlap_role("target", "reached"))
    want = {(r.id, r.area): (r.t, r.d, r.n) for r in pairs.groupBy("id", "area").agg(F.count_if(F.col("role") == "target").alias("t"), F.count_if(F.col("role") == "distractor").alias("d"), F.count("role").alias("n")).collect()}
    assert sum(t > 0 for t, _, _ in want.values()) > 20
    for size in (3.0, 10.0, 100.0):
        got = {(r.id, r.area): (r.n_target, r.n_distractor, r.n_fields) for r in S.overlap_votes(p, f, ["id"], [0, 1, 2], size).collect()}
        assert {k: v for k, v in got.items() if k[0] != 99} == want and len([k for k in got if k[0] == 99]) == 3


def test_shared_areas_equal_the_expressions(spark):
    rng = np.random.default_rng(8)
    rows = []
    for k in range(200):
        n = int(rng.integers(3, 7))
        at = np.sort(rng.random(n)) * 6.28
        corners = [(float(a), float(b)) for a, b in zip(3 * np.cos(at), 2 * np.sin(at))]
        rows.append((k, corners + corners[-1:] * (k % 2), float(rng.normal()), float(rng.normal()), float(rng.random() * 3 * (k % 9 > 0))))
    df = spark.createDataFrame(rows, "id int, p array<struct<x:double,y:double>>, x double, y double, r double")
    want = df.select(G.polygon_area(F.col("p")), G.circle_polygon_area(F.col("x"), F.col("y"), F.col("r"), F.col("p"))).orderBy("id").collect()
    flat = np.array([c for row in rows for c in row[1]])
    x, y, r = (np.array([row[k] for row in rows]) for k in (2, 3, 4))
    area, shared = S.shared_areas(np.array([len(row[1]) for row in rows]), flat[:, 0], flat[:, 1], x, y, r)
    assert np.allclose(area, [w[0] for w in want], atol=1e-12) and np.allclose(shared, [w[1] for w in want], atol=1e-12)
    points = df.where("id < 20").selectExpr("id", "'A' AS target", "'A' AS reached", "p AS a", "p AS b").withColumn("a", F.transform("a", lambda c: F.struct(c["x"].alias("x"), (c["y"] * 9).alias("y")))).withColumn("b", F.col("a"))
    fields = df.selectExpr("0 AS area", "x", "y", "r AS radius").limit(5)
    plan = S.overlap_votes(points, fields, ["id"], [0], 5.0)._jdf.queryExecution().executedPlan().toString()
    assert "atan2" not in plan.lower()  # no areas by lambdas
