"""Recursive filters: their design, and chunks of a recording against one pass over all of it."""

import cmath
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import filters as B


def one_pass(x, sections):
    y = np.array(x, float)
    for b0, b1, b2, a1, a2 in sections:
        z1 = z2 = 0.0
        out = []
        for v in y:
            w = b0 * v + z1
            z1, z2 = b1 * v - a1 * w + z2, b2 * v - a2 * w
            out.append(w)
        y = np.array(out)
    return y


def gain(sections, f, fs):
    z = cmath.exp(-2j * cmath.pi * f / fs)
    return abs(np.prod([(b0 + b1 * z + b2 * z * z) / (1 + a1 * z + a2 * z * z) for b0, b1, b2, a1, a2 in sections]))


@pytest.mark.parametrize(("order", "fs", "low", "high", "stop"), [(4, 1000, 2, 300, False), (4, 30_000, 600, 9_000, False), (4, 1000, None, 200, False), (1, 60, None, 3, False), (3, 100, 10, None, False), (4, 1000, 49.8, 50.2, True), (5, 64, 4, 16, False)])
def test_butterworth_gains(order, fs, low, high, stop):
    s = B.butterworth(order, fs, low, high, stop)
    edges = [c for c in (low, high) if c]
    assert all(gain(s, c, fs) == pytest.approx(0.5**0.5, abs=1e-6) for c in edges)
    band = bool(low and high)
    passes = {0.0: not low or stop, fs / 2 - 1e-9: not high or stop}
    assert all(gain(s, f, fs) == pytest.approx(float(p), abs=1e-3) for f, p in passes.items())
    if band:
        warped = cmath.sqrt(np.tan(np.pi * low / fs) * np.tan(np.pi * high / fs)).real
        assert gain(s, np.arctan(warped) * fs / np.pi, fs) == pytest.approx(0.0 if stop else 1.0, abs=1e-6)
    # monotonic on either side of the pass band, twice as steep as the order says it must be at least an octave away
    assert all(max(abs(r) for r in np.roots([1, a1, a2])) < 1 for *_, a1, a2 in s)


def test_first_order_by_hand():
    k = np.tan(np.pi * 3 / 60)
    assert B.butterworth(1, 60, high=3) == [pytest.approx((k / (1 + k), k / (1 + k), 0.0, (k - 1) / (k + 1), 0.0))]
    for bad in ({}, {"low": 0.0}, {"high": 30.0}, {"low": 5.0, "stop": True}):
        with pytest.raises(ValueError):
            B.butterworth(2, 60, **bad)


@pytest.mark.parametrize("chunk", [1, 7, 100, 1 << 16])
def test_chunks_equal_one_pass(spark, chunk):
    """Recordings that start below zero, of one sample, with gaps longer than chunks and missing values."""
    rng = random.Random(2)
    whole = {"a": {k: rng.gauss(0, 1) for k in range(-30, 400)}, "b": {5: 2.0}, "c": {k: rng.gauss(0, 1) for k in [*range(20), *range(300, 330)]}}
    whole["a"][50] = None
    rows = [(r, s, v) for r, own in whole.items() for s, v in own.items()]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "rec string, sample int, value double")
    sections = B.butterworth(4, 1000, 2, 300)
    for backward in (False, True):
        got = {(r.rec, r.sample): r.filtered for r in B.recursive(df, ["rec"], sections, backward=backward, chunk=chunk).collect()}
        assert len(got) == len(rows)
        for rec, own in whole.items():
            at = list(range(min(own), max(own) + 1))
            x = np.array([own.get(s) or 0.0 for s in at])
            y = one_pass(x[::-1], sections)[::-1] if backward else one_pass(x, sections)
            assert all(abs(got[rec, s] - v) < 1e-9 for s, v in zip(at, y) if s in own)
    assert B.recursive(df.limit(0), ["rec"], sections, chunk=chunk).count() == 0


def test_two_passes_do_not_delay(spark):
    """A tone in the band keeps its phase; one outside goes; the notch takes its own."""
    n, fs = 2000, 1000
    t = np.arange(n) / fs
    tone = {f: np.sin(2 * np.pi * f * t) for f in (20, 50, 450)}
    df = spark.createDataFrame([(f"{f}", k, float(v)) for f, x in tone.items() for k, v in enumerate(x)], "tone string, sample int, value double")
    got = B.field_potential(df, ["tone"], fs, 2, 300, (48.0, 52.0), every=2, chunk=300).orderBy("sample").collect()
    of = {f: np.array([r.filtered for r in got if r.tone == f"{f}"]) for f in tone}
    assert all(len(x) == n / 2 for x in of.values())
    mid = slice(300, 700)
    assert np.abs(of[20][mid] - tone[20][::2][mid]).max() < 0.03 and np.abs(of[450][mid]).max() < 0.05 and np.abs(of[50][mid]).max() < 0.1
    quiet = B.unit_activity(df.where(F.col("tone") == "450"), ["tone"], fs, 300, 490, 20, every=4, chunk=512).orderBy("sample").collect()
    assert np.abs(np.array([r.filtered for r in quiet])[150:350] - 2 / np.pi).max() < 0.1


def test_work_follows_the_samples(spark, monkeypatch):
    """A short recording costs as many blocks as it has samples, wherever it lies in its chunk; null names are kept."""
    system, seen = B.Recursion(B.butterworth(1, 60, high=3)), []
    df = spark.createDataFrame([(r, s, 1.0) for r in ("a", None) for s in (5, 6, 40_000, 70_000)], "rec string, sample long, value double")
    packed = B._pack(df.where("sample < 100"), ["rec"], "value", "sample", 1 << 16).toArrow().to_batches()
    for batch in packed:
        seen += [len(x) for _, _, x, _ in B._stretches(batch, 1, False, 1 << 16)]
    assert seen == [2, 2]
    got = {(r.rec, r.sample): r.filtered for r in B.recursive(df, ["rec"], B.butterworth(1, 60, high=3)).collect()}
    x = np.zeros(70_001)
    x[[5, 6, 40_000, 70_000]] = 1
    y = one_pass(x, B.butterworth(1, 60, high=3))
    assert len(got) == 8 and all(abs(v - y[s]) < 1e-12 for (_, s), v in got.items())
    assert np.allclose(system.end(x[:7]), system.end(np.r_[np.zeros(100), x[:7]]))
