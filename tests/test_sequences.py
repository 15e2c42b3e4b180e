"""Alignment of code sequences: the search, short and late recordings, session markers, and what can't be aligned."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import sequences as Q


def test_places_by_loops():
    rng = random.Random(8)
    for _ in range(300):
        codes = np.array([rng.choice([-5, 0, 1, 2, 1 << 40]) for _ in range(rng.randrange(40))], np.int64)
        key = codes[(a := rng.randrange(40)) : a + rng.randrange(1, 6)] if rng.random() < 0.7 else np.array([7], np.int64)
        want = [i for i in range(len(codes) - len(key) + 1) if len(key) and (codes[i : i + len(key)] == key).all()]
        assert Q.places_of(codes, key).tolist() == want


def sequence(spark, rows, names="session string, pos long, time double, code long"):
    return spark.createDataFrame(rows, names)


def recording(session, codes):
    return [(session, k, 10.0 * k, c) for k, c in enumerate(codes)]


def log_of(session, codes):
    return [(session, k, c, 1.0 * k, 1.0 * k + 0.5) for k, c in enumerate(codes)]


LOG = "session string, pos long, code long, log_time double, screen_time double"


@pytest.mark.parametrize("chunk", [100, Q.CHUNK])
def test_recordings_that_can_and_cannot_be_aligned(spark, chunk):
    """Keys across chunks; short, late and both; a key twice; other codes; no recording; null sessions."""
    rng = random.Random(9)
    codes = [rng.randrange(1000) for _ in range(450)]
    cases = {
        "whole": ([5, 5, *codes, 7], ("aligned", 2, 450, 0, 0)),
        "short": ([1, *codes[:430]], ("aligned", 1, 430, 20, 0)),
        "late": (codes[150:], ("late", -150, 300, 150, 0)),
        "late and short": (codes[150:400], ("late", -150, 250, 200, 0)),
        "twice": ([*codes[:10], *codes], ("many", None, None, None, None)),
        "other": ([codes[0], *codes[2:]], ("none", None, None, None, None)),
        "wrong": ([*codes[:300], 1001, *codes[301:]], ("differ", 0, 450, 0, 1)),
    }
    record = [r for s, (own, _) in cases.items() for r in recording(s, own)] + [(None, 0, 1.0, 1), ("no log", 0, 1.0, 1)]
    logs = [r for s in [*cases, "silent", None] for r in log_of(s, codes)]
    rows, report = Q.align_to_log(sequence(spark, record), sequence(spark, logs, LOG), ["session"], chunk=chunk)
    got = {r.session: (r.status, r.offset, r.paired, r.missing, r.differing) for r in report.collect()}
    none = ("none", None, None, None, None)
    assert got == {s: want for s, (_, want) in cases.items()} | {"silent": none, None: none}
    aligned = rows.collect()
    assert {r.session for r in aligned} == {"whole", "short", "late", "late and short"}
    for r in aligned:
        own, (_, offset, *_) = cases[r.session]
        at = r.pos + offset
        assert r.code == codes[r.pos] and r.time == (10.0 * at if 0 <= at < len(own) else None)
    with pytest.raises(ValueError):
        Q.occurrences(sequence(spark, record), sequence(spark, record), ["session"], 100, chunk=50)


def test_session_markers(spark):
    """Every way in which markers may lie, as a table of the span that is kept and of how it was found."""
    codes = [992, *range(20, 60), 993]
    inner = codes[:-1]
    cases = {
        "both": (codes, codes, inner, "markers"),
        "no end": (codes[:-3], codes, codes[:-4], "markers"),
        "no start": (codes[3:], codes, codes[3:-1], "markers"),
        "end before": ([993, *codes], codes, inner, "markers"),
        "end before, no end": ([993, *codes[:-3]], codes, codes[:-4], "markers"),
        "start after": ([*codes[3:], 992, 11], codes, codes[3:-1], "markers"),
        "neither": (codes[2:-2], codes, inner, "log"),
        "two ends before": ([993, 993, *codes], codes, inner, "log"),
        "other length": ([992, *range(20, 30), *range(31, 60), 993], codes, None, "differ"),
        "other code": ([992, *range(20, 30), 5, *range(31, 60), 993], codes, None, "differ"),
        "nothing alike": ([1, 2, 3], codes, None, "none"),
        "log without markers": (list(range(20, 60)), list(range(20, 60)), None, "unmarked"),
    }
    record = sequence(spark, [r for s, (own, *_) in cases.items() for r in recording(s, own)])
    log = sequence(spark, [r for s, (_, own, *_) in cases.items() for r in log_of(s, own)], LOG)
    rows, report = Q.align_to_screen(record, log, ["session"], 10.0)
    assert {r.session: r.status for r in report.collect()} == {s: how for s, (*_, how) in cases.items()}
    got = rows.orderBy("session", "screen_time").collect()
    for s, (own, logged, kept, how) in cases.items():
        assert [r.code for r in got if r.session == s] == (kept or [])
    for r in got:
        own, logged, *_ = cases[r.session]
        at = logged.index(r.code)
        assert r.screen_time == at + 0.5
        if r.code not in own:
            assert r.sample is None and r.screen_sample is None
        else:
            assert r.sample == 10.0 * own.index(r.code) and r.screen_sample == r.sample + 5.0
    assert Q.align_to_screen(record.limit(0), log.limit(0), ["session"], 10.0)[1].count() == 0


def test_positions_of_a_hot_session(spark):
    df = spark.range(1000).select(F.when(F.col("id") < 900, "a").otherwise("b").alias("session"), (F.col("id") * 37 % 1000).alias("t"))
    got = Q.with_position(df, ["session"], ["t"], hot_rows=50)
    for s in "ab":
        own = got.where(F.col("session") == s).orderBy("t").collect()
        assert [r.pos for r in own] == list(range(len(own)))
