"""Edges, ties, missing values and invariants on small frames."""

import datetime as dt
import math
import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.functions import geometry as G
from tidemark.functions import scalars as X
from tidemark.operators import aggregates as A
from tidemark.operators import joins as J
from tidemark.operators import predicates as P
from tidemark.operators import spatial as O
from tidemark.operators import spectral as S
from tidemark.operators import statistics as I
from tidemark.operators import windows as W
from tidemark.sources import eventlog as E
from tidemark.sources import signals
from tidemark.sources import tables as T
from tidemark.staging import numbered


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def rows(df, *order):
    return [tuple(r) for r in (df.orderBy(*order) if order else df).collect()]


def test_run_lengths_sum_to_rows_and_nulls_are_equal(spark):
    df = frame(spark, [(1, k, s) for k, s in enumerate(["a", "a", None, None, "b", "a"])], "session long, pos long, state string")
    got = rows(A.run_lengths(df).select("start", "state", "length"), "start")
    assert got == [(0, "a", 2), (2, None, 2), (4, "b", 1), (5, "a", 1)]


def test_transition_rows_sum_to_one(spark):
    df = frame(spark, [(s, k, "abc"[(s * k) % 3]) for s in range(4) for k in range(9)], "session long, pos long, state string")
    for pooled in (False, True):
        sums = A.transition_matrix(df, pooled=pooled).groupBy("a").agg(F.sum("share").alias("s"))
        assert all(abs(r["s"] - 1) < 1e-12 for r in sums.collect())


def test_histogram_edges(spark):
    df = frame(spark, [(x,) for x in (0.0, 5.0, 10.0, 10.1, -0.1)], "v double")
    assert rows(A.histogram(df, "v", 0.0, 10.0, 2).select("bin", "n"), "bin") == [(0, 1), (1, 2)]


def test_bands_share_an_edge(spark):
    df = frame(spark, [("x", 8.0, True)], "k string, freq double, sig boolean")
    assert rows(A.band_significance(df, {"a": (4, 8), "b": (8, 12)}, ["k"]), "band") == [("x", "a", 100.0), ("x", "b", 100.0)]


def test_probability_one_is_in_no_bin(spark):
    df = frame(spark, [(1, 1.0)] * 6 + [(1, 0.2)] * 5, "state int, p double")
    assert rows(A.probability_bins(df, "p", 0.1, "state").select("bin", "n")) == [(2, 5)]


def test_majority_ties_go_to_the_first_listed(spark):
    df = frame(spark, [(1, "b"), (1, "a")], "g int, c string")
    assert rows(A.majority_vote(df, ["g"], "c", ["b", "a"]).select("winner")) == [("b",)]


def test_asof_takes_equal_times_and_nearest_prefers_the_earlier(spark):
    left = frame(spark, [(1, 10), (1, 5), (1, 0)], "k int, t long")
    right = frame(spark, [(1, 0, "a"), (1, 10, "b")], "k int, u long, v string")
    assert rows(J.asof_backward(left, right, ["k"], "t", "u", ["v"]).select("t", "v_found"), "t") == [(0, "a"), (5, "a"), (10, "b")]
    assert rows(J.asof_forward(left, right, ["k"], "t", "u", ["v"]).select("t", "v_found"), "t") == [(0, "a"), (5, "b"), (10, "b")]
    assert rows(J.nearest(left, right, ["k"], "t", "u", "v", 4).select("t", "nearest"), "t") == [(0, "a"), (5, None), (10, "b")]
    assert rows(J.nearest(left, right, ["k"], "t", "u", "v").select("t", "nearest"), "t")[1] == (5, "a")


def test_sequences_that_do_not_occur_give_no_offset(spark):
    a = frame(spark, [(k, k % 7) for k in range(30)], "p long, code int")
    b = frame(spark, [(k, 9) for k in range(10)], "p long, code int")
    assert J.align_sequences(a, b, "p", "code", 5).count() == 0


def test_select_trials(spark):
    df = frame(spark, [(1, True, "x"), (2, False, "x"), (3, None, "y")], "id int, ok boolean, kind string")
    assert rows(P.select_trials(df, ["~ok", "kind=x"]).select("id")) == [(2,)]
    assert P.select_trials(df, []).count() == 3


def test_missing_trials_go_before_missing_channels(spark):
    df = frame(spark, [(1, 1, None), (1, 2, None), (2, 1, None), (2, 2, 1.0)], "trial int, channel int, value double")
    assert rows(P.drop_all_missing(df).select("trial", "channel", "value")) == [(2, 2, 1.0)]


def test_outcome_precedence(spark):
    df = frame(spark, [(True, True, False, True), (False, False, False, True), (False, False, True, False)], "c boolean, w boolean, m boolean, x boolean")
    got = [r[0] for r in df.select(P.trial_outcome(*map(F.col, "cwmx"))).collect()]
    assert got == ["correct_end", "other", "miss"]


def test_hann_power_peaks_at_the_tone_and_coherence_of_itself_is_one(spark):
    tone = [(1, c, k, math.sin(2 * math.pi * 8 * k / 64) + 0.1 * c * ((k * 7) % 5)) for c in (0, 1) for k in range(64)]
    df = frame(spark, tone, "trial int, channel int, sample long, value double")
    p = S.power_hann(df.where("channel = 0"), ["trial", "channel"], 64, 64.0, 1, 32).orderBy(F.col("power").desc()).first()
    assert p["freq"] == 8.0
    same = df.where("channel = 0").unionByName(df.where("channel = 0").withColumn("channel", F.lit(1)))
    c = [r["coherence"] for r in S.coherence(same, ["trial"], "channel", 16, 64.0, 4, 24).collect()]
    assert c and all(abs(x - 1) < 1e-9 for x in c)


def test_tapers_are_orthonormal():
    t = S.slepian_tapers(64, 3.0, 5)
    assert np.allclose(t @ t.T, np.eye(5), atol=1e-9)


def test_circle_polygon_area_against_counting(spark):
    rng = np.random.default_rng(3)
    cases = []
    for _ in range(30):
        angles = np.sort(rng.uniform(0, 2 * np.pi, rng.integers(3, 7)))
        pts = [(float(np.cos(a) * 3), float(np.sin(a) * 2)) for a in angles]
        cases.append((float(rng.normal()), float(rng.normal()), float(rng.uniform(0.5, 3)), pts))
    df = frame(spark, cases, "x double, y double, r double, p array<struct<x:double,y:double>>")
    got = df.select("x", "y", "r", "p", G.circle_polygon_area(F.col("x"), F.col("y"), F.col("r"), F.col("p")).alias("a"), G.polygon_area(F.col("p")).alias("whole")).collect()
    for r in got:
        edges = [(r["p"][k - 1], r["p"][k]) for k in range(len(r["p"]))]
        n = 400
        g = (np.arange(n) + 0.5) / n * 2 - 1
        gx, gy = np.meshgrid(g * r["r"] + r["x"], g * r["r"] + r["y"])
        inside = (gx - r["x"]) ** 2 + (gy - r["y"]) ** 2 <= r["r"] ** 2
        odd = np.zeros(gx.shape, bool)
        for a, b in edges:
            odd ^= ((a.y > gy) != (b.y > gy)) & (gx < (b.x - a.x) * (gy - a.y) / (b.y - a.y) + a.x)
        inside &= odd
        assert r["a"] == pytest.approx(inside.mean() * (2 * r["r"]) ** 2, abs=0.03 * r["r"] ** 2)
        assert r["a"] <= min(r["whole"], math.pi * r["r"] ** 2) + 1e-6


def test_mann_whitney_ties_and_symmetry(spark):
    df = frame(spark, [("a", float(x)) for x in (1, 2, 2, 3, 9)] + [("b", float(x)) for x in (2, 2, 5, 7)], "g string, v double")
    r = I.mann_whitney(df, "g", "v").first()
    u = sum((x > y) + 0.5 * (x == y) for x in (1, 2, 2, 3, 9) for y in (2, 2, 5, 7))
    assert r["u"] == u and 0 <= r["p"] <= 1


def test_upper_tail(spark):
    z = [0.0, 1.0, 1.959964, -1.959964]
    got = [r[0] for r in frame(spark, [(x,) for x in z], "z double").select(X.upper_tail(F.col("z"))).collect()]
    assert got == pytest.approx([0.5, 0.158655, 0.025, 0.975], abs=1e-6)


def test_array_split_and_linspace(spark):
    df = spark.range(1)
    assert df.select(X.array_split(F.sequence(F.lit(1), F.lit(7)), 3)).first()[0] == [[1, 2, 3], [4, 5], [6, 7]]
    assert df.select(X.linspace(F.lit(0.0), F.lit(1.0), 3)).first()[0] == [0.0, 0.5, 1.0]


def test_log_lines_that_are_not_timed_are_left_out(spark):
    df = frame(spark, [("1.5,[7],LogTypes::Eventmarker,996,15",), ("oops,[7],LogTypes::X,1",), ("",), (None,)], "value string")
    assert rows(E.parse_lines(df)) == [(1.5, 7, "Eventmarker", ["996", "15"])]
    v = frame(spark, [("X=1.5 Y=bad Z=-2",)], "t string").select(E.vector(F.col("t")).alias("v")).first()["v"]
    assert (v["x"], v["y"], v["z"]) == (1.5, None, -2.0)


def test_log_files_keep_their_order(spark, tmp_path):
    (tmp_path / "a.log").write_text("head\n" + "".join(f"{k}.0,[1],LogTypes::Tick,{k}\n" for k in range(50)))
    got = rows(E.read_event_log(spark, str(tmp_path / "a.log")).select("line_no", "ts"), "line_no")
    assert got == [(k + 2, float(k)) for k in range(50)]


def test_signal_files_round_trip(spark, tmp_path):
    sig = frame(spark, [(s, t, c, k, float(s * t + c * k)) for s in (1, 2) for t in (1, 2) for c in (0, 1) for k in range(20)], "session int, trial int, channel int, sample long, value double")
    trials = frame(spark, [(1, 0.0)], "trial int, starting_time double")
    signals.write_signal(sig, trials, str(tmp_path / "s"))
    back, _ = signals.read_signal(spark, str(tmp_path / "s"))
    assert sorted(rows(back.select(sig.columns))) == sorted(rows(sig))
    signals.write_signal(sig, trials.drop("starting_time"), str(tmp_path / "t"))
    with pytest.raises(ValueError):
        signals.read_signal(spark, str(tmp_path / "t"))


def test_results_are_never_overwritten(spark, tmp_path):
    path = str(tmp_path / "r")
    T.write_results(frame(spark, [("a", 1, 1.0), ("b", 1, 2.0)], "k string, x int, v double"), path, ["k", "x"])
    T.write_results(frame(spark, [("a", 1, 9.0), ("c", None, 3.0)], "k string, x int, v double"), path, ["k", "x"])
    T.write_results(frame(spark, [("c", None, 8.0)], "k string, x int, v double"), path, ["k", "x"])
    assert sorted(rows(spark.read.parquet(path).select("k", "v"))) == [("a", 1.0), ("b", 2.0), ("c", 3.0)]


def test_headers_of_two_rows():
    assert T.joined_header(["scorer", "nose", ""], ["i", "x", "y"]) == ["scorer_i", "nose_x", "nose_y"]


SECOND = 1_000_000


def stream_of(spark, folder, parts):
    """A stream of files of (session, us, seq, code) rows, in the order given, with us as a time, in its own session."""
    from tidemark.streaming import jobs

    schema = "session long, us long, seq long, code int, ts timestamp"
    for k, own in enumerate(parts):
        rows_ = frame(spark, own, "session long, us long, seq long, code int").withColumn("ts", F.timestamp_micros("us"))
        rows_.coalesce(1).write.parquet(str(folder / "in" / f"p{k}"))
        time.sleep(1.1)  # files are read in the order of their times
    return jobs.events_stream(jobs.session_for(spark, 2), str(folder / "in" / "*"), spark.createDataFrame([], schema).schema)


def trials_of(spark, folder, stream, lateness, longest):
    from tidemark.streaming import jobs

    trials = jobs.segment(stream, "session", "ts", "us", "seq", "code", 1, 9, lateness, longest)
    seen = jobs.drain(trials, str(folder / "out"), str(folder / "check"))
    return seen, spark.read.schema("session long, start long, stop long, complete boolean").parquet(str(folder / "out"))


def kept_state(spark, folder):
    from tidemark.streaming import jobs

    own = jobs.session_for(spark, 2)
    return {n: own.read.format("statestore").option("stateVarName", n).load(str(folder / "check")).count() for n in ("marks", "open", "wake")}


def end_recording(spark, folder, stream, seen, by):
    from tidemark.streaming import jobs

    jobs.end_marker(spark, str(folder / "in" / "end"), stream.schema, "ts", seen, by)


def test_stream_equals_batch_over_several_files(spark, tmp_path):
    """Files in any order, times tied: the sink alone has the batch's trials once the recording has ended, and no state
    is left."""
    rng = random.Random(1)
    events = [(s, rng.randrange(200) * SECOND, k, rng.choice([1, 9, 5])) for s in range(4) for k in range(40)]
    mixed = rng.sample(events, len(events))
    stream = stream_of(spark, tmp_path, [mixed[k::3] for k in range(3)])
    longest = dt.timedelta(seconds=20)
    seen, _ = trials_of(spark, tmp_path, stream, "10 minutes", longest)
    end_recording(spark, tmp_path, stream, seen, dt.timedelta(minutes=20))
    _, got = trials_of(spark, tmp_path, stream, "10 minutes", longest)
    want = []
    for s in range(4):
        marks = sorted((t, k, c) for x, t, k, c in events if x == s and c != 5)
        for (t, _, c), after in zip(marks, [*marks[1:], (None, None, None)]):
            if c == 1:
                full = after[2] == 9 and after[0] - t <= 20 * SECOND
                want.append((s, t, after[0] if full else None, full))
    assert sorted(rows(got), key=str) == sorted(want, key=str) and {x[3] for x in want} == {True, False}
    assert kept_state(spark, tmp_path) == {"marks": 0, "open": 0, "wake": 0}


def test_trials_leave_the_running_stream(spark, tmp_path):
    """Session 1 gets no rows after the first file: its trial leaves when a later file moves the watermark. Session 3's
    start is never stopped: a timer gives it up and frees it. A row beyond the lateness is dropped; session 2 is open."""
    parts = [[(1, 20 * SECOND, 1, 9), (1, 10 * SECOND, 0, 1), (3, 15 * SECOND, 5, 1)], [(2, 500 * SECOND, 2, 1)], [(2, 510 * SECOND, 3, 9), (2, 5 * SECOND, 4, 9), (None, 4 * SECOND, 6, 1)]]
    stream = stream_of(spark, tmp_path, parts)
    _, got = trials_of(spark, tmp_path, stream, "30 seconds", dt.timedelta(seconds=100))
    assert sorted(rows(got)) == [(1, 10 * SECOND, 20 * SECOND, True), (3, 15 * SECOND, None, False)]
    assert kept_state(spark, tmp_path) == {"marks": 2, "open": 0, "wake": 1}


def test_upsert_replays_change_nothing(spark, tmp_path, monkeypatch):
    """A batch whose write fails after its rows, before the ledger, is run again; earlier batches stay as they were; a
    closed window's state goes; what no ledger names is not read."""
    from tidemark.streaming import jobs

    hour = 3600 * SECOND
    parts = [[(1, k * hour // 4, k, 1) for k in range(8)], [(1, 2 * hour + k, 10 + k, 1) for k in range(3)], [(1, 30 * hour, 20, 1)], [(1, 31 * hour, 21, 1)]]
    stream = stream_of(spark, tmp_path, parts)
    result = jobs.rates(stream, "ts", "1 hour", "90 minutes", ["session"])
    out, check = str(tmp_path / "out"), str(tmp_path / "check")
    whole = type(spark.range(1).write).parquet
    failed = []

    def failing(self, path, *a, **b):
        if path.endswith("ledger/batch=1") and not failed:
            failed.append(path)
            raise OSError("lost")
        return whole(self, path, *a, **b)

    with monkeypatch.context() as m:
        m.setattr(type(spark.range(1).write), "parquet", failing)
        with pytest.raises(Exception):
            jobs.upsert(result, out, check)
    before = {p: p.stat().st_mtime_ns for p in (tmp_path / "out" / "rows" / "batch=0").rglob("*.parquet")}
    assert failed and before
    assert sum(r["n"] for r in jobs.latest(spark, out, ["window_start", "session"]).collect()) == 8
    jobs.upsert(result, out, check)
    got = {r["window_start"].hour + 24 * (r["window_start"].day - 1): r["n"] for r in jobs.latest(spark, out, ["window_start", "session"]).collect()}
    assert got == {0: 4, 1: 4, 2: 3, 30: 1, 31: 1}
    assert before == {p: p.stat().st_mtime_ns for p in (tmp_path / "out" / "rows" / "batch=0").rglob("*.parquet")}
    assert jobs.session_for(spark).read.format("statestore").load(check).count() == 2  # windows of hours 30 and 31


def test_feed_is_in_order_and_whole(spark, tmp_path):
    from tidemark.streaming import jobs

    df = spark.range(1000).select("id", F.timestamp_seconds(F.col("id") * 7919 % 1000).alias("ts")).unionByName(spark.sql("select 5000L as id, cast(null as timestamp) as ts"))
    folders = jobs.feed(df, "ts", str(tmp_path / "feed"), 4)
    ranges = [spark.read.parquet(p).agg(F.min("ts"), F.max("ts"), F.count("id")).first() for p in folders]
    assert len(folders) == 4 and sum(r[2] for r in ranges) == 1000 and all(a[1] < b[0] for a, b in zip(ranges, ranges[1:]))
    assert all(150 < r[2] < 350 for r in ranges)


def test_asof_of_a_hot_key_equals_the_plain_one(spark):
    rng = random.Random(2)
    left = frame(spark, [(k % 7 % 2, rng.randrange(300), k) for k in range(400)], "k int, t long, id long")
    right = frame(spark, [(k % 5 % 2, rng.randrange(300), k) for k in range(60)], "k int, u long, v long")
    for join in (J.asof_backward, J.asof_forward):
        for on in (["k"], []):
            a, b = (left, right) if on else (left.drop("k"), right.drop("k"))
            want, got = (sorted(map(str, rows(join(a, b, on, "t", "u", ["v"], hot_rows=n)))) for n in (1_000_000, 37))
            assert got == want
    assert J.asof_backward(left, right, ["k"], "t", "u", ["v"], or_first=True).where("v_found IS NULL").count() == 0


def test_windows_that_overlap_share_their_events(spark):
    trials = frame(spark, [(1, 0, 10), (1, 5, None), (1, 50, 60)], "s int, a long, b long")
    events = frame(spark, [(1, 7, 2), (1, 9, 3), (1, 12, 4)], "s int, t long, c int")
    got = rows(J.first_in_window(trials, events, ["s"], "a", "b", "t", "c", 20).select("a", "first_code", "latency", "hits"), "a")
    assert got == [(0, 2, 7, 2), (5, 2, 2, 3), (50, None, None, 0)]


def test_numbered_rows_follow_the_order(spark):
    df = frame(spark, [(k * 7919 % 1000,) for k in range(1000)], "v long").repartition(5)
    assert rows(numbered(df, ["v"]).where("pos != v")) == []


def test_sequences_cross_the_ends_of_chunks(spark):
    codes = [k * k % 11 + (k == 25) for k in range(60)]
    a = frame(spark, list(enumerate(codes)), "p long, code int")
    b = frame(spark, [(k, codes[23 + k]) for k in range(12)], "p long, code int")
    assert rows(J.align_sequences(a, b, "p", "code", 5, chunk=8)) == [(23, 1)]


def test_filters_over_chunks_equal_one_convolution(spark):
    rng = np.random.default_rng(4)
    v = rng.normal(size=100)
    taps = S.bandpass_taps(64, 4, 16, 15)
    df = frame(spark, [(1, k, float(x)) for k, x in enumerate(v)], "trial int, sample long, value double")
    for centred in (True, False):
        got = [r[2] for r in rows(S.fir(df, ["trial"], taps, centred, chunk=16), "sample")]
        assert got == pytest.approx(np.convolve(v, taps)[7:107] if centred else np.convolve(v, taps)[:100])
    tone = np.sin(2 * np.pi * 8 * np.arange(256) / 64)
    stopped = np.convolve(tone, S.notch_taps(64, 7, 9, 101), "same")[80:176]
    assert np.abs(stopped).max() < 0.2 and sum(S.notch_taps(64, 7, 9, 101)) == pytest.approx(1, abs=0.05)


def test_spectra_equal_sums_of_products(spark):
    rng = np.random.default_rng(5)
    v = rng.normal(size=64)
    df = frame(spark, [(1, k, float(x)) for k, x in enumerate(v)], "trial int, sample long, value double")
    n = np.arange(64)
    taper = S.slepian_tapers(64, 2.0, 3)
    for r in S.power_multitaper(df, ["trial"], 64, 64.0, 16, 32, 4).collect():
        z = [(((v - v.mean()) * w) * np.exp(-2j * np.pi * r["freq"] * n / 64)).sum() for w in taper]
        assert r["power"] == pytest.approx(np.mean(np.abs(z) ** 2) / 64)
    assert S.power_hann(df.where("sample < 60"), ["trial"], 64, 64.0, 2, 30).count() == 0


def test_peaks_by_brute_force(spark):
    rng = np.random.default_rng(6)
    v = rng.integers(0, 12, 150).astype(float)
    df = frame(spark, [(1, k, float(x)) for k, x in enumerate(v)], "g int, p long, v double")
    want = []
    for k in range(1, 149):
        if v[k] > v[k - 1] and v[k] > v[k + 1]:
            lows = []
            for side in (range(k - 1, -1, -1), range(k + 1, 150)):
                low = v[k]
                for j in side:
                    if v[j] > v[k]:
                        break
                    low = min(low, v[j])
                lows.append(low)
            if v[k] - max(lows) >= 3:
                want.append((1, k, v[k], v[k] - max(lows), "max"))
    assert rows(W.peaks(df, ["g"], "p", "v", 3.0), "p") == want
    both = rows(W.peaks(df, ["g"], "p", "v", 3.0, distance=6, kind="both"), "p")
    for kind in ("max", "min"):
        at = [r[1] for r in both if r[4] == kind]
        assert at and all(b - a >= 6 for a, b in zip(at, at[1:]))


def test_permutations_in_blocks_keep_the_law(spark):
    """Two groups a difference apart: found in one block and in many; equal groups aren't."""
    rng = np.random.default_rng(7)
    data = [(k, x, bool(k % 2), float(rng.normal() + (2.0 if k % 2 and x == 3 else 0))) for k in range(120) for x in range(6)]
    df = frame(spark, data, "unit long, x long, own boolean, v double").withColumn("f", F.lit("only"))
    whole = rows(I.permutation_test(df, F.col("own"), "unit", "x", "v", 300), "x")
    old, I.BLOCK = I.BLOCK, 16
    try:
        parts = rows(I.permutation_test(df, F.col("own"), "unit", "x", "v", 300, family=["f"]), "x")
    finally:
        I.BLOCK = old
    assert [r[-1] for r in whole] == [r[-1] for r in parts] == [x == 3 for x in range(6)]
    assert [r[1] for r in whole] == pytest.approx([r[2] for r in parts])
    assert whole[0][2] == pytest.approx(parts[0][3], rel=0.25)


def test_rank_z_p_against_shuffled_rows(spark):
    rng = np.random.default_rng(8)
    g = np.repeat([0, 1, 2], [40, 30, 50])
    hit = rng.random(120) < np.where(g == 1, 0.55, 0.3)
    df = frame(spark, [(int(a), bool(b)) for a, b in zip(g, hit)], "g int, hit boolean")
    z = lambda k, n1: ((k * (120 - n1 - hit.sum() + k) - (n1 - k) * (hit.sum() - k)) / 2) / math.sqrt(n1 * (120 - n1) * 121 / 12)
    shuffled = np.array([rng.permutation(hit) for _ in range(4000)])
    for r in I.rank_z_vs_rest(df, "g", F.col("hit"), 4000).collect():
        own = g == r["g"]
        far = np.abs(z(shuffled[:, own].sum(1), own.sum())) >= abs(r["z"]) - 1e-12
        assert r["k1"] == hit[own].sum() and r["p"] == pytest.approx(far.mean(), abs=0.03)


def test_headers_stop_at_blank_lines_and_split_double_fields(spark):
    lines = ["maze_3 opened at 10:30", "User: ann", "Res:X: 640,Y: 480", "odd:one:three", "User: bob", "", "Late: 1"]
    got = E.header(frame(spark, [("s", k, x) for k, x in enumerate(lines)] + [("t", 0, "lone")], "session string, n int, value string"), "session", "n")
    assert rows(got, "session") == [("s", "maze_3", "10:30", {"User": "bob", "ResX": "640", "ResY": "480"}), ("t", "lone", "lone", None)]


def test_files_with_two_header_rows(spark, tmp_path):
    (tmp_path / "a.csv").write_text("nose,,ear\nx,y,x\n1,2.5,3\n4,none,6\n")
    got = T.read_two_row_header(spark, str(tmp_path / "a.csv"))
    assert got.columns == ["nose_x", "nose_y", "ear_x"]
    assert sorted(rows(got)) == [(1.0, 2.5, 3.0), (4.0, None, 6.0)]


def test_channel_metadata_is_complete_or_an_error(spark, tmp_path):
    sig, trials = frame(spark, [(1, 1, 0, 0, 1.0)], "session int, trial int, channel int, sample long, value double"), frame(spark, [(1, 0.0)], "trial int, starting_time double")
    channels = frame(spark, [(0, "a1", 500.0)], "channel int, name string, sample_rate double")
    signals.write_signal(sig, trials, str(tmp_path / "s"), channels=channels)
    assert rows(signals.read_channels(spark, str(tmp_path / "s"))) == [(0, "a1", 500.0)]
    signals.write_signal(sig, trials, str(tmp_path / "t"), channels=channels.drop("sample_rate"))
    with pytest.raises(ValueError):
        signals.read_channels(spark, str(tmp_path / "t"))


def test_words_with_strobe_bits(spark):
    top = 32768
    words = frame(spark, [(1, 0, top + 7, False), (1, 1, 5, True), (1, 2, 9, False), (1, 3, top + 2, False), (1, 4, top + 3, True), (2, 0, 4, False), (2, 0, 4, False), (2, 1, 4, False), (3, 0, 8, True)], "g int, t long, word long, up boolean")
    got = lambda repair: sorted(rows(W.words_at_strobes(words, ["g"], "t", "word", F.col("up"), repair)))
    plain = [(2, 0, 4), (2, 1, 4), (3, 0, 8)]
    assert got(None) == [(1, 0, top + 7), (1, 3, top + 2), *plain]
    assert got("strobe") == [(1, 1, 5 - top), (1, 4, 3), *plain]
    assert got("shift") == [(1, 0, None), (1, 3, 9), *plain]
    with pytest.raises(ValueError):
        got("other")


def test_recordings_that_disagree_with_their_log(spark):
    flashes = frame(spark, [("a", t) for t in (0, 100, 101, 102, 103, 150, 300, 301, 302)], "film string, t long")
    parts = W.split_at_bursts(flashes, ["film"], "t", ["t"], 6, 3)
    assert sorted(rows(parts.select("t", "part"))) == [(100, 0), (101, 0), (102, 0), (103, 0), (150, 0), (300, 1), (301, 1), (302, 1)]
    log = lambda n: frame(spark, [("a", n)], "film string, expected long")
    assert rows(W.closest_part(parts, ["film"], log(4))) == [("a", 0, 5, 4, False)]
    assert rows(W.closest_part(parts, ["film"], log(3), strict=True)) == [("a", 1, 3, 3, True)]
    with pytest.raises(Exception, match="agree"):
        rows(W.closest_part(parts, ["film"], log(9), strict=True))


def test_gaze_straight_ahead_turns_nothing(spark):
    eye = F.struct(*[F.lit(0.0).alias(n) for n in "xyz"])
    df = frame(spark, [(0.0, 0.0, 10.0, 0.0), (20.0, 5.0, 20.0, 5.0), (None, 0.0, 1.0, 1.0)], "gx double, gy double, x double, y double")
    got = rows(df.select(F.round(G.dome_to_eye(F.col("x"), F.col("y"), F.col("gx"), F.col("gy"), eye)["eccentricity"], 6)))
    assert got == [(10.0,), (0.0,), (None,)]


def test_roles_of_overlaps(spark):
    rows = [
        ("A", None, False, True, True, "target"), ("A", "B", False, False, True, "distractor"), ("B", None, False, False, False, "neither"), ("B", "B", True, True, True, "target"),
        ("B", "A", True, True, True, "distractor"), ("A", None, True, True, True, "neither"), (None, "A", False, True, True, "neither"), ("A", "A", False, None, None, None),
    ]
    df = spark.createDataFrame(rows, "target string, reached string, collapsed boolean, inside_a boolean, inside_b boolean, want string")
    assert [r["got"] for r in df.withColumn("got", O.overlap_role("target", "reached")).collect()] == [r[-1] for r in rows]


def test_raster_rows_gaps_and_ends(spark):
    trials = [(1, 1, 0, 2.0, "correct"), (1, 2, 0, 99.0, "wrong"), (1, 3, 1, None, "correct"), (1, 4, 1, 1.0, "wrong"), (1, 5, 2, 1.0, "correct")]
    states = [(1, 1, 7, 0.5, "target"), (1, 1, 7, 1.0, "distractor"), (1, 4, 7, 0.0, "target")]
    a = spark.createDataFrame(trials, "session long, trial long, block long, end double, outcome string")
    b = spark.createDataFrame(states, "session long, trial long, area int, t double, state string")
    got = O.overlap_raster(a, b, ["session"], [7], [0.0, 1.0, 2.0], 10.0).collect()
    by_row = {}
    for r in sorted(got, key=lambda r: (r["row"], r["tick"])):
        by_row.setdefault((r["row"], r["trial"], r["outcome"]), []).append(r["state"])
    none = [None] * 3
    assert by_row == {
        (0, 1, "correct"): ["target", "distractor", "distractor"], (1, None, "gap"): none, (2, None, "gap"): none, (3, 4, "wrong"): ["target", "target", None],
        (4, None, "gap"): none, (5, None, "gap"): none, (6, 5, "correct"): ["neither", "neither", None],
    }
    assert O.overlap_raster(a.limit(0), b.limit(0), ["session"], [7], [0.0], 10.0).count() == 0


def test_trial_table_edges(spark):
    """A stimulus whose codes the trial's end cuts off, repeated stimuli, conditions and morphs, a block before and within
    a trial, an error digit out of range, the last trial left open; ends that some trials lack."""
    from tidemark.operators import trials as R

    codes = [12, 3000, 3101, 7, 10_030, 4004, 10_005, 3101, 7, 10_040, 4003, 10_006, 55, 60, 70, 107, 108, 1, 3000, 20, 3006, 10_012, 3101, 7, 3000, 2, 3450, 3401, 3403, 3090, 3000, 1]
    df = frame(spark, [("s", k, c) for k, c in enumerate(codes)] + [("t", 0, 3000), ("t", 1, 99), ("t", 2, 3000), (None, 0, 3000), (None, 1, 3000)], "session string, t int, code int")
    got = {(r.session, r.trial): r.asDict() for r in R.trial_table(df, ["session"], ["t"], "code", 3000).collect()}
    assert set(got) == {("s", 1), ("s", 2), ("s", 3), ("t", 1), (None, 1)}
    a, b, c = (got["s", k] for k in (1, 2, 3))
    assert (a["start_time"], a["end_time"], a["correct"], a["wrong"], a["error"], a["base_block"]) == (1, 18, True, False, 7, 2)
    assert (a["condition_target"], a["condition_distractor"], a["distance"], a["offset"], a["right"], a["left"]) == (5, 20, 40, -6, True, True)
    assert (b["placeholder_distance"], b["distance"], b["offset"], b["base_block"]) == (12, 3000 - 10_000, 0, 2)
    assert (c["wrong"], c["morph_target"], c["morph_distractor"], c["base_block"], c["condition_target"]) == (True, 50, 3, 10, 0)
    assert got["t", 1]["base_block"] is None and got["t", 1]["condition_target"] == 49
    ended = R.trial_table(df, ["session"], ["t"], "code", 3000, start_at=2, end_at=3090, hot_rows=4).collect()
    assert [(r.session, r.trial, r.start_time, r.end_time) for r in ended] == [("s", 3, 25, 29)]


def test_typed_values_and_named_objects(spark):
    log = frame(spark, [
        ("s", 1, 1, 0.5, "IntParameterHeader", ["a", "b"]), ("s", 2, 1, 0.6, "IntParameter", ["3", "x"]), ("s", 3, 1, 0.7, "BoolParameterHeader", ["c", "d"]), ("s", 4, 1, 0.8, "BoolParameter", ["1", "false"]),
        ("s", 5, 1, 0.9, "VectorParameterHeader", ["v"]), ("s", 6, 1, 1.0, "VectorParameter", ["X=1 Y=-2.5 Z=0"]), ("s", 7, 1, 1.1, "OddParameterHeader", ["o"]), ("s", 8, 1, 1.2, "OddParameter", ["text "]),
        ("s", 9, 1, 1.3, "FloatParameterHeader", ["f"]), ("s", 10, 1, 1.4, "IntParameter", ["9"]),
    ], "session string, line_no long, object_id long, ts double, kind string, payload array<string>")
    got = {r.name: (r.type, r.number, r.flag, r.vector and tuple(r.vector), r.string) for r in E.typed_params(log).collect()}
    assert got == {"a": ("Int", 3.0, None, None, None), "b": ("Int", None, None, None, None), "c": ("Bool", None, True, None, None), "d": ("Bool", None, False, None, None), "v": ("Vector", None, None, (1.0, -2.5, 0.0), None), "o": ("Odd", None, None, None, "text")}
    born = [("s", 1, 7, "Guid", ["0"]), ("s", 2, 7, "StateName", ["x", "first "]), ("s", 3, 8, "Guid", ["0"]), ("s", 4, 8, "ObjectName", ["other"]), ("s", 9, 7, "Guid", ["0"]), ("s", 10, 7, "ObjectName", ["again"])]
    schema = "session string, line_no long, object_id long, kind string, payload array<string>"
    objects = E.named_objects(frame(spark, born, schema), ["ObjectName", "StateName"], hot_rows=2)
    assert sorted(tuple(r) for r in objects.collect() if r.end) == [("s", 7, 0, 1, "first", 1, 8)]
    assert sorted((r.name, r.repeat) for r in objects.collect() if r.end is None) == [("again", 1), ("other", 0)]
    with pytest.raises(Exception, match="no naming row"):
        E.named_objects(frame(spark, [*born, ("s", 11, 5, "Guid", ["0"]), ("s", 12, 6, "StateName", ["x"])], schema), ["StateName", "ObjectName"]).collect()


def test_curve_search_finds_the_curve(spark):
    points = [("a", float(x), 2.0 + 3.0 * math.exp(-((x - 3) ** 2) / 2)) for x in range(-10, 11)] + [("b", float(x), 1.0) for x in range(4)] + [("a", None, 9.0), ("a", 50.0, None)]
    got = {r.g: r for r in O.curve_search(frame(spark, points, "g string, x double, z double"), ["g"], [float(k) for k in range(-10, 11)], [*O.log_spaced(0.25, 4.0, 5)]).collect()}
    a = got["a"]
    assert (a.cx, a.sigma) == (3.0, 1.0) and abs(a.amplitude - 3) < 1e-9 and abs(a.base - 2) < 1e-9 and a.sse < 1e-9 and a.r2 > 1 - 1e-9
    assert got["b"].sse < 1e-9


def test_gaussian_search_equals_every_candidate(spark):
    """Candidates that are no full product, weights, cells off a grid and missing ones, against plain sums."""
    rng = random.Random(12)
    cells = [(g, rng.uniform(0, 5), rng.choice([0.0, 1.0, 2.5]), rng.gauss(0, 1), rng.choice([0.0, 1.0, 2.0])) for g in "ab" for _ in range(60)]
    centres, sigmas = [(1.0, 1.0), (2.0, 0.5), (4.0, 1.0), (2.0, 2.0)], [0.5, 1.0, 3.0]
    df = frame(spark, [*cells, ("a", None, 1.0, 1.0, 1.0), ("b", 1.0, 1.0, None, 1.0)], "ch string, x double, y double, z double, w double")
    got = {r.ch: r for r in O.gaussian_search(df, ["ch"], centres, sigmas, F.col("w")).collect()}
    for ch in "ab":
        x, y, z, w = (np.array([c[k] for c in cells if c[0] == ch]) for k in range(1, 5))
        best = None
        for (cx, cy) in centres:
            for s in sigmas:
                g = np.exp(-((x - cx) ** 2 + (y - cy) ** 2) / (2 * s * s))
                m = np.stack([g, np.ones_like(g)], 1) * np.sqrt(w)[:, None]
                fit = np.linalg.lstsq(m, z * np.sqrt(w), rcond=None)[0]
                sse = float((w * (z - fit[0] * g - fit[1]) ** 2).sum())
                best = min(best or (np.inf,), (sse, cx, cy, s, *fit))
        r = got[ch]
        assert (r.cx, r.cy, r.sigma) == best[1:4] and (r.sse, r.amplitude, r.base) == pytest.approx((best[0], best[4], best[5]), abs=1e-6)
