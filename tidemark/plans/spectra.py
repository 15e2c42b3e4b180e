"""Queries of section J (spectra and filters)."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from ..operators import aggregates as A
from ..operators import filters as B
from ..operators import spectral as P
from ..operators import windows as W
from .registry import query, r6

N, FS = 64, 64.0


def _power_sql(low: float, high: float) -> str:
    norm = FS * sum((0.5 - 0.5 * math.cos(2 * math.pi * k / N)) ** 2 for k in range(N))
    return f"""SELECT trial, channel, k * {FS} / {N} AS freq, (re * re + im * im) * CASE WHEN k = 0 OR k * 2 = {N} THEN 1 ELSE 2 END / {norm!r} AS power FROM (
  SELECT trial, channel, k, sum(v * cos(2 * pi() * ((k * sample) % {N}) / {N})) AS re, sum(-v * sin(2 * pi() * ((k * sample) % {N}) / {N})) AS im FROM (
    SELECT trial, channel, sample, (value - avg(value) OVER w) * (0.5 - 0.5 * cos(2 * pi() * sample / {N})) AS v, count(value) OVER w AS n FROM sig_nan WINDOW w AS (PARTITION BY trial, channel)), range({N // 2 + 1}) r(k)
  WHERE n = {N} AND k * {FS} / {N} BETWEEN {low} AND {high} GROUP BY trial, channel, k)"""


def _tapered_sql(low: float, high: float, bandwidth: float) -> str:
    nw = bandwidth * N / FS / 2
    rows = ", ".join(f"({i}, {s}, {float(v)!r}::DOUBLE)" for i, row in enumerate(P.slepian_tapers(N, nw, max(int(2 * nw - 1), 1))) for s, v in enumerate(row))
    return f"""SELECT trial, channel, k * {FS} / {N} AS freq, avg(re * re + im * im) / {FS} AS power FROM (
  SELECT trial, channel, taper, k, sum(v * w * cos(2 * pi() * ((k * sample) % {N}) / {N})) AS re, sum(-v * w * sin(2 * pi() * ((k * sample) % {N}) / {N})) AS im FROM (
    SELECT trial, channel, sample, value - avg(value) OVER q AS v, count(value) OVER q AS n FROM sig_nan WINDOW q AS (PARTITION BY trial, channel)) JOIN (VALUES {rows}) h(taper, s, w) ON s = sample, range({N // 2 + 1}) r(k)
  WHERE n = {N} AND k * {FS} / {N} > {low} AND k * {FS} / {N} <= {high} GROUP BY trial, channel, taper, k) GROUP BY trial, channel, k"""


_BY = ["trial", "channel"]


@query("J1_power_hann", f"SELECT trial, channel, freq, round(power, 6) AS power FROM ({_power_sql(2, 30)})")
def _(t):
    return P.power_hann(t.sig_nan, _BY, N, FS, 2, 30).withColumn("power", r6("power"))


@query("J2_power_multitaper", f"SELECT trial, channel, freq, round(power, 6) AS power FROM ({_tapered_sql(16, 32, 4)})")
def _(t):
    return P.power_multitaper(t.sig_nan, _BY, N, FS, 16, 32, 4).withColumn("power", r6("power"))


@query("J3_hybrid_spectrum", f"SELECT trial, channel, freq, round(power, 6) AS power FROM ({_power_sql(2, 16)} UNION ALL {_tapered_sql(16, 32, 4)})")
def _(t):
    return P.hybrid_spectrum(t.sig_nan, _BY, N, FS, 16, 2, 32, 4).withColumn("power", r6("power"))


@query("J4_coherence", """WITH m AS (SELECT trial, array_id, sample, avg(value) AS value FROM sig GROUP BY ALL),
w AS (SELECT trial, array_id, wd, sample - wd * 8 AS s, value FROM m, range(7) q(wd) WHERE sample >= wd * 8 AND sample < wd * 8 + 16),
v AS (SELECT trial, array_id, wd, s, (value - avg(value) OVER (PARTITION BY trial, array_id, wd)) * (0.5 - 0.5 * cos(2 * pi() * s / 16)) AS v FROM w),
f AS (SELECT trial, array_id, wd, k * 4.0::DOUBLE AS freq, sum(v * cos(2 * pi() * ((k * s) % 16) / 16)) AS re, sum(-v * sin(2 * pi() * ((k * s) % 16) / 16)) AS im FROM v, range(1, 9) r(k) GROUP BY trial, array_id, wd, k)
SELECT x.trial, x.array_id AS a, y.array_id AS b, x.freq, round((pow(avg(x.re * y.re + x.im * y.im), 2) + pow(avg(x.im * y.re - x.re * y.im), 2)) / (avg(x.re * x.re + x.im * x.im) * avg(y.re * y.re + y.im * y.im)), 6) AS coherence
FROM f x JOIN f y ON x.trial = y.trial AND x.wd = y.wd AND x.freq = y.freq AND x.array_id < y.array_id GROUP BY ALL""".replace("GROUP BY ALL\"\"\"", "").replace("y.array_id GROUP BY ALL", "y.array_id GROUP BY x.trial, x.array_id, y.array_id, x.freq"))
def _(t):
    m = t.sig.groupBy("trial", "array_id", "sample").agg(F.avg("value").alias("value"))
    return P.coherence(m, ["trial"], "array_id", 16, FS, 2, 32).withColumn("coherence", r6("coherence"))


@query("J5_aperiodic_residual", f"""WITH s AS (SELECT channel, freq, log10(freq) AS x, log10(avg(power)) AS y FROM ({_power_sql(2, 30)}) GROUP BY channel, freq),
a AS (SELECT channel, regr_slope(y, x) AS m, regr_intercept(y, x) AS i FROM s GROUP BY channel), r AS (SELECT s.*, y - i - m * x AS r FROM s JOIN a USING (channel)),
q AS (SELECT channel, quantile_cont(r, 0.975) AS q FROM r GROUP BY channel), b AS (SELECT channel, regr_slope(y, x) AS m, regr_intercept(y, x) AS i FROM r JOIN q USING (channel) WHERE r <= q GROUP BY channel)
SELECT channel, freq, round(m, 6) AS slope, round(i, 6) AS intercept, round(y - i - m * x, 6) AS residual FROM r JOIN b USING (channel)""")
def _(t):
    mean = P.power_hann(t.sig_nan, _BY, N, FS, 2, 30).groupBy("channel", "freq").agg(F.avg("power").alias("power"))
    return P.aperiodic_residual(mean, ["channel"]).withColumns({n: r6(n) for n in ("slope", "intercept", "residual")})


def _taps_sql(taps: list[float], shift: int) -> str:
    return "(VALUES " + ", ".join(f"({k - shift}, {h!r}::DOUBLE)" for k, h in enumerate(taps)) + ") h(k, h)"


BAND, SMOOTH = P.bandpass_taps(FS, 4, 16, 15), P.bandpass_taps(FS, 0, 8, 9)
_FIR = f"SELECT s.trial, s.channel, o.sample, sum(s.value * h) AS filtered FROM sig s, {_taps_sql(BAND, 7)}, (SELECT unnest(range(64)) AS sample) o WHERE o.sample = s.sample + k GROUP BY s.trial, s.channel, o.sample"


@query("J6_bandpass_decimate", f"SELECT trial, channel, sample, round(filtered, 6) AS filtered FROM ({_FIR}) WHERE sample % 4 = 0")
def _(t):
    return P.fir(t.sig, _BY, BAND, every=4).select(*_BY, "sample", r6("filtered").alias("filtered"))


@query("J6_envelope", f"SELECT s.trial, s.channel, o.sample, round(sum(abs(s.filtered) * h), 6) AS filtered FROM ({_FIR}) s, {_taps_sql(SMOOTH, 4)}, (SELECT unnest(range(0, 64, 4)) AS sample) o WHERE o.sample = s.sample + k GROUP BY s.trial, s.channel, o.sample")
def _(t):
    return P.envelope(t.sig, _BY, BAND, SMOOTH, 4).select(*_BY, "sample", r6("filtered").alias("filtered"))


@query("J7_spikes_from_raw", f"""WITH sig AS (SELECT trial, channel, sample, value - median(value) OVER (PARTITION BY trial, sample) AS value FROM (SELECT trial, channel, sample, value FROM (SELECT * FROM sig))),
f AS ({_FIR}), o AS (SELECT *, stddev_pop(filtered) OVER (PARTITION BY trial, channel) AS sd FROM f)
SELECT trial, sample, channel, 0 AS unit FROM (SELECT *, sample - lag(sample) OVER (PARTITION BY trial, channel ORDER BY sample) AS g FROM o WHERE abs(filtered) > 1.5 * sd) WHERE g > 2""".replace("WITH sig AS (SELECT trial, channel, sample, value - median(value) OVER (PARTITION BY trial, sample) AS value FROM (SELECT trial, channel, sample, value FROM (SELECT * FROM sig)))", "WITH s0 AS (SELECT trial, channel, sample, value - median(value) OVER (PARTITION BY trial, sample) AS value FROM sig)").replace("FROM sig s,", "FROM s0 s,"))
def _(t):
    ref = A.common_median_reference(t.sig, ["trial", "sample"]).select(*_BY, "sample", F.col("referenced").alias("value"))
    x = P.fir(ref, _BY, BAND)
    return W.threshold_events(x, _BY, "sample", 1.5, 2, value="filtered").select("trial", "sample", "channel", F.lit(0).alias("unit"))


@query("J8_unit_peak_channel", """WITH m AS (SELECT trial % 6 AS unit, channel, sample, median(value) AS m FROM sig WHERE trial % 6 NOT IN (2, 4) GROUP BY trial % 6, channel, sample),
s AS (SELECT unit, channel, max(m) - min(m) AS swing FROM m GROUP BY unit, channel)
SELECT unit, channel, round(swing, 6) AS swing FROM s QUALIFY row_number() OVER (PARTITION BY unit ORDER BY swing DESC, channel) = 1""")
def _(t):
    labels = t.sig.select((F.col("trial") % 6).alias("unit")).distinct().withColumn("label", F.when(F.col("unit") == 2, "noise").when(F.col("unit") == 4, "mua").otherwise("good"))
    x = P.unit_peak_channel(t.sig.withColumn("unit", F.col("trial") % 6), labels)
    return x.withColumn("swing", r6("swing"))


@query("J8_split_recordings", """WITH f AS (SELECT file_no, n, (coalesce(sum(n) OVER (ORDER BY file_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::BIGINT AS "from" FROM (
  SELECT file_no, 500 + file_no % 7 * 100 AS n FROM (SELECT unnest(range(0, max(l_orderkey) // 500 + 1)) AS file_no FROM lineitem)))
SELECT file_no::BIGINT AS file_no, count(*) AS n, min(s - "from")::BIGINT AS low, max(s - "from")::BIGINT AS high FROM (SELECT l_orderkey AS s FROM lineitem) JOIN f ON s >= "from" AND s < "from" + n GROUP BY file_no""")
def _(t):
    # files of 500 to 1,100 samples, as many as the recording needs
    last = t("lineitem").agg(F.floor(F.max("l_orderkey") / 500).alias("m"))
    files = last.select(F.explode(F.sequence(F.lit(0).cast("long"), "m")).alias("file_no")).withColumn("n", 500 + F.col("file_no") % 7 * 100)
    x = P.split_recordings(t("lineitem").select(F.col("l_orderkey").alias("sample")), files)
    return x.groupBy("file_no").agg(F.count(F.lit(1)).alias("n"), F.min("file_sample").alias("low"), F.max("file_sample").alias("high"))


def _recursive_sql(source: str, by: str, sections: list, sign: int = 1) -> str:
    """Sections run sample by sample from rest over rows (by, sample, x), numbered from 0 in order of sign * sample: by, sample, y."""
    n, keys = len(sections), [k.strip() for k in by.split(",")]
    state = ", ".join(f"z{k}1, z{k}2" for k in range(n))
    inner = "SELECT *, x AS y0 FROM (SELECT n.*, {0} FROM nums n {1})"

    def step(start: str, join: str) -> str:
        sql = inner.format(start, join)
        for k, (b0, *_) in enumerate(sections):
            sql = f"SELECT *, {b0!r}::DOUBLE * y{k} + z{k}1 AS y{k + 1} FROM ({sql})"
        after = ", ".join(f"{b1!r}::DOUBLE * y{k} - ({a1!r}::DOUBLE) * y{k + 1} + z{k}2 AS z{k}1, {b2!r}::DOUBLE * y{k} - ({a2!r}::DOUBLE) * y{k + 1} AS z{k}2" for k, (_, b1, b2, a1, a2) in enumerate(sections))
        return f"SELECT {by}, sample, i, y{n} AS y, {after} FROM ({sql})"

    zero = ", ".join(f"0.0::DOUBLE AS z{k}1, 0.0::DOUBLE AS z{k}2" for k in range(n))
    match = " AND ".join(f"n.{k} = r.{k}" for k in keys)
    return f"""WITH RECURSIVE nums AS (SELECT {by}, sample, x, row_number() OVER (PARTITION BY {by} ORDER BY {sign} * sample) AS i FROM {source}),
r AS ({step(zero, "WHERE i = 1")} UNION ALL {step(state, f"JOIN r ON {match} AND n.i = r.i + 1")}) SELECT {by}, sample, y FROM r"""


_BUTTER, _SLOW = B.butterworth(4, FS, 4, 16), B.butterworth(4, FS, high=8)
_ONCE = _recursive_sql("(SELECT trial, channel, sample, value AS x FROM sig)", "trial, channel", _BUTTER)
_TWICE = _recursive_sql(f"(SELECT trial, channel, sample, y AS x FROM ({_ONCE}))", "trial, channel", _BUTTER, -1)


@query("J6_field_potential", f"SELECT trial, channel, sample, round(y, 6) AS filtered FROM ({_TWICE}) WHERE sample % 4 = 0")
def _(t):
    return B.field_potential(t.sig, _BY, FS, 4, 16, every=4, chunk=25).select(*_BY, "sample", r6("filtered").alias("filtered"))


_RECT = _recursive_sql(f"(SELECT trial, channel, sample, abs(y) AS x FROM ({_TWICE}))", "trial, channel", _SLOW)


@query("J6_unit_activity", f"SELECT trial, channel, sample, round(y, 6) AS filtered FROM ({_recursive_sql(f'(SELECT trial, channel, sample, y AS x FROM ({_RECT}))', 'trial, channel', _SLOW, -1)}) WHERE sample % 4 = 0")
def _(t):
    return B.unit_activity(t.sig, _BY, FS, 4, 16, 8, every=4).select(*_BY, "sample", r6("filtered").alias("filtered"))


@query("J9_recursive_lowpass", f"SELECT session, pos, round(y, 6) AS filtered FROM (SELECT session, sample AS pos, y FROM ({_recursive_sql('(SELECT session, pos AS sample, value AS x FROM seq)', 'session', B.butterworth(1, 60, high=3))}))")
def _(t):
    """Values along a session through the first-order low-pass of 3 Hz at 60 Hz."""
    return B.recursive(t.seq, ["session"], B.butterworth(1, 60, high=3), sample="pos").select("session", "pos", r6("filtered").alias("filtered"))


LOW = P.smoothing_taps(60, 3, 12)


@query("J9_lowpass_1pole", f"SELECT s.session, o.pos, round(sum(s.value * h), 6) AS filtered FROM seq s, {_taps_sql(LOW, 0)}, seq o WHERE o.session = s.session AND o.pos = s.pos + k GROUP BY s.session, o.pos")
def _(t):
    x = P.fir(t.seq, ["session"], LOW, centred=False, sample="pos")
    return x.select("session", "pos", r6("filtered").alias("filtered"))
