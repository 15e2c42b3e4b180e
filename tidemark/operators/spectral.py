"""Spectra, coherence and filters (section J).

Each window, trial or chunk of a channel is one row of samples, on which numpy's transforms and convolutions work in
Arrow batches; Spark deals the rows.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .joins import span_join
from .kernels import apply_kernel


def _frequencies(n: int, fs: float, low: float, high: float, open_low: bool = False) -> list[tuple[int, float]]:
    """(k, k fs / n) within [low, high], or (low, high]."""
    return [(k, k * fs / n) for k in range(n // 2 + 1) if (k * fs / n > low if open_low else k * fs / n >= low) and k * fs / n <= high]


def _hann(n: int) -> np.ndarray:
    return 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(n) / n)


def power_hann(sig: DataFrame, by: list[str], n: int, fs: float, low: float, high: float, value: str = "value", sample: str = "sample") -> DataFrame:
    """One-sided power density of each window of n samples, mean removed and Hann-weighted; windows with missing values
    are left out."""
    freqs = _frequencies(n, fs, low, high)
    at, names = np.array([k for k, _ in freqs], int), np.array([f for _, f in freqs])
    weight, norm = _hann(n), fs * (_hann(n) ** 2).sum()
    sides = np.where((at == 0) | (at * 2 == n), 1.0, 2.0)

    def spectrum(x: dict) -> dict | None:
        v = x[value].astype(float)
        if len(v) != n or np.isnan(v).any():
            return None
        z = np.fft.rfft((v - v.mean()) * weight)[at]
        return {"freq": names, "power": (z.real**2 + z.imag**2) * sides / norm}

    return apply_kernel(sig, by, [sample], [value], spectrum, "freq double, power double")


def slepian_tapers(n: int, half_bandwidth: float, count: int) -> np.ndarray:
    """The first discrete prolate spheroidal sequences, as eigenvectors of their tridiagonal matrix; unit energy."""
    k = np.arange(n)
    diagonal = ((n - 1 - 2 * k) / 2) ** 2 * math.cos(2 * math.pi * half_bandwidth / n)
    off = k[1:] * (n - k[1:]) / 2
    _, vectors = np.linalg.eigh(np.diag(diagonal) + np.diag(off, 1) + np.diag(off, -1))
    return vectors[:, ::-1][:, :count].T


def power_multitaper(sig: DataFrame, by: list[str], n: int, fs: float, low: float, high: float, bandwidth: float, value: str = "value", sample: str = "sample") -> DataFrame:
    """Mean power over max(2NW - 1, 1) tapers within (low, high], NW being bandwidth times half the window's length."""
    nw = bandwidth * n / fs / 2
    tapers = slepian_tapers(n, nw, max(int(2 * nw - 1), 1))
    freqs = _frequencies(n, fs, low, high, True)
    at, names = np.array([k for k, _ in freqs], int), np.array([f for _, f in freqs])

    def spectrum(x: dict) -> dict | None:
        v = x[value].astype(float)
        if len(v) != n or np.isnan(v).any():
            return None
        z = np.fft.rfft((v - v.mean()) * tapers, axis=1)[:, at]
        return {"freq": names, "power": (z.real**2 + z.imag**2).mean(0) / fs}

    return apply_kernel(sig, by, [sample], [value], spectrum, "freq double, power double")


def hybrid_spectrum(sig: DataFrame, by: list[str], n: int, fs: float, split: float, low: float, high: float, bandwidth: float) -> DataFrame:
    """The Hann spectrum up to the split and the multitaper one above it."""
    return power_hann(sig, by, n, fs, low, split).unionByName(power_multitaper(sig, by, n, fs, split, high, bandwidth))


def coherence(sig: DataFrame, by: list[str], source: str, length: int, fs: float, low: float, high: float, value: str = "value", sample: str = "sample") -> DataFrame:
    """(by, a, b, freq, coherence): squared coherence of every pair of sources over half-overlapping Hann windows of a
    length; missing values count as zero, windows start at sample 0. A group holds one trial of all its sources."""
    half, weight = length // 2, _hann(length)
    freqs = _frequencies(length, fs, low, high)
    at, names = np.array([k for k, _ in freqs], int), np.array([f for _, f in freqs])

    def cross(x: dict) -> dict | None:
        sources = np.unique(x[source])
        last = int(x[sample].max())
        grid = np.zeros((len(sources), last + 1))
        grid[np.searchsorted(sources, x[source]), x[sample].astype(int)] = np.nan_to_num(x[value].astype(float))
        starts = np.arange(0, last + 2 - length, half)
        if not len(starts) or len(sources) < 2:
            return None
        own = grid[:, starts[:, None] + np.arange(length)]
        z = np.fft.rfft((own - own.mean(2, keepdims=True)) * weight, axis=2)[:, :, at]
        power = (z.real**2 + z.imag**2).mean(1)
        i, j = np.triu_indices(len(sources), 1)
        with np.errstate(all="ignore"):
            c = np.abs((z[i] * z[j].conj()).mean(1)) ** 2 / (power[i] * power[j])
        n = len(names)
        return {"a": np.repeat(sources[i], n), "b": np.repeat(sources[j], n), "freq": np.tile(names, len(i)), "coherence": c.ravel()}

    kind = sig.schema[source].dataType.simpleString().replace("bigint", "long")
    got = apply_kernel(sig, by, [source, sample], [value], cross, f"a {kind}, b {kind}, freq double, coherence double")
    return got.withColumn("coherence", F.when(~F.isnan("coherence"), F.col("coherence")))


def aperiodic_residual(spectrum: DataFrame, by: list[str], freq: str = "freq", power: str = "power", keep: float = 0.975) -> DataFrame:
    """Log power less a straight line in log frequency, fitted, and again without points far above the first line."""
    x = spectrum.where((F.col(power) > 0) & (F.col(freq) > 0)).withColumn("_x", F.log10(freq)).withColumn("_y", F.log10(power))
    first = x.groupBy(*by).agg(F.regr_slope("_y", "_x").alias("_s"), F.regr_intercept("_y", "_x").alias("_i"))
    x = x.join(first, by).withColumn("_r", F.col("_y") - F.col("_i") - F.col("_s") * F.col("_x"))
    limit = x.groupBy(*by).agg(F.percentile("_r", F.lit(keep)).alias("_q"))
    second = x.join(limit, by).where("_r <= _q").groupBy(*by).agg(F.regr_slope("_y", "_x").alias("slope"), F.regr_intercept("_y", "_x").alias("intercept"))
    return x.join(second, by).select(*by, freq, "slope", "intercept", (F.col("_y") - F.col("intercept") - F.col("slope") * F.col("_x")).alias("residual"))


def bandpass_taps(fs: float, low: float, high: float, taps: int) -> list[float]:
    """A windowed-sinc band-pass of an odd number of taps (low of 0: a low-pass)."""
    middle = taps // 2

    def sinc(cut: float, k: int) -> float:
        return 2 * cut / fs if k == 0 else math.sin(2 * math.pi * cut / fs * k) / (math.pi * k)

    return [(sinc(high, k - middle) - (sinc(low, k - middle) if low else 0.0)) * (0.54 - 0.46 * math.cos(2 * math.pi * k / (taps - 1))) for k in range(taps)]


def smoothing_taps(fs: float, cut: float, taps: int) -> list[float]:
    """A one-pole low-pass cut off after so many taps, with unit sum."""
    decay = math.exp(-2 * math.pi * cut / fs)
    raw = [decay**k for k in range(taps)]
    return [x / sum(raw) for x in raw]


def notch_taps(fs: float, low: float, high: float, taps: int) -> list[float]:
    """A filter that stops the band from low to high: the sample itself less the band-pass."""
    out = [-h for h in bandpass_taps(fs, low, high, taps)]
    out[taps // 2] += 1.0
    return out


def fir(sig: DataFrame, by: list[str], taps: list[float], centred: bool = True, every: int = 1, value: str = "value", sample: str = "sample", chunk: int = 1 << 16) -> DataFrame:
    """(by, sample, filtered) at every sample from a group's first to its last that a known sample is in reach of;
    missing samples and those off the ends count as zero. Only every so many are computed.

    A group is cut into chunks of samples, which also get the samples in reach beyond their ends, so that recordings of
    any length spread over tasks.
    """
    size = len(taps)
    shift, h = size // 2 if centred else 0, np.array(taps, float)
    ends = sig.groupBy(*by).agg(F.min(sample).alias("_a"), F.max(sample).alias("_b"))
    s = F.col(sample)
    homes = F.sequence(F.floor((s - shift) / chunk), F.floor((s + size - 1 - shift) / chunk))
    rows = sig.join(ends, by).select(*by, F.explode(homes).alias("_chunk"), F.col(sample).cast("long").alias("_s"), F.col(value).cast("double").alias("_v"), F.col("_a").cast("long").alias("_a"), F.col("_b").cast("long").alias("_b"))
    rows = rows.withColumn("_own", F.col("_chunk"))

    def convolve(x: dict) -> dict | None:
        at, own = x["_s"], int(x["_own"][0])
        low, high = max(own * chunk, int(x["_a"][0])), min(own * chunk + chunk - 1, int(x["_b"][0]))
        if low > high:
            return None
        base = int(min(at[0], low - size))
        dense = np.zeros(int(max(at[-1], high)) - base + size + 1)
        seen = np.zeros(len(dense))
        known = ~np.isnan(x["_v"])
        dense[at[known] - base] = x["_v"][known]
        seen[at[known] - base] = 1
        out = np.arange(low, high + 1)
        out = out[out % every == 0]
        if not len(out):
            return None
        first = out - base + shift
        got = np.convolve(dense, h)[first]
        near = np.convolve(seen, np.ones(size))[first] > 0.5
        return {sample: out[near], "filtered": got[near]}

    kind = "long" if sig.schema[sample].dataType.simpleString() == "bigint" else "int"
    return apply_kernel(rows, [*by, "_chunk"], ["_s"], ["_v", "_a", "_b", "_own"], convolve, f"{sample} {kind}, filtered double").drop("_chunk")


def envelope(sig: DataFrame, by: list[str], band: list[float], smooth: list[float], every: int) -> DataFrame:
    """Band-passed, rectified, smoothed and thinned."""
    x = fir(sig, by, band).withColumn("filtered", F.abs("filtered"))
    return fir(x, by, smooth, every=every, value="filtered")


def unit_peak_channel(templates: DataFrame, labels: DataFrame, value: str = "value") -> DataFrame:
    """The channel with the largest swing of each unit's median waveform; units labelled noise or mua are left out."""
    good = templates.join(labels.where(F.col("label").isin("noise", "mua")), "unit", "left_anti")
    medians = good.groupBy("unit", "channel", "sample").agg(F.median(value).alias("m"))
    swing = medians.groupBy("unit", "channel").agg((F.max("m") - F.min("m")).alias("swing"))
    return swing.groupBy("unit").agg(F.max_by("channel", F.struct("swing", -F.col("channel"))).alias("channel"), F.max("swing").alias("swing"))


def split_recordings(spikes: DataFrame, files: DataFrame) -> DataFrame:
    """Spikes of a joined recording with the file they fall in and their sample in it; files are (file_no, n)."""
    w = Window.orderBy("file_no").rowsBetween(Window.unboundedPreceding, -1)
    spans = files.withColumn("_from", F.coalesce(F.sum("n").over(w), F.lit(0)))
    x = span_join(spikes, spans.where("n > 0").withColumn("_to", F.col("_from") + F.col("n") - 1), "sample", "_from", "_to")
    return x.withColumn("file_sample", F.col("sample") - F.col("_from")).drop("_from", "_to", "n")
