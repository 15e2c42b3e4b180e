"""Recursive (infinite impulse response) filters over recordings of any length (sections J6 and J9).

A recursive filter is an affine map: what a stretch of samples does to the filter's state is a fixed matrix power and an
offset. So chunks of a recording are filtered from rest, all at once; the states they end in are composed along each
recording, one row a chunk; and then every chunk is filtered from the state that it really begins in. The result is that
of one pass over the whole recording, however it is cut.
"""

from __future__ import annotations

import cmath
import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..staging import written

#: A second-order section: b0, b1, b2, a1, a2 of y = b0 x + b1 x' + b2 x'' - a1 y' - a2 y''.
Section = tuple[float, float, float, float, float]
#: Samples that are multiplied at once within a chunk.
BLOCK = 64


def butterworth(order: int, fs: float, low: float | None = None, high: float | None = None, stop: bool = False) -> list[Section]:
    """Sections of a Butterworth filter: low-pass with high alone, high-pass with low alone, band-pass with both, or
    band-stop. Its cut-offs, below half of fs, are where it passes half of the power; bands have twice the order."""
    if low is None and high is None or not all(c is None or 0 < c < fs / 2 for c in (low, high)) or (stop and None in (low, high)):
        raise ValueError("cut-offs must lie between 0 and half the sample rate")
    warp = lambda c: 2 * fs * math.tan(math.pi * c / fs)
    poles = [cmath.exp(1j * math.pi * (2 * k + order + 1) / (2 * order)) for k in range(order)]
    if low is not None and high is not None:
        middle, width = warp(low) * warp(high), warp(high) - warp(low)
        poles = [x for p in poles for q in ((width / p if stop else width * p) / 2,) for r in (cmath.sqrt(q * q - middle),) for x in (q + r, q - r)]
        zeros = [s * 1j * math.sqrt(middle) for _ in range(order) for s in (1, -1)] if stop else [0.0] * order
    elif low is not None:
        poles, zeros = [warp(low) / p for p in poles], [0.0] * order
    else:
        poles, zeros = [warp(high) * p for p in poles], []
    digital = lambda s: (2 * fs + s) / (2 * fs - s)
    p, z = [digital(s) for s in poles], [digital(s) for s in zeros]
    z += [-1.0 + 0j] * (len(p) - len(z))
    # unit gain where the filter passes most: at rest, at half of fs, or in the middle of the band
    at = cmath.exp(2j * math.atan(math.sqrt(warp(low) * warp(high)) / (2 * fs))) if low is not None and high is not None and not stop else -1.0 if low is not None and not stop else 1.0
    sections = []
    for own_p, own_z in _matched(p, z):
        (_, a1, a2), zero = _product(own_p), _product(own_z)
        share = float(abs(np.prod([at - x for x in own_p]) / np.prod([at - x for x in own_z])))
        sections.append((share * zero[0], share * zero[1], share * zero[2], a1, a2))
    return sections


def _matched(poles: list[complex], zeros: list[complex]) -> list[tuple[list[complex], list[complex]]]:
    """Pairs of poles, those nearest to the unit circle first, each with as many of the zeros that are left and nearest:
    sections that hardly amplify keep their rounding small."""
    left, found = _pairs(zeros), []
    for own in sorted(_pairs(poles), key=lambda x: abs(1 - abs(x[0]))):
        if any(x[0].imag for x in left):
            best = min(left, key=lambda x: abs(x[0] - own[0]))
            left.remove(best)
        else:
            single = sorted((r for x in left for r in x), key=lambda r: abs(r - own[0]))
            best, rest = single[: len(own)], single[len(own) :]
            left = [[r] for r in rest]
        found.append((own, best))
    return found[::-1]


def _pairs(roots: list[complex]) -> list[list[complex]]:
    """Roots in conjugate pairs, and real ones two by two; one may be left alone."""
    upper = sorted((r for r in roots if r.imag > 1e-9), key=lambda r: (abs(r), r.real))
    real = sorted((complex(r.real) for r in roots if abs(r.imag) <= 1e-9), key=lambda r: r.real)
    return [[r, r.conjugate()] for r in upper] + [real[k : k + 2] for k in range(0, len(real), 2)]


def _product(roots: list[complex]) -> tuple[float, float, float]:
    one = np.poly(roots).real
    return tuple(float(x) for x in (*one, *[0.0] * (3 - len(one))))


class Recursion:
    """Sections in series as one linear system s' = A s + B x, y = C s + D x, with the maps of a block of samples."""

    def __init__(self, sections: list[Section]):
        d = 2 * len(sections)
        a, b = np.zeros((d, d)), np.zeros(d)
        c, gain = np.zeros(d), 1.0
        for k, (b0, b1, b2, a1, a2) in enumerate(sections):
            # the section's input is c s + gain x of those before it
            i, j = 2 * k, 2 * k + 1
            for row, (feed, back) in ((i, (b1, a1)), (j, (b2, a2))):
                a[row] += (feed - back * b0) * c
                a[row, i] -= back
                b[row] = (feed - back * b0) * gain
            a[i, j] += 1
            c, gain = b0 * c, b0 * gain
            c[i] += 1
        self.a, self.b, self.c, self.d = a, b, c, gain
        powers = [np.eye(d)]
        for _ in range(BLOCK):
            powers.append(powers[-1] @ a)
        impulse = np.array([gain, *(c @ powers[k] @ b for k in range(BLOCK - 1))])
        self.respond = np.array([[impulse[r - s] if r >= s else 0.0 for s in range(BLOCK)] for r in range(BLOCK)])
        self.observe = np.array([c @ powers[k] for k in range(BLOCK)])
        self.reach = np.array([powers[BLOCK - 1 - k] @ b for k in range(BLOCK)]).T
        self.over = powers[BLOCK]
        self.powers: dict[int, np.ndarray] = {}

    def run(self, x: np.ndarray, state: np.ndarray) -> np.ndarray:
        """Output from a state."""
        blocks = np.pad(x, (0, -len(x) % BLOCK)).reshape(-1, BLOCK)
        pushes = blocks @ self.reach.T
        states = np.empty((len(blocks), len(state)))
        for k in range(len(blocks)):
            states[k] = state
            state = self.over @ state + pushes[k]
        return (blocks @ self.respond.T + states @ self.observe.T).ravel()[: len(x)]

    def end(self, x: np.ndarray) -> np.ndarray:
        """The state after the last sample, from rest, in which samples of nothing before the first leave it."""
        state = np.zeros(len(self.b))
        for push in np.pad(x, (-len(x) % BLOCK, 0)).reshape(-1, BLOCK) @ self.reach.T:
            state = self.over @ state + push
        return state

    def after(self, n: int, state: np.ndarray) -> np.ndarray:
        """What n samples of nothing leave of a state."""
        if n not in self.powers:
            if len(self.powers) > 10_000:
                self.powers.clear()
            self.powers[n] = np.linalg.matrix_power(self.a, n)
        return self.powers[n] @ state


def _pack(sig: DataFrame, by: list[str], value: str, sample: str, chunk: int) -> DataFrame:
    """(by, _chunk, _s, _v): a row a chunk of a recording, with its samples in order."""
    rows = sig.select(*by, F.col(sample).cast("long").alias("_s"), F.col(value).cast("double").alias("_v"))
    packed = rows.groupBy(*by, F.floor(F.col("_s") / chunk).alias("_chunk")).agg(F.array_sort(F.collect_list(F.struct("_s", "_v"))).alias("_r"))
    return packed.select(*by, "_chunk", F.col("_r._s").alias("_s"), F.col("_r._v").alias("_v"))


def _unpack(packed: DataFrame, by: list[str], sample: str, kind: str, out: str) -> DataFrame:
    x = packed.select(*by, F.explode(F.arrays_zip("_s", "_v")).alias("_x"))
    return x.select(*by, F.col("_x._s").cast(kind).alias(sample), F.col("_x._v").alias(out))


def _stretches(batch: pa.RecordBatch, at: int, backward: bool, chunk: int) -> Iterator[tuple[np.ndarray, int, np.ndarray, int]]:
    """Of each row, in the filter's direction: where the samples lie in the values from the first to the last of them, how
    many places the chunk has before these, the values, and how many it has after them."""
    columns = [batch.column(at + k) for k in range(3)]
    s, v = columns[1].values.to_numpy(zero_copy_only=False), columns[2].values.to_numpy(zero_copy_only=False)
    offsets = columns[1].offsets.to_numpy(), columns[2].offsets.to_numpy()
    for row, k in enumerate(columns[0].to_pylist()):
        own, values = (x[o[row] : o[row + 1]] for x, o in zip((s, v), offsets))
        first, last = int(own[0]), int(own[-1])
        x = np.zeros(last - first + 1)
        x[own - first] = np.nan_to_num(values, posinf=np.inf, neginf=-np.inf)
        before, after = first - k * chunk, (k + 1) * chunk - 1 - last
        yield (last - own, after, x[::-1], before) if backward else (own - first, before, x, after)


def _pass(packed: DataFrame, by: list[str], system: Recursion, backward: bool, chunk: int) -> DataFrame:
    """packed with the filter's output for its values. Work follows the samples, not the length of a chunk."""
    packed = written(packed)
    keys = packed.select(*by).schema.simpleString()[len("struct<") : -1]
    n = len(by)

    def ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            states = [system.after(after, system.end(x)).tolist() for _, _, x, after in _stretches(batch, n, backward, chunk)]
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in range(n + 1)), pa.array(states, pa.list_(pa.float64()))], [*by, "_chunk", "_end"])

    def compose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The states that chunks other than a recording's first begin in; rows come in order of recording and chunk."""
        state = np.zeros(len(system.b))
        for batch in batches:
            at, begins = [], []
            for row, (k, end, last) in enumerate(zip(*(batch.column(n + i).to_pylist() for i in range(3)))):
                if last is None:
                    state = np.asarray(end)
                    continue
                state = system.after((abs(k - last) - 1) * chunk, state) if abs(k - last) > 1 else state
                at.append(row)
                begins.append(state.tolist())
                state = system.after(chunk, state) + np.asarray(end)
            kept = batch.take(pa.array(at, pa.int64()))
            yield pa.RecordBatch.from_arrays([*(kept.column(k) for k in range(n + 1)), pa.array(begins, pa.list_(pa.float64()))], [*by, "_chunk", "_begin"])

    kind = f"{keys}, _chunk bigint"
    along = Window.partitionBy(*by).orderBy(F.desc("_chunk") if backward else F.asc("_chunk"))
    final = packed.mapInArrow(ends, f"{kind}, _end array<double>").withColumn("_last", F.lag("_chunk").over(along))
    begins = final.mapInArrow(compose, f"{kind}, _begin array<double>")
    named = begins.select(*[F.col(c).alias(f"_key_{k}") for k, c in enumerate((*by, "_chunk"))], "_begin")
    same = reduce(lambda a, b: a & b, (F.col(c).eqNullSafe(F.col(f"_key_{k}")) for k, c in enumerate((*by, "_chunk"))))
    both = packed.join(named, same, "left").select(*by, "_chunk", "_s", "_v", "_begin")

    def filtered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for (at, before, x, _), begin in zip(_stretches(batch, n, backward, chunk), batch.column(n + 3).to_pylist()):
                state = np.zeros(len(system.b)) if begin is None else system.after(before, np.asarray(begin))
                found.append(system.run(x, state)[at])
            ends = np.cumsum([0, *map(len, found)])
            values = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate([np.empty(0), *found])))
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in range(n + 2)), values], [*by, "_chunk", "_s", "_v"])

    return both.mapInArrow(filtered, f"{kind}, _s array<bigint>, _v array<double>")


def recursive(sig: DataFrame, by: list[str], sections: list[Section], value: str = "value", sample: str = "sample", out: str = "filtered", backward: bool = False, chunk: int = 1 << 16) -> DataFrame:
    """(by, sample, out): a recursive filter's output at every sample that sig has, from rest at a recording's first (or,
    backward, its last) one.

    Samples are whole numbers, one row each; those that are missing, or have no value, count as zero. Recordings may be of
    any length: a task holds a chunk, and the composition one row a chunk.
    """
    x = _pass(_pack(sig, by, value, sample, chunk), by, Recursion(sections), backward, chunk)
    return _unpack(x, by, sample, sig.schema[sample].dataType.simpleString(), out)


def _twice(packed: DataFrame, by: list[str], sections: list[Section], chunk: int) -> DataFrame:
    system = Recursion(sections)
    return _pass(_pass(packed, by, system, False, chunk), by, system, True, chunk)


def two_pass(sig: DataFrame, by: list[str], sections: list[Section], every: int = 1, value: str = "value", sample: str = "sample", chunk: int = 1 << 16) -> DataFrame:
    """(by, sample, filtered): forward, then backward over the output, so that nothing is delayed; every so many samples
    are kept. Both passes begin at rest, without padding."""
    x = _twice(_pack(sig, by, value, sample, chunk), by, sections, chunk)
    return _unpack(x, by, sample, sig.schema[sample].dataType.simpleString(), "filtered").where(F.col(sample) % every == 0)


def field_potential(sig: DataFrame, by: list[str], fs: float, low: float, high: float, notch: tuple[float, float] | None = None, every: int = 1, order: int = 4, chunk: int = 1 << 16) -> DataFrame:
    """Band-passed from low to high, without the notch's band if given, thinned."""
    x = _twice(_pack(sig, by, "value", "sample", chunk), by, butterworth(order, fs, low, high), chunk)
    x = _twice(x, by, butterworth(order, fs, *notch, stop=True), chunk) if notch else x
    return _unpack(x, by, "sample", sig.schema["sample"].dataType.simpleString(), "filtered").where(F.col("sample") % every == 0)


def unit_activity(sig: DataFrame, by: list[str], fs: float, low: float, high: float, smooth: float, every: int = 1, order: int = 4, chunk: int = 1 << 16) -> DataFrame:
    """Band-passed, rectified, low-passed and thinned."""
    x = _twice(_pack(sig, by, "value", "sample", chunk), by, butterworth(order, fs, low, high), chunk)
    x = _twice(x.withColumn("_v", F.transform("_v", F.abs)), by, butterworth(order, fs, high=smooth), chunk)
    return _unpack(x, by, "sample", sig.schema["sample"].dataType.simpleString(), "filtered").where(F.col("sample") % every == 0)
