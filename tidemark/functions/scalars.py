"""Code words, dates, grids and small arithmetic as Column expressions (sections H7 to H11)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def combine_words(high: Column, low: Column) -> Column:
    """A 16-bit word of two 8-bit ones."""
    return F.shiftleft(high.bitwiseAND(F.lit(255)), 8).bitwiseOR(low.bitwiseAND(F.lit(255)))


def strip_strobe(word: Column) -> Column:
    """A word without its highest bit of sixteen."""
    return word.bitwiseAND(F.lit(32767))


def has_strobe(word: Column) -> Column:
    return word.bitwiseAND(F.lit(32768)) > 0


def iso_parts(text: Column) -> Column:
    """(day YYYYMMDD, time HHMMSS) of an ISO-8601 moment; null if it is none."""
    m = F.try_to_timestamp(F.replace(F.rtrim(F.replace(text, F.lit("Z"), F.lit(""))), F.lit("T"), F.lit(" ")))
    return F.struct(F.date_format(m, "yyyyMMdd").alias("day"), F.date_format(m, "HHmmss").alias("time"))


def dashed_day(day: Column, sep: str = "_") -> Column:
    """YYYYMMDD with separators."""
    return F.concat_ws(sep, F.substring(day, 1, 4), F.substring(day, 5, 2), F.substring(day, 7, 2))


def linspace(a: Column, b: Column, n: int) -> Column:
    """n evenly spaced values from a to b."""
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda k: a + (b - a) * k / max(1, n - 1))


def array_split(values: Column, parts: int) -> Column:
    """Contiguous parts of nearly equal size, the first ones longer."""
    size = F.size(values)
    base, more = F.floor(size / parts).cast("int"), size % parts
    start = lambda k: k * base + F.least(k, more)
    return F.transform(F.sequence(F.lit(0), F.lit(parts - 1)), lambda k: F.slice(values, start(k) + 1, start(k + 1) - start(k)))


def meshgrid(xs: Column, ys: Column) -> Column:
    """All pairs (x, y), y by y."""
    return F.flatten(F.transform(ys, lambda y: F.transform(xs, lambda x: F.struct(x.alias("x"), y.alias("y")))))


def decibel(power: Column) -> Column:
    return F.when(power > 0, 10 * F.log10(F.when(power > 0, power)))


def clip(c: Column, low: float, high: float) -> Column:
    return F.least(F.greatest(c, F.lit(low)), F.lit(high))


def normal_density(x: Column, mean: Column, sd: Column) -> Column:
    z = F.try_divide(x - mean, sd)
    return F.try_divide(F.exp(-z * z / 2), sd * 2.5066282746310002)


def rescale(c: Column, low: Column, high: Column, to_low: float = 0.5, to_high: float = 1.0) -> Column:
    """c, between low and high, on another scale; null where those are equal."""
    return F.try_divide(c - low, high - low) * (to_high - to_low) + to_low


def upper_tail(z: Column) -> Column:
    """One-sided p of a normal z, by a rational approximation of the error function (error below 1.5e-7)."""
    x = F.abs(z) / 1.4142135623730951
    t = 1 / (1 + 0.3275911 * x)
    erfc = t * (0.254829592 + t * (-0.284496736 + t * (1.421413741 + t * (-1.453152027 + t * 1.061405429)))) * F.exp(-x * x)
    return F.when(z >= 0, erfc / 2).otherwise(1 - erfc / 2)
