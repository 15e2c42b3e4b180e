"""Exact quantiles of groups of any size: distinct values are counted, their counts summed in order over parts of the
group, and a quantile is read off where its rank falls. No task holds a group's values."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scans import HOT_ROWS, Scan


def exact_quantiles(df: DataFrame, by: list[str], value: str, shares: dict[str, float], hot_rows: int = HOT_ROWS) -> DataFrame:
    """(by, named quantiles) of each group, interpolated between the two values around rank share * (n - 1). Nulls don't
    count; a group of nothing else has null quantiles. Null keys are a group of their own."""
    keys = [F.col(c).alias(f"_g{k}") for k, c in enumerate(by)]
    names = [f"_g{k}" for k in range(len(by))]
    rows = df.select(*keys, F.col(value).cast("double").alias("_v"))
    totals = rows.groupBy(*names).agg(F.count("_v").alias("_n")).select(*[F.col(n).alias(f"_t{n}") for n in names], "_n")
    counts = rows.where("_v IS NOT NULL").groupBy(*names, "_v").agg(F.count(F.lit(1)).alias("_c"))
    upto = Scan(counts, names, ["_v"], hot_rows).carry(_upto=("upto", F.col("_c"))).done()
    same = F.lit(True)
    for n in names:
        same = same & F.col(n).eqNullSafe(F.col(f"_t{n}"))
    x = totals.join(upto, same, "left")
    rank = {name: F.lit(float(p)) * (F.col("_n") - 1) for name, p in shares.items()}

    def at(place):
        return F.max(F.when((F.col("_upto") > place) & (F.col("_upto") - F.col("_c") <= place), F.col("_v")))

    ends = [c for name, r in rank.items() for c in (at(F.floor(r)).alias(f"_a_{name}"), at(F.ceil(r)).alias(f"_b_{name}"))]
    got = x.groupBy(*[f"_t{n}" for n in names], "_n").agg(*ends)
    between = [(F.col(f"_a_{name}") + (F.col(f"_b_{name}") - F.col(f"_a_{name}")) * (r - F.floor(r))).alias(name) for name, r in rank.items()]
    return got.select(*[F.col(f"_t{n}").alias(c) for n, c in zip(names, by)], *between)


def join_groups(a: DataFrame, b: DataFrame, by: list[str]) -> DataFrame:
    """Two tables of one row a group, side by side; null keys meet."""
    other = b.select(*[F.col(c).alias(f"_o_{c}") for c in by], *[c for c in b.columns if c not in by])
    same = F.lit(True)
    for c in by:
        same = same & F.col(c).eqNullSafe(F.col(f"_o_{c}"))
    return a.join(other, same).drop(*[f"_o_{c}" for c in by])
