"""Values carried along ordered groups of any size: running sums, last and next known values, neighbours.

A window over a group sorts it in one task. Here a group with very many rows is cut at quantiles of its order, the parts
are sorted apart, and what a part needs from the parts before or after it is one row a part. Which groups are cut, and
where, is part of the plan: nothing runs when it is built.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rows above which a group is cut, the parts of one that is, and how many groups are cut at most, the largest first: a
#: group left whole is larger only if so many others are larger still, so it holds less than one in so many of all rows.
HOT_ROWS, PARTS, MOST_CUT = 1_000_000, 64, 4_096


def _same(on: list[str]) -> Column:
    return reduce(lambda a, b: a & b, (F.col(c).eqNullSafe(F.col(f"_key_{c}")) for c in on), F.lit(True))


def _keys(df: DataFrame, on: list[str], *values: str) -> DataFrame:
    return df.select(*[F.col(c).alias(f"_key_{c}") for c in on], *values)


def cut_hot(df: DataFrame, on: list[str], at: str, hot_rows: int = HOT_ROWS, parts: int = PARTS) -> DataFrame:
    """df with _part: -1 in groups of at most so many rows, else the rank of a part of the group, in order of at.

    at is a number, date or time; nulls come first. Rows with equal at are in one part, whatever their number.
    """
    # both tables are bounded by MOST_CUT rows
    hot = df.groupBy(*on).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > hot_rows).orderBy(F.col("_n").desc(), *on).limit(MOST_CUT)
    own = df.select(*on, at).join(F.broadcast(_keys(hot, on)), _same(on), "left_semi")
    places = ", ".join(f"{k / parts}D" for k in range(1, parts))
    cuts = own.groupBy(*on).agg(F.expr(f"percentile_approx(`{at}`, array({places}), {20 * parts})").alias("_scan_cuts"), F.count(F.lit(1)).alias("_scan_rows")).where("_scan_rows > 0")
    x = df.join(F.broadcast(_keys(cuts, on, "_scan_cuts", "_scan_rows")), _same(on), "left")
    part = F.expr(f"CASE WHEN _scan_rows IS NULL THEN -1 WHEN _scan_cuts IS NULL THEN 0 ELSE size(filter(_scan_cuts, c -> c < `{at}`)) END")
    return x.select(*[F.col(f"`{c}`") for c in df.columns], part.alias("_part"))


#: What can be carried: the sum over the rows before, the sum up to a row, the last known value up to it, the next known
#: value from it on, and the value of the row before or after it (null where there is none).
KINDS = ("before", "upto", "last", "next", "lag", "lead")


class Scan:
    """Rows whose groups were cut; each call of ``carry`` adds columns, over the same parts.

    order starts with the column that groups are cut at, and should be total: rows that tie in it come in any order.
    """

    def __init__(self, df: DataFrame, on: list[str], order: list[str], hot_rows: int = HOT_ROWS, parts: int = PARTS):
        self.on, self.order = on, order
        self.rows = cut_hot(df, on, order[0], hot_rows, parts)

    def with_columns(self, columns: dict[str, Column]) -> Scan:
        self.rows = self.rows.withColumns(columns)
        return self

    def where(self, condition: Column) -> Scan:
        self.rows = self.rows.where(condition)
        return self

    def carry(self, **values: tuple[str, Column]) -> Scan:
        """Columns name=(kind, value), of ``KINDS``."""
        if any(kind not in KINDS for kind, _ in values.values()):
            raise ValueError(f"kinds are {KINDS}")
        by = Window.partitionBy(*self.on, "_part").orderBy(*self.order)
        back, ahead = by.rowsBetween(Window.unboundedPreceding, 0), by.rowsBetween(0, Window.unboundedFollowing)
        earlier = by.rowsBetween(Window.unboundedPreceding, -1)
        place = F.struct(*self.order)
        local, ends, carried = {}, {}, {}
        over_parts = Window.partitionBy(*self.on).orderBy("_part")
        parts_before, parts_after = over_parts.rowsBetween(Window.unboundedPreceding, -1), over_parts.rowsBetween(1, Window.unboundedFollowing)
        joined = {}
        for name, (kind, value) in values.items():
            one, got, other = F.struct(value.alias("v")), F.col(f"_own_{name}"), F.col(f"_far_{name}")
            known = F.when(value.isNotNull(), one)
            if kind in ("before", "upto"):
                local[name] = F.coalesce(F.sum(value).over(earlier if kind == "before" else back), F.lit(0))
                ends[name], carried[name] = F.sum(value), F.sum(F.col(f"_end_{name}")).over(parts_before)
                joined[name] = got + F.coalesce(other, F.lit(0))
                continue
            forward = kind in ("next", "lead")
            if kind in ("last", "next"):
                local[name] = F.first(known, True).over(ahead) if forward else F.last(known, True).over(back)
                rank = F.when(value.isNotNull(), place)
            else:
                local[name] = F.lead(one).over(by) if forward else F.lag(one).over(by)
                rank = place
            ends[name] = F.min_by(one, rank) if forward else F.max_by(one, rank)
            carried[name] = F.first(f"_end_{name}", True).over(parts_after) if forward else F.last(f"_end_{name}", True).over(parts_before)
            joined[name] = F.coalesce(got, other)["v"]
        # at most PARTS rows of each of MOST_CUT groups
        far = self.rows.where("_part >= 0").groupBy(*self.on, "_part").agg(*[c.alias(f"_end_{n}") for n, c in ends.items()])
        far = far.select(*[F.col(c).alias(f"_key_{c}") for c in (*self.on, "_part")], *[c.alias(f"_far_{n}") for n, c in carried.items()])
        kept = [c for c in self.rows.columns if c not in values]
        x = self.rows.select(*self.rows.columns, *[c.alias(f"_own_{n}") for n, c in local.items()])
        x = x.join(F.broadcast(far), _same([*self.on, "_part"]), "left")
        self.rows = x.select(*kept, *[c.alias(n) for n, c in joined.items()])
        return self

    def done(self) -> DataFrame:
        return self.rows.drop("_part")


def scan(df: DataFrame, on: list[str], order: list[str], hot_rows: int = HOT_ROWS, **values: tuple[str, Column]) -> DataFrame:
    """df with the columns name=(kind, value) of ``Scan.carry``."""
    return Scan(df, on, order, hot_rows).carry(**values).done()


def chunked(df: DataFrame, on: list[str], order: list[str], before: int = 0, after: int = 0, hot_rows: int = HOT_ROWS) -> DataFrame:
    """df with _pos (a row's place in its group, from 0), _chunk and _own: groups in chunks of hot_rows places, each with as
    many rows of the chunks before and after it, for which _own is false. A window over a group whose frame reaches no
    further is, for own rows, one over its chunk. A chunk must be at least as long as what it lends."""
    if hot_rows < max(before, after):
        raise ValueError("chunks must be at least as long as the frame")
    x = scan(df, on, order, hot_rows, _pos=("before", F.lit(1).cast("long")))
    home, place = F.floor(F.col("_pos") / hot_rows), F.col("_pos") % hot_rows
    near = F.array_compact(F.array(home, F.when(place >= hot_rows - before, home + 1), F.when((place < after) & (home > 0), home - 1)))
    return x.withColumn("_chunk", F.explode(near)).withColumn("_own", home == F.col("_chunk"))
