"""Table functions that emit any number of rows from the ordered rows of a partition (section 2.13).

Spark sorts and deals the partitions; a function sees one row at a time and holds a bounded state, so partitions may be
of any length. ``register`` names them for SQL:

    SELECT * FROM segments(TABLE(marks) PARTITION BY session ORDER BY (us, seq), 3000, 3091)
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql.functions import lit, udtf


@udtf(returnType="session bigint, start bigint, stop bigint")
class Segments:
    """Of rows (session, us, code) the spans from a start to the first stop after it, unless another start comes first;
    a start without a stop is emitted, with a null stop, when it is known to have none."""

    def __init__(self) -> None:
        self.session, self.open = None, None

    def eval(self, row: Row, start: int, stop: int) -> Iterator[tuple]:
        self.session = row["session"]
        if row["code"] == start:
            if self.open is not None:
                yield self.session, self.open, None
            self.open = row["us"]
        elif row["code"] == stop and self.open is not None:
            yield self.session, self.open, row["us"]
            self.open = None

    def terminate(self) -> Iterator[tuple]:
        if self.open is not None:
            yield self.session, self.open, None


@udtf(returnType="session bigint, pos bigint, gram array<bigint>")
class KGrams:
    """Of rows (session, code) every k codes in a row, with the place of the first, from 0; fewer codes give none."""

    def __init__(self) -> None:
        self.held, self.seen = None, 0

    def eval(self, row: Row, k: int) -> Iterator[tuple]:
        if self.held is None:
            if k < 1:
                raise ValueError("k must be at least 1")
            self.held = deque(maxlen=k)
        self.held.append(row["code"])
        self.seen += 1
        if self.seen >= k:
            yield row["session"], self.seen - k, list(self.held)


def register(spark: SparkSession) -> None:
    """segments and kgrams, for SQL of this session."""
    spark.udtf.register("segments", Segments)
    spark.udtf.register("kgrams", KGrams)


def segments(events: DataFrame, order: list[str], start: int, stop: int) -> DataFrame:
    """``Segments`` of (session, us, code), sessions apart, in an order of columns of events."""
    return Segments(events.asTable().partitionBy("session").orderBy(*order), lit(start), lit(stop))


def kgrams(events: DataFrame, order: list[str], k: int) -> DataFrame:
    """``KGrams`` of (session, code), sessions apart, in an order of columns of events."""
    return KGrams(events.asTable().partitionBy("session").orderBy(*order), lit(k))
