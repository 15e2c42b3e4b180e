"""What the operators share: joins with counted sides, memory of workers, connected components, running sums."""

from __future__ import annotations

import contextlib
import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..staging import new_dir, shared_dir
from ..staging import written as cut

__all__ = ["cut", "new_dir", "shared_dir"]

#: A word: a run of anything but the six ASCII white-space characters.
WORD = r"[^\x20\x09-\x0D]+"


#: Rows of the smaller side of a join up to which it is broadcast; it is counted first, and beyond it both are sorted.
SMALL_ROWS = 500_000


def join_counted(big: DataFrame, small: DataFrame, on: str | list[str], how: str = "inner") -> DataFrame:
    """big joined with small, which is a written table of a few numbers a row: broadcast only if it is counted to be
    small. Else both sides are shuffled bare, so that adaptive execution can split the hot keys of big."""
    return big.join(F.broadcast(small) if small.count() <= SMALL_ROWS else small.hint("merge"), on, how)


def by_bytes(batch: pa.RecordBatch, most: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """A batch in slices of about so many bytes, one row at least, so that results of long texts don't pile up."""
    rows = max(1, int(len(batch) * most / max(1, batch.nbytes)))
    for at in range(0, len(batch), rows):
        yield batch.slice(at, rows)


def release() -> None:
    """Give freed memory of this Python worker back to the system: workers stay alive between stages."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def tidied(run):
    """A function over batches for mapInArrow that releases freed memory when its task ends."""

    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            release()

    return wrapped


def _state(edges: DataFrame) -> tuple:
    h = F.xxhash64("u", "v").cast("decimal(38,0)")
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(h)).first())


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """Connected components of an undirected graph, by alternating large-star and small-star steps.

    edges has two long columns; loops and repeats are fine. Returns (node, root) for every node that has an edge,
    root being the smallest node of its component. Each step is two aggregations that combine on the map side, whose
    results are written, and a join with these, so that a node with very many edges fills no task (join_counted).
    Rounds grow with the logarithm of the longest path. Only counts and hash sums reach the driver.
    """
    a, b = edges.columns
    e = cut(
        edges.where(F.col(a) != F.col(b))
        .select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))
        .distinct()
    )
    seen = _state(e)
    for _ in range(most_rounds):
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = cut(both.groupBy("u").agg(F.min(F.least("u", "v")).alias("m")))
        large = join_counted(both, low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = cut(large.distinct())
        low = cut(large.groupBy("u").agg(F.min("v").alias("m")))
        small = (
            join_counted(large, low, "u")
            .select(F.explode(F.array(F.struct("u", "m"), F.struct(F.col("v").alias("u"), "m"))).alias("x"))
            .select(F.col("x.u").alias("u"), F.col("x.m").alias("v"))
            .where("u != v")
            .distinct()
        )
        e = cut(small)
        now = _state(e)
        if now == seen:
            break
        seen = now
    else:
        raise RuntimeError("components did not settle")
    tops = e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    return e.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(tops)


def running(df: DataFrame, order: list, value: str, before: str = "before") -> DataFrame:
    """df with the sum of a long column over all earlier rows in a total order, in a column named before.

    Rows are dealt by range and sorted in their tasks, where local sums run; only one total a task is added up in
    one place. The result is cut, so its rows keep the tasks that they were counted in.
    """
    from pyspark import TaskContext

    names = [*df.columns, "_part", before]
    at = df.columns.index(value)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, total = TaskContext.get().partitionId(), 0
        for batch in batches:
            ends = np.cumsum(np.asarray(batch.column(at), np.int64)) + total
            local = np.concatenate(([total], ends[:-1])) if len(ends) else ends
            total = int(ends[-1]) if len(ends) else total
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.full(len(batch), part)), pa.array(local)], names)

    schema = df.schema.simpleString()[len("struct<") : -1]
    sums = cut(df.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(run, f"{schema},_part:bigint,{before}:bigint"))
    totals = sums.groupBy("_part").agg(F.max(F.col(before) + F.col(value)).alias("_sum"))
    earlier = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select("_part", F.coalesce(F.sum("_sum").over(earlier), F.lit(0)).alias("_start"))
    return sums.join(F.broadcast(starts), "_part").withColumn(before, F.col(before) + F.col("_start")).drop("_part", "_start")
