"""Functions over whole ordered series: a group's rows become arrays of one row, on which numpy works in Arrow batches."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Kernel = Callable[[dict[str, np.ndarray]], dict[str, np.ndarray] | None]


def apply_kernel(df: DataFrame, by: list[str], order: list[str], columns: list[str], kernel: Kernel, schema: str) -> DataFrame:
    """(by, schema): what a kernel gives for each group, as rows.

    The kernel gets the group's columns as arrays in order (missing numbers are NaN) and returns arrays of one length by
    name, or None for no rows. Each group is held by one task, so by must bound its length: trials, channels, chunks.
    """
    names = list(dict.fromkeys([*order, *columns]))
    listed = df.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct(*names))).alias("_rows"))
    packed = listed.select(*by, *[F.col("_rows").getField(c).alias(f"_{k}") for k, c in enumerate(names)])
    fields = [part.strip().split(" ", 1) for part in schema.split(",")]
    kinds = {"double": pa.float64(), "long": pa.int64(), "int": pa.int32(), "boolean": pa.bool_(), "string": pa.string()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, len(batch), 64):
                part = batch.slice(at, 64)
                counts, found = [], {name: [] for name, _ in fields}
                for row in range(len(part)):
                    own = {c: part.column(len(by) + k)[row].values.to_numpy(zero_copy_only=False) for k, c in enumerate(names)}
                    got = kernel(own)
                    counts.append(0 if got is None else len(got[fields[0][0]]))
                    if counts[-1]:
                        for name, _ in fields:
                            found[name].append(got[name])
                if not sum(counts):
                    continue
                keys = pa.array(np.repeat(np.arange(len(part)), counts))
                values = [pa.array(np.concatenate(found[name]), kinds[kind]) for name, kind in fields]
                yield pa.RecordBatch.from_arrays([*(part.column(k).take(keys) for k in range(len(by))), *values], [*by, *found])

    keys = df.select(*by).schema.simpleString()[len("struct<") : -1]
    return packed.mapInArrow(run, f"{keys}, {schema}")
