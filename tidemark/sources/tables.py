"""Delimited files, slices by index, paths as metadata, and sinks that don't repeat themselves (section A)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.joins import span_join


def read_delimited(spark: SparkSession, path: str, schema: str, header: bool = True, separator: str = ",") -> DataFrame:
    return spark.read.csv(path, schema=schema, header=header, sep=separator)


def codes_to_text(codes: Column) -> Column:
    """An array of codes as one comma-separated string."""
    return F.array_join(F.transform(codes, lambda c: c.cast("string")), ",")


def text_to_codes(text: Column) -> Column:
    """The codes of a comma-separated string; parts that are no numbers are null."""
    return F.transform(F.split(text, ","), lambda c: F.trim(c).try_cast("long"))


def joined_header(first: list[str], second: list[str]) -> list[str]:
    """Column names from two header rows, a blank in the first one meaning the name before it."""
    names, last = [], ""
    for a, b in zip(first, second):
        last = a or last
        names.append(f"{last}_{b}" if last else b)
    return names


def read_two_row_header(spark: SparkSession, path: str, kind: str = "double", separator: str = ",") -> DataFrame:
    """Delimited files whose first two rows together name the columns, all of one kind. The names are the first file's;
    rows that repeat either header row are left out wherever they stand."""
    first, second = (r.value for r in spark.read.text(path).head(2))
    names = joined_header(first.split(separator), second.split(separator))
    schema = T.StructType([T.StructField(n, T.StringType()) for n in names])
    rows = spark.read.text(path).where(~F.col("value").isin(first, second)).select(F.from_csv("value", schema.simpleString()[len("struct<") : -1].replace(":", " "), {"sep": separator}).alias("x"))
    return rows.select(*[F.col("x").getField(n).try_cast(kind).alias(n) for n in names])


INDEX = T.ArrayType(T.StructType([T.StructField("session_id", T.StringType()), T.StructField("start_idx", T.LongType()), T.StructField("end_idx", T.LongType())]))


def slice_by_index(values: DataFrame, index: DataFrame, text: str, pos: str) -> DataFrame:
    """Values with the session whose slice holds their position, both ends included; date is the id's second part."""
    slices = index.select(F.explode(F.from_json(text, INDEX)).alias("s")).select("s.*")
    x = span_join(values, slices, pos, "start_idx", "end_idx")
    return x.withColumn("date", F.split_part("session_id", F.lit("_"), F.lit(2))).drop("start_idx", "end_idx")


def path_fields(path: Column, root: str, names: list[str]) -> list[Column]:
    """The path's segments after root, by name; null where the path is shorter or lacks root."""
    parts = F.split(path, "/")
    at = F.array_position(parts, root)
    return [F.when(at > 0, F.get(parts, (at + k).cast("int"))).alias(n) for k, n in enumerate(names)]


def alignment_tag(path: Column) -> Column:
    """The last six digits of ``..._events######.npy``; null for other paths."""
    return F.nullif(F.regexp_extract(path, r"_events\d*(\d{6})\.npy$", 1), F.lit(""))


def without_known(new: DataFrame, known: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of new whose keys, nulls included, aren't known yet; equal new rows appear once."""
    same = reduce(lambda a, b: a & b, [new[k].eqNullSafe(known[k]) for k in keys])
    return new.join(known.select(*keys).distinct(), same, "left_anti").dropDuplicates(keys)


def append_new(known: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """known with the rows of new whose keys it lacks."""
    return known.unionByName(without_known(new, known, keys))


def write_results(df: DataFrame, path: str, keys: list[str]) -> None:
    """Append rows whose keys the table at path doesn't hold; what it holds is never overwritten."""
    spark = df.sparkSession
    try:
        known = spark.read.parquet(path)
    except Exception as e:  # nothing written yet
        if "PATH_NOT_FOUND" not in str(e) and "UNABLE_TO_INFER_SCHEMA" not in str(e):
            raise
        df.dropDuplicates(keys).write.partitionBy(*keys[:1]).parquet(path)
        return
    without_known(df, known, keys).write.mode("append").partitionBy(*keys[:1]).parquet(path)


def session_inventory(df: DataFrame, session: str, day: str, task: str, since: str, wanted: str) -> DataFrame:
    """Sessions after a date that hold the wanted task: trials and the sorted list of tasks of each."""
    x = df.where(F.col(day) >= F.lit(since).cast("timestamp_ntz"))
    got = x.groupBy(session).agg(F.count(F.lit(1)).alias("trials"), F.array_sort(F.collect_set(task)).alias("_tasks"))
    return got.where(F.array_contains("_tasks", wanted)).select(session, "trials", F.array_join("_tasks", ",").alias("tasks"))
