"""Trial-segmented signals: long and packed forms, with their trial table (section A)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def pack(sig: DataFrame, by: list[str], sample: str = "sample", value: str = "value") -> DataFrame:
    """One row a trial and channel: values as an array in sample order, and the first sample."""
    x = sig.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct(sample, value))).alias("_x"))
    return x.select(*by, F.col("_x")[0][sample].alias("first_sample"), F.col("_x").getField(value).alias("values"))


def unpack(packed: DataFrame, by: list[str]) -> DataFrame:
    """The long form of packed rows."""
    return packed.select(*by, "first_sample", F.posexplode("values").alias("_k", "value")).select(*by, (F.col("first_sample") + F.col("_k")).alias("sample"), "value")


def write_signal(sig: DataFrame, trials: DataFrame, path: str, partition: str = "session", channels: DataFrame | None = None) -> None:
    """Samples partitioned by session and sorted by channel and time within files, so that crops prune; trials beside,
    and the channels' metadata (channel, name, sample_rate), if given."""
    sig.repartition(partition, "channel").sortWithinPartitions("channel", "trial", "sample").write.mode("overwrite").partitionBy(partition).parquet(f"{path}/samples")
    trials.write.mode("overwrite").parquet(f"{path}/trials")
    if channels is not None:
        channels.write.mode("overwrite").parquet(f"{path}/channels")


def read_channels(spark: SparkSession, path: str) -> DataFrame:
    """(channel, name, sample_rate) as written; metadata without names or sample rates is an error."""
    channels = spark.read.parquet(f"{path}/channels")
    missing = {"channel", "name", "sample_rate"} - set(channels.columns)
    if missing:
        raise ValueError(f"the channels lack {', '.join(sorted(missing))}")
    return channels


def read_signal(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(samples, trials) as written; a trial table without start times is an error."""
    trials = spark.read.parquet(f"{path}/trials")
    if "starting_time" not in trials.columns:
        raise ValueError("the trial table has no starting_time")
    return spark.read.parquet(f"{path}/samples"), trials


def trial_time(trials: DataFrame, fs: float, n: str = "n", offset: str = "offset") -> DataFrame:
    """Each trial's samples with their time, (0 ... n-1 + offset) / fs; a trial of no samples has none."""
    x = trials.where(F.col(n) > 0).withColumn("sample", F.explode(F.sequence(F.lit(0), F.col(n).cast("int") - 1)))
    return x.withColumn("t", (F.col("sample") + F.col(offset)) / fs)
