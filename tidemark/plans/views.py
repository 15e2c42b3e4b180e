"""The shapes that operators work on (event log, state sequence, trials, signal, points), as views of the tables."""

from __future__ import annotations

import re
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: The same views for DuckDB, in an order in which each needs only earlier ones.
SQL = {
    "ev": """SELECT user_id AS session, date_diff('microsecond', TIMESTAMP '2024-01-01', ts) AS us, event_id AS seq, event_type, value, props,
  CASE event_type WHEN 'signup' THEN 3000 WHEN 'view' THEN 3011 WHEN 'click' THEN 1 WHEN 'error' THEN 2 WHEN 'purchase' THEN 3091 END AS code
  FROM events""",
    "seq": """SELECT session, row_number() OVER (PARTITION BY session ORDER BY us, seq) - 1 AS pos, event_type AS state,
  event_type = 'purchase' AS is_exit, us, value, code FROM ev""",
    "tr": """SELECT o_custkey AS session, o_orderkey AS trial, o_orderpriority AS state, o_orderstatus AS outcome, o_totalprice AS rt,
  o_orderdate AS day FROM orders""",
    "sig": """SELECT trial % 5 AS session, trial, channel, channel // 2 + 1 AS array_id, trial % 4 AS state, sample, (sample - 16) / 64 AS t, value FROM (
  SELECT vec_id // 8 AS trial, vec_id % 8 AS channel, unnest(range(len(embedding))) AS sample,
    unnest(embedding)::DOUBLE AS value FROM embeddings)
  WHERE trial < (SELECT count(*) // 8 FROM embeddings)""",
    "sig_nan": """SELECT * REPLACE (CASE WHEN trial % 13 = 5 OR (channel = 3 AND session = 2) THEN NULL ELSE value END AS value) FROM sig""",
    "spk": """SELECT l_orderkey AS trial, l_suppkey % 32 AS channel, l_quantity / 50 AS t, l_linenumber AS unit, l_partkey AS part FROM lineitem""",
}
_NEEDS = {"seq": ["ev"], "sig_nan": ["sig"]}


def with_views(sql: str) -> str:
    """sql as a subquery below the views that it names."""
    wanted: list[str] = []
    for name in SQL:
        if re.search(rf"\b{name}\b", sql):
            wanted += [x for x in [*_NEEDS.get(name, []), name] if x not in wanted]
    if not wanted:
        return sql
    return "WITH " + ",\n".join(f"{x} AS ({SQL[x]})" for x in wanted) + f"\nSELECT * FROM (\n{sql}\n)"


class Tables:
    """The given tables of a folder, and the views."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def __call__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    @cached_property
    def ev(self) -> DataFrame:
        code = F.create_map(*[F.lit(x) for kv in {"signup": 3000, "view": 3011, "click": 1, "error": 2, "purchase": 3091}.items() for x in kv])
        us = F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ'2024-01-01 00:00:00', ts)")
        return self("events").select(F.col("user_id").alias("session"), us.alias("us"), F.col("event_id").alias("seq"), "event_type", "value", "props", code[F.col("event_type")].alias("code"))

    @cached_property
    def seq(self) -> DataFrame:
        by = Window.partitionBy("session").orderBy("us", "seq")
        pos = (F.row_number().over(by) - 1).cast("long")
        return self.ev.select("session", pos.alias("pos"), F.col("event_type").alias("state"), (F.col("event_type") == "purchase").alias("is_exit"), "us", "value", "code")

    @cached_property
    def tr(self) -> DataFrame:
        return self("orders").select(
            F.col("o_custkey").alias("session"), F.col("o_orderkey").alias("trial"), F.col("o_orderpriority").alias("state"), F.col("o_orderstatus").alias("outcome"), F.col("o_totalprice").alias("rt"), F.col("o_orderdate").alias("day")
        )

    @cached_property
    def sig(self) -> DataFrame:
        e = self("embeddings")
        whole = e.agg(F.floor(F.count(F.lit(1)) / 8).alias("whole"))
        x = e.select(F.floor(F.col("vec_id") / 8).alias("trial"), (F.col("vec_id") % 8).alias("channel"), F.posexplode("embedding").alias("sample", "value"))
        x = x.join(F.broadcast(whole), F.col("trial") < F.col("whole"))
        return x.select(
            (F.col("trial") % 5).alias("session"), "trial", "channel", (F.floor(F.col("channel") / 2) + 1).alias("array_id"), (F.col("trial") % 4).alias("state"), F.col("sample").cast("long").alias("sample"), ((F.col("sample") - 16) / 64).alias("t"), F.col("value").cast("double").alias("value")
        )

    @cached_property
    def sig_nan(self) -> DataFrame:
        gone = (F.col("trial") % 13 == 5) | ((F.col("channel") == 3) & (F.col("session") == 2))
        return self.sig.withColumn("value", F.when(~gone, F.col("value")))

    @cached_property
    def spk(self) -> DataFrame:
        return self("lineitem").select(F.col("l_orderkey").alias("trial"), (F.col("l_suppkey") % 32).alias("channel"), (F.col("l_quantity") / 50).alias("t"), F.col("l_linenumber").alias("unit"), F.col("l_partkey").alias("part"))
