"""Stream queries over events that lie in several files, each over the whole recording."""

import os

import pytest
from oracle import TABLES, compare
from pyspark.sql import functions as F

from tidemark.plans import catalog

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    top = tmp_path_factory.mktemp("tables")
    for name in TABLES:
        if name != "events":
            os.symlink(f"{SF}/{name}.parquet", top / f"{name}.parquet")
    events = spark.read.parquet(f"{SF}/events.parquet")
    events.repartition(4, F.col("event_id")).write.parquet(str(top / "events.parquet"))
    return str(top)


@pytest.mark.parametrize("name", ["T1_stream_ingest", "T2_stream_segment", "T2_stream_trials", "T3_stream_rate", "T3_sliding_rate", "T3_burst_rate"])
def test_parts_of_several_files(spark, folder, name):
    assert compare(spark, name, catalog.queries()[name], catalog.oracle_sql()[name], folder) == ""
