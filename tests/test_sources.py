"""The log source. What is stored of it: test_ledger.py."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from tidewatch.sources.logs import BlockLogs


def source(spark, fetch="fetch", **options):
    spark.dataSource.register(BlockLogs)
    return {"fetch": f"tests.fake_logs:{fetch}", "head": "tests.fake_logs:head", "chunk": "20", **options}


def test_batch(spark):
    d = spark.read.format("block_logs").options(**source(spark, start="5", end="49")).load()
    assert d.rdd.getNumPartitions() == 3
    rows = d.collect()
    assert [(r["block"], r["log_index"]) for r in rows] == [(b, i) for b in range(5, 50) for i in (0, 1)]


def test_one_block_too_large(spark):
    with pytest.raises(Exception, match="TooLarge"):
        spark.read.format("block_logs").options(**source(spark, "none_fit", end="3")).load().collect()


def test_stream(spark, tmp_path):
    d = spark.readStream.format("block_logs").options(**source(spark)).load()
    d.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start().awaitTermination()
    got = spark.read.parquet(f"{tmp_path}/out")
    assert got.count() == 100 and got.agg(F.max("block")).first()[0] == 49
