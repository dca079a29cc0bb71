"""Micro-batch ingestion: deduplicated append, touched-key snapshots and the cursor in one commit."""

from __future__ import annotations

import hashlib
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators import series
from ..plans.catalogue import query
from ..sources.scratch import new_folder
from ..sources.tables import micros, read, sql
from .ledger import Ledger

SCHEMA = "event_id LONG, ts TIMESTAMP_NTZ, user_id LONG, event_type STRING, value DOUBLE, props STRING"


def run_of(checkpoint: str) -> str:
    """Tells the runs of a query from different checkpoints apart."""
    return "r" + hashlib.sha256(checkpoint.encode()).hexdigest()[:12]


def ingest_events(stream: DataFrame, out: str, checkpoint: str):
    """Starts a query that runs over what is there and stops: events appended
    once by event_id, counts of the touched pools, the cursor. All of a batch is
    committed at once (see ledger), so one that was cut off, or that a restart
    from an old or a fresh checkpoint brings again, changes nothing twice."""
    ledger, run = Ledger(stream.sparkSession, out), run_of(checkpoint)

    def commit(rows: DataFrame, batch_id: int) -> None:
        batch = ledger.begin(run, batch_id)
        if batch is None:
            return
        new = batch.append_once("events", rows, ["event_id"], ["event_id"], ["ts"])
        pools = new.select((F.get_json_object("props", "$.k").try_cast("bigint") % 20).alias("pool"), micros("ts").alias("t"), "event_type")
        touched = pools.groupBy("pool").agg(F.max("t").alias("t"), F.count("*").alias("events"), F.count_if(F.col("event_type") == "purchase").alias("buys"))
        batch.append("activity", touched)
        top = new.agg(F.max("event_id")).first()[0]
        if top is not None:
            batch.advance("events", processed=top)
        batch.commit()

    return stream.writeStream.foreachBatch(commit).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def net(deltas: DataFrame) -> DataFrame:
    return deltas.groupBy("token", "holder").agg(F.sum("delta").alias("delta"))


def transfers_ledger(spark: SparkSession, out: str) -> Ledger:
    return Ledger(spark, out, folds={"deltas": net})


def net_balances(stream: DataFrame, out: str, checkpoint: str):
    """Nets transfers (id, token, src, dst, value) batch by batch. Each batch
    stores, with its new transfers, the deltas of the holders that they touch; a
    balance is their sum, and merged deltas are summed. Transfers that were seen
    before change nothing."""
    ledger, run = transfers_ledger(stream.sparkSession, out), run_of(checkpoint)

    def commit(rows: DataFrame, batch_id: int) -> None:
        batch = ledger.begin(run, batch_id)
        if batch is None:
            return
        new = batch.append_once("transfers", rows, ["id"])
        side = lambda who, sign: F.struct(F.col(who).alias("holder"), (sign * F.col("value")).alias("delta"))
        moves = new.select("token", F.inline(F.array(side("src", -1), side("dst", 1))))
        batch.append("deltas", net(moves))
        batch.commit()

    return stream.writeStream.foreachBatch(commit).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def balances(spark: SparkSession, out: str) -> DataFrame:
    """(token, holder, balance), also of holders that sold everything."""
    return net(transfers_ledger(spark, out).table("deltas")).withColumnRenamed("delta", "balance")


def refresh_due(active: DataFrame, last: DataFrame, age: int) -> DataFrame:
    """Keys of `active` whose latest row in `last` (pool, t) is older than `age`
    against the newest of all, or missing: windows decay without events."""
    newest = last.agg(F.max("t").alias("now"))
    fresh = last.groupBy("pool").agg(F.max("t").alias("t")).join(F.broadcast(newest), F.col("t") > F.col("now") - age)
    return active.join(fresh, "pool", "left_anti")


@query(sql("snapshots", f"SELECT p_partkey AS pool FROM part WHERE p_partkey NOT IN (SELECT pool FROM snapshots GROUP BY pool HAVING max(t) > (SELECT max(t) FROM snapshots) - {3 * series.DAY})"))
def refresh_lane(spark: SparkSession, sf: str) -> DataFrame:
    o = read(spark, sf, "orders").select((F.col("o_custkey") % 97).alias("pool"), micros("o_orderdate").alias("t"))
    return refresh_due(read(spark, sf, "part").select(F.col("p_partkey").alias("pool")), o, 3 * series.DAY)


@query()
def stream_replay_equivalence(spark: SparkSession, sf: str) -> DataFrame:
    """Ingests the events as a stream twice, the second time from a fresh
    checkpoint and in other batches, and counts events and keys by type."""
    base = new_folder(spark)
    read(spark, sf, "events").repartition(5).write.parquet(f"{base}/in")
    for k, files in enumerate((2, 3)):
        ingest_events(spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", files).parquet(f"{base}/in"), f"{base}/out", f"{base}/checkpoint{k}").awaitTermination()
    got = Ledger(spark, f"{base}/out").table("events").groupBy("event_type").agg(F.count("*").alias("rows"), F.count_distinct("event_id").alias("keys"))
    want = read(spark, sf, "events").groupBy("event_type").agg(F.count("*").alias("expected"))
    return reduce(lambda a, b: a.join(b, "event_type", "full"), [got, want])


@query("WITH m AS (SELECT o_orderkey AS id, o_custkey % 5 AS token, o_custkey AS src, o_orderkey % 300 AS dst, floor(o_totalprice)::BIGINT AS value FROM orders), n AS (SELECT token, src AS holder, -value AS v FROM m UNION ALL SELECT token, dst, value FROM m) SELECT token, holder, sum(v)::BIGINT AS balance FROM n GROUP BY 1, 2")
def stream_balances(spark: SparkSession, sf: str) -> DataFrame:
    base = new_folder(spark)
    o = read(spark, sf, "orders")
    t = o.select(F.col("o_orderkey").alias("id"), (F.col("o_custkey") % 5).alias("token"), F.col("o_custkey").alias("src"), (F.col("o_orderkey") % 300).alias("dst"), F.floor("o_totalprice").cast("bigint").alias("value"))
    t.repartition(4).write.parquet(f"{base}/in")
    for k in range(2):
        net_balances(spark.readStream.schema(t.schema).option("maxFilesPerTrigger", 2 + k).parquet(f"{base}/in"), f"{base}/out", f"{base}/checkpoint{k}").awaitTermination()
    return balances(spark, f"{base}/out")
