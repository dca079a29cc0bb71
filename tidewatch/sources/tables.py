"""Reads tables and gives them their roles: swaps, snapshots, scores, labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """df in as many tasks as a shuffle has: a table of a few million narrow rows
    may be one row group, which is one task, whatever is done to its rows."""
    spark = df.sparkSession
    return df.repartition(max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions"))), *keys)


def micros(ts: str) -> Column:
    """Microseconds since 1970 of a timestamp without zone, whatever the session's."""
    return F.expr(f"timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', {ts})")


def swaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, pool, buyer, t, side, amount): one row per event."""
    e = read(spark, sf_dir, "events")
    side = F.when(F.col("event_type") == "purchase", "BUY").when(F.col("event_type") == "click", "SELL").otherwise("UNKNOWN")
    pool = F.try_element_at(F.array(F.get_json_object("props", "$.k")), F.lit(1)).try_cast("bigint") % 20
    return e.select(F.col("event_id").alias("id"), pool.alias("pool"), F.col("user_id").alias("buyer"), micros("ts").alias("t"), side.alias("side"), F.floor(F.col("value") * 100 + 0.5).cast("bigint").alias("amount"))


def snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, pool, t, fdv, liq): liq is null where it could not be computed."""
    o = read(spark, sf_dir, "orders")
    liq = F.when(F.col("o_orderstatus") != "P", F.col("o_totalprice") * 0.4)
    return o.select(F.col("o_orderkey").alias("id"), (F.col("o_custkey") % 97).alias("pool"), micros("o_orderdate").alias("t"), F.col("o_totalprice").alias("fdv"), liq.alias("liq"))


def scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, token, t, score)"""
    e = read(spark, sf_dir, "events")
    return e.select(F.col("event_id").alias("id"), F.col("user_id").alias("token"), micros("ts").alias("t"), (F.floor("value") % 101).cast("bigint").alias("score"))


def alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, token, t, level, score): views and purchases as alerts."""
    e = read(spark, sf_dir, "events")
    level = F.when(F.col("event_type") == "purchase", "GREEN").when(F.col("event_type") == "view", "YELLOW").when(F.col("event_type") == "click", "RED").otherwise("GRAY")
    return e.select(F.col("event_id").alias("id"), F.col("user_id").alias("token"), micros("ts").alias("t"), level.alias("level"), (F.floor("value") % 101).cast("bigint").alias("score"))


def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, token, t, horizon, mult, dd, status): realized labels from orders;
    mult and dd in basis points."""
    o = read(spark, sf_dir, "orders")
    return o.select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("token"), micros("o_orderdate").alias("t"), F.col("o_orderpriority").alias("horizon"), F.floor(F.col("o_totalprice") / 4).cast("bigint").alias("mult"), (F.floor("o_totalprice") % 10000).cast("bigint").alias("dd"), F.col("o_orderstatus").alias("status"))


#: The same roles for DuckDB.
ROLES = {
    "swaps": "swaps AS (SELECT event_id AS id, TRY_CAST(props->>'$.k' AS BIGINT) % 20 AS pool, user_id AS buyer, epoch_us(ts) AS t, CASE event_type WHEN 'purchase' THEN 'BUY' WHEN 'click' THEN 'SELL' ELSE 'UNKNOWN' END AS side, floor(value * 100 + 0.5)::BIGINT AS amount FROM events)",
    "snapshots": "snapshots AS (SELECT o_orderkey AS id, o_custkey % 97 AS pool, epoch_us(o_orderdate) AS t, o_totalprice AS fdv, CASE WHEN o_orderstatus <> 'P' THEN o_totalprice * 0.4::DOUBLE END AS liq FROM orders)",
    "scores": "scores AS (SELECT event_id AS id, user_id AS token, epoch_us(ts) AS t, floor(value)::BIGINT % 101 AS score FROM events)",
    "alerts": "alerts AS (SELECT event_id AS id, user_id AS token, epoch_us(ts) AS t, CASE event_type WHEN 'purchase' THEN 'GREEN' WHEN 'view' THEN 'YELLOW' WHEN 'click' THEN 'RED' ELSE 'GRAY' END AS level, floor(value)::BIGINT % 101 AS score FROM events)",
    "labels_": "labels_ AS (SELECT o_orderkey AS id, o_custkey AS token, epoch_us(o_orderdate) AS t, o_orderpriority AS horizon, floor(o_totalprice / 4)::BIGINT AS mult, floor(o_totalprice)::BIGINT % 10000 AS dd, o_orderstatus AS status FROM orders)",
}


def sql(roles: str, body: str) -> str:
    """A statement with the named roles as common table expressions; a body that
    begins with a comma adds its own."""
    return "WITH " + ", ".join(ROLES[r] for r in roles.split()) + " " + body
