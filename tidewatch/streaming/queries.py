"""The passes over logs that are made from the tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions import abi
from ..plans.catalogue import query
from ..sources.scratch import new_folder
from ..sources.tables import read, spread, sql, swaps
from . import state
from .ledger import Ledger
from .passes import activity_pass, discovery_pass

#: Blocks of the made logs, blocks a span, microseconds a block (50 minutes a span).
BLOCKS, SPAN, TICK = 4000, 2000, 1_500_000
FACTORIES = [{"address": "0x" + "a" * 40, "kind": "v2", "dex": "alpha", "deployed": 0}, {"address": "0x" + "b" * 40, "kind": "v3", "dex": "beta", "deployed": 0}]


def _hex(x: Column) -> Column:
    return F.lower(F.when(x < 0, F.lpad(F.hex(x), 64, "F")).otherwise(F.lpad(F.hex(x), 64, "0")))


def _topic(x: Column) -> Column:
    return F.concat(F.lit("0x"), _hex(x))


def _address(x: Column) -> Column:
    return F.concat(F.lit("0x"), F.right(_hex(x), F.lit(40)))


def _number(address: str) -> Column:
    return F.conv(F.substring(address, 3, 40), 16, 10).cast("bigint").alias(address)


QUOTES = [f"0x{10_000 + i:040x}" for i in range(1, 11)]


def creation_logs(spark: SparkSession, sf: str) -> Callable[[int, int], DataFrame]:
    """A log a part; of every tenth a second one, with another token."""
    k, price = F.col("p_partkey").cast("bigint"), F.col("p_partkey") % 3 == 0
    d = spread(read(spark, sf, "part").select("p_partkey", "p_size"), "p_partkey").select(k.alias("k"), (10_000 + F.col("p_size")).cast("bigint").alias("asset"), price.alias("price"), F.explode(F.when(k % 10 == 0, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("log_index"))
    k, other = F.col("k"), F.col("k") + 20_000 + 7 * F.col("log_index")
    first = k % 5 == 0
    t0, t1 = F.when(first, other).otherwise(F.col("asset")), F.when(first, F.col("asset")).otherwise(other)
    topics = F.array(F.when(F.col("price"), abi.event_topic(abi.CREATED["v3"])).otherwise(abi.event_topic(abi.CREATED["v2"])), _topic(t0), _topic(t1))
    topics = F.when(F.col("price"), F.concat(topics, F.array(_topic(500 * (1 + k % 4))))).otherwise(topics)
    pool = k + 1_000_000
    data = F.concat(F.lit("0x"), F.when(F.col("price"), F.concat(_hex(k % 21 - 10), _hex(pool))).otherwise(F.concat(_hex(pool), _hex(k))))
    by = F.when(F.col("price"), FACTORIES[1]["address"]).otherwise(FACTORIES[0]["address"])
    logs = d.select((k % BLOCKS).alias("block"), F.col("log_index").cast("bigint"), _topic(k).alias("tx"), by.alias("address"), topics.alias("topics"), data.alias("data"))
    return lambda first, last: logs.where(F.col("block").between(first, last))


def swap_logs(spark: SparkSession, sf: str) -> Callable[[int, int, DataFrame], DataFrame]:
    """A log a line item, in the pool of its part."""
    i = read(spark, sf, "lineitem").select(
        (F.col("l_orderkey") % BLOCKS).alias("block"), (F.col("l_partkey") * 1_000_000 + F.col("l_suppkey") * 10 + F.col("l_linenumber")).cast("bigint").alias("log_index"), F.col("l_orderkey").alias("tx"), _address(F.col("l_partkey").cast("bigint") + 1_000_000).alias("pool"),
        F.col("l_suppkey").cast("bigint").alias("buyer"), F.col("l_quantity").cast("bigint").alias("x"), F.floor("l_extendedprice").cast("bigint").alias("q"), F.when(F.col("l_linenumber") % 3 != 0, 1).otherwise(-1).alias("sign"),
    )

    def logs(first: int, last: int, pools: DataFrame) -> DataFrame:
        d = i.where(F.col("block").between(first, last)).join(pools.select("pool", "kind", (F.col("quote") == F.col("token0")).alias("front")), "pool")
        quote, base = F.col("sign") * F.col("q"), -F.col("sign") * F.col("x")
        a0, a1 = F.when(F.col("front"), quote).otherwise(base), F.when(F.col("front"), base).otherwise(quote)
        in_, out_ = (lambda a: _hex(F.greatest(a, F.lit(0)))), (lambda a: _hex(F.greatest(-a, F.lit(0))))
        price = F.col("kind") == "v3"
        data = F.concat(F.lit("0x"), F.when(price, F.concat(_hex(a0), _hex(a1), *[_hex(F.lit(1).cast("bigint"))] * 3)).otherwise(F.concat(in_(a0), in_(a1), out_(a0), out_(a1))))
        event = F.when(price, abi.event_topic(abi.SWAPPED["v3"])).otherwise(abi.event_topic(abi.SWAPPED["v2"]))
        return d.select("block", "log_index", _topic(F.col("tx")).alias("tx"), F.col("pool").alias("address"), F.array(event, _topic(F.lit(7).cast("bigint")), _topic(F.col("buyer"))).alias("topics"), data.alias("data"))

    return logs


def _discovered(spark: SparkSession, sf: str) -> Ledger:
    """Two passes, the second from where the first had to stop (block 1900)."""
    ledger = Ledger(spark, new_folder(spark))
    for head in (BLOCKS // 2, BLOCKS + 100):
        discovery_pass(ledger, creation_logs(spark, sf), head, FACTORIES, QUOTES, confirmations=100, span=SPAN)
    return ledger


@query("""WITH a AS (SELECT p_partkey AS k, 10000 + p_size AS asset, 20000 + p_partkey AS other, p_partkey % 5 = 0 AS front, p_partkey % 3 = 0 AS price FROM part)
SELECT 1000000 + k AS pool, CASE WHEN price THEN 'beta' ELSE 'alpha' END AS dex, CASE WHEN price THEN 'v3' ELSE 'v2' END AS kind,
  CASE WHEN front THEN other ELSE asset END::BIGINT AS token0, CASE WHEN front THEN asset ELSE other END::BIGINT AS token1,
  CASE WHEN price THEN 500 * (1 + k % 4) END::INT AS fee, CASE WHEN price THEN k % 21 - 10 END::INT AS spacing,
  CASE WHEN least(asset, other) <= 10010 THEN asset END::BIGINT AS quote, CASE WHEN asset <= 10010 THEN other END::BIGINT AS base, k % 4000 AS block FROM a""")
def discovered_pools(spark: SparkSession, sf: str) -> DataFrame:
    p = _discovered(spark, sf).table("pools")
    return p.select(_number("pool"), "dex", "kind", _number("token0"), _number("token1"), "fee", "spacing", _number("quote"), _number("base"), "block")


@query("SELECT token::BIGINT AS token, min(block) AS block FROM (SELECT 10000 + p_size AS token, p_partkey % 4000 AS block FROM part UNION ALL SELECT 20000 + p_partkey, p_partkey % 4000 FROM part) GROUP BY 1")
def discovered_tokens(spark: SparkSession, sf: str) -> DataFrame:
    """With the block of the first span that has them, the least in it."""
    t = _discovered(spark, sf).table("tokens")
    return t.select(_number("token"), "block")


_EVENTS = """WITH p AS (SELECT p_partkey AS k, p_partkey % 4000 AS block FROM part WHERE p_size <= 10),
m AS (SELECT min(block) - 1 AS start FROM p), i AS (SELECT unnest([0, 1, 2]) AS i),
s AS (SELECT start + 2000 * i AS low, least(start + 2000 * (i + 1), 1900) AS upto FROM m, i WHERE start + 2000 * i < 1900 UNION ALL SELECT 1900 + 2000 * i, least(1900 + 2000 * (i + 1), 4000) FROM i WHERE 1900 + 2000 * i < 4000),
e AS (SELECT l_partkey AS pool, l_suppkey AS buyer, CASE WHEN l_linenumber % 3 <> 0 THEN 'BUY' ELSE 'SELL' END AS side, floor(l_extendedprice)::HUGEINT AS amount, upto, upto * 1500000 AS t
      FROM lineitem JOIN p ON k = l_partkey JOIN s ON l_orderkey % 4000 > low AND l_orderkey % 4000 <= upto WHERE block <= upto)"""


@query(_EVENTS + """,
w AS (SELECT a.pool, a.upto, a.t, e.buyer, e.side, e.amount, e.t >= a.t - 1200000000 AS recent FROM (SELECT DISTINCT pool, upto, t FROM e) a JOIN e ON e.pool = a.pool AND e.t BETWEEN a.t - 3600000000 AND a.t),
c AS (SELECT pool, upto, max(t) AS t, count(DISTINCT CASE WHEN side = 'BUY' AND recent THEN buyer END) AS buyers_20m, count(DISTINCT CASE WHEN side = 'BUY' THEN buyer END) AS buyers_1h,
   count(*) FILTER (side = 'BUY' AND recent) AS buys_20m, count(*) FILTER (side = 'SELL' AND recent) AS sells_20m,
   coalesce(sum(amount) FILTER (side = 'BUY' AND recent), 0)::BIGINT AS buy_volume_20m, coalesce(sum(amount) FILTER (side = 'BUY'), 0)::BIGINT AS buy_volume_1h,
   coalesce(sum(amount) FILTER (side = 'SELL' AND recent), 0)::BIGINT AS sell_volume_20m, coalesce(sum(amount) FILTER (side = 'SELL'), 0)::BIGINT AS sell_volume_1h FROM w GROUP BY 1, 2),
x AS (SELECT pool, upto, buyer, sum(amount)::HUGEINT AS x FROM w WHERE side = 'BUY' GROUP BY 1, 2, 3),
r AS (SELECT *, row_number() OVER (PARTITION BY pool, upto ORDER BY x, buyer) AS i, sum(x) OVER (PARTITION BY pool, upto)::DOUBLE AS s FROM x),
g AS (SELECT pool, upto, count(*) AS n, sum(x)::HUGEINT AS s, sum(i * x)::HUGEINT AS ix, -sum(greatest(x / s, 1e-12) * ln(greatest(x / s, 1e-12))) AS h FROM r GROUP BY 1, 2),
z AS (SELECT pool, upto, floor(sum(CASE WHEN n >= 2 THEN n ELSE 0 END) * 10000 / sum(n) + 0.5)::BIGINT AS repeated_bps FROM (SELECT pool, upto, amount, count(*) AS n FROM w WHERE side = 'BUY' GROUP BY 1, 2, 3) GROUP BY 1, 2)
SELECT c.pool + 1000000 AS pool, c.upto AS block, t, buyers_20m, buyers_1h, buys_20m, sells_20m, buy_volume_20m, buy_volume_1h, sell_volume_20m, sell_volume_1h,
  CASE WHEN n >= 2 AND s > 0 THEN ((20000 * (2 * ix - (n + 1) * s) + n * s) // (2 * n * s))::BIGINT END AS gini_bps,
  CASE WHEN n >= 2 AND s > 0 THEN least(10000, greatest(0, floor(h / ln(n) * 10000 + 0.5)))::BIGINT END AS entropy_bps, repeated_bps
FROM c LEFT JOIN g USING (pool, upto) LEFT JOIN z USING (pool, upto)""")
def activity_windows(spark: SparkSession, sf: str) -> DataFrame:
    """Snapshots of the pools that each span touches, after two passes; the first
    ends at block 1900, in the middle of a span."""
    ledger = _discovered(spark, sf)
    for head in (BLOCKS // 2, BLOCKS + 100):
        activity_pass(ledger, swap_logs(spark, sf), head, lambda block: block * TICK, confirmations=100, span=SPAN)
    s = ledger.table("snapshots")
    return s.select(_number("pool"), "block", "t", "buyers_20m", "buyers_1h", "buys_20m", "sells_20m", *[F.col(f"{side}_volume_{w}").cast("bigint").alias(f"{side}_volume_{w}") for side in ("buy", "sell") for w in ("20m", "1h")], "gini_bps", "entropy_bps", "repeated_bps")


# ---- state by key


def _emitted(stream: DataFrame, mode: str, base: str) -> DataFrame:
    """All that a stream emits, with the number of its batch."""

    def keep(rows: DataFrame, batch: int) -> None:
        rows.withColumn("batch", F.lit(batch)).write.mode("overwrite").parquet(f"{base}/out/at={batch}")

    stream.writeStream.outputMode(mode).foreachBatch(keep).option("checkpointLocation", f"{base}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return stream.sparkSession.read.schema(f"{', '.join(f'{f.name} {f.dataType.simpleString()}' for f in stream.schema)}, batch int").parquet(f"{base}/out").drop("at")


def _in_order(df: DataFrame, by: str, slices: int, path: str, files: int = 16, least: int = 100_000) -> int:
    """Writes df in slices whose order is that of a column of times, and returns
    of how many files each is: one, or `files` if all slices have `least` rows."""
    low, high = df.agg(F.min(F.unix_micros(by)), F.max(F.unix_micros(by))).first()
    at = lambda i: low + (high - low) * i // slices
    inside = [(F.unix_micros(by) >= at(k)) & (F.unix_micros(by) < at(k + 1) + (k + 1 == slices)) for k in range(slices)]
    n = files if min(df.agg(*[F.count_if(x) for x in inside]).first()) >= least else 1
    for x in inside:
        part = df.where(x)
        (part.repartition(n) if n > 1 else part.coalesce(1)).write.mode("append").parquet(path)
    return n


_DAY_OF_ORDERS = "timestamp_micros(timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', o_orderdate))"


@query("WITH m AS (SELECT o_orderkey AS id, o_custkey % 5 AS token, o_custkey AS src, o_orderkey % 300 AS dst, floor(o_totalprice)::BIGINT AS value FROM orders), n AS (SELECT token, src AS holder, -value AS v FROM m UNION ALL SELECT token, dst, value FROM m) SELECT token, holder, sum(v)::BIGINT AS balance FROM n GROUP BY 1, 2")
def holders_by_state(spark: SparkSession, sf: str) -> DataFrame:
    """Orders as transfers, some of them delivered twice: the last balance that
    was emitted for every holder."""
    state.keyed_state(spark)
    base, o = new_folder(spark, "holders"), read(spark, sf, "orders")
    t = o.select(F.col("o_orderkey").cast("bigint").alias("id"), F.expr(_DAY_OF_ORDERS).alias("ts"), (F.col("o_custkey") % 5).cast("bigint").alias("token"), F.col("o_custkey").cast("bigint").alias("src"), (F.col("o_orderkey") % 300).cast("bigint").alias("dst"), F.floor("o_totalprice").cast("bigint").alias("value"))
    n = _in_order(t.unionByName(t.where("id % 7 = 0")), "ts", 3, f"{base}/in")
    stream = state.holder_balances(spark.readStream.schema(t.schema).option("maxFilesPerTrigger", n).parquet(f"{base}/in"), "1 day")
    return _emitted(stream, "update", base).groupBy("token", "holder").agg(F.max_by("balance", "batch").alias("balance"))


WIDTH, EVERY = 6 * 3600, 3 * 3600


@query(sql("swaps", f""", e AS (SELECT * FROM swaps WHERE side <> 'UNKNOWN' AND pool IS NOT NULL), p AS (SELECT (max(t) // 1000 - 86400000) * 1000 AS passed FROM e),
g AS (SELECT DISTINCT pool, unnest(range((t + {EVERY * 1_000_000} - 1) // ({EVERY * 1_000_000}), (t + {WIDTH * 1_000_000}) // ({EVERY * 1_000_000}) + 2)) * {EVERY * 1_000_000} AS t FROM e)
SELECT g.pool, g.t, count(DISTINCT CASE WHEN side = 'BUY' THEN buyer END) AS buyers, count(*) FILTER (side = 'BUY') AS buys, count(*) FILTER (side = 'SELL') AS sells, coalesce(sum(amount) FILTER (side = 'BUY'), 0)::BIGINT AS buy_volume, coalesce(sum(amount) FILTER (side = 'SELL'), 0)::BIGINT AS sell_volume
FROM g JOIN p ON g.t <= passed LEFT JOIN e ON e.pool = g.pool AND e.t BETWEEN g.t - {WIDTH * 1_000_000} AND g.t GROUP BY g.pool, g.t"""))
def decaying_activity(spark: SparkSession, sf: str) -> DataFrame:
    """Windows of six hours, every three hours, of pools that trade now and then:
    rows go on until a window is empty, without events that would call for them."""
    state.keyed_state(spark)
    base = new_folder(spark, "windows")
    s = swaps(spark, sf).where("pool IS NOT NULL").select(F.timestamp_micros("t").alias("ts"), "pool", "buyer", "side", "amount")
    n = _in_order(s, "ts", 3, f"{base}/in")
    stream = state.decaying_windows(spark.readStream.schema(s.schema).option("maxFilesPerTrigger", n).parquet(f"{base}/in"), "1 day", WIDTH, EVERY)
    return _emitted(stream, "append", base).select("pool", F.unix_micros("t").alias("t"), "buyers", "buys", "sells", "buy_volume", "sell_volume")
