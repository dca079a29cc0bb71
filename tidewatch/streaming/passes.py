"""Discovery and activity passes: from logs to pools, swaps and rolling windows.

A pass goes from its cursor to the safe head in spans of blocks. What a span
adds to any table and the cursor's move are one batch of the ledger, so a pass
that is cut off anywhere goes on at the block after its last whole span.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions import abi, wide
from ..operators import series
from ..sources.logs import FULL, BlockLogs
from .ledger import Ledger

MINUTE = 60_000_000
SHORT, LONG = 20 * MINUTE, 60 * MINUTE
#: Amounts of more digits have no Gini index and entropy: their products leave Spark's decimals.
DIGITS = 28


@dataclass
class Done:
    """What a pass did; `first` is None where there was nothing to scan."""

    first: int | None = None
    last: int | None = None
    spans: int = 0
    logs: int = 0
    inserted: int = 0
    snapshots: int = 0
    refreshed: int = 0


def block_logs(spark: SparkSession, fetch: str, chunk: int = 2000) -> Callable[[int, int], DataFrame]:
    """Logs of a range of blocks from the log source, `chunk` blocks a task."""
    spark.dataSource.register(BlockLogs)
    return lambda first, last: spark.read.format("block_logs").options(fetch=fetch, columns=FULL, start=first, end=last, chunk=chunk).load()


def quote_side(token0: Column, token1: Column, quotes: list[str]) -> Column:
    """(quote, base): the first trusted asset that is one of the tokens, and the
    other token; null if neither is trusted."""
    sides = [F.when(token0 == q, F.struct(token0.alias("quote"), token1.alias("base"))).when(token1 == q, F.struct(token1.alias("quote"), token0.alias("base"))) for q in quotes]
    return F.coalesce(*sides, F.lit(None).cast("struct<quote:string,base:string>"))


def created_pools(logs: DataFrame, factories: list[dict], quotes: list[str]) -> DataFrame:
    """One row a log: the pool it creates. factories: address, kind (v2 or v3),
    dex. A log of another address, or that can't be decoded, fails the job."""
    known = F.create_map(*[x for f in factories for x in (F.lit(f["address"].lower()), F.struct(F.lit(f["kind"]).alias("kind"), F.lit(f["dex"]).alias("dex")))])
    d = logs.withColumn("factory", F.lower("address")).withColumn("of", F.try_element_at(known, F.col("factory")))
    kind = F.when(F.col("of").isNull(), abi.refuse("log from unwatched address ", F.col("address")).cast("string")).otherwise(F.col("of.kind"))
    d = d.withColumn("kind", kind).withColumn("made", abi.created_pool(F.col("kind"), F.col("topics"), F.col("data")))
    side = quote_side(F.col("made.token0"), F.col("made.token1"), [q.lower() for q in quotes])
    return d.select("made.pool", "factory", "of.dex", "kind", "made.token0", "made.token1", "made.fee", "made.spacing", side["quote"].alias("quote"), side["base"].alias("base"), "block", "tx", "log_index")


def discovery_pass(ledger: Ledger, logs: Callable[[int, int], DataFrame], head: int, factories: list[dict], quotes: list[str], confirmations: int = 0, span: int = 2000) -> Done:
    """Pools and tokens of the blocks from the cursor to `head` less
    `confirmations`. Before the first pass, all blocks before the first factory
    (`deployed`) count as processed. A pool's first log counts, a token's first
    block."""
    done = Done()
    if span < 1:
        raise ValueError("span must be 1 or more")
    if not factories:
        return done
    batch = ledger.begin()
    before = batch.state["cursors"].get("discovery")
    batch.advance("discovery", observed=head, **({} if before else {"processed": min(f["deployed"] for f in factories) - 1}))
    at = batch.state["cursors"]["discovery"]["processed"] + 1
    target = head - confirmations
    if at > target:
        batch.commit()
        return done
    done.first = at
    while at <= target:
        to = min(at + span - 1, target)
        made = created_pools(logs(at, to), factories, quotes).persist()
        done.logs += made.count()
        # logs delivered twice: the first of a pool counts, for its tokens too
        first = F.min_by(F.struct(*made.columns), F.struct("block", "log_index", *made.columns))
        pools = made.groupBy(F.col("pool").alias("of")).agg(first.alias("made")).select("made.*").persist()
        done.inserted += batch.append_once("pools", pools, ["pool"], first=["block", "log_index"]).count()
        tokens = pools.select(F.explode(F.array("token0", "token1")).alias("token"), "block")
        batch.append_once("tokens", tokens, ["token"], first=["block"])
        batch.advance("discovery", processed=to)
        batch.commit()
        made.unpersist()
        pools.unpersist()
        done.spans += 1
        done.last = to
        at, batch = to + 1, ledger.begin()
        batch.advance("discovery", observed=head)
    return done


def normalized_swaps(logs: DataFrame, pools: DataFrame, seen: int) -> DataFrame:
    """One row a log of a pool with a trusted quote side: its amounts in base and
    quote, and its side: BUY where base leaves the pool and quote enters, SELL the
    other way round. `seen`: when, in microseconds. A log of a pool that isn't
    among `pools` (pool, kind, token0, quote, base) fails the job."""
    p = pools.select("pool", "kind", "token0", "quote", "base")
    d = logs.withColumn("pool", F.lower("address")).join(p, "pool", "left")
    kind = F.when(F.col("kind").isNull(), abi.refuse("log from unwatched pool ", F.col("address")).cast("string")).otherwise(F.col("kind"))
    d = d.withColumn("kind", kind).withColumn("s", abi.swap(F.col("kind"), F.col("topics"), F.col("data"))).where("quote IS NOT NULL AND base IS NOT NULL")
    amount = lambda token: F.when(F.col(token) == F.col("token0"), F.col("s.amount0")).otherwise(F.col("s.amount1"))
    d = d.withColumn("dbase", amount("base")).withColumn("dquote", amount("quote"))
    out_, in_ = (lambda c: F.col(c).startswith("-")), (lambda c: ~F.col(c).startswith("-") & (F.col(c) != "0"))
    side = F.when(out_("dbase") & in_("dquote"), "BUY").when(in_("dbase") & out_("dquote"), "SELL").otherwise("UNKNOWN")
    plain = lambda c: F.ltrim(F.col(c), F.lit("-"))
    return d.select("pool", "kind", "block", "tx", "log_index", "s.sender", "s.recipient", "s.amount0", "s.amount1", plain("dbase").alias("base_amount"), plain("dquote").alias("quote_amount"), side.alias("side"), "quote", "base", F.lit(seen).cast("bigint").alias("t"))


def activity_snapshots(events: DataFrame, pools: DataFrame, captured: int, block: int) -> DataFrame:
    """One row a pool of `pools` (pool): what its swaps (pool, t, side, recipient,
    quote_amount as text) of the last 20 minutes and the last hour come to, both
    ends inside, and how its buyers' sizes of that hour are spread. A pool without
    swaps gets zeros, and null shapes."""
    e = events.join(pools.select("pool"), "pool", "left_semi").where(F.col("t").between(captured - LONG, captured))
    e = e.select("pool", F.lower("recipient").alias("buyer"), "side", F.col("quote_amount").alias("amount"), (F.col("t") >= captured - SHORT).alias("recent"))
    buy, sell, recent = F.col("side") == "BUY", F.col("side") == "SELL", F.col("recent")
    counts = e.groupBy("pool").agg(
        F.count_distinct(F.when(buy & recent, F.col("buyer"))).alias("buyers_20m"),
        F.count_distinct(F.when(buy, F.col("buyer"))).alias("buyers_1h"),
        F.count_if(buy & recent).alias("buys_20m"),
        F.count_if(sell & recent).alias("sells_20m"),
    )
    sums = wide.limb_sums(e.where("side <> 'UNKNOWN'"), ["pool", "side", "recent"], "amount")
    part = lambda side, r: F.max(F.when((F.col("side") == side) & (F.col("recent") == r), F.col("total")))
    sums = sums.groupBy("pool").agg(*[part(side, r).alias(f"{side}{int(r)}") for side in ("BUY", "SELL") for r in (False, True)])
    b = e.where(buy)
    narrow = b.groupBy("pool").agg(F.max(F.length("amount")).alias("w")).where(F.col("w") <= DIGITS)
    few = b.join(narrow, "pool", "left_semi").withColumn("amount", F.col("amount").cast("decimal(28,0)"))
    d = pools.select("pool").distinct().join(counts, "pool", "left").join(sums, "pool", "left")
    for shape in (series.gini_bps(few), series.entropy_bps(few.withColumn("amount", F.col("amount").cast("double"))), series.repeated_size_bps(b)):
        d = d.join(shape, "pool", "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).alias(c)
    text = lambda c: F.coalesce(F.col(c), F.lit("0"))
    volume = lambda side: [text(f"{side}1").alias(f"{side.lower()}_volume_20m"), wide.sum_of(text(f"{side}0"), text(f"{side}1")).alias(f"{side.lower()}_volume_1h")]
    return d.select(
        "pool", F.lit(block).cast("bigint").alias("block"), F.lit(captured).cast("bigint").alias("t"),
        zero("buyers_20m"), zero("buyers_1h"), zero("buys_20m"), zero("sells_20m"), *volume("BUY"), *volume("SELL"), "gini_bps", "entropy_bps", "repeated_bps",
    )


def refresh_pools(pools: DataFrame, snapshots: DataFrame | None, before: int, limit: int) -> DataFrame:
    """The `limit` pools of the oldest newest snapshot, those without one first,
    of all whose newest is older than `before`; of equals the least."""
    last = pools.select("pool").withColumn("last", F.lit(None).cast("bigint"))
    if snapshots is not None:
        last = pools.select("pool").join(snapshots.groupBy("pool").agg(F.max("t").alias("last")), "pool", "left")
    return last.where(F.col("last").isNull() | (F.col("last") < before)).orderBy(F.col("last").asc_nulls_first(), "pool").limit(limit).select("pool")


def activity_pass(
    ledger: Ledger, logs: Callable[[int, int, DataFrame], DataFrame], head: int, clock: Callable[[int], int], active: Callable[[DataFrame], DataFrame] | None = None,
    confirmations: int = 0, span: int = 2000, refresh_after: int = 10 * MINUTE, refresh_limit: int = 500,
) -> Done:
    """Swaps of the pools that discovery has stored, and snapshots of the pools
    that a span touches, up to `head` less `confirmations` and never beyond
    discovery's cursor. `logs` gets a range of blocks and the pools to ask for;
    `clock` the time, in microseconds, at which a span's last block is seen;
    `active` takes a part of the pools. With it, pools whose newest snapshot is
    older than `refresh_after` get another in the end, without events too:
    windows decay. Swaps that are stored already change nothing."""
    done = Done()
    if span < 1:
        raise ValueError("span must be 1 or more")
    batch = ledger.begin()
    discovered = batch.state["cursors"].get("discovery")
    if discovered is None:
        return done
    target = min(max(head - confirmations, 0), discovered["processed"])

    def watched(to: int) -> DataFrame:
        stored = ledger.table("pools")
        if stored is None:
            return ledger.spark.createDataFrame([], "pool string, kind string, token0 string, quote string, base string, block long")
        pools = stored.where((F.col("block") <= to) & F.col("quote").isNotNull())
        return active(pools) if active else pools

    if "activity" not in batch.state["cursors"]:
        first = watched(target).agg(F.min("block")).first()[0]
        batch.advance("activity", processed=target if first is None else first - 1)
    batch.advance("activity", observed=head)
    at = batch.state["cursors"]["activity"]["processed"] + 1
    if at > target:
        batch.commit()
        done.refreshed = _refresh(ledger, watched, target, clock, refresh_after, refresh_limit) if active else 0
        return done
    done.first = at
    while at <= target:
        to = min(at + span - 1, target)
        pools, captured = watched(to), clock(to)
        swaps = normalized_swaps(logs(at, to, pools), pools, captured).persist()
        done.logs += swaps.count()
        done.inserted += batch.append_once("swaps", swaps, ["tx", "log_index"], ["block", "t"]).count()
        touched = swaps.select("pool").distinct()
        events = batch.table("swaps", since=("t", captured - LONG))
        made = batch.append("snapshots", activity_snapshots(events, touched, captured, to), order=["t"])
        done.snapshots += made.count()
        batch.advance("activity", processed=to)
        batch.commit()
        swaps.unpersist()
        done.spans += 1
        done.last = to
        at, batch = to + 1, ledger.begin()
        batch.advance("activity", observed=head)
    if active:
        done.refreshed = _refresh(ledger, watched, target, clock, refresh_after, refresh_limit)
    return done


def _refresh(ledger: Ledger, watched: Callable[[int], DataFrame], to: int, clock: Callable[[int], int], after: int, limit: int) -> int:
    """Snapshots of active pools that have aged; no cursor moves."""
    batch, now = ledger.begin(), clock(to)
    due = refresh_pools(watched(to), batch.table("snapshots"), now - after, limit)
    events = batch.table("swaps", since=("t", now - LONG))
    if events is None:
        return 0
    made = batch.append("snapshots", activity_snapshots(events, due, now, to), order=["t"])
    n = made.count()
    if n:
        batch.commit()
    return n
