"""Holders, anchors along chains of pools, and round trips through reserves."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

c = F.col


def share_bps(part: Column, whole: Column) -> Column:
    """part * 10^4 / whole, rounded down; 0 for no whole."""
    x, y = part.cast("decimal(28,0)") * 10_000, whole.cast("decimal(28,0)")
    return F.when(y > 0, F.call_function("div", x, y)).otherwise(0)


def top_sums(df: DataFrame, key: str, value: str, flags: dict[str, Column], most: int, salts: int = 64) -> DataFrame:
    """(key, and a column a flag): the sum of the `most` largest values of the
    rows that have the flag. Each of `salts` parts of a key finds its own largest
    first, so that a key with a third of all rows is no task's work alone."""
    rows = df.select(key, value, F.inline(F.array_compact(F.array(*[F.when(when, F.struct(F.lit(name).alias("flag"))) for name, when in flags.items()]))))
    part = rows.withColumn("salt", F.pmod(F.spark_partition_id(), F.lit(salts)))
    few = Window.partitionBy(key, "flag", "salt").orderBy(c(value).desc())
    part = part.withColumn("r", F.row_number().over(few)).where(c("r") <= most)
    all_ = Window.partitionBy(key, "flag").orderBy(c(value).desc())
    top = part.withColumn("r", F.row_number().over(all_)).where(c("r") <= most)
    return top.groupBy(key).agg(*[F.sum(F.when(c("flag") == name, c(value))).alias(name) for name in flags])


def holder_report(balances: DataFrame, excluded: DataFrame, tokens: DataFrame, most: int = 10) -> DataFrame:
    """One row a token of `tokens` (token, deployer, total_supply): holders, and
    shares in basis points of (token, holder, balance).

    excluded (token, holder, reason): what isn't economic, the pool with reason
    `pool`. Largest and top shares are of all balances (of total_supply where
    there are none), adjusted ones of those not excluded. deployer_bps is null
    without a deployer, or if it is excluded. float_bps, what neither excluded
    holders nor the deployer have, and pool_bps are of total_supply, held between
    0 and 10^4, null without one. A holder excluded twice counts by its first
    reason, `pool` last.
    """
    x = excluded.groupBy("token", "holder").agg(F.min(F.struct((c("reason") == "pool").alias("last"), "reason"))["reason"].alias("reason"), F.max((c("reason") == "pool").cast("int")).alias("pool"))
    b = balances.join(x, ["token", "holder"], "left").join(tokens.select("token", c("deployer").alias("holder"), F.lit(True).alias("deploys")), ["token", "holder"], "left")
    own = c("reason").isNull()
    total = lambda when: F.coalesce(F.sum(F.when(when, c("balance"))), F.lit(0))
    g = b.groupBy("token").agg(
        F.count("*").alias("holders"), F.count_if(own).alias("adjusted_holders"), F.sum("balance").alias("all"), total(own).alias("own"), F.max("balance").alias("largest"),
        total(own & c("deploys")).alias("deployed"), total(c("pool") == 1).alias("pooled"),
    )
    g = g.join(top_sums(b.select("token", "balance", own.alias("own__")), "token", "balance", {"top": F.lit(True), "own_top": c("own__")}, most), "token", "left")
    gone = tokens.join(x.select("token", c("holder").alias("deployer"), F.lit(True).alias("excluded__")), ["token", "deployer"], "left")
    t = gone.join(g, "token", "left").fillna(0, ["holders", "adjusted_holders", "all", "own", "largest", "deployed", "pooled", "top", "own_top"])
    known = c("deployer").isNotNull() & c("excluded__").isNull()
    base = F.when(c("all") > 0, c("all")).otherwise(c("total_supply"))
    clamp = lambda part: F.when(c("total_supply") > 0, F.greatest(F.lit(0), F.least(F.lit(10_000), share_bps(F.greatest(part, F.lit(0)), c("total_supply"))))).cast("bigint")
    return t.select(
        "token", "holders", "adjusted_holders", share_bps(c("largest"), base).alias("largest_bps"), share_bps(c("top"), base).alias("top10_bps"), share_bps(c("own_top"), c("own")).alias("adjusted_top10_bps"),
        F.when(known, share_bps(c("deployed"), c("own"))).alias("deployer_bps"), clamp(c("total_supply") - (c("all") - c("own")) - F.when(known, c("deployed")).otherwise(0)).alias("float_bps"), clamp(c("pooled")).alias("pool_bps"),
    )


def anchor_chain(pools: DataFrame, dollar: int, hops: int, least_depth: float) -> DataFrame:
    """(asset, price, pool, hop): what an asset is worth in dollars, along at most
    `hops` pools. pools (pool, a, b, reserve_a, reserve_b).

    A round prices the assets that share a pool with one priced before: by the
    pool whose other side is deepest in dollars, the first of equals, if it is at
    least `least_depth` deep. A round's tables are one row an asset; pools are
    grouped by asset on the map side.
    """
    side = lambda x, y, rx, ry: F.struct(c(x).alias("asset"), c(y).alias("quote"), c(rx).alias("own"), c(ry).alias("other"))
    edges = pools.where("a <> b AND reserve_a > 0 AND reserve_b > 0").select("pool", F.inline(F.array(side("a", "b", "reserve_a", "reserve_b"), side("b", "a", "reserve_b", "reserve_a"))))
    none = F.lit(None).cast(dict(pools.dtypes)["pool"])
    known = pools.sparkSession.range(1).select(F.lit(dollar).cast(dict(pools.dtypes)["a"]).alias("asset"), F.lit(1.0).alias("price"), none.alias("pool"), F.lit(0).alias("hop"))
    for hop in range(1, hops + 1):
        reach = edges.join(known.select(c("asset").alias("quote"), "price"), "quote").join(known.select("asset"), "asset", "left_anti")
        reach = reach.withColumn("depth", c("other") * c("price"))
        best = reach.groupBy("asset").agg(F.max_by(F.struct("pool", "depth", (c("other") / c("own") * c("price")).alias("price")), F.struct(c("depth"), -c("pool"))).alias("m"))
        known = known.unionByName(best.where(c("m.depth") >= least_depth).select("asset", "m.price", "m.pool", F.lit(hop).alias("hop")))
    return known


def _whole(x: Column, y: Column) -> Column:
    return F.call_function("div", x, y)


def _given(amount: Column, reserve_in: Column, reserve_out: Column, fee_bps: int) -> Column:
    """What a pool gives, also 0; null without reserves."""
    d = "decimal(19,0)"
    after = amount.cast(d) * (10_000 - fee_bps)
    out = _whole((after.cast("decimal(24,0)") * reserve_out.cast("decimal(14,0)")).cast("decimal(38,0)"), (reserve_in.cast(d) * 10_000 + after).cast("decimal(38,0)"))
    return F.when((reserve_in > 0) & (reserve_out > 0), out)


def swap_out(amount: Column, reserve_in: Column, reserve_out: Column, fee_bps: int = 30) -> Column:
    """What a constant-product pool gives for an amount, rounded down; null
    without reserves, or where it gives nothing."""
    return F.nullif(_given(amount, reserve_in, reserve_out, fee_bps), F.lit(0))


def slippage_curve(pools: DataFrame, dollar_raw: Column, notionals: list[float], fee_bps: int = 30) -> DataFrame:
    """pools (..., base_reserve, quote_reserve) and `curve`: for each notional in
    dollars the loss of buying and selling at once, in basis points of what was
    put in, rounded down and at least 0; null where a leg gives nothing.
    `dollar_raw`: raw quote units of a dollar. Notionals are taken to the cent.
    Each leg is a step of its own over an array: inside one expression a leg would
    be computed again wherever it is named, and the code outgrows what compiles."""
    raw = lambda n: _whole(dollar_raw.cast("decimal(19,0)") * int(n * 100 + 0.5), F.lit(100).cast("decimal(3,0)"))
    legs = F.array(*[F.struct(F.lit(f"{n:g}").alias("notional"), raw(n).alias("raw")) for n in notionals])
    bought = lambda x: F.struct(x["notional"].alias("notional"), x["raw"].alias("raw"), _given(x["raw"], c("quote_reserve"), c("base_reserve"), fee_bps).alias("bought"))
    back = lambda x: F.struct(x["notional"].alias("notional"), x["raw"].alias("raw"), F.when(x["bought"] > 0, _given(x["bought"], c("base_reserve"), c("quote_reserve"), fee_bps)).alias("back"))

    def point(x: Column) -> Column:
        loss = F.when((x["raw"] > 0) & (x["back"] > 0), _whole(F.greatest(F.lit(0), x["raw"] - x["back"]).cast("decimal(28,0)") * 10_000, x["raw"])).cast("bigint")
        return F.struct(x["notional"].alias("notional"), loss.alias("loss_bps"))

    return pools.withColumn("curve", F.transform(F.transform(F.transform(legs, bought), back), point))
