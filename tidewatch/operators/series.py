"""Rolling windows, buy shape, trajectories and labels over snapshot history."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from .dominance import counts_in_ranges

HOUR = 3_600_000_000
DAY = 24 * HOUR


def half_up(x: Column) -> Column:
    """Rounds .5 up, also below zero."""
    return F.floor(x + 0.5).cast("bigint")


def rolling_activity(swaps: DataFrame, width: int, at: str = "BUY") -> DataFrame:
    """For each swap of side `at`: distinct buyers, buys, sells and volumes of
    its pool in [t - width, t], both ends inside.

    A swap counts from its time on until `width` later, so all figures are
    running sums of what enters and leaves; a buyer enters with the first of
    several buys no more than `width` apart and leaves `width` after the last.
    Sums run within buckets of a pool's time, onto the sum of the buckets before
    (a table of one row per pool and bucket), so neither a hot pool nor a crowded
    window is one task's work."""
    buy, sell = F.col("side") == "BUY", F.col("side") == "SELL"
    mine = Window.partitionBy("pool", "buyer").orderBy("t", "id")
    buys = swaps.where(buy).select("*", F.lag("t").over(mine).alias("prev"), F.lead("t").over(mine).alias("next"))
    s = buys.unionByName(swaps.where(sell), allowMissingColumns=True)
    whole = lambda x: F.when(x, 1).otherwise(0).cast("bigint")
    amount = lambda x: F.when(x, F.coalesce("amount", F.lit(0))).otherwise(0).cast("bigint")
    comes = buy & F.col("buyer").isNotNull() & (F.col("prev").isNull() | (F.col("t") - F.col("prev") > width))
    goes = buy & F.col("buyer").isNotNull() & (F.col("next").isNull() | (F.col("next") - F.col("t") > width))
    names = ("buyers", "buys", "sells", "buy_volume", "sell_volume")

    def change(time, place: int, sign: int, buyer):
        values = (whole(buyer), whole(buy), whole(sell), amount(buy), amount(sell))
        return F.struct(time.alias("time"), F.lit(place).alias("place"), *[(sign * v).alias(n) for v, n in zip(values, names)])

    # at one time, what enters comes before the rows that ask, what leaves after
    moves = s.select("pool", F.inline(F.array(change(F.col("t"), 0, 1, comes), change(F.col("t") + width, 2, -1, goes))))
    asks = swaps.where(F.col("side") == at).select("pool", F.col("t").alias("time"), F.lit(1).alias("place"), "id")
    u = moves.unionByName(asks, allowMissingColumns=True).withColumn("bucket", F.floor(F.col("time") / (16 * width)))
    upto = Window.partitionBy("pool", "bucket").orderBy("time", "place").rowsBetween(Window.unboundedPreceding, 0)
    inside = u.select("id", "pool", "bucket", "place", *[F.coalesce(F.sum(n).over(upto), F.lit(0)).alias(n) for n in names]).where("place = 1")
    totals = u.groupBy(F.col("pool").alias("p"), F.col("bucket").alias("at")).agg(*[F.coalesce(F.sum(n), F.lit(0)).alias(n) for n in names])
    before = Window.partitionBy("p").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    carried = totals.select("p", "at", *[F.sum(n).over(before).alias(f"{n}_0") for n in names])
    out = inside.join(carried, F.col("pool").eqNullSafe(F.col("p")) & (F.col("bucket") == F.col("at")), "left")
    return out.select("id", "pool", *[(F.col(n) + F.coalesce(f"{n}_0", F.lit(0))).alias(n) for n in names])


def gini_bps(swaps: DataFrame) -> DataFrame:
    """Gini index of the pools' buys by buyer, exact, half up; null below two
    buyers or without volume."""
    t = swaps.where("side = 'BUY'").groupBy("pool", "buyer").agg(F.sum("amount").cast("decimal(38,0)").alias("x"))
    t = t.withColumn("i", F.row_number().over(Window.partitionBy("pool").orderBy("x", "buyer")))
    g = t.groupBy("pool").agg(F.count("*").alias("n"), F.sum("x").alias("s"), F.sum(F.col("i") * F.col("x")).alias("ix"))
    return g.select("pool", F.expr("CASE WHEN n >= 2 AND s > 0 THEN (20000 * (2 * ix - (n + 1) * s) + n * s) div (2 * n * s) END").alias("gini_bps"))


def entropy_bps(swaps: DataFrame) -> DataFrame:
    """Shannon entropy of the pools' buys by buyer over its maximum; null below
    two buyers or without volume."""
    t = swaps.where("side = 'BUY'").groupBy("pool", "buyer").agg(F.sum("amount").alias("x"))
    w = Window.partitionBy("pool")
    t = t.withColumn("s", F.sum("x").over(w)).withColumn("n", F.count("*").over(w)).where("n > 1 AND s > 0")
    p = F.greatest(F.col("x") / F.col("s"), F.lit(1e-12))
    h = t.groupBy("pool").agg((-F.sum(p * F.ln(p)) / F.ln(F.max("n"))).alias("h"))
    return swaps.where("side = 'BUY'").select("pool").distinct().join(h, "pool", "left").select("pool", F.when(F.col("h").isNotNull(), F.least(F.lit(10000), F.greatest(F.lit(0), half_up(F.col("h") * 10000)))).alias("entropy_bps"))


def repeated_size_bps(swaps: DataFrame) -> DataFrame:
    """Share of buys whose exact size occurs at least twice in the pool."""
    c = swaps.where("side = 'BUY'").groupBy("pool", "amount").count()
    return c.groupBy("pool").agg(half_up(F.sum(F.when(F.col("count") >= 2, F.col("count")).otherwise(0)) * 10000 / F.sum("count")).alias("repeated_bps"))


def trajectory(snaps: DataFrame) -> DataFrame:
    """Per pool with a valued snapshot: first peak, latest, drawdown, minutes at
    80 % of the peak or more (a gap counts for its earlier end; the last counts
    nothing), snapshots with and without value, and whether it collapsed."""
    v = snaps.where("liq IS NOT NULL").withColumn("next", F.lead("t").over(Window.partitionBy("pool").orderBy("t", "id"))).withColumn("peak", F.max("liq").over(Window.partitionBy("pool")))
    held = F.when(F.col("liq") >= F.col("peak") * 0.8, F.coalesce(F.col("next") - F.col("t"), F.lit(0))).otherwise(0)
    a = v.groupBy("pool").agg(F.max("peak").alias("peak"), F.max_by("liq", F.struct("t", "id")).alias("latest"), F.floor(F.sum(held) / 60_000_000).cast("bigint").alias("minutes_near_peak"))
    n = snaps.groupBy("pool").agg(F.count("*").alias("snapshots"))
    fall = F.when(F.col("peak") > 0, half_up((F.col("peak") - F.col("latest")) * 10000 / F.col("peak"))).otherwise(0)
    return a.join(n, "pool").select("pool", "peak", "latest", fall.alias("drawdown_bps"), "minutes_near_peak", "snapshots", ((F.col("peak") > 0) & (F.col("latest") < F.col("peak") * 0.2)).alias("collapsed"))


def outcome_label(snaps: DataFrame, horizon: int, keep: float = 0.3, fdv_floor: float = 10_000.0) -> DataFrame:
    """SURVIVED or DIED at the horizon from a pool's first snapshot (by id);
    pools with fewer than two valued snapshots inside, or nothing at the
    horizon, are left out."""
    first = F.min_by("t", "id").over(Window.partitionBy("pool"))
    w = snaps.withColumn("t0", first).where(F.col("t").between(F.col("t0"), F.col("t0") + horizon))
    g = w.groupBy("pool").agg(F.max("liq").alias("peak"), F.count("liq").alias("n"), F.max_by(F.struct("liq", "fdv"), "id").alias("end"))
    g = g.where("n >= 2 AND end.liq IS NOT NULL AND end.fdv IS NOT NULL")
    alive = (F.col("end.liq") >= F.col("peak") * keep) & (F.col("end.fdv") >= fdv_floor)
    return g.select("pool", "peak", F.col("end.liq").alias("liq_at_horizon"), F.when(alive, "SURVIVED").otherwise("DIED").alias("outcome"))


def performance_label(snaps: DataFrame, horizon: int, low: float, high: float, now: int) -> DataFrame:
    """Greatest multiple of the entry price within the horizon, the worst fall
    at or before that first peak, and the minutes to it. Entry: the first
    snapshot (by id) in the band; only windows that have fully passed."""
    e = snaps.where(F.col("fdv").between(low, high)).groupBy("pool").agg(F.min_by(F.struct("t", "fdv", "id"), "id").alias("e"))
    e = e.where(F.col("e.t") + horizon <= now).select("pool", F.col("e.t").alias("t0"), F.col("e.fdv").alias("p0"))
    w = snaps.where("fdv IS NOT NULL").join(e, "pool").where(F.col("t").between(F.col("t0"), F.col("t0") + horizon))
    w = w.withColumn("top", F.max(F.struct(F.col("fdv"), -F.col("t"), -F.col("id"))).over(Window.partitionBy("pool")))
    before = (F.col("t") < -F.col("top.col2")) | ((F.col("t") == -F.col("top.col2")) & (F.col("id") <= -F.col("top.col3")))
    g = w.groupBy("pool").agg(F.max("p0").alias("p0"), F.max("fdv").alias("best"), F.min(F.when(before, F.col("fdv"))).alias("worst"), F.max(-F.col("top.col2") - F.col("t0")).alias("dt"), F.count("*").alias("snapshots"))
    worst = F.least("worst", "p0")
    return g.select("pool", F.greatest(F.lit(10000), half_up(F.col("best") * 10000 / F.col("p0"))).alias("multiple_bps"), F.greatest(F.lit(0), half_up((F.col("p0") - worst) * 10000 / F.col("p0"))).alias("drawdown_bps"), half_up(F.col("dt") / 60_000_000).alias("minutes_to_peak"), "snapshots")


def sustained_peak(snaps: DataFrame, width: int, low: float, high: float) -> DataFrame:
    """Buckets of `width` from entry; one with two valued snapshots or more
    counts by its least value; the greatest such, the first of equals."""
    e = snaps.where(F.col("fdv").between(low, high)).groupBy("pool").agg(F.min_by(F.struct("t", "fdv"), "id").alias("e")).select("pool", F.col("e.t").alias("t0"), F.col("e.fdv").alias("p0"))
    b = snaps.join(e, "pool").where("t >= t0 AND fdv IS NOT NULL").withColumn("bucket", F.expr(f"(t - t0) div {width}"))
    b = b.groupBy("pool", "p0", "bucket").agg(F.count("*").alias("n"), F.min("fdv").alias("low"), F.max_by("liq", F.when(F.col("liq").isNotNull(), F.struct("t", "id"))).alias("exit")).where("n >= 2")
    g = b.groupBy("pool", "p0").agg(F.min_by(F.struct("low", "bucket", "exit"), F.struct(-F.col("low"), F.col("bucket"))).alias("m"))
    return g.select("pool", F.floor(F.col("m.low") * 10000 / F.col("p0")).cast("bigint").alias("sustained_bps"), F.col("m.bucket").alias("bucket"), F.col("m.exit").alias("exit_liquidity"))


def cohort_percentiles(snaps: DataFrame, least: int = 8) -> DataFrame:
    """Share of a pool's peers (age from half to twice its own, itself not) with
    at most its value, of those that have one; null without its own value. Peers
    are counted by dominance, not joined."""
    c = snaps.groupBy("pool").agg(F.max_by("fdv", F.struct("t", "id")).alias("y"), ((F.max("t") - F.min("t")) / 60_000_000).alias("x")).where("x > 0").withColumnRenamed("pool", "id")
    n = counts_in_ranges(c, F.col("x") * 0.5, F.col("x") * 2).join(c.select("id", "y"), "id")
    share = (F.col("at_most") - 1) / F.nullif(F.col("valued") - 1, F.lit(0))
    return n.where(F.col("inside") - 1 >= least).select(F.col("id").alias("pool"), (F.col("inside") - 1).alias("cohort"), F.when(F.col("y").isNotNull(), half_up(share * 10000)).alias("fdv_bps"))
