"""Eligibility, score, tier, risk and alert gate as column expressions.

Missing data is unknown, never a pass; a score cannot override a failed gate.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .scalars import level_rank
from .texts import usd_number

c = F.col


def tiers(x: Column, *steps: tuple[float, int], otherwise: int = 0) -> Column:
    """Points of the first step whose bound x reaches; null x reaches none."""
    out = F.when(x >= steps[0][0], steps[0][1])
    for bound, points in steps[1:]:
        out = out.when(x >= bound, points)
    return out.otherwise(otherwise)


def failed_rules() -> Column:
    """Hard rules that a candidate fails, in order."""
    rule = lambda name, bad: F.when(bad, F.lit(name))
    below = lambda x, least: F.coalesce(x < least, F.lit(True))
    return F.array_compact(F.array(
        rule("fdvBand", F.coalesce(~c("fdv").between(10_000, 100_000), F.lit(True))),
        rule("minTotalLiquidity", below(c("total_liq"), 5_000)),
        rule("minQuoteLiquidity", below(c("quote_liq"), 2_500)),
        rule("liquidityNotCollapsed", F.coalesce(c("collapsed"), F.lit(False))),
        rule("minAge", c("age_minutes") < 0),
        rule("maxEffectiveSellLoss", F.coalesce(c("sell_loss_bps") > 800, F.lit(False))),
        rule("sellSimulationPass", c("simulation") == "FAIL"),
        rule("noCriticalPermission", c("critical")),
    ))


def soft_failed_rules() -> Column:
    over = lambda x, most: F.coalesce(x > most, F.lit(True))
    return F.array_compact(F.array(F.when(c("buyers_1h") < 15, F.lit("minUniqueBuyers")), F.when(over(c("deployer_bps"), 800), F.lit("maxDeployerPct")), F.when(over(c("top10_bps"), 4_500), F.lit("maxAdjustedTop10Pct"))))


def liquidity_depth() -> Column:
    ratio = F.when(c("fdv") > 0, F.floor(c("quote_liq") / c("fdv") * 10000))
    return F.greatest(F.lit(0), F.least(F.lit(35), tiers(c("quote_liq"), (30_000, 20), (20_000, 16), (10_000, 10), (5_000, 6), (2_500, 2)) + tiers(ratio, (2_000, 8), (1_500, 6), (1_000, 4), (500, 2)) + slippage_points()))


def slippage_points() -> Column:
    """+7 if all known losses are flat, -5 if they grow steeply."""
    known = F.filter(c("slippage"), lambda x: x.isNotNull())
    flat = F.when(F.array_max(known) <= 300, 7).otherwise(0)
    steep = F.when((F.size(known) > 1) & (F.try_element_at(known, F.lit(-1)) - F.get(known, F.lit(0)) >= 500), -5).otherwise(0)
    return flat + steep


def buyer_breadth() -> Column:
    return tiers(c("buyers_1h"), (30, 15), (15, 13), (5, 8), (1, 3)) + tiers(c("buyers_20m"), (15, 10), (5, 6), (1, 3))


def buy_flow() -> Column:
    """Only with five buys by five buyers at least."""
    ratio = c("buys_20m") / (c("sells_20m") + 1)
    points = tiers(ratio, (3, 15), (1.5, 10), (1, 6)) + F.when(c("buy_volume") > c("sell_volume"), 5).otherwise(0)
    return F.when((c("buys_20m") >= 5) & (c("buyers_20m") >= 5), F.least(F.lit(20), points)).otherwise(0)


def low_cap_tilt() -> Column:
    f = c("fdv")
    return F.when(f.between(15_000, 40_000), 20).when((f > 40_000) & (f <= 60_000), 12).when((f >= 10_000) & (f < 15_000), 10).when((f > 60_000) & (f <= 100_000), 6).otherwise(0)


def opportunity() -> Column:
    return F.greatest(F.lit(0), F.least(F.lit(100), liquidity_depth() + buyer_breadth() + buy_flow() + low_cap_tilt()))


def replayed(df: DataFrame, features: str, entry_fdv: Column) -> DataFrame:
    """df with the columns that the rules read, from a struct of stored entry
    features (texts.entry_features). What a source would have given counts as in
    a live pass where the source is missing: no activity is none, no risk is
    unknown; what can't be told as of entry is null."""
    e = lambda k: F.col(f"{features}.{k}")
    none = lambda x, default: F.coalesce(x, F.lit(default))
    null = F.lit(None)
    return df.withColumns({
        "fdv": entry_fdv,
        "quote_liq": usd_number(e("quoteLiquidityUsd")),
        "total_liq": usd_number(e("totalLiquidityUsd")),
        "age_minutes": e("ageMinutesAtEntry"),
        "collapsed": null.cast("boolean"),
        "regressed": null.cast("boolean"),
        "sell_loss_bps": e("effectiveSellLossBps"),
        "simulation": none(e("simulationStatus"), "UNKNOWN"),
        "risk": none(e("riskStatus"), "UNKNOWN"),
        "critical": none(e("criticalPermissionPresent"), False),
        "buyers_1h": none(e("uniqueBuyers1h"), 0.0),
        "buyers_20m": none(e("uniqueBuyers20m"), 0.0),
        "buys_20m": none(e("buyCount20m"), 0.0),
        "sells_20m": none(e("sellCount20m"), 0.0),
        "buy_volume": none(e("quoteBuyVolumeRaw20m").try_cast("decimal(38,0)"), 0),
        "sell_volume": none(e("quoteSellVolumeRaw20m").try_cast("decimal(38,0)"), 0),
        "deployer_bps": e("deployerPctBps"),
        "top10_bps": e("adjustedTop10PctBps"),
        "slippage": null.cast("array<double>"),
    })


def alert_level() -> Column:
    """Of a candidate with eligible and score."""
    gone = F.coalesce(c("collapsed"), F.lit(False)) | F.coalesce(c("regressed"), F.lit(False))
    green = c("eligible") & (c("score") >= 80) & (c("buyers_1h") >= 20) & F.coalesce(c("top10_bps") < 4_000, F.lit(True)) & (c("simulation") == "PASS") & c("fdv").between(15_000, 40_000)
    yellow = c("eligible") & (c("score") >= 65) & c("fdv").between(15_000, 60_000) & (c("total_liq") >= 8_000)
    red = c("fdv").between(10_000, 100_000) & (c("quote_liq") >= 2_500) & (c("buyers_1h") >= 5) & ~F.coalesce(c("critical"), F.lit(False)) & (F.coalesce(c("risk"), F.lit("UNKNOWN")) != "FAIL")
    return F.when(gone, "GRAY").when(green, "GREEN").when(yellow, "YELLOW").when(red, "RED").otherwise("GRAY")


def alert_gate(cooldown: int, floor: int = 80, floor_red: int = 70, delta: int = 10) -> tuple[Column, Column]:
    """(emit, reason) of level, score, t against last_level, last_score, last_t
    of the token's latest alert (null: none), and sibling_level, sibling_token of
    the latest that was delivered, not long ago, for another token of like name
    (null: none): it holds back what doesn't outrank it."""
    least = F.when(c("level") == "RED", max(floor, floor_red)).otherwise(floor)
    rank, last = level_rank(c("level")), level_rank(c("last_level"))
    reason = (
        F.when(c("level") == "GRAY", "level-gray-never-emits")
        .when(c("score") < least, "below-min-score")
        .when(c("sibling_level").isNotNull() & (rank <= level_rank(c("sibling_level"))), F.concat(F.lit("duplicate-name:"), c("sibling_level"), F.lit("@"), c("sibling_token").cast("string")))
        .when(c("last_level").isNull(), "first-alert")
        .when(rank > last, "level-increase")
        .when(c("t") - c("last_t") < cooldown, "within-cooldown")
        .when(c("score") - c("last_score") < delta, "no-material-improvement")
        .when(rank == last, "cooldown-elapsed:same-level")
        .otherwise("cooldown-elapsed:de-escalation")
    )
    return reason.isin("first-alert", "level-increase", "cooldown-elapsed:same-level", "cooldown-elapsed:de-escalation"), reason


def risk_status() -> Column:
    """FAIL on a critical permission or failed simulation, UNKNOWN if either
    analysis is incomplete, else PASS."""
    unknown = c("permission").isNull() | c("permission").isin("UNKNOWN", "ANALYSIS_FAILED") | (F.coalesce(c("simulation"), F.lit("UNKNOWN")) == "UNKNOWN")
    return F.when((c("permission") == "PRESENT") | (c("simulation") == "FAIL"), "FAIL").when(unknown, "UNKNOWN").otherwise("PASS")


def effective_risk(most: int) -> Column:
    """ERROR stays; older than `most` is STALE."""
    return F.when(c("status") == "ERROR", "ERROR").when(c("age") > most, "STALE").otherwise(c("status"))


def realized_taxonomy(outcome: Column | None = None) -> Column:
    """What came of a call; `outcome` F: the token died."""
    return F.when(((c("status") if outcome is None else outcome) == "F") | F.coalesce(c("collapsed"), F.lit(False)), "RUGGED").when(c("mult") >= 20_000, "RUNNER").when(c("mult") < 11_000, "BLED").otherwise("HELD_BAND")
