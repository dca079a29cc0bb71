"""Judged briefs against what came of them, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

#: The risk tags of a brief, and those whose coming true is
#: measured; the others are counted, never guessed at.
TAGS = ("RUG_LP_PULL", "SELL_RESTRICTION", "CONCENTRATION_DUMP", "WASH_COORDINATION", "NO_FOLLOW_THROUGH", "OTHER")
MEASURED = ("RUG_LP_PULL", "CONCENTRATION_DUMP", "NO_FOLLOW_THROUGH")
#: A fall in basis points that counts as a dump, and the share of
#: the peak below which liquidity has collapsed.
DUMP_BPS, COLLAPSE = 5_000, 0.2


def implied_bps(recommendation: Column, confidence: Column) -> Column:
    """The stated probability of a run, by the recommendation."""
    return F.when(recommendation == "RESEARCH", confidence).when(recommendation == "WATCH", 5_000).otherwise(10_000 - confidence)


def liquidity_collapsed(peak: Column, at_horizon: Column) -> Column:
    """False where either is unknown."""
    return F.coalesce((peak > 0) & (at_horizon < peak * COLLAPSE), F.lit(False))


def came_true(tag: Column, label: Column, drawdown: Column) -> Column:
    """Whether a risk tag came true; null for a tag that isn't measured."""
    dumped = (label == "RUGGED") | (drawdown > DUMP_BPS)
    return F.when(tag == "RUG_LP_PULL", label == "RUGGED").when(tag == "CONCENTRATION_DUMP", dumped).when(tag == "NO_FOLLOW_THROUGH", label.isin("BLED", "HELD_BAND"))


def rate_bps(k: Column, n: Column) -> Column:
    return F.when(n > 0, F.floor(k / n * 10_000 + 0.5)).otherwise(0).cast("bigint")
