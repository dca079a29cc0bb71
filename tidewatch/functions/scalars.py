"""Scalar functions as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

LEVELS = ("GRAY", "RED", "YELLOW", "GREEN")


def normal_name(x: Column) -> Column:
    return F.regexp_replace(F.lower(x), "[^a-z0-9]+", "")


def escape_html(x: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        x = F.replace(x, F.lit(a), F.lit(b))
    return x


def untrusted(x: Column, most: int = 128) -> Column:
    """Without control characters and backticks, cut to `most` characters."""
    return F.substring(F.regexp_replace(x, r"[\x00-\x1F\x7F-\x9F`]", ""), 1, most)


def json_number(x: Column, path: str) -> Column:
    """A plain decimal number of a JSON text; null for anything else."""
    v = F.get_json_object(x, path)
    return F.when(v.rlike(r"^-?[0-9.]+$"), v.try_cast("double"))


def shortfall_bps(spot: Column, actual: Column) -> Column:
    """Loss against the spot, rounded down, at least 0; null if unknown."""
    return F.when((spot > 0) & actual.isNotNull(), F.greatest(F.lit(0), F.floor((spot - actual) * 10000 / spot).cast("bigint")))


def level_rank(x: Column) -> Column:
    c = F.when(x == LEVELS[3], 3)
    for i in (2, 1):
        c = c.when(x == LEVELS[i], i)
    return c.otherwise(0)


def implied_probability(x: Column) -> Column:
    return F.least(F.lit(10000), F.greatest(F.lit(0), x))
