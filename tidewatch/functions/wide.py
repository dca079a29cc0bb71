"""Exact integers of up to 78 digits, beyond Spark's decimals, kept as text."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import StringType

LIMB, LIMBS = 18, 5
WAD = 10**18


def limb_sums(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """(keys, total): exact sums of signed integers in text. Each is split into
    five limbs of 18 digits, summed as decimals by Spark; carries are settled in
    one Arrow UDF per group. Nulls are left out."""
    x = F.col(value)
    sign = F.when(x.startswith("-"), -1).otherwise(1)
    padded = F.lpad(F.regexp_replace(x, "^[-+]", ""), LIMB * LIMBS, "0")
    parts = [(F.substring(padded, 1 + LIMB * i, LIMB).cast("decimal(20,0)") * sign).alias(f"l{i}") for i in range(LIMBS)]
    s = df.where(x.isNotNull()).select(*keys, *parts).groupBy(*keys).agg(*[F.sum(f"l{i}").cast("string").alias(f"l{i}") for i in range(LIMBS)])
    return s.select(*keys, _joined(*[F.col(f"l{i}") for i in range(LIMBS)]).alias("total"))


@pandas_udf(StringType())
def _joined(a: pd.Series, b: pd.Series, c: pd.Series, d: pd.Series, e: pd.Series) -> pd.Series:
    return pd.Series([str(sum(int(x) * 10 ** (LIMB * (LIMBS - 1 - i)) for i, x in enumerate(row))) for row in zip(a, b, c, d, e)], dtype=object)


def _exact(compute: Callable[..., int | None], *columns: Column) -> Column:
    @pandas_udf(StringType())
    def run(values: pd.DataFrame) -> pd.Series:
        rows = values.itertuples(index=False, name=None)
        return pd.Series([None if any(v is None or v != v for v in r) or (y := compute(*map(int, r))) is None else str(y) for r in rows], dtype=object)

    return run(F.struct(*[c.cast("string").alias(f"c{i}") for i, c in enumerate(columns)]))


def mul_div(a: Column, b: Column, d: Column) -> Column:
    """floor(a b / d); null where d is 0 or anything is null."""
    return _exact(lambda x, y, z: x * y // z if z else None, a, b, d)


def difference(a: Column, b: Column) -> Column:
    return _exact(lambda x, y: x - y, a, b)


def sum_of(a: Column, b: Column) -> Column:
    return _exact(lambda x, y: x + y, a, b)


def v2_price(base: Column, quote: Column, base_decimals: Column, quote_decimals: Column) -> Column:
    """Price of the base in the quote, times 10^18; null on a zero reserve."""
    return _exact(lambda b, q, bd, qd: q * WAD * 10**bd // (b * 10**qd) if b > 0 and q > 0 else None, base, quote, base_decimals, quote_decimals)


def v3_price(root: Column, base_decimals: Column, quote_decimals: Column, base_first: bool = True) -> Column:
    """The same from a square root price times 2^96; null if that is zero."""

    def price(s: int, bd: int, qd: int) -> int | None:
        if s <= 0:
            return None
        up, down = (s * s, 1 << 192) if base_first else (1 << 192, s * s)
        return up * WAD * 10**bd // (down * 10**qd)

    return _exact(price, root, base_decimals, quote_decimals)


def usd_value(raw: Column, decimals: Column, price: Column) -> Column:
    """raw / 10^decimals times price, times 10^18; null from 10^36 dollars on."""
    return _exact(lambda r, d, p: v if (v := r * p // 10**d) < 10**54 else None, raw, decimals, price)


def price_by_kind(kind: Column, base_reserve: Column, quote_reserve: Column, root: Column, base_decimals: Column, quote_decimals: Column, base_first: Column) -> Column:
    """The price of a pool by its kind, v2 by reserves or v3 by square root and
    side; null for another kind, and where the kind's own inputs are missing."""
    none = F.lit(None).cast("string")
    of = lambda which, x: F.when(which, x.cast("string")).otherwise(none)
    v2, v3 = kind == "v2", kind == "v3"
    forward, back = v3 & base_first, v3 & ~base_first
    return F.coalesce(v2_price(of(v2, base_reserve), quote_reserve, base_decimals, quote_decimals), v3_price(of(forward, root), base_decimals, quote_decimals, True), v3_price(of(back, root), base_decimals, quote_decimals, False))


def format_wad(x: Column) -> Column:
    """A whole number of 10^-18 in text as a plain decimal, without zeros at its
    end: 250000000000000000 is 0.25."""
    digits = F.regexp_replace(x, "^-?0*", "")
    padded = F.when(F.length(digits) < 19, F.lpad(digits, 19, "0")).otherwise(digits)
    whole = F.substring(padded, F.lit(1), F.length(padded) - 18)
    part = F.regexp_replace(F.right(padded, F.lit(18)), "0+$", "")
    minus = F.when(x.startswith("-") & (digits != ""), "-").otherwise("")
    return F.concat(minus, whole, F.when(part != "", F.concat(F.lit("."), part)).otherwise(""))
