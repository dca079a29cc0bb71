"""Exact prices and values of pools, from line items as reserves and roots."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import wide
from ..sources.tables import read
from .catalogue import query

_POOLS = """x AS (SELECT l_orderkey AS k, l_linenumber AS n, CASE l_linenumber % 3 WHEN 0 THEN 'v2' WHEN 1 THEN 'v3' ELSE 'other' END AS kind, CASE WHEN l_suppkey % 9 = 0 THEN 0 ELSE l_suppkey END::HUGEINT AS base, (l_partkey * 1000)::HUGEINT AS quote, (l_suppkey % 7)::HUGEINT AS root, CASE WHEN l_partkey % 2 = 0 THEN 6 ELSE 8 END AS bd, l_quantity::INT % 2 = 0 AS first_ FROM lineitem),
y AS (SELECT *, CASE bd WHEN 6 THEN 1000000 ELSE 100000000 END::HUGEINT AS b10, 1000000::HUGEINT AS q10, 1000000000000000000::HUGEINT AS wad FROM x),
z AS (SELECT k, n, kind, quote, CASE WHEN kind = 'v2' AND base > 0 AND quote > 0 THEN quote * wad * b10 // (base * q10) WHEN kind = 'v3' AND root > 0 AND first_ THEN root * root * wad * b10 // q10 WHEN kind = 'v3' AND root > 0 THEN wad * b10 // (root * root * q10) END AS price FROM y)"""


def pools(spark, sf):
    i = read(spark, sf, "lineitem")
    n, s, p = F.col("l_linenumber"), F.col("l_suppkey"), F.col("l_partkey")
    kind = F.when(n % 3 == 0, "v2").when(n % 3 == 1, "v3").otherwise("other")
    root = (s % 7).cast("decimal(38,0)") * F.lit(str(2**96)).cast("decimal(38,0)")
    x = i.select(F.col("l_orderkey").alias("k"), n.alias("n"), kind.alias("kind"), F.when(s % 9 == 0, 0).otherwise(s).alias("base"), (p * 1000).alias("quote"), root.cast("decimal(38,0)").cast("string").alias("root"), F.when(p % 2 == 0, 6).otherwise(8).alias("bd"), (F.col("l_quantity").cast("int") % 2 == 0).alias("first"))
    price = wide.price_by_kind(F.col("kind"), F.col("base"), F.col("quote"), F.col("root"), F.col("bd"), F.lit(6), F.col("first"))
    return x.select("k", "n", "kind", "quote", price.alias("price"))


@query(f"WITH {_POOLS} SELECT k, n, kind, price::VARCHAR AS price FROM z")
def pool_prices(spark, sf):
    """Floor of the price times 10^18, by kind of pool; null for other kinds and
    for empty reserves or roots."""
    return pools(spark, sf).select("k", "n", "kind", "price")


@query(f"WITH {_POOLS} SELECT k, n, CASE WHEN v IS NOT NULL THEN (v // 1000000000000000000)::VARCHAR || CASE WHEN v % 1000000000000000000 <> 0 THEN '.' || rtrim(lpad((v % 1000000000000000000)::VARCHAR, 18, '0'), '0') ELSE '' END END AS usd FROM (SELECT k, n, quote * price // 1000000 AS v FROM z WHERE kind <> 'other')")
def pool_values(spark, sf):
    """What the quote reserve (six decimals) is worth at the price, as a plain decimal."""
    x = pools(spark, sf).where("kind <> 'other'")
    return x.select("k", "n", wide.format_wad(wide.usd_value(F.col("quote"), F.lit(6), F.col("price"))).alias("usd"))
