"""Lookups by key and ordered scans, by parameter."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F


def by_keys(df: DataFrame, column: str, keys: list, same: str | None = None) -> DataFrame:
    """The rows whose `column` is one of the keys; `same` names a function such as
    `lower` that both sides go through. Keys are literals, which the scan prunes
    by; repeated and null keys match nothing more."""
    wanted = [k for k in dict.fromkeys(keys) if k is not None]
    side = lambda x: F.call_function(same, x) if same else x
    return df.where(side(F.col(column)).isin(*[side(F.lit(k)) for k in wanted])) if wanted else df.limit(0)


def since(df: DataFrame, time: str, start: Column | int, keep: Column | None = None) -> DataFrame:
    """The rows at or after a time, that `keep` holds for; the filter reaches the
    scan. Order where rows are taken in it (orderBy), not before."""
    rows = df.where(F.col(time) >= start)
    return rows if keep is None else rows.where(keep)


def top_of_chunks(df: DataFrame, order: list[Column], most: int) -> DataFrame:
    """The first `most` rows in the order: each partition keeps its own first ones
    and those are merged, so nothing is sorted as a whole."""
    return df.orderBy(*order).limit(most)


def first_by(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first row of each key, one per key; combined before the shuffle."""
    row = F.struct(*df.columns)
    return df.groupBy(*[F.col(k).alias(f"k{i}") for i, k in enumerate(keys)]).agg(F.min_by(row, F.struct(*order)).alias("r")).select("r.*")


def running_place(df: DataFrame, key: str, order: list[Column]) -> DataFrame:
    return df.withColumn("place", F.row_number().over(Window.partitionBy(key).orderBy(*order)))
