"""Exact ranks and quantiles of groups that no single task has to hold.

A place k of a group's sorted values is found by narrowing: a mergeable sketch
gives a bracket of values that holds it for certain, an exact count tells how
many rows lie below and inside, and while many lie inside, the next sketch is of
those alone. What is left is counted by distinct value and summed up in order.
Nothing is sorted, rows are only combined before shuffles, and a value that a
third of all rows share is one row from then on.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..sources.scratch import written

#: Values of a sketch that are looked at, its accuracy, rounds at most, and the
#: rows inside a bracket that end them (by distinct values, one task counts them).
STEPS, ACCURACY, ROUNDS, FEW = 512, 20_000, 4, 100_000
#: Places (group and cut) that go through the driver, some 100 bytes each; more
#: are written and shuffled.
MOST_PLACES = 100_000


def _settled(places: DataFrame, few: bool) -> DataFrame:
    """Places as they are now, without what they came from."""
    return places.sparkSession.createDataFrame(places.toArrow()) if few else written(places, "ranks")


def _with(rows: DataFrame, places: DataFrame, keys: list[str], few: bool) -> DataFrame:
    p = places.withColumnsRenamed({k: f"{k}__p" for k in keys})
    on = reduce(Column.__and__, [F.col(k).eqNullSafe(F.col(f"{k}__p")) for k in keys]) if keys else F.lit(True)
    return rows.join(F.broadcast(p) if few else p, on).drop(*[f"{k}__p" for k in keys])


def places(df: DataFrame, keys: list[str], value: str, wanted: DataFrame) -> DataFrame:
    """(keys, cut, k, value, below, equal): the value at place k, from 1, of each
    group's sorted values, how many rows are less and how many equal it. `wanted`
    is (keys, cut, k); null values don't count, places beyond a group's end and
    groups without rows give no row. Groups are matched null-safely."""
    few = wanted.limit(MOST_PLACES + 1).count() <= MOST_PLACES
    by = [*keys, "cut", "k"]
    base = df.where(F.col(value).isNotNull()).select(*keys, F.col(value).alias("v__"))
    now = _settled(wanted.select(*by), few).select(*by, F.lit(0).cast("bigint").alias("below"), F.lit(None).cast(base.schema["v__"].dataType).alias("low"), F.lit(None).cast(base.schema["v__"].dataType).alias("high"))

    def inside(p: DataFrame) -> DataFrame:
        return _with(base, p, keys, few).where(F.col("low").isNull() | F.col("v__").between(F.col("low"), F.col("high")))

    values = F.expr(f"percentile_approx(v__, array({', '.join(f'{i / STEPS!r}D' for i in range(STEPS + 1))}), {ACCURACY})")
    for _ in range(ROUNDS):
        sketch = inside(now).groupBy(*by, "below").agg(F.count("*").alias("n"), values.alias("s"))
        at = sketch.withColumn("at", (F.col("k") - F.col("below")) / F.col("n") * STEPS)
        low = F.element_at("s", F.greatest(F.lit(1), F.floor("at").cast("int") - 1))
        high = F.element_at("s", F.least(F.lit(STEPS + 1), F.ceil("at").cast("int") + 3))
        if dict(base.dtypes)["v__"] == "bigint":  # the sketch holds doubles
            low, high = low - F.shiftright(F.abs(low), 52), high + F.shiftright(F.abs(high), 52)
        bracket = _settled(at.where("at > 0 AND k - below <= n").select(*by, low.alias("low"), high.alias("high")), few)
        v = F.col("v__")
        counts = _with(base, bracket, keys, few).groupBy(*by, "low", "high").agg(F.count_if(v < F.col("low")).alias("below"), F.count_if(v.between(F.col("low"), F.col("high"))).alias("inside"))
        now = _settled(counts, few)
        if (now.agg(F.max("inside")).first()[0] or 0) <= FEW:
            break
    found = inside(now).groupBy(*by, "below", "v__").agg(F.count("*").alias("equal"))
    upto = F.col("below") + F.sum("equal").over(Window.partitionBy(*by).orderBy("v__"))
    hit = found.withColumn("upto", upto).where((F.col("upto") >= F.col("k")) & (F.col("upto") - F.col("equal") < F.col("k")))
    return _settled(hit.select(*by, F.col("v__").alias(value), (F.col("upto") - F.col("equal")).alias("below"), "equal"), few)


def sizes(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    return df.where(F.col(value).isNotNull()).groupBy(*keys).agg(F.count("*").alias("n"))


def _wanted(n: DataFrame, keys: list[str], cuts: dict[str, Column]) -> DataFrame:
    """(keys, cut, k) of places as expressions of n."""
    return n.select(*keys, F.inline(F.array(*[F.struct(F.lit(name).alias("cut"), k.cast("bigint").alias("k")) for name, k in cuts.items()])))


def _wide(found: DataFrame, keys: list[str], cuts: list[str], value: str) -> DataFrame:
    return found.groupBy(*keys).agg(*[F.max(F.when(F.col("cut") == c, F.col(value))).alias(c) for c in cuts])


def nearest_ranks(df: DataFrame, keys: list[str], value: str, shares: dict[str, float]) -> DataFrame:
    """(keys, and a column a share): the least value that at least that share of
    the group's values don't exceed."""
    cuts = {name: F.greatest(F.lit(1), F.ceil(F.lit(p).cast("decimal(10,6)") * F.col("n"))) for name, p in shares.items()}
    return _wide(places(df, keys, value, _wanted(sizes(df, keys, value), keys, cuts)), keys, list(shares), value)


def medians(df: DataFrame, keys: list[str], value: str, name: str = "median") -> DataFrame:
    """(keys, median): the middle value, or the mean of the two."""
    cuts = {"lower__": F.expr("(n + 1) div 2"), "upper__": F.expr("n div 2 + 1")}
    m = _wide(places(df, keys, value, _wanted(sizes(df, keys, value), keys, cuts)), keys, list(cuts), value)
    return m.select(*keys, ((F.col("lower__") + F.col("upper__")) / 2).alias(name))


def tiles(df: DataFrame, keys: list[str], value: str, tie: str, last: list[Column], name: str) -> DataFrame:
    """df with `name`: of how many of the places `last` (from 1, expressions of
    the group's size n) a row lies beyond, when its group is sorted by value, then
    tie; null where the value is null. The ties of a cut are looked for only among
    the rows that share its value, in the same way."""
    cuts = {f"{i}": k for i, k in enumerate(last)}
    at = places(df, keys, value, _wanted(sizes(df, keys, value), keys, cuts))
    edge = at.select(*keys, F.col("cut").alias("edge"), F.col(value).alias("edge__v"), (F.col("k") - F.col("below")).alias("place"))
    few = edge.limit(MOST_PLACES + 1).count() <= MOST_PLACES
    rows = df.where(F.col(value).isNotNull()).select(*keys, F.col(value).alias("v__"), F.col(tie).alias("tie__"))
    same = _with(rows, edge.drop("place"), keys, few).where("v__ = edge__v").select(*keys, "edge", "tie__")
    ties = places(same, [*keys, "edge"], "tie__", edge.select(*keys, "edge", F.lit("tie").alias("cut"), F.col("place").alias("k")))
    edges = _with(edge, ties.select(*keys, "edge", "tie__"), [*keys, "edge"], few)
    edges = edges.groupBy(*keys).agg(F.collect_list(F.struct("edge__v", "tie__")).alias("edges__"))
    here = F.struct(F.col(value).alias("edge__v"), F.col(tie).alias("tie__"))
    p = edges.withColumnsRenamed({k: f"{k}__p" for k in keys})
    on = reduce(Column.__and__, [F.col(k).eqNullSafe(F.col(f"{k}__p")) for k in keys]) if keys else F.lit(True)
    beyond = F.when(F.col(value).isNotNull(), F.size(F.filter("edges__", lambda e: e < here)))
    return df.join(F.broadcast(p) if few else p, on, "left").withColumn(name, beyond).drop("edges__", *[f"{k}__p" for k in keys])


def beside(groups: DataFrame, more: DataFrame, keys: list[str]) -> DataFrame:
    """groups with the columns of more, both one row a group; null keys are equal,
    groups that `more` lacks get nulls."""
    p = more.withColumnsRenamed({k: f"{k}__p" for k in keys})
    on = reduce(Column.__and__, [F.col(k).eqNullSafe(F.col(f"{k}__p")) for k in keys])
    return groups.join(p, on, "left").drop(*[f"{k}__p" for k in keys])


def quartiles(df: DataFrame, keys: list[str], value: str, tie: str, name: str = "quartile") -> DataFrame:
    """df with floor(4 i / n) of the sorted place i, from 0: 0 to 3."""
    return tiles(df, keys, value, tie, [F.expr(f"({q} * n + 3) div 4") for q in (1, 2, 3)], name)


def ntile4(df: DataFrame, keys: list[str], value: str, tie: str, name: str = "quartile") -> DataFrame:
    """df with SQL's ntile(4): 1 to 4, the first groups larger by one row."""
    return tiles(df, keys, value, tie, [F.expr(f"{q} * (n div 4) + least({q}, n % 4)") for q in (1, 2, 3)], name).withColumn(name, F.col(name) + 1)
