"""Counting points in two dimensions without comparing pairs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..sources.scratch import written

#: Children of a node of the tree of places; slices of a node by value.
RADIX, SLICES = 8, 64


def _running(u: DataFrame, keys: list[str], order: list[str], sums: dict[str, Column], slice_: str) -> DataFrame:
    """u with running sums over its groups in order, computed within slices of a
    group onto the sums of the slices before: no task holds a whole group."""
    here = Window.partitionBy(*keys, slice_).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy(*keys).orderBy(slice_).rowsBetween(Window.unboundedPreceding, -1)
    totals = u.groupBy(*keys, slice_).agg(*[F.sum(x).alias(f"{n}__t") for n, x in sums.items()])
    totals = totals.select(*keys, slice_, *[F.coalesce(F.sum(f"{n}__t").over(before), F.lit(0)).alias(f"{n}__b") for n in sums])
    inside = u.select("*", *[F.coalesce(F.sum(x).over(here), F.lit(0)).alias(f"{n}__h") for n, x in sums.items()])
    out = inside.join(totals, [*keys, slice_])
    return out.select(*u.columns, *[(F.col(f"{n}__h") + F.col(f"{n}__b")).alias(n) for n in sums])


def _slices(df: DataFrame, column: str) -> Column:
    """A number that grows with the column, from approximate quantiles: SLICES
    numbers come to the driver."""
    edges = df.select(F.percentile_approx(F.col(column).cast("double"), [(i + 1) / SLICES for i in range(SLICES - 1)], 1000)).first()[0]
    edges = sorted(set(edges or [0.0]))
    return F.size(F.filter(F.array(*map(F.lit, edges)), lambda e: e < F.col(column)))


def counts_in_ranges(points: DataFrame, low: Column, high: Column) -> DataFrame:
    """(id, inside, valued, at_most) for every row of points (id, x, y): how many
    points have an x in [low, high] (expressions of x), how many of them have a
    y, and how many have a y at most its own; 0 for a null y, itself counted.

    Distinct x are numbered in order, once; a range of x is then one of places.
    Places form a tree of eight children a node: the points before a place are,
    level by level, those of the same parent in an earlier child, so each point
    and each query is one row a level. Within a parent, rows are read in the
    order of y with a running count per child. Work is n log n; parents and the
    list of x are cut into slices, which hand their counts on.
    """
    points = written(points, "points")
    xs = points.groupBy("x").agg(F.count("*").alias("all"), F.count("y").alias("valued")).where("x IS NOT NULL")
    probes = xs.select(F.col("x").alias("of"), F.inline(F.array(F.struct(low.cast("double").alias("x"), F.lit(0).alias("kind")), F.struct(high.cast("double").alias("x"), F.lit(2).alias("kind")))))
    u = xs.select(F.col("x").cast("double").alias("x"), F.lit(1).alias("kind"), F.col("x").alias("of"), F.lit(1).alias("one"), "all", "valued").unionByName(probes, allowMissingColumns=True)
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("bigint")
    sums = {"places": zero("one"), "n_all": zero("all"), "n_valued": zero("valued")}
    run = _running(u.withColumn("slice", _slices(xs, "x")).withColumn("list", F.lit(0)), ["list"], ["x", "kind"], sums, "slice")
    at = lambda kind, c: F.max(F.when(F.col("kind") == kind, F.col(c)))
    ranges = run.groupBy(F.col("of").alias("x")).agg(
        (at(1, "places") - 1).alias("place"), at(0, "places").alias("first"), at(2, "places").alias("end"),
        (at(2, "n_all") - at(0, "n_all")).alias("inside"), (at(2, "n_valued") - at(0, "n_valued")).alias("valued"),
    )
    p = written(points.join(ranges, "x"), "ranges")
    n_places, levels = xs.count(), 1
    while RADIX**levels < n_places + 1:
        levels += 1
    level = F.explode(F.sequence(F.lit(0), F.lit(levels - 1)))
    weights = p.where("y IS NOT NULL").groupBy("place", "y").agg(F.count("*").alias("w"))
    ends = F.inline(F.array(F.struct(F.col("first").alias("place"), F.lit(-1).alias("sign")), F.struct(F.col("end").alias("place"), F.lit(1).alias("sign"))))
    asks = p.where("y IS NOT NULL").select("id", "y", ends)
    v = weights.select("place", "y", "w", F.lit(0).alias("kind")).unionByName(asks.withColumn("kind", F.lit(1)), allowMissingColumns=True)
    v = v.select("*", level.alias("level"), _slices(points, "y").alias("slice"))
    v = v.withColumn("child", F.expr(f"place div cast(pow({RADIX}, level) as bigint) % {RADIX}")).withColumn("parent", F.expr(f"place div cast(pow({RADIX}, level + 1) as bigint)"))
    upto = {f"c{k}": F.when(F.col("child") < k, zero("w")).otherwise(F.lit(0).cast("bigint")) for k in range(1, RADIX)}
    r = _running(v, ["level", "parent"], ["y", "kind"], upto, "slice").where("kind = 1")
    found = F.element_at(F.array(F.lit(0).cast("bigint"), *[F.col(c) for c in upto]), F.col("child").cast("int") + 1)
    below = r.groupBy("id").agg(F.sum(found * F.col("sign")).alias("at_most"))
    return p.select("id", "inside", "valued").join(below, "id", "left").select("id", "inside", "valued", zero("at_most").alias("at_most"))
