"""Latest per key, as-of and nearest joins, each with one shuffle of the key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F


def latest(df: DataFrame, keys: list[str], order: list[str], cols: list[str]) -> DataFrame:
    """The row of each key with the greatest order; aggregates on the map side."""
    return df.groupBy(*keys).agg(F.max_by(F.struct(*cols), F.struct(*order)).alias("r")).select(*keys, "r.*")


def as_of(left: DataFrame, right: DataFrame, key: str, time: str, tie: str, cols: list[str], grace: int = 0, tolerance: int | None = None, forward: bool = False, bucket: int | None = None) -> DataFrame:
    """left with struct `match` of the right columns: the last right row at or
    before left time + grace (ties by the greatest tie), null if none or if it
    is further than tolerance. forward: the first at or after instead.

    Rows of both sides are tagged, united and read in time order by one window
    per key, so there is no range join and one exchange. Left rows with a null
    key match nothing. `bucket`, a length of time, splits keys with very many
    rows: windows are per key and bucket, and a left row without a match in its
    own takes the last right row of the buckets before (of those after, if
    forward), from a table of one row per key and bucket."""
    l = left.select("*", F.col(time).alias("lt"), (F.col(time) + (-grace if forward else grace)).alias("o"), F.lit(1).alias("side"), F.lit(None).cast(right.schema[tie].dataType).alias("rtie"))
    r = right.select(F.col(key), F.col(time).alias("o"), F.lit(0).alias("side"), F.col(tie).alias("rtie"), F.struct(F.col(time).alias("t"), F.col(tie), *[c for c in cols if c not in (time, tie)]).alias("r"))
    u = l.unionByName(r, allowMissingColumns=True)
    part = [key] if bucket is None else [key, "bucket__"]
    if bucket is not None:
        u = u.withColumn("bucket__", F.floor(F.col("o") / bucket))
    if forward:
        w = Window.partitionBy(*part).orderBy(F.col("o").desc(), "side", F.col("rtie")).rowsBetween(Window.unboundedPreceding, 0)
    else:
        w = Window.partitionBy(*part).orderBy("o", "side", "rtie").rowsBetween(Window.unboundedPreceding, 0)
    match = F.last("r", ignorenulls=True).over(w)
    out = u.withColumn("match", match).where("side = 1")
    if bucket is not None:
        # what each bucket of a key hands on, over the buckets that hold anything
        b = u.where(F.col(key).isNotNull())
        far = F.struct(F.when(F.lit(forward), -F.col("o")).otherwise(F.col("o")), "rtie")
        ends = b.groupBy(key, "bucket__").agg(F.max_by("r", F.when(F.col("side") == 0, far)).alias("end__"))
        over = Window.partitionBy(key).orderBy(F.desc("bucket__") if forward else F.asc("bucket__")).rowsBetween(Window.unboundedPreceding, -1)
        ends = ends.select(key, "bucket__", F.last("end__", ignorenulls=True).over(over).alias("carried__"))
        out = out.join(ends, [key, "bucket__"], "left").withColumn("match", F.coalesce("match", "carried__"))
    if tolerance is not None:
        out = out.withColumn("match", F.when(F.abs(F.col("lt") - F.col("match.t")) <= tolerance, F.col("match")))
    return out.withColumn("match", F.when(F.col(key).isNotNull(), F.col("match"))).select(*left.columns, "match")


def as_of_all(left: DataFrame, rights: dict[str, DataFrame], key: str, time: str, tie: str, tolerance: dict[str, int] | None = None) -> DataFrame:
    """left with, for each right table by name, a struct of its columns: its last
    row at or before left time (ties by the greatest tie), null if none or if it
    is further than its tolerance; and <name>_n, how many rows there were until
    then. All tables are united and read by one window per key: one exchange,
    however many they are. Left rows with a null key match nothing."""
    u = left.select("*", F.col(time).alias("o"), F.lit(1).alias("side"), F.lit(None).cast(left.schema[tie].dataType).alias("rtie"))
    for name, right in rights.items():
        u = u.unionByName(right.select(F.col(key), F.col(time).alias("o"), F.lit(0).alias("side"), F.col(tie).alias("rtie"), F.struct(F.col(time).alias("t"), *[c for c in right.columns if c not in (time, key)]).alias(name)), allowMissingColumns=True)
    w = Window.partitionBy(key).orderBy("o", "side", "rtie").rowsBetween(Window.unboundedPreceding, 0)
    out = u.select("*", *[F.last(n, ignorenulls=True).over(w).alias(f"{n}__m") for n in rights], *[F.count(n).over(w).alias(f"{n}__n") for n in rights]).where("side = 1")
    here = F.col(key).isNotNull()
    near = lambda n: (F.col(time) - F.col(f"{n}__m.t") <= tolerance[n]) if n in (tolerance or {}) else F.lit(True)
    return out.select(*left.columns, *[F.when(here & near(n), F.col(f"{n}__m")).alias(n) for n in rights], *[F.when(here, F.col(f"{n}__n")).otherwise(0).alias(f"{n}_n") for n in rights])


def latest_other(left: DataFrame, right: DataFrame, key: str, own: str, time: str, tie: str, cols: list[str], within: int | None = None, bucket: int | None = None) -> DataFrame:
    """left with `other`: the last right row of the same key but another `own`
    that comes before it by (time, tie), null if there is none, or none in the
    last `within`. Rows with a null key match nothing; a null `own` differs from
    none.

    One window per key carries two rows on: the last one, and the last one before
    it of another `own`; one of them is the answer whatever the left row's `own`.
    `bucket`, a length of time, splits keys with very many rows: windows are per
    key and bucket, and what the buckets before hand on comes from a table of two
    rows per key and bucket."""
    cols = list(dict.fromkeys([time, tie, own, *cols]))
    l = left.where(F.col(key).isNotNull()).select("*", F.lit(1).alias("side__"), F.lit(None).cast(right.select(F.struct(*cols)).schema[0].dataType).alias("r__"))
    r = right.where(F.col(key).isNotNull() & F.col(own).isNotNull()).select(F.col(key), F.col(time), F.col(tie), F.lit(0).alias("side__"), F.struct(*cols).alias("r__"))

    def carried(rows: DataFrame, part: list[str]) -> DataFrame:
        """rows with `last__` and `before__`, up to and with the row itself."""
        w = Window.partitionBy(*part).orderBy(time, tie, F.col("side__").desc())
        upto = w.rowsBetween(Window.unboundedPreceding, 0)
        d = rows.withColumn("last__", F.last("r__", ignorenulls=True).over(upto))
        previous = F.last("r__", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))
        d = d.withColumn("previous__", previous)
        turn = F.col("r__").isNotNull() & (F.col(f"r__.{own}") != F.col(f"previous__.{own}"))
        return d.withColumn("before__", F.last(F.when(turn, F.col("previous__")), ignorenulls=True).over(upto)).drop("previous__")

    def differs(c: str) -> Column:
        return F.when(F.col(f"{c}.{own}") != F.col(own), F.col(c))

    u = l.unionByName(r, allowMissingColumns=True)
    if bucket is None:
        out = carried(u, [key]).where("side__ = 1").withColumn("other", F.coalesce(differs("last__"), differs("before__")))
    else:
        u = u.withColumn("bucket__", F.floor(F.col(time) / bucket))
        inside = carried(u, [key, "bucket__"])
        out = inside.where("side__ = 1")
        at = F.struct(F.col(time), F.col(tie), -F.col("side__"))
        ends = inside.groupBy(key, "bucket__").agg(F.max_by(F.struct("last__", "before__"), at).alias("e"))
        two = ends.select(key, "bucket__", F.explode(F.array("e.before__", "e.last__")).alias("r__")).where("r__ IS NOT NULL")
        heads = out.select(key, "bucket__").distinct().select(key, "bucket__", F.lit(1).alias("side__"))
        rows = two.select(key, F.col("bucket__").alias("b__"), F.col(f"r__.{time}").alias(time), F.col(f"r__.{tie}").alias(tie), F.lit(0).alias("side__"), "r__")
        # a bucket's head comes before its own rows
        start = heads.select(key, F.col("bucket__").alias("b__"), (F.col("bucket__") * bucket).cast(left.schema[time].dataType).alias(time), "side__")
        handed = carried(rows.unionByName(start, allowMissingColumns=True), [key]).where("side__ = 1")
        handed = handed.select(F.col(key).alias("k__"), F.col("b__").alias("kb__"), F.col("last__").alias("last0__"), F.col("before__").alias("before0__"))
        out = out.join(handed, (F.col(key) == F.col("k__")) & (F.col("bucket__") == F.col("kb__")), "left")
        out = out.withColumn("other", F.coalesce(differs("last__"), differs("before__"), differs("last0__"), differs("before0__")))
    if within is not None:
        out = out.withColumn("other", F.when(F.col(time) - F.col(f"other.{time}") <= within, F.col("other")))
    nothing = left.where(F.col(key).isNull()).withColumn("other", F.lit(None).cast(out.schema["other"].dataType))
    return out.select(*left.columns, "other").unionByName(nothing)


def nearest(left: DataFrame, right: DataFrame, key: str, time: str, tie: str, cols: list[str]) -> DataFrame:
    """left with `match`, the right row of least distance in time; of equal
    distances the greatest tie."""
    back = as_of(left, right, key, time, tie, cols).withColumnRenamed("match", "back")
    both = as_of(back, right, key, time, tie, cols, forward=True).withColumnRenamed("match", "ahead")
    rank = lambda m: F.struct(-F.abs(F.col(time) - F.col(f"{m}.t")), F.col(f"{m}.{tie}"))
    ahead: Column = F.col("back").isNull() | (F.col("ahead").isNotNull() & (rank("ahead") > rank("back")))
    return both.withColumn("match", F.when(ahead, F.col("ahead")).otherwise(F.col("back"))).select(*left.columns, "match")


def assert_no_lookahead(df: DataFrame, asof: str, seen: Column) -> DataFrame:
    """df; the job fails at a row whose evidence `seen` is later than its as-of
    time."""
    bad = F.raise_error(F.concat(F.lit("evidence is later than "), F.col(asof).cast("string"))).cast("boolean")
    return df.where(F.when(seen > F.col(asof), bad).otherwise(True))
