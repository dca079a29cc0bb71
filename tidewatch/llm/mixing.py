"""Mixing sources to target weights by hash-threshold histograms."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import stash

#: Of a row's 60-bit hash, each level of the histogram takes the next 12 bits.
BITS, LEVELS = 12, 3


def word_count(text: Column) -> Column:
    """Number of words [^\\x20\\x09-\\x0D]+; null counts 0."""
    one = F.regexp_replace(text, r"[^\x20\x09-\x0D]+", "w")
    return F.coalesce(F.length(F.regexp_replace(one, r"[\x20\x09-\x0D]+", "")), F.lit(0)).cast("long")


def row_hash(key: Column, text: Column) -> Column:
    """60 uniform bits of the key (of the text where the key is null)."""
    h = F.md5(F.coalesce(key.cast("string"), text, F.lit("")).cast("binary"))
    return F.conv(F.substring(h, 1, 15), 16, 10).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = (5, 2, 1), most: int = 3) -> DataFrame:
    """sizes: (source, source_size), one row per source. Sources in code point
    order, null last, take the weights in turn and share the sum of all sizes;
    no target exceeds `most` times its source's size, and what is cut off goes
    to the others by weight until none is above. Closed form: with sources in
    ascending order of most * size / weight, the first k are capped where the
    share left per unit of weight exceeds their ratio. Windows here run over
    the table of sources, not over documents.
    """
    order = Window.orderBy(F.col("source").isNull().cast("int"), F.col("source"))
    n = len(weights)
    rank = (F.row_number().over(order) - 1) % n
    weight = reduce(lambda c, i: c.when(rank == i, weights[i]), range(1, n), F.when(rank == 0, weights[0]))
    w = sizes.withColumn("weight", weight.cast("long")).withColumn("cap", most * F.col("source_size"))
    by_ratio = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").isNull().cast("int"), "source")
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    after = by_ratio.rowsBetween(0, Window.unboundedFollowing)
    everything = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    w = w.select("*", F.sum("source_size").over(everything).alias("total"), F.coalesce(F.sum("cap").over(before), F.lit(0)).alias("capped"), F.sum("weight").over(after).alias("open"), F.row_number().over(by_ratio).alias("at"))
    level = (F.col("total") - F.col("capped")).cast("double") / F.col("open")
    w = w.withColumn("level", level).withColumn("fits", F.col("level") * F.col("weight") <= F.col("cap"))
    first = F.min(F.when(F.col("fits"), F.struct("at", "level"))).over(everything)
    w = w.withColumn("first", first)
    free = F.col("first").isNotNull() & (F.col("at") >= F.col("first.at"))
    target = F.when(free, F.least(F.col("first.level") * F.col("weight"), F.col("cap").cast("double"))).otherwise(F.col("cap").cast("double"))
    return w.select("source", "source_size", F.coalesce(target, F.lit(0.0)).alias("target"))


def mix(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", weights: tuple[int, ...] = (5, 2, 1), most: int = 3) -> DataFrame:
    """Per row of docs: key, `size` (words; null text 0), `source_size`,
    `target` (its source's, see source_targets) and `copies` (0 to `most`).

    Each source's rows are taken floor(target / size of source) times; the rest
    of the budget goes to the rows whose hash lies under the source's threshold.
    The threshold comes from nested histograms: words by (source, hash bucket),
    running sums within a source's 4,096 buckets, then a finer histogram of the
    one bucket in which the budget ends, three levels deep. Nothing is sorted
    but buckets, texts are read once, and a hot source costs no more than
    others: sums are combined before the shuffle.

    A row without words takes part with size 0. Rows with equal key (or null
    keys and equal text) have one hash and are taken together. A null source is
    a source. An empty table gives an empty one. Other columns are not used.
    """
    d = docs.select(F.col(key).alias("id"), F.col(source).alias("source"), word_count(F.col(text)).alias("size"), row_hash(F.col(key), F.col(text)).alias("hash"))
    d = stash(d, "mix")
    t = thresholds(d, weights, most)
    out = d.join(t, F.col("source").eqNullSafe(F.col("s")))
    return out.select(F.col("id").alias(key), "size", "source_size", "target", _copies(most).alias("copies"))


def _copies(most: int) -> Column:
    return F.least(F.lit(most), F.col("whole") + (F.col("hash") < F.col("limit")).cast("int"))


def thresholds(d: DataFrame, weights: tuple[int, ...], most: int) -> DataFrame:
    """(s, source_size, target, whole, limit), one row per source of d (source,
    size, hash): its rows are taken `whole` times, and once more where their
    hash is under `limit`; see mix."""
    targets = source_targets(d.groupBy("source").agg(F.sum("size").alias("source_size")), weights, most)
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    whole = F.least(F.floor(ratio + 1e-12), F.lit(most)).cast("int")
    t = targets.withColumn("whole", whole).withColumn("budget", F.greatest(F.lit(0.0), F.col("target") - F.col("whole") * F.col("source_size")))
    t = t.withColumn("low", F.lit(0).cast("long")).withColumn("got", F.lit(0).cast("long"))
    for k in range(LEVELS):
        shift = 60 - BITS * (k + 1)
        cut = stash(t, "mix-thresholds")
        if k == 0:
            h = d.groupBy("source", F.shiftright("hash", shift).alias("bucket")).agg(F.sum("size").alias("words"))
        else:
            edge = cut.select(F.col("source").alias("s"), F.shiftright("low", shift + BITS).alias("coarse"))
            inside = d.join(edge, d["source"].eqNullSafe(edge["s"]) & (F.shiftright(d["hash"], shift + BITS) == edge["coarse"]), "left_semi")
            h = inside.groupBy("source", F.shiftright("hash", shift).alias("bucket")).agg(F.sum("size").alias("words"))
        c = cut.withColumnRenamed("source", "s")
        upto = Window.partitionBy("source").orderBy("bucket")
        h = h.withColumn("sum", F.sum("words").over(upto)).join(c.select("s", "budget", "got"), F.col("source").eqNullSafe(F.col("s")))
        # the boundary bucket: the last whose rows before it fit the budget
        start = F.col("got") + F.col("sum") - F.col("words")
        fit = h.where(start.cast("double") <= F.col("budget")).groupBy("source").agg(F.max(F.struct("bucket", start.alias("start"), "words")).alias("b"))
        fit = fit.select(F.col("source").alias("s2"), F.shiftleft("b.bucket", shift).alias("low2"), F.col("b.start").alias("start"), F.col("b.words").alias("words"))
        t = cut.drop("words").join(fit, F.col("source").eqNullSafe(F.col("s2")), "left")
        t = t.select("source", "source_size", "target", "whole", "budget", F.coalesce("low2", "low").alias("low"), F.coalesce("start", "got").alias("got"), F.coalesce("words", F.lit(0)).alias("words"))
    # the last boundary bucket is taken whole if that comes nearer to the budget
    over = F.col("got") + F.col("words") - F.col("budget") < F.col("budget") - F.col("got")
    limit = F.col("low") + F.when(over, F.lit(1 << (60 - BITS * LEVELS)).cast("long")).otherwise(F.lit(0).cast("long"))
    limit = F.when(F.col("budget") > 0, limit).otherwise(F.lit(0).cast("long"))
    return stash(t.select(F.col("source").alias("s"), "source_size", "target", "whole", limit.alias("limit")), "mix-limits")


def op1(docs: DataFrame) -> DataFrame:
    return mix(docs).select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"), "copies")


def mixed_documents(docs: DataFrame, weights: tuple[int, ...] = (5, 2, 1), most: int = 3) -> DataFrame:
    """The rows of docs, each as often as the mix takes it: a row's copies follow
    from its source and its hash alone, so texts don't move; the table of
    thresholds has one row per source, and Spark broadcasts it by its size.
    Rows that share a source and a key have one hash and are taken together,
    those with a null key by their text; see mix for the other cases."""
    hash_, size = row_hash(F.col("doc_id"), F.col("text")), word_count(F.col("text"))
    t = thresholds(stash(docs.select("source", size.alias("size"), hash_.alias("hash")), "mix"), weights, most)
    d = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col("source").alias("from"), hash_.alias("hash"))
    taken = d.join(t, F.col("from").eqNullSafe(F.col("s"))).select("row", _copies(most).alias("copies")).where("copies > 0")
    return taken.select("row", F.explode(F.sequence(F.lit(1), F.col("copies")))).select("row.*")


ORACLE = r"""
WITH d AS (
  SELECT doc_id, source,
         CASE WHEN text IS NULL THEN 0 ELSE len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) END::BIGINT AS size,
         ('0x' || substr(md5(coalesce(doc_id::VARCHAR, text, '')), 1, 15))::BIGINT >> 24 AS h
  FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (SELECT *, [5, 2, 1][1 + ((row_number() OVER (ORDER BY source IS NULL, encode(source)) - 1) % 3)] AS weight, 3 * source_size AS cap FROM s),
r AS (SELECT *, sum(source_size) OVER () AS total,
         coalesce(sum(cap) OVER (ORDER BY cap / weight, source IS NULL, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS capped,
         sum(weight) OVER (ORDER BY cap / weight, source IS NULL, source ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS open,
         row_number() OVER (ORDER BY cap / weight, source IS NULL, source) AS nth FROM w),
l AS (SELECT *, (total - capped)::DOUBLE / open::DOUBLE AS level FROM r),
f AS (SELECT min(nth) AS nth, arg_min(level, nth) AS level FROM l WHERE level * weight <= cap),
t AS (SELECT source, source_size,
         CASE WHEN f.nth IS NOT NULL AND l.nth >= f.nth THEN least(f.level * weight, cap::DOUBLE) ELSE cap::DOUBLE END AS target
      FROM l LEFT JOIN f ON true),
b AS (SELECT *, CASE WHEN source_size > 0 THEN least(floor(target / source_size + 1e-12), 3) ELSE 0 END::BIGINT AS whole FROM t),
g AS (SELECT *, greatest(0.0, target - whole * source_size) AS budget FROM b),
u AS (SELECT source, h, sum(size)::BIGINT AS words FROM d GROUP BY source, h),
v AS (SELECT u.*, sum(words) OVER (PARTITION BY source ORDER BY h) AS upto FROM u),
e AS (SELECT v.source, max(v.h) AS h, arg_max(upto - words, v.h) AS got, arg_max(words, v.h) AS words
      FROM v JOIN g ON v.source IS NOT DISTINCT FROM g.source WHERE upto - words <= budget GROUP BY v.source),
x AS (SELECT g.*, CASE WHEN budget > 0 THEN e.h + CASE WHEN got + words - budget < budget - got THEN 1 ELSE 0 END ELSE 0 END AS lim
      FROM g JOIN e ON g.source IS NOT DISTINCT FROM e.source)
SELECT doc_id, size, source_size, target, size * least(3, whole + (h < lim)::INT)::BIGINT AS taken, least(3, whole + (h < lim)::INT)::INT AS copies
FROM d JOIN x ON d.source IS NOT DISTINCT FROM x.source
"""
