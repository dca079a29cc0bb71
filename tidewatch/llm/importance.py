"""Importance resampling of documents towards a target's distribution."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import stash

#: Words: digits, letters a-z and all beyond ASCII.
FEATURE_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def feature_words(text: Column) -> Column:
    """Words of a text whose A-Z are lower-cased, no other letter; null has none.
    lower() does that for ASCII texts, at a fraction of translate()'s cost."""
    low = F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, CAPITALS, CAPITALS.lower()))
    return F.coalesce(F.regexp_extract_all(low, F.lit(FEATURE_WORD), F.lit(0)), F.array().cast("array<string>"))


def feature_buckets(words: Column, longest: int, buckets: int) -> Column:
    """One bucket per run of 1 to `longest` consecutive words, joined by one
    space, repeats included: crc32 modulo `buckets`."""

    def of(feature: Column) -> Column:
        return (F.crc32(feature.cast("binary")) % buckets).cast("int")

    def runs(w: Column, k: int) -> Column:
        starts = F.when(F.size(w) >= k, F.sequence(F.lit(1), F.size(w) - (k - 1))).otherwise(F.array().cast("array<int>"))
        return F.transform(starts, lambda i: of(F.array_join(F.slice(w, i, k), " ")))

    # bound to a name, words aren't made again for every run
    return F.transform(F.array(words), lambda w: F.concat(F.transform(w, of), *[runs(w, k) for k in range(2, longest + 1)]))[0]


def bucket_totals(df: DataFrame, text: str, longest: int, buckets: int) -> dict[int, int]:
    """How many features of all texts fall in each bucket; at most `buckets`
    totals come to the driver, summed before the shuffle."""
    b = df.select(F.explode(feature_buckets(feature_words(F.col(text)), longest, buckets)).alias("bucket"))
    return {r["bucket"]: r["n"] for r in b.groupBy("bucket").agg(F.count("*").alias("n")).collect()}


def gains(have: dict[int, int], want: dict[int, int], buckets: int) -> np.ndarray:
    """floor(1000 ln) of each bucket's smoothed share of the target's features
    over its share of the documents', in doubles."""
    s, t = float(sum(have.values())), float(sum(want.values()))
    ratio = [(want.get(b, 0) + 1.0) * (s + buckets) / ((have.get(b, 0) + 1.0) * (t + buckets)) for b in range(buckets)]
    return np.array([math.floor(1000 * math.log(r)) for r in ratio], dtype=np.int64)


def ranks(rows: DataFrame, order: list[Column]) -> DataFrame:
    """rows and `place`, their place in `order` from 1: sorted by ranges, each
    range numbered from its start, and the starts are running sums of the
    ranges' sizes (a window over one row per range, not over rows)."""
    placed = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("place__", F.monotonically_increasing_id())
    placed = stash(placed, "ranks").withColumn("range__", F.shiftright("place__", 33)).withColumn("place__", F.col("place__").bitwiseAND((1 << 33) - 1))
    sizes = placed.groupBy("range__").agg(F.count("*").alias("size__"))
    before = Window.orderBy("range__").rowsBetween(Window.unboundedPreceding, -1)
    starts = stash(sizes.select("range__", F.coalesce(F.sum("size__").over(before), F.lit(0)).alias("start__")), "ranks-starts")
    return placed.join(F.broadcast(starts), "range__").withColumn("place", F.col("start__") + F.col("place__") + 1).drop("range__", "start__", "place__")


def resample(
    docs: DataFrame, target: DataFrame, key: str = "doc_id", text: str = "text", target_text: str = "text",
    longest: int = 1, buckets: int = 10_000, share: int = 10, least: int = 20, seed: int = 2024,
) -> DataFrame:
    """Per row of docs: key, n_features, weight, score and rank, all long.

    weight is the sum over a document's features of their buckets' gains: of the
    features of `target` against those of docs. score adds Gumbel noise from the
    key, so the highest scores are a draw without replacement in proportion to
    exp(weight / 1000). Of the documents with `least` words and more, `share` in
    a hundred are drawn; `rank` counts them from the highest score, ties by
    smaller key, the others' is null.

    Texts are read twice, for the totals and for the weights, and never
    exploded for the weights: the array of a document's buckets is summed over
    the array of gains, a literal. A null text has no features; a null key is
    written as empty text in the noise and comes last among ties; rows that
    share a key share its noise and each has its own rank. An empty table gives
    an empty one; an empty target leaves all buckets its smoothing.
    """
    gain = F.lit(gains(bucket_totals(docs, text, longest, buckets), bucket_totals(target, target_text, longest, buckets), buckets))
    d = docs.select(F.col(key).alias("id"), feature_words(F.col(text)).alias("words"))
    d = d.select("id", F.size("words").alias("n_words"), feature_buckets(F.col("words"), longest, buckets).alias("buckets"))
    weight = F.aggregate("buckets", F.lit(0).cast("long"), lambda a, b: a + F.element_at(gain, b + 1))
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("id").cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("long")
    noise = F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0)))
    d = d.select("id", (F.col("n_words") >= least).alias("open"), F.size("buckets").cast("long").alias("n_features"), weight.alias("weight"), noise.alias("noise"))
    d = stash(d.select("id", "open", "n_features", "weight", (F.col("weight") + F.col("noise")).alias("score")), "resample")
    drawn = (d.where("open").count() * share) // 100
    order = [F.col("open").desc(), F.col("score").desc(), F.col("id").isNull(), F.col("id"), F.col("n_features"), F.col("weight")]
    rank = F.when(F.col("open") & (F.col("place") <= drawn), F.col("place"))
    return ranks(d, order).select(F.col("id").alias(key), "n_features", "weight", "score", rank.alias("rank"))


def op13(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    return resample(docs, benchmark)


ORACLE = r"""
WITH crc AS (SELECT [list_reduce(list_concat([n], [-1, -1, -1, -1, -1, -1, -1, -1]), lambda c, i: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END) FOR n IN range(256)] AS t),
d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM documents),
b AS (SELECT regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM benchmark),
u AS (SELECT doc_id, unnest(words) AS word FROM d),
v AS (SELECT unnest(words) AS word FROM b),
k AS (SELECT DISTINCT word, hex(encode(word)) AS h FROM (SELECT word FROM u UNION SELECT word FROM v)),
y AS (SELECT word, [('0x' || substr(h, 2 * i + 1, 2))::BIGINT FOR i IN range(length(h) // 2)] AS bytes FROM k),
z AS (SELECT word, xor(4294967295, list_reduce(list_concat([4294967295], bytes), lambda c, x: xor(c // 256, crc.t[xor(c, x) % 256 + 1]))) % 10000 AS bucket FROM y, crc),
s AS (SELECT bucket, count(*) AS s FROM u JOIN z USING (word) GROUP BY bucket),
t AS (SELECT bucket, count(*) AS t FROM v JOIN z USING (word) GROUP BY bucket),
n AS (SELECT (SELECT count(*) FROM u) AS total_s, (SELECT count(*) FROM v) AS total_t),
g AS (SELECT s.bucket, floor(1000 * ln((coalesce(t, 0) + 1)::DOUBLE * (total_s + 10000)::DOUBLE / ((s + 1)::DOUBLE * (total_t + 10000)::DOUBLE)))::BIGINT AS gain
      FROM n, s LEFT JOIN t ON s.bucket = t.bucket),
w AS (SELECT doc_id, count(*) AS n_features, sum(gain)::BIGINT AS weight FROM u JOIN z USING (word) JOIN g USING (bucket) GROUP BY doc_id),
r AS (SELECT doc_id, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight,
             ('0x' || substr(sha256('2024:' || doc_id), 1, 8))::BIGINT AS h FROM d LEFT JOIN w USING (doc_id)),
c AS (SELECT doc_id, n_features, weight, weight + floor(-1000 * ln(-ln((h + 0.5)::DOUBLE / 4294967296::DOUBLE)))::BIGINT AS score FROM r),
o AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS place, count(*) OVER () AS n FROM c WHERE n_features >= 20)
SELECT c.doc_id, c.n_features, c.weight, c.score, CASE WHEN o.place <= n * 10 // 100 THEN o.place END AS rank
FROM c LEFT JOIN o USING (doc_id)
"""
