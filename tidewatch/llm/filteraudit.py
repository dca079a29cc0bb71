"""What five filters take from each source, in every order of applying them."""

from __future__ import annotations

import json
from functools import reduce
from itertools import permutations

from pyspark.sql import Column, DataFrame, functions as F

from .common import join_bounded, stash

FILTERS = "ABCDE"
#: Bytes of a text's first block; each block is GROWTH times as long as the one before.
BLOCK, GROWTH = 256, 16
#: Rows of one class that meet its least row in one group of a shuffle.
MEMBERS = 1000


def failing(text: Column) -> Column:
    """Bits 0 to 3: the text fails A (under 200 words), B (fewer distinct words
    than half its words), C (more than 2 % of its code points are A-Z), D (holds
    one of # $ % & * |). Null counts as empty."""
    t = F.coalesce(text, F.lit(""))
    solid = F.btrim(t, F.lit(" \t\n\v\f\r"))
    words, none = F.split(solid, r"[\x20\x09-\x0D]+"), (solid == "").cast("long")
    n, kinds = F.size(words) - none, F.size(F.array_distinct(words)) - none
    capitals = F.length(F.regexp_replace(t, "[^A-Z]+", "")).cast("long")
    fails = [n < 200, 100 * kinds < 50 * n, 100 * capitals > 2 * F.length(t).cast("long"), t.rlike(r"[#$%&*|]")]
    return reduce(lambda a, b: a + b, [F.lit(1 << i) * f.cast("int") for i, f in enumerate(fails)])


def refinement(text: Column) -> Column:
    """What texts are split by, one after the other: length in code points, then
    the hashes of successive blocks of UTF-8, as many as its bytes ask for."""
    t = F.coalesce(text, F.lit(""))
    data, size_, blocks, at, size = t.cast("binary"), F.octet_length(t), [], 0, BLOCK
    while at < 1 << 31:
        # blocks of bytes are cut without reading what is before them
        blocks.append(F.when(size_ > at, F.xxhash64(F.substring(data, at + 1, min(size, (1 << 31) - 1)))))
        at, size = at + size, size * GROWTH
    return F.concat(F.array(F.length(t).cast("long")), F.filter(F.array(*blocks), lambda b: b.isNotNull()))


def class_after(steps: Column) -> Column:
    """The class of a row that all its steps were applied to."""
    return F.aggregate(steps, F.lit(0).cast("long"), lambda c, s: F.xxhash64(c, s))


def repeated_classes(d: DataFrame) -> DataFrame:
    """(class, parts, least, n) of the classes of two and more rows of d (id,
    steps) that no step tells apart. `steps` as from refinement, `parts` their
    number, `class` as from class_after, `least` the least id that isn't null.

    A round applies one step: it splits the classes that are left, drops those
    of one row, and is the last for classes that have no step left. Counts are
    combined before the shuffle and written before they are joined, so a hot
    class makes no hot task, and texts don't move at all.
    """
    left = d.select("id", "steps", F.size("steps").alias("parts"), F.lit(0).cast("long").alias("class"))
    done, at = [], 0
    while True:
        split = left.withColumn("class", F.xxhash64("class", F.element_at("steps", at + 1)))
        at += 1
        many = split.groupBy("class", "parts").agg(F.count("*").alias("n"), F.min("id").alias("least")).where("n > 1")
        many = stash(many, "audit-classes")
        done.append(many.where(F.col("parts") == at).select("class", "parts", "least", "n"))
        more = many.where(F.col("parts") > at).select("class", "parts")
        if more.isEmpty():
            return reduce(DataFrame.unionByName, done)
        left = stash(join_bounded(split.where(F.col("parts") > at), more, ["class", "parts"], "left_semi", 16), "audit-left")


def copies(docs: DataFrame, classes: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, class, parts) of the rows of docs whose text is that of a row with a
    smaller key. `classes` as from repeated_classes, of the same rows.

    Whole texts are compared: every member of a class with its least row, which
    goes to as many groups of the shuffle as the class has thousands of members.
    Should hashes have put different texts in a class, those that differ from
    the least row's are grouped by text.
    """
    steps = refinement(F.col(text))
    d = docs.select(F.col(key).alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text"), steps.alias("steps"))
    # two projections: each of them uses what the one before made once
    d = d.select("id", "text", class_after(F.col("steps")).alias("class"), F.size("steps").alias("parts"))
    of = classes.where("least IS NOT NULL").withColumn("groups", F.ceil(F.col("n") / MEMBERS).cast("int"))
    members = join_bounded(d, of, ["class", "parts"], "inner", 32)
    first = members.where("id = least").groupBy("class", "parts", "groups").agg(F.min("text").alias("first"))
    first = first.select("class", "parts", "first", F.explode(F.sequence(F.lit(0), F.col("groups") - 1)).alias("group"))
    later = members.where("id > least").withColumn("group", F.pmod(F.xxhash64("id"), F.col("groups")).cast("int"))
    met = later.join(first, ["class", "parts", "group"])
    met = stash(met.select("id", "class", "parts", F.when(F.col("text") != F.col("first"), F.col("text")).alias("other")), "audit-met")
    others = met.where("other IS NOT NULL")
    least = stash(others.groupBy("class", "parts", "other").agg(F.min("id").alias("least")), "audit-others")
    apart = join_bounded(others, least, ["class", "parts", "other"], "inner", F.length("other") + 32).where("id > least")
    return met.where("other IS NULL").select("id", "class", "parts").unionByName(apart.select("id", "class", "parts")).distinct()


def masks(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", part: str = "source") -> DataFrame:
    """(part, mask, n, good, toxic): how many documents of a part fail just the
    filters of a mask (bit 0 for A to bit 4 for E), and how many of them are
    labelled quality 1 and toxic 1. At most 32 rows a part.

    Rows that share key and text are so many documents, none of them a copy of
    the other, as no key is smaller; a row without a key is no copy and has
    none, nor labels. Null text is empty text, a null part the empty string; of
    several labels of one key the larger counts.
    """
    steps = refinement(F.col(text))
    d = docs.select(
        F.col(key).alias("id"), F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"), failing(F.col(text)).alias("mask"), steps.alias("steps")
    )
    d = stash(d, "audit")
    e = stash(copies(docs, repeated_classes(d), key, text), "audit-copies").withColumn("copy", F.lit(16))
    marks = stash(labels.groupBy(F.col("doc_id").alias("id")).agg(*[F.max((F.col(c) == 1).cast("int")).alias(c) for c in ("quality", "toxic")]), "audit-labels")
    d = d.select("id", "part", "mask", class_after(F.col("steps")).alias("class"), F.size("steps").alias("parts"))
    d = join_bounded(join_bounded(d, e, ["id", "class", "parts"], "left", 28), marks, "id", "left", 16)
    d = d.withColumn("mask", F.col("mask") + F.coalesce("copy", F.lit(0)))
    return d.groupBy("part", "mask").agg(F.count("*").alias("n"), *[F.coalesce(F.sum(c), F.lit(0)).alias(name) for c, name in (("quality", "good"), ("toxic", "toxic"))])


def audit(counts: DataFrame) -> DataFrame:
    """From counts as of masks: per part, order of the filters and step, what
    becomes of the part's documents at that step; see op12."""
    orders = ["".join(p) for p in permutations(FILTERS)]
    table = [
        {"filter_order": o, "step": i + 1, "before": sum(1 << FILTERS.index(f) for f in o[:i]), "bit": 1 << FILTERS.index(o[i])} for o in orders for i in range(len(o))
    ]
    steps = F.from_json(F.lit(json.dumps(table)), "array<struct<filter_order:string,step:int,before:int,bit:int>>")
    by_part = counts.groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("masks"))
    s = by_part.select("part", "masks", F.inline(steps))

    def total(of: str, where) -> Column:
        return F.aggregate("masks", F.lit(0).cast("long"), lambda a, m: a + F.when(where(m["mask"]), m[of]).otherwise(0))

    before, bit = F.col("before"), F.col("bit")

    def here(m: Column) -> Column:
        return (m.bitwiseAND(bit) != 0) & (m.bitwiseAND(before) == 0)

    # of all orders, the share in which a filter comes first among those that a document fails
    share = F.aggregate("masks", F.lit(0).cast("long"), lambda a, m: a + F.when(m["mask"].bitwiseAND(bit) != 0, m["n"] * (F.lit(len(orders)).cast("long") / F.bit_count(m["mask"])).cast("long")).otherwise(0))
    return s.select(
        "part",
        "filter_order",
        "step",
        total("n", lambda m: m.bitwiseAND(before.bitwiseOR(bit)) == 0).alias("kept"),
        total("n", here).alias("removed"),
        total("n", lambda m: (m.bitwiseAND(bit) != 0) & (m.bitwiseAND(before) != 0)).alias("redundant"),
        total("n", lambda m: m == bit).alias("unique_fails"),
        total("good", here).alias("good_lost"),
        total("toxic", here).alias("toxic_lost"),
        share.alias("shapley"),
    )


def op12(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per part, order of the five filters (120) and step (5): kept,
    removed, redundant, unique_fails, good_lost, toxic_lost, shapley. An empty
    table has no parts and so no rows."""
    return audit(masks(docs, labels))


ORACLE = r"""
WITH t AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text FROM documents),
w AS (SELECT *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words FROM t),
d AS (SELECT doc_id, part,
        (len(words) < 200)::INT AS a,
        (100 * len(list_distinct(words)) < 50 * len(words))::INT AS b,
        (100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 2 * length(text))::INT AS c,
        regexp_matches(text, '[#$%&*|]')::INT AS d,
        coalesce(doc_id > min(doc_id) OVER (PARTITION BY text), false)::INT AS e FROM w),
l AS (SELECT doc_id, max((quality = 1)::INT) AS good, max((toxic = 1)::INT) AS toxic FROM labels GROUP BY doc_id),
f AS (SELECT part, [a, b, c, d, e] AS fails, count(*) AS n, coalesce(sum(good), 0) AS good, coalesce(sum(toxic), 0) AS toxic
      FROM d LEFT JOIN l USING (doc_id) GROUP BY ALL),
x AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS letter),
o AS (SELECT p.letter || q.letter || r.letter || s.letter || u.letter AS filter_order
      FROM x p, x q, x r, x s, x u
      WHERE q.letter <> p.letter AND r.letter NOT IN (p.letter, q.letter) AND s.letter NOT IN (p.letter, q.letter, r.letter)
        AND u.letter NOT IN (p.letter, q.letter, r.letter, s.letter)),
s AS (SELECT filter_order, step, [instr('ABCDE', substr(filter_order, i, 1)) FOR i IN range(1, step)] AS before,
             instr('ABCDE', substr(filter_order, step, 1)) AS k FROM o, (SELECT unnest([1, 2, 3, 4, 5]) AS step)),
m AS (SELECT part, filter_order, step, k, n, good, toxic, fails[k] = 1 AS now, list_sum(fails) AS all_fails,
             coalesce(list_sum([fails[i] FOR i IN before]), 0) > 0 AS gone FROM f, s),
g AS (SELECT part, filter_order, step, k,
        coalesce(sum(n) FILTER (NOT gone AND NOT now), 0)::BIGINT AS kept,
        coalesce(sum(n) FILTER (NOT gone AND now), 0)::BIGINT AS removed,
        coalesce(sum(n) FILTER (gone AND now), 0)::BIGINT AS redundant,
        coalesce(sum(n) FILTER (now AND all_fails = 1), 0)::BIGINT AS unique_fails,
        coalesce(sum(good) FILTER (NOT gone AND now), 0)::BIGINT AS good_lost,
        coalesce(sum(toxic) FILTER (NOT gone AND now), 0)::BIGINT AS toxic_lost
      FROM m GROUP BY part, filter_order, step, k)
SELECT part, filter_order, step::INT AS step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
       (sum(removed) OVER (PARTITION BY part, k))::BIGINT AS shapley
FROM g
"""
