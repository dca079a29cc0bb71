"""Line dedup by overlapping windows of three lines."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from .common import small_batches, stash

WINDOW = 3


def line_windows(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, th, k, w1, w2): a 128-bit hash of each window of three consecutive
    lines. Lines are trimmed of spaces; lines that are then empty don't count.
    th tells apart rows that share an id."""
    d = docs.select(F.col(key).alias("id"), F.xxhash64(F.col(key), F.col(text)).alias("th"), F.filter(F.transform(F.split(F.col(text), "\n"), lambda x: F.trim(x)), lambda x: x != "").alias("lines"))
    d = d.where(F.size("lines") >= WINDOW)
    d = d.select("id", "th", F.transform("lines", lambda x: F.struct(F.xxhash64(x).alias("a"), F.xxhash64(F.lit(7), x).alias("b"))).alias("h"))
    parts = lambda h, k: [h[k + i][p] for i in range(WINDOW) for p in "ab"]
    windows = F.transform(F.sequence(F.lit(0), F.size("h") - WINDOW), lambda k: F.struct(k.alias("k"), F.xxhash64(*parts(F.col("h"), k)).alias("w1"), F.xxhash64(F.lit(1), *parts(F.col("h"), k)).alias("w2")))
    return d.select("id", "th", F.explode(windows).alias("w")).select("id", "th", "w.k", "w.w1", "w.w2")


def _without(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Columns: a row's others, its text, and the starts of windows to remove."""
    for batch in small_batches(batches, "text"):
        texts, starts = batch.column(1).to_pylist(), batch.column(2).to_pylist()
        total, gone = [], []
        for i, (text, ks) in enumerate(zip(texts, starts)):
            if text is None:
                total.append(0), gone.append(0)
                continue
            lines = text.split("\n")
            covered = {k + j for k in ks or () for j in range(WINDOW)}
            kept, n = [], 0
            for line in lines:
                if line.strip(" "):
                    if n not in covered:
                        kept.append(line)
                    n += 1
                else:
                    kept.append(line)
            total.append(n), gone.append(len(covered))
            if covered:
                texts[i] = "\n".join(kept)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string()), pa.array(total, pa.int64()), pa.array(gone, pa.int64())], names=["row", "text", "n_lines", "n_removed"])


def dedup_lines(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """docs with `text` replaced, and columns n_lines and n_removed.

    A window of three consecutive lines that occurs more than once in the table
    stays where it comes first, by (id, position), and goes elsewhere; a line
    goes if any window to remove covers it. Texts of fewer than three lines
    stay. Null text stays null with no lines; a null id comes before others;
    rows equal in id and text are one document and don't remove each other;
    rows that share an id but not the text are ordered by a hash. Empty lines
    stay. Columns of docs keep their names; n_lines and n_removed replace
    columns of these names.

    The global step works on 128-bit hashes, 16 bytes a window: a grouped
    minimum, combined before the shuffle, then a join of windows to the repeated
    ones, whose hot keys AQE splits. Texts move once, to meet their removals.
    """
    w = stash(line_windows(docs, key, text), "line-windows")
    at = F.struct("id", "th", "k")
    again = w.groupBy("w1", "w2").agg(F.min(at).alias("first"), F.count("*").alias("n"), F.max(at).alias("last")).where((F.col("n") > 1) & (F.col("first") != F.col("last")))
    # written first: a join right above the grouping could not split a hot window
    later = w.join(stash(again, "line-repeats"), ["w1", "w2"]).where(at != F.col("first"))
    gone = later.groupBy("id", "th").agg(F.collect_set("k").alias("starts__")).select(F.col("id").alias("id__"), F.col("th").alias("th__"), "starts__")
    rest = [c for c in docs.columns if c not in (text, "n_lines", "n_removed")]
    d = docs.select(F.struct(*[F.col(f"`{c}`") for c in rest]).alias("row"), F.col(text).alias("text"), F.col(key).alias("id"), F.xxhash64(F.col(key), F.col(text)).alias("th"))
    d = d.join(gone, (F.col("th") == F.col("th__")) & F.col("id").eqNullSafe(F.col("id__")), "left").select("row", "text", "starts__")
    schema = T.StructType([d.schema["row"], T.StructField("text", T.StringType()), T.StructField("n_lines", T.LongType()), T.StructField("n_removed", T.LongType())])
    out = d.mapInArrow(_without, schema)
    order = [F.col("text").alias(text) if c == text else F.col("row").getField(c).alias(c) for c in docs.columns if c not in ("n_lines", "n_removed")]
    return out.select(*order, "n_lines", "n_removed")


def op2(docs: DataFrame) -> DataFrame:
    return dedup_lines(docs.select("doc_id", "text")).select("doc_id", "n_lines", "n_removed", "text")


ORACLE = """
WITH l AS (
  SELECT doc_id, pos, line, trim(line) <> '' AS real
  FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM documents)),
n AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY pos) - 1 AS k FROM l WHERE real),
w AS (SELECT doc_id, k, trim(line) || chr(10) || trim(lead(line, 1) OVER x) || chr(10) || trim(lead(line, 2) OVER x) AS win
      FROM n WINDOW x AS (PARTITION BY doc_id ORDER BY k)),
f AS (SELECT doc_id, k, row_number() OVER (PARTITION BY win ORDER BY doc_id, k) AS nth FROM w WHERE win IS NOT NULL),
g AS (SELECT DISTINCT doc_id, k + j AS k FROM f, (VALUES (0), (1), (2)) v(j) WHERE nth > 1),
a AS (SELECT l.doc_id, l.pos, l.line, l.real, g.k IS NOT NULL AS gone
      FROM l LEFT JOIN n USING (doc_id, pos) LEFT JOIN g ON g.doc_id = n.doc_id AND g.k = n.k)
SELECT d.doc_id, coalesce(z.n_lines, 0)::BIGINT AS n_lines, coalesce(z.n_removed, 0)::BIGINT AS n_removed,
       CASE WHEN d.text IS NULL THEN NULL ELSE coalesce(z.kept, '') END AS text
FROM documents d LEFT JOIN (
  SELECT doc_id, count(*) FILTER (real) AS n_lines, count(*) FILTER (gone) AS n_removed,
         string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone) AS kept
  FROM a GROUP BY doc_id) z USING (doc_id)
"""
