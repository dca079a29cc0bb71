from collections import Counter
from math import isclose

import pytest
from compare import DATA, same
from pyspark.sql import functions as F

from tidewatch.llm import mixing


def test_matches_sql(spark):
    sf = str(DATA / "sf0.01")
    same(mixing.op1(spark.read.parquet(f"{sf}/documents.parquet")), mixing.ORACLE, sf)


def waterfill(sizes, weights=(5, 2, 1), most=3):
    names = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    target, open_, left = {}, set(names), sum(sizes.values())
    while open_:
        unit = left / sum(w[s] for s in open_)
        over = {s for s in open_ if unit * w[s] > most * sizes[s]}
        if not over:
            return target | {s: unit * w[s] for s in open_}
        target |= {s: float(most * sizes[s]) for s in over}
        left -= sum(most * sizes[s] for s in over)
        open_ -= over
    return target


@pytest.mark.parametrize("sizes", [{"a": 10, "b": 100, "c": 1000, None: 5}, {"a": 0, "b": 7}, {"z": 1}, {"a": 0}, {"a": 5, "b": 5, "c": 5, "d": 500, "e": 1}])
def test_targets(spark, sizes):
    got = mixing.source_targets(spark.createDataFrame(list(sizes.items()), "source string, source_size long")).collect()
    want = waterfill(sizes)
    assert len(got) == len(sizes)
    for r in got:
        assert isclose(r["target"], want[r["source"]], rel_tol=1e-9, abs_tol=1e-9)


def test_taken_is_near_the_target(spark):
    d = spark.read.parquet(str(DATA / "sf0.01/documents.parquet"))
    rows = mixing.op1(d).groupBy("target", "source_size").agg(F.sum("taken").alias("taken"), F.max(F.col("taken") - 3 * F.col("size")).alias("over"), F.max("size").alias("largest")).collect()
    for r in rows:
        assert r["over"] <= 0
        assert abs(r["taken"] - r["target"]) <= r["largest"]


def test_reruns_agree(odd):
    assert sorted(mixing.op1(odd).collect(), key=str) == sorted(mixing.op1(odd.repartition(5)).collect(), key=str)


def test_odd_rows(odd, clashing, nothing):
    rows = mixing.op1(odd).collect()
    assert len(rows) == odd.count() and all(r["size"] is not None and 0 <= r["copies"] <= 3 for r in rows)
    assert sum(r["size"] == 0 for r in rows) == 4
    assert mixing.op1(clashing).count() == len(rows)
    assert mixing.op1(nothing).count() == 0


def test_mixed_documents_keep_columns(odd, clashing, nothing):
    out = mixing.mixed_documents(clashing)
    assert out.columns == clashing.columns and out.schema == clashing.schema
    got = Counter(r["doc_id"] for r in out.collect())
    want = Counter()
    for r in mixing.op1(odd).collect():
        want[r["doc_id"]] += r["copies"]
    assert got == +want
    assert mixing.mixed_documents(nothing).count() == 0


def test_keys_that_sources_share(spark):
    """Rows without a key, and keys that several sources have: each row is taken as its own source is."""
    rows = [(None if i % 2 else i % 10, "word " * (1 + i % 7) + str(i), "en", "abc"[i % 3], 1) for i in range(90)]
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    m = mixing.op1(d).groupBy("target").agg(F.sum("taken").alias("taken")).collect()
    words = mixing.mixed_documents(d).groupBy("source").agg(F.sum(mixing.word_count(F.col("text"))).alias("taken")).collect()
    assert sorted(r["taken"] for r in words if r["taken"]) == sorted(r["taken"] for r in m if r["taken"])
