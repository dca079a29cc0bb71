from collections import Counter
from itertools import permutations

import pytest
from compare import DATA, same
from pyspark.sql import functions as F

from tidewatch.llm import filteraudit

LABELS = "doc_id long, quality int, toxic int"


def test_matches_sql(spark):
    sf = str(DATA / "sf0.01")
    same(filteraudit.op12(spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")), filteraudit.ORACLE, sf)


def brute(rows, labels):
    """The report by the definitions, document by document and order by order."""
    good, toxic = Counter(), Counter()
    for i, q, t in labels:
        if i is not None:
            good[i] |= q == 1
            toxic[i] |= t == 1
    docs = []
    for i, text, source in rows:
        t = text or ""
        words = t.encode().split()
        fails = set()
        if len(words) < 200:
            fails.add("A")
        if 100 * len(set(words)) < 50 * len(words):
            fails.add("B")
        if 100 * sum("A" <= c <= "Z" for c in t) > 2 * len(t):
            fails.add("C")
        if set(t) & set("#$%&*|"):
            fails.add("D")
        if i is not None and any(j is not None and j < i and (u or "") == t for j, u, _ in rows):
            fails.add("E")
        docs.append((i, source or "", fails))
    out, shapley = {}, Counter()
    for part in {p for _, p, _ in docs}:
        for order in map("".join, permutations("ABCDE")):
            left = [d for d in docs if d[1] == part]
            gone = []
            for step, f in enumerate(order, 1):
                hit = [d for d in left if f in d[2]]
                left = [d for d in left if f not in d[2]]
                unique = sum(d[2] == {f} for d in docs if d[1] == part)
                out[part, order, step] = (len(left), len(hit), sum(f in d[2] for d in gone), unique, sum(good[d[0]] for d in hit), sum(toxic[d[0]] for d in hit))
                shapley[part, f] += len(hit)
                gone += hit
    return {(*k, *v, shapley[k[0], k[1][k[2] - 1]]) for k, v in out.items()}


def small(spark):
    text = " ".join(f"w{i}" for i in range(220))
    rows = [
        (1, text, "a"), (2, text, "a"), (3, text, None), (3, text, ""), (4, text + " A" * 30, "a"), (5, "one # two", "b"), (6, "one # two", "b"),
        (7, None, "b"), (8, "", "b"), (9, "", None), (None, text, "a"), (None, None, "c"), (10, "SHOUT " * 300, "c"), (11, "shout " * 300, "c"),
        (12, text[:-1], "a"), (13, text[:-1] + "x", "a"), (14, "é" * 256 + "a", "a"), (15, "é" * 256 + "b", "a"), (16, "é" * 256 + "b", "a"),
    ]
    labels = [(1, 1, 0), (2, 1, 1), (2, 0, 0), (3, None, 1), (7, 1, None), (None, 1, 1), (99, 1, 1), (16, 1, 0)]
    return rows, labels


def got(df):
    return {tuple(r) for r in df.collect()}


def test_by_definition(spark):
    rows, labels = small(spark)
    d, y = spark.createDataFrame(rows, "doc_id long, text string, source string"), spark.createDataFrame(labels, LABELS)
    assert got(filteraudit.op12(d, y)) == brute(rows, labels)


def test_real_rows_by_definition(spark):
    d = spark.read.parquet(str(DATA / "sf0.001/documents.parquet")).select("doc_id", "text", "source")
    y = spark.read.parquet(str(DATA / "sf0.001/labels.parquet")).select("doc_id", "quality", "toxic")
    assert got(filteraudit.op12(d, y)) == brute([tuple(r) for r in d.collect()], [tuple(r) for r in y.collect()])


def test_copies_of_all_lengths(spark, monkeypatch):
    """Texts that differ in their last character only, of lengths around the
    ends of blocks; a class of more members than a group takes."""
    monkeypatch.setattr(filteraudit, "MEMBERS", 7)
    rows = []
    for n in (0, 1, 255, 256, 257, 4351, 4352, 4353, 69887, 69888, 69889):
        for k in range(3):
            rows += [(len(rows) + i, "x" * n + "abc"[k]) for i in range(2)]
    for n in (255, 256, 257, 4352, 69887):
        rows += [(len(rows), "é" * n + c) for c in ("a", "b", "a")]
    rows += [(1000 + i, "the same") for i in range(100)]
    d = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    steps = d.select(F.col("doc_id").alias("id"), filteraudit.refinement(F.col("text")).alias("steps"))
    found = {r["id"] for r in filteraudit.copies(d, filteraudit.repeated_classes(steps)).collect()}
    first = {}
    assert found == {i for i, t in sorted(rows) if first.setdefault(t, i) != i}


def test_colliding_hashes(spark, monkeypatch):
    """With a hash that tells nothing apart, texts still are."""
    monkeypatch.setattr(filteraudit, "refinement", lambda text: F.array(F.lit(0).cast("long") + F.length(text) * 0))
    rows = [(1, "a"), (2, "b"), (3, "a"), (4, "b"), (5, "c"), (6, "b"), (7, "a")]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    steps = d.select(F.col("doc_id").alias("id"), filteraudit.refinement(F.col("text")).alias("steps"))
    classes = filteraudit.repeated_classes(steps)
    assert classes.count() == 1
    assert {r["id"] for r in filteraudit.copies(d, classes).collect()} == {3, 4, 6, 7}


def test_odd_rows(spark, odd, clashing, nothing):
    y = spark.createDataFrame([(1, 1, 0), (9, 0, 1)], LABELS)
    rows = [(r["doc_id"], r["text"], r["source"]) for r in odd.collect()]
    want = brute(rows, [(1, 1, 0), (9, 0, 1)])
    assert got(filteraudit.op12(odd, y)) == want and got(filteraudit.op12(clashing, y)) == want
    assert filteraudit.op12(nothing, y).count() == 0
    assert got(filteraudit.op12(odd, y.limit(0))) == brute(rows, [])
    assert filteraudit.op12(nothing, y).schema == filteraudit.op12(odd, y).schema


@pytest.mark.parametrize("mask,at", [(1, 120), (3, 60), (31, 24)])
def test_shares(spark, mask, at):
    counts = spark.createDataFrame([("p", mask, 1, 0, 0)], "part string, mask int, n long, good long, toxic long")
    assert filteraudit.audit(counts).where("filter_order = 'ABCDE' AND step = 1").first()["shapley"] == at
