import hashlib
import re
from collections import Counter

from compare import DATA
from pyspark.sql import functions as F

from tidewatch.llm import multiset as m


def vectors(spark, texts):
    d = spark.createDataFrame(list(enumerate(texts)), "i int, text string")
    return m.fingerprint_texts(d, ["i"], {"text": "v"})


def test_order_does_not_count_and_repeats_do(spark):
    v = {r["i"]: r["h"] for r in vectors(spark, ["One. Two. Three.", "Three. One.\nTwo.", "One. Two. Three. Three.", "", None, "One. Two. Three."]).select("i", m.as_hex(F.col("v")).alias("h")).collect()}
    assert v[0] == v[1] == v[5] != v[2] and v[3] == v[4] and len(v[0]) == m.WIDE * 8 + m.SIGNS * 4


def test_insert_and_delete(spark):
    v = vectors(spark, ["Alpha. Beta.", "Gamma.\nDelta.", "Alpha. Beta. Gamma. Delta."])
    a, b, c = (v.where(F.col("i") == i).select(F.col("v").alias(n)) for i, n in enumerate("abc"))
    j = a.crossJoin(b).crossJoin(c)
    r = j.select(m.as_hex(m.combine(F.col("a"), F.col("b"))).alias("sum"), m.as_hex(F.col("c")).alias("c"), m.as_hex(m.combine(F.col("c"), F.col("b"), -1)).alias("less"), m.as_hex(F.col("a")).alias("a")).first()
    assert r["sum"] == r["c"] and r["less"] == r["a"]


def check(d):
    rows = d.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("h", F.xxhash64("text")).collect()
    rows = [(r["doc_id"], r["text"]) for r in sorted(rows, key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, r["h"]))]
    want = []
    for i, (key, text) in enumerate(rows):
        k, other = len(text) // 2, rows[(i + 1) % len(rows)][1]
        want.append((str(key), len(text), hashlib.sha256((text[: len(text) - k] + other[:k]).encode()).hexdigest()))
    got = m.op8(d).collect()
    assert sorted((str(r["doc_id"]), r["n_chars"], r["edited_sha256"]) for r in got) == sorted(want)
    assert all(0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1 and (r["near_edited"] == 1) == (r["fingerprint"] == r["edited_fingerprint"]) for r in got)
    return got


def test_whole_table(spark):
    d = spark.read.parquet(str(DATA / "sf0.01/documents.parquet"))
    text = {r["doc_id"]: r["text"] for r in d.collect()}
    seen: dict = {}
    for r in check(d):
        assert seen.setdefault(text[r["doc_id"]], r["fingerprint"]) == r["fingerprint"]


def test_many_ranges(spark):
    d = spark.createDataFrame([(i * 3 % 500, f"text {i}. more {i % 7}.") for i in range(500)], "doc_id long, text string")
    got = {r["doc_id"]: r["next_text"] for r in m.with_next(d, rows=20).collect()}
    text = {r["doc_id"]: r["text"] for r in d.collect()}
    assert got == {i: text[(i + 1) % 500] for i in range(500)}


def test_odd_rows(odd, clashing, nothing):
    assert len(check(odd)) == odd.count()
    assert m.op8(clashing).count() == odd.count() and m.op8(nothing).count() == 0


def test_one_row(spark):
    assert len(check(spark.createDataFrame([(1, "abcd")], "doc_id long, text string"))) == 1


def test_no_python(spark, odd):
    plan = m.op8(odd)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


def pieces(text):
    return Counter(p for p in re.split(r"\n+|(?<=[.!?])[ \t\n\x0b\f\r]+", text) if p)


def test_fingerprints_and_likeness_by_brute_force(spark, documents):
    rows = sorted((r["doc_id"], r["text"] or "") for r in documents.collect())
    direct = {}
    edited = {}
    for i, (key, text) in enumerate(rows):
        k, other = len(text) // 2, rows[(i + 1) % len(rows)][1]
        edited[key] = text[: len(text) - k] + other[:k]
    for name, texts in (("own", dict(rows)), ("edited", edited)):
        d = spark.createDataFrame(list(texts.items()), "i long, text string")
        direct[name] = {r["i"]: r["h"] for r in m.fingerprint_texts(d, ["i"], {"text": "v"}).select("i", m.as_hex(F.col("v")).alias("h")).collect()}
    following = {key: rows[(i + 1) % len(rows)][1] for i, (key, _) in enumerate(rows)}
    for r in m.op8(documents).collect():
        key = r["doc_id"]
        # the edited text's is got by deletion and insertion, and equals its own
        assert (r["fingerprint"], r["edited_fingerprint"]) == (direct["own"][key], direct["edited"][key])
        a = pieces(dict(rows)[key])
        for got, b in ((r["near_edited"], pieces(edited[key])), (r["near_next"], pieces(following[key]))):
            n, shared = a.total() + b.total(), (a & b).total()
            most = max(max(a.values(), default=1), max(b.values(), default=1))
            if a == b:
                assert got == 1
            elif most == 1:
                assert abs(got - 2 * shared / n) <= 6 * m.likeness_error(a.total(), b.total(), shared) + 0.001


def test_places_ascend_and_hot_keys_are_spread(spark):
    d = spark.range(20_000).select(F.when(F.col("id") % 3 == 0, 77).when(F.col("id") % 3 == 1, None).otherwise(F.col("id")).cast("long").alias("doc_id"), F.concat(F.lit("text "), F.col("id").cast("string"), F.lit(".")).alias("text"))
    got = m.with_next(d, rows=100, cells=50).select("bucket", "rn", "doc_id", F.xxhash64("text").alias("h"), "text", "next_text")
    size = got.groupBy("bucket").count().agg(F.max("count")).first()[0]
    assert size < 1500
    rows = [(r["doc_id"] is not None, r["doc_id"] or 0, r["h"], r["text"], r["next_text"], r["bucket"]) for r in got.collect()]
    assert len(rows) == 20_000 and all(x[5] <= y[5] for x, y in zip(sorted(rows), sorted(rows)[1:]))
    assert {x[3]: x[4] for x in rows} == {x[3]: y[3] for x, y in zip(sorted(rows), sorted(rows)[1:] + sorted(rows)[:1])}
