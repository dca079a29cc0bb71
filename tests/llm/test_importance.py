import hashlib
import math
import re
import zlib
from collections import Counter

import pytest
from compare import DATA, same

from tidewatch.llm import importance

SF = str(DATA / "sf0.01")
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = {i: i + 32 for i in range(65, 91)}


def test_matches_sql(spark):
    read = [spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "benchmark")]
    same(importance.op13(*read), importance.ORACLE, SF)


def brute(docs, target, longest=1, buckets=10_000, share=10, least=20, seed=2024):
    def features(text):
        words = WORD.findall((text or "").translate(LOWER))
        return len(words), [zlib.crc32(" ".join(words[i : i + k]).encode()) % buckets for k in range(1, longest + 1) for i in range(len(words) - k + 1)]

    have, want = Counter(b for _, t in docs for b in features(t)[1]), Counter(b for t in target for b in features(t)[1])
    s, t = sum(have.values()), sum(want.values())
    gain = [math.floor(1000 * math.log((want[b] + 1) * (s + buckets) / ((have[b] + 1) * (t + buckets)))) for b in range(buckets)]
    rows, drawable = [], []
    for i, text in docs:
        n, f = features(text)
        h = int(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[b] for b in f)
        score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        rows.append((i, len(f), weight, score))
        if n >= least:
            drawable.append((-score, i is None, i or 0, len(f), weight, i))
    drawn = sorted(drawable)[: len(drawable) * share // 100]
    rank = {(x[5], x[3], x[4], -x[0]): k for k, x in enumerate(drawn, 1)}
    return sorted(((*r, rank.get((r[0], r[1], r[2], r[3]))) for r in rows), key=str)


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


@pytest.mark.parametrize("longest,share,buckets", [(1, 10, 10_000), (1, 100, 50), (2, 30, 1000), (3, 0, 10_000)])
def test_by_brute_force(spark, longest, share, buckets):
    d = spark.read.parquet(f"{DATA}/sf0.001/documents.parquet")
    b = spark.read.parquet(f"{DATA}/sf0.001/benchmark.parquet")
    docs, target = [(r["doc_id"], r["text"]) for r in d.collect()], [r["text"] for r in b.collect()]
    got = importance.resample(d, b, longest=longest, share=share, buckets=buckets)
    assert rows_of(got) == brute(docs, target, longest, buckets, share)


def test_words(spark):
    texts = ["", "ABC déf ÀÉ É1x", "a_b-c1", " x  ", "İstanbul ſ K", "東京タワー 😀9", "ALL ascii 42", None]
    d = spark.createDataFrame([(t,) for t in texts], "text string").select("text", importance.feature_words(importance.F.col("text")).alias("w"))
    for r in d.collect():
        assert r["w"] == WORD.findall((r["text"] or "").translate(LOWER))


def test_reruns_agree(spark):
    d, b = (spark.read.parquet(f"{DATA}/sf0.001/{t}.parquet") for t in ("documents", "benchmark"))
    assert rows_of(importance.op13(d, b)) == rows_of(importance.op13(d.repartition(7), b))


def test_places_over_many_ranges(spark):
    """Equal scores and many ranges: places run from 1 without gaps."""
    d = spark.range(5000).selectExpr("id", "id % 3 AS score").repartition(9)
    got = importance.ranks(d, [importance.F.col("score").desc(), importance.F.col("id")]).collect()
    want = {r: k for k, r in enumerate(sorted(range(5000), key=lambda i: (-(i % 3), i)), 1)}
    assert {r["id"]: r["place"] for r in got} == want


def test_odd_rows(spark, odd, clashing, nothing):
    b = spark.createDataFrame([("lazy dog river",), (None,), ("",)], "text string")
    docs = [(r["doc_id"], r["text"]) for r in odd.collect()]
    got = rows_of(importance.resample(odd, b, share=50))
    want = brute(docs, ["lazy dog river", None, ""], share=50)
    # the row that is there twice has two ranks, one after the other
    twice = [r for r in got if r[0] == 9]
    assert len(twice) == 2 and len({r[:4] for r in twice}) == 1
    assert [r for r in got if r[0] != 9] == [r for r in want if r[0] != 9]
    assert rows_of(importance.resample(clashing, b, share=50)) == got
    assert importance.op13(nothing, b).count() == 0
    ranks = sorted(r["rank"] for r in importance.resample(odd, b.limit(0), share=100).collect() if r["rank"])
    assert ranks == list(range(1, len(ranks) + 1)) and len(ranks) == 5


def test_the_draw_leans_to_the_target(spark):
    """Documents about the target's subject are drawn far above their share."""
    rows = [(i, " ".join(("tide harbour vessel anchor" if i % 10 == 0 else "market ledger invoice audit").split()[(i + k) % 4] for k in range(30))) for i in range(400)]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    b = spark.createDataFrame([("the vessel left the harbour with the tide",)], "text string")
    drawn = [r["doc_id"] for r in importance.resample(d, b).collect() if r["rank"]]
    assert len(drawn) == 40 and sum(i % 10 == 0 for i in drawn) >= 36
