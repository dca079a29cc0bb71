"""What a task holds and how work is spread, and results on ties that show it."""

from __future__ import annotations

import math

import pandas as pd
import pytest
from compare import DATA, same
from pyspark.sql import functions as F

import __spark_entry__  # noqa: F401  it fills the catalogue
from tidewatch.functions import keccak
from tidewatch import plans
from tidewatch.operators import citations, stats
from tidewatch.plans import catalogue, judgment
from tidewatch.sources import scratch
from tidewatch.streaming import queries, state


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_near_ties_rank_by_id(spark):
    """Distances that are equal to four places, though not to six."""
    d = spark.createDataFrame([(0, [0.0]), (1, [1.00004]), (2, [1.0]), (3, [1.0])], "id long, v array<double>")
    found = lambda **scale: [r["id"] for r in stats.knn(d, d.where("id = 0"), 3, **scale).orderBy("rank").collect()]
    assert found(scale=1e4) == [1, 2, 3]
    assert found() == [2, 3, 1]


def test_comparable_knn_on_the_larger_table(spark):
    sf = str(DATA / "sf0.1")
    same(catalogue.QUERIES["comparable_knn"](spark, sf), catalogue.ORACLES["comparable_knn"], sf)


def test_keccak_of_many():
    texts = [bytes(range(n % 256)) * 2 for n in (0, 1, 40, 67, 68, 69, 135, 136, 137, 200)] + [b"x" * 40] * 3
    assert keccak.keccak256_many(texts) == [keccak.keccak256(t) for t in texts]
    assert keccak.keccak256_many([]) == []


def test_checksums_are_spread(spark):
    got = catalogue.QUERIES["checksummed_addresses"](spark, str(DATA / "sf0.001"))
    assert got.rdd.getNumPartitions() > 1
    assert all(r["address"] == keccak.checksum(f"0x{r['id']:040x}") for r in got.collect())


def test_checksums_of_nulls(spark):
    d = spark.createDataFrame([("0x5aaeb6053f3e94c9b9a09f33669435e7ef1beaed",), (None,)], "a string").coalesce(1)
    assert [r[0] for r in d.select(keccak.checksum_address(F.col("a"))).collect()] == ["0x5aAeb6053F3E94C9b9A09f33669435E7Ef1BeAed", None]


@pytest.mark.parametrize("k", [1, 3, 200])
def test_nearest_shared_keeps_no_pairs(spark, k):
    """By brute force, with ties, lacking features and more probes than a block."""
    rows = [(i, None if i % 5 == 0 else float(i % 7), None if i % 11 == 0 else float(i % 3)) for i in range(120)]
    d = spark.createDataFrame(rows, "id long, a double, b double")

    def distance(p, r):
        both = [(x - y) ** 2 for x, y in zip(p[1:], r[1:]) if x is not None and y is not None]
        return math.floor(math.sqrt(sum(both)) * 1e6 + 0.5) / 1e6 if both else math.inf

    want = [(p[0], i, rank + 1) for p in rows if p[0] % 2 == 0 for rank, (_, i) in enumerate(sorted((distance(p, r), r[0]) for r in rows if r[0] != p[0])[:k])]
    for most in (20_000, 25):
        n = stats.nearest_shared(d, d.where("id % 2 = 0"), ["a", "b"], k, most)
        assert "NestedLoop" not in plan(n) and "Cartesian" not in plan(n)
        assert sorted((r["probe"], r["id"], r["rank"]) for r in n.collect()) == sorted(want)


def test_holders_need_no_python(spark, tmp_path):
    state.keyed_state(spark)
    schema = "id long, ts timestamp, token long, src long, dst long, value long"
    spark.createDataFrame([], schema).write.parquet(f"{tmp_path}/in")
    logical = state.holder_balances(spark.readStream.schema(schema).parquet(f"{tmp_path}/in"), "1 hour")._jdf.queryExecution().analyzed().toString()
    assert "Aggregate" in logical and "Pandas" not in logical


def test_slices_in_several_files(spark, tmp_path):
    """Each slice of times has as many files as it is said to."""
    d = spark.range(4000).select("id", F.timestamp_seconds("id").alias("ts"))
    for least, files in ((1000, 4), (10_000, 1)):
        path = f"{tmp_path}/{least}"
        assert queries._in_order(d, "ts", 2, path, 4, least) == files
        per = spark.read.parquet(path).groupBy(F.input_file_name()).agg(F.min("id").alias("low"), F.max("id").alias("high")).collect()
        assert len(per) == 2 * files and all((r["low"] < 2000) == (r["high"] < 2000) for r in per)


def test_windows_keep_cells_not_times():
    """Sums and buyers are one entry a cell, however many swaps it has."""

    class Kept(dict):
        containsKey, getValue, updateValue = dict.__contains__, dict.__getitem__, dict.__setitem__

    w = state.Windows(30, 20)
    w.sums, w.buyers = Kept(), Kept()
    w.read = type("Read", (), {"exists": lambda self: False})()
    w.handle = type("Handle", (), {"registerTimer": lambda self, at: None})()
    rows = pd.DataFrame({"ts": pd.to_datetime(range(1_000_000, 9_000_000, 1000), unit="us"), "pool": 1, "buyer": [i % 50 for i in range(8000)], "side": "BUY", "amount": 2})
    for part in (rows[:5000], rows[5000:]):
        assert not list(w.handleInputRows((1,), iter([part[:2000], part[2000:]]), None))
    assert dict(w.sums) == {(1,): (8000, 0, 16000, 0)}
    assert w._bought(1).tolist() == list(range(50))


def test_citations_read_payloads_once(spark, monkeypatch):
    """Payloads and pointers are written before seven tables and the verdicts read them."""
    kept = []
    for module in (plans.briefs, citations):
        monkeypatch.setattr(module, "written", lambda df, tag="scratch": kept.append(tag) or scratch.written(df, tag))
    got = catalogue.QUERIES["citation_verdicts"](spark, str(DATA / "sf0.001"))
    assert kept == ["payloads", "pointers"]
    assert got.count() == spark.read.parquet(f"{DATA}/sf0.001/events.parquet").where("event_id % 20 = 0").count()


def test_legs_are_computed_once(spark):
    got = catalogue.QUERIES["slippage_curve"](spark, str(DATA / "sf0.001"))
    assert got._jdf.queryExecution().optimizedPlan().toString().count(" div ") <= 6


def test_replay_is_spread(spark):
    assert judgment.replayed_parts(spark, str(DATA / "sf0.001")).rdd.getNumPartitions() > 1


def test_creation_logs_are_spread(spark):
    assert queries.creation_logs(spark, str(DATA / "sf0.001"))(0, 4000).rdd.getNumPartitions() > 1
