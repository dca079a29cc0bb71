"""Exact ranks, quantiles and counts in ranges against plain sorting."""

from __future__ import annotations

import random
from math import ceil
from statistics import median

import pytest
from pyspark.sql import functions as F

from tidewatch.operators import dominance, ranks, series


SHAPES = {
    "ties": lambda pick: pick.randrange(4),
    "one": lambda pick: 7,
    "spread": lambda pick: pick.randrange(10**12),
    "tails": lambda pick: int(pick.choice([-1, 1]) * 10 ** pick.uniform(0, 17)),
    "hot": lambda pick: 5 if pick.random() < 0.4 else pick.randrange(1000),
}
SCHEMA = "g string, v long, id long"


def rows_of_all_shapes():
    """A group for each shape and size, one of null, and one without values."""
    pick, rows = random.Random(3), []
    for shape, make in SHAPES.items():
        for n in (1, 2, 3, 5, 7, 3001):
            rows += [(f"{shape}{n}", make(pick), i) for i in range(n)]
    rows += [(None, pick.randrange(9), i) for i in range(10)]
    return [*rows, ("ties7", None, -1), ("empty", None, -2)]


def groups(rows):
    out = {}
    for g, v, i in rows:
        if v is not None:
            out.setdefault(g, []).append((v, i))
    return {g: sorted(x) for g, x in out.items()}


@pytest.mark.parametrize("few", [100_000, 5])
def test_quantiles(spark, monkeypatch, few):
    """Also when brackets have to be narrowed again and again."""
    monkeypatch.setattr(ranks, "FEW", few)
    monkeypatch.setattr(ranks, "STEPS", 512 if few > 5 else 16)
    rows = rows_of_all_shapes()
    d, by = spark.createDataFrame(rows, SCHEMA), groups(rows)
    got = {r["g"]: r for r in ranks.nearest_ranks(d, ["g"], "v", {"low": 0.0, "p50": 0.5, "p99": 0.99, "top": 1.0}).collect()}
    assert set(got) == set(by)
    for g, x in by.items():
        assert [got[g][c] for c in ("low", "p50", "p99", "top")] == [x[max(1, ceil(round(p * len(x), 9))) - 1][0] for p in (0, 0.5, 0.99, 1)], g


def test_medians(spark):
    rows = rows_of_all_shapes()
    for r in ranks.medians(spark.createDataFrame(rows, SCHEMA), ["g"], "v").collect():
        assert r["median"] == pytest.approx(median(v for v, _ in groups(rows)[r["g"]]))


def test_tiles(spark):
    rows = rows_of_all_shapes()
    d, by = spark.createDataFrame(rows, SCHEMA), groups(rows)
    got = ranks.ntile4(ranks.quartiles(d, ["g"], "v", "id", "q"), ["g"], "v", "id", "t").collect()
    assert len(got) == len(rows)
    place = {g: {x: i for i, x in enumerate(v)} for g, v in by.items()}
    for r in got:
        if r["v"] is None:
            assert r["q"] is None and r["t"] is None
            continue
        i, m = place[r["g"]][r["v"], r["id"]], len(by[r["g"]])
        assert r["q"] == i * 4 // m
        small, more = divmod(m, 4)
        assert r["t"] == next(k for k in range(1, 5) if i < k * small + min(k, more))


def test_no_group_is_one_task(spark):
    """The windows left are over what two rounds of brackets leave, by cut."""
    d = spark.range(20000).selectExpr("'a' AS g", "id * 7 % 19997 AS v", "id")
    plan = ranks.quartiles(d, ["g"], "v", "id")._jdf.queryExecution().optimizedPlan().toString()
    assert "windowspecdefinition" not in plan
    at = ranks.places(d, ["g"], "v", spark.createDataFrame([("a", "x", 5000)], "g string, cut string, k long"))
    assert at.first()["v"] == sorted(i * 7 % 19997 for i in range(20000))[4999]


@pytest.mark.parametrize("shape,n", [("plain", 1), ("plain", 700), ("ties", 60), ("hot", 700)])
def test_counts_in_ranges(spark, shape, n):
    pick = random.Random(n)
    x = {"plain": lambda: pick.uniform(0.1, 100), "ties": lambda: float(pick.randrange(1, 6)), "hot": lambda: 3.0 if pick.random() < 0.4 else pick.uniform(1, 10)}[shape]
    rows = [(i, x(), None if pick.random() < 0.1 else float(pick.randrange(30))) for i in range(n)]
    got = dominance.counts_in_ranges(spark.createDataFrame(rows, "id long, x double, y double"), F.col("x") * 0.5, F.col("x") * 2).collect()
    assert len(got) == n
    for r in got:
        _, a, f = rows[r["id"]]
        peers = [b for _, c, b in rows if a * 0.5 <= c <= a * 2]
        valued = [b for b in peers if b is not None]
        assert (r["inside"], r["valued"], r["at_most"]) == (len(peers), len(valued), 0 if f is None else sum(b <= f for b in valued))


def test_cohorts_join_no_pools(spark):
    s = spark.range(400).selectExpr("id", "id % 50 AS pool", "id * id * 1000000 AS t", "cast(id % 37 AS double) AS fdv", "1.0D AS liq")
    plan = series.cohort_percentiles(s)
    assert "peer" not in plan._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count() > 0
