"""Operators and functions on small tables with known results."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from tidewatch.functions import contracts, keccak, texts, wide
from tidewatch.operators import asof, ranks, series, stats

MIN = 60_000_000


def one(spark, *columns):
    return tuple(spark.range(1).select(*[c.alias(f"c{i}") for i, c in enumerate(columns)]).first())


def test_keccak():
    assert keccak.keccak256(b"").hex() == "c5d2460186f7233c927e7db2dcc703c0e500b653ca82273b7bfad8045d85a470"
    assert keccak.selector("transfer(address,uint256)") == "a9059cbb"
    assert keccak.checksum("0x5aaeb6053f3e94c9b9a09f33669435e7ef1beaed") == "0x5aAeb6053F3E94C9b9A09f33669435E7Ef1BeAed"


def test_price_math(spark):
    lit = lambda x: F.lit(str(x))
    got = one(
        spark,
        wide.v2_price(lit(2 * 10**18), lit(5 * 10**6), F.lit(18), F.lit(6)),
        wide.v2_price(F.lit("0"), F.lit("1"), F.lit(18), F.lit(6)),
        wide.v3_price(lit(2**96), F.lit(18), F.lit(18)),
        wide.v3_price(lit(2**96), F.lit(18), F.lit(6)),
        wide.v3_price(F.lit("0"), F.lit(18), F.lit(18)),
        wide.usd_value(lit(10**54), F.lit(18), lit(10**18)),
        wide.mul_div(F.lit("7"), F.lit("3"), F.lit("0")),
    )
    assert got == (str(25 * 10**17), None, str(10**18), str(10**30), None, None, None)


def test_wide_sums(spark):
    rows = [(1, str(10**70)), (1, str(-3)), (1, None), (2, "-5"), (2, "5"), (2, str(-(10**40)))]
    got = {r["k"]: int(r["total"]) for r in wide.limb_sums(spark.createDataFrame(rows, "k int, v string"), ["k"], "v").collect()}
    assert got == {1: 10**70 - 3, 2: -(10**40)}


def swaps(spark, amounts):
    rows = [(i, 1, b, i, "BUY", a) for i, (b, a) in enumerate(amounts)]
    return spark.createDataFrame(rows, "id long, pool long, buyer string, t long, side string, amount long")


@pytest.mark.parametrize(
    "amounts, gini, entropy, repeated",
    [
        ([("A", 500), ("A", 500)], None, None, 10000),
        ([(b, 1000) for b in "ABCD"], 0, 10000, 10000),
        ([("A", 990), ("B", 5), ("C", 5)], 6567, 573, 6667),
        ([("A", 300), ("A", 700), ("B", 1000), ("C", 1000)], 0, 10000, 5000),
        ([("A", 100), ("B", 100), ("C", 100), ("A", 250), ("B", 300)], None, None, 6000),
        ([("A", 100), ("B", 200), ("C", 300)], None, None, 0),
        ([("A", 5 * 10**15), ("B", 3 * 10**15 + 1), ("C", 2 * 10**15), ("D", 1)], 4000, 7427, 0),
    ],
)
def test_buy_shape(spark, amounts, gini, entropy, repeated):
    s = swaps(spark, amounts)
    if gini is not None or len({b for b, _ in amounts}) == 1:
        assert series.gini_bps(s).first()["gini_bps"] == gini
        assert series.entropy_bps(s).first()["entropy_bps"] == entropy
    assert series.repeated_size_bps(s).first()["repeated_bps"] == repeated


def snaps(spark, points):
    """points: (minute, fdv, liquidity)"""
    rows = [(i, 1, m * MIN, f, q) for i, (m, f, q) in enumerate(points)]
    return spark.createDataFrame(rows, "id long, pool long, t long, fdv double, liq double")


@pytest.mark.parametrize(
    "points, want",
    [
        ([(0, 1.0, 1000.0)], (1000, 1000, 0, 0, 1, False)),
        ([(0, 1.0, 1000.0), (10, 1.0, 2000.0), (20, 1.0, 1800.0), (40, 1.0, 1200.0)], (2000, 1200, 4000, 30, 4, False)),
        ([(0, 1.0, 10000.0), (60, 1.0, 1500.0)], (10000, 1500, 8500, 60, 2, True)),
        ([(0, 1.0, None), (5, 1.0, 500.0)], (500, 500, 0, 0, 2, False)),
    ],
)
def test_trajectory(spark, points, want):
    assert tuple(series.trajectory(snaps(spark, points)).first())[1:] == want


def test_trajectory_without_values(spark):
    assert series.trajectory(snaps(spark, [(0, 1.0, None)])).count() == 0


@pytest.mark.parametrize("end, want", [((30000.0, 10000.0), "SURVIVED"), ((29999.99, 50000.0), "DIED"), ((100000.0, 9999.99), "DIED"), ((None, 1.0), None)])
def test_outcome(spark, end, want):
    rows = series.outcome_label(snaps(spark, [(0, 50000.0, 100000.0), (60, end[1], end[0]), (3000, 1.0, 1.0)]), 1440 * MIN).collect()
    assert [r["outcome"] for r in rows] == ([want] if want else [])


@pytest.mark.parametrize("prices, want", [([(0, 1.0), (30, 0.7)], (10000, 0)), ([(0, 1.0), (10, 0.5), (20, 2.0), (30, 0.1)], (20000, 5000)), ([(0, 1.0)], (10000, 0))])
def test_performance(spark, prices, want):
    s = snaps(spark, [(m, p, 1.0) for m, p in prices])
    r = series.performance_label(s, 72 * 60 * MIN, 0.9, 1.1, 72 * 60 * MIN).first()
    assert (r["multiple_bps"], r["drawdown_bps"]) == want
    assert series.performance_label(s, 72 * 60 * MIN, 0.9, 1.1, 71 * 60 * MIN).count() == 0


@pytest.mark.parametrize("k, n, want", [(10, 20, (2993, 7007)), (50, 100, (4038, 5962)), (0, 5, (0, 4345)), (5, 5, (5655, 10000)), (0, 0, (None, None))])
def test_wilson(spark, k, n, want):
    assert one(spark, *stats.wilson(F.lit(k), F.lit(n))) == want


def test_balances(spark):
    moves = [("Z", "A", 100), ("A", "B", 40), ("A", "P", 10), ("B", "C", 15), ("C", "B", 15), ("B", "Z", 5)]
    d = spark.createDataFrame([(1, *m) for m in moves], "token int, src string, dst string, value long")
    got = {r["holder"]: r["balance"] for r in stats.net_balances(d).collect()}
    assert got == {"A": 50, "B": 35, "P": 10}


@pytest.mark.parametrize("balances, want", [([60, 30, 10], (6000, 10000)), ([1, 2], (6666, 10000)), ([10] * 12, (833, 8333))])
def test_concentration(spark, balances, want):
    d = spark.createDataFrame([(1, i, b) for i, b in enumerate(balances)], "token int, holder int, balance long")
    r = stats.concentration(d, excluded="false").first()
    assert (r["largest_bps"], r["top10_bps"]) == want


def test_quartiles_differ_from_ntile(spark):
    d = ranks.quartiles(spark.createDataFrame([(1, i) for i in range(6)], "g int, v int"), ["g"], "v", "v", "q")
    assert [d.where(F.col("q") == i).count() for i in range(4)] == [2, 1, 2, 1]


def test_as_of(spark):
    left = spark.createDataFrame([(1, "k", 10), (2, "k", 4), (3, None, 10), (4, "z", 10)], "id int, k string, t long")
    right = spark.createDataFrame([(1, "k", 5, "a"), (2, "k", 10, "b"), (3, "k", 10, "c"), (4, "k", 12, "d"), (5, None, 1, "n")], "r int, k string, t long, v string")
    of = lambda **kw: {x["id"]: x["match"] and x["match"]["v"] for x in asof.as_of(left, right, "k", "t", "r", ["v"], **kw).collect()}
    assert of() == {1: "c", 2: None, 3: None, 4: None}
    assert of(grace=2) == {1: "d", 2: "a", 3: None, 4: None}
    assert of(grace=1)[2] == "a" and of(tolerance=0)[1] == "c"
    near = {x["id"]: x["match"] and x["match"]["v"] for x in asof.nearest(left, right, "k", "t", "r", ["v"]).collect()}
    assert near == {1: "c", 2: "a", 3: None, 4: None}


def test_lookahead_fails_the_job(spark):
    d = spark.createDataFrame([(1, 5), (1, 7)], "t long, seen long")
    assert asof.assert_no_lookahead(d.where("seen < 1"), "t", F.col("seen")).count() == 0
    with pytest.raises(Exception, match="evidence is later"):
        asof.assert_no_lookahead(d, "t", F.col("seen")).collect()


def test_blocks_of_probes_give_the_same(spark):
    d = spark.createDataFrame([(i, [float(i % 7), float(i % 5)]) for i in range(60)], "id int, v array<double>")
    p = d.where("id % 10 = 0")
    assert sorted(stats.knn(d, p, 3).collect()) == sorted(stats.knn(d, p, 3, most=2).collect())


def test_texts(spark):
    lit = F.lit
    got = one(spark, texts.usd(lit(1234567.5)), texts.usd(lit(float("nan"))), texts.age(lit(89)), texts.age(lit(312)), texts.age(lit(4464)), texts.percent(lit(3250)), texts.usd_number(lit("")), texts.usd_number(lit("1.2.3")), texts.bytes32_text(lit("0x" + "4142" + "00" * 30)))
    assert got == ("$1,234,568", "unknown", "89m", "5.2h", "3.1d", "32.5%", 0.0, None, "AB")


def test_permissions_without_code(spark):
    assert one(spark, contracts.permission(F.lit("0x"), "mint"), contracts.permission(F.lit("0x6040c10f1900"), "mint"), contracts.permission(F.lit("0x60"), "mint")) == ("UNKNOWN", "PRESENT", "ABSENT")


def test_as_of_in_buckets_equals_one_window(spark):
    import random

    rng = random.Random(2)
    l = spark.createDataFrame([(i, rng.choice([1, 2, None]), rng.randrange(1000)) for i in range(200)], "id long, k long, t long")
    r = spark.createDataFrame([(i, rng.choice([1, 1, 2, 3]), rng.randrange(1000)) for i in range(60)], "rid long, k long, t long")
    for forward in (False, True):
        for more in ({}, {"grace": 40}, {"tolerance": 15}):
            whole, split = (sorted((x["id"], x["match"] and tuple(x["match"])) for x in asof.as_of(l, r, "k", "t", "rid", [], forward=forward, bucket=b, **more).collect()) for b in (None, 50))
            assert whole == split


def test_as_of_all(spark):
    l = spark.createDataFrame([(1, "a", 100), (2, "a", 5), (3, None, 100), (4, "b", 50)], "id long, k string, t long")
    x = spark.createDataFrame([(10, "a", 100), (11, "a", 100), (12, "a", 101), (13, "b", 1)], "id long, k string, t long")
    y = spark.createDataFrame([(20, "a", 90), (21, "b", 50), (22, None, 1)], "id long, k string, t long")
    got = {r["id"]: (r["x"] and r["x"]["id"], r["x_n"], r["y"] and r["y"]["id"]) for r in asof.as_of_all(l, {"x": x, "y": y}, "k", "t", "id", tolerance={"x": 40}).collect()}
    assert got == {1: (11, 2, 20), 2: (None, 0, None), 3: (None, 0, None), 4: (None, 1, 21)}


def test_rolling_activity_by_brute_force(spark):
    import random

    rng = random.Random(5)
    rows = [(i, rng.choice([1, 1, 1, 2, None]), rng.choice("abcd"), rng.randrange(400), rng.choice(["BUY", "BUY", "SELL", "UNKNOWN"]), rng.randrange(100)) for i in range(300)]
    d = spark.createDataFrame(rows, "id long, pool long, buyer string, t long, side string, amount long")
    want = set()
    for i, pool, _, t, side, _ in rows:
        if side == "BUY":
            near = [r for r in rows if r[1] == pool and t - 7 <= r[3] <= t]
            b, s = [r for r in near if r[4] == "BUY"], [r for r in near if r[4] == "SELL"]
            want.add((i, pool, len({r[2] for r in b}), len(b), len(s), sum(r[5] for r in b), sum(r[5] for r in s)))
    assert {tuple(r) for r in series.rolling_activity(d, 7).collect()} == want


def test_strict_entry_features(spark):
    import json

    good = {k: None if v.endswith("?") else 5 for k, v in texts.ENTRY_FEATURES.items()} | {"quoteLiquidityUsd": "12.5", "riskStatus": "STALE", "isProxy": False}
    assert len(good) == 26
    rows = [good, good | {"uniqueBuyers1h": "3"}, good | {"uniqueBuyers1h": 3}, good | {"isProxy": "false"}, good | {"riskStatus": "MAYBE"}, good | {"ageMinutesAtEntry": None}, good | {"extra": 1}, {k: v for k, v in good.items() if k != "isProxy"}, good | {"quoteLiquidityUsd": 12.5}]
    d = spark.createDataFrame([(i, json.dumps(r)) for i, r in enumerate(rows)] + [(9, "[1]"), (10, "{"), (11, None)], "i int, j string")
    got = {r["i"]: r["e"] for r in d.select("i", texts.entry_features(F.col("j")).alias("e")).collect()}
    assert [i for i in got if got[i] is not None] == [0, 2, 6]
    assert got[0]["quoteLiquidityUsd"] == "12.5" and got[2]["uniqueBuyers1h"] == 3 and got[0]["isProxy"] is False


def test_ids_quoted(spark):
    raw = '{"update_id":123,"message":{"id":-45,"date":12345678901234567890,"text":"a, 12345678901234567890, \\"id\\":7"}}'
    want = '{"update_id":"123","message":{"id":"-45","date":12345678901234567890,"text":"a, 12345678901234567890, \\"id\\":7"}}'
    assert one(spark, texts.quote_wide_integers(F.lit(raw))) == (want,)


def test_realized_tags(spark):
    from tidewatch.functions import judgment

    of = lambda tag, label, fall: one(spark, judgment.came_true(F.lit(tag), F.lit(label), F.lit(fall)))[0]
    assert of("RUG_LP_PULL", "RUGGED", 0) and not of("RUG_LP_PULL", "BLED", 9000)
    assert of("CONCENTRATION_DUMP", "RUNNER", 5001) and not of("CONCENTRATION_DUMP", "RUNNER", 5000)
    assert of("NO_FOLLOW_THROUGH", "HELD_BAND", 0) and not of("NO_FOLLOW_THROUGH", "RUNNER", 0)
    assert of("OTHER", "RUGGED", 9000) is None
    assert one(spark, judgment.implied_bps(F.lit("RESEARCH"), F.lit(8000)), judgment.implied_bps(F.lit("WATCH"), F.lit(8000)), judgment.implied_bps(F.lit("PASS"), F.lit(8000))) == (8000, 5000, 2000)
    assert one(spark, judgment.liquidity_collapsed(F.lit(100.0), F.lit(19.9)), judgment.liquidity_collapsed(F.lit(100.0), F.lit(20.0)), judgment.liquidity_collapsed(F.lit(None).cast("double"), F.lit(1.0))) == (True, False, False)


def test_lookups(spark):
    from tidewatch.operators import lookup

    d = spark.createDataFrame([("A", 1, 5), ("b", 2, 4), ("c", 3, 3), ("a", 4, 9)], "k string, n int, t long")
    ns = lambda x: sorted(r["n"] for r in x.collect())
    assert ns(lookup.by_keys(d, "k", ["a", "B", "a", None], "lower")) == [1, 2, 4] and ns(lookup.by_keys(d, "k", ["a"])) == [4] and ns(lookup.by_keys(d, "k", [])) == []
    assert ns(lookup.since(d, "t", 4, F.col("n") < 4)) == [1, 2]
    assert ns(lookup.first_by(d.withColumn("g", F.lower("k")), ["g"], ["t", "n"])) == [1, 2, 3]


def test_first_rows_win_within_a_batch(spark, tmp_path):
    from tidewatch.streaming.ledger import Ledger

    rows = [(1, 30, "late"), (1, 10, "first"), (1, 20, "second"), (2, 5, "only")]
    d = spark.createDataFrame(rows, "k int, t long, v string").repartition(4)
    ledger = Ledger(spark, f"file://{tmp_path}/x")
    batch = ledger.begin("r", 0)
    got = batch.append_once("x", d, ["k"], first=["t"])
    batch.commit()
    assert {(r["k"], r["v"]) for r in got.collect()} == {(1, "first"), (2, "only")}
    again = ledger.begin("r", 1).append_once("x", d.withColumn("t", F.col("t") - 100), ["k"], first=["t"])
    assert again.count() == 0


def test_format_wad(spark):
    cases = {2500 * 10**18: "2500", 25 * 10**16: "0.25", -15 * 10**17: "-1.5", 0: "0", 1: "0.000000000000000001", 10**40 + 5 * 10**17: "10000000000000000000000.5"}
    got = one(spark, *[wide.format_wad(F.lit(str(x))) for x in cases])
    assert list(got) == list(cases.values())
