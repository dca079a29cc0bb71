"""Rules against the cases that define them."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from tidewatch.functions import contracts, rules, winners
from tidewatch.operators import asof, market


@pytest.mark.parametrize("bucket", [None, 7, 1000])
def test_latest_other(spark, bucket):
    pick = random.Random(4)
    r = [(i, pick.choice(["a", "b", None]), pick.choice([1, 1, 1, 2, 3, None]), pick.randrange(40)) for i in range(120)]
    l = [(1000 + i, pick.choice(["a", "b", "c", None]), pick.choice([1, 2, 9]), pick.randrange(45)) for i in range(60)]
    schema = "id long, name string, token int, t long"
    got = asof.latest_other(spark.createDataFrame(l, schema), spark.createDataFrame(r, schema), "name", "token", "t", "id", [], within=10, bucket=bucket).collect()
    assert len(got) == len(l)
    for row in got:
        found = [(t, i) for i, n, k, t in r if n is not None and n == row["name"] and k is not None and k != row["token"] and (t, i) < (row["t"], row["id"])]
        best = max(found, default=None)
        if best and row["t"] - best[0] > 10:
            best = None
        assert (row["other"] and (row["other"]["t"], row["other"]["id"])) == best


def gate(spark, **row):
    base = {"level": "YELLOW", "score": 90, "t": 100, "last_level": None, "last_score": None, "last_t": None, "sibling_level": None, "sibling_token": None} | row
    d = spark.createDataFrame([tuple(base.values())], "level string, score int, t long, last_level string, last_score int, last_t long, sibling_level string, sibling_token string")
    emit, reason = rules.alert_gate(30)
    return tuple(d.select(emit, reason).first())


def test_duplicate_names(spark):
    assert gate(spark) == (True, "first-alert")
    assert gate(spark, sibling_level="YELLOW", sibling_token="0xb") == (False, "duplicate-name:YELLOW@0xb")
    assert gate(spark, sibling_level="GREEN", sibling_token="0xb") == (False, "duplicate-name:GREEN@0xb")
    assert gate(spark, sibling_level="RED", sibling_token="0xb") == (True, "first-alert")
    assert gate(spark, level="GRAY", sibling_level="RED", sibling_token="0xb") == (False, "level-gray-never-emits")
    assert gate(spark, score=10, sibling_level="GREEN", sibling_token="0xb")[1] == "below-min-score"
    assert gate(spark, last_level="RED", last_score=80, last_t=99, sibling_level="YELLOW", sibling_token="0xb")[1].startswith("duplicate-name")


@pytest.mark.parametrize("text", ["liquidityDepth:28", "liquidityDepth:28,buyerBreadth:25,buyFlow:20,lowCapTilt:21", "depth:93", "liquidityDepth:x,buyerBreadth:25,buyFlow:20,lowCapTilt:20"])
def test_bad_weights(text):
    with pytest.raises(ValueError):
        winners.parse_weights(text)


def test_weights():
    assert winners.parse_weights(None) == winners.parse_weights("liquidityDepth:28,buyerBreadth:25,buyFlow:20,lowCapTilt:20")


def test_present_weights_give_the_score(spark):
    d = spark.createDataFrame([(a, b, c, e) for a in range(0, 29, 4) for b in range(0, 26, 5) for c in (0, 6, 20) for e in (0, 10, 20)], "liquidityDepth int, buyerBreadth int, buyFlow int, lowCapTilt int")
    same = winners.weighted_score(lambda k: F.lit(float(winners.MAXIMA[k]))) == sum(F.col(k) for k in winners.MAXIMA)
    assert d.where(~same).count() == 0


def test_sweep_by_hand(spark):
    rows = [("tune", True, "RED", 28, 0, 0, 20, 30_000, None), ("tune", True, "YELLOW", 0, 25, 20, 0, 10_000, "DIED"), ("tune", True, "GRAY", 28, 25, 20, 20, 60_000, None), ("tune", False, "GREEN", 28, 25, 20, 20, 60_000, None), ("confirm", True, "GREEN", 10, 10, 10, 10, 10_000, "SURVIVED")]
    d = spark.createDataFrame(rows, "period string, eligible boolean, level string, liquidityDepth int, buyerBreadth int, buyFlow int, lowCapTilt int, mult int, outcome string")
    grid = {"breadth": winners.parse_weights("liquidityDepth:10,buyerBreadth:60,buyFlow:20,lowCapTilt:3")}
    got = {r["period"]: r for r in winners.sweep(d, grid, 46, 48).collect()}
    t = got["tune"]
    # base: the red one has 48 and is in, the yellow one 45 and isn't; breadth turns that round
    assert (t["n"], t["winners"], t["winners_5x"], t["caught_base"], t["caught"], t["hits_base"], t["hits"], t["losers_let_in"], t["let_in_died"]) == (4, 3, 2, 1, 1, 1, 0, 1, 1)
    assert (t["delta_hits"], t["precision_base"], t["recall"]) == (-1, 1.0, 0.0) and got["confirm"]["caught"] == 0
    assert tuple(winners.ceiling(d, caught=48, reachable=45).first()) == (3, 1, 0, 2, 0)


def tier(spark, trusted=True, snaps=True, shadow=None, replay=None):
    kind = "struct<eligible:boolean,score:int,level:string>"
    d = spark.createDataFrame([(trusted, snaps, shadow, replay)], f"trusted boolean, snaps boolean, shadow {kind}, replay {kind}")
    d = d.withColumn("gate", winners.gate_attribution("shadow", "replay", 40, 50))
    return tuple(d.select(winners.coverage_tier(F.col("trusted"), F.col("snaps"), "gate"), "gate.source", "gate.floor").first())


def test_ladder(spark):
    good = (True, 60, "RED")
    assert tier(spark, trusted=False, shadow=good) == (2, "shadow", 50)
    assert tier(spark, snaps=False) == (3, "none", 40)
    assert tier(spark) == (4, "none", 40)
    assert tier(spark, shadow=(False, 90, "GREEN"), replay=good)[:2] == (5, "shadow")
    assert tier(spark, replay=(True, 45, "RED")) == (6, "replay", 50)
    assert tier(spark, replay=(True, 45, "YELLOW")) == (7, "replay", 40)
    assert tier(spark, replay=(True, 99, "GRAY"))[0] == 6
    assert tier(spark, replay=(True, None, "GREEN"))[0] == 7


def test_feedback(spark):
    a = [("hit", "p", "GREEN"), ("seen", "p", "YELLOW"), ("low", "p", "RED"), ("both", "p", "GREEN")]
    d = [("seen", None, "ENTERED"), ("bad", "q", "ENTERED"), ("both", "p", "ENTERED")]
    o = [("hit", "p2", "SURVIVED"), ("seen", "p", "SURVIVED"), ("bad", "q", "DIED"), ("miss", "m", "SURVIVED"), ("low", "p", "SURVIVED"), ("both", "p", "DIED"), ("both", "p", "SURVIVED"), ("trade", "t", "DIED")]
    w = [("trade", "t", "BUY"), ("trade", "t", "SELL"), ("nothing", "n", "BUY")]
    f = lambda rows, name: spark.createDataFrame(rows, f"token string, pool string, {name} string")
    got = {r["token"]: (r["quadrant"], r["pools"], r["sides"]) for r in winners.feedback(f(a, "level"), f(d, "action"), f(o, "outcome"), f(w, "side")).collect()}
    assert got == {"hit": ("SYSTEM-HIT/OPERATOR-MISS", ["p", "p2"], []), "bad": ("BAD-ENTRY", ["q"], []), "miss": ("SYSTEM-MISS", ["m"], []), "trade": ("BAD-ENTRY", ["t"], ["BUY", "SELL"])}


def test_holders(spark):
    b = spark.createDataFrame([("t", "a", 50), ("t", "b", 30), ("t", "pool", 100), ("t", "zero", 20), ("x", "zero", 5)], "token string, holder string, balance long")
    e = spark.createDataFrame([("t", "pool", "pool"), ("t", "zero", "zero-address"), ("x", "zero", "zero-address")], "token string, holder string, reason string")
    k = spark.createDataFrame([("t", "b", 400), ("x", "zero", 10), ("none", None, 0)], "token string, deployer string, total_supply long")
    got = {r["token"]: tuple(r)[1:] for r in market.holder_report(b, e, k).collect()}
    assert got["t"] == (4, 2, 5000, 10000, 10000, 3750, 6250, 2500)
    assert got["x"] == (1, 0, 10000, 10000, 0, None, 5000, 0)
    assert got["none"] == (0, 0, 0, 0, 0, None, None, None)


def test_top_sums_of_a_hot_key(spark):
    d = spark.range(5000).selectExpr("1 AS token", "id AS balance").repartition(8)
    assert market.top_sums(d, "token", "balance", {"top": F.lit(True)}, 10).first()["top"] == sum(range(4990, 5000))


def test_risk_reasons(spark):
    def of(ver="VERIFIED", proxy="none", sim="PASS", why=None, **states):
        s = {k: F.lit(states.get(k, "ABSENT")) for k in contracts.PERMISSIONS}
        status, risks, good = contracts.risk_reasons(F.lit(ver), F.lit(proxy), s, F.lit(sim).cast("string"), F.array(F.lit(why)) if why else F.lit(None).cast("array<string>"))
        return tuple(spark.range(1).select(status, risks, good).first())

    assert of() == ("PASS", [], ["Contract source is verified", "Buy and sell simulate successfully through the real route"])
    assert of(proxy="beacon")[0] == "UNKNOWN" and "Contract is a proxy (beacon); logic can change" in of(proxy="beacon")[1]
    assert of(mint="PRESENT")[:2] == ("FAIL", ["Critical privileged capability present: mint"])
    assert of(pause="ANALYSIS_FAILED")[:2] == ("UNKNOWN", ["Privileged-permission analysis incomplete: pause"])
    assert of(ownership="PRESENT", transferTax="UNKNOWN")[:2] == ("PASS", ["Owner-controlled administrative functions present"])
    assert of(sim=None)[:2] == ("UNKNOWN", ["Trade simulation was not performed"])
    assert of(ver="UNVERIFIED", sim="FAIL", why="sell reverted")[:2] == ("FAIL", ["Contract source is not verified", "sell reverted"])


def test_anchor_chain(spark):
    rows = [(1, 1, 0, 10.0, 20_000.0), (2, 1, 0, 10.0, 30_000.0), (3, 2, 1, 100.0, 5.0), (4, 2, 0, 50.0, 14_999.0), (5, 3, 2, 1.0, 10.0), (6, 4, 3, 1.0, 1e9), (7, 5, 5, 1.0, 1e9), (8, 6, 0, 0.0, 1e9)]
    d = spark.createDataFrame(rows, "pool long, a long, b long, reserve_a double, reserve_b double")
    got = {r["asset"]: (r["price"], r["pool"], r["hop"]) for r in market.anchor_chain(d, 0, 2, 10_000).collect()}
    assert got == {0: (1.0, None, 0), 1: (3000.0, 2, 1), 2: (14_999 / 50, 4, 1)}
    deeper = market.anchor_chain(d, 0, 3, 1000)
    assert {r["asset"]: r["hop"] for r in deeper.collect()} == {0: 0, 1: 1, 2: 1, 3: 2, 4: 3}


def test_round_trips(spark):
    d = spark.createDataFrame([(10**9, 10**9), (0, 10**9), (10, 10**9)], "base_reserve long, quote_reserve long")
    got = [[p["loss_bps"] for p in r["curve"]] for r in market.slippage_curve(d, F.lit(1_000_000), [1, 100]).collect()]

    def trip(rb, rq, raw):
        out = lambda a, i, o: a * 9970 * o // (i * 10_000 + a * 9970)
        back = out(out(raw, rq, rb), rb, rq)
        return max(0, (raw - back) * 10_000 // raw)

    assert got == [[trip(10**9, 10**9, 10**6), trip(10**9, 10**9, 10**8)], [None, None], [None, None]]
