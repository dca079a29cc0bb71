"""Contract risk, valuation and anchors."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import abi, contracts, rules
from ..functions.scalars import shortfall_bps
from ..sources.tables import read
from .catalogue import query

_SELECTED = ("mint", "pause", "ownership", "upgradeAdmin")


def _contracts(spark, sf):
    """Parts as contracts: three storage words and code."""
    p, n = read(spark, sf, "part"), F.col("p_partkey")
    word = lambda k: F.when(n % k == 0, F.concat(F.lit("0x"), F.lpad(F.lower(F.hex("p_partkey")), 64, "0"))).when(n % 2 == 0, F.lit("0x" + "0" * 64))
    code = F.when(n % 13 != 0, F.concat(F.lit("0x60"), F.md5(F.col("p_name").cast("binary")), *[F.when(n % (3 + i) == 0, contracts.SELECTORS[k][0]).otherwise("00") for i, k in enumerate(_SELECTED)]))
    return p.select(n.alias("id"), word(3).alias("implementation"), word(5).alias("legacy"), word(7).alias("beacon"), code.alias("code"))


_WORD = "CASE WHEN p_partkey % {0} = 0 THEN '0x' || lpad(lower(to_hex(p_partkey)), 64, '0') WHEN p_partkey % 2 = 0 THEN '0x' || repeat('0', 64) END AS {1}"
_CODE = "CASE WHEN p_partkey % 13 <> 0 THEN '0x60' || md5(p_name) || " + " || ".join(f"CASE WHEN p_partkey % {3 + i} = 0 THEN '{contracts.SELECTORS[k][0]}' ELSE '00' END" for i, k in enumerate(_SELECTED)) + " END AS code"
_CONTRACTS = "WITH k AS (SELECT p_partkey AS id, " + ", ".join([_WORD.format(3, "implementation"), _WORD.format(5, "legacy"), _WORD.format(7, "beacon"), _CODE]) + " FROM part), s AS (SELECT *, implementation IS NOT NULL AND NOT regexp_full_match(implementation, '0x0*') AS i, legacy IS NOT NULL AND NOT regexp_full_match(legacy, '0x0*') AS l, beacon IS NOT NULL AND NOT regexp_full_match(beacon, '0x0*') AS b FROM k) "


@query(_CONTRACTS + "SELECT id, CASE WHEN i THEN 'eip1967' WHEN l THEN 'legacy' WHEN b THEN 'beacon' ELSE 'none' END AS kind, CASE WHEN i THEN '0x' || right(implementation, 40) WHEN l THEN '0x' || right(legacy, 40) END AS logic FROM s")
def proxy_kind(spark, sf):
    k = _contracts(spark, sf)
    kind = contracts.proxy_kind(F.col("implementation"), F.col("beacon"), F.col("legacy"))
    return k.withColumn("kind", kind).select("id", "kind", F.when(F.col("kind") == "eip1967", contracts.slot_address(F.col("implementation"))).when(F.col("kind") == "legacy", contracts.slot_address(F.col("legacy"))).alias("logic"))


def _state(kind):
    return f"CASE WHEN code IS NULL THEN 'UNKNOWN' WHEN {' OR '.join(f'contains(code, {s!r})' for s in contracts.SELECTORS[kind])} THEN 'PRESENT' ELSE 'ABSENT' END"


@query(_CONTRACTS + ", ".join(["SELECT id"] + [f"{_state(k)} AS {k}" for k in contracts.SELECTORS]) + ", list_contains([" + ", ".join(map(_state, ("mint", "blacklist", "pause", "upgradeAdmin"))) + "], 'PRESENT') AS critical FROM k")
def permission_findings(spark, sf):
    code = F.col("code")
    return _contracts(spark, sf).select("id", *[contracts.permission(code, k).alias(k) for k in contracts.SELECTORS], contracts.critical(code).alias("critical"))


@query("SELECT status, count(*) AS n FROM (SELECT CASE WHEN s_suppkey % 7 = 0 THEN 'UNKNOWN' WHEN s_suppkey % 3 = 0 OR s_suppkey % 4 = 0 THEN 'UNVERIFIED' ELSE 'VERIFIED' END AS status FROM supplier) GROUP BY 1")
def verification_status(spark, sf):
    k = F.col("s_suppkey")
    abi = F.when(k % 3 == 0, "  ").when(k % 4 == 0, "Contract source code not verified").otherwise("[]")
    s = read(spark, sf, "supplier").select(contracts.verification(k % 7 != 0, abi).alias("status"))
    return s.groupBy("status").agg(F.count("*").alias("n"))


_PROBE = "p AS (SELECT p_partkey AS id, p_partkey % 17 = 0 AS br, p_partkey % 19 = 0 AS sr, p_partkey % 23 = 0 AS tr, CASE WHEN p_partkey % 5 <> 0 THEN p_size - 1 END AS bo, CASE WHEN p_partkey % 6 <> 0 THEN p_size * (p_partkey % 10) // 10 END AS so, p_size AS spot FROM part), l AS (SELECT *, CASE WHEN NOT sr AND so IS NOT NULL AND spot > 0 THEN greatest(0, (spot - so) * 10000 // spot) END AS loss FROM p)"


@query("WITH " + _PROBE + " SELECT id, CASE WHEN br OR sr OR tr OR coalesce(loss >= 5000, false) THEN 'FAIL' WHEN bo IS NULL OR bo <= 0 OR so IS NULL OR so <= 0 THEN 'UNKNOWN' ELSE 'PASS' END AS status, loss::BIGINT AS sell_loss_bps FROM l")
def simulation_class(spark, sf):
    n, size = F.col("p_partkey"), F.col("p_size")
    p = read(spark, sf, "part").select(n.alias("id"), (n % 17 == 0).alias("br"), (n % 19 == 0).alias("sr"), (n % 23 == 0).alias("tr"), F.when(n % 5 != 0, size - 1).alias("bo"), F.when(n % 6 != 0, F.expr("p_size * (p_partkey % 10) div 10")).alias("so"), size.alias("spot"))
    loss = F.when(~F.col("sr"), shortfall_bps(F.col("spot"), F.col("so")))
    buy, sell = contracts.leg(F.col("br"), F.col("bo")), contracts.leg(F.col("sr"), F.col("so"))
    return p.withColumn("loss", loss).select("id", contracts.simulation(buy, sell, F.col("tr"), F.col("loss")).alias("status"), F.col("loss").alias("sell_loss_bps"))


@query("SELECT o_orderkey AS id, CASE WHEN o_orderstatus = 'P' THEN 'ERROR' WHEN o_orderkey % 100 > 60 THEN 'STALE' WHEN o_orderstatus = 'O' THEN 'PASS' ELSE 'FAIL' END AS status FROM orders")
def effective_risk_status(spark, sf):
    status = F.when(F.col("o_orderstatus") == "P", "ERROR").when(F.col("o_orderstatus") == "O", "PASS").otherwise("FAIL")
    o = read(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), status.alias("status"), (F.col("o_orderkey") % 100).alias("age"))
    return o.select("id", rules.effective_risk(60).alias("status"))


_MORE = "q AS (SELECT p_partkey AS id, CASE p_partkey % 3 WHEN 0 THEN 'PASS' WHEN 1 THEN 'FAIL' ELSE 'UNKNOWN' END AS simulation, p_partkey % 5 = 1 AS critical, CASE WHEN p_partkey % 4 <> 0 THEN p_partkey % 4 = 1 END AS is_proxy, CASE p_partkey % 7 WHEN 0 THEN 'VERIFIED' WHEN 1 THEN 'UNVERIFIED' ELSE 'UNKNOWN' END AS verification, CASE WHEN p_partkey % 6 <> 0 THEN p_partkey * 37 % 1000 END AS deployer_bps, CASE WHEN p_partkey % 8 <> 0 THEN p_partkey * 53 % 9000 END AS top10_bps, CASE WHEN p_partkey % 9 <> 0 THEN p_partkey * 71 % 5000 END AS largest_bps, CASE WHEN p_partkey % 10 <> 0 THEN p_partkey % 40 END AS holders, CASE WHEN p_partkey % 2 = 0 THEN p_partkey % 30 END AS adjusted_holders, CASE WHEN p_partkey % 3 <> 0 THEN p_partkey * 89 % 10001 END AS gini_bps, CASE WHEN p_partkey % 3 <> 1 THEN p_partkey * 97 % 10001 END AS entropy_bps, CASE WHEN p_partkey % 3 <> 2 THEN p_partkey * 61 % 10001 END AS repeated_bps FROM part)"


@query("WITH " + _MORE + """ SELECT id, array_to_string(list_filter([CASE WHEN simulation = 'PASS' THEN 'Trade simulation passes through the real route' END, CASE WHEN verification = 'VERIFIED' THEN 'Contract source is verified' END, CASE WHEN deployer_bps <= 100 THEN 'Deployer holds a negligible share' END, CASE WHEN top10_bps < 2000 THEN 'Adjusted top-10 ownership is well distributed' END, CASE WHEN coalesce(adjusted_holders, holders) > 0 THEN 'Adjusted holder count is ' || coalesce(adjusted_holders, holders) END], lambda x: x IS NOT NULL), '; ') AS positive,
array_to_string(list_filter([CASE WHEN simulation <> 'PASS' THEN 'Sell simulation is not confirmed (status ' || simulation || ')' END, CASE WHEN critical THEN 'A critical privileged permission is present' END, CASE WHEN is_proxy THEN 'Contract is a proxy; logic can change' END, CASE WHEN verification = 'UNVERIFIED' THEN 'Contract source is not verified' END, CASE WHEN deployer_bps > 800 THEN 'Deployer holds a large share (' || deployer_bps || ' bps of supply)' END, CASE WHEN top10_bps >= 6000 THEN 'Adjusted top-10 ownership is highly concentrated (' || top10_bps || ' bps)' END, CASE WHEN largest_bps >= 3000 THEN 'A single holder controls a large share (' || largest_bps || ' bps)' END, CASE WHEN gini_bps >= 7000 THEN 'Buy sizes are highly concentrated in one buyer (Gini ' || gini_bps || ' bps)' END, CASE WHEN entropy_bps <= 3000 THEN 'Buy-size entropy is low (' || entropy_bps || ' bps of max)' END, CASE WHEN repeated_bps >= 4000 THEN 'A large share of buys repeat an identical quote size (' || repeated_bps || ' bps)' END], lambda x: x IS NOT NULL), '; ') AS risk FROM q""")
def advisory_reasons(spark, sf):
    """All reasons worth no points, for and against; every signal is missing for
    some rows."""
    k = F.col("p_partkey")
    some = lambda keep, x: F.when(keep, x)
    q = read(spark, sf, "part").select(k.alias("id"), F.when(k % 3 == 0, "PASS").when(k % 3 == 1, "FAIL").otherwise("UNKNOWN").alias("simulation"), (k % 5 == 1).alias("critical"), some(k % 4 != 0, k % 4 == 1).alias("is_proxy"), F.when(k % 7 == 0, "VERIFIED").when(k % 7 == 1, "UNVERIFIED").otherwise("UNKNOWN").alias("verification"), some(k % 6 != 0, k * 37 % 1000).alias("deployer_bps"), some(k % 8 != 0, k * 53 % 9000).alias("top10_bps"), some(k % 9 != 0, k * 71 % 5000).alias("largest_bps"), some(k % 10 != 0, k % 40).alias("holders"), some(k % 2 == 0, k % 30).alias("adjusted_holders"), some(k % 3 != 0, k * 89 % 10001).alias("gini_bps"), some(k % 3 != 1, k * 97 % 10001).alias("entropy_bps"), some(k % 3 != 2, k * 61 % 10001).alias("repeated_bps"))
    return q.select("id", F.array_join(contracts.positives(), "; ").alias("positive"), F.array_join(contracts.advisory(), "; ").alias("risk"))


_ANCHOR = "d AS (SELECT s_nationkey AS pair, s_suppkey AS pool, s_acctbal AS depth FROM supplier), a AS (SELECT pair, pool, depth FROM (SELECT *, row_number() OVER (PARTITION BY pair ORDER BY depth DESC, pool) AS r FROM d) WHERE r = 1 AND depth >= 5000)"


def _anchors(spark, sf):
    """Of each pair the deepest pool, the first of equals, if deep enough."""
    d = read(spark, sf, "supplier").select(F.col("s_nationkey").alias("pair"), F.col("s_suppkey").alias("pool"), F.col("s_acctbal").alias("depth"))
    best = d.groupBy("pair").agg(F.max_by(F.struct("pool", "depth"), F.struct(F.col("depth"), -F.col("pool"))).alias("b"))
    return best.select("pair", "b.pool", "b.depth").where("depth >= 5000")


@query("WITH " + _ANCHOR + " SELECT * FROM a")
def usd_anchor(spark, sf):
    return _anchors(spark, sf)


@query("WITH " + _ANCHOR + ", v AS (SELECT c_custkey AS id, c_custkey % 9 <> 0 AS trusted, CASE WHEN c_custkey % 11 <> 0 THEN c_custkey % 40 END AS decimals, a.depth AS anchor, c_acctbal AS liq, CASE WHEN c_custkey % 13 <> 0 THEN 1 END AS value FROM customer LEFT JOIN a ON a.pair = c_nationkey) SELECT reason, count(*) AS n FROM (SELECT CASE WHEN NOT trusted THEN 'no-trusted-quote' WHEN decimals IS NULL OR decimals > 36 THEN 'metadata-error' WHEN anchor IS NULL THEN 'no-usd-anchor' WHEN liq <= 0 THEN 'zero-liquidity' WHEN value IS NULL THEN 'overflow' END AS reason FROM v) GROUP BY 1")
def valuation_reasons(spark, sf):
    k = F.col("c_custkey")
    c = read(spark, sf, "customer").join(_anchors(spark, sf).select(F.col("pair").alias("c_nationkey"), F.col("depth").alias("anchor")), "c_nationkey", "left")
    reason = contracts.null_reason(k % 9 != 0, F.when(k % 11 != 0, k % 40), F.col("anchor"), F.col("c_acctbal"), F.when(k % 13 != 0, 1))
    return c.groupBy(reason.alias("reason")).agg(F.count("*").alias("n"))


@query("SELECT l_orderkey AS k, l_linenumber AS n, l_suppkey AS buyer, (CASE WHEN l_linenumber % 2 = 0 THEN l_partkey - l_suppkey ELSE l_suppkey - l_partkey END)::BIGINT AS a0, (CASE WHEN l_linenumber % 2 = 0 THEN l_suppkey - 1000 ELSE l_partkey END)::BIGINT AS a1 FROM lineitem")
def decoded_swaps(spark, sf):
    """Event data of two kinds of pools, made from line items and read again."""
    x, y = F.col("l_partkey"), F.col("l_suppkey")
    u = lambda c: F.lpad(F.hex(c), 64, "0")
    s = lambda c: F.when(c < 0, F.lpad(F.hex(c), 64, "F")).otherwise(u(c))
    kind = F.when(F.col("l_linenumber") % 2 == 0, "v2").otherwise("v3")
    data = F.concat(F.lit("0x"), F.when(kind == "v2", F.concat(u(x), u(y), u(y), u(F.lit(1000)))).otherwise(F.concat(s(y - x), s(x))))
    i = read(spark, sf, "lineitem").select(F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("n"), kind.alias("kind"), data.alias("data"), F.concat(F.lit("0x"), u(y)).alias("topic"))
    a0, a1 = abi.swap_amounts(F.col("kind"), F.col("data"))
    return i.select("k", "n", F.conv(F.substring(abi.address(F.col("topic")), 3, 40), 16, 10).cast("bigint").alias("buyer"), a0.cast("bigint").alias("a0"), a1.cast("bigint").alias("a1"))
