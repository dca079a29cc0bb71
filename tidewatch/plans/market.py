"""Holder reports, risk verdicts, anchors and slippage over the tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import contracts
from ..operators import market
from ..sources.tables import read, spread
from .catalogue import query
from .history import _MOVES, _balances

_CLAMP = "CASE WHEN supply > 0 THEN greatest(0, least(10000, greatest({0}, 0) * 10000 // supply))::BIGINT END"


@query(f"""WITH {_MOVES}, s AS (SELECT t AS token, CASE WHEN t <> 3 THEN t * 3 + 1 END AS deployer, CASE WHEN t = 5 THEN 0 ELSE 30000 + t * 7 END AS supply FROM (SELECT unnest([0, 1, 2, 3, 4, 5, 6, 7]) AS t)),
x AS (SELECT token, holder, holder % 26 = 0 AS pool FROM b WHERE holder % 13 = 0),
r AS (SELECT b.*, x.holder IS NOT NULL AS gone, coalesce(x.pool, false) AS pool, row_number() OVER (PARTITION BY b.token ORDER BY balance DESC) AS k, row_number() OVER (PARTITION BY b.token, x.holder IS NULL ORDER BY balance DESC) AS ko FROM b LEFT JOIN x USING (token, holder)),
g AS (SELECT s.token, any_value(deployer) AS deployer, any_value(supply) AS supply, count(r.holder) AS holders, count(r.holder) FILTER (NOT gone) AS adjusted_holders, coalesce(sum(balance), 0)::BIGINT AS total, coalesce(sum(balance) FILTER (NOT gone), 0)::BIGINT AS own, coalesce(max(balance), 0) AS largest,
  coalesce(sum(balance) FILTER (k <= 10), 0)::BIGINT AS top, coalesce(sum(balance) FILTER (NOT gone AND ko <= 10), 0)::BIGINT AS own_top, coalesce(sum(balance) FILTER (pool), 0)::BIGINT AS pooled, coalesce(sum(balance) FILTER (NOT gone AND holder = deployer), 0)::BIGINT AS deployed,
  any_value(deployer) IS NOT NULL AND coalesce(NOT bool_or(gone AND holder = deployer), true) AS known FROM s LEFT JOIN r USING (token) GROUP BY s.token)
SELECT token, holders, adjusted_holders, (CASE WHEN greatest(total, supply) > 0 THEN largest * 10000 // CASE WHEN total > 0 THEN total ELSE supply END ELSE 0 END)::BIGINT AS largest_bps, (CASE WHEN greatest(total, supply) > 0 THEN top * 10000 // CASE WHEN total > 0 THEN total ELSE supply END ELSE 0 END)::BIGINT AS top10_bps,
  (CASE WHEN own > 0 THEN own_top * 10000 // own ELSE 0 END)::BIGINT AS adjusted_top10_bps, CASE WHEN known THEN (CASE WHEN own > 0 THEN deployed * 10000 // own ELSE 0 END)::BIGINT END AS deployer_bps,
  {_CLAMP.format('supply - (total - own) - CASE WHEN known THEN deployed ELSE 0 END')} AS float_bps, {_CLAMP.format('pooled')} AS pool_bps FROM g""")
def holder_report(spark, sf):
    """Seven tokens and an eighth that nobody holds; holders of multiples of 13
    are excluded, of 26 they are pools; one token has no deployer, one no supply."""
    b = _balances(spark, sf)
    x = b.where("holder % 13 = 0").select("token", "holder", F.when(F.col("holder") % 26 == 0, "pool").otherwise("burn-address").alias("reason"))
    t = F.col("token")
    tokens = spark.range(8).select(F.col("id").alias("token")).join(b.select("token").distinct(), "token", "left").select(t, F.when(t != 3, t * 3 + 1).alias("deployer"), F.when(t == 5, 0).otherwise(30_000 + t * 7).alias("total_supply"))
    return market.holder_report(b, x, tokens)


_STATE = {k: f"CASE WHEN p_partkey % {n} = 0 THEN 'PRESENT' WHEN p_partkey % {n} = 1 THEN '{w}' ELSE 'ABSENT' END" for (k, n), w in zip({"mint": 11, "blacklist": 13, "pause": 17, "upgradeAdmin": 19, "transferTax": 5, "ownership": 7}.items(), ["UNKNOWN", "ANALYSIS_FAILED", "UNKNOWN", "UNKNOWN", "UNKNOWN", "UNKNOWN"])}
_CRITICAL = ", ".join(f"s_{k}" for k, yes in contracts.PERMISSIONS.items() if yes)


def _line(k: str, critical: bool) -> str:
    words = {"transferTax": "Adjustable transfer-tax capability present", "ownership": "Owner-controlled administrative functions present"}.get(k, f"Critical privileged capability present: {k}")
    gap = f" WHEN s_{k} IN ('UNKNOWN', 'ANALYSIS_FAILED') THEN 'Privileged-permission analysis incomplete: {k}'" if critical else ""
    return f"CASE WHEN s_{k} = 'PRESENT' THEN '{words}'{gap} END"


@query(f"""WITH p AS (SELECT p_partkey AS id, CASE p_partkey % 3 WHEN 0 THEN 'VERIFIED' WHEN 1 THEN 'UNVERIFIED' ELSE 'UNKNOWN' END AS ver, CASE p_partkey % 10 WHEN 0 THEN 'beacon' WHEN 1 THEN 'eip1967' ELSE 'none' END AS proxy,
  CASE p_size % 5 WHEN 0 THEN 'FAIL' WHEN 1 THEN 'UNKNOWN' WHEN 2 THEN NULL ELSE 'PASS' END AS sim, {', '.join(f"CASE WHEN p_partkey % 10 = 0 THEN 'UNKNOWN' ELSE {s} END AS s_{k}" for k, s in _STATE.items())} FROM part)
SELECT id, CASE WHEN list_contains([{_CRITICAL}], 'PRESENT') OR coalesce(sim, '') = 'FAIL' THEN 'FAIL' WHEN list_has_any([{_CRITICAL}], ['UNKNOWN', 'ANALYSIS_FAILED']) OR coalesce(sim, 'UNKNOWN') = 'UNKNOWN' THEN 'UNKNOWN' ELSE 'PASS' END AS status,
  array_to_string(list_filter([CASE ver WHEN 'UNVERIFIED' THEN 'Contract source is not verified' WHEN 'UNKNOWN' THEN 'Contract verification status is unknown' END, CASE WHEN proxy <> 'none' THEN 'Contract is a proxy (' || proxy || '); logic can change' END, {', '.join(_line(k, y) for k, y in contracts.PERMISSIONS.items())},
    CASE WHEN sim IS NULL THEN 'Trade simulation was not performed' WHEN sim = 'FAIL' THEN 'Sell reverted' END], lambda x: x IS NOT NULL), '; ') AS risks,
  array_to_string(list_filter([CASE WHEN ver = 'VERIFIED' THEN 'Contract source is verified' END, CASE WHEN sim = 'PASS' THEN 'Buy and sell simulate successfully through the real route' END], lambda x: x IS NOT NULL), '; ') AS good FROM p""")
def risk_verdicts(spark, sf):
    k = F.col("p_partkey")
    p = read(spark, sf, "part").select(
        k.alias("id"), F.when(k % 3 == 0, "VERIFIED").when(k % 3 == 1, "UNVERIFIED").otherwise("UNKNOWN").alias("ver"), F.when(k % 10 == 0, "beacon").when(k % 10 == 1, "eip1967").otherwise("none").alias("proxy"),
        F.when(F.col("p_size") % 5 == 0, "FAIL").when(F.col("p_size") % 5 == 1, "UNKNOWN").when(F.col("p_size") % 5 == 2, None).otherwise("PASS").alias("sim"), *[F.expr(s).alias(f"s_{name}") for name, s in _STATE.items()],
    )
    failed = F.when(F.col("sim") == "FAIL", F.array(F.lit("Sell reverted")))
    status, risks, good = contracts.risk_reasons(F.col("ver"), F.col("proxy"), {name: F.col(f"s_{name}") for name in contracts.PERMISSIONS}, F.col("sim"), failed)
    return p.select("id", status.alias("status"), F.array_join(risks, "; ").alias("risks"), F.array_join(good, "; ").alias("good"))


def _hop(n: int) -> str:
    return f"""r{n} AS (SELECT asset, price, pool, hop FROM (SELECT e.asset, e.pool, e.other * k.price AS depth, e.other / e.own * k.price AS price, {n} AS hop, row_number() OVER (PARTITION BY e.asset ORDER BY e.other * k.price DESC, e.pool) AS i
  FROM e JOIN k{n - 1} k ON k.asset = e.quote WHERE e.asset NOT IN (SELECT asset FROM k{n - 1})) WHERE i = 1 AND depth >= 5000), k{n} AS (SELECT * FROM k{n - 1} UNION ALL SELECT * FROM r{n})"""


@query(f"""WITH p AS (SELECT s_suppkey AS pool, s_nationkey AS a, s_suppkey % 40 AS b, (s_suppkey * 10 + 7)::DOUBLE AS ra, s_acctbal::DOUBLE AS rb FROM supplier WHERE s_nationkey <> s_suppkey % 40 AND s_acctbal > 0),
e AS (SELECT pool, a AS asset, b AS quote, ra AS own, rb AS other FROM p UNION ALL SELECT pool, b, a, rb, ra FROM p), k0 AS (SELECT 0::BIGINT AS asset, 1.0::DOUBLE AS price, NULL::BIGINT AS pool, 0 AS hop), {_hop(1)}, {_hop(2)}, {_hop(3)} SELECT asset, price, pool, hop FROM k3""")
def anchor_chain(spark, sf):
    """Suppliers as pools of a nation's asset and another, priced from asset 0 in
    up to three hops."""
    k = F.col("s_suppkey")
    p = read(spark, sf, "supplier").select(k.cast("bigint").alias("pool"), F.col("s_nationkey").cast("bigint").alias("a"), (k % 40).cast("bigint").alias("b"), (k * 10 + 7).cast("double").alias("reserve_a"), F.col("s_acctbal").cast("double").alias("reserve_b"))
    return market.anchor_chain(p, 0, 3, 5_000)


_LEG = "CASE WHEN {1} > 0 AND {2} > 0 AND {0} * 9970 * {2} // ({1} * 10000 + {0} * 9970) > 0 THEN {0} * 9970 * {2} // ({1} * 10000 + {0} * 9970) END"


@query(f"""WITH p AS (SELECT p_partkey AS id, (p_size * 100000)::HUGEINT AS base, (CASE WHEN p_partkey % 11 = 0 THEN 0 ELSE p_partkey * 1000 END)::HUGEINT AS quote FROM part),
n AS (SELECT p.*, notional, cents * 1000 // 100 AS raw FROM p, (VALUES ('1', 100::HUGEINT), ('25.5', 2550), ('1000', 100000)) AS t(notional, cents)),
b AS (SELECT *, {_LEG.format('raw', 'quote', 'base')} AS bought FROM n), s AS (SELECT *, CASE WHEN bought IS NOT NULL THEN {_LEG.format('bought', 'base', 'quote')} END AS back FROM b)
SELECT id, notional, CASE WHEN back IS NOT NULL THEN greatest(0, (raw - back) * 10000 // raw)::BIGINT END AS loss_bps FROM s""")
def slippage_curve(spark, sf):
    """Round trips of three sizes through the reserves of every part's pool."""
    k = F.col("p_partkey")
    p = spread(read(spark, sf, "part").select("p_partkey", "p_size"), "p_partkey").select(k.alias("id"), (F.col("p_size").cast("bigint") * 100_000).alias("base_reserve"), F.when(k % 11 == 0, 0).otherwise(k * 1000).cast("bigint").alias("quote_reserve"))
    return market.slippage_curve(p, F.lit(1000), [1, 25.5, 1000]).select("id", F.inline("curve"))
