"""Winners that were lost, weights that would have caught them, disagreements."""

from __future__ import annotations

from itertools import product

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions import rules, winners
from ..sources.tables import alerts, labels, read, sql, swaps
from .catalogue import query
from .judgment import _JSON_SQL, replayed_parts
from .reports import _BREADTH, _DEPTH, _FAILED, _FLOW, _TILT

FLOOR, FLOOR_RED = 40, 50


def evaluated(spark: SparkSession, sf: str) -> DataFrame:
    """Replayed parts: eligibility, level and components, which don't depend on
    weights; the multiple, the period and the outcome come from the part."""
    d = replayed_parts(spark, sf).where("e IS NOT NULL")
    d = d.withColumn("eligible", F.size(rules.failed_rules()) == 0).withColumn("score", rules.opportunity())
    d = d.withColumns({"level": rules.alert_level(), "liquidityDepth": rules.liquidity_depth(), "buyerBreadth": rules.buyer_breadth(), "buyFlow": rules.buy_flow(), "lowCapTilt": rules.low_cap_tilt()})
    k = F.col("id")
    period, outcome = F.when(k % 3 == 0, "tune").when(k % 3 == 1, "confirm").otherwise("neither"), F.when(k % 4 == 0, "DIED").when(k % 4 == 1, "SURVIVED")
    return d.withColumns({"period": period, "outcome": outcome, "mult": k * 7919 % 60_000})


#: The same in SQL.
_EVALUATED = f"""{_JSON_SQL}, v AS (SELECT *, len({_FAILED}) = 0 AS eligible, {_DEPTH} AS d, {_BREADTH} AS b, {_FLOW} AS w, {_TILT} AS l FROM f),
r AS (SELECT *, greatest(0, least(100, d + b + w + l)) AS score, CASE id % 3 WHEN 0 THEN 'tune' WHEN 1 THEN 'confirm' ELSE 'neither' END AS period, CASE id % 4 WHEN 0 THEN 'DIED' WHEN 1 THEN 'SURVIVED' END AS outcome, id * 7919 % 60000 AS mult FROM v),
x AS (SELECT *, CASE WHEN eligible AND score >= 80 AND buyers_1h >= 20 AND simulation = 'PASS' AND fdv BETWEEN 15000 AND 40000 THEN 'GREEN' WHEN eligible AND score >= 65 AND fdv BETWEEN 15000 AND 60000 AND coalesce(total_liq >= 8000, false) THEN 'YELLOW'
  WHEN fdv BETWEEN 10000 AND 100000 AND coalesce(quote_liq >= 2500, false) AND buyers_1h >= 5 AND NOT coalesce(critical, false) THEN 'RED' ELSE 'GRAY' END AS level FROM r)"""
#: Fifty sets of weights: what three of four components have, the last gets the rest.
GRID = [(a, b, w) for a, b, w in product(range(8, 48, 8), range(5, 45, 10), range(0, 30, 10)) if a + b + w <= 93][:50]
_GRID = ", ".join(f"({a}, {b}, {w}, {93 - a - b - w})" for a, b, w in GRID)


@query(f"""WITH {_EVALUATED}, g AS (SELECT * FROM (VALUES {_GRID}) AS t(w1, w2, w3, w4)),
y AS (SELECT g.*, period, outcome, mult >= 20000 AS win, mult >= 50000 AS win5, eligible AND level <> 'GRAY' AND d + b + w + l >= CASE level WHEN 'RED' THEN {FLOOR_RED} ELSE {FLOOR} END AS base,
  eligible AND level <> 'GRAY' AND floor(d / 28.0::DOUBLE * w1 + b / 25.0::DOUBLE * w2 + w / 20.0::DOUBLE * w3 + l / 20.0::DOUBLE * w4 + 0.5) >= CASE level WHEN 'RED' THEN {FLOOR_RED} ELSE {FLOOR} END AS caught FROM x, g),
a AS (SELECT w1 || '-' || w2 || '-' || w3 || '-' || w4 AS weights, period, count(*) AS n, count(*) FILTER (win) AS winners, count(*) FILTER (win5) AS winners_5x, count(*) FILTER (base) AS caught_base, count(*) FILTER (caught) AS caught,
  count(*) FILTER (base AND win) AS hits_base, count(*) FILTER (caught AND win) AS hits, count(*) FILTER (base AND win5) AS hits_5x_base, count(*) FILTER (caught AND win5) AS hits_5x,
  count(*) FILTER (caught AND NOT base AND NOT win) AS losers_let_in, count(*) FILTER (caught AND NOT base AND NOT win AND outcome = 'DIED') AS let_in_died, count(*) FILTER (caught AND NOT base AND NOT win AND outcome = 'SURVIVED') AS let_in_survived,
  count(*) FILTER (caught AND NOT base AND NOT win AND outcome IS NULL) AS let_in_unknown FROM y GROUP BY 1, 2)
SELECT *, caught - caught_base AS delta_caught, hits - hits_base AS delta_hits, hits_5x - hits_5x_base AS delta_hits_5x, CASE WHEN caught_base = 0 THEN 0 ELSE hits_base / caught_base END AS precision_base, CASE WHEN winners = 0 THEN 0 ELSE hits_base / winners END AS recall_base,
  CASE WHEN caught = 0 THEN 0 ELSE hits / caught END AS precision, CASE WHEN winners = 0 THEN 0 ELSE hits / winners END AS recall FROM a""")
def sweep_comparison(spark, sf):
    """Fifty sets of weights against the present ones, by period."""
    grid = {"-".join(map(str, (*g, 93 - sum(g)))): winners.parse_weights(",".join(f"{k}:{v}" for k, v in zip(winners.MAXIMA, (*g, 93 - sum(g))))) for g in GRID}
    return winners.sweep(evaluated(spark, sf), grid, FLOOR, FLOOR_RED)


@query(f"""WITH {_EVALUATED}, y AS (SELECT d + b + w + l AS s, NOT eligible OR level = 'GRAY' AS gate FROM x WHERE mult >= 20000)
SELECT count(*) AS winners, count(*) FILTER (NOT gate AND s >= 60) AS already_caught, count(*) FILTER (NOT gate AND s >= 45 AND s < 60) AS reachable, count(*) FILTER (gate) AS gate_blocked, count(*) FILTER (NOT gate AND s < 45) AS below FROM y""")
def reachable_ceiling(spark, sf):
    return winners.ceiling(evaluated(spark, sf), caught=60, reachable=45)


@query(f"""WITH {_EVALUATED},
p AS (SELECT p_partkey AS id, p_size % 12 <> 0 AS trusted, p_partkey % 10 <> 3 AS snaps, p_partkey % 4 = 0 AS shadow, p_size % 5 <> 0 AS se, p_size * 2 AS ss, CASE p_size % 3 WHEN 0 THEN 'GRAY' WHEN 1 THEN 'RED' ELSE 'YELLOW' END AS sl FROM part),
g AS (SELECT p.*, CASE WHEN shadow THEN 'shadow' WHEN x.id IS NOT NULL THEN 'replay' ELSE 'none' END AS source, CASE WHEN shadow THEN se ELSE x.eligible END AS eligible, CASE WHEN shadow THEN ss ELSE x.score END AS score, CASE WHEN shadow THEN sl ELSE x.level END AS level FROM p LEFT JOIN x USING (id)),
t AS (SELECT source, CASE WHEN NOT trusted THEN 2 WHEN NOT snaps THEN 3 WHEN source = 'none' THEN 4 WHEN NOT eligible THEN 5 WHEN level = 'GRAY' OR score < CASE level WHEN 'RED' THEN {FLOOR_RED} ELSE {FLOOR} END THEN 6 ELSE 7 END AS tier FROM g)
SELECT tier::INT AS tier, ['undiscovered', 'no-trusted-quote', 'enriched-late', 'signals-missing', 'hard-gated', 'below-floor', 'caught'][tier] AS label, source, count(*) AS n FROM t GROUP BY 1, 2, 3""")
def coverage_tier(spark, sf):
    """Parts as winners: a logged decision of every fourth, else the replay of
    their features, and the stage that would have hidden them."""
    p = read(spark, sf, "part").select(F.col("p_partkey").alias("id"), F.col("p_size").alias("z"))
    level = F.when(F.col("z") % 3 == 0, "GRAY").when(F.col("z") % 3 == 1, "RED").otherwise("YELLOW")
    shadow = F.when(F.col("id") % 4 == 0, F.struct((F.col("z") % 5 != 0).alias("eligible"), (F.col("z") * 2).alias("score"), level.alias("level")))
    replay = evaluated(spark, sf).select("id", F.struct("eligible", "score", "level").alias("replay"))
    p = p.join(replay, "id", "left").withColumn("shadow", shadow).withColumn("gate", winners.gate_attribution("shadow", "replay", FLOOR, FLOOR_RED))
    tier = winners.coverage_tier(F.col("z") % 12 != 0, F.col("id") % 10 != 3, "gate")
    return p.groupBy(tier.cast("int").alias("tier"), F.col("gate.source").alias("source")).agg(F.count("*").alias("n")).withColumn("label", winners.tier_label(F.col("tier")))


@query(sql("alerts labels_ swaps", """, a AS (SELECT token, id % 7 AS pool, level FROM alerts WHERE id % 50 = 0 AND level <> 'GRAY'), d AS (SELECT c_custkey AS token, CASE WHEN c_custkey % 2 = 0 THEN c_custkey % 7 END AS pool, CASE c_custkey % 5 WHEN 0 THEN 'ENTERED' WHEN 1 THEN 'PASSED' ELSE 'WATCHED' END AS action FROM customer WHERE c_custkey % 3 = 0),
o AS (SELECT token, id % 7 AS pool, CASE status WHEN 'F' THEN 'DIED' ELSE 'SURVIVED' END AS outcome FROM labels_ WHERE status <> 'P' AND id % 20 = 0), w AS (SELECT buyer * 7 AS token, pool, side FROM swaps WHERE id % 100 = 0 AND side <> 'UNKNOWN'),
u AS (SELECT token, pool, level, NULL AS action, NULL AS outcome, NULL AS side FROM a UNION ALL SELECT token, pool, NULL, action, NULL, NULL FROM d UNION ALL SELECT token, pool, NULL, NULL, outcome, NULL FROM o UNION ALL SELECT token, pool, NULL, NULL, NULL, side FROM w),
g AS (SELECT token, string_agg(DISTINCT pool::VARCHAR, ',' ORDER BY pool::VARCHAR) AS pools, string_agg(DISTINCT level, ',' ORDER BY level) AS levels, string_agg(DISTINCT action, ',' ORDER BY action) AS actions, string_agg(DISTINCT outcome, ',' ORDER BY outcome) AS outcomes, string_agg(DISTINCT side, ',' ORDER BY side) AS sides,
  count(level) AS alerts, bool_or(coalesce(level IN ('YELLOW', 'GREEN'), false)) AS tier, bool_or(coalesce(action = 'ENTERED', false) OR coalesce(side = 'BUY', false)) AS entered, bool_or(coalesce(outcome = 'SURVIVED', false)) AS survived, bool_or(coalesce(outcome = 'DIED', false)) AS died FROM u GROUP BY token),
q AS (SELECT *, CASE WHEN tier AND survived AND NOT entered THEN 'SYSTEM-HIT/OPERATOR-MISS' WHEN entered AND died AND NOT survived THEN 'BAD-ENTRY' WHEN survived AND alerts = 0 THEN 'SYSTEM-MISS' END AS quadrant FROM g)
SELECT token, coalesce(pools, '') AS pools, coalesce(levels, '') AS levels, coalesce(actions, '') AS actions, coalesce(outcomes, '') AS outcomes, coalesce(sides, '') AS sides, quadrant FROM q WHERE quadrant IS NOT NULL"""))
def feedback_quadrants(spark, sf):
    """Alerts, decisions, outcomes and detected trades by token."""
    a = alerts(spark, sf).where("id % 50 = 0 AND level <> 'GRAY'").select("token", (F.col("id") % 7).alias("pool"), "level")
    k = F.col("c_custkey")
    d = read(spark, sf, "customer").where(k % 3 == 0).select(k.alias("token"), F.when(k % 2 == 0, k % 7).alias("pool"), F.when(k % 5 == 0, "ENTERED").when(k % 5 == 1, "PASSED").otherwise("WATCHED").alias("action"))
    o = labels(spark, sf).where("status <> 'P' AND id % 20 = 0").select("token", (F.col("id") % 7).alias("pool"), F.when(F.col("status") == "F", "DIED").otherwise("SURVIVED").alias("outcome"))
    w = swaps(spark, sf).where("id % 100 = 0 AND side <> 'UNKNOWN'").select((F.col("buyer") * 7).alias("token"), "pool", "side")
    text = lambda c: F.array_join(F.sort_array(F.col(c).cast("array<string>")), ",").alias(c)
    return winners.feedback(a, d, o, w).select("token", *[text(c) for c in ("pools", "levels", "actions", "outcomes", "sides")], "quadrant")
