"""Windows, labels, balances and dedup over history."""

from __future__ import annotations

from pyspark.sql import Window, functions as F

from ..functions import rules
from ..operators import series, stats
from ..operators.series import DAY, half_up
from ..sources.tables import alerts, labels, read, snapshots, sql, swaps
from .catalogue import query

W = 5 * DAY
H = 300 * DAY


@query(sql("swaps", f"SELECT a.id, a.pool, count(DISTINCT CASE WHEN b.side = 'BUY' THEN b.buyer END) AS buyers, count(*) FILTER (b.side = 'BUY') AS buys, count(*) FILTER (b.side = 'SELL') AS sells, coalesce(sum(b.amount) FILTER (b.side = 'BUY'), 0)::BIGINT AS buy_volume, coalesce(sum(b.amount) FILTER (b.side = 'SELL'), 0)::BIGINT AS sell_volume FROM swaps a JOIN swaps b ON a.pool IS NOT DISTINCT FROM b.pool AND b.t BETWEEN a.t - {W} AND a.t WHERE a.side = 'BUY' GROUP BY a.id, a.pool"))
def rolling_activity(spark, sf):
    return series.rolling_activity(swaps(spark, sf), W)


_TOTALS = ", x AS (SELECT pool, buyer, sum(amount)::HUGEINT AS x FROM swaps WHERE side = 'BUY' GROUP BY 1, 2)"


@query(sql("swaps", _TOTALS + ", r AS (SELECT *, row_number() OVER (PARTITION BY pool ORDER BY x, buyer) AS i FROM x), g AS (SELECT pool, count(*) AS n, sum(x)::HUGEINT AS s, sum(i * x)::HUGEINT AS ix FROM r GROUP BY pool) SELECT pool, CASE WHEN n >= 2 AND s > 0 THEN ((20000 * (2 * ix - (n + 1) * s) + n * s) // (2 * n * s))::BIGINT END AS gini_bps FROM g"))
def gini_bps(spark, sf):
    return series.gini_bps(swaps(spark, sf))


@query(sql("swaps", _TOTALS + ", y AS (SELECT *, sum(x) OVER (PARTITION BY pool)::DOUBLE AS s, count(*) OVER (PARTITION BY pool) AS n FROM x), g AS (SELECT pool, max(n) AS n, max(s) AS s, -sum(greatest(x / s, 1e-12) * ln(greatest(x / s, 1e-12))) / ln(max(n)) AS h FROM y WHERE n > 1 AND s > 0 GROUP BY pool) SELECT p.pool, CASE WHEN h IS NOT NULL THEN least(10000, greatest(0, floor(h * 10000 + 0.5)))::BIGINT END AS entropy_bps FROM (SELECT DISTINCT pool FROM x) p LEFT JOIN g ON g.pool IS NOT DISTINCT FROM p.pool"))
def entropy_bps(spark, sf):
    return series.entropy_bps(swaps(spark, sf))


@query(sql("swaps", ", c AS (SELECT pool, amount, count(*) AS n FROM swaps WHERE side = 'BUY' GROUP BY 1, 2) SELECT pool, floor(sum(CASE WHEN n >= 2 THEN n ELSE 0 END) * 10000 / sum(n) + 0.5)::BIGINT AS repeated_bps FROM c GROUP BY pool"))
def repeated_size_bps(spark, sf):
    return series.repeated_size_bps(swaps(spark, sf))


@query(sql("snapshots", ", v AS (SELECT *, lead(t) OVER (PARTITION BY pool ORDER BY t, id) AS nxt, max(liq) OVER (PARTITION BY pool) AS peak FROM snapshots WHERE liq IS NOT NULL), a AS (SELECT pool, max(peak) AS peak, arg_max(liq, (t, id)) AS latest, floor(sum(CASE WHEN liq >= peak * 0.8::DOUBLE THEN coalesce(nxt - t, 0) ELSE 0 END) / 60000000)::BIGINT AS minutes_near_peak FROM v GROUP BY pool) SELECT a.pool, peak, latest, CASE WHEN peak > 0 THEN floor((peak - latest) * 10000 / peak + 0.5)::BIGINT ELSE 0 END AS drawdown_bps, minutes_near_peak, n AS snapshots, peak > 0 AND latest < peak * 0.2::DOUBLE AS collapsed FROM a JOIN (SELECT pool, count(*) AS n FROM snapshots GROUP BY pool) USING (pool)"))
def liquidity_trajectory(spark, sf):
    return series.trajectory(snapshots(spark, sf))


@query("SELECT o_custkey AS token, arg_max(o_orderstatus, (o_orderdate, o_orderkey)) AS latest, (count(*) FILTER (o_orderstatus = 'O') - (arg_max(o_orderstatus, (o_orderdate, o_orderkey)) = 'O')::INT)::BIGINT AS prior_pass, arg_max(o_orderstatus, (o_orderdate, o_orderkey)) = 'F' AND count(*) FILTER (o_orderstatus = 'O') > 0 AS regressed FROM orders GROUP BY 1")
def simulation_regression(spark, sf):
    g = read(spark, sf, "orders").groupBy(F.col("o_custkey").alias("token")).agg(F.max_by("o_orderstatus", F.struct("o_orderdate", "o_orderkey")).alias("latest"), F.count_if(F.col("o_orderstatus") == "O").alias("ok"))
    return g.select("token", "latest", (F.col("ok") - (F.col("latest") == "O").cast("int")).alias("prior_pass"), ((F.col("latest") == "F") & (F.col("ok") > 0)).alias("regressed"))


@query(sql("snapshots", ", c AS (SELECT pool, arg_max(fdv, (t, id)) AS fdv, (max(t) - min(t)) / 60000000 AS age FROM snapshots GROUP BY pool HAVING max(t) > min(t)) SELECT a.pool, count(*) AS cohort, floor(avg((b.fdv <= a.fdv)::INT) * 10000 + 0.5)::BIGINT AS fdv_bps FROM c a JOIN c b ON a.pool <> b.pool AND b.age BETWEEN a.age * 0.5 AND a.age * 2 GROUP BY a.pool HAVING count(*) >= 8"))
def cohort_percentiles(spark, sf):
    return series.cohort_percentiles(snapshots(spark, sf))


_ENTRY = "e AS (SELECT pool, arg_min(t, id) AS t0, arg_min(fdv, id) AS p0 FROM snapshots WHERE fdv BETWEEN 50000 AND 200000 GROUP BY pool)"


@query(sql("snapshots", f", {_ENTRY}, b AS (SELECT s.pool, p0, (t - t0) // {60 * DAY} AS bucket, count(*) AS n, min(fdv) AS low, arg_max(liq, (t, id)) FILTER (liq IS NOT NULL) AS exit FROM snapshots s JOIN e USING (pool) WHERE t >= t0 GROUP BY 1, 2, 3 HAVING count(*) >= 2), r AS (SELECT *, row_number() OVER (PARTITION BY pool ORDER BY low DESC, bucket) AS k FROM b) SELECT pool, floor(low * 10000 / p0)::BIGINT AS sustained_bps, bucket, exit AS exit_liquidity FROM r WHERE k = 1"))
def sustained_peak(spark, sf):
    return series.sustained_peak(snapshots(spark, sf), 60 * DAY, 50_000, 200_000)


@query(sql("snapshots", f", f AS (SELECT pool, arg_min(t, id) AS t0 FROM snapshots GROUP BY pool), w AS (SELECT s.* FROM snapshots s JOIN f USING (pool) WHERE t BETWEEN t0 AND t0 + {H}), g AS (SELECT pool, max(liq) AS peak, count(liq) AS n, max(id) AS id FROM w GROUP BY pool) SELECT g.pool, peak, w.liq AS liq_at_horizon, CASE WHEN w.liq >= peak * 0.3::DOUBLE AND w.fdv >= 10000 THEN 'SURVIVED' ELSE 'DIED' END AS outcome FROM g JOIN w ON w.pool = g.pool AND w.id = g.id WHERE n >= 2 AND w.liq IS NOT NULL AND w.fdv IS NOT NULL"))
def outcome_label(spark, sf):
    return series.outcome_label(snapshots(spark, sf), H)


_NOW = 900_000_000_000_000


@query(sql("snapshots", f", {_ENTRY}, w AS (SELECT s.*, t0, p0 FROM snapshots s JOIN e USING (pool) WHERE t0 + {H} <= {_NOW} AND t BETWEEN t0 AND t0 + {H}), k AS (SELECT *, row_number() OVER (PARTITION BY pool ORDER BY fdv DESC, t, id) AS r FROM w), p AS (SELECT * FROM k WHERE r = 1) SELECT p.pool, greatest(10000, floor(p.fdv * 10000 / p.p0 + 0.5))::BIGINT AS multiple_bps, greatest(0, floor((p.p0 - least(p.p0, min(w.fdv) FILTER (w.t < p.t OR (w.t = p.t AND w.id <= p.id)))) * 10000 / p.p0 + 0.5))::BIGINT AS drawdown_bps, floor((p.t - p.t0) / 60000000 + 0.5)::BIGINT AS minutes_to_peak, count(*) AS snapshots FROM p JOIN w ON w.pool = p.pool GROUP BY p.pool, p.fdv, p.p0, p.t, p.t0, p.id"))
def performance_label(spark, sf):
    return series.performance_label(snapshots(spark, sf), H, 50_000, 200_000, _NOW)


@query(sql("labels_", ", x AS (SELECT *, dd > 8000 AS collapsed FROM labels_) SELECT horizon, CASE WHEN status = 'F' OR collapsed THEN 'RUGGED' WHEN mult >= 20000 THEN 'RUNNER' WHEN mult < 11000 THEN 'BLED' ELSE 'HELD_BAND' END AS taxonomy, count(*) AS n FROM x GROUP BY 1, 2"))
def realized_taxonomy(spark, sf):
    x = labels(spark, sf).withColumn("collapsed", F.col("dd") > 8000)
    return x.groupBy("horizon", rules.realized_taxonomy().alias("taxonomy")).agg(F.count("*").alias("n"))


# ---- balances: a line item moves its quantity from supplier to part

_MOVES = "m AS (SELECT l_orderkey % 7 AS token, l_suppkey AS src, l_partkey % 150 AS dst, l_quantity::BIGINT AS v FROM lineitem), n AS (SELECT token, src AS holder, -v AS v FROM m UNION ALL SELECT token, dst, v FROM m), b AS (SELECT token, holder, sum(v)::BIGINT AS balance FROM n GROUP BY 1, 2 HAVING sum(v) > 0)"


def _balances(spark, sf):
    i = read(spark, sf, "lineitem")
    return stats.net_balances(i.select((F.col("l_orderkey") % 7).alias("token"), F.col("l_suppkey").alias("src"), (F.col("l_partkey") % 150).alias("dst"), F.col("l_quantity").cast("bigint").alias("value")))


@query("WITH " + _MOVES + " SELECT * FROM b")
def balance_netting(spark, sf):
    return _balances(spark, sf)


@query("WITH " + _MOVES + ", r AS (SELECT *, holder % 13 = 0 AS o, row_number() OVER (PARTITION BY token, holder % 13 = 0 ORDER BY balance DESC, holder) AS k FROM b), g AS (SELECT token, count(*) AS holders, count(*) FILTER (NOT o) AS adjusted_holders, coalesce(sum(balance) FILTER (NOT o), sum(balance))::BIGINT AS base, coalesce(max(balance) FILTER (NOT o), 0) AS largest, coalesce(sum(balance) FILTER (NOT o AND k <= 10), 0)::BIGINT AS most FROM r GROUP BY token) SELECT token, holders, adjusted_holders, largest * 10000 // base AS largest_bps, most * 10000 // base AS top10_bps FROM g")
def holder_concentration(spark, sf):
    return stats.concentration(_balances(spark, sf))


@query("WITH " + _MOVES + ", r AS (SELECT *, row_number() OVER (PARTITION BY token ORDER BY balance DESC, holder) AS k FROM b) SELECT token, sum(balance)::BIGINT AS top3 FROM r WHERE k <= 3 GROUP BY token")
def top_n_share(spark, sf):
    w = Window.partitionBy("token").orderBy(F.desc("balance"), "holder")
    return _balances(spark, sf).withColumn("k", F.row_number().over(w)).where("k <= 3").groupBy("token").agg(F.sum("balance").alias("top3"))


# ---- dedup and sets


@query("SELECT user_id, event_type, min(event_id) AS event_id, arg_min(value, event_id) AS value FROM events GROUP BY 1, 2")
def first_wins_dedup(spark, sf):
    return read(spark, sf, "events").groupBy("user_id", "event_type").agg(F.min("event_id").alias("event_id"), F.min_by("value", "event_id").alias("value"))


@query(sql("labels_", ", old AS (SELECT DISTINCT token, horizon FROM labels_ WHERE id % 2 = 0), n AS (SELECT token, horizon, min(id) AS id FROM labels_ WHERE id % 2 = 1 GROUP BY 1, 2) SELECT n.* FROM n WHERE NOT EXISTS (SELECT 1 FROM old WHERE old.token = n.token AND old.horizon = n.horizon)"))
def append_once_new_rows(spark, sf):
    l = labels(spark, sf)
    new = l.where("id % 2 = 1").groupBy("token", "horizon").agg(F.min("id").alias("id"))
    return new.join(l.where("id % 2 = 0"), ["token", "horizon"], "left_anti")


@query(sql("alerts labels_", "SELECT token FROM alerts UNION SELECT token FROM labels_ UNION SELECT c_custkey FROM customer"))
def token_universe_union(spark, sf):
    c = read(spark, sf, "customer").select(F.col("c_custkey").alias("token"))
    return alerts(spark, sf).select("token").union(labels(spark, sf).select("token")).union(c).distinct()


@query("SELECT o_custkey AS holder, arg_max(o_totalprice, (o_orderdate, o_orderkey)) AS balance, max(o_orderdate)::DATE::VARCHAR AS updated FROM orders GROUP BY 1")
def upsert_latest_balance(spark, sf):
    o = read(spark, sf, "orders")
    return o.groupBy(F.col("o_custkey").alias("holder")).agg(F.max_by("o_totalprice", F.struct("o_orderdate", "o_orderkey")).alias("balance"), F.date_format(F.max("o_orderdate"), "yyyy-MM-dd").alias("updated"))
