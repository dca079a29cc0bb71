"""Lookups, lanes, sinks' row logic, and the remaining reports."""

from __future__ import annotations

from pyspark.sql import Window, functions as F

from ..operators import asof, ranks, stats
from ..operators.series import DAY, half_up
from ..operators.stats import r6
from ..sources.tables import alerts, labels, micros, read, snapshots, sql, swaps
from .catalogue import query

# ---- lookups


@query("SELECT l_orderkey AS a, l_linenumber AS b, count(*) AS n FROM lineitem WHERE least(l_suppkey, l_partkey % 100) = 3 AND greatest(l_suppkey, l_partkey % 100) BETWEEN 3 AND 60 GROUP BY 1, 2")
def unordered_pairs(spark, sf):
    """Pools of a pair, whichever side each asset is on."""
    i = read(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_suppkey").alias("x"), (F.col("l_partkey") % 100).alias("y"))
    pair = i.where((F.least("x", "y") == 3) & F.greatest("x", "y").between(3, 60))
    return pair.groupBy(F.col("l_orderkey").alias("a"), F.col("l_linenumber").alias("b")).agg(F.count("*").alias("n"))


@query(sql("swaps", "SELECT id, pool, side FROM swaps WHERE side IN ('BUY', 'SELL') AND buyer IN (SELECT c_custkey FROM customer WHERE c_nationkey = 3)"))
def wallet_swaps(spark, sf):
    wallets = read(spark, sf, "customer").where("c_nationkey = 3").select(F.col("c_custkey").alias("buyer"))
    return swaps(spark, sf).where(F.col("side").isin("BUY", "SELL")).join(wallets, "buyer", "left_semi").select("id", "pool", "side")


@query(sql("swaps", f"SELECT id, pool, t FROM swaps WHERE pool IN (1, 2, 3) AND t >= (SELECT max(t) FROM swaps) - {10 * DAY}"))
def swaps_since(spark, sf):
    s = swaps(spark, sf)
    last = s.agg(F.max("t").alias("top"))
    return s.where("pool IN (1, 2, 3)").join(F.broadcast(last), F.col("t") >= F.col("top") - 10 * DAY).select("id", "pool", "t")


_WANTED = 1_704_067_200_000_000


@query(f"SELECT w.n_nationkey AS k, coalesce((SELECT min(event_id) FROM events WHERE epoch_us(ts) >= {_WANTED} + w.n_nationkey * 129600000000), (SELECT max(event_id) + 1 FROM events)) AS block FROM nation w")
def block_at_time(spark, sf):
    """The first block at or after each wanted time; past the head, head + 1.
    Blocks and wanted times meet by the day: a day's first blocks (a running
    minimum from the end, over one row a day) tell where no block is left in the
    wanted day itself, so any number of wanted times costs one pass of blocks."""
    e = read(spark, sf, "events").select("event_id", micros("ts").alias("t")).withColumn("day", F.expr(f"t div {DAY}"))
    w = read(spark, sf, "nation").select(F.col("n_nationkey").alias("k"), (_WANTED + F.col("n_nationkey") * 129_600_000_000).alias("at")).withColumn("day", F.expr(f"at div {DAY}"))
    days = e.groupBy("day").agg(F.min("event_id").alias("least")).unionByName(w.select("day").distinct(), allowMissingColumns=True).groupBy("day").agg(F.min("least").alias("least"))
    after = days.select("day", F.min("least").over(Window.orderBy(F.desc("day")).rowsBetween(Window.unboundedPreceding, -1)).alias("after"))
    head = e.agg(F.max("event_id").alias("head"))
    inside = w.join(e, "day").where("t >= at").groupBy("k").agg(F.min("event_id").alias("own"))
    j = w.join(inside, "k", "left").join(after, "day", "left").join(F.broadcast(head))
    return j.select("k", F.coalesce(F.least("own", "after"), F.col("head") + 1).alias("block"))


@query(sql("alerts labels_", "SELECT l.id FROM labels_ l WHERE EXISTS (SELECT 1 FROM alerts a WHERE a.token = l.token AND a.t - 1000000000000000 <= l.t % 2000000000000)"))
def alerted_before(spark, sf):
    """An alert at or before a label's time: one minimum per token instead of a
    range join."""
    first = alerts(spark, sf).groupBy("token").agg(F.min("t").alias("first"))
    l = labels(spark, sf).join(first, "token")
    return l.where(F.col("first") - 1_000_000_000_000_000 <= F.col("t") % 2_000_000_000_000).select("id")


@query(sql("labels_", "SELECT id, token, t FROM labels_ WHERE horizon = '1-URGENT' AND t BETWEEN 820454400000000 AND 883612800000000 AND token NOT IN (SELECT s_suppkey FROM supplier) ORDER BY t, id LIMIT 100"))
def replay_candidates(spark, sf):
    l = labels(spark, sf).where("horizon = '1-URGENT' AND t BETWEEN 820454400000000 AND 883612800000000")
    seen = read(spark, sf, "supplier").select(F.col("s_suppkey").alias("token"))
    return l.join(seen, "token", "left_anti").orderBy("t", "id").limit(100).select("id", "token", "t")


@query(sql("alerts", "SELECT id FROM alerts WHERE level <> 'GRAY' AND score >= CASE WHEN level = 'RED' THEN greatest(60, 70) ELSE 60 END"))
def qualifying_volume(spark, sf):
    floor = F.when(F.col("level") == "RED", F.greatest(F.lit(60), F.lit(70))).otherwise(60)
    return alerts(spark, sf).where((F.col("level") != "GRAY") & (F.col("score") >= floor)).select("id")


@query(sql("snapshots", "SELECT pool, min(t) AS first_t, count(*) AS n FROM snapshots GROUP BY 1"))
def first_snapshot(spark, sf):
    return snapshots(spark, sf).groupBy("pool").agg(F.min("t").alias("first_t"), F.count("*").alias("n"))


@query(sql("snapshots", f", w AS (SELECT DISTINCT pool FROM snapshots WHERE fdv > 400000), z AS (SELECT pool FROM snapshots GROUP BY pool HAVING max(t) < (SELECT max(t) FROM snapshots) - {5 * DAY}) SELECT pool, min(lane)::INT AS lane FROM (SELECT pool, 0 AS lane FROM w UNION ALL SELECT pool, 1 FROM z) GROUP BY 1"))
def lane_union(spark, sf):
    """Two lanes without repeats; a pool of both is in the first."""
    s = snapshots(spark, sf)
    last = s.agg(F.max("t").alias("top"))
    idle = s.groupBy("pool").agg(F.max("t").alias("t")).join(F.broadcast(last), F.col("t") < F.col("top") - 5 * DAY).select("pool", F.lit(1).alias("lane"))
    return s.where("fdv > 400000").select("pool", F.lit(0).alias("lane")).unionByName(idle).groupBy("pool").agg(F.min("lane").alias("lane"))


# ---- what the sinks write


@query("WITH o AS (SELECT c_custkey AS chat, c_acctbal AS status, c_nationkey AS added FROM customer WHERE c_custkey % 3 <> 0), n AS (SELECT o_custkey AS chat, max(o_totalprice) AS status, 99 AS added FROM orders WHERE o_custkey % 2 = 0 GROUP BY 1) SELECT coalesce(o.chat, n.chat) AS chat, coalesce(n.status, o.status) AS status, coalesce(o.added, n.added)::BIGINT AS added FROM o FULL JOIN n ON o.chat = n.chat")
def upsert_keeping_first(spark, sf):
    """New status wins; the time of adding stays what it was."""
    old = read(spark, sf, "customer").where("c_custkey % 3 <> 0").select(F.col("c_custkey").alias("chat"), F.col("c_acctbal").alias("old"), F.col("c_nationkey").cast("bigint").alias("since"))
    new = read(spark, sf, "orders").where("o_custkey % 2 = 0").groupBy(F.col("o_custkey").alias("chat")).agg(F.max("o_totalprice").alias("new"))
    return old.join(new, "chat", "full").select("chat", F.coalesce("new", "old").alias("status"), F.coalesce("since", F.lit(99)).alias("added"))


@query("SELECT q AS quote, count(*) AS n, count(*) FILTER (was IS NULL AND q IS NOT NULL) AS updated FROM (SELECT CASE WHEN l_linenumber % 2 = 0 THEN l_suppkey % 10 END AS was, CASE WHEN l_linenumber % 2 = 0 THEN l_suppkey % 10 WHEN l_suppkey % 10 = 4 OR l_partkey % 10 = 4 THEN 4 WHEN l_suppkey % 10 = 2 OR l_partkey % 10 = 2 THEN 2 END AS q FROM lineitem) GROUP BY 1")
def renormalized_quotes(spark, sf):
    x, y = F.col("l_suppkey") % 10, F.col("l_partkey") % 10
    was = F.when(F.col("l_linenumber") % 2 == 0, x)
    now = F.coalesce(was, *[F.when((x == a) | (y == a), a) for a in (4, 2)])
    i = read(spark, sf, "lineitem").select(was.alias("was"), now.alias("quote"))
    return i.groupBy("quote").agg(F.count("*").alias("n"), F.count_if(F.col("was").isNull() & F.col("quote").isNotNull()).alias("updated"))


@query("WITH o AS (SELECT c_nationkey AS name, floor(c_acctbal)::BIGINT % 5 AS hash, c_custkey AS seen FROM customer), f AS (SELECT name, hash, min(seen) AS seen FROM o GROUP BY 1, 2) SELECT name, hash, row_number() OVER (PARTITION BY name ORDER BY seen)::INT AS version FROM f")
def prompt_versions(spark, sf):
    """A text seen before keeps its version, a new one gets the next."""
    c = read(spark, sf, "customer").select(F.col("c_nationkey").alias("name"), (F.floor("c_acctbal").cast("bigint") % 5).alias("hash"), F.col("c_custkey").alias("at"))
    f = c.groupBy("name", "hash").agg(F.min("at").alias("at"))
    return f.select("name", "hash", F.row_number().over(Window.partitionBy("name").orderBy("at")).alias("version"))


# ---- windows over touched keys


@query(sql("swaps", f", k AS (SELECT p_partkey AS pool FROM part), w AS (SELECT * FROM swaps WHERE t > (SELECT max(t) FROM swaps) - {2 * DAY}) SELECT k.pool, count(w.id) AS events, count(*) FILTER (w.side = 'BUY') AS buys, coalesce(sum(w.amount) FILTER (w.side = 'SELL'), 0)::BIGINT AS sold FROM k LEFT JOIN w ON w.pool = k.pool GROUP BY 1"))
def windowed_snapshots(spark, sf):
    """Pools without events get rows of zeros."""
    s = swaps(spark, sf)
    last = s.agg(F.max("t").alias("top"))
    w = s.join(F.broadcast(last), F.col("t") > F.col("top") - 2 * DAY).groupBy("pool").agg(F.count("*").alias("events"), F.count_if(F.col("side") == "BUY").alias("buys"), F.sum(F.when(F.col("side") == "SELL", F.col("amount"))).alias("sold"))
    k = read(spark, sf, "part").select(F.col("p_partkey").alias("pool"))
    z = lambda c: F.coalesce(F.col(c), F.lit(0)).alias(c)
    return k.join(w, "pool", "left").select("pool", z("events"), z("buys"), z("sold"))


@query("WITH m AS (SELECT l_orderkey % 7 AS token, l_suppkey AS src, l_partkey % 150 AS dst, l_quantity::BIGINT AS v, l_orderkey % 2 AS chunk FROM lineitem), n AS (SELECT token, src AS holder, -v AS v, chunk FROM m UNION ALL SELECT token, dst, v, chunk FROM m) SELECT token, holder, sum(v)::BIGINT AS balance FROM n GROUP BY 1, 2 HAVING count(*) FILTER (chunk = 1) > 0")
def touched_balances(spark, sf):
    """Balances after a second chunk, of the holders that it touches; one that
    falls to nothing is written too."""
    i = read(spark, sf, "lineitem").select((F.col("l_orderkey") % 7).alias("token"), F.col("l_suppkey").alias("src"), (F.col("l_partkey") % 150).alias("dst"), F.col("l_quantity").cast("bigint").alias("v"), (F.col("l_orderkey") % 2).alias("chunk"))
    moves = i.select("token", "chunk", F.explode(F.array(F.struct(F.col("src").alias("holder"), (-F.col("v")).alias("v")), F.struct(F.col("dst").alias("holder"), F.col("v").alias("v")))).alias("m"))
    g = moves.groupBy("token", F.col("m.holder").alias("holder")).agg(F.sum("m.v").alias("balance"), F.count_if(F.col("chunk") == 1).alias("touched"))
    return g.where("touched > 0").drop("touched")


# ---- reports


@query(sql("labels_", "SELECT horizon, floor(avg(dd) * 1e4 + 0.5) / 1e4 AS mean, floor(sqrt((sum(dd::HUGEINT * dd)::DOUBLE - sum(dd)::DOUBLE * sum(dd)::DOUBLE / count(*)) / count(*)) * 1e2 + 0.5) / 1e2 AS std, count(*) AS n FROM labels_ GROUP BY 1"))
def feature_stats(spark, sf):
    """Population mean and deviation."""
    return labels(spark, sf).groupBy("horizon").agg((F.floor(F.avg("dd") * 1e4 + 0.5) / 1e4).alias("mean"), (F.floor(F.stddev_pop("dd") * 1e2 + 0.5) / 1e2).alias("std"), F.count("*").alias("n"))


@query(sql("labels_", ", s AS (SELECT id, floor((dd % 36) / 35.0 * 40 + (mult % 26) / 25.0 * 30 + (id % 21) / 20.0 * 23 + 0.5)::BIGINT AS score FROM labels_) SELECT score, count(*) AS n FROM s GROUP BY 1"))
def counterfactual_scores(spark, sf):
    """Components over their maxima, times other weights, rounded half up."""
    part = lambda x, most, weight: F.col(x) % (most + 1) / F.lit(float(most)) * weight
    s = half_up(part("dd", 35, 40) + part("mult", 25, 30) + part("id", 20, 23))
    return labels(spark, sf).groupBy(s.alias("score")).agg(F.count("*").alias("n"))


@query(sql("labels_", ", q AS (SELECT dd // 2500 AS bucket, status = 'F' AS bad, status <> 'P' AS covered FROM labels_) SELECT bucket, floor(count(*) FILTER (covered) * 10000 / count(*) + 0.5)::BIGINT AS coverage_bps, floor(count(*) FILTER (bad) * 10000 / count(*) + 0.5)::BIGINT AS bad_bps FROM q GROUP BY 1 HAVING count(*) FILTER (covered) * 10000 / count(*) >= 6000"))
def coverage_gated_buckets(spark, sf):
    q = labels(spark, sf).groupBy(F.expr("dd div 2500").alias("bucket")).agg((F.count_if(F.col("status") != "P") * 10000 / F.count("*")).alias("c"), half_up(F.count_if(F.col("status") == "F") * 10000 / F.count("*")).alias("bad_bps"))
    return q.where("c >= 6000").select("bucket", half_up(F.col("c")).alias("coverage_bps"), "bad_bps")


_FEATURES = "x AS (SELECT s_suppkey AS id, CASE WHEN s_acctbal > 0 THEN log10(s_acctbal) END AS a, (s_nationkey * 7 % 25)::DOUBLE AS b FROM supplier), m AS (SELECT avg(a) AS ma, stddev_pop(a) AS sa, avg(b) AS mb, stddev_pop(b) AS sb FROM x), z AS (SELECT id, (a - ma) / sa AS a, (b - mb) / sb AS b FROM x, m)"


@query("WITH " + _FEATURES + ", d AS (SELECT p.id AS probe, z.id, floor(sqrt(coalesce((z.a - p.a) ** 2, 0) + (z.b - p.b) ** 2) * 1e6 + 0.5) / 1e6 AS distance FROM z JOIN z p ON p.id % 50 = 0 AND z.id <> p.id), r AS (SELECT *, (row_number() OVER (PARTITION BY probe ORDER BY distance, id))::INT AS rank FROM d) SELECT probe, id, rank FROM r WHERE rank <= 10")
def comparable_launches(spark, sf):
    """Nearest by standardised features; amounts by their logarithm, and a
    feature that either side lacks is left out. Probes are the stated set of
    ids divisible by 50."""
    s = read(spark, sf, "supplier").select(F.col("s_suppkey").alias("id"), F.when(F.col("s_acctbal") > 0, F.log10("s_acctbal")).alias("a"), (F.col("s_nationkey") * 7 % 25).cast("double").alias("b"))
    m = s.agg(*[f(c).alias(f"{n}{c}") for c in "ab" for n, f in (("m", F.avg), ("s", F.stddev_pop))])
    z = s.join(F.broadcast(m)).select("id", *[F.when(F.col(f"s{c}") > 0, (F.col(c) - F.col(f"m{c}")) / F.col(f"s{c}")).otherwise(F.col(c) * 0).alias(c) for c in "ab"])
    return stats.nearest_shared(z, z.where("id % 50 = 0"), ["a", "b"], 10).select("probe", "id", "rank")


@query(sql("alerts labels_", ", j AS (SELECT l.id, l.t, a.t - 900000000000000 AS seen, l.id % 10 = 0 AS late FROM labels_ l JOIN alerts a ON a.token = l.token), k AS (SELECT id, t, max(seen) FILTER (seen <= t) AS before, max(seen) AS newest, bool_or(late) AS late FROM j GROUP BY 1, 2) SELECT count(*) AS rows, count(*) FILTER (CASE WHEN late THEN newest ELSE before END > t) AS ahead, count(*) FILTER (late) AS unguarded FROM k WHERE CASE WHEN late THEN newest ELSE before END IS NOT NULL"))
def no_lookahead(spark, sf):
    """Evidence that is younger than its as-of time, counted. One label in ten
    gets its token's newest evidence whatever its time, the others the last one
    before; the guard (operators.asof.assert_no_lookahead) passes the latter and
    would fail the job on the former."""
    l = labels(spark, sf).select("id", "token", "t")
    a = alerts(spark, sf).select(F.col("id").alias("aid"), "token", (F.col("t") - 900_000_000_000_000).alias("t"), "score")
    newest = a.groupBy("token").agg(F.max("t").alias("newest"))
    m = asof.as_of(l, a, "token", "t", "aid", ["score"]).join(newest, "token", "left")
    late = F.col("id") % 10 == 0
    guarded = asof.assert_no_lookahead(m.where(~late).select("id", "t", F.col("match.t").alias("seen"), F.lit(False).alias("late")), "t", F.col("seen"))
    both = guarded.unionByName(m.where(late).select("id", "t", F.col("newest").alias("seen"), F.lit(True).alias("late"))).where("seen IS NOT NULL")
    return both.agg(F.count("*").alias("rows"), F.count_if(F.col("seen") > F.col("t")).alias("ahead"), F.count_if("late").alias("unguarded"))


@query(sql("labels_", ", x AS (SELECT horizon, mult, (mult >= 50000)::INT AS hit, CASE WHEN t < 820454400000000 THEN 'v1' ELSE 'v2' END AS v FROM labels_) SELECT v, horizon, count(*) AS n, sum(hit)::BIGINT AS hits, percentile_cont(0.5) WITHIN GROUP (ORDER BY mult) AS median, floor(avg(hit) * 1e6 + 0.5) / 1e6 AS rate FROM x GROUP BY 1, 2"))
def report_slices(spark, sf):
    x = labels(spark, sf).select("horizon", "mult", (F.col("mult") >= 50000).cast("int").alias("hit"), F.when(F.col("t") < 820454400000000, "v1").otherwise("v2").alias("v"))
    g = x.groupBy("v", "horizon").agg(F.count("*").alias("n"), F.sum("hit").alias("hits"), r6(F.avg("hit")).alias("rate"))
    return ranks.beside(g, ranks.medians(x, ["v", "horizon"], "mult"), ["v", "horizon"])
