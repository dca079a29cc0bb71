"""Dashboard aggregations, as-of joins and selection lanes."""

from __future__ import annotations

from pyspark.sql import Window, functions as F

from ..functions.scalars import level_rank, normal_name
from ..operators import asof, ranks, series, stats
from ..operators.series import DAY, half_up
from ..operators.stats import r6
from ..sources.tables import alerts, labels, micros, read, scores, snapshots, sql, swaps
from .catalogue import query

H = 30 * DAY
FLOORS = [0, *range(50, 100, 5)]


@query("SELECT o_orderpriority AS horizon, count(*) AS n, count(*) FILTER (o_orderstatus = 'O') AS survived, count(*) FILTER (o_orderstatus = 'F') AS died FROM orders GROUP BY 1")
def survival_by_horizon(spark, sf):
    o = read(spark, sf, "orders")
    return o.groupBy(F.col("o_orderpriority").alias("horizon")).agg(F.count("*").alias("n"), F.count_if(F.col("o_orderstatus") == "O").alias("survived"), F.count_if(F.col("o_orderstatus") == "F").alias("died"))


@query(sql("alerts", "SELECT count(*) AS alerts, count(*) FILTER (score >= 50) AS strong, count(DISTINCT token) AS tokens, count(DISTINCT CASE WHEN level = 'GREEN' THEN token END) AS green, count(DISTINCT CASE WHEN level = 'YELLOW' THEN token END) AS yellow, count(DISTINCT CASE WHEN level = 'RED' THEN token END) AS red FROM alerts"))
def funnel_summary(spark, sf):
    a = alerts(spark, sf)
    of = lambda x: F.count_distinct(F.when(F.col("level") == x, F.col("token"))).alias(x.lower())
    return a.agg(F.count("*").alias("alerts"), F.count_if(F.col("score") >= 50).alias("strong"), F.count_distinct("token").alias("tokens"), of("GREEN"), of("YELLOW"), of("RED"))


@query("SELECT strftime(o_orderdate, '%Y-%m-%d') AS day, count(*) AS launches, count(*) FILTER (o_totalprice >= 50000) AS in_band FROM orders WHERE o_orderdate > (SELECT max(o_orderdate) FROM orders) - INTERVAL 30 DAY GROUP BY 1")
def launch_cadence(spark, sf, days=30):
    o = read(spark, sf, "orders").select("o_orderdate", "o_totalprice")
    last = o.agg(F.max("o_orderdate").alias("last"))
    recent = o.join(F.broadcast(last), F.col("o_orderdate") > F.col("last") - F.expr(f"INTERVAL {int(days)} DAYS"))
    return recent.groupBy(F.date_format("o_orderdate", "yyyy-MM-dd").alias("day")).agg(F.count("*").alias("launches"), F.count_if(F.col("o_totalprice") >= 50000).alias("in_band"))


@query(sql("labels_ scores", f""", m AS (SELECT l.*, (SELECT s.score FROM scores s WHERE s.token = l.token AND s.t <= l.t + {DAY * 9000} ORDER BY s.t DESC, s.id DESC LIMIT 1) AS score FROM labels_ l),
 f AS (SELECT unnest({FLOORS}) AS floor)
SELECT f.floor::INT AS floor, count(m.id) AS n, coalesce(floor(avg((mult >= 20000)::INT) * 1e6 + 0.5) / 1e6, 0) AS share2, coalesce(floor(avg((mult >= 50000)::INT) * 1e6 + 0.5) / 1e6, 0) AS share5, coalesce(floor(avg((mult >= 100000)::INT) * 1e6 + 0.5) / 1e6, 0) AS share10
FROM f LEFT JOIN m ON m.score >= f.floor GROUP BY 1"""))
def score_precision_curve(spark, sf, horizon=None):
    """Flagship: as-of join of labels to scores with forward grace, folded over
    floors. Labels are grouped by score first, so floors meet 101 rows."""
    l = labels(spark, sf) if horizon is None else labels(spark, sf).where(F.col("horizon") == horizon)
    m = asof.as_of(l.select("id", "token", "t", "mult"), scores(spark, sf), "token", "t", "id", ["score"], grace=DAY * 9000)
    g = m.where("match IS NOT NULL").groupBy("match.score").agg(F.count("*").alias("c"), *[F.count_if(F.col("mult") >= x).alias(f"c{x}") for x in (20000, 50000, 100000)])
    floors = spark.range(1).select(F.explode(F.lit(FLOORS)).alias("floor"))
    j = F.broadcast(floors).join(g, F.col("score") >= F.col("floor"), "left").groupBy("floor").agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"), *[F.sum(f"c{x}").alias(f"c{x}") for x in (20000, 50000, 100000)])
    share = lambda x, n: F.coalesce(F.when(F.col("n") > 0, r6(F.col(f"c{x}") / F.col("n"))), F.lit(0.0)).alias(n)
    return j.select(F.col("floor").cast("int").alias("floor"), "n", share(20000, "share2"), share(50000, "share5"), share(100000, "share10"))


@query(sql("labels_", """, q AS (SELECT mult, dd, ntile(4) OVER (PARTITION BY horizon ORDER BY dd, id) AS bucket, horizon FROM labels_ WHERE status <> 'P')
SELECT horizon, bucket, count(*) AS n, min(dd) AS low, max(dd) AS high, percentile_cont(0.5) WITHIN GROUP (ORDER BY mult) AS median_mult, floor(avg((mult >= 20000)::INT) * 1e6 + 0.5) / 1e6 AS share2 FROM q GROUP BY 1, 2"""))
def feature_quartiles(spark, sf, horizon=None):
    l = labels(spark, sf) if horizon is None else labels(spark, sf).where(F.col("horizon") == horizon)
    q = ranks.ntile4(l.where("status <> 'P'"), ["horizon"], "dd", "id", "bucket").withColumn("bucket", F.col("bucket").cast("bigint"))
    g = q.groupBy("horizon", "bucket").agg(F.count("*").alias("n"), F.min("dd").alias("low"), F.max("dd").alias("high"), r6(F.avg((F.col("mult") >= 20000).cast("int"))).alias("share2"))
    return ranks.beside(g, ranks.medians(q, ["horizon", "bucket"], "mult", "median_mult"), ["horizon", "bucket"])


@query(sql("alerts labels_", """, r AS (SELECT a.id, a.token, a.level, a.t, c.c_name AS name FROM alerts a LEFT JOIN customer c ON c.c_custkey = a.token ORDER BY a.t DESC, a.id DESC LIMIT 200)
SELECT r.id, r.token, r.level, r.name, (SELECT l.mult FROM labels_ l WHERE l.token = r.token ORDER BY l.t DESC, l.id DESC LIMIT 1) AS mult, (SELECT l.dd FROM labels_ l WHERE l.token = r.token ORDER BY l.t DESC, l.id DESC LIMIT 1) AS dd FROM r"""))
def recent_alert_outcomes(spark, sf, limit=200):
    a = alerts(spark, sf).orderBy(F.desc("t"), F.desc("id")).limit(limit)
    names = read(spark, sf, "customer").select(F.col("c_custkey").alias("token"), F.col("c_name").alias("name"))
    l = asof.latest(labels(spark, sf), ["token"], ["t", "id"], ["mult", "dd"])
    return a.join(names, "token", "left").join(l, "token", "left").select("id", "token", "level", "name", "mult", "dd")


@query("SELECT CASE WHEN turn % 2 = 0 THEN 'v1' ELSE 'v2' END AS version, count(*) AS n, count(*) FILTER (role = 'user') AS users, floor(avg(length(text)) FILTER (role = 'assistant') * 1e6 + 0.5) / 1e6 AS mean_length FROM conversations WHERE text IS NOT NULL GROUP BY 1")
def judgment_quality_version(spark, sf):
    c = read(spark, sf, "conversations").where("text IS NOT NULL")
    v = F.when(F.col("turn") % 2 == 0, "v1").otherwise("v2").alias("version")
    return c.groupBy(v).agg(F.count("*").alias("n"), F.count_if(F.col("role") == "user").alias("users"), r6(F.avg(F.when(F.col("role") == "assistant", F.length("text")))).alias("mean_length"))


@query("SELECT strftime(date_trunc('week', ts), '%Y-%m-%d') AS week, count(*) AS n, count(*) FILTER (event_type = 'error') AS errors, floor(avg(value) FILTER (event_type = 'purchase') * 1e4 + 0.5) / 1e4 AS mean_value FROM events GROUP BY 1")
def judgment_quality_week(spark, sf):
    e = read(spark, sf, "events")
    return e.groupBy(F.date_format(F.date_trunc("week", "ts"), "yyyy-MM-dd").alias("week")).agg(F.count("*").alias("n"), F.count_if(F.col("event_type") == "error").alias("errors"), (F.floor(F.avg(F.when(F.col("event_type") == "purchase", F.col("value"))) * 1e4 + 0.5) / 1e4).alias("mean_value"))


# ---- latest, as-of, nearest


@query(sql("snapshots", "SELECT pool, fdv, id FROM (SELECT *, row_number() OVER (PARTITION BY pool ORDER BY t DESC, id DESC) AS rn FROM snapshots) WHERE rn = 1"))
def latest_snapshot_by_time(spark, sf):
    return asof.latest(snapshots(spark, sf), ["pool"], ["t", "id"], ["fdv", "id"])


@query(sql("snapshots", "SELECT pool, max(id) AS id, arg_max(fdv, id) AS fdv FROM snapshots GROUP BY pool"))
def latest_snapshot_by_id(spark, sf):
    return asof.latest(snapshots(spark, sf), ["pool"], ["id"], ["id", "fdv"])


_VIEWS = "SELECT event_id AS id, user_id AS u, epoch_us(ts) AS t, value FROM events WHERE event_type = 'view'"
_BUYS = "SELECT event_id AS id, user_id AS u, epoch_us(ts) AS t FROM events WHERE event_type = 'purchase'"


def _sides(spark, sf):
    e = read(spark, sf, "events").select(F.col("event_id").alias("id"), F.col("user_id").alias("u"), micros("ts").alias("t"), "value", "event_type")
    return e.where("event_type = 'purchase'").select("id", "u", "t"), e.where("event_type = 'view'").select("id", "u", "t", "value")


def _asof_sql(on: str, order: str, keep: str = "true") -> str:
    return f"WITH v AS ({_VIEWS}), b AS ({_BUYS}), j AS (SELECT b.id, b.u, v.id AS view_id, v.value, v.t AS vt, b.t AS bt, row_number() OVER (PARTITION BY b.id ORDER BY v.id IS NULL, {order}) AS rn FROM b LEFT JOIN v ON v.u = b.u AND {on}) SELECT id, u, CASE WHEN {keep} THEN view_id END AS view_id, CASE WHEN {keep} THEN value END AS value FROM j WHERE rn = 1"


def _matched(m):
    return m.select("id", "u", F.col("match.id").alias("view_id"), F.col("match.value").alias("value"))


@query(_asof_sql("v.t <= b.t", "v.t DESC, v.id DESC"))
def asof_backward(spark, sf):
    b, v = _sides(spark, sf)
    return _matched(asof.as_of(b, v, "u", "t", "id", ["value"], bucket=3 * DAY))


@query(_asof_sql(f"v.t <= b.t + {DAY}", "v.t DESC, v.id DESC"))
def asof_grace(spark, sf):
    b, v = _sides(spark, sf)
    return _matched(asof.as_of(b, v, "u", "t", "id", ["value"], grace=DAY, bucket=3 * DAY))


@query(_asof_sql("v.t <= b.t", "v.t DESC, v.id DESC", f"abs(bt - vt) <= {DAY}"))
def asof_tolerance(spark, sf):
    b, v = _sides(spark, sf)
    return _matched(asof.as_of(b, v, "u", "t", "id", ["value"], tolerance=DAY))


@query(_asof_sql("true", "abs(v.t - b.t), v.id DESC"))
def nearest_by_distance(spark, sf):
    b, v = _sides(spark, sf)
    return _matched(asof.nearest(b, v, "u", "t", "id", ["value"]))


@query(sql("snapshots", "SELECT max(t) AS newest, count(DISTINCT pool) AS pools FROM snapshots"))
def global_freshness(spark, sf):
    return snapshots(spark, sf).agg(F.max("t").alias("newest"), F.count_distinct("pool").alias("pools"))


# ---- lanes: pools are parts modulo 97 to match the snapshots' pools

_P = "p AS (SELECT p_partkey AS part, p_partkey % 97 AS pool FROM part)"
_LAST = "last AS (SELECT pool, max(id) AS id, arg_max(fdv, id) AS fdv, arg_max(coalesce(liq, -1), id) AS liq, max(t) AS t FROM snapshots GROUP BY pool)"


def _pools(spark, sf):
    return read(spark, sf, "part").select(F.col("p_partkey").alias("part"), (F.col("p_partkey") % 97).alias("pool"))


def _last(spark, sf):
    return snapshots(spark, sf).groupBy("pool").agg(F.max("id").alias("id"), F.max_by("fdv", "id").alias("fdv"), F.max_by("liq", "id").alias("liq"), F.max("t").alias("t"))


@query(sql("snapshots", f", {_P}, {_LAST} SELECT p.part FROM p WHERE EXISTS (SELECT 1 FROM last WHERE last.pool = p.pool AND fdv BETWEEN 50000 AND 200000 AND liq >= 25000)"))
def band_lane(spark, sf):
    band = _last(spark, sf).where("fdv BETWEEN 50000 AND 200000 AND liq >= 25000")
    return _pools(spark, sf).join(band, "pool", "left_semi").select("part")


@query(sql("snapshots", f", {_P}, {_LAST} SELECT p.part FROM p LEFT JOIN last USING (pool) WHERE p.part >= 1000 OR coalesce(fdv BETWEEN 10000 AND 100000, false)"))
def active_set(spark, sf):
    j = _pools(spark, sf).join(_last(spark, sf), "pool", "left")
    return j.where((F.col("part") >= 1000) | F.coalesce(F.col("fdv").between(10000, 100000), F.lit(False))).select("part")


@query(sql("snapshots", f", {_P}, {_LAST}, c AS (SELECT max(t) - {H} AS c FROM snapshots) SELECT part, t, (row_number() OVER (ORDER BY t NULLS FIRST, part))::INT AS place FROM p LEFT JOIN last USING (pool) WHERE NOT coalesce(fdv BETWEEN 10000 AND 100000, false) AND NOT EXISTS (SELECT 1 FROM snapshots s, c WHERE s.pool = p.pool AND s.t >= c.c) ORDER BY t NULLS FIRST, part LIMIT 500"))
def idle_lane_nulls_first(spark, sf):
    """Pools that aren't active and have no snapshot since the cut, the stalest
    first, those without any before them."""
    s = snapshots(spark, sf)
    cut = s.agg((F.max("t") - H).alias("cut"))
    fresh = s.join(F.broadcast(cut), F.col("t") >= F.col("cut")).select("pool").distinct()
    j = _pools(spark, sf).join(_last(spark, sf), "pool", "left").where(~F.coalesce(F.col("fdv").between(10000, 100000), F.lit(False))).join(fresh, "pool", "left_anti")
    top = j.orderBy(F.asc_nulls_first("t"), "part").limit(500)
    return top.select("part", "t", F.row_number().over(Window.orderBy(F.asc_nulls_first("t"), "part")).alias("place"))


@query(sql("snapshots", f", {_P} SELECT part FROM p WHERE NOT EXISTS (SELECT 1 FROM snapshots s WHERE s.pool = p.pool AND s.liq IS NOT NULL AND s.t >= (SELECT max(t) FROM snapshots) - {H})"))
def needs_refresh(spark, sf):
    s = snapshots(spark, sf)
    last = s.agg(F.max("t").alias("top"))
    fresh = s.where("liq IS NOT NULL").join(F.broadcast(last), F.col("t") >= F.col("top") - H)
    return _pools(spark, sf).join(fresh, "pool", "left_anti").select("part")


@query(sql("snapshots", f", d AS (SELECT DISTINCT pool FROM snapshots WHERE fdv BETWEEN 50000 AND 200000 AND t + {H} <= (SELECT max(t) FROM snapshots)) SELECT d.pool FROM d WHERE d.pool NOT IN (SELECT s_suppkey FROM supplier)"))
def due_performance(spark, sf):
    s = snapshots(spark, sf)
    last = s.agg(F.max("t").alias("top"))
    due = s.where("fdv BETWEEN 50000 AND 200000").join(F.broadcast(last), F.col("t") + H <= F.col("top")).select("pool").distinct()
    return due.join(read(spark, sf, "supplier"), F.col("pool") == F.col("s_suppkey"), "left_anti")


@query(sql("snapshots", f"SELECT pool, min(t) AS first_t FROM snapshots GROUP BY pool HAVING min(t) + {H} <= (SELECT max(t) FROM snapshots) AND pool NOT IN (SELECT n_nationkey FROM nation)"))
def due_outcome(spark, sf):
    s = snapshots(spark, sf)
    last = s.agg(F.max("t").alias("top"))
    due = s.groupBy("pool").agg(F.min("t").alias("first_t")).join(F.broadcast(last), F.col("first_t") + H <= F.col("top")).drop("top")
    return due.join(read(spark, sf, "nation"), F.col("pool") == F.col("n_nationkey"), "left_anti")


_RANK = "CASE level WHEN 'GREEN' THEN 3 WHEN 'YELLOW' THEN 2 WHEN 'RED' THEN 1 ELSE 0 END"


@query(sql("alerts", f", a AS (SELECT *, {_RANK} AS r FROM alerts), b AS (SELECT * FROM a WHERE score % 7 = 0) SELECT a.id FROM a WHERE a.level <> 'GRAY' AND a.id NOT IN (SELECT id FROM b) AND NOT EXISTS (SELECT 1 FROM b WHERE b.token = a.token AND b.t > a.t - {DAY} AND b.t <= a.t AND b.r >= a.r)"))
def alerts_needing_brief(spark, sf):
    """Briefs: alerts whose score is a multiple of 7. A token's last days are
    read by one window per token instead of a range join."""
    a = alerts(spark, sf).withColumn("r", level_rank(F.col("level"))).withColumn("brief", F.col("score") % 7 == 0)
    w = Window.partitionBy("token").orderBy("t").rangeBetween(-DAY + 1, 0)
    top = F.max(F.when(F.col("brief"), F.col("r"))).over(w)
    return a.withColumn("top", top).where((F.col("level") != "GRAY") & ~F.col("brief") & (F.col("top").isNull() | (F.col("top") < F.col("r")))).select("id")


@query(sql("labels_", "SELECT id, mult FROM labels_ l WHERE mult >= 50000 AND NOT EXISTS (SELECT 1 FROM lineitem i WHERE i.l_orderkey = l.id AND i.l_returnflag = 'R')"))
def winner_candidates(spark, sf):
    items = read(spark, sf, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("id"))
    return labels(spark, sf).where("mult >= 50000").join(items, "id", "left_anti").select("id", "mult")


@query(sql("snapshots", f"SELECT count(*) AS untrusted FROM snapshots WHERE liq IS NULL AND t >= (SELECT max(t) FROM snapshots) - {H}"))
def untrusted_census(spark, sf):
    s = snapshots(spark, sf)
    last = s.agg(F.max("t").alias("top"))
    return s.where("liq IS NULL").join(F.broadcast(last), F.col("t") >= F.col("top") - H).agg(F.count("*").alias("untrusted"))


@query(sql("snapshots", f", {_LAST}, x AS (SELECT pool, CASE WHEN fdv BETWEEN 50000 AND 200000 THEN 0 ELSE 1 END AS lane, t FROM last) SELECT pool, lane, (row_number() OVER (ORDER BY lane, t, pool))::INT AS place FROM x ORDER BY lane, t, pool LIMIT 60"))
def two_lane_fill(spark, sf):
    x = _last(spark, sf).select("pool", F.when(F.col("fdv").between(50000, 200000), 0).otherwise(1).alias("lane"), "t")
    top = x.orderBy("lane", "t", "pool").limit(60)
    return top.select("pool", "lane", F.row_number().over(Window.orderBy("lane", "t", "pool")).alias("place"))


# ---- joins


@query("WITH n AS (SELECT p_partkey AS id, regexp_replace(lower(p_name), '[^a-z0-9]+', '', 'g') AS name FROM part) SELECT a.id, count(*) AS siblings, min(b.id) AS first FROM n a JOIN n b ON a.name = b.name AND a.id <> b.id AND a.name <> '' GROUP BY a.id")
def similar_name_match(spark, sf):
    n = read(spark, sf, "part").select(F.col("p_partkey").alias("id"), normal_name(F.col("p_name")).alias("name")).where("name <> ''")
    g = n.groupBy("name").agg(F.count("*").alias("n"), F.min("id").alias("m")).where("n > 1")
    second = n.join(g, "name").where("id <> m").groupBy("name").agg(F.min("id").alias("m2"))
    j = n.join(g, "name").join(second, "name")
    return j.select("id", (F.col("n") - 1).alias("siblings"), F.when(F.col("id") == F.col("m"), F.col("m2")).otherwise(F.col("m")).alias("first"))


_TOKENS = "k AS (SELECT c.c_nationkey AS deployer, o.o_custkey AS token, max((o_orderstatus = 'O')::INT) AS alive, max((o_orderstatus = 'F')::INT) AS dead FROM customer c JOIN orders o ON o.o_custkey = c.c_custkey {} GROUP BY 1, 2)"


def _deployers(spark, sf, before=None):
    o = read(spark, sf, "orders").select("o_custkey", "o_orderstatus", "o_orderdate")
    if before is not None:
        o = o.where(F.col("o_orderdate") < F.lit(before).cast("timestamp_ntz"))
    t = o.groupBy(F.col("o_custkey").alias("token")).agg(F.max((F.col("o_orderstatus") == "O").cast("int")).alias("alive"), F.max((F.col("o_orderstatus") == "F").cast("int")).alias("dead"))
    c = read(spark, sf, "customer").select(F.col("c_custkey").alias("token"), F.col("c_nationkey").alias("deployer"))
    return c, t


@query("WITH " + _TOKENS.format("") + " SELECT c.c_nationkey AS deployer, count(DISTINCT c.c_custkey) AS tokens, coalesce(any_value(s), 0)::BIGINT AS survived, coalesce(any_value(d), 0)::BIGINT AS died FROM customer c LEFT JOIN (SELECT deployer, sum(alive) AS s, sum(CASE WHEN alive = 0 AND dead = 1 THEN 1 ELSE 0 END) AS d FROM k GROUP BY 1) x ON x.deployer = c.c_nationkey GROUP BY 1")
def deployer_history_live(spark, sf):
    c, t = _deployers(spark, sf)
    return c.join(t, "token", "left").groupBy("deployer").agg(F.count("*").alias("tokens"), F.coalesce(F.sum("alive"), F.lit(0)).alias("survived"), F.count_if((F.col("alive") == 0) & (F.col("dead") == 1)).alias("died"))


@query("WITH " + _TOKENS.format("AND o.o_orderdate < TIMESTAMP '1996-01-01'") + " SELECT deployer, count(*) AS tokens, sum(alive)::BIGINT AS survived, sum(CASE WHEN alive = 0 AND dead = 1 THEN 1 ELSE 0 END)::BIGINT AS died FROM k GROUP BY 1")
def deployer_history_asof(spark, sf):
    c, t = _deployers(spark, sf, "1996-01-01")
    return c.join(t, "token").groupBy("deployer").agg(F.count("*").alias("tokens"), F.sum("alive").alias("survived"), F.count_if((F.col("alive") == 0) & (F.col("dead") == 1)).alias("died"))


@query(sql("swaps", f", f AS (SELECT pool, min(t) AS t0 FROM swaps GROUP BY pool), e AS (SELECT DISTINCT s.pool, s.buyer FROM swaps s JOIN f ON s.pool IS NOT DISTINCT FROM f.pool WHERE side = 'BUY' AND t <= t0 + {5 * DAY}), h AS (SELECT pool, buyer, sum(CASE side WHEN 'BUY' THEN amount WHEN 'SELL' THEN -amount ELSE 0 END) AS b FROM swaps GROUP BY 1, 2) SELECT e.pool, count(*) AS early, count(*) FILTER (h.b > 0) AS still, floor(count(*) FILTER (h.b > 0) * 10000 / count(*) + 0.5)::BIGINT AS retention_bps FROM e JOIN h ON e.pool = h.pool AND e.buyer = h.buyer GROUP BY e.pool"))
def early_buyer_retention(spark, sf):
    s = swaps(spark, sf).where("pool IS NOT NULL")
    f = s.groupBy("pool").agg(F.min("t").alias("t0"))
    per = s.join(f, "pool").groupBy("pool", "buyer").agg(F.max(((F.col("side") == "BUY") & (F.col("t") <= F.col("t0") + 5 * DAY)).cast("int")).alias("early"), F.sum(F.when(F.col("side") == "BUY", F.col("amount")).when(F.col("side") == "SELL", -F.col("amount")).otherwise(0)).alias("b"))
    return per.where("early = 1").groupBy("pool").agg(F.count("*").alias("early"), F.count_if(F.col("b") > 0).alias("still"), half_up(F.count_if(F.col("b") > 0) * 10000 / F.count("*")).alias("retention_bps"))


def candidates(spark, sf):
    """One wide row per pool: its latest snapshot, activity of its last day, and
    fields derived from its number; every side is grouped by pool first."""
    s = _last(spark, sf)
    a = swaps(spark, sf)
    top = a.agg(F.max("t").alias("top"))
    w = a.join(F.broadcast(top), F.col("t") >= F.col("top") - 5 * DAY).groupBy("pool").agg(F.count_distinct(F.when(F.col("side") == "BUY", F.col("buyer"))).alias("buyers_1h"), F.count_if(F.col("side") == "BUY").alias("buys_20m"), F.count_if(F.col("side") == "SELL").alias("sells_20m"), F.sum(F.when(F.col("side") == "BUY", F.col("amount")).otherwise(0)).alias("buy_volume"), F.sum(F.when(F.col("side") == "SELL", F.col("amount")).otherwise(0)).alias("sell_volume"))
    z = lambda c: F.coalesce(F.col(c), F.lit(0)).alias(c)
    j = s.join(w, "pool", "left").select("pool", (F.col("fdv") / 4).alias("fdv"), (F.col("liq") / 4).alias("quote_liq"), (F.col("liq") / 2).alias("total_liq"), z("buyers_1h"), z("buys_20m"), z("sells_20m"), z("buy_volume"), z("sell_volume"))
    return derived(j)


def derived(j):
    p = F.col("pool")
    return j.select("*", F.floor(F.col("buyers_1h") / 2).cast("bigint").alias("buyers_20m"), (p * 7 % 900).alias("sell_loss_bps"), F.when(p % 5 != 0, p * 31 % 1000).alias("deployer_bps"), F.when(p % 7 != 0, p * 97 % 6000).alias("top10_bps"), F.when(p % 3 == 0, "PASS").when(p % 11 == 0, "FAIL").otherwise("UNKNOWN").alias("simulation"), (p % 17 == 0).alias("critical"), (p % 19 == 0).alias("collapsed"), (p % 23 == 0).alias("regressed"), p.alias("age_minutes"), F.array(p % 400, F.when(p % 4 != 0, p % 400 + p % 13 * 50)).alias("slippage"), F.when(p % 13 == 0, "FAIL").when(p % 2 == 0, "PASS").alias("risk"))


CANDIDATES = f""", {_LAST}, w AS (SELECT pool, count(DISTINCT CASE WHEN side = 'BUY' THEN buyer END) AS buyers_1h, count(*) FILTER (side = 'BUY') AS buys_20m, count(*) FILTER (side = 'SELL') AS sells_20m, coalesce(sum(amount) FILTER (side = 'BUY'), 0)::BIGINT AS buy_volume, coalesce(sum(amount) FILTER (side = 'SELL'), 0)::BIGINT AS sell_volume FROM swaps WHERE t >= (SELECT max(t) FROM swaps) - {5 * DAY} GROUP BY pool),
c AS (SELECT s.pool, s.fdv / 4 AS fdv, CASE WHEN s.liq >= 0 THEN s.liq / 4 END AS quote_liq, CASE WHEN s.liq >= 0 THEN s.liq / 2 END AS total_liq, coalesce(buyers_1h, 0) AS buyers_1h, coalesce(buys_20m, 0) AS buys_20m, coalesce(sells_20m, 0) AS sells_20m, coalesce(buy_volume, 0) AS buy_volume, coalesce(sell_volume, 0) AS sell_volume,
 floor(coalesce(buyers_1h, 0) / 2)::BIGINT AS buyers_20m, s.pool * 7 % 900 AS sell_loss_bps, CASE WHEN s.pool % 5 <> 0 THEN s.pool * 31 % 1000 END AS deployer_bps, CASE WHEN s.pool % 7 <> 0 THEN s.pool * 97 % 6000 END AS top10_bps, CASE WHEN s.pool % 3 = 0 THEN 'PASS' WHEN s.pool % 11 = 0 THEN 'FAIL' ELSE 'UNKNOWN' END AS simulation, s.pool % 17 = 0 AS critical, s.pool % 19 = 0 AS collapsed, s.pool % 23 = 0 AS regressed, s.pool AS age_minutes, s.pool % 400 AS slip1, CASE WHEN s.pool % 4 <> 0 THEN s.pool % 400 + s.pool % 13 * 50 END AS slip2, CASE WHEN s.pool % 13 = 0 THEN 'FAIL' WHEN s.pool % 2 = 0 THEN 'PASS' END AS risk
 FROM last s LEFT JOIN w ON w.pool = s.pool)"""


@query(sql("snapshots swaps", CANDIDATES + " SELECT pool, fdv, quote_liq, total_liq, buyers_1h, buys_20m, sells_20m, buy_volume, sell_volume, buyers_20m, sell_loss_bps, deployer_bps, top10_bps, simulation, critical FROM c"))
def candidate_features(spark, sf):
    return candidates(spark, sf).drop("collapsed", "regressed", "age_minutes", "slippage", "risk")
