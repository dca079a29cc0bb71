"""Rules, calibration reports, tools and scalars."""

from __future__ import annotations

from pyspark.sql import Window, functions as F

from ..functions import rules, scalars, texts, wide
from ..functions.scalars import normal_name
from ..operators import asof, ranks, stats
from ..operators.series import DAY, half_up
from ..operators.stats import r6, wilson
from ..sources.tables import alerts, labels, read, snapshots, sql, swaps
from .analytics import CANDIDATES, FLOORS, candidates
from .catalogue import query

_FAILED = "list_filter([CASE WHEN NOT coalesce(fdv BETWEEN 10000 AND 100000, false) THEN 'fdvBand' END, CASE WHEN NOT coalesce(total_liq >= 5000, false) THEN 'minTotalLiquidity' END, CASE WHEN NOT coalesce(quote_liq >= 2500, false) THEN 'minQuoteLiquidity' END, CASE WHEN collapsed THEN 'liquidityNotCollapsed' END, CASE WHEN coalesce(sell_loss_bps > 800, false) THEN 'maxEffectiveSellLoss' END, CASE WHEN simulation = 'FAIL' THEN 'sellSimulationPass' END, CASE WHEN critical THEN 'noCriticalPermission' END], lambda x: x IS NOT NULL)"
_SOFT = "list_filter([CASE WHEN buyers_1h < 15 THEN 'minUniqueBuyers' END, CASE WHEN coalesce(deployer_bps > 800, true) THEN 'maxDeployerPct' END, CASE WHEN coalesce(top10_bps > 4500, true) THEN 'maxAdjustedTop10Pct' END], lambda x: x IS NOT NULL)"
_DEPTH = "greatest(0, least(35, CASE WHEN quote_liq >= 30000 THEN 20 WHEN quote_liq >= 20000 THEN 16 WHEN quote_liq >= 10000 THEN 10 WHEN quote_liq >= 5000 THEN 6 WHEN quote_liq >= 2500 THEN 2 ELSE 0 END + CASE WHEN floor(quote_liq / fdv * 10000) >= 2000 THEN 8 WHEN floor(quote_liq / fdv * 10000) >= 1500 THEN 6 WHEN floor(quote_liq / fdv * 10000) >= 1000 THEN 4 WHEN floor(quote_liq / fdv * 10000) >= 500 THEN 2 ELSE 0 END + CASE WHEN greatest(slip1, slip2) <= 300 THEN 7 ELSE 0 END + CASE WHEN slip2 IS NOT NULL AND slip2 - slip1 >= 500 THEN -5 ELSE 0 END))"
_BREADTH = "(CASE WHEN buyers_1h >= 30 THEN 15 WHEN buyers_1h >= 15 THEN 13 WHEN buyers_1h >= 5 THEN 8 WHEN buyers_1h >= 1 THEN 3 ELSE 0 END + CASE WHEN buyers_20m >= 15 THEN 10 WHEN buyers_20m >= 5 THEN 6 WHEN buyers_20m >= 1 THEN 3 ELSE 0 END)"
_FLOW = "(CASE WHEN buys_20m >= 5 AND buyers_20m >= 5 THEN least(20, CASE WHEN buys_20m / (sells_20m + 1) >= 3 THEN 15 WHEN buys_20m / (sells_20m + 1) >= 1.5 THEN 10 WHEN buys_20m / (sells_20m + 1) >= 1 THEN 6 ELSE 0 END + CASE WHEN buy_volume > sell_volume THEN 5 ELSE 0 END) ELSE 0 END)"
_TILT = "(CASE WHEN fdv BETWEEN 15000 AND 40000 THEN 20 WHEN fdv > 40000 AND fdv <= 60000 THEN 12 WHEN fdv >= 10000 AND fdv < 15000 THEN 10 WHEN fdv > 60000 AND fdv <= 100000 THEN 6 ELSE 0 END)"
_SCORED = CANDIDATES + f", s AS (SELECT *, {_DEPTH} + {_BREADTH} + {_FLOW} + {_TILT} AS score, len({_FAILED}) = 0 AS eligible FROM c)"


def _scored(spark, sf):
    return candidates(spark, sf).withColumn("eligible", F.size(rules.failed_rules()) == 0).withColumn("score", rules.opportunity())


@query(sql("snapshots swaps", CANDIDATES + f" SELECT pool, len({_FAILED}) = 0 AS eligible, array_to_string({_FAILED}, ',') AS failed, array_to_string({_SOFT}, ',') AS soft_failed FROM c"))
def eligibility_rules(spark, sf):
    return candidates(spark, sf).select("pool", (F.size(rules.failed_rules()) == 0).alias("eligible"), F.array_join(rules.failed_rules(), ",").alias("failed"), F.array_join(rules.soft_failed_rules(), ",").alias("soft_failed"))


@query(sql("snapshots swaps", CANDIDATES + f" SELECT pool, {_DEPTH}::INT AS depth, {_BREADTH}::INT AS breadth, {_FLOW}::INT AS flow, {_TILT}::INT AS tilt, ({_DEPTH} + {_BREADTH} + {_FLOW} + {_TILT})::INT AS score FROM c"))
def opportunity_score(spark, sf):
    i = lambda x, n: x.cast("int").alias(n)
    return candidates(spark, sf).select("pool", i(rules.liquidity_depth(), "depth"), i(rules.buyer_breadth(), "breadth"), i(rules.buy_flow(), "flow"), i(rules.low_cap_tilt(), "tilt"), i(rules.opportunity(), "score"))


@query(sql("snapshots swaps", _SCORED + " SELECT pool, CASE WHEN collapsed OR regressed THEN 'GRAY' WHEN eligible AND score >= 80 AND buyers_1h >= 20 AND coalesce(top10_bps < 4000, true) AND simulation = 'PASS' AND fdv BETWEEN 15000 AND 40000 THEN 'GREEN' WHEN eligible AND score >= 65 AND fdv BETWEEN 15000 AND 60000 AND total_liq >= 8000 THEN 'YELLOW' WHEN fdv BETWEEN 10000 AND 100000 AND quote_liq >= 2500 AND buyers_1h >= 5 AND NOT critical AND coalesce(risk, 'UNKNOWN') <> 'FAIL' THEN 'RED' ELSE 'GRAY' END AS level FROM s"))
def alert_level(spark, sf):
    return _scored(spark, sf).select("pool", rules.alert_level().alias("level"))


def token_names(spark, sf):
    """(token, name): three tokens share a part's name."""
    p = read(spark, sf, "part").select((F.col("p_partkey") - 1).alias("at"), normal_name(F.col("p_name")).alias("name"))
    return p.select(F.explode(F.sequence(F.col("at") * 3, F.col("at") * 3 + 2)).alias("token"), F.nullif("name", F.lit("")).alias("name"))


def delivered(spark, sf):
    """Alerts that went out, with the names of their tokens."""
    return alerts(spark, sf).where("id % 4 <> 0").join(token_names(spark, sf), "token")


#: For SQL: names, and alerts that were delivered.
NAMED = "names AS (SELECT (p_partkey - 1) * 3 + i AS token, nullif(regexp_replace(lower(p_name), '[^a-z0-9]+', '', 'g'), '') AS name FROM part, (SELECT unnest([0, 1, 2]) AS i)), sent AS (SELECT alerts.*, name FROM alerts JOIN names USING (token) WHERE id % 4 <> 0)"


@query(sql("alerts", f""", {NAMED}, x AS (SELECT a.*, name, CASE level WHEN 'GREEN' THEN 3 WHEN 'YELLOW' THEN 2 WHEN 'RED' THEN 1 ELSE 0 END AS r FROM alerts a LEFT JOIN names USING (token)), y AS (SELECT *, lag(level) OVER w AS last_level, lag(score) OVER w AS last_score, lag(t) OVER w AS last_t, lag(r) OVER w AS lr FROM x WINDOW w AS (PARTITION BY token ORDER BY t, id)),
o AS (SELECT a.id, arg_max(struct_pack(level := b.level, token := b.token), (b.t, b.id)) AS s FROM x a JOIN sent b ON a.name = b.name AND a.token <> b.token AND b.t >= a.t - {DAY} AND (b.t < a.t OR b.t = a.t AND b.id < a.id) GROUP BY a.id),
z AS (SELECT y.*, s.level AS sl, s.token AS st, CASE s.level WHEN 'GREEN' THEN 3 WHEN 'YELLOW' THEN 2 WHEN 'RED' THEN 1 ELSE 0 END AS sr FROM y LEFT JOIN o USING (id))
SELECT id, CASE WHEN level = 'GRAY' THEN 'level-gray-never-emits' WHEN score < 80 THEN 'below-min-score' WHEN sl IS NOT NULL AND r <= sr THEN 'duplicate-name:' || sl || '@' || st WHEN last_level IS NULL THEN 'first-alert' WHEN r > lr THEN 'level-increase' WHEN t - last_t < {DAY} THEN 'within-cooldown' WHEN score - last_score < 10 THEN 'no-material-improvement' WHEN r = lr THEN 'cooldown-elapsed:same-level' ELSE 'cooldown-elapsed:de-escalation' END AS reason FROM z"""))
def alert_gate(spark, sf):
    w = Window.partitionBy("token").orderBy("t", "id")
    a = alerts(spark, sf).select("*", *[F.lag(c).over(w).alias(f"last_{c}") for c in ("level", "score", "t")]).join(token_names(spark, sf), "token", "left")
    a = asof.latest_other(a, delivered(spark, sf), "name", "token", "t", "id", ["level"], within=DAY, bucket=7 * DAY)
    a = a.withColumns({"sibling_level": F.col("other.level"), "sibling_token": F.col("other.token")})
    return a.select("id", rules.alert_gate(DAY)[1].alias("reason"))


@query("SELECT p_partkey AS id, CASE WHEN p_size % 9 = 0 OR p_size % 11 = 0 THEN 'FAIL' WHEN p_size % 4 = 0 OR p_size % 5 = 0 THEN 'UNKNOWN' ELSE 'PASS' END AS status FROM part")
def risk_assessment(spark, sf):
    s = F.col("p_size")
    p = read(spark, sf, "part").select(F.col("p_partkey").alias("id"), F.when(s % 9 == 0, "PRESENT").when(s % 4 == 0, "UNKNOWN").otherwise("ABSENT").alias("permission"), F.when(s % 11 == 0, "FAIL").when(s % 5 != 0, "PASS").alias("simulation"))
    return p.select("id", rules.risk_status().alias("status"))


@query("SELECT side, count(*) AS n FROM (SELECT CASE WHEN b < 0 AND q > 0 THEN 'BUY' WHEN b > 0 AND q < 0 THEN 'SELL' ELSE 'UNKNOWN' END AS side FROM (SELECT l_quantity - 25 AS b, 50000 - l_extendedprice AS q FROM lineitem)) GROUP BY 1")
def swap_side(spark, sf):
    i = read(spark, sf, "lineitem").select((F.col("l_quantity") - 25).alias("b"), (50000 - F.col("l_extendedprice")).alias("q"))
    side = F.when((F.col("b") < 0) & (F.col("q") > 0), "BUY").when((F.col("b") > 0) & (F.col("q") < 0), "SELL").otherwise("UNKNOWN")
    return i.groupBy(side.alias("side")).agg(F.count("*").alias("n"))


@query("SELECT l_suppkey AS a, count(*) AS n, count(*) FILTER (q = 3) AS quote3, count(*) FILTER (q IS NULL) AS untrusted FROM (SELECT l_suppkey, CASE WHEN l_suppkey % 10 = 3 OR l_partkey % 10 = 3 THEN 3 WHEN l_suppkey % 10 = 7 OR l_partkey % 10 = 7 THEN 7 END AS q FROM lineitem) GROUP BY 1")
def quote_side(spark, sf):
    x, y = F.col("l_suppkey") % 10, F.col("l_partkey") % 10
    q = F.coalesce(*[F.when((x == k) | (y == k), k) for k in (3, 7)])
    return read(spark, sf, "lineitem").select(F.col("l_suppkey").alias("a"), q.alias("q")).groupBy("a").agg(F.count("*").alias("n"), F.count_if(F.col("q") == 3).alias("quote3"), F.count_if(F.col("q").isNull()).alias("untrusted"))


# ---- reports

_STATS = "count(*) AS n, min(mult) AS min, percentile_disc(0.5) WITHIN GROUP (ORDER BY mult) AS median, percentile_disc(0.75) WITHIN GROUP (ORDER BY mult) AS p75, max(mult) AS max, floor(avg((mult >= 20000)::INT) * 10000 + 0.5)::BIGINT AS share_2x, floor(avg((mult >= 50000)::INT) * 10000 + 0.5)::BIGINT AS share_5x, percentile_disc(0.5) WITHIN GROUP (ORDER BY dd) AS median_dd"


@query(sql("labels_", f"SELECT horizon, {_STATS} FROM labels_ GROUP BY 1"))
def calibration_headline(spark, sf):
    return stats.multiple_stats(labels(spark, sf), ["horizon"])


@query(sql("labels_", f", q AS (SELECT *, CASE WHEN status <> 'P' THEN least(3, floor((row_number() OVER (PARTITION BY horizon, status <> 'P' ORDER BY dd, id) - 1) * 4 / count(*) OVER (PARTITION BY horizon, status <> 'P')))::INT END AS bucket FROM labels_) SELECT horizon, bucket, {_STATS} FROM q GROUP BY 1, 2"))
def calibration_buckets(spark, sf):
    l = labels(spark, sf)
    known = ranks.quartiles(l.where("status <> 'P'"), ["horizon"], "dd", "id", "bucket")
    return stats.multiple_stats(known.unionByName(l.where("status = 'P'"), allowMissingColumns=True), ["horizon", "bucket"])


@query(sql("labels_", ", q AS (SELECT *, dd // 2500 AS bucket, id % 2 = 0 AS tune, (status = 'F')::INT AS bad FROM labels_), p AS (SELECT avg(bad) FILTER (tune) AS t, avg(bad) FILTER (NOT tune) AS c FROM q), l AS (SELECT bucket, count(*) AS n, avg(bad) FILTER (tune) - any_value(p.t) AS lt, avg(bad) FILTER (NOT tune) - any_value(p.c) AS lc FROM q, p GROUP BY bucket) SELECT bucket, n, floor(lt * 1e6 + 0.5) / 1e6 AS lift_tune, floor(lc * 1e6 + 0.5) / 1e6 AS lift_confirm, sign(floor(lt * 1e6 + 0.5)) = sign(floor(lc * 1e6 + 0.5)) AND floor(lt * 1e6 + 0.5) <> 0 AS signal FROM l"))
def died_cohort_lift(spark, sf):
    q = labels(spark, sf).select(F.expr("dd div 2500").alias("bucket"), (F.col("id") % 2 == 0).alias("tune"), (F.col("status") == "F").cast("int").alias("bad"))
    of = lambda y: F.avg(F.when(F.col("tune") == y, F.col("bad")))
    p = q.agg(of(True).alias("pt"), of(False).alias("pc"))
    g = q.groupBy("bucket").agg(F.count("*").alias("n"), of(True).alias("t"), of(False).alias("c")).join(F.broadcast(p))
    a, b = r6(F.col("t") - F.col("pt")), r6(F.col("c") - F.col("pc"))
    return g.select("bucket", "n", a.alias("lift_tune"), b.alias("lift_confirm"), ((F.signum(a) == F.signum(b)) & (a != 0)).alias("signal"))


@query(sql("alerts", f", f AS (SELECT unnest({FLOORS}) AS floor), d AS (SELECT floor, t // {DAY} AS day, count(DISTINCT token) AS k FROM f JOIN alerts ON score >= floor AND level <> 'GRAY' GROUP BY 1, 2) SELECT floor::INT AS floor, sum(k)::BIGINT AS token_days, floor(avg(k) * 1e6 + 0.5) / 1e6 AS per_day FROM d GROUP BY 1"))
def floor_volume(spark, sf):
    """A token counts on a day for every floor up to its best score then."""
    best = alerts(spark, sf).where("level <> 'GRAY'").groupBy("token", F.expr(f"t div {DAY}").alias("day")).agg(F.max("score").alias("score"))
    per = best.select("day", F.explode(F.filter(F.lit(FLOORS), lambda f: f <= F.col("score"))).alias("floor")).groupBy("floor", "day").agg(F.count("*").alias("k"))
    return per.groupBy(F.col("floor").cast("int").alias("floor")).agg(F.sum("k").alias("token_days"), r6(F.avg("k")).alias("per_day"))


@query("WITH g AS (SELECT source, count(*) AS n, count(*) FILTER (quality = 1) AS k FROM documents JOIN labels USING (doc_id) GROUP BY 1) SELECT source, n, k, floor(greatest(0, (k / n + 3.8416 / (2 * n) - 1.96 * sqrt((k / n * (1 - k / n) + 3.8416 / (4 * n)) / n)) / (1 + 3.8416 / n)) * 10000 + 0.5)::BIGINT AS low, floor(least(1, (k / n + 3.8416 / (2 * n) + 1.96 * sqrt((k / n * (1 - k / n) + 3.8416 / (4 * n)) / n)) / (1 + 3.8416 / n)) * 10000 + 0.5)::BIGINT AS high FROM g")
def wilson_rates(spark, sf):
    d = read(spark, sf, "documents").select("doc_id", "source").join(read(spark, sf, "labels"), "doc_id")
    g = d.groupBy("source").agg(F.count("*").alias("n"), F.count_if(F.col("quality") == 1).alias("k"))
    low, high = wilson(F.col("k"), F.col("n"))
    return g.select("source", "n", "k", low.alias("low"), high.alias("high"))


@query(sql("labels_", ", x AS (SELECT dd, (mult >= 50000)::INT AS hit FROM labels_) SELECT least(9, dd // 1000) AS decile, count(*) AS n, floor(avg(dd) + 0.5)::BIGINT AS stated, floor(avg(hit) * 10000 + 0.5)::BIGINT AS realized, floor(avg(pow(dd / 10000 - hit, 2)) * 1e6 + 0.5)::BIGINT AS brier_micro FROM x GROUP BY 1"))
def brier_calibration(spark, sf):
    x = labels(spark, sf).select("dd", (F.col("mult") >= 50000).cast("int").alias("hit"))
    return x.groupBy(F.expr("least(9L, dd div 1000)").alias("decile")).agg(F.count("*").alias("n"), half_up(F.avg("dd")).alias("stated"), half_up(F.avg("hit") * 10000).alias("realized"), half_up(F.avg(F.pow(F.col("dd") / 10000 - F.col("hit"), 2)) * 1e6).alias("brier_micro"))


@query(sql("labels_", "SELECT CASE WHEN horizon <> '1-URGENT' THEN 'wrongHorizon' WHEN mult NOT BETWEEN 5000 AND 50000 THEN 'wrongBand' WHEN status = 'P' THEN 'unparseable' ELSE 'kept' END AS reason, count(*) AS n FROM labels_ GROUP BY 1"))
def skip_reasons(spark, sf):
    r = F.when(F.col("horizon") != "1-URGENT", "wrongHorizon").when(~F.col("mult").between(5000, 50000), "wrongBand").when(F.col("status") == "P", "unparseable").otherwise("kept")
    return labels(spark, sf).groupBy(r.alias("reason")).agg(F.count("*").alias("n"))


# ---- tools


@query("WITH p AS (SELECT vec_id AS probe, embedding AS v FROM embeddings WHERE vec_id % 50 = 0), d AS (SELECT probe, vec_id AS id, floor(sqrt(list_sum(list_transform(list_zip(embedding, v), lambda x: (x[1]::DOUBLE - x[2]::DOUBLE) ** 2))) * 1e4 + 0.5) / 1e4 AS distance FROM embeddings, p WHERE vec_id <> probe), r AS (SELECT *, (row_number() OVER (PARTITION BY probe ORDER BY distance, id))::INT AS rank FROM d) SELECT probe, id, rank FROM r WHERE rank <= 5")
def comparable_knn(spark, sf):
    e = read(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"))
    n = stats.knn(e, e.where("id % 50 = 0"), 5, scale=1e4)
    return n.select("probe", "id", "rank")


@query(sql("labels_", "SELECT horizon, count(*) AS n, floor(avg((status = 'F')::INT) * 1e6 + 0.5) / 1e6 AS died, floor(avg((mult >= 20000)::INT) * 1e6 + 0.5) / 1e6 AS runner, percentile_disc(0.5) WITHIN GROUP (ORDER BY mult) AS median, count(*) < 5 AS low_sample FROM labels_ WHERE dd < 5000 AND mult > 10000 GROUP BY 1"))
def base_rate_pattern(spark, sf):
    x = labels(spark, sf).where("dd < 5000 AND mult > 10000")
    g = x.groupBy("horizon").agg(F.count("*").alias("n"), r6(F.avg((F.col("status") == "F").cast("int"))).alias("died"), r6(F.avg((F.col("mult") >= 20000).cast("int"))).alias("runner"), (F.count("*") < 5).alias("low_sample"))
    return ranks.beside(g, ranks.nearest_ranks(x, ["horizon"], "mult", {"median": 0.5}), ["horizon"])


@query(sql("snapshots", ", x AS (SELECT *, row_number() OVER (PARTITION BY pool ORDER BY t, id) - 1 AS i, count(*) OVER (PARTITION BY pool) AS n FROM snapshots) SELECT pool, id, i::BIGINT AS i FROM x WHERE n <= 12 OR list_contains(list_transform(range(12), lambda j: floor(j * (n - 1) / 11 + 0.5)::BIGINT), i)"))
def market_downsample(spark, sf):
    return stats.downsample(snapshots(spark, sf), "pool", ["t", "id"], 12).select("pool", "id", F.col("i").cast("bigint").alias("i"))


@query("SELECT p_partkey AS id, list_extract([500, 2000, 5000], list_position(l, list_min(l)))::INT AS size FROM (SELECT p_partkey, [abs(500 - p_retailprice), abs(2000 - p_retailprice), abs(5000 - p_retailprice)] AS l FROM part)")
def slippage_nearest(spark, sf):
    near = F.array_min(F.transform(F.array(*[F.lit(x) for x in (500, 2000, 5000)]), lambda x: F.struct(F.abs(x - F.col("p_retailprice")).alias("d"), x.alias("size"))))
    return read(spark, sf, "part").select(F.col("p_partkey").alias("id"), near["size"].alias("size"))


@query("""WITH q AS (SELECT event_id AS brief, 'orders' AS tab, user_id * 3 AS row_id, floor(value)::BIGINT AS claimed FROM events UNION ALL SELECT event_id, 'ghost', user_id, 0 FROM events WHERE event_id % 10 = 0),
r AS (SELECT o_orderkey AS row_id, o_totalprice AS actual FROM orders)
SELECT code, count(*) AS n, count(DISTINCT brief) AS briefs FROM (SELECT brief, CASE WHEN tab <> 'orders' THEN 'UNKNOWN_TABLE' WHEN r.row_id IS NULL THEN 'ROW_NOT_FOUND' WHEN abs(claimed * 1000 - actual) / abs(actual) * 10000 <= 100 THEN 'OK' ELSE 'VALUE_MISMATCH' END AS code FROM q LEFT JOIN r ON q.tab = 'orders' AND r.row_id = q.row_id) GROUP BY 1""")
def citation_check(spark, sf):
    e = read(spark, sf, "events")
    q = e.select(F.col("event_id").alias("brief"), F.lit("orders").alias("tab"), (F.col("user_id") * 3).alias("row_id"), F.floor("value").cast("bigint").alias("claimed")).unionByName(e.where("event_id % 10 = 0").select(F.col("event_id").alias("brief"), F.lit("ghost").alias("tab"), F.col("user_id").alias("row_id"), F.lit(0).cast("bigint").alias("claimed")))
    r = read(spark, sf, "orders").select(F.lit("orders").alias("tab"), F.col("o_orderkey").alias("row_id"), F.col("o_totalprice").alias("actual"))
    j = q.join(r, ["tab", "row_id"], "left")
    near = texts.within_tolerance(F.col("claimed") * 1000, F.col("actual"), 100)
    code = F.when(F.col("tab") != "orders", "UNKNOWN_TABLE").when(F.col("actual").isNull(), "ROW_NOT_FOUND").when(near, "OK").otherwise("VALUE_MISMATCH")
    return j.groupBy(code.alias("code")).agg(F.count("*").alias("n"), F.count_distinct("brief").alias("briefs"))


# ---- scalars


@query("SELECT c_custkey AS id, regexp_replace(lower(c_name), '[^a-z0-9]+', '', 'g') AS name FROM customer")
def name_normalize(spark, sf):
    return read(spark, sf, "customer").select(F.col("c_custkey").alias("id"), scalars.normal_name(F.col("c_name")).alias("name"))


@query("SELECT page_id, md5(replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;')) AS digest FROM pages")
def html_escape(spark, sf):
    return read(spark, sf, "pages").select("page_id", F.md5(scalars.escape_html(F.col("html")).cast("binary")).alias("digest"))


@query(r"SELECT doc_id, substr(regexp_replace(text, '[\x00-\x1F\x7F-\x{9F}`]', '', 'g'), 1, 128) AS fenced FROM documents")
def untrusted_fence(spark, sf):
    return read(spark, sf, "documents").select("doc_id", scalars.untrusted(F.col("text")).alias("fenced"))


@query("SELECT event_id, CASE WHEN regexp_full_match(props->>'$.k', '-?[0-9.]+') THEN TRY_CAST(props->>'$.k' AS DOUBLE) END AS k FROM events")
def json_feature_read(spark, sf):
    return read(spark, sf, "events").select("event_id", scalars.json_number(F.col("props"), "$.k").alias("k"))


@query("SELECT strftime(date_trunc('week', o_orderdate), '%Y-%m-%d') AS week, count(*) AS n FROM orders GROUP BY 1")
def iso_week_bucket(spark, sf):
    return read(spark, sf, "orders").groupBy(F.date_format(F.date_trunc("week", "o_orderdate"), "yyyy-MM-dd").alias("week")).agg(F.count("*").alias("n"))


@query("SELECT p_partkey AS id, CASE WHEN p_size > 0 THEN greatest(0, floor((p_size - p_partkey % 60) * 10000 / p_size))::BIGINT END AS bps FROM part")
def shortfall_bps(spark, sf):
    return read(spark, sf, "part").select(F.col("p_partkey").alias("id"), scalars.shortfall_bps(F.col("p_size"), F.col("p_partkey") % 60).alias("bps"))


@query(sql("alerts", "SELECT level, (CASE level WHEN 'GREEN' THEN 3 WHEN 'YELLOW' THEN 2 WHEN 'RED' THEN 1 ELSE 0 END)::INT AS rank, count(*) AS n FROM alerts GROUP BY 1, 2"))
def level_rank(spark, sf):
    return alerts(spark, sf).groupBy("level", scalars.level_rank(F.col("level")).alias("rank")).agg(F.count("*").alias("n"))


# ---- rows only: exact wide integers


@query()
def wide_price_math(spark, sf):
    """Prices and sums of integers beyond 38 digits, from the orders."""
    o = read(spark, sf, "orders").select("o_custkey", F.concat(F.col("o_orderkey").cast("string"), F.lit("0" * 40)).alias("raw"), F.floor("o_totalprice").cast("bigint").alias("p"))
    priced = o.select((F.col("o_custkey") % 97).alias("pool"), F.coalesce(wide.mul_div(F.col("raw"), F.col("p"), F.lit(10**18)), F.lit("0")).alias("value"))
    return wide.limb_sums(priced, ["pool"], "value")
