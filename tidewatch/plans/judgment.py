"""Briefs against outcomes, evidence as of a time, and the scoring pass."""

from __future__ import annotations

from pyspark.sql import Window, functions as F

from ..functions import judgment, rules, texts
from ..operators import asof, lookup, ranks
from ..operators.series import DAY, half_up
from ..operators.stats import wilson
from ..sources.tables import alerts, labels, micros, read, scores, snapshots, spread, sql
from .analytics import CANDIDATES, candidates
from .catalogue import query
from .reports import _BREADTH, _DEPTH, _FAILED, _FLOW, _SCORED, _TILT, NAMED, delivered, token_names

# ---- briefs: events as judged calls, labels of their pools as what came of them

_BRIEFS = """briefs AS (SELECT event_id AS id, user_id % 500 AS pool, 'v' || (1 + event_id % 2) AS version, epoch_us(ts) AS t,
  CASE WHEN event_id % 10 < 7 THEN 'COMPLETED' WHEN event_id % 10 < 9 THEN 'REJECTED_FABRICATED_CITATION' ELSE 'FAILED' END AS status,
  CASE event_id % 7 WHEN 0 THEN NULL WHEN 1 THEN 'RESEARCH' WHEN 2 THEN 'RESEARCH' WHEN 3 THEN 'WATCH' ELSE 'PASS' END AS recommendation,
  CASE WHEN event_id % 13 <> 0 THEN floor(value * 37)::BIGINT % 10001 END AS confidence,
  CASE WHEN event_id % 11 <> 0 THEN floor(value * 100)::BIGINT END AS latency, event_id % 9 AS calls,
  list_filter([CASE WHEN event_id % 2 = 0 THEN 'RUG_LP_PULL' END, CASE WHEN event_id % 3 = 0 THEN 'SELL_RESTRICTION' END, CASE WHEN event_id % 5 = 0 THEN 'CONCENTRATION_DUMP' END, CASE WHEN event_id % 4 = 1 THEN 'NO_FOLLOW_THROUGH' END, CASE WHEN event_id % 17 = 0 THEN 'OTHER' END], lambda x: x IS NOT NULL) AS tags
  FROM events),
perf AS (SELECT pool, horizon, arg_max(mult, id) AS mult, arg_max(dd, id) AS dd, arg_max(status, id) AS outcome, arg_max(CASE WHEN id % 6 <> 0 THEN mult ELSE -1 END, id) AS peak FROM (SELECT *, token % 500 AS pool FROM labels_) GROUP BY 1, 2),
judged AS (SELECT b.*, p.horizon, p.mult, p.dd,
  CASE WHEN p.outcome = 'F' OR (p.peak > 0 AND p.peak * (10000 - p.dd) / 10000 < p.peak * 0.2) THEN 'RUGGED' WHEN p.mult >= 20000 THEN 'RUNNER' WHEN p.mult < 11000 THEN 'BLED' ELSE 'HELD_BAND' END AS label,
  b.status = 'COMPLETED' AND recommendation IS NOT NULL AND confidence IS NOT NULL AS scored,
  CASE recommendation WHEN 'RESEARCH' THEN confidence WHEN 'WATCH' THEN 5000 ELSE 10000 - confidence END AS implied
  FROM briefs b JOIN perf p USING (pool) WHERE b.status <> 'FAILED')"""


def briefs(spark, sf):
    """(id, pool, version, t, status, recommendation, confidence, latency, calls, tags)"""
    i = F.col("event_id")
    tag = lambda cond, name: F.when(cond, F.lit(name))
    tags = F.array_compact(F.array(tag(i % 2 == 0, "RUG_LP_PULL"), tag(i % 3 == 0, "SELL_RESTRICTION"), tag(i % 5 == 0, "CONCENTRATION_DUMP"), tag(i % 4 == 1, "NO_FOLLOW_THROUGH"), tag(i % 17 == 0, "OTHER")))
    status = F.when(i % 10 < 7, "COMPLETED").when(i % 10 < 9, "REJECTED_FABRICATED_CITATION").otherwise("FAILED")
    call = F.when(i % 7 == 0, None).when(i % 7 < 3, "RESEARCH").when(i % 7 == 3, "WATCH").otherwise("PASS")
    return read(spark, sf, "events").select(i.alias("id"), (F.col("user_id") % 500).alias("pool"), F.concat(F.lit("v"), (1 + i % 2).cast("string")).alias("version"), micros("ts").alias("t"), status.alias("status"), call.alias("recommendation"), F.when(i % 13 != 0, F.floor(F.col("value") * 37).cast("bigint") % 10001).alias("confidence"), F.when(i % 11 != 0, F.floor(F.col("value") * 100).cast("bigint")).alias("latency"), (i % 9).alias("calls"), tags.alias("tags"))


def performances(spark, sf):
    """(pool, horizon, mult, dd, status, peak, at_horizon): the last of each."""
    l = labels(spark, sf).withColumn("pool", F.col("token") % 500).withColumn("peak", F.when(F.col("id") % 6 != 0, F.col("mult")))
    p = asof.latest(l, ["pool", "horizon"], ["id"], ["mult", "dd", "status", "peak"])
    return p.withColumn("at_horizon", F.col("peak") * (10_000 - F.col("dd")) / 10_000)


def judged(spark, sf):
    """Every brief that didn't fail at every horizon that its pool has a label
    for, with the label and whether it counts for scores: a rejected brief counts
    for the rate of fabrication alone."""
    j = briefs(spark, sf).where("status <> 'FAILED'").join(performances(spark, sf).withColumnRenamed("status", "outcome"), "pool")
    j = j.withColumn("collapsed", judgment.liquidity_collapsed(F.col("peak"), F.col("at_horizon")))
    label = rules.realized_taxonomy(F.col("outcome"))
    scored = (F.col("status") == "COMPLETED") & F.col("recommendation").isNotNull() & F.col("confidence").isNotNull()
    return j.select("id", "pool", "version", "horizon", "status", "recommendation", "latency", "calls", "tags", "mult", "dd", label.alias("label"), scored.alias("scored"), judgment.implied_bps(F.col("recommendation"), F.col("confidence")).alias("implied"))


@query(sql("labels_", f""", {_BRIEFS}
SELECT version, horizon, count(*) AS n, count(*) FILTER (scored) AS scored, count(*) FILTER (recommendation = 'RESEARCH') AS research, count(*) FILTER (recommendation = 'WATCH') AS watch, count(*) FILTER (recommendation = 'PASS') AS pass, floor(count(*) FILTER (status = 'REJECTED_FABRICATED_CITATION') / count(*) * 10000 + 0.5)::BIGINT AS fabrication_bps,
  floor(avg(floor((implied / 10000 - (label = 'RUNNER')::INT) ** 2 * 1e6 + 0.5)) FILTER (scored) + 0.5)::BIGINT AS brier_micro, percentile_cont(0.5) WITHIN GROUP (ORDER BY latency) AS median_latency, percentile_cont(0.5) WITHIN GROUP (ORDER BY calls) AS median_calls
FROM judged GROUP BY 1, 2"""))
def judge_report(spark, sf):
    """Slices by version and horizon: calls by kind, fabrication, mean Brier."""
    j = judged(spark, sf)
    brier = half_up(F.pow(F.col("implied") / 10_000 - (F.col("label") == "RUNNER").cast("int"), 2) * 1e6)
    kind = lambda x: F.count_if(F.col("recommendation") == x).alias(x.lower())
    rejected = F.count_if(F.col("status") == "REJECTED_FABRICATED_CITATION")
    by = ["version", "horizon"]
    g = j.groupBy(*by).agg(F.count("*").alias("n"), F.count_if("scored").alias("scored"), kind("RESEARCH"), kind("WATCH"), kind("PASS"), judgment.rate_bps(rejected, F.count("*")).alias("fabrication_bps"), half_up(F.avg(F.when(F.col("scored"), brier))).alias("brier_micro"))
    for c in ("latency", "calls"):
        g = ranks.beside(g, ranks.medians(j, by, c, f"median_{c}"), by)
    return g


@query(sql("labels_", f""", {_BRIEFS}, s AS (SELECT * FROM judged WHERE scored),
x AS (SELECT version, horizon, tag, list_contains(tags, tag) AS called, CASE tag WHEN 'RUG_LP_PULL' THEN label = 'RUGGED' WHEN 'CONCENTRATION_DUMP' THEN label = 'RUGGED' OR dd > 5000 WHEN 'NO_FOLLOW_THROUGH' THEN label IN ('BLED', 'HELD_BAND') END AS true_ FROM s, (SELECT unnest(['RUG_LP_PULL', 'SELL_RESTRICTION', 'CONCENTRATION_DUMP', 'WASH_COORDINATION', 'NO_FOLLOW_THROUGH', 'OTHER']) AS tag))
SELECT version, horizon, tag, tag IN ('RUG_LP_PULL', 'CONCENTRATION_DUMP', 'NO_FOLLOW_THROUGH') AS measured, count(*) FILTER (called) AS predicted, count(*) FILTER (true_) AS realized,
  CASE WHEN measured AND predicted > 0 THEN floor(count(*) FILTER (called AND true_) / predicted * 10000 + 0.5)::BIGINT END AS precision_bps, CASE WHEN measured AND realized > 0 THEN floor(count(*) FILTER (called AND true_) / realized * 10000 + 0.5)::BIGINT END AS recall_bps
FROM x GROUP BY 1, 2, 3"""))
def judge_tags(spark, sf):
    """Precision and recall of each risk tag in each slice; a tag that isn't
    measured has its calls counted alone. All tags are counted in one pass."""
    s = judged(spark, sf).where("scored")
    called = lambda t: F.array_contains("tags", t)
    true_ = lambda t: F.coalesce(judgment.came_true(F.lit(t), F.col("label"), F.col("dd")), F.lit(False))
    g = s.groupBy("version", "horizon").agg(*[F.struct(F.count_if(called(t)).alias("predicted"), F.count_if(true_(t)).alias("realized"), F.count_if(called(t) & true_(t)).alias("hits")).alias(t) for t in judgment.TAGS])
    rows = F.explode(F.array(*[F.struct(F.lit(t).alias("tag"), F.lit(t in judgment.MEASURED).alias("measured"), F.col(t).alias("c")) for t in judgment.TAGS]))
    r = g.select("version", "horizon", rows.alias("r")).select("version", "horizon", "r.tag", "r.measured", "r.c.predicted", "r.c.realized", "r.c.hits")
    share = lambda n: F.when(F.col("measured") & (F.col(n) > 0), judgment.rate_bps(F.col("hits"), F.col(n)))
    return r.select("version", "horizon", "tag", "measured", "predicted", "realized", share("predicted").alias("precision_bps"), share("realized").alias("recall_bps"))


@query(sql("labels_", f""", {_BRIEFS}, x AS (SELECT version, horizon, least(9, implied // 1000) AS bucket, implied, (label = 'RUNNER')::INT AS hit FROM judged WHERE scored), g AS (SELECT version, horizon, bucket, count(*) AS n, floor(avg(implied) + 0.5)::BIGINT AS stated_bps, sum(hit)::BIGINT AS k FROM x GROUP BY 1, 2, 3)
SELECT version, horizon, bucket, n, stated_bps, floor(k / n * 10000 + 0.5)::BIGINT AS realized_bps, floor(greatest(0, (k / n + 3.8416 / (2 * n) - 1.96 * sqrt((k / n * (1 - k / n) + 3.8416 / (4 * n)) / n)) / (1 + 3.8416 / n)) * 10000 + 0.5)::BIGINT AS low_bps FROM g"""))
def judge_calibration(spark, sf):
    x = judged(spark, sf).where("scored").withColumn("bucket", F.expr("least(9L, implied div 1000)"))
    g = x.groupBy("version", "horizon", "bucket").agg(F.count("*").alias("n"), half_up(F.avg("implied")).alias("stated_bps"), F.count_if(F.col("label") == "RUNNER").alias("k"))
    return g.select("version", "horizon", "bucket", "n", "stated_bps", judgment.rate_bps(F.col("k"), F.col("n")).alias("realized_bps"), wilson(F.col("k"), F.col("n"))[0].alias("low_bps"))


# ---- as of a time


_EVENT = "SELECT event_id AS id, user_id AS token, epoch_us(ts) AS t, value FROM events WHERE event_type = '{}'"


def _events(spark, sf, kind):
    return read(spark, sf, "events").where(F.col("event_type") == kind).select(F.col("event_id").alias("id"), F.col("user_id").alias("token"), micros("ts").alias("t"), "value")


@query(f"""WITH l AS ({_EVENT.format('error')}), e AS ({_EVENT.format('view')}), s AS ({_EVENT.format('purchase')}),
m AS (SELECT l.id, l.token, e.id AS eid, e.t AS et, e.value >= 50 AS eligible, row_number() OVER (PARTITION BY l.id ORDER BY e.t DESC, e.id DESC) AS rn FROM l JOIN e ON e.token = l.token AND e.t <= l.t AND e.t >= l.t - {5 * DAY}),
n AS (SELECT m.id, m.eid, m.eligible, s.id AS sid, floor(s.value)::BIGINT AS score, row_number() OVER (PARTITION BY m.id ORDER BY abs(s.t - m.et), s.id DESC) AS rs FROM m JOIN s ON s.token = m.token WHERE m.rn = 1)
SELECT id, eid AS evaluation, eligible, sid AS score_id, score FROM n WHERE rs = 1""")
def shadow_decision(spark, sf, window=5 * DAY):
    """What was decided about a token as of a time: the last evaluation within
    the window before it, and the score nearest to that evaluation; a token that
    lacks either has no decision."""
    at = _events(spark, sf, "error").select("id", "token", "t")
    e = _events(spark, sf, "view").withColumn("eligible", F.col("value") >= 50)
    s = _events(spark, sf, "purchase").withColumn("score", F.floor("value").cast("bigint"))
    m = asof.as_of(at, e, "token", "t", "id", ["eligible"], tolerance=window).where("match IS NOT NULL")
    m = m.select("id", "token", F.col("match.t").alias("t"), F.col("match.id").alias("evaluation"), "match.eligible")
    n = asof.nearest(m, s, "token", "t", "id", ["score"]).where("match IS NOT NULL")
    return n.select("id", "evaluation", "eligible", F.col("match.id").alias("score_id"), "match.score")


@query(f"""WITH b AS ({_EVENT.format('purchase')}), v AS (SELECT user_id AS token, event_id AS id, epoch_us(ts) AS t, event_type FROM events),
j AS (SELECT b.id, b.t AS bt, v.event_type, v.id AS vid, v.t AS vt, row_number() OVER (PARTITION BY b.id, v.event_type ORDER BY v.t DESC, v.id DESC) AS rn, count(*) OVER (PARTITION BY b.id, v.event_type) AS n FROM b LEFT JOIN v ON v.token = b.token AND v.t <= b.t AND v.event_type <> 'purchase')
SELECT id, max(CASE WHEN event_type = 'view' AND rn = 1 THEN vid END) AS activity_id, max(CASE WHEN event_type = 'click' AND rn = 1 THEN vid END) AS holders_id, max(CASE WHEN event_type = 'signup' AND rn = 1 AND bt - vt <= {5 * DAY} THEN vid END) AS risk_id, coalesce(max(CASE WHEN event_type = 'error' THEN n END), 0)::BIGINT AS market_rows, max(CASE WHEN event_type = 'error' AND rn = 1 THEN vid END) AS market_last_id FROM j GROUP BY id""")
def evidence_bundle(spark, sf):
    """Each alert with the last row of every kind of evidence at or before its
    time, risk no older than five days, and how much of the market series there
    was; no evidence may be younger than the alert. One exchange for all kinds."""
    b = _events(spark, sf, "purchase").select("id", "token", "t")
    kinds = {"activity": "view", "holders": "click", "risk": "signup", "market": "error"}
    m = asof.as_of_all(b, {n: _events(spark, sf, k).select("id", "token", "t") for n, k in kinds.items()}, "token", "t", "id", tolerance={"risk": 5 * DAY})
    seen = F.greatest(*[F.coalesce(F.col(f"{n}.t"), F.col("t")) for n in kinds])
    m = asof.assert_no_lookahead(m, "t", seen)
    return m.select("id", *[F.col(f"{n}.id").alias(f"{n}_id") for n in ("activity", "holders", "risk")], F.col("market_n").alias("market_rows"), F.col("market.id").alias("market_last_id"))


# ---- passes


_LEVEL = "CASE WHEN collapsed OR regressed THEN 'GRAY' WHEN eligible AND score >= 80 AND buyers_1h >= 20 AND coalesce(top10_bps < 4000, true) AND simulation = 'PASS' AND fdv BETWEEN 15000 AND 40000 THEN 'GREEN' WHEN eligible AND score >= 65 AND fdv BETWEEN 15000 AND 60000 AND total_liq >= 8000 THEN 'YELLOW' WHEN fdv BETWEEN 10000 AND 100000 AND quote_liq >= 2500 AND buyers_1h >= 5 AND NOT critical AND coalesce(risk, 'UNKNOWN') <> 'FAIL' THEN 'RED' ELSE 'GRAY' END"
_R = "CASE {} WHEN 'GREEN' THEN 3 WHEN 'YELLOW' THEN 2 WHEN 'RED' THEN 1 ELSE 0 END"


@query(sql("snapshots swaps alerts scores", _SCORED + f""", v AS (SELECT *, {_LEVEL} AS level FROM s), k AS (SELECT max(t) AS now FROM alerts),
a AS (SELECT token, arg_max(level, (t, id)) AS last_level, arg_max(score, (t, id)) AS last_score, max(t) AS last_t FROM alerts GROUP BY token), z AS (SELECT token, max(t) AS scored_t FROM scores GROUP BY token),
{NAMED}, o AS (SELECT v.pool, arg_max(struct_pack(level := b.level, token := b.token), (b.t, b.id)) AS s FROM v JOIN names n ON n.token = v.pool JOIN sent b ON b.name = n.name AND b.token <> v.pool, k WHERE b.t >= now - {DAY} GROUP BY v.pool),
x AS (SELECT v.*, o.s.level AS sl, o.s.token AS st, {_R.format('o.s.level')} AS sr, now, a.last_level, a.last_score, a.last_t, scored_t, {_R.format('v.level')} AS r, {_R.format('last_level')} AS lr FROM v, k LEFT JOIN a ON a.token = v.pool LEFT JOIN z ON z.token = v.pool LEFT JOIN o ON o.pool = v.pool),
g AS (SELECT *, CASE WHEN level = 'GRAY' THEN 'level-gray-never-emits' WHEN score < CASE WHEN level = 'RED' THEN 50 ELSE 40 END THEN 'below-min-score' WHEN sl IS NOT NULL AND r <= sr THEN 'duplicate-name:' || sl || '@' || st WHEN last_level IS NULL THEN 'first-alert' WHEN r > lr THEN 'level-increase' WHEN now - last_t < {DAY} THEN 'within-cooldown' WHEN score - last_score < 10 THEN 'no-material-improvement' WHEN r = lr THEN 'cooldown-elapsed:same-level' ELSE 'cooldown-elapsed:de-escalation' END AS gate FROM x)
SELECT pool, score::INT AS score, level, array_to_string({_FAILED}, ',') AS failed, gate AS reason, level <> 'GRAY' OR (buyers_1h > 0 AND (scored_t IS NULL OR now - scored_t >= {2 * DAY})) AS logged, gate IN ('first-alert', 'level-increase', 'cooldown-elapsed:same-level', 'cooldown-elapsed:de-escalation') AS emitted FROM g"""))
def scoring_pass(spark, sf, shadow_interval=2 * DAY, cooldown=DAY, floor=40, floor_red=50):
    """One pass over all pools: features, eligibility, score, level, which rows
    are logged (grey ones only while they trade and not too often), and whether
    an alert goes out against the token's last one."""
    c = candidates(spark, sf).withColumn("eligible", F.size(rules.failed_rules()) == 0).withColumn("score", rules.opportunity())
    c = c.withColumn("level", rules.alert_level())
    a = asof.latest(alerts(spark, sf), ["token"], ["t", "id"], ["level", "score", "t"]).select(F.col("token").alias("pool"), *[F.col(x).alias(f"last_{x}") for x in ("level", "score", "t")])
    z = scores(spark, sf).groupBy(F.col("token").alias("pool")).agg(F.max("t").alias("scored_t"))
    now = alerts(spark, sf).agg(F.max("t").alias("t"))
    x = c.join(a, "pool", "left").join(z, "pool", "left").join(F.broadcast(now)).join(token_names(spark, sf).withColumnRenamed("token", "pool"), "pool", "left")
    # ids from 0: all that was delivered until now comes before
    x = asof.latest_other(x.withColumn("id", F.lit(1 << 62)).withColumn("token", F.col("pool")), delivered(spark, sf), "name", "token", "t", "id", ["level"], within=cooldown)
    x = x.withColumns({"sibling_level": F.col("other.level"), "sibling_token": F.col("other.token")})
    emit, reason = rules.alert_gate(cooldown, floor, floor_red)
    due = (F.col("buyers_1h") > 0) & (F.col("scored_t").isNull() | (F.col("t") - F.col("scored_t") >= shadow_interval))
    return x.select("pool", F.col("score").cast("int").alias("score"), "level", F.array_join(rules.failed_rules(), ",").alias("failed"), reason.alias("reason"), ((F.col("level") != "GRAY") | due).alias("logged"), emit.alias("emitted"))


_JSON_SQL = f"""f AS (SELECT p_partkey AS id, p_size * 900.0 AS fdv, CASE WHEN p_partkey % 6 <> 0 THEN p_size * 150.0 END AS quote_liq, CASE WHEN p_partkey % 6 <> 0 THEN p_size * 310.0 END AS total_liq, p_partkey % 50 AS age_minutes, NULL::BOOLEAN AS collapsed, CASE WHEN p_partkey % 4 <> 0 THEN p_partkey % 1100 END AS sell_loss_bps,
  CASE p_partkey % 3 WHEN 0 THEN 'PASS' WHEN 1 THEN 'FAIL' ELSE 'UNKNOWN' END AS simulation, p_partkey % 5 = 1 AS critical, CASE WHEN p_partkey % 8 <> 0 THEN p_size ELSE 0 END AS buyers_1h, p_size // 2 AS buyers_20m, p_size AS buys_20m, p_size // 3 AS sells_20m, p_size * 10 AS buy_volume, p_size * 7 AS sell_volume, NULL::BIGINT AS slip1, NULL::BIGINT AS slip2
  FROM part WHERE p_partkey % 9 < 6)"""


def replayed_parts(spark, sf):
    """(id, e and what the rules read) of parts as tokens at entry: features as
    JSON, read strictly; e is null where a row can't be replayed."""
    k, z = F.col("p_partkey"), F.col("p_size")
    null = lambda keep, x: F.when(keep, x.cast("string")).otherwise("null")
    q = lambda x: F.concat(F.lit('"'), x.cast("string"), F.lit('"'))
    word = F.when(k % 3 == 0, "PASS").when(k % 3 == 1, "FAIL")
    values = {name: F.lit("null") for name in texts.ENTRY_FEATURES}
    values |= {
        "quoteLiquidityUsd": null(k % 6 != 0, q(z * 150.0)),
        "totalLiquidityUsd": null(k % 6 != 0, q(z * 310.0)),
        "ageMinutesAtEntry": F.when(k % 9 == 7, q(k % 50)).otherwise((k % 50).cast("string")),
        "uniqueBuyers20m": F.expr("p_size div 2").cast("string"),
        "uniqueBuyers1h": null(k % 8 != 0, z),
        "buyCount20m": z.cast("string"),
        "sellCount20m": F.expr("p_size div 3").cast("string"),
        "quoteBuyVolumeRaw20m": q(z * 10),
        "quoteSellVolumeRaw20m": q(z * 7),
        "simulationStatus": F.when(k % 9 == 8, q(F.lit("MAYBE"))).when(word.isNotNull(), q(word)).otherwise("null"),
        "effectiveSellLossBps": null(k % 4 != 0, k % 1100),
        "criticalPermissionPresent": F.when(k % 5 == 1, "true").when(k % 5 == 2, "false").otherwise("null"),
    }
    members = F.array(*[F.when((F.lit(name) != "isProxy") | (k % 9 != 6), F.concat(F.lit(f'"{name}": '), v)) for name, v in values.items()])
    json = F.concat(F.lit("{"), F.array_join(F.array_compact(members), ", "), F.lit("}"))
    d = spread(read(spark, sf, "part").select("p_partkey", "p_size"), "p_partkey").select(k.alias("id"), (z * 900.0).alias("entry_fdv"), texts.entry_features(json).alias("e"))
    return rules.replayed(d, "e", F.col("entry_fdv"))


@query(f"WITH {_JSON_SQL} SELECT p.p_partkey AS id, f.id IS NOT NULL AS parsed, CASE WHEN f.id IS NOT NULL THEN array_to_string({_FAILED}, ',') END AS failed, CASE WHEN f.id IS NOT NULL THEN ({_DEPTH} + {_BREADTH} + {_FLOW} + {_TILT})::INT END AS score FROM part p LEFT JOIN f ON f.id = p.p_partkey")
def feature_replay(spark, sf):
    """Stored entry features, read strictly, and the gate replayed over them.
    Missing sources count as in the live pass; a row that lacks a key (one in
    nine), has a number as text, or a word that isn't one of the choices, isn't
    replayed."""
    c, there = replayed_parts(spark, sf), F.col("e").isNotNull()
    return c.select("id", there.alias("parsed"), F.when(there, F.array_join(rules.failed_rules(), ",")).alias("failed"), F.when(there, rules.opportunity().cast("int")).alias("score"))


# ---- lookups and scans


@query("SELECT c_custkey AS id, c_name AS name FROM customer WHERE lower(c_name) IN ('customer#000000001', 'customer#000000007', 'customer#000000100')")
def tokens_by_address(spark, sf, wanted=("Customer#000000001", "CUSTOMER#000000007", "customer#000000100", "customer#000000001")):
    c = read(spark, sf, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"))
    return lookup.by_keys(c, "name", list(wanted), "lower")


@query(sql("scores", "SELECT id, token, score FROM scores WHERE t >= 1705276800000000 AND score >= 50"))
def scores_since(spark, sf, start=1_705_276_800_000_000, least=50):
    return lookup.since(scores(spark, sf), "t", start, F.col("score") >= least).select("id", "token", "score")


@query(f"WITH {_BRIEFS.split('perf AS')[0].rstrip().rstrip(',')} SELECT id, pool, recommendation FROM briefs WHERE version = 'v2' AND status = 'COMPLETED' ORDER BY t DESC, id DESC LIMIT 150")
def recent_briefs(spark, sf, version="v2", limit=150):
    b = briefs(spark, sf).where((F.col("version") == version) & (F.col("status") == "COMPLETED"))
    return lookup.top_of_chunks(b, [F.desc("t"), F.desc("id")], limit).select("id", "pool", "recommendation")


@query(sql("labels_", "SELECT id, token, horizon, mult FROM labels_ WHERE token IN (3, 14, 15, 92, 65)"))
def labels_of_tokens(spark, sf, tokens=(3, 14, 15, 92, 65)):
    return lookup.by_keys(labels(spark, sf), "token", list(tokens)).select("id", "token", "horizon", "mult")


@query(sql("snapshots", "SELECT id, pool, t, (row_number() OVER (ORDER BY t DESC, id))::INT AS place FROM snapshots WHERE pool IN (1, 5, 8, 13, 21, 34) ORDER BY t DESC, id LIMIT 40"))
def pools_ordered(spark, sf, pools=(1, 5, 8, 13, 21, 34), limit=40):
    """The newest rows of several pools together: each chunk's first rows, merged."""
    rows = lookup.by_keys(snapshots(spark, sf), "pool", list(pools))
    top = lookup.top_of_chunks(rows, [F.desc("t"), F.col("id")], limit)
    return top.select("id", "pool", "t", F.row_number().over(Window.orderBy(F.desc("t"), "id")).alias("place"))


@query("SELECT name, version, id FROM (SELECT c_nationkey AS name, c_custkey % 7 AS version, c_custkey AS id, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey % 7 DESC, c_custkey) AS rn FROM customer) WHERE rn = 1")
def latest_prompts(spark, sf):
    c = read(spark, sf, "customer").select(F.col("c_nationkey").alias("name"), (F.col("c_custkey") % 7).alias("version"), F.col("c_custkey").alias("id"))
    return lookup.first_by(c.withColumn("back", -F.col("version")), ["name"], ["back", "id"]).select("name", "version", "id")


@query("SELECT conv_id, turn, sha256(coalesce(text, '')) AS digest FROM conversations")
def tool_result_digests(spark, sf):
    return read(spark, sf, "conversations").select("conv_id", "turn", F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("digest"))
