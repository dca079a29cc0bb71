"""Commands, renderings, claims and payloads."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import texts
from ..functions.keccak import checksum_address
from ..sources.tables import alerts, micros, read, spread, sql
from .catalogue import query

_HEX = "'0x' || lpad(lower(to_hex(c_custkey)), 40, '0')"


def _address(column):
    return F.concat(F.lit("0x"), F.lpad(F.lower(F.hex(column)), 40, "0"))


@query("SELECT c_custkey AS id, trim(c_name) AS name FROM customer")
def bytes32_names(spark, sf):
    c = read(spark, sf, "customer")
    word = F.concat(F.lit("0x"), F.rpad(F.hex(F.col("c_name").cast("binary")), 64, "0"))
    return c.select(F.col("c_custkey").alias("id"), texts.bytes32_text(word).alias("name"))


@query(f"SELECT c_custkey AS id, CASE c_custkey % 5 WHEN 0 THEN 'score' WHEN 1 THEN 'score' WHEN 2 THEN 'usage' WHEN 3 THEN 'usage' END AS kind, CASE WHEN c_custkey % 5 < 2 THEN {_HEX} END AS address FROM customer")
def score_requests(spark, sf):
    """Messages: an address, /score with one, with junk, alone; other words."""
    k = F.col("c_custkey")
    spoken = F.concat(F.lit("/score 0x"), F.upper(F.substring(_address("c_custkey"), 3, 40)))
    text = F.when(k % 5 == 0, F.concat(F.lit("  "), _address("c_custkey"))).when(k % 5 == 1, spoken).when(k % 5 == 2, "/score 0x12").when(k % 5 == 3, "/score").otherwise("score please")
    c = read(spark, sf, "customer").select(k.alias("id"), texts.score_request(text).alias("r"))
    return c.select("id", "r.kind", "r.address")


@query("SELECT o_orderkey AS id, '$' || format('{:,}', floor(o_totalprice + 0.5)::BIGINT) AS usd, CASE WHEN m < 90 THEN m::BIGINT || 'm' WHEN m / 60 < 48 THEN format('{:.1f}', floor(m / 60 * 10 + 0.5) / 10) || 'h' ELSE format('{:.1f}', floor(m / 60 / 24 * 10 + 0.5) / 10) || 'd' END AS age, CASE WHEN o_orderstatus = 'P' THEN 'unknown' ELSE format('{:.1f}', floor(m / 10 + 0.5) / 10) || '%' END AS share FROM (SELECT *, o_orderkey % 9973 AS m FROM orders)")
def formatted_amounts(spark, sf):
    m = F.col("o_orderkey") % 9973
    return read(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), texts.usd(F.col("o_totalprice")).alias("usd"), texts.age(m).alias("age"), texts.percent(F.when(F.col("o_orderstatus") != "P", m)).alias("share"))


@query(sql("alerts", "SELECT id, level || ' ' || token || chr(10) || 'Score ' || score || CASE WHEN score >= 80 THEN chr(10) || 'strong' ELSE '' END AS message, sha256(level || ' ' || token) AS digest FROM alerts WHERE level <> 'GRAY'"))
def alert_messages(spark, sf):
    a = alerts(spark, sf).where("level <> 'GRAY'")
    head = F.concat_ws(" ", "level", F.col("token").cast("string"))
    return a.select("id", F.concat_ws("\n", head, F.concat(F.lit("Score "), F.col("score").cast("string")), F.when(F.col("score") >= 80, F.lit("strong"))).alias("message"), F.sha2(head.cast("binary"), 256).alias("digest"))


@query("SELECT event_id AS id, strftime(ts, '%Y-%m-%dT%H:%M:%S.%g') || 'Z' AS at, greatest(0, floor((max(epoch_us(ts)) OVER () - epoch_us(ts)) / 60000000))::BIGINT AS age FROM events")
def event_times(spark, sf):
    e = read(spark, sf, "events").select("event_id", "ts", micros("ts").alias("t"))
    last = e.agg(F.max("t").alias("now"))
    return e.join(F.broadcast(last)).select(F.col("event_id").alias("id"), texts.iso_millis(F.col("ts")).alias("at"), texts.age_minutes(F.col("t"), F.col("now")).alias("age"))


@query("SELECT o_orderkey AS id, CASE o_orderkey % 4 WHEN 0 THEN o_totalprice WHEN 1 THEN 0.0 END AS usd, CASE o_orderkey % 5 WHEN 0 THEN true WHEN 1 THEN o_orderkey % 3 = 0 WHEN 2 THEN true ELSE o_orderkey % 2 = 0 END AS holds FROM orders")
def claims_hold(spark, sf):
    """Claims: a price half a percent off, one two percent off unless the key is
    a multiple of three, a timestamp of the same minute, words."""
    k, p = F.col("o_orderkey"), F.col("o_totalprice")
    text = F.when(k % 4 == 0, p.cast("string")).when(k % 4 == 1, F.lit(" ")).when(k % 4 == 2, F.lit("1.2.3"))
    claimed = F.when(k % 5 == 0, (p * 1.005).cast("string")).when(k % 5 == 1, F.when(k % 3 == 0, p).otherwise(p * 1.02).cast("string")).when(k % 5 == 2, F.lit("1995-01-01T00:00:59Z")).otherwise(F.when(k % 2 == 0, F.lit(" WATCH ")).otherwise(F.lit("PASS")))
    actual = F.when(k % 5 < 2, p.cast("string")).when(k % 5 == 2, F.lit("1995-01-01T00:00:00.000Z")).otherwise(F.lit("WATCH"))
    return read(spark, sf, "orders").select(k.alias("id"), texts.usd_number(text).alias("usd"), texts.claim_holds(claimed, actual).alias("holds"))


@query("SELECT o_orderkey AS id, '{\"update_id\":\"' || CASE WHEN o_orderkey % 2 = 0 THEN '1234567890' || lpad(o_orderkey::VARCHAR, 9, '0') ELSE o_orderkey::VARCHAR END || '\",\"chat\":{\"id\":\"-' || o_orderkey || '\"},\"date\":12345678901234567890,\"text\":\"a, 12345678901234567890, b\"}' AS json FROM orders")
def wide_ids_quoted(spark, sf):
    """Ids of any length are quoted; a long number under another key, or inside
    a text, stays."""
    k = F.col("o_orderkey")
    number = F.when(k % 2 == 0, F.concat(F.lit("1234567890"), F.lpad(k.cast("string"), 9, "0"))).otherwise(k.cast("string"))
    raw = F.concat(F.lit('{"update_id":'), number, F.lit(',"chat":{"id":-'), k.cast("string"), F.lit('},"date":12345678901234567890,"text":"a, 12345678901234567890, b"}'))
    return read(spark, sf, "orders").select(k.alias("id"), texts.quote_wide_integers(raw).alias("json"))


@query("SELECT o_orderkey AS id, CASE o_orderkey % 6 WHEN 0 THEN true WHEN 1 THEN true WHEN 2 THEN o_orderkey % 4 = 0 WHEN 3 THEN false WHEN 4 THEN false ELSE true END AS holds FROM orders")
def array_claims_hold(spark, sf):
    """Claims against arrays: the whole array, one element, an element half a
    percent off or (unless the key is a multiple of four) two percent off, none
    of them, an empty array, a whole array with spaces."""
    k, p = F.col("o_orderkey"), F.col("o_totalprice").cast("string")
    off = F.when(k % 4 == 0, F.col("o_totalprice") * 1.005).otherwise(F.col("o_totalprice") * 1.02)
    actual = F.when(k % 6 == 4, F.array().cast("array<string>")).otherwise(F.array(F.lit("WATCH"), p))
    claimed = F.when(k % 6 == 0, F.to_json(F.array(F.lit("WATCH"), p))).when(k % 6 == 1, F.lit("WATCH")).when(k % 6 == 2, off.cast("string")).when(k % 6 == 3, F.lit("PASS")).when(k % 6 == 4, F.lit("WATCH")).otherwise(F.concat(F.lit('[ "WATCH" , "'), p, F.lit('" ]')))
    return read(spark, sf, "orders").select(k.alias("id"), texts.any_claim_holds(claimed, actual).alias("holds"))


@query("SELECT event_id AS id, CASE event_id % 6 WHEN 0 THEN (props->>'$.k')::DOUBLE WHEN 2 THEN 1.0 END AS k, CASE WHEN event_id % 6 < 3 THEN event_type END AS side, CASE WHEN event_id % 6 < 3 THEN event_id % 2 = 0 END AS flag FROM events")
def strict_features(spark, sf):
    """An object with three keys: k a number or null, a side, a flag. A key more
    is ignored; one with words or a quoted number for k, or without the flag,
    counts as nothing."""
    i, k = F.col("event_id"), F.get_json_object("props", "$.k")
    rest = F.concat(F.lit('"side": "'), F.col("event_type"), F.lit('", "flag": '), (i % 2 == 0).cast("string"), F.lit("}"))
    of = lambda v: F.concat(F.lit('{"k": '), v if not isinstance(v, str) else F.lit(v), F.lit(", "), rest)
    json = F.when(i % 6 == 0, of(k)).when(i % 6 == 1, of("null")).when(i % 6 == 2, of('1, "z": 2')).when(i % 6 == 3, of('"one"')).when(i % 6 == 4, of('"1"')).otherwise(F.lit('{"k": 1, "side": "view"}'))
    e = read(spark, sf, "events").select(i.alias("id"), texts.strict_object(json, {"k": "number?", "side": "string", "flag": "boolean"}).alias("f"))
    return e.select("id", "f.k", "f.side", "f.flag")


@query()
def checksummed_addresses(spark, sf):
    """Rows only: the checksum needs a hash that SQL lacks."""
    return spread(read(spark, sf, "customer").select("c_custkey"), "c_custkey").select(F.col("c_custkey").alias("id"), checksum_address(_address("c_custkey")).alias("address"))
