"""Briefs: which are valid, and which citations hold."""

from __future__ import annotations

import json
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions import briefs
from ..operators import citations
from ..sources.scratch import written
from ..sources.tables import read, spread
from .catalogue import query

EVIDENCE = {"table": "token_risks", "rowId": "7", "field": "p_size", "claimedValue": "3"}
VALID = {
    "thesis": "t", "thesisEvidence": [EVIDENCE], "confidenceBps": 5000, "riskCalls": [{"risk": "r", "tag": "OTHER", "severity": "LOW", "evidence": [EVIDENCE]}] * 3,
    "disconfirming": [{"claim": "c", "evidence": []}], "whatWouldChangeThisCall": ["w"], "recommendation": "WATCH",
}


def _but(path: str, value=None) -> str:
    """The valid brief as JSON with another value at a path (a name and perhaps
    an index and a name); without the name where the value is None."""
    brief = json.loads(json.dumps(VALID))
    *way, last = [int(x) if x.isdigit() else x for x in path.split(".")]
    inside = reduce(lambda x, k: x[k], way, brief)
    if value is None:
        del inside[last]
    else:
        inside[last] = value
    return json.dumps(brief)


#: Briefs and, in the same order, what is wrong with them.
CASES = [
    (json.dumps(VALID), None), ("{", "INVALID_JSON"), ("", "INVALID_JSON"), ("[1]", "INVALID_SHAPE"), ("null", "INVALID_SHAPE"),
    (_but("thesis", ""), "THESIS_INVALID"), (_but("thesis", 5), "THESIS_INVALID"), (_but("thesis", "x" * 601), "THESIS_TOO_LONG"), (_but("thesis", "x" * 600), None),
    (_but("thesisEvidence", "[x"), "EVIDENCE_ARRAY_INVALID"), (_but("thesisEvidence"), "EVIDENCE_ARRAY_INVALID"), (_but("thesisEvidence", ["x"]), "EVIDENCE_POINTER_INVALID"),
    (_but("thesisEvidence.0.rowId", 7), "EVIDENCE_POINTER_INVALID"), (_but("thesisEvidence.0.claimedValue", ""), "EVIDENCE_POINTER_INVALID"), (_but("thesisEvidence", []), None),
    (_but("confidenceBps", "5000"), "CONFIDENCE_OUT_OF_RANGE"), (_but("confidenceBps", 10001), "CONFIDENCE_OUT_OF_RANGE"), (_but("confidenceBps", 0.5), "CONFIDENCE_OUT_OF_RANGE"), (_but("confidenceBps", 1e4), None),
    (_but("riskCalls", {}), "RISK_CALLS_INVALID"), (_but("riskCalls.2"), "RISK_CALLS_COUNT"), (_but("riskCalls.1", "x"), "RISK_CALL_INVALID"), (_but("riskCalls.1.risk", ""), "RISK_CALL_INVALID"),
    (_but("riskCalls.0.tag", "RUG"), "RISK_CALL_TAG_INVALID"), (_but("riskCalls.2.severity", "low"), "RISK_CALL_SEVERITY_INVALID"), (_but("riskCalls.2.evidence", []), "RISK_CALL_EVIDENCE_EMPTY"),
    (_but("riskCalls.2.evidence"), "EVIDENCE_ARRAY_INVALID"), (_but("riskCalls.2.evidence.0.table"), "EVIDENCE_POINTER_INVALID"),
    (_but("disconfirming"), "CITED_CLAIM_ARRAY_INVALID"), (_but("disconfirming", [VALID["disconfirming"][0]] * 9), "CITED_CLAIM_ARRAY_TOO_LONG"), (_but("disconfirming.0", 1), "CITED_CLAIM_INVALID"),
    (_but("disconfirming.0.claim", 1), "CITED_CLAIM_INVALID"), (_but("disconfirming.0.claim", "x" * 401), "CITED_CLAIM_TOO_LONG"), (_but("disconfirming", []), None),
    (_but("whatWouldChangeThisCall", "w"), "STRING_ARRAY_INVALID"), (_but("whatWouldChangeThisCall", ["w"] * 9), "STRING_ARRAY_TOO_LONG"), (_but("whatWouldChangeThisCall", ["w", ""]), "STRING_ARRAY_ITEM_INVALID"),
    (_but("whatWouldChangeThisCall", ["x" * 401]), "STRING_ARRAY_ITEM_TOO_LONG"), (_but("recommendation", "BUY"), "RECOMMENDATION_INVALID"), (_but("recommendation"), "RECOMMENDATION_INVALID"),
]
_CODES = ", ".join("NULL" if code is None else f"'{code}'" for _, code in CASES)


@query(f"SELECT code, count(*) AS n FROM (SELECT [{_CODES}][o_orderkey % {len(CASES)} + 1] AS code FROM orders) GROUP BY 1")
def brief_payload_validation(spark: SparkSession, sf: str) -> DataFrame:
    """One of the cases an order; each breaks one rule, or none."""
    text = F.get(F.array(*[F.lit(c) for c, _ in CASES]), (F.col("o_orderkey") % len(CASES)).cast("int"))
    return read(spark, sf, "orders").select(briefs.brief_error(text).alias("code")).groupBy("code").agg(F.count("*").alias("n"))


#: The tables that briefs may cite: the test table in each role, and its key.
ROLES = {
    "pool_snapshots": ("orders", "o_orderkey"), "pool_activity_snapshots": ("events", "event_id"), "token_holder_snapshots": ("customer", "c_custkey"), "token_risks": ("part", "p_partkey"),
    "trade_simulations": ("supplier", "s_suppkey"), "token_outcomes": ("nation", "n_nationkey"), "token_performance": ("region", "r_regionkey"),
}
#: Of each: a field that is cited, and how the claim is made of what it says.
CITED = {"pool_snapshots": "o_totalprice", "pool_activity_snapshots": "ts", "token_holder_snapshots": "c_mktsegment", "token_risks": "p_size", "trade_simulations": "s_acctbal", "token_outcomes": "n_name", "token_performance": "r_name"}
NAMES = [*ROLES, "judgment_tool_calls", "ghosts"]


def _pointers(spark: SparkSession, sf: str) -> DataFrame:
    """(brief, clause, table, row, field, claimed): seven pointers for every
    twentieth event: one a clause, two of the thesis."""
    e = read(spark, sf, "events").where("event_id % 20 = 0").select(F.col("event_id").alias("brief"), F.explode(F.sequence(F.lit(0), F.lit(6))).alias("i"))
    n = F.col("brief") / 20 * 7 + F.col("i")
    e = e.withColumn("n", n.cast("bigint")).withColumn("table", F.get(F.array(*map(F.lit, NAMES)), (F.col("n") % len(NAMES)).cast("int")))
    size = F.when(F.col("table").isin("token_outcomes"), 27).when(F.col("table") == "token_performance", 6).when(F.col("table") == "judgment_tool_calls", 3).otherwise(110)
    return e.withColumn("id", F.col("n") * 31 % size)


@query("""WITH e AS (SELECT event_id AS brief, unnest([0, 1, 2, 3, 4, 5, 6]) AS i FROM events WHERE event_id % 20 = 0),
p AS (SELECT brief, i, brief // 20 * 7 + i AS n FROM e),
q AS (SELECT *, ['pool_snapshots', 'pool_activity_snapshots', 'token_holder_snapshots', 'token_risks', 'trade_simulations', 'token_outcomes', 'token_performance', 'judgment_tool_calls', 'ghosts'][n % 9 + 1] AS tab FROM p),
k AS (SELECT *, n * 31 % CASE tab WHEN 'token_outcomes' THEN 27 WHEN 'token_performance' THEN 6 WHEN 'judgment_tool_calls' THEN 3 ELSE 110 END AS id FROM q),
r AS (SELECT 'pool_snapshots' AS tab, o_orderkey AS id, true AS numeric FROM orders UNION ALL SELECT 'pool_activity_snapshots', event_id, false FROM events UNION ALL SELECT 'token_holder_snapshots', c_custkey, false FROM customer
  UNION ALL SELECT 'token_risks', p_partkey, true FROM part UNION ALL SELECT 'trade_simulations', s_suppkey, true FROM supplier UNION ALL SELECT 'token_outcomes', n_nationkey, false FROM nation UNION ALL SELECT 'token_performance', r_regionkey, false FROM region),
c AS (SELECT brief, i, CASE WHEN k.tab = 'ghosts' THEN 'UNKNOWN_TABLE' WHEN n % 11 = 5 THEN 'ROW_NOT_FOUND' WHEN k.tab = 'judgment_tool_calls' AND k.id < 2 THEN CASE WHEN n % 13 = 4 THEN 'FIELD_NOT_FOUND' WHEN n % 5 = 3 THEN 'VALUE_MISMATCH' ELSE 'OK' END
  WHEN r.id IS NULL THEN 'ROW_NOT_FOUND' WHEN n % 13 = 4 THEN 'FIELD_NOT_FOUND' WHEN n % 5 = 3 THEN 'VALUE_MISMATCH' ELSE 'OK' END AS code, i < 6 AS bears FROM k LEFT JOIN r ON r.tab = k.tab AND r.id = k.id)
SELECT brief, count(*) AS total, count(*) FILTER (code = 'OK') AS verified, count(*) FILTER (code = 'UNKNOWN_TABLE') AS unknown_tables, count(*) FILTER (code = 'ROW_NOT_FOUND') AS no_rows, count(*) FILTER (code = 'FIELD_NOT_FOUND') AS no_fields, count(*) FILTER (code = 'VALUE_MISMATCH') AS mismatches,
  count(*) FILTER (code <> 'OK' AND bears) AS load_bearing_failures, CASE WHEN count(*) FILTER (code <> 'OK' AND bears) > 0 THEN 'REJECT' ELSE 'OK' END AS verdict FROM c GROUP BY 1""")
def citation_verdicts(spark: SparkSession, sf: str) -> DataFrame:
    """Briefs that cite seven tables and their own tool calls. Claims repeat what
    the field says: numbers within half a percent, times to the second; every
    fifth is wrong, every thirteenth names a field that isn't there, every
    eleventh a row that can't be."""
    tables = {name: (read(spark, sf, t), key) for name, (t, key) in ROLES.items()}
    p = _pointers(spark, sf)

    def said(name: str) -> DataFrame:
        df, key = tables[name]
        c = F.col(CITED[name])
        kind = dict(df.dtypes)[CITED[name]]
        claim = F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss") if kind.startswith("timestamp") else c.cast("string") if kind == "string" else (c * 1.004).cast("string")
        wrong = F.lit("1999-01-01T00:00") if kind.startswith("timestamp") else F.lit("nobody") if kind == "string" else (c * 1.05 + 1).cast("string")
        return df.select(F.lit(name).alias("table"), F.col(key).cast("bigint").alias("id"), claim.alias("right"), wrong.alias("wrong"))

    p = p.join(reduce(DataFrame.unionByName, [said(n) for n in ROLES]), ["table", "id"], "left")
    n, tool = F.col("n"), F.col("table") == "judgment_tool_calls"
    right = F.when(tool, (F.col("brief") + F.col("id")).cast("string")).otherwise(F.col("right"))
    wrong = F.when(tool, "-1").otherwise(F.col("wrong"))
    field = F.when(tool, "found").otherwise(F.try_element_at(F.create_map(*[F.lit(x) for kv in CITED.items() for x in kv]), F.col("table")))
    pointer = F.struct(
        F.col("table"), F.when(n % 11 == 5, "x1").otherwise(F.concat(F.when(n % 2 == 0, "00").otherwise(""), F.col("id").cast("string"))).alias("rowId"),
        F.when(n % 13 == 4, "nothing").otherwise(F.coalesce(field, F.lit("any"))).alias("field"), F.coalesce(F.when(n % 5 == 3, wrong).otherwise(right), F.lit("none")).alias("claimedValue"),
    )
    g = p.groupBy("brief").agg(F.sort_array(F.collect_list(F.struct("i", pointer.alias("p")))).alias("ps"))
    of: Column = F.col("ps.p")
    risk = lambda i: F.struct(F.lit("r").alias("risk"), F.lit("OTHER").alias("tag"), F.lit("LOW").alias("severity"), F.slice(of, i, 1 if i < 5 else 2).alias("evidence"))
    payload = F.to_json(F.struct(F.lit("t").alias("thesis"), F.slice(of, 1, 2).alias("thesisEvidence"), F.lit(5000).alias("confidenceBps"), F.array(risk(3), risk(4), risk(5)).alias("riskCalls"), F.array(F.struct(F.lit("c").alias("claim"), F.slice(of, 7, 1).alias("evidence"))).alias("disconfirming"), F.array(F.lit("w")).alias("whatWouldChangeThisCall"), F.lit("PASS").alias("recommendation")))
    # each table's citations, the calls and the verdicts read them again
    payloads = written(spread(g.select("brief", payload.alias("json")), "brief").where(briefs.brief_error(F.col("json")).isNull()), "payloads")
    calls = payloads.select("brief", F.explode(F.array(F.lit(0), F.lit(1))).alias("seq")).select("brief", "seq", F.to_json(F.struct((F.col("brief") + F.col("seq")).alias("found"), F.array(F.lit("a"), F.lit("b")).alias("list"))).alias("result"))
    checks = citations.check_citations(payloads, tables, calls)
    count = lambda code, name: F.count_if(F.col("code") == code).alias(name)
    codes = checks.groupBy("brief").agg(count("UNKNOWN_TABLE", "unknown_tables"), count("ROW_NOT_FOUND", "no_rows"), count("FIELD_NOT_FOUND", "no_fields"), count("VALUE_MISMATCH", "mismatches"))
    return citations.citation_verdicts(payloads, checks).join(codes, "brief")
