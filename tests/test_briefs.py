"""Brief validation and citations, case by case."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from tidewatch.functions import briefs
from tidewatch.operators import citations
from tidewatch.plans.briefs import CASES, VALID, _but


def problems(spark, *texts):
    d = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, json string")
    return [r["p"] for r in d.select("i", briefs.brief_problem(F.col("json")).alias("p")).orderBy("i").collect()]


def test_every_case(spark):
    got = problems(spark, *[c for c, _ in CASES])
    assert [p and p.split(":")[0] for p in got] == [code for _, code in CASES]


def test_problems_say_where(spark):
    got = problems(
        spark, _but("riskCalls.2.evidence.0.rowId", 7), _but("disconfirming.0.evidence", [{}]), _but("thesisEvidence.0", None), _but("whatWouldChangeThisCall", ["a", 1]), _but("thesis", "😀" * 301), _but("thesis", "😀" * 300), None,
    )
    assert got == [
        "EVIDENCE_POINTER_INVALID: riskCalls[2].evidence[0].rowId must be a nonempty string",
        "EVIDENCE_POINTER_INVALID: disconfirming[0].evidence[0].table must be a nonempty string",
        None,
        "STRING_ARRAY_ITEM_INVALID: whatWouldChangeThisCall[1] must be a nonempty string",
        "THESIS_TOO_LONG: thesis exceeds 600 characters",
        None,
        "INVALID_JSON: payload is not valid JSON",
    ]


def point(table, row, field, claimed):
    return {"table": table, "rowId": row, "field": field, "claimedValue": claimed}


def brief(thesis=(), risks=((), (), ()), against=()):
    rest = {"riskCalls": [{"risk": "r", "tag": "OTHER", "severity": "LOW", "evidence": list(r)} for r in risks], "disconfirming": [{"claim": "c", "evidence": list(against)}]}
    return json.dumps(VALID | rest | {"thesisEvidence": list(thesis)})


@pytest.fixture(scope="module")
def tables(spark):
    snaps = spark.createDataFrame([(1, "100.50", True, None), (2, "0", False, "x")], "id long, fdv string, ok boolean, note string").withColumn("seen", F.expr("timestamp_ntz'2026-07-10 12:00:30'"))
    risks = spark.createDataFrame([(1, ["mint", "pause"], "PASS")], "id long, reasons array<string>, status string")
    return {"pool_snapshots": (snaps, "id"), "token_risks": (risks, "id")}


CALLS = [(1, 0, '{"n": 5, "list": ["a", 7], "deep": {"b": 1, "a": [2]}, "none": null, "yes": true}'), (1, 1, "[1]"), (2, 0, '{"n": 6}')]


@pytest.mark.parametrize(
    "pointer,code",
    [
        (("pool_snapshots", "1", "fdv", "100.5"), "OK"),
        (("pool_snapshots", "1", "fdv", " 101.0 "), "OK"),
        (("pool_snapshots", "1", "fdv", "102"), "VALUE_MISMATCH"),
        (("pool_snapshots", "1", "fdv", "100.5%"), "VALUE_MISMATCH"),
        (("pool_snapshots", "2", "fdv", "0.0"), "OK"),
        (("pool_snapshots", "2", "fdv", "0.1"), "VALUE_MISMATCH"),
        (("pool_snapshots", "1", "ok", "true"), "OK"),
        (("pool_snapshots", "1", "ok", "True"), "VALUE_MISMATCH"),
        (("pool_snapshots", "1", "note", "null"), "VALUE_MISMATCH"),
        (("pool_snapshots", "1", "note", " "), "OK"),
        (("pool_snapshots", "1", "seen", "2026-07-10T12:00:59.000Z"), "OK"),
        (("pool_snapshots", "1", "seen", "2026-07-10T12:01:00.000Z"), "VALUE_MISMATCH"),
        (("pool_snapshots", "007", "fdv", "1"), "ROW_NOT_FOUND"),
        (("pool_snapshots", "001", "fdv", "100.5"), "OK"),
        (("pool_snapshots", "1x", "fdv", "1"), "ROW_NOT_FOUND"),
        (("pool_snapshots", "-1", "fdv", "1"), "ROW_NOT_FOUND"),
        (("pool_snapshots", "99999999999999999999", "fdv", "1"), "ROW_NOT_FOUND"),
        (("pool_snapshots", "1", "nope", "1"), "FIELD_NOT_FOUND"),
        (("alerts_sent", "1", "fdv", "1"), "UNKNOWN_TABLE"),
        (("token_risks", "1", "reasons", "pause"), "OK"),
        (("token_risks", "1", "reasons", "mint,pause"), "OK"),
        (("token_risks", "1", "reasons", "blacklist"), "VALUE_MISMATCH"),
        (("judgment_tool_calls", "0", "n", "5.02"), "OK"),
        (("judgment_tool_calls", "0", "n", "6"), "VALUE_MISMATCH"),
        (("judgment_tool_calls", "0", "list", "7"), "OK"),
        (("judgment_tool_calls", "0", "deep", '{"b":1,"a":[2]}'), "OK"),
        (("judgment_tool_calls", "0", "yes", "true"), "OK"),
        (("judgment_tool_calls", "0", "none", "x"), "VALUE_MISMATCH"),
        (("judgment_tool_calls", "0", "nope", "1"), "FIELD_NOT_FOUND"),
        (("judgment_tool_calls", "1", "0", "1"), "FIELD_NOT_FOUND"),
        (("judgment_tool_calls", "9", "n", "5"), "ROW_NOT_FOUND"),
        (("judgment_tool_calls", "zero", "n", "5"), "ROW_NOT_FOUND"),
    ],
)
def test_citations(request, tables, pointer, code):
    """All cases run as one job; each is looked up."""
    if not hasattr(test_citations, "codes"):
        spark = request.getfixturevalue("spark")
        cases = [m.args[1] for m in request.node.own_markers + request.node.parent.own_markers if m.name == "parametrize"] or [m.args[1] for m in test_citations.pytestmark if m.name == "parametrize"]
        pointers = [point(*p) for p, _ in cases[0]]
        d = spark.createDataFrame([(1, brief(pointers))], "brief int, json string")
        rows = citations.check_citations(d, tables, spark.createDataFrame(CALLS, "brief int, seq int, result string")).collect()
        test_citations.codes = {(r["table"], r["row"], r["field"], r["claimed"]): r["code"] for r in rows}
    assert test_citations.codes[pointer] == code


def test_verdicts(spark, tables):
    good, bad = point("pool_snapshots", "1", "fdv", "100.5"), point("ghosts", "1", "x", "1")
    rows = [
        (1, brief([good], [[good], [good], [good]], [bad])),
        (2, brief([good], [[good], [good, bad], [good]])),
        (3, brief([bad], [[good]] * 3)),
        (4, brief()),
        (5, brief([point("judgment_tool_calls", "0", "n", "5")], [[good]] * 3)),
    ]
    d = spark.createDataFrame(rows, "brief int, json string")
    checks = citations.check_citations(d, tables, spark.createDataFrame(CALLS, "brief int, seq int, result string"))
    got = {r["brief"]: tuple(r)[1:] for r in citations.citation_verdicts(d, checks).collect()}
    assert got == {1: (5, 4, 0, "OK"), 2: (5, 4, 1, "REJECT"), 3: (4, 3, 1, "REJECT"), 4: (0, 0, 0, "OK"), 5: (4, 3, 1, "REJECT")}
    claims = {(r["brief"], r["claim"]) for r in checks.where("load_bearing AND code <> 'OK'").collect()}
    assert claims == {(2, "riskCalls[1]"), (3, "thesis"), (5, "thesis")}
