"""Briefs in JSON: what makes one invalid, and the evidence it points to.

Types are those of the JSON itself: a number in quotes is a text. All of it is
column expressions over a variant that is parsed once.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# The limits of a brief and the words it may use.
THESIS, ITEMS, ITEM, RISKS = 600, 8, 400, 3
TAGS = ["RUG_LP_PULL", "SELL_RESTRICTION", "CONCENTRATION_DUMP", "WASH_COORDINATION", "NO_FOLLOW_THROUGH", "OTHER"]
SEVERITIES = ["LOW", "MEDIUM", "HIGH"]
CALLS = ["RESEARCH", "WATCH", "PASS"]
POINTER = ["table", "rowId", "field", "claimedValue"]


def part(v: Column, path: str) -> Column:
    return F.try_variant_get(v, path, "variant")


def kind(v: Column) -> Column:
    """STRING, BIGINT, OBJECT<...>, ARRAY<...>, VOID, ...; empty where nothing is."""
    return F.coalesce(F.schema_of_variant(v), F.lit(""))


def text(v: Column, path: str) -> Column:
    """The text at a path; null where something else or nothing is."""
    return F.when(kind(part(v, path)) == "STRING", F.try_variant_get(v, path, "string"))


def items(v: Column, path: str) -> Column:
    """The elements of an array at a path; null where none is."""
    return F.when(kind(part(v, path)).startswith("ARRAY"), F.try_variant_get(v, path, "array<variant>"))


def length(x: Column) -> Column:
    """In units of UTF-16, as the briefs' limits count."""
    return (F.octet_length(F.encode(x, "UTF-16BE")) / 2).cast("int")


def filled(x: Column) -> Column:
    return F.coalesce(x != "", F.lit(False))


def _say(code: str, *words) -> Column:
    return F.concat(F.lit(code + ": "), *[w if isinstance(w, Column) else F.lit(w) for w in words])


def _at(path, i: Column) -> Column:
    return F.concat(path if isinstance(path, Column) else F.lit(path), F.lit("["), i.cast("string"), F.lit("]"))


def _first(elements: Column, problem) -> Column:
    """The first problem of an array's elements, each with its index; null if
    there is none."""
    return F.get(F.array_compact(F.transform(elements, lambda x, i: problem(x, i))), F.lit(0))


def pointer_problem(p: Column, path: Column) -> Column:
    """Of one pointer to evidence: four texts, none empty."""
    out = F.when(~kind(p).startswith("OBJECT"), _say("EVIDENCE_POINTER_INVALID", path, " must be an object"))
    for field in POINTER:
        out = out.when(~filled(text(p, f"$.{field}")), _say("EVIDENCE_POINTER_INVALID", path, f".{field} must be a nonempty string"))
    return out


def evidence_problem(v: Column, at: str, path) -> Column:
    found = items(v, at)
    return F.when(found.isNull(), _say("EVIDENCE_ARRAY_INVALID", path, " must be an array")).otherwise(_first(found, lambda p, i: pointer_problem(p, _at(path, i))))


def risk_problem(r: Column, i: Column) -> Column:
    path, evidence = _at("riskCalls", i), F.concat(_at("riskCalls", i), F.lit(".evidence"))
    bad = evidence_problem(r, "$.evidence", evidence)
    one_of = lambda at, words: ~F.coalesce(text(r, at).isin(words), F.lit(False))
    # coalesce, as a problem that is tested and then named would be sought twice
    return F.coalesce(
        F.when(~kind(r).startswith("OBJECT"), _say("RISK_CALL_INVALID", path, " must be an object"))
        .when(~filled(text(r, "$.risk")), _say("RISK_CALL_INVALID", path, ".risk must be a nonempty string"))
        .when(one_of("$.tag", TAGS), _say("RISK_CALL_TAG_INVALID", path, ".tag must be one of " + ", ".join(TAGS)))
        .when(one_of("$.severity", SEVERITIES), _say("RISK_CALL_SEVERITY_INVALID", path, ".severity must be one of " + ", ".join(SEVERITIES))),
        bad,
        F.when(F.size(items(r, "$.evidence")) == 0, _say("RISK_CALL_EVIDENCE_EMPTY", evidence, " must contain at least one pointer")),
    )


def claim_problem(c: Column, i: Column) -> Column:
    path = _at("disconfirming", i)
    claim = text(c, "$.claim")
    return (
        F.when(~kind(c).startswith("OBJECT"), _say("CITED_CLAIM_INVALID", path, " must be an object"))
        .when(~filled(claim), _say("CITED_CLAIM_INVALID", path, ".claim must be a nonempty string"))
        .when(length(claim) > ITEM, _say("CITED_CLAIM_TOO_LONG", path, f".claim exceeds {ITEM} characters"))
        .otherwise(evidence_problem(c, "$.evidence", F.concat(path, F.lit(".evidence"))))
    )


def change_problem(x: Column, i: Column) -> Column:
    path, words = _at("whatWouldChangeThisCall", i), text(x, "$")
    return F.when(~filled(words), _say("STRING_ARRAY_ITEM_INVALID", path, " must be a nonempty string")).when(length(words) > ITEM, _say("STRING_ARRAY_ITEM_TOO_LONG", path, f" exceeds {ITEM} characters"))


def brief_problem(json: Column) -> Column:
    """The first thing that makes a brief's JSON invalid, as `CODE: what`; null
    where it is valid. An object with a key twice isn't read as JSON."""

    def of(v: Column) -> Column:
        thesis, confidence = text(v, "$.thesis"), F.try_variant_get(v, "$.confidenceBps", "double")
        number = kind(part(v, "$.confidenceBps")).rlike("^(BIGINT|DECIMAL|DOUBLE|FLOAT)")
        whole = F.coalesce(number & (confidence == F.floor(confidence)) & confidence.between(0, 10_000), F.lit(False))
        evidence = evidence_problem(v, "$.thesisEvidence", "thesisEvidence")
        risks, claims, changes = items(v, "$.riskCalls"), items(v, "$.disconfirming"), items(v, "$.whatWouldChangeThisCall")
        risk, claim, change = _first(risks, risk_problem), _first(claims, claim_problem), _first(changes, change_problem)
        return F.coalesce(
            F.when(v.isNull(), _say("INVALID_JSON", "payload is not valid JSON"))
            .when(~kind(v).startswith("OBJECT"), _say("INVALID_SHAPE", "payload must be a JSON object"))
            .when(~filled(thesis), _say("THESIS_INVALID", "thesis must be a nonempty string"))
            .when(length(thesis) > THESIS, _say("THESIS_TOO_LONG", f"thesis exceeds {THESIS} characters")),
            evidence,
            F.when(~whole, _say("CONFIDENCE_OUT_OF_RANGE", "confidenceBps must be an integer between 0 and 10000"))
            .when(risks.isNull(), _say("RISK_CALLS_INVALID", "riskCalls must be an array"))
            .when(F.size(risks) != RISKS, _say("RISK_CALLS_COUNT", f"riskCalls must contain exactly {RISKS} entries")),
            risk,
            F.when(claims.isNull(), _say("CITED_CLAIM_ARRAY_INVALID", "disconfirming must be an array"))
            .when(F.size(claims) > ITEMS, _say("CITED_CLAIM_ARRAY_TOO_LONG", f"disconfirming must contain at most {ITEMS} items")),
            claim,
            F.when(changes.isNull(), _say("STRING_ARRAY_INVALID", "whatWouldChangeThisCall must be an array"))
            .when(F.size(changes) > ITEMS, _say("STRING_ARRAY_TOO_LONG", f"whatWouldChangeThisCall must contain at most {ITEMS} items")),
            change,
            F.when(~F.coalesce(text(v, "$.recommendation").isin(CALLS), F.lit(False)), _say("RECOMMENDATION_INVALID", "recommendation must be one of " + ", ".join(CALLS))),
        )

    return F.get(F.transform(F.array(F.try_parse_json(json)), of), F.lit(0))


def brief_error(json: Column) -> Column:
    """The code of brief_problem."""
    return F.substring_index(brief_problem(json), ":", 1)


def pointers(json: Column) -> Column:
    """Array of (claim, load_bearing, table, row, field, claimed): every pointer
    of a valid brief with the clause it belongs to. The thesis and the risk calls
    bear the brief's load, what is disconfirming doesn't."""

    def point(p: Column, claim: Column, bears: bool) -> Column:
        return F.struct(claim.alias("claim"), F.lit(bears).alias("load_bearing"), *[text(p, f"$.{f}").alias(name) for f, name in zip(POINTER, ("table", "row", "field", "claimed"))])

    def of(v: Column) -> Column:
        inner = lambda at, bears: F.flatten(F.transform(items(v, f"$.{at}"), lambda c, i: F.transform(items(c, "$.evidence"), lambda p: point(p, _at(at, i), bears))))
        return F.concat(F.transform(items(v, "$.thesisEvidence"), lambda p: point(p, F.lit("thesis"), True)), inner("riskCalls", True), inner("disconfirming", False))

    return F.get(F.transform(F.array(F.try_parse_json(json)), of), F.lit(0))
