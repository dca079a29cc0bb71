"""Evidence that briefs point to, against the rows and tool results themselves."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import ArrayType, DateType, TimestampNTZType, TimestampType

from ..functions import briefs, texts
from ..sources.scratch import written

TOOL_CALLS = "judgment_tool_calls"
ROW = r"^\d+$"
NUMBER = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"
CELL = "struct<kind:string,text:string,elements:array<string>>"


def row_number(text: Column) -> Column:
    """A row's number in text, without leading zeros; null for other text."""
    return F.when(text.rlike(ROW), F.regexp_replace(text, r"^0+(?=\d)", ""))


def cells(df: DataFrame, table: str, key: str) -> DataFrame:
    """(table, row, fields): a table's rows as maps from column names to cells,
    which tell times, lists and other values apart."""

    def cell(f) -> Column:
        c, none = F.col(f.name), F.lit(None).cast("array<string>")
        if isinstance(f.dataType, ArrayType):
            elements = F.transform(c.cast("array<string>"), lambda e: F.coalesce(e, F.lit("")))
            return F.struct(F.lit("list").alias("kind"), F.array_join(elements, ",").alias("text"), elements.alias("elements"))
        if isinstance(f.dataType, (TimestampType, TimestampNTZType, DateType)):
            return F.struct(F.lit("time").alias("kind"), texts.iso_millis(c).alias("text"), none.alias("elements"))
        return F.struct(F.lit("value").alias("kind"), c.cast("string").alias("text"), none.alias("elements"))

    fields = F.create_map(*[x for f in df.schema for x in (F.lit(f.name), cell(f))])
    return df.select(F.lit(table).alias("table"), F.col(key).cast("string").alias("row"), fields.cast(f"map<string,{CELL}>").alias("fields"))


def tool_cells(calls: DataFrame) -> DataFrame:
    """(brief, row, fields) of calls (brief, seq, result): the top keys of results
    that are JSON objects; values inside are their JSON."""

    def plain(v: Column) -> Column:
        return F.coalesce(F.when(briefs.kind(v).rlike("^(OBJECT|ARRAY)"), F.to_json(v)).otherwise(F.try_variant_get(v, "$", "string")), F.lit(""))

    def cell(k: Column, v: Column) -> Column:
        elements = F.transform(briefs.items(v, "$"), plain)
        value = F.when(elements.isNotNull(), F.array_join(elements, ",")).when(briefs.kind(v).startswith("OBJECT"), F.try_element_at("raw", k)).otherwise(plain(v))
        return F.struct(F.when(elements.isNotNull(), "list").otherwise("value").alias("kind"), value.alias("text"), elements.alias("elements"))

    # as text, an object inside keeps the order of its keys
    c = calls.select("brief", F.col("seq").cast("string").alias("row"), F.try_parse_json("result").alias("v"), F.from_json("result", "map<string,string>").alias("raw"))
    fields = F.when(briefs.kind(F.col("v")).startswith("OBJECT"), F.transform_values(F.try_variant_get("v", "$", "map<string,variant>"), cell))
    return c.select("brief", "row", fields.cast(f"map<string,{CELL}>").alias("found"))


def _plain(claimed: Column, actual: Column, bps: float) -> Column:
    x, y = (F.when(c.rlike(NUMBER), c.try_cast("double")) for c in (claimed, actual))
    return F.when(x.isNotNull() & y.isNotNull(), texts.within_tolerance(x, y, bps)).otherwise(claimed == actual)


def holds(claimed: Column, cell: Column, bps: float = 100) -> Column:
    """Whether a claim is what a cell says: numbers within a tolerance, times by
    the minute, of lists the whole (joined by commas) or any element, other
    values as text."""
    c, actual = F.trim(claimed), F.trim(F.coalesce(cell["text"], F.lit("")))
    any_of = F.exists(cell["elements"], lambda e: _plain(c, F.trim(F.coalesce(e, F.lit(""))), bps))
    return F.when(cell["kind"] == "time", F.substring(actual, 1, 16) == F.substring(c, 1, 16)).when(cell["kind"] == "list", (c == actual) | F.coalesce(any_of, F.lit(False))).otherwise(_plain(c, actual, bps))


def check_citations(payloads: DataFrame, tables: dict[str, tuple[DataFrame, str]], calls: DataFrame, bps: float = 100) -> DataFrame:
    """(brief, place, claim, load_bearing, table, row, field, claimed, actual,
    code), one row a pointer of the payloads (brief, json), valid briefs all:
    OK, VALUE_MISMATCH, FIELD_NOT_FOUND, ROW_NOT_FOUND or UNKNOWN_TABLE.

    tables: by name, with their key column. Of each only cited rows are kept, by
    a semi-join with the distinct citations, and their union is joined once;
    pointers are written first, as every table's share of them is read. Tool
    results (brief, seq, result) are those of the same brief.
    """
    p = payloads.select("brief", F.posexplode(briefs.pointers(F.col("json"))).alias("place", "p")).select("brief", "place", "p.*")
    p = written(p.withColumn("key", row_number(F.col("row"))), "pointers")
    cited = p.where(F.col("key").isNotNull()).select("table", "key").distinct()

    def of(name: str) -> DataFrame:
        df, key = tables[name]
        ids = cited.where(F.col("table") == name).select(F.col("key").try_cast(df.schema[key].dataType).alias("cited__")).where("cited__ IS NOT NULL")
        return cells(df.join(ids, F.col(key) == F.col("cited__"), "left_semi"), name, key)

    rows = reduce(DataFrame.unionByName, [of(name) for name in tables]).withColumnRenamed("row", "key")
    tools = tool_cells(calls).withColumnRenamed("row", "key").withColumn("table", F.lit(TOOL_CALLS)).withColumn("called", F.lit(True))
    j = p.join(rows, ["table", "key"], "left").join(tools, ["brief", "table", "key"], "left")
    tool = F.col("table") == TOOL_CALLS
    fields = F.when(tool, F.col("found")).otherwise(F.col("fields"))
    cell = F.try_element_at(fields, F.col("field"))
    missing = F.when(tool, F.col("called").isNull()).otherwise(F.col("fields").isNull())
    code = (
        F.when(~tool & ~F.col("table").isin(list(tables)), "UNKNOWN_TABLE")
        .when(F.col("key").isNull() | missing, "ROW_NOT_FOUND")
        .when(~F.coalesce(F.map_contains_key(fields, F.col("field")), F.lit(False)), "FIELD_NOT_FOUND")
        .when(F.coalesce(holds(F.col("claimed"), cell, bps), F.lit(False)), "OK")
        .otherwise("VALUE_MISMATCH")
    )
    actual = F.when(code.isin("OK", "VALUE_MISMATCH"), F.coalesce(cell["text"], F.lit("")))
    return j.select("brief", "place", "claim", "load_bearing", "table", "row", "field", "claimed", actual.alias("actual"), code.alias("code"))


def citation_verdicts(payloads: DataFrame, checks: DataFrame) -> DataFrame:
    """(brief, total, verified, load_bearing_failures, verdict): REJECT where a
    citation fails that the thesis or a risk call rests on. A brief without
    citations is OK."""
    g = checks.groupBy("brief").agg(F.count("*").alias("total"), F.count_if(F.col("code") == "OK").alias("verified"), F.count_if((F.col("code") != "OK") & F.col("load_bearing")).alias("load_bearing_failures"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).alias(c)
    v = payloads.select("brief").distinct().join(g, "brief", "left").select("brief", zero("total"), zero("verified"), zero("load_bearing_failures"))
    return v.withColumn("verdict", F.when(F.col("load_bearing_failures") > 0, "REJECT").otherwise("OK"))
