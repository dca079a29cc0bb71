"""Commands, messages, amounts and claims in text, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

ADDRESS = "0x[0-9a-fA-F]{40}"


def bytes32_text(word: Column) -> Column:
    """Text of a 32-byte word up to its first NUL, trimmed."""
    return F.trim(F.substring_index(F.decode(F.unhex(F.substring(word, 3, 64)), "UTF-8"), "\0", 1))


def score_request(text: Column) -> Column:
    """struct(kind, address) of a chat message: `score` for an address, alone or
    after /score; `usage` for /score without one; null for other text."""
    t = F.trim(text)
    argument = F.trim(F.regexp_extract(t, r"^/score(?:@\w+)?(?:\s+(.*))?$", 1))
    command = t.rlike(r"^/score(?:@\w+)?(?:\s+.*)?$")
    of = lambda kind, a: F.struct(F.lit(kind).alias("kind"), a.alias("address"))
    return F.when(t.rlike(f"^{ADDRESS}$"), of("score", F.lower(t))).when(command & argument.rlike(f"^{ADDRESS}$"), of("score", F.lower(argument))).when(command, of("usage", F.lit(None).cast("string")))


def usd(x: Column) -> Column:
    """$1,234; unknown where null or not finite."""
    ok = x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    return F.when(ok, F.concat(F.lit("$"), F.format_number(F.floor(x + 0.5).cast("bigint"), 0))).otherwise("unknown")


def age(minutes: Column) -> Column:
    one = lambda x: F.format_string("%.1f", F.floor(x * 10 + 0.5) / 10)
    hours = minutes / 60
    return F.when(minutes < 90, F.concat(F.greatest(F.lit(0), F.floor(minutes + 0.5)).cast("bigint").cast("string"), F.lit("m"))).when(hours < 48, F.concat(one(hours), F.lit("h"))).otherwise(F.concat(one(hours / 24), F.lit("d")))


def percent(bps: Column) -> Column:
    return F.when(bps.isNull(), "unknown").otherwise(F.concat(F.format_string("%.1f", F.floor(bps / 10 + 0.5) / 10), F.lit("%")))


def iso_millis(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")


def age_minutes(then: Column, now: Column) -> Column:
    """Of two columns of microseconds; at least 0."""
    return F.greatest(F.lit(0), F.floor((now - then) / 60_000_000)).cast("bigint")


def usd_number(x: Column) -> Column:
    """A number of a text; blank text counts 0, null and other text null."""
    t = F.trim(x)
    v = F.when(t == "", F.lit(0.0)).otherwise(t.try_cast("double"))
    return F.when(~F.isnan(v) & (F.abs(v) < float("inf")), v)


def within_tolerance(claimed: Column, actual: Column, bps: float) -> Column:
    """Relative to the actual value, to the claim where that is 0."""
    base = F.when(actual == 0, F.abs(claimed)).otherwise(F.abs(actual))
    return (claimed == actual) | ((base > 0) & (F.abs(claimed - actual) / base * 10_000 <= bps))


def any_claim_holds(claimed: Column, actual: Column, bps: float = 100) -> Column:
    """For an array of actual texts: the claim is the whole array, as JSON without
    spaces, or holds for any element; false for an empty or null array."""
    whole = F.to_json(actual) == F.regexp_replace(claimed, r"\s*([\[\],])\s*", "$1")
    return F.coalesce(whole, F.lit(False)) | F.coalesce(F.exists(actual, lambda a: F.coalesce(claim_holds(claimed, a, bps), F.lit(False))), F.lit(False))


def claim_holds(claimed: Column, actual: Column, bps: float = 100) -> Column:
    """Numbers within tolerance, timestamps by the minute, other text exactly."""
    c, a = F.trim(claimed), F.trim(actual)
    stamp = r"^\d{4}-\d\d-\d\dT\d\d:\d\d"
    x, y = c.try_cast("double"), a.try_cast("double")
    return F.when(a.rlike(stamp), F.substring(a, 1, 16) == F.substring(c, 1, 16)).when(x.isNotNull() & y.isNotNull(), within_tolerance(x, y, bps)).otherwise(c == a)


def quote_wide_integers(json: Column, keys: tuple[str, ...] = ("id", "update_id")) -> Column:
    """JSON with the bare integers of these keys put in quotes, so that no reader
    rounds them; other keys, and digits inside texts, stay."""
    return F.regexp_replace(json, rf'"({"|".join(keys)})":(-?\d+)', '"$1":"$2"')


def strict_object(json: Column, kinds: dict[str, str]) -> Column:
    """struct of a JSON object's fields if it has all these keys, each of its type
    (`number`, `string`, `boolean` or words to choose from, as `A|B`; a ? allows
    null), else null. A number in quotes is a string. More keys are ignored."""

    def of(x: Column) -> Column:
        ok, fields = x["object"], []
        for k, kind in kinds.items():
            part = F.try_variant_get(x["whole"], f"$.{k}", "variant")
            there = F.schema_of_variant(part)
            plain = kind.removesuffix("?")
            text = F.try_variant_get(x["whole"], f"$.{k}", "string")
            if plain == "number":
                v, right = F.try_variant_get(x["whole"], f"$.{k}", "double"), there.rlike("^(BIGINT|DECIMAL|DOUBLE|FLOAT)")
            elif plain == "boolean":
                v, right = F.try_variant_get(x["whole"], f"$.{k}", "boolean"), there == "BOOLEAN"
            else:
                v, right = text, there == "STRING"
                if plain != "string":
                    right &= text.isin(*plain.split("|"))
            ok &= F.coalesce(right, F.lit(False)) | F.coalesce(there == "VOID", F.lit(False)) & F.lit(kind.endswith("?"))
            fields.append(v.alias(k))
        return F.when(ok, F.struct(*fields))

    # an element of an array is parsed once, a plain expression wherever it is named
    once = F.struct(F.try_parse_json(json).alias("whole"), F.coalesce(json.rlike(r"^\s*\{"), F.lit(False)).alias("object"))
    return F.get(F.transform(F.array(once), of), F.lit(0))


#: The keys of stored entry features and their types.
ENTRY_FEATURES = {
    "quoteLiquidityUsd": "string?",
    "totalLiquidityUsd": "string?",
    "ageMinutesAtEntry": "number",
    "uniqueBuyers20m": "number?",
    "uniqueBuyers1h": "number?",
    "buyCount20m": "number?",
    "sellCount20m": "number?",
    "quoteBuyVolumeRaw20m": "string?",
    "quoteSellVolumeRaw20m": "string?",
    "buySizeGiniBps": "number?",
    "buySizeEntropyBps": "number?",
    "repeatedSizeBuyPctBps": "number?",
    "floatBps": "number?",
    "supplyInPoolBps": "number?",
    "adjustedTop10PctBps": "number?",
    "deployerPctBps": "number?",
    "holderCount": "number?",
    "adjustedHolderCount": "number?",
    "largestHolderPctBps": "number?",
    "holderClusterScoreBps": "number?",
    "riskStatus": "PASS|FAIL|UNKNOWN|STALE|ERROR?",
    "simulationStatus": "PASS|FAIL|UNKNOWN?",
    "effectiveSellLossBps": "number?",
    "criticalPermissionPresent": "boolean?",
    "isProxy": "boolean?",
    "verificationStatus": "VERIFIED|UNVERIFIED|UNKNOWN?",
}


def entry_features(json: Column) -> Column:
    """Entry features, all or none: a row that lacks a key is not guessed at."""
    return strict_object(json, ENTRY_FEATURES)
