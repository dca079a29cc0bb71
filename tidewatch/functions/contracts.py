"""What a contract's storage, bytecode and probes say, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from .keccak import selector

#: Signatures whose selector in bytecode shows a permission.
SIGNATURES = {
    "mint": ("mint(address,uint256)", "mint(uint256)"),
    "blacklist": ("blacklist(address)", "addBlackList(address)", "setBlackListStatus(address,bool)", "isBlacklisted(address)", "setBlacklist(address,bool)"),
    "pause": ("pause()", "unpause()", "setPaused(bool)", "pause(bool)"),
    "transferTax": ("setFee(uint256)", "setFees(uint256,uint256)", "setTaxFee(uint256)", "setBuyTax(uint256)", "setSellTax(uint256)", "setTaxes(uint256,uint256)"),
    "ownership": ("transferOwnership(address)", "renounceOwnership()", "owner()"),
    "upgradeAdmin": ("upgradeTo(address)", "upgradeToAndCall(address,bytes)", "setImplementation(address)"),
}
SELECTORS = {kind: tuple(map(selector, names)) for kind, names in SIGNATURES.items()}


def empty_slot(slot: Column) -> Column:
    return slot.isNull() | slot.rlike("^0x0*$")


def proxy_kind(implementation: Column, beacon: Column, legacy: Column) -> Column:
    return F.when(~empty_slot(implementation), "eip1967").when(~empty_slot(legacy), "legacy").when(~empty_slot(beacon), "beacon").otherwise("none")


def slot_address(slot: Column) -> Column:
    """The last 20 bytes of a word, in lower case."""
    return F.concat(F.lit("0x"), F.lower(F.right(F.lpad(F.substring(slot, 3, 64), 64, "0"), F.lit(40))))


def permission(code: Column, kind: str) -> Column:
    """PRESENT, ABSENT, or UNKNOWN where there is no code."""
    low = F.lower(F.coalesce(code, F.lit("")))
    found = F.exists(F.array(*[F.lit(s) for s in SELECTORS[kind]]), lambda s: F.contains(low, s))
    return F.when(F.length(low) <= 2, "UNKNOWN").when(found, "PRESENT").otherwise("ABSENT")


def matched_selectors(code: Column, kind: str) -> Column:
    low = F.lower(F.coalesce(code, F.lit("")))
    return F.filter(F.array(*[F.lit(s) for s in SELECTORS[kind]]), lambda s: F.contains(low, s))


def critical(code: Column) -> Column:
    """Whether a permission that matters to a holder is there."""
    return F.array_contains(F.array(*[permission(code, k) for k in ("mint", "blacklist", "pause", "upgradeAdmin")]), "PRESENT")


def verification(answered: Column, abi: Column) -> Column:
    """UNKNOWN where the explorer gave no answer."""
    text = F.trim(F.coalesce(abi, F.lit("")))
    return F.when(~answered, "UNKNOWN").when((text == "") | (F.lower(text) == "contract source code not verified"), "UNVERIFIED").otherwise("VERIFIED")


def leg(reverted: Column, out: Column) -> Column:
    return F.when(reverted, "FAIL").when(out.isNull() | (out <= 0), "UNKNOWN").otherwise("PASS")


def simulation(buy: Column, sell: Column, transfer_reverted: Column, sell_loss: Column, most: int = 5_000) -> Column:
    bad = (buy == "FAIL") | (sell == "FAIL") | transfer_reverted | F.coalesce(sell_loss >= most, F.lit(False))
    return F.when(bad, "FAIL").when((buy == "UNKNOWN") | (sell == "UNKNOWN"), "UNKNOWN").otherwise("PASS")


#: The shares and bounds from which a signal is worth a word.
GINI_HIGH, ENTROPY_LOW, REPEATED_HIGH = 7_000, 3_000, 4_000


def positives() -> Column:
    """Reasons worth no points of a candidate, in order: those in favour. The
    texts are fixed output values."""
    c = F.col
    holders = F.coalesce(c("adjusted_holders"), c("holders"))
    return F.array_compact(F.array(
        F.when(c("simulation") == "PASS", "Trade simulation passes through the real route"),
        F.when(c("verification") == "VERIFIED", "Contract source is verified"),
        F.when(c("deployer_bps") <= 100, "Deployer holds a negligible share"),
        F.when(c("top10_bps") < 2_000, "Adjusted top-10 ownership is well distributed"),
        F.when(holders > 0, F.concat(F.lit("Adjusted holder count is "), holders.cast("string"))),
    ))


def advisory() -> Column:
    """Reasons worth no points of a candidate, in order: those against. The texts
    are fixed output values."""
    c = F.col
    when = lambda cond, text: F.when(cond, text if isinstance(text, Column) else F.lit(text))
    bps = lambda head, x, tail: F.concat(F.lit(head), x.cast("string"), F.lit(tail))
    return F.array_compact(F.array(
        when(c("simulation") != "PASS", F.concat(F.lit("Sell simulation is not confirmed (status "), c("simulation"), F.lit(")"))),
        when(c("critical"), "A critical privileged permission is present"),
        when(c("is_proxy"), "Contract is a proxy; logic can change"),
        when(c("verification") == "UNVERIFIED", "Contract source is not verified"),
        when(c("deployer_bps") > 800, bps("Deployer holds a large share (", c("deployer_bps"), " bps of supply)")),
        when(c("top10_bps") >= 6_000, bps("Adjusted top-10 ownership is highly concentrated (", c("top10_bps"), " bps)")),
        when(c("largest_bps") >= 3_000, bps("A single holder controls a large share (", c("largest_bps"), " bps)")),
        when(c("gini_bps") >= GINI_HIGH, bps("Buy sizes are highly concentrated in one buyer (Gini ", c("gini_bps"), " bps)")),
        when(c("entropy_bps") <= ENTROPY_LOW, bps("Buy-size entropy is low (", c("entropy_bps"), " bps of max)")),
        when(c("repeated_bps") >= REPEATED_HIGH, bps("A large share of buys repeat an identical quote size (", c("repeated_bps"), " bps)")),
    ))


def null_reason(trusted: Column, decimals: Column, anchor: Column, liquidity: Column, value: Column) -> Column:
    """Why a pool has no valuation; null where it has one."""
    return (
        F.when(~F.coalesce(trusted, F.lit(False)), "no-trusted-quote")
        .when(decimals.isNull() | ~decimals.between(0, 36), "metadata-error")
        .when(anchor.isNull(), "no-usd-anchor")
        .when(F.coalesce(liquidity, F.lit(0)) <= 0, "zero-liquidity")
        .when(value.isNull(), "overflow")
    )


#: The permissions, and which of them are critical.
PERMISSIONS = {"mint": True, "blacklist": True, "pause": True, "upgradeAdmin": True, "transferTax": False, "ownership": False}


def risk_reasons(verification: Column, proxy: Column, states: dict[str, Column], simulation: Column, simulation_reasons: Column) -> tuple[Column, Column, Column]:
    """(status, risk reasons, good reasons) of a token, in order. states: of each
    permission PRESENT, ABSENT, UNKNOWN or ANALYSIS_FAILED; behind a beacon they
    are all UNKNOWN, as its logic can't be found. simulation: PASS, FAIL or
    UNKNOWN, null if none was made. A critical permission or a failed simulation
    is FAIL, a critical gap UNKNOWN, never a PASS."""
    states = {k: F.when(proxy == "beacon", "UNKNOWN").otherwise(s) for k, s in states.items()}
    found = []
    for k, critical in PERMISSIONS.items():
        s = states[k]
        there = {"transferTax": "Adjustable transfer-tax capability present", "ownership": "Owner-controlled administrative functions present"}.get(k, f"Critical privileged capability present: {k}")
        line = F.when(s == "PRESENT", there)
        found.append(line.when(s.isin("UNKNOWN", "ANALYSIS_FAILED"), f"Privileged-permission analysis incomplete: {k}") if critical else line)
    verified = F.when(verification == "VERIFIED", None).when(verification == "UNVERIFIED", "Contract source is not verified").otherwise("Contract verification status is unknown")
    behind = F.when(proxy != "none", F.concat(F.lit("Contract is a proxy ("), proxy, F.lit("); logic can change")))
    tried = F.when(simulation.isNull(), F.array(F.lit("Trade simulation was not performed"))).otherwise(F.coalesce(simulation_reasons, F.array().cast("array<string>")))
    risks = F.concat(F.array_compact(F.array(verified, behind, *found)), tried)
    good = F.array_compact(F.array(F.when(verification == "VERIFIED", "Contract source is verified"), F.when(simulation == "PASS", "Buy and sell simulate successfully through the real route")))
    critical = [states[k] for k, yes in PERMISSIONS.items() if yes]
    some = lambda *words: F.exists(F.array(*critical), lambda s: s.isin(*words))
    outcome = F.coalesce(simulation, F.lit("UNKNOWN"))
    status = F.when(some("PRESENT") | (outcome == "FAIL"), "FAIL").when(some("UNKNOWN", "ANALYSIS_FAILED") | (outcome == "UNKNOWN"), "UNKNOWN").otherwise("PASS")
    return status, risks, good
