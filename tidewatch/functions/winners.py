"""Which stage lost a winner, what other weights would have caught, and where
system and operator disagree."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from ..operators.series import half_up

c = F.col
# The components of a score, their maxima, and the tiers' labels.
MAXIMA = {"liquidityDepth": 28, "buyerBreadth": 25, "buyFlow": 20, "lowCapTilt": 20}
TIERS = {1: "undiscovered", 2: "no-trusted-quote", 3: "enriched-late", 4: "signals-missing", 5: "hard-gated", 6: "below-floor", 7: "caught"}


def parse_weights(text: str | None) -> dict[str, float]:
    """Weights of all components, as `liquidityDepth:28,buyerBreadth:25,...`;
    they share the maxima's sum. The maxima themselves for None."""
    if text is None:
        return {k: float(v) for k, v in MAXIMA.items()}
    out: dict[str, float] = {}
    for pair in text.split(","):
        key, _, value = pair.partition(":")
        if key not in MAXIMA or not value.replace(".", "", 1).isdigit():
            raise ValueError(f"{pair!r} isn't <component>:<points>")
        out[key] = float(value)
    if missing := MAXIMA.keys() - out.keys():
        raise ValueError(f"no weight for {sorted(missing)}")
    if sum(out.values()) != sum(MAXIMA.values()):
        raise ValueError(f"weights sum to {sum(out.values())}, not {sum(MAXIMA.values())}")
    return out


def weighted_score(weight) -> Column:
    """Components over their maxima, times weight(component), rounded half up."""
    return half_up(reduce(Column.__add__, [c(k) / F.lit(float(most)) * weight(k) for k, most in MAXIMA.items()]))


def delivery_floor(level: Column, floor: int, floor_red: int) -> Column:
    """What a score has to reach to be sent: red ones a floor of their own too."""
    return F.when(level == "RED", max(floor, floor_red)).otherwise(floor)


def sweep(rows: DataFrame, grid: dict[str, dict[str, float]], floor: int, floor_red: int, winner: int = 20_000, big: int = 50_000) -> DataFrame:
    """Per set of weights and period: who would have been caught, against the
    present weights. rows: period, eligible, level, the four components, mult and
    outcome (SURVIVED, DIED or null) of replayed candidates.

    Caught: eligible, not grey, and the weighted score reaches the floor. Rows
    collapse to the distinct tuples of what matters first, a few thousand however
    many rows there are, and only those meet the grid.
    """
    bar = F.when(c("eligible") & (c("level") != "GRAY"), delivery_floor(c("level"), floor, floor_red))
    parts = [*MAXIMA]
    t = rows.groupBy("period", *parts, bar.alias("bar"), (c("mult") >= winner).alias("win"), (c("mult") >= big).alias("win5"), "outcome").agg(F.count("*").alias("k"))
    sets = F.array(*[F.struct(F.lit(name).alias("weights"), *[F.lit(float(w[p])).alias(f"w_{p}") for p in parts]) for name, w in grid.items()])
    t = t.select("*", F.inline(sets))
    t = t.withColumns({"base": F.coalesce(weighted_score(lambda p: F.lit(float(MAXIMA[p]))) >= c("bar"), F.lit(False)), "caught": F.coalesce(weighted_score(lambda p: c(f"w_{p}")) >= c("bar"), F.lit(False))})
    n = lambda when, name: F.coalesce(F.sum(F.when(when, c("k"))), F.lit(0)).alias(name)
    let_in = c("caught") & ~c("base") & ~c("win")
    g = t.groupBy("weights", "period").agg(
        F.sum("k").alias("n"), n(c("win"), "winners"), n(c("win5"), "winners_5x"), n(c("base"), "caught_base"), n(c("caught"), "caught"),
        n(c("base") & c("win"), "hits_base"), n(c("caught") & c("win"), "hits"), n(c("base") & c("win5"), "hits_5x_base"), n(c("caught") & c("win5"), "hits_5x"),
        n(let_in, "losers_let_in"), n(let_in & (c("outcome") == "DIED"), "let_in_died"), n(let_in & c("outcome").isNotNull() & (c("outcome") != "DIED"), "let_in_survived"), n(let_in & c("outcome").isNull(), "let_in_unknown"),
    )
    share = lambda a, b: F.when(c(b) == 0, 0.0).otherwise(c(a) / c(b))
    return g.withColumns({
        "delta_caught": c("caught") - c("caught_base"), "delta_hits": c("hits") - c("hits_base"), "delta_hits_5x": c("hits_5x") - c("hits_5x_base"),
        "precision_base": share("hits_base", "caught_base"), "recall_base": share("hits_base", "winners"), "precision": share("hits", "caught"), "recall": share("hits", "winners"),
    })


def ceiling(rows: DataFrame, winner: int = 20_000, caught: int = 75, reachable: int = 55) -> DataFrame:
    """One row: of the winners, how many were caught already, could be reached by
    other weights, were blocked by a gate, or score too low for either."""
    score, gate = weighted_score(lambda p: F.lit(float(MAXIMA[p]))), ~c("eligible") | (c("level") == "GRAY")
    w = rows.where(c("mult") >= winner)
    n = lambda when, name: F.count_if(when).alias(name)
    return w.agg(F.count("*").alias("winners"), n(~gate & (score >= caught), "already_caught"), n(~gate & (score >= reachable) & (score < caught), "reachable"), n(gate, "gate_blocked"), n(~gate & (score < reachable), "below"))


def gate_attribution(shadow: str, replay: str, floor: int, floor_red: int) -> Column:
    """(source, eligible, score, level, floor): what the gate said of a winner,
    from the decision that was logged (a struct column, null if none), else from
    the replay of its features (likewise), else none."""

    def of(source: str, column: str | None) -> Column:
        field = lambda f, kind: (F.col(f"{column}.{f}") if column else F.lit(None)).cast(kind).alias(f)
        bar = delivery_floor(F.col(f"{column}.level"), floor, floor_red) if column else F.lit(floor)
        return F.struct(F.lit(source).alias("source"), field("eligible", "boolean"), field("score", "int"), field("level", "string"), bar.cast("int").alias("floor"))

    return F.when(F.col(shadow).isNotNull(), of("shadow", shadow)).when(F.col(replay).isNotNull(), of("replay", replay)).otherwise(of("none", None))


def coverage_tier(trusted: Column, snapshots: Column, gate: str) -> Column:
    """The first stage that would have hidden a winner, 2 to 7. Tier 1 isn't
    discovered, so it has no row."""
    g = lambda f: F.col(f"{gate}.{f}")
    under = g("eligible") & ((g("score") < g("floor")) | (g("level") == "GRAY"))
    return F.when(~trusted, 2).when(~snapshots, 3).when(g("source") == "none", 4).when(~g("eligible"), 5).when(F.coalesce(under, F.lit(False)), 6).otherwise(7)


def tier_label(tier: Column) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for kv in TIERS.items() for x in kv]), tier)


def feedback(alerts: DataFrame, decisions: DataFrame, outcomes: DataFrame, trades: DataFrame) -> DataFrame:
    """One row a token on which system and operator disagree, explainably:
    alerted yellow or green and survived but not entered; entered and died only;
    survived without any alert. alerts (token, pool, level), decisions (token,
    pool, action), outcomes (token, pool, outcome), trades (token, pool, side) of
    watched wallets. Each source is reduced to its distinct values before they
    are united."""
    sources = {"levels": (alerts, "level"), "actions": (decisions, "action"), "outcomes": (outcomes, "outcome"), "sides": (trades, "side")}
    u = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [df.select("token", "pool", c(col).alias(name)).distinct() for name, (df, col) in sources.items()])
    g = u.groupBy("token").agg(F.sort_array(F.collect_set("pool")).alias("pools"), *[F.sort_array(F.collect_set(n)).alias(n) for n in sources])
    has = lambda n, *values: F.arrays_overlap(c(n), F.array(*map(F.lit, values)))
    entered, survived, died = has("actions", "ENTERED") | has("sides", "BUY"), has("outcomes", "SURVIVED"), has("outcomes", "DIED")
    q = F.when(has("levels", "YELLOW", "GREEN") & survived & ~entered, "SYSTEM-HIT/OPERATOR-MISS").when(entered & died & ~survived, "BAD-ENTRY").when(survived & (F.size("levels") == 0), "SYSTEM-MISS")
    return g.withColumn("quadrant", q).where("quadrant IS NOT NULL")
