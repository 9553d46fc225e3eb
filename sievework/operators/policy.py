"""Decision policies, costs and threshold search as CASE expressions and small grids."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.constants import ACTIONS, BRAND_REVIEW_SCORE, COSTS, DEPLOYMENT_PREVALENCE, EVIDENCE_FEATURES, RISKS, THREATS, THRESHOLD_GRID, V1_REASONS, V1_THRESHOLDS, V2_THRESHOLDS

Read = Callable[[str], Column]


def value(name: str) -> Column:
    return F.coalesce(F.col(f"feature__{name}"), F.lit(0.0))


def available(name: str) -> Column:
    return F.coalesce(F.col(f"available__{name}"), F.lit(False))


def flag(name: str) -> Column:
    """Available and at least one half."""
    return available(name) & (value(name) >= 0.5)


def check_thresholds(review: float, block: float) -> None:
    if not (0 <= review <= 1 and 0 <= block <= 1 and review <= block):
        raise ValueError("thresholds need 0 <= review <= block <= 1")


def evidence_count(columns: set[str] | None = None) -> Column:
    """How many of the evidence features that a frame has are available and set."""
    names = [n for n in EVIDENCE_FEATURES if columns is None or f"feature__{n}" in columns]
    return sum((flag(n).cast("int") for n in names), F.lit(0))


def _decision(rules: list[tuple[Column | None, str, str, str]], evidence: Column) -> Column:
    out = None
    for test, risk, action, reason in rules:
        made = F.struct(F.lit(risk).alias("risk"), F.lit(action).alias("action"), F.lit(reason).alias("reason"))
        out = (F.when(test, made) if out is None else out.when(test, made)) if test is not None else out.otherwise(made)
    return out


def decide_v1(evidence: Column, review: float | Column = V1_THRESHOLDS[0], block: float | Column = V1_THRESHOLDS[1]) -> Column:
    """struct(risk, action, reason) of the first policy; the first rule that holds decides."""
    if isinstance(review, float):
        check_thresholds(review, block)
    p = value("phishing_probability")
    rules = [
        (flag("known_malicious"), "DANGEROUS", "BLOCK", V1_REASONS["malicious"]),
        (flag("whitelist_hit"), "SAFE", "ALLOW", V1_REASONS["whitelist"]),
        ((p >= block) & (evidence >= 1), "DANGEROUS", "BLOCK", V1_REASONS["high"]),
        (p >= review, "SUSPICIOUS", "REVIEW", V1_REASONS["elevated"]),
        (None, "SAFE", "ALLOW", V1_REASONS["low"]),
    ]
    return _decision(rules, evidence)


def decide_v2(evidence: Column, review: float = V2_THRESHOLDS[0], block: float = V2_THRESHOLDS[1]) -> Column:
    """struct(risk, action, reason) of the second policy, which knows brands, shorteners and redirects."""
    check_thresholds(review, block)
    p = value("phishing_probability")
    score = F.when(available("brand_risk_score"), value("brand_risk_score")).otherwise(0.0)
    mismatch, redirect = flag("brand_domain_mismatch"), flag("cross_domain_redirect")
    official = flag("brand_detected") & ~mismatch & (score <= 0)
    rules = [
        (flag("known_malicious"), "DANGEROUS", "BLOCK", "KNOWN_MALICIOUS_GUARDRAIL"),
        (flag("whitelist_hit"), "SAFE", "ALLOW", "WHITELIST_ALLOW"),
        (official & ~redirect, "SAFE", "ALLOW", "OFFICIAL_BRAND_DOMAIN_ALLOW"),
        (mismatch & (p >= block), "DANGEROUS", "BLOCK", "BRAND_IMPERSONATION_BLOCK"),
        (mismatch & ((p >= review) | (score >= BRAND_REVIEW_SCORE)), "SUSPICIOUS", "REVIEW", "BRAND_IMPERSONATION_REVIEW"),
        ((p >= block) & (evidence >= 1), "DANGEROUS", "BLOCK", "HIGH_PROBABILITY_WITH_EVIDENCE"),
        (flag("shortener_detected"), "SUSPICIOUS", "REVIEW", "SHORTENER_REVIEW"),
        (redirect, "SUSPICIOUS", "REVIEW", "CROSS_DOMAIN_REDIRECT_REVIEW"),
        (p >= review, "SUSPICIOUS", "REVIEW", "ELEVATED_PROBABILITY"),
        (None, "SAFE", "ALLOW", "LOW_RISK"),
    ]
    return _decision(rules, evidence)


def probability_only(review: float, block: float) -> Column:
    """The action by thresholds alone."""
    p = value("phishing_probability")
    return F.when(p >= block, "BLOCK").when(p >= review, "REVIEW").otherwise("ALLOW")


def guardrail(action: Column) -> Column:
    """BLOCK where known malicious, else the action given."""
    return F.when(flag("known_malicious"), "BLOCK").otherwise(action)


def cost(state: Column, action: Column) -> Column:
    """The cost of an action in a true state; null for other states."""
    table = F.create_map(*[F.lit(x) for s, row in COSTS.items() for a, c in zip(ACTIONS, row) for x in (f"{s}|{a}", c)])
    return F.try_element_at(table, F.concat_ws("|", state, action))


def expected_cost(df: DataFrame, state: str = "true_state", action: str = "action") -> DataFrame:
    return df.agg(F.avg(cost(F.col(state), F.col(action))).alias("expected_cost"))


def prevalence(df: DataFrame, state: str = "true_state", target: float = DEPLOYMENT_PREVALENCE) -> DataFrame:
    """One row of weights that give malicious rows the prevalence of deployment; both classes are needed."""
    share = F.avg((F.col(state) != "BENIGN").cast("double"))
    found = df.agg(share.alias("observed"))
    ok = F.assert_true((F.col("observed") > 0) & (F.col("observed") < 1), F.lit("both classes are needed")).isNull()
    weights = {"w_malicious": F.lit(target) / F.col("observed"), "w_benign": (1 - F.lit(target)) / (1 - F.col("observed"))}
    return found.where(ok).withColumns(weights)


def select_thresholds(df: DataFrame, evidence: Column, state: str = "true_state", grid: tuple[float, ...] = THRESHOLD_GRID, target: float = DEPLOYMENT_PREVALENCE) -> DataFrame:
    """One row: the pair of thresholds of lowest weighted mean cost, with its cost and the grid's size.

    What decides is the probability, whether there is evidence, the guardrails and the state, and of the
    probability only between which grid values it lies. So rows are counted by these few cells first, and the
    grid meets at most (grid + 1) * 16 cells however many rows there are.
    """
    p = value("phishing_probability")
    at = sum(((p >= g).cast("int") for g in grid), F.lit(0))
    cells = df.select(at.alias("at"), (evidence >= 1).alias("ev"), flag("known_malicious").alias("known"), flag("whitelist_hit").alias("white"), F.col(state).alias("state"))
    cells = cells.groupBy("at", "ev", "known", "white", "state").agg(F.count(F.lit(1)).alias("n"))
    weights = cells.agg((F.sum(F.when(F.col("state") != "BENIGN", F.col("n")).otherwise(0)) / F.sum("n")).alias("observed"))
    pairs = df.sparkSession.createDataFrame([(i, j, grid[i], grid[j]) for i in range(len(grid)) for j in range(i, len(grid))], "i int, j int, review_at double, block_at double")
    joined = cells.crossJoin(F.broadcast(pairs)).crossJoin(F.broadcast(weights))
    action = F.when(F.col("known"), "BLOCK").when(F.col("white"), "ALLOW").when((F.col("at") > F.col("j")) & F.col("ev"), "BLOCK").when(F.col("at") > F.col("i"), "REVIEW").otherwise("ALLOW")
    weight = F.when(F.col("state") == "BENIGN", (1 - F.lit(target)) / (1 - F.col("observed"))).otherwise(F.lit(target) / F.col("observed"))
    per_pair = joined.groupBy("review_at", "block_at").agg((F.sum(weight * F.col("n") * cost(F.col("state"), action)) / F.sum(weight * F.col("n"))).alias("c"))
    best = F.min(F.struct(F.round("c", 12).alias("c"), "review_at", "block_at"))
    return per_pair.agg(best.alias("b"), F.count(F.lit(1)).alias("evaluated")).select("b.review_at", "b.block_at", F.round("b.c", 6).alias("expected_cost"), "evaluated", F.lit(len(grid) ** 2).alias("grid_size"))


def operational(df: DataFrame, state: str = "true_state", action: str = "action", target: float = DEPLOYMENT_PREVALENCE) -> DataFrame:
    """One row: weighted expected cost, and the share of each action by class and overall."""
    cells = df.groupBy(F.col(state).alias("state"), F.col(action).alias("action")).agg(F.count(F.lit(1)).alias("n"))
    bad = F.col("state") != "BENIGN"
    total = F.sum("n")
    share = F.sum(F.when(bad, F.col("n")).otherwise(0)) / total
    mean = lambda test: F.sum(F.when(test, F.col("n") * cost(F.col("state"), F.col("action")))) / F.sum(F.when(test, F.col("n")))
    rate = lambda test, what: F.round(F.coalesce(F.sum(F.when(test & (F.col("action") == what), F.col("n"))), F.lit(0)) / F.sum(F.when(test, F.col("n"))), 6)
    rates = {f"{cls.lower()}_{a.lower()}_rate": rate(F.col("state") == cls, a) for cls in COSTS for a in ACTIONS}
    rates |= {"review_rate": rate(F.lit(True), "REVIEW"), "block_rate": rate(F.lit(True), "BLOCK")}
    return cells.agg(F.round(F.lit(target) * mean(bad) + F.lit(1 - target) * mean(~bad), 6).alias("expected_cost"), F.round(share, 6).alias("observed_share"), *[c.alias(n) for n, c in rates.items()])


def targets(decision: Column, state: Column) -> dict[str, Column]:
    """Class indexes that a policy sets as training targets."""
    index = lambda names, c: F.try_element_at(F.create_map(*[F.lit(x) for k, n in enumerate(names) for x in (n, k)]), c)
    return {"risk_target": index(RISKS, decision.risk), "action_target": index(ACTIONS, decision.action), "threat_target": index(THREATS, state), "provenance": F.lit("POLICY_SUPERVISED")}


def guardrail_report(df: DataFrame, action: str = "action") -> DataFrame:
    """One row: rows, forced blocks, and how many of them the action alone would not have blocked."""
    known = flag("known_malicious")
    return df.agg(F.count(F.lit(1)).alias("rows"), F.count_if(known).alias("forced"), F.count_if(known & (F.col(action) != "BLOCK")).alias("overrides"))


def counterfactuals(decide: Callable[[Column], Column], df: DataFrame, evidence: Column) -> DataFrame:
    """Rows that break an invariant, with the names of those they break (violations).

    Each row is decided anew with its intelligence and whitelist forced:
    known_malicious_guardrail: confirmed evidence must block;
    whitelist_risk: a whitelist without confirmed evidence must not raise the risk;
    whitelist_override: with both, the whitelist must undo neither the block nor the danger;
    unknown_not_safe: intelligence that is unavailable must not lower the risk below that of a clean answer.
    """
    hits = [n for n in ("urlhaus_hit", "threatfox_hit") if f"available__{n}" in df.columns]

    def forced(rows: DataFrame, known: float | None, white: bool, out: str) -> DataFrame:
        lookups = {"feature__known_malicious": F.lit(known or 0.0), "available__known_malicious": F.lit(known is not None)}
        for n in hits:
            lookups |= {f"feature__{n}": F.lit(0.0), f"available__{n}": F.lit(known is not None)}
        return rows.withColumns(lookups | {"feature__whitelist_hit": F.lit(float(white)), "available__whitelist_hit": F.lit(white)}).withColumn(out, decide(evidence))

    rows = df.select(F.struct("*").alias("_row"), "*")
    for out, known, white in (("_clean", 0.0, False), ("_known", 1.0, False), ("_white", 0.0, True), ("_both", 1.0, True), ("_unknown", None, False)):
        rows = forced(rows, known, white, out)
    risk = lambda name: F.array_position(F.array(*map(F.lit, RISKS)), F.col(f"{name}.risk"))
    broken = {
        "known_malicious_guardrail": F.col("_known.action") != "BLOCK",
        "whitelist_risk": risk("_white") > risk("_clean"),
        "whitelist_override": (F.col("_both.action") != "BLOCK") | (F.col("_both.risk") != "DANGEROUS"),
        "unknown_not_safe": risk("_unknown") < risk("_clean"),
    }
    names = F.array_compact(F.array(*[F.when(test, F.lit(name)) for name, test in broken.items()]))
    return rows.select("_row.*", names.alias("violations")).where(F.size("violations") > 0)


# The fields of a golden decision.
GOLDEN = ("input", "expectedAction", "expectedRisk", "expectedReasonCode", "brandDetected", "brandOfficialDomain", "brandDomainMismatch", "brandRiskScore", "shortenerDetected", "redirectStatus")


def golden_fixtures(df: DataFrame, url: str = "url") -> DataFrame:
    """What the second policy decides for rows with decision features and brand and shortener structs, as fixtures."""
    decision = decide_v2(evidence_count(set(df.columns)))
    values = (
        F.col(url), decision.action, decision.risk, decision.reason, F.col("brand.detected"), F.col("brand.official_domain"), F.col("brand.domain_mismatch"),
        F.round("brand.risk_score", 6), F.col("shortener.detected"), F.lit("NOT_OBSERVED"),
    )
    return df.select(*[v.alias(n) for n, v in zip(GOLDEN, values)])


def golden_counts(fixtures: DataFrame) -> DataFrame:
    """(kind, value, n): fixtures by action and by reason."""
    found = fixtures.groupingSets([["expectedAction"], ["expectedReasonCode"]], "expectedAction", "expectedReasonCode").agg(F.count(F.lit(1)).alias("n"))
    kind = F.when(F.col("expectedReasonCode").isNull(), "action").otherwise("reason")
    return found.select(kind.alias("kind"), F.coalesce("expectedAction", "expectedReasonCode").alias("value"), "n")
