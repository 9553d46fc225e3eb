"""Queries of sampling, splitting, intelligence lookups, decisions, metrics, calibration and integrity."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import features, urls
from ..functions.constants import DECISION_FEATURES, THRESHOLD_GRID
from ..operators import calibration, integrity, intel, joins, metrics, policy, sampling, seals
from . import adapters as A
from .registry import query

HASHED = "sha256('42|' || {0})"


def _take(source: str, part: str, key: str, limit: str, keep: str) -> str:
    return f"SELECT {keep} FROM (SELECT *, row_number() OVER (PARTITION BY {part} ORDER BY {HASHED.format(key)}, {key}) AS r FROM {source}) WHERE r <= {limit}"


@query("smp_per_class", _take("v_urls", "label", "ord", "20", "ord, label"))
def smp_per_class(spark, sf):
    return sampling.sample_per_class(A.urls(spark, sf), 20).select("ord", "label")


@query("smp_source_cap", "SELECT ord, source FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY sha256('42|' || ord), ord) AS r FROM v_urls) WHERE r <= 20 OR source NOT IN ('tranco', 'cert_polska', 'phishing_database')")
def smp_source_cap(spark, sf):
    return sampling.preselect_sources(A.urls(spark, sf), 10).select("ord", "source")


@query("smp_capped_source", """
WITH c AS (SELECT source, count(*) AS n FROM v_urls WHERE label = 'PHISHING' GROUP BY 1),
q AS (SELECT source, greatest(0, least(least(n, 15), 30 - coalesce(sum(least(n, 15)) OVER (ORDER BY source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))) AS quota FROM c),
r AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY sha256('42|' || ord), ord) AS r FROM v_urls WHERE label = 'PHISHING')
SELECT ord, source FROM r JOIN q USING (source) WHERE r <= quota""")
def smp_capped_source(spark, sf):
    return sampling.capped_source_sample(A.urls(spark, sf), "PHISHING", 30).select("ord", "source")


def _ip_hosts(spark, sf):
    host = F.when(F.col("ord") % 2 == 0, F.concat(F.lit("192.0.2."), (F.col("ord") % 200).cast("string"))).otherwise("a.example")
    return A.urls(spark, sf).withColumn("hostname", host)


_ARTIFACT = """
SELECT ord, label FROM v_urls WHERE label <> 'MALWARE' OR ord % 2 = 1
UNION ALL SELECT ord, label FROM (SELECT *, row_number() OVER (ORDER BY sha256('42|' || ord), ord) AS r FROM v_urls WHERE label = 'MALWARE' AND ord % 2 = 0)
WHERE r <= (SELECT count(*) FROM v_urls WHERE label = 'MALWARE' AND ord % 2 = 1)"""


@query("smp_artifact_ctrl", _ARTIFACT)
def smp_artifact_ctrl(spark, sf):
    return sampling.artifact_controlled(_ip_hosts(spark, sf)).select("ord", "label")


@query("smp_regime", f"WITH a AS ({_ARTIFACT}), v_dummy AS (SELECT 1) " + _take("a", "label", "ord", "25", "ord, label") + " AND EXISTS (SELECT 1 FROM v_urls)")
def smp_regime(spark, sf):
    return sampling.regime(_ip_hosts(spark, sf), "artifact_controlled", 25).select("ord", "label")


def _split(spark, sf):
    """Events with a cheap split by user for the split checks."""
    split = F.when(F.col("user_id") % 10 < 7, "train").when(F.col("user_id") % 10 == 7, "validation").otherwise("test")
    return A.snapshots(spark, sf).withColumns({"split": split, "source": F.concat(F.lit("s"), (F.col("ord") % 3).cast("string"))})


@query("smp_holdout", "SELECT split, 's' || (ord % 3) AS source, count(*) AS n FROM (SELECT *, CASE WHEN user_id % 10 < 7 THEN 'train' WHEN user_id % 10 = 7 THEN 'validation' ELSE 'test' END AS split FROM v_snap) WHERE split = 'test' OR ord % 3 <> 1 GROUP BY 1, 2")
def smp_holdout(spark, sf):
    return sampling.source_holdout(_split(spark, sf), "s1").groupBy("split", "source").agg(F.count(F.lit(1)).alias("n"))


_SPLIT_SQL = """
WITH g AS (SELECT DISTINCT user_id FROM v_snap),
c AS (SELECT a.attempt, user_id, row_number() OVER (PARTITION BY attempt ORDER BY sha256((attempt + 42) || '|' || user_id), user_id) AS r, count(*) OVER (PARTITION BY attempt) AS n FROM g, (SELECT unnest(range(64)) AS attempt) a),
h AS (SELECT *, ceil(n * 0.3::DOUBLE - 1e-9) AS held FROM c),
s AS (SELECT attempt, user_id, CASE WHEN r <= ceil(held * 0.5::DOUBLE - 1e-9) THEN 'test' WHEN r <= held THEN 'validation' ELSE 'train' END AS split FROM h),
k AS (SELECT user_id, label, count(*) AS n FROM v_snap GROUP BY 1, 2),
t AS (SELECT sum(n) AS total FROM k), w AS (SELECT label, sum(n) AS whole FROM k GROUP BY 1),
f AS (SELECT a.attempt, p.split, w.label, w.whole FROM (SELECT DISTINCT attempt FROM s) a, (SELECT unnest(['train', 'validation', 'test']) AS split) p, w),
x AS (SELECT attempt, split, label, sum(n) AS n FROM s JOIN k USING (user_id) GROUP BY 1, 2, 3),
y AS (SELECT f.*, coalesce(x.n, 0) AS n, sum(coalesce(x.n, 0)) OVER (PARTITION BY f.attempt, f.split) AS part FROM f LEFT JOIN x USING (attempt, split, label)),
z AS (SELECT attempt, split, abs(any_value(part) / any_value(t.total)::DOUBLE - CASE split WHEN 'train' THEN 0.7 ELSE 0.15 END) + sum(abs(CASE WHEN part > 0 THEN n / part::DOUBLE ELSE 0 END - whole / t.total::DOUBLE)) + 5 * count(*) FILTER (n = 0) AS sc FROM y, t GROUP BY 1, 2),
v AS (SELECT attempt, round(sum(sc)::DOUBLE, 9) AS score FROM z GROUP BY 1)
"""


@query("spl_score", _SPLIT_SQL + "SELECT CAST(attempt AS INTEGER) AS attempt, round(score, 6) AS score FROM v")
def spl_score(spark, sf):
    return sampling.split_scores(A.snapshots(spark, sf), "user_id").select("attempt", F.round("score", 6).alias("score"))


@query("spl_group", _SPLIT_SQL + "SELECT user_id, split FROM s WHERE attempt = (SELECT attempt FROM v ORDER BY score, attempt LIMIT 1)")
def spl_group(spark, sf):
    return sampling.group_split(A.snapshots(spark, sf), "user_id")


@query("spl_shared", _SPLIT_SQL + ", b AS (SELECT user_id, split FROM s WHERE attempt = (SELECT attempt FROM v ORDER BY score, attempt LIMIT 1)) SELECT label, split, count(*) AS n FROM v_snap JOIN b USING (user_id) WHERE label <> 'view' GROUP BY 1, 2")
def spl_shared(spark, sf):
    rows = A.snapshots(spark, sf)
    view = rows.where("label <> 'view'")
    return sampling.with_split(view, sampling.group_split(rows, "user_id"), "user_id").groupBy("label", "split").agg(F.count(F.lit(1)).alias("n"))


@query("spl_leak", "SELECT user_id FROM v_snap WHERE user_id % 10 = 3 GROUP BY 1 HAVING count(*) FILTER (ord % 2 = 0) > 0 AND count(*) FILTER (ord % 2 = 1) > 0")
def spl_leak(spark, sf):
    rows = _split(spark, sf).withColumn("split", F.when((F.col("user_id") % 10 == 3) & (F.col("ord") % 2 == 0), "test").otherwise(F.col("split")))
    return sampling.leaking_groups(rows, "user_id")


@query("spl_temporal", "WITH d AS (SELECT max(snapshot_date) AS last FROM v_snap) SELECT CASE WHEN snapshot_date = last THEN 'test' ELSE 'train' END AS split, count(*) AS n FROM v_snap, d GROUP BY 1")
def spl_temporal(spark, sf):
    return sampling.temporal_split(A.snapshots(spark, sf), "snapshot_date").groupBy("split").agg(F.count(F.lit(1)).alias("n"))


@query("spl_temporal_contract", "SELECT count(DISTINCT snapshot_date) AS dates, min(snapshot_date) AS first_date, max(snapshot_date) AS test_date, 'READY' AS status FROM v_snap")
def spl_temporal_contract(spark, sf):
    return sampling.temporal_contract(A.snapshots(spark, sf), "snapshot_date")


@query("spl_rows_per_date", "SELECT snapshot_date AS date, count(*) AS n FROM v_snap GROUP BY 1")
def spl_rows_per_date(spark, sf):
    return sampling.rows_per_date(A.snapshots(spark, sf), "snapshot_date")


@query("spl_kfold", "SELECT user_id, CAST((row_number() OVER (ORDER BY sha256('42|' || user_id), user_id) - 1) % 5 AS INTEGER) AS fold FROM (SELECT DISTINCT user_id FROM v_snap)")
def spl_kfold(spark, sf):
    return sampling.group_folds(A.snapshots(spark, sf), "user_id", 5)


@query("spl_kfold_check", "SELECT count(*) AS rows, count(*) AS held_out_once, CAST(0 AS BIGINT) AS crossing_groups FROM v_snap")
def spl_kfold_check(spark, sf):
    rows = A.snapshots(spark, sf)
    return sampling.fold_check(rows, sampling.group_folds(rows, "user_id", 5), "user_id")


@query("indicator_digest", "SELECT DISTINCT sha256(indicator) AS digest FROM v_feed")
def indicator_digest(spark, sf):
    return A.digests(A.feed(spark, sf))


@query("ti_index", "SELECT provider, indicator, timestamp FROM v_feed")
def ti_index(spark, sf):
    return intel.build_index(A.feed(spark, sf))


_HOST_STATUS = "SELECT h.ord, CASE WHEN t.indicator IS NULL THEN 'UNKNOWN' ELSE 'KNOWN_MALICIOUS' END AS status, CASE WHEN t.indicator IS NULL THEN 'NONE' ELSE 'DOMAIN_MATCH' END AS confidence, t.timestamp FROM v_hosts h LEFT JOIN v_ti t ON t.indicator = h.hostname AND t.provider = '{0}'"


@query("ti_lookup", _HOST_STATUS.format("urlhaus"))
def ti_lookup(spark, sf):
    rows = intel.lookup(A.hosts(spark, sf), intel.build_index(A.intel(spark, sf)), "hostname", "urlhaus")
    return rows.select("ord", "ti.status", "ti.confidence", "ti.timestamp")


@query("ti_lookup_url", _HOST_STATUS.format("threatfox"))
def ti_lookup_url(spark, sf):
    rows = intel.lookup_url(A.hosts(spark, sf), intel.build_index(A.intel(spark, sf)), "hostname", "registrable_domain", "threatfox")
    return rows.select("ord", "ti.status", "ti.confidence", "ti.timestamp")


@query("ti_merge", "SELECT h.ord, CASE WHEN t.indicator IS NULL THEN 'UNAVAILABLE' ELSE 'KNOWN_MALICIOUS' END AS status, CASE WHEN t.indicator IS NULL THEN 'offline' ELSE t.provider END AS providers FROM v_hosts h LEFT JOIN v_ti t ON t.indicator = h.hostname")
def ti_merge(spark, sf):
    index = intel.build_index(A.intel(spark, sf))
    rows = intel.lookup(A.hosts(spark, sf), index, "hostname", "urlhaus", out="a")
    rows = intel.lookup(rows, None, "hostname", "offline", out="b")
    rows = intel.lookup(rows, index, "hostname", "threatfox", out="c")
    return rows.select("ord", intel.merge(["a", "b", "c"]).alias("m")).select("ord", "m.status", F.array_join("m.providers", ",").alias("providers"))


@query("ti_digest", "SELECT ord, hostname IN (SELECT indicator FROM v_ti) AS known_malicious FROM v_hosts")
def ti_digest(spark, sf):
    return intel.contains(A.hosts(spark, sf), A.digests(A.intel(spark, sf)), "hostname", "registrable_domain").select("ord", "known_malicious")


@query("ti_freeze", "SELECT count(*) AS indicators, sha256(coalesce(string_agg(d, chr(10) ORDER BY d), '')) AS digest FROM (SELECT DISTINCT sha256(indicator) AS d FROM v_feed)")
def ti_freeze(spark, sf):
    return intel.snapshot_digest(A.digests(A.feed(spark, sf)))


@query("ti_overlap", """
WITH x AS (SELECT label, source, 'DOMAIN' AS host_type, CAST(hostname IN (SELECT indicator FROM v_ti) AS INTEGER) AS hit FROM v_hosts)
SELECT CASE WHEN grouping(label) = 0 THEN 'label' WHEN grouping(source) = 0 THEN 'source' ELSE 'host_type' END AS dimension, coalesce(label, source, host_type) AS value, count(*) AS n, CAST(sum(hit) AS BIGINT) AS hits, round(sum(hit) / count(*)::DOUBLE, 6) AS rate
FROM x GROUP BY GROUPING SETS ((label), (source), (host_type))""")
def ti_overlap(spark, sf):
    return intel.overlap_audit(intel.contains(A.hosts(spark, sf), A.digests(A.intel(spark, sf)), "hostname", "registrable_domain"))


_BRAND = {0: ("paypal", True), 1: ("google", True), 2: ("google@registrable_domain", 0.85), 3: ("paypal@registrable_domain!", 0.95), 4: ("microsoft@registrable_domain!", 0.95), 7: ("apple@subdomain", 0.7)}
_N = "page_id % 3 = 0"


@query("brand_official", "SELECT page_id AS ord, CASE page_id % 10 WHEN 0 THEN 'paypal' WHEN 1 THEN 'google' END AS brand FROM pages")
def brand_official(spark, sf):
    return A.branded(spark, sf).select("ord", intel.official_brand(F.col("hostname"), F.col("registrable_domain")).alias("brand"))


@query("brand_assess", f"""
SELECT page_id AS ord, page_id % 10 IN (0, 1, 2, 3, 4, 7) OR {_N} AS detected, page_id % 10 IN (0, 1) AS official_domain, page_id % 10 IN (2, 3, 4, 7) AS domain_mismatch,
  round(CASE page_id % 10 WHEN 0 THEN 0 WHEN 1 THEN 0 WHEN 2 THEN 0.85 WHEN 3 THEN 0.95 WHEN 4 THEN 0.95 WHEN 7 THEN 0.7 ELSE CASE WHEN {_N} THEN 0.35 ELSE 0 END END::DOUBLE, 6) AS risk_score,
  CASE page_id % 10 WHEN 0 THEN 'paypal@registrable_domain' WHEN 1 THEN 'google@registrable_domain' ELSE concat_ws(',', CASE page_id % 10 WHEN 2 THEN 'google@registrable_domain' WHEN 3 THEN 'paypal@registrable_domain!' WHEN 4 THEN 'microsoft@registrable_domain!' WHEN 7 THEN 'apple@subdomain' END, CASE WHEN {_N} THEN 'netflix@path' END) END AS matches
FROM pages""")
def brand_assess(spark, sf):
    rows = intel.brand_assessment(A.branded(spark, sf))
    return rows.select("ord", "brand.detected", "brand.official_domain", "brand.domain_mismatch", F.round("brand.risk_score", 6).alias("risk_score"), intel.brand_text(F.col("brand")).alias("matches"))


@query("short_assess", "SELECT page_id AS ord, page_id % 10 IN (5, 6) AS detected, CASE WHEN page_id % 10 IN (5, 6) THEN 'bit.ly' END AS domain FROM pages")
def short_assess(spark, sf):
    rows = A.branded(spark, sf).withColumn("s", intel.shortener(F.col("hostname"), F.col("registrable_domain")))
    return rows.select("ord", "s.detected", "s.domain")


@query("redir_resolve", "SELECT ord, CASE WHEN f IS NULL THEN 'NOT_OBSERVED' ELSE 'OBSERVED' END AS status, f AS count FROM (SELECT ord, (SELECT min(o.ord) % 4 FROM v_hosts o WHERE o.normalized_url = h.normalized_url AND o.ord % 5 = 0) AS f FROM v_hosts h)")
def redir_resolve(spark, sf):
    rows = A.hosts(spark, sf)
    seen = rows.where("ord % 5 = 0").groupBy("normalized_url").agg((F.min("ord") % 4).alias("count"), F.lit(True).alias("cross_domain"), F.lit("x").alias("final_url"))
    return intel.resolve_redirects(rows, seen).select("ord", "redirect.status", "redirect.count")


@query("prob_lookup", "SELECT h.ord, coalesce(t.p, 0.5) AS phishing_probability, CASE WHEN t.p IS NULL THEN 'unavailable_not_in_dataset' ELSE 'dataset' END AS probability_source FROM v_hosts h LEFT JOIN (SELECT hostname, round(min_by((ord % 7) / 7::DOUBLE, ord), 6) AS p FROM v_hosts WHERE ord % 6 = 0 GROUP BY 1) t USING (hostname)")
def prob_lookup(spark, sf):
    rows = A.hosts(spark, sf)
    p = F.round((F.col("ord") % 7) / 7, 6)
    table = rows.where("ord % 6 = 0").select("hostname", "ord", p.alias("phishing_probability"), (1 - p).alias("benign_probability"))
    return intel.probability_lookup(rows, table, "hostname").select("ord", "phishing_probability", "probability_source")


_V1 = "CASE WHEN known THEN 'BLOCK' WHEN white THEN 'ALLOW' WHEN p >= {1} AND ev >= 1 THEN 'BLOCK' WHEN p >= {0} THEN 'REVIEW' ELSE 'ALLOW' END"
_SCORE = "brand_score"
_V2 = f"""CASE WHEN known THEN 'BLOCK KNOWN_MALICIOUS_GUARDRAIL' WHEN white THEN 'ALLOW WHITELIST_ALLOW' WHEN brand AND NOT mismatch AND {_SCORE} <= 0 AND NOT redirect THEN 'ALLOW OFFICIAL_BRAND_DOMAIN_ALLOW'
 WHEN mismatch AND p >= 0.85 THEN 'BLOCK BRAND_IMPERSONATION_BLOCK' WHEN mismatch AND (p >= 0.35 OR {_SCORE} >= 0.5) THEN 'REVIEW BRAND_IMPERSONATION_REVIEW' WHEN p >= 0.85 AND ev >= 1 THEN 'BLOCK HIGH_PROBABILITY_WITH_EVIDENCE'
 WHEN short THEN 'REVIEW SHORTENER_REVIEW' WHEN redirect THEN 'REVIEW CROSS_DOMAIN_REDIRECT_REVIEW' WHEN p >= 0.35 THEN 'REVIEW ELEVATED_PROBABILITY' ELSE 'ALLOW LOW_RISK' END"""


def _evidence(df):
    return policy.evidence_count(set(df.columns))


@query("pol_evidence", "SELECT ev AS evidence, count(*) AS n FROM v_dec GROUP BY 1")
def pol_evidence(spark, sf):
    df = A.decisions(spark, sf)
    return df.groupBy(_evidence(df).alias("evidence")).agg(F.count(F.lit(1)).alias("n"))


@query("pol_v1", f"SELECT {_V1.format('0.3', '0.7')} AS action, true_state, count(*) AS n FROM v_dec GROUP BY 1, 2")
def pol_v1(spark, sf):
    df = A.decisions(spark, sf)
    return df.groupBy(policy.decide_v1(_evidence(df)).action.alias("action"), "true_state").agg(F.count(F.lit(1)).alias("n"))


@query("pol_v2", f"SELECT {_V2} AS decision, count(*) AS n FROM v_dec GROUP BY 1")
def pol_v2(spark, sf):
    df = A.decisions(spark, sf)
    d = policy.decide_v2(_evidence(df))
    return df.groupBy(F.concat_ws(" ", d.action, d.reason).alias("decision")).agg(F.count(F.lit(1)).alias("n"))


_COST = "CASE true_state || ' ' || a WHEN 'BENIGN REVIEW' THEN 1 WHEN 'BENIGN BLOCK' THEN 20 WHEN 'PHISHING ALLOW' THEN 100 WHEN 'PHISHING REVIEW' THEN 10 WHEN 'KNOWN_MALWARE ALLOW' THEN 500 WHEN 'KNOWN_MALWARE REVIEW' THEN 25 ELSE 0 END"


def _acted(spark, sf):
    df = A.decisions(spark, sf)
    return df.withColumn("action", policy.decide_v1(_evidence(df), 0.35, 0.85).action)


_ACTED = f"WITH d AS (SELECT *, {_V1.format('0.35', '0.85')} AS a FROM v_dec) "


@query("pol_cost", _ACTED + f"SELECT round(avg({_COST})::DOUBLE, 6) AS expected_cost FROM d")
def pol_cost(spark, sf):
    return policy.expected_cost(_acted(spark, sf)).select(F.round("expected_cost", 6).alias("expected_cost"))


@query("pol_prevalence", "WITH o AS (SELECT avg(CAST(true_state <> 'BENIGN' AS INTEGER)) AS s FROM v_dec) SELECT round(s, 6) AS observed, round(0.02 / s, 6) AS w_malicious, round(0.98 / (1 - s), 6) AS w_benign FROM o")
def pol_prevalence(spark, sf):
    return policy.prevalence(A.decisions(spark, sf)).select(*[F.round(c, 6).alias(c) for c in ("observed", "w_malicious", "w_benign")])


@query("pol_thresholds", f"""
WITH c AS (SELECT p, ev >= 1 AS ev, known, white, true_state, count(*) AS n FROM v_dec GROUP BY ALL),
o AS (SELECT sum(n) FILTER (true_state <> 'BENIGN') / sum(n)::DOUBLE AS s FROM c),
g AS (SELECT unnest([{', '.join(f'{t!r}::DOUBLE' for t in THRESHOLD_GRID)}]) AS t),
x AS (SELECT g1.t AS review_at, g2.t AS block_at, true_state, n, CASE WHEN true_state = 'BENIGN' THEN 0.98 / (1 - s) ELSE 0.02 / s END AS w,
      CASE WHEN known THEN 'BLOCK' WHEN white THEN 'ALLOW' WHEN p >= g2.t AND ev THEN 'BLOCK' WHEN p >= g1.t THEN 'REVIEW' ELSE 'ALLOW' END AS a FROM c, o, g g1, g g2 WHERE g1.t <= g2.t),
e AS (SELECT review_at, block_at, sum(w * n * {_COST}) / sum(w * n) AS cost FROM x GROUP BY 1, 2)
SELECT review_at, block_at, round(cost, 6) AS expected_cost, (SELECT count(*) FROM e) AS evaluated, 324 AS grid_size FROM e ORDER BY round(cost, 12), 1, 2 LIMIT 1""")
def pol_thresholds(spark, sf):
    df = A.decisions(spark, sf)
    return policy.select_thresholds(df, _evidence(df))


@query("pol_prob_only", "SELECT CASE WHEN p >= 0.85 THEN 'BLOCK' WHEN p >= 0.35 THEN 'REVIEW' ELSE 'ALLOW' END AS action, count(*) AS n FROM v_dec GROUP BY 1")
def pol_prob_only(spark, sf):
    return A.decisions(spark, sf).groupBy(policy.probability_only(0.35, 0.85).alias("action")).agg(F.count(F.lit(1)).alias("n"))


@query("pol_guardrail", "SELECT count(*) AS rows, count(*) FILTER (known) AS forced, count(*) FILTER (known AND p < 0.85) AS overrides FROM v_dec")
def pol_guardrail(spark, sf):
    return policy.guardrail_report(A.decisions(spark, sf).withColumn("action", policy.probability_only(0.35, 0.85)))


@query("pol_guardrail_probe", "SELECT digest FROM (SELECT DISTINCT sha256(indicator) AS digest FROM v_feed) ORDER BY 1 LIMIT 200")
def pol_guardrail_probe(spark, sf):
    """The probe feature: the first 200 digests in order."""
    return A.digests(A.feed(spark, sf)).orderBy("digest").limit(200)


@query("pol_cost_eval", _ACTED + f", m AS (SELECT avg({_COST}) FILTER (true_state <> 'BENIGN') AS bad, avg({_COST}) FILTER (true_state = 'BENIGN') AS good FROM d) SELECT round(0.02 * bad + 0.98 * good, 6) AS expected_cost, (SELECT round(avg(CAST(a = 'REVIEW' AS INTEGER)), 6) FROM d) AS review_rate, (SELECT round(avg(CAST(a = 'BLOCK' AS INTEGER)), 6) FROM d) AS block_rate, (SELECT round(avg(CAST(a = 'BLOCK' AS INTEGER)), 6) FROM d WHERE true_state = 'PHISHING') AS phishing_block_rate FROM m")
def pol_cost_eval(spark, sf):
    return policy.operational(_acted(spark, sf)).select("expected_cost", "review_rate", "block_rate", "phishing_block_rate")


@query("pol_targets", f"SELECT CASE WHEN {_V1.format('0.3', '0.7')} = 'ALLOW' THEN 0 WHEN {_V1.format('0.3', '0.7')} = 'REVIEW' THEN 1 ELSE 2 END AS action_target, CASE true_state WHEN 'BENIGN' THEN 0 WHEN 'PHISHING' THEN 1 ELSE 2 END AS threat_target, count(*) AS n FROM v_dec GROUP BY 1, 2")
def pol_targets(spark, sf):
    df = A.decisions(spark, sf)
    made = policy.targets(policy.decide_v1(_evidence(df)), F.col("true_state"))
    return df.select(made["action_target"].alias("action_target"), made["threat_target"].alias("threat_target")).groupBy("action_target", "threat_target").agg(F.count(F.lit(1)).alias("n"))


@query("pol_counterfactual", "SELECT p FROM v_dec WHERE false")
def pol_counterfactual(spark, sf):
    df = A.decisions(spark, sf)
    return policy.counterfactuals(policy.decide_v2, df, _evidence(df)).select(F.col("feature__phishing_probability").alias("p"))


@query("pol_counterfactual_broken", "SELECT 'known_malicious_guardrail,whitelist_override' AS violations, count(*) AS n FROM v_dec WHERE p < 0.85")
def pol_counterfactual_broken(spark, sf):
    """A policy of thresholds alone breaks the guardrails wherever it does not block."""
    df = A.decisions(spark, sf)
    p = policy.value("phishing_probability")
    risk = F.when(p >= 0.85, "DANGEROUS").when(p >= 0.35, "SUSPICIOUS").otherwise("SAFE")
    found = policy.counterfactuals(lambda _: F.struct(risk.alias("risk"), policy.probability_only(0.35, 0.85).alias("action")), df, _evidence(df))
    return found.groupBy(F.array_join("violations", ",").alias("violations")).agg(F.count(F.lit(1)).alias("n"))


@query("pol_counterfactual_unknown", "SELECT 'whitelist_risk,unknown_not_safe' AS violations, count(*) AS n FROM v_dec")
def pol_counterfactual_unknown(spark, sf):
    """A policy that trusts silence: risk falls without intelligence and rises by a whitelist."""
    df = A.decisions(spark, sf)
    known = policy.flag("known_malicious")
    risk = F.when(known, "DANGEROUS").when(policy.flag("whitelist_hit"), "DANGEROUS").when(policy.available("known_malicious"), "SUSPICIOUS").otherwise("SAFE")
    found = policy.counterfactuals(lambda _: F.struct(risk.alias("risk"), F.when(known, "BLOCK").otherwise("ALLOW").alias("action")), df, _evidence(df))
    return found.groupBy(F.array_join("violations", ",").alias("violations")).agg(F.count(F.lit(1)).alias("n"))


@query("pol_final", "SELECT CASE WHEN known THEN 'BLOCK' WHEN p >= 0.85 THEN 'BLOCK' WHEN p >= 0.35 THEN 'REVIEW' ELSE 'ALLOW' END AS final, count(*) AS n FROM v_dec GROUP BY 1")
def pol_final(spark, sf):
    return A.decisions(spark, sf).groupBy(policy.guardrail(policy.probability_only(0.35, 0.85)).alias("final")).agg(F.count(F.lit(1)).alias("n"))


_C2 = "count(*) FILTER (y = 1 AND predicted = 1) AS tp, count(*) FILTER (y = 0 AND predicted = 0) AS tn, count(*) FILTER (y = 0 AND predicted = 1) AS fp, count(*) FILTER (y = 1 AND predicted = 0) AS fn"
_B2 = "tp, tn, fp, fn, round(tp / (tp + fp)::DOUBLE, 6) AS precision, round(tp / (tp + fn)::DOUBLE, 6) AS recall, round(2 * tp / (2 * tp + fp + fn)::DOUBLE, 6) AS f1, round(tn / (tn + fp)::DOUBLE, 6) AS specificity, round((tp / (tp + fn)::DOUBLE + tn / (tn + fp)::DOUBLE) / 2, 6) AS balanced_accuracy"


def _rounded(df, *names):
    return df.select(*[F.round(c, 6).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes if not names or c in names])


_BINARY = ("tp", "tn", "fp", "fn", "precision", "recall", "f1", "specificity", "balanced_accuracy")


@query("met_binary", f"SELECT {_B2} FROM (SELECT {_C2} FROM v_scored2)")
def met_binary(spark, sf):
    return _rounded(metrics.binary_metrics(A.scored2(spark, sf)), *_BINARY)


@query("met_subgroup", f"SELECT subgroup, {_B2} FROM (SELECT subgroup, {_C2} FROM (SELECT *, unnest(list_filter([CASE WHEN on_ip THEN 'ip_host' ELSE 'non_ip_host' END, 'source_' || source], lambda t: t IS NOT NULL)) AS subgroup FROM v_scored2) GROUP BY 1)")
def met_subgroup(spark, sf):
    tags = {"ip_host": F.col("on_ip"), "non_ip_host": ~F.col("on_ip"), "source_O": F.col("source") == "O", "source_F": F.col("source") == "F"}
    return _rounded(metrics.subgroup_metrics(A.scored2(spark, sf), tags), "subgroup", *_BINARY)


@query("met_auroc", "SELECT round((sum(CASE WHEN y = 1 THEN r END) - p * (p + 1) / 2) / (p * (n - p))::DOUBLE, 6) AS auroc FROM (SELECT y, rank() OVER (ORDER BY score) + (count(*) OVER (PARTITION BY score) - 1) / 2 AS r, sum(y) OVER () AS p, count(*) OVER () AS n FROM v_scored2) GROUP BY p, n")
def met_auroc(spark, sf):
    return metrics.ranking_metrics(A.scored2(spark, sf)).select(F.round("auroc", 6).alias("auroc"))


@query("met_auprc", "WITH c AS (SELECT score, sum(y) AS pos, count(*) AS n FROM v_scored2 GROUP BY 1), r AS (SELECT pos, sum(pos) OVER w AS tp, sum(n) OVER w AS al FROM c WINDOW w AS (ORDER BY score DESC)) SELECT round(sum(pos * tp / al::DOUBLE) / sum(pos), 6) AS auprc FROM r")
def met_auprc(spark, sf):
    return metrics.ranking_metrics(A.scored2(spark, sf)).select(F.round("auprc", 6).alias("auprc"))


_M3 = """
WITH k AS (SELECT unnest([0, 1, 2]) AS c), t AS (SELECT c, count(*) FILTER (y = c AND predicted = c) AS tp, count(*) FILTER (y <> c AND predicted = c) AS fp, count(*) FILTER (y = c AND predicted <> c) AS fn FROM v_scored3, k GROUP BY 1),
m AS (SELECT c, tp, tp + fn AS support, CASE WHEN tp + fp = 0 THEN 0 ELSE tp / (tp + fp)::DOUBLE END AS pr, CASE WHEN tp + fn = 0 THEN 0 ELSE tp / (tp + fn)::DOUBLE END AS re, CASE WHEN 2 * tp + fp + fn = 0 THEN 0 ELSE 2 * tp / (2 * tp + fp + fn)::DOUBLE END AS f1 FROM t)
"""


@query("met_multi", _M3 + """SELECT round(sum(tp) / sum(support)::DOUBLE, 6) AS accuracy, round(avg(pr), 6) AS macro_precision, round(avg(re), 6) AS macro_recall, round(avg(f1), 6) AS macro_f1, round(sum(f1 * support) / sum(support), 6) AS weighted_f1,
 round(1 - sum(re) FILTER (c = 0), 6) AS benign_fpr, CAST(sum(support) AS BIGINT) AS n, (SELECT round(count(*) FILTER (y <> 0 AND predicted = 0) / count(*) FILTER (y <> 0)::DOUBLE, 6) FROM v_scored3) AS malicious_fnr FROM m""")
def met_multi(spark, sf):
    return _rounded(metrics.multiclass_metrics(A.scored3(spark, sf)))


@query("met_head", _M3 + "SELECT c AS cls, round(pr, 6) AS precision, round(re, 6) AS recall, round(f1, 6) AS f1, support FROM m")
def met_head(spark, sf):
    return _rounded(metrics.class_report(A.scored3(spark, sf), 3), "cls", "precision", "recall", "f1", "support")


@query("met_ovr", """
WITH k AS (SELECT unnest([0, 1, 2]) AS c), s AS (SELECT c, CAST(y = c AS INTEGER) AS y, CASE c WHEN 0 THEN p0 WHEN 1 THEN p1 ELSE p2 END AS score FROM v_scored3, k),
r AS (SELECT c, y, rank() OVER (PARTITION BY c ORDER BY score) + (count(*) OVER (PARTITION BY c, score) - 1) / 2 AS r FROM s),
a AS (SELECT c, sum(y) AS p, count(*) AS n, (sum(CASE WHEN y = 1 THEN r END) - sum(y) * (sum(y) + 1) / 2) / (sum(y) * (count(*) - sum(y)))::DOUBLE AS u FROM r GROUP BY 1)
SELECT round(avg(u), 6) AS macro_auroc FROM a""")
def met_ovr(spark, sf):
    return metrics.one_vs_rest(A.scored3(spark, sf)).select(F.round("macro_auroc", 6).alias("macro_auroc"))


@query("met_errors", "WITH c AS (SELECT y, predicted, count(*) AS n, sum(count(*)) OVER (PARTITION BY y) AS tot FROM v_scored3 GROUP BY 1, 2) SELECT ['benign', 'phishing', 'malware'][y + 1] || '_as_' || ['benign', 'phishing', 'malware'][predicted + 1] AS error, n, round(n / tot::DOUBLE, 6) AS rate FROM c WHERE y <> predicted")
def met_errors(spark, sf):
    return _rounded(metrics.error_summary(A.scored3(spark, sf)))


@query("met_source_bias", "SELECT source, y, count(*) AS n, round(avg(CAST(y = predicted AS INTEGER)), 6) AS accuracy, round(avg(CAST(half = 1 AS INTEGER)), 6) AS ip_share, round(avg(own), 6) AS mean_true_probability FROM v_scored3 GROUP BY 1, 2")
def met_source_bias(spark, sf):
    return _rounded(metrics.source_bias(A.scored3(spark, sf), F.col("half") == 1))


@query("cls_weights", "SELECT y AS cls, round(sum(count(*)) OVER () / (3.0::DOUBLE * count(*)), 6) AS weight FROM v_scored3 GROUP BY 1")
def cls_weights(spark, sf):
    return _rounded(metrics.class_weights(A.scored3(spark, sf), 3))


@query("imp_gain_topk", "WITH g AS (SELECT source AS name, count(*)::DOUBLE AS gain FROM documents WHERE source IS NOT NULL GROUP BY 1), t AS (SELECT sum(gain) AS s FROM g) SELECT name, gain, CAST(row_number() OVER (ORDER BY gain DESC, name) AS INTEGER) AS rank, round(gain / s, 6) AS share FROM g, t ORDER BY gain DESC, name LIMIT 20")
def imp_gain_topk(spark, sf):
    gains = A.read(spark, sf, "documents").where("source is not null").groupBy(F.col("source").alias("name")).agg(F.count(F.lit(1)).cast("double").alias("gain"))
    return _rounded(metrics.top_share(gains, "name", "gain"))


@query("lat_percentiles", "SELECT event_type, round(avg(value), 6) AS mean, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.95), 6) AS p95, min(value) AS min, max(value) AS max FROM events GROUP BY 1")
def lat_percentiles(spark, sf):
    return _rounded(metrics.latency_summary(A.read(spark, sf, "events"), "value", ["event_type"]))


@query("feat_token_stats", "SELECT quantile_cont(n, 0.5) AS p50, round(quantile_cont(n, 0.9), 6) AS p90, round(quantile_cont(n, 0.95), 6) AS p95, round(quantile_cont(n, 0.99), 6) AS p99, max(n) AS max, round(avg(n), 6) AS mean FROM (SELECT len(string_split(text, ' '))::BIGINT AS n FROM documents WHERE text IS NOT NULL)")
def feat_token_stats(spark, sf):
    rows = A.read(spark, sf, "documents").where("text is not null").select(F.size(F.split("text", " ", -1)).cast("long").alias("n"))
    return _rounded(metrics.token_statistics(rows, "n"))


@query("mdl_parity", "SELECT 0.0::DOUBLE AS max_abs_error, 0.0::DOUBLE AS mean_abs_error, 1.0::DOUBLE AS agreement FROM v_scored3 LIMIT 1")
def mdl_parity(spark, sf):
    left = A.scored3(spark, sf)
    right = left.withColumn("p", calibration.apply_temperature(F.col("p"), 1.0))
    return metrics.parity(left, right).select(*[F.round(c, 9).alias(c) for c in ("max_abs_error", "mean_abs_error", "agreement")])


@query("mdl_parity_scaled", """
WITH q AS (SELECT id, p0, p1, p2, sqrt(p0) AS a, sqrt(p1) AS b, sqrt(p2) AS c FROM v_scored3),
g AS (SELECT abs(p0 - a / (a + b + c)) AS g0, abs(p1 - b / (a + b + c)) AS g1, abs(p2 - c / (a + b + c)) AS g2 FROM q)
SELECT round(max(greatest(g0, g1, g2)), 6) AS max_abs_error, round(avg((g0 + g1 + g2) / 3), 6) AS mean_abs_error, 1.0::DOUBLE AS agreement FROM g""")
def mdl_parity_scaled(spark, sf):
    """Parity of a model with itself at temperature 2: other probabilities, the same likeliest class."""
    left = A.scored3(spark, sf)
    right = left.withColumn("p", calibration.apply_temperature(F.col("p"), 2.0))
    return _rounded(metrics.parity(left, right))


_T3 = "SELECT id, y, pow(p0, 1 / 2.0::DOUBLE) AS a, pow(p1, 1 / 2.0::DOUBLE) AS b, pow(p2, 1 / 2.0::DOUBLE) AS c FROM v_scored3"


@query("cal_temperature", f"SELECT id, round(a / (a + b + c), 6) AS q0, round(b / (a + b + c), 6) AS q1, round(c / (a + b + c), 6) AS q2 FROM ({_T3})")
def cal_temperature(spark, sf):
    q = calibration.apply_temperature(F.col("p"), 2.0)
    return A.scored3(spark, sf).select("id", q.alias("q")).select("id", *[F.round(F.get("q", F.lit(k)), 6).alias(f"q{k}") for k in range(3)])


@query("cal_nll", "SELECT round(avg(-ln(least(greatest(own, 1e-12), 1))), 6) AS nll FROM v_scored3")
def cal_nll(spark, sf):
    return calibration.losses(A.scored3(spark, sf)).select(F.round("nll", 6).alias("nll"))


@query("cal_brier", "SELECT round(avg(pow(p0 - CAST(y = 0 AS INTEGER), 2) + pow(p1 - CAST(y = 1 AS INTEGER), 2) + pow(p2 - CAST(y = 2 AS INTEGER), 2)), 6) AS brier FROM v_scored3")
def cal_brier(spark, sf):
    return calibration.losses(A.scored3(spark, sf)).select(F.round("brier", 6).alias("brier"))


_REL = f"WITH b AS (SELECT list_count(list_filter([{', '.join(f'CASE WHEN conf > {k} / 15::DOUBLE THEN 1 END' for k in range(1, 15))}], lambda x: x IS NOT NULL)) AS bin, conf, CAST(predicted = y AS INTEGER) AS hit FROM v_scored3), r AS (SELECT bin, count(*) AS n, avg(conf) AS confidence, avg(hit) AS accuracy FROM b GROUP BY 1)"


@query("cal_reliability", _REL + "SELECT CAST(k AS INTEGER) AS bin, coalesce(n, 0) AS n, round(confidence, 6) AS confidence, round(accuracy, 6) AS accuracy FROM (SELECT unnest(range(15)) AS k) LEFT JOIN r ON r.bin = k")
def cal_reliability(spark, sf):
    return _rounded(calibration.reliability(A.scored3(spark, sf)).drop("low", "high"))


@query("cal_ece", _REL + "SELECT round(sum(n * abs(accuracy - confidence)) / sum(n), 6) AS ece FROM r")
def cal_ece(spark, sf):
    return _rounded(calibration.ece(A.scored3(spark, sf)))


@query("cal_fit", """
WITH g AS (SELECT unnest(list_concat([k / 20::DOUBLE for k in range(1, 101)], [5 + k / 4::DOUBLE for k in range(1, 41)])) AS t),
l AS (SELECT y, ln(p0) AS a, ln(p1) AS b, ln(p2) AS c, ln(own) AS o FROM v_scored3),
n AS (SELECT t, avg(ln(exp(a / t) + exp(b / t) + exp(c / t)) - o / t) AS nll FROM l, g GROUP BY 1)
SELECT t AS temperature, round(nll, 6) AS nll FROM n ORDER BY round(nll, 12), t LIMIT 1""")
def cal_fit(spark, sf):
    return calibration.fit_temperature(A.scored3(spark, sf)).select("temperature", F.round("nll", 6).alias("nll"))


_THRESHOLDS = (0.1, 0.3, 0.5, 0.7, 0.9)


@query("cal_thresholds", f"""
WITH g AS (SELECT unnest([{', '.join(f'{t}::DOUBLE' for t in _THRESHOLDS)}]) AS threshold),
c AS (SELECT threshold, count(*) FILTER (score >= threshold AND y = 1) AS tp, count(*) FILTER (score >= threshold AND y = 0) AS fp, count(*) FILTER (score < threshold AND y = 1) AS fn, count(*) FILTER (score < threshold AND y = 0) AS tn FROM v_scored2, g GROUP BY 1)
SELECT threshold, tp, fp, fn, tn, round(tp / (tp + fn)::DOUBLE, 6) AS tpr, round(fp / (fp + tn)::DOUBLE, 6) AS fpr, round(fn / (tp + fn)::DOUBLE, 6) AS fnr, round(CASE WHEN tp + fp = 0 THEN 0 ELSE tp / (tp + fp)::DOUBLE END, 6) AS precision, round(tp / (tp + fn)::DOUBLE, 6) AS recall, round((tp + fp) / (tp + fp + fn + tn)::DOUBLE, 6) AS flagged_share FROM c""")
def cal_thresholds(spark, sf):
    return _rounded(calibration.threshold_table(A.scored2(spark, sf), F.col("score"), F.col("y") == 1, _THRESHOLDS))


_CALIBRATED = """
WITH g AS (SELECT unnest(list_concat([k / 20::DOUBLE for k in range(1, 101)], [5 + k / 4::DOUBLE for k in range(1, 41)])) AS t),
l AS (SELECT half, y, predicted, [p0, p1, p2] AS p, least(greatest(own, 1e-12), 1) AS own FROM v_scored3),
n AS (SELECT t, round(avg(ln(exp(ln(p[1]) / t) + exp(ln(p[2]) / t) + exp(ln(p[3]) / t)) - ln(own) / t), 12) AS nll FROM l, g WHERE half = 0 GROUP BY 1),
b AS (SELECT t FROM n ORDER BY nll, t LIMIT 1),
s AS (SELECT 'before' AS stage, 1.0::DOUBLE AS t, y, p FROM l WHERE half = 1 UNION ALL
      SELECT 'after', t, y, [pow(p[1], 1 / t) / z, pow(p[2], 1 / t) / z, pow(p[3], 1 / t) / z] FROM (SELECT *, pow(p[1], 1 / t) + pow(p[2], 1 / t) + pow(p[3], 1 / t) AS z FROM l, b WHERE half = 1)),
m AS (SELECT stage, t, y, p, list_max(p) AS conf, CAST(list_position(p, list_max(p)) - 1 = y AS INTEGER) AS hit, least(CAST(ceil(list_max(p) * 15) AS INTEGER), 15) AS bin FROM s),
e AS (SELECT stage, sum(n * abs(acc - conf)) / sum(n) AS ece FROM (SELECT stage, bin, count(*) AS n, avg(hit) AS acc, avg(conf) AS conf FROM m GROUP BY 1, 2) GROUP BY 1),
r AS (SELECT stage, t AS temperature, round(avg(-ln(p[y + 1])), 6) AS nll, round(avg(pow(p[1] - CAST(y = 0 AS INTEGER), 2) + pow(p[2] - CAST(y = 1 AS INTEGER), 2) + pow(p[3] - CAST(y = 2 AS INTEGER), 2)), 6) AS brier FROM m GROUP BY 1, 2)
"""


@query("cal_pipeline", _CALIBRATED + "SELECT stage, temperature, nll, brier, round(ece, 6) AS ece FROM r JOIN e USING (stage)")
def cal_pipeline(spark, sf):
    rows = A.scored3(spark, sf)
    return _rounded(calibration.calibrate(rows.where("half = 0"), rows.where("half = 1")))


@query("cal_select", _CALIBRATED + "SELECT stage AS selected FROM r JOIN e USING (stage) ORDER BY ece, brier, nll, stage DESC LIMIT 1")
def cal_select(spark, sf):
    rows = A.scored3(spark, sf)
    return calibration.select_probabilities(calibration.calibrate(rows.where("half = 0"), rows.where("half = 1")))


def _vector(spark, sf):
    rows = A.hosts(spark, sf).withColumns({"phishing_probability": (F.col("ord") % 101) / 100, "known_malicious": (F.col("ord") % 29 == 0).cast("int"), "urlhaus_hit": (F.col("ord") % 29 == 0).cast("int"), "threatfox_hit": F.lit(0)})
    return features.with_decision_features(features.with_features(rows), F.col("ord") % 3 != 0)


@query("feat_31", "SELECT ord, (ord % 101) / 100::DOUBLE AS phishing_probability, CAST(ord % 29 = 0 AS INTEGER)::DOUBLE AS known_malicious, length(normalized_url)::DOUBLE AS url_length, CAST(scheme = 'https' AS INTEGER)::DOUBLE AS uses_https, CASE WHEN ord % 3 <> 0 THEN 23 ELSE 20 END AS available FROM v_hosts")
def feat_31(spark, sf):
    rows = _vector(spark, sf)
    total = sum((F.col(f"available__{n}").cast("int") for n in DECISION_FEATURES), F.lit(0))
    return rows.select("ord", *[F.col(f"feature__{n}").alias(n) for n in ("phishing_probability", "known_malicious", "url_length", "uses_https")], total.alias("available"))


@query("feat_avail", "SELECT ord % 3 <> 0 AS ti_available, count(*) AS n FROM v_urls GROUP BY 1")
def feat_avail(spark, sf):
    return _vector(spark, sf).groupBy(F.col("available__urlhaus_hit").alias("ti_available")).agg(F.count(F.lit(1)).alias("n"))


@query("feat_v2", "SELECT page_id AS ord, CAST(page_id % 10 IN (2, 3, 4, 7) AS INTEGER)::DOUBLE AS mismatch, CAST(page_id % 10 IN (5, 6) AS INTEGER)::DOUBLE AS shortener, false AS redirect_seen FROM pages")
def feat_v2(spark, sf):
    rows = intel.brand_assessment(A.branded(spark, sf)).withColumn("shortener", intel.shortener(F.col("hostname"), F.col("registrable_domain")))
    rows = rows.withColumn("redirect", F.struct(F.lit("NOT_OBSERVED").alias("status"), F.lit(0).alias("count"), F.lit(False).alias("cross_domain")))
    made = features.with_intel(rows)
    return made.select("ord", F.col("feature__brand_domain_mismatch").alias("mismatch"), F.col("feature__shortener_detected").alias("shortener"), F.col("available__redirect_count").alias("redirect_seen"))


_GOLDEN = """
WITH g AS (SELECT page_id AS ord, page_id % 10 AS k, (page_id % 101) / 100::DOUBLE AS p FROM pages),
d AS (SELECT ord, CASE WHEN k IN (0, 1) THEN 'ALLOW OFFICIAL_BRAND_DOMAIN_ALLOW' WHEN k IN (2, 3, 4, 7) AND p >= 0.85 THEN 'BLOCK BRAND_IMPERSONATION_BLOCK' WHEN k IN (2, 3, 4, 7) THEN 'REVIEW BRAND_IMPERSONATION_REVIEW'
  WHEN k IN (5, 6) THEN 'REVIEW SHORTENER_REVIEW' WHEN p >= 0.35 THEN 'REVIEW ELEVATED_PROBABILITY' ELSE 'ALLOW LOW_RISK' END AS decision, k IN (5, 6) AS short FROM g)
"""


def _golden(spark, sf):
    rows = intel.brand_assessment(A.branded(spark, sf)).withColumn("shortener", intel.shortener(F.col("hostname"), F.col("registrable_domain")))
    rows = rows.withColumns({"redirect": F.struct(F.lit("NOT_OBSERVED").alias("status"), F.lit(0).alias("count"), F.lit(False).alias("cross_domain")), "phishing_probability": (F.col("ord") % 101) / 100, "known_malicious": F.lit(0), "urlhaus_hit": F.lit(0), "threatfox_hit": F.lit(0)})
    made = features.with_intel(features.with_decision_features(features.with_features(rows)))
    return policy.golden_fixtures(made.withColumn("url", F.col("ord")))


@query("int_golden", _GOLDEN + "SELECT ord AS input, split_part(decision, ' ', 1) AS action, split_part(decision, ' ', 2) AS reason, short AS shortener FROM d")
def int_golden(spark, sf):
    return _golden(spark, sf).select("input", F.col("expectedAction").alias("action"), F.col("expectedReasonCode").alias("reason"), F.col("shortenerDetected").alias("shortener"))


@query("int_golden_counts", _GOLDEN + "SELECT 'action' AS kind, split_part(decision, ' ', 1) AS value, count(*) AS n FROM d GROUP BY 2 UNION ALL SELECT 'reason', split_part(decision, ' ', 2), count(*) FROM d GROUP BY 2")
def int_golden_counts(spark, sf):
    return policy.golden_counts(_golden(spark, sf))


@query("feat_zscore", "SELECT round(avg(length(normalized_url)), 6) AS mean_url_length, round(stddev_pop(length(normalized_url)), 6) AS scale_url_length, round(avg(length(hostname)), 6) AS mean_hostname_length, 1.0::DOUBLE AS scale_redirect_count FROM v_hosts")
def feat_zscore(spark, sf):
    return _rounded(features.fit_normalizer(_vector(spark, sf)), "mean_url_length", "scale_url_length", "mean_hostname_length", "scale_redirect_count")


@query("feat_encode62", "WITH z AS (SELECT avg(length(normalized_url)) AS m, stddev_pop(length(normalized_url)) AS s FROM v_hosts) SELECT ord, 62 AS width, round((length(normalized_url) - m) / s, 6) AS url_length, CASE WHEN ord % 3 <> 0 AND ord % 29 = 0 THEN 1.0 ELSE 0.0 END::DOUBLE AS known_malicious FROM v_hosts, z")
def feat_encode62(spark, sf):
    rows = _vector(spark, sf)
    made = features.with_encoded(rows, features.fit_normalizer(rows))
    at = {n: k for k, n in enumerate(DECISION_FEATURES)}
    return made.select("ord", F.size("encoded").alias("width"), F.round(F.get("encoded", F.lit(at["url_length"])), 6).alias("url_length"), F.get("encoded", F.lit(at["known_malicious"])).alias("known_malicious"))


_ROW = "sha256(concat_ws(chr(31), " + ", ".join(f"coalesce('=' || CAST({c} AS VARCHAR), '~')" for c in ("ord", "url", "label", "source", "collected_at")) + "))"
_PARTS = ", ".join(f"CAST(sum(CAST('0x' || substr(d, {4 + 15 * k}, 15) AS BIGINT)) AS VARCHAR)" for k in range(4))


@query("int_manifest", f"""
WITH p AS (SELECT CASE WHEN ord % 2 = 0 THEN 'FULL_URL' ELSE 'DOMAIN_ONLY' END AS dataset_view, {_ROW} AS d FROM v_urls),
l AS (SELECT dataset_view, substr(d, 1, 3) AS p, count(*) AS n, concat_ws(':', substr(d, 1, 3), CAST(count(*) AS VARCHAR), {_PARTS}) AS line FROM p GROUP BY 1, 2)
SELECT dataset_view, CAST(sum(n) AS BIGINT) AS rows, sha256(string_agg(line, chr(10) ORDER BY p)) AS sha256 FROM l GROUP BY 1""")
def int_manifest(spark, sf):
    rows = A.urls(spark, sf).withColumn("dataset_view", F.when(F.col("ord") % 2 == 0, "FULL_URL").otherwise("DOMAIN_ONLY"))
    return integrity.manifest(rows, ["ord", "url", "label", "source", "collected_at"])


@query("int_assign_hash", f"""
WITH p AS (SELECT DISTINCT sha256(CASE WHEN ord % 2 = 0 THEN 'FULL_URL' ELSE 'DOMAIN_ONLY' END || ':' || hostname) AS d FROM v_hosts),
l AS (SELECT substr(d, 1, 3) AS p, count(*) AS n, concat_ws(':', substr(d, 1, 3), CAST(count(*) AS VARCHAR), {_PARTS}) AS line FROM p GROUP BY 1)
SELECT CAST(sum(n) AS BIGINT) AS rows, sha256(string_agg(line, chr(10) ORDER BY p)) AS sha256 FROM l""")
def int_assign_hash(spark, sf):
    rows = A.hosts(spark, sf).withColumn("dataset_view", F.when(F.col("ord") % 2 == 0, "FULL_URL").otherwise("DOMAIN_ONLY"))
    return integrity.assignment_digest(rows, "hostname")


@query("int_contract", "SELECT 'unknown_label' AS violation, count(*) FILTER (label NOT IN ('BENIGN', 'PHISHING')) AS n FROM v_hosts UNION ALL SELECT 'model_url', count(*) FILTER (ord % 10 = 0) FROM v_hosts UNION ALL SELECT 'leaking_group', count(*) FROM (SELECT hostname FROM v_hosts GROUP BY 1 HAVING count(DISTINCT ord % 2) > 1)")
def int_contract(spark, sf):
    url = F.when(F.col("ord") % 10 == 0, "x").otherwise(urls.domain_url(F.col("hostname")))
    rows = A.hosts(spark, sf).withColumns({"model_url": url, "split": F.when(F.col("ord") % 2 == 0, "train").otherwise("test")})
    return integrity.contract_violations(rows, ["BENIGN", "PHISHING"], "hostname")


@query("int_staleness", "SELECT CASE WHEN d < 0 THEN 'UNKNOWN' WHEN d <= 30 THEN 'FRESH' WHEN d <= 180 THEN 'STALE' ELSE 'OUTDATED' END AS staleness, count(*) AS n FROM (SELECT date_diff('day', CAST(o_orderdate AS DATE), DATE '1996-06-30') AS d FROM orders) GROUP BY 1")
def int_staleness(spark, sf):
    return A.read(spark, sf, "orders").groupBy(integrity.staleness(F.date_format("o_orderdate", "yyyy-MM-dd"), F.lit("1996-06-30")).alias("staleness")).agg(F.count(F.lit(1)).alias("n"))


@query("int_history", "SELECT o_orderkey AS snapshot_id, o_custkey, lag(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS previous FROM orders")
def int_history(spark, sf):
    rows = A.read(spark, sf, "orders").select(F.col("o_orderkey").alias("snapshot_id"), "o_custkey", F.col("o_orderdate").alias("seq"))
    return integrity.history_summary(rows, part="o_custkey").select("snapshot_id", "o_custkey", "previous")


@query("int_history_register", "SELECT CAST(ord AS BIGINT) AS snapshot_id, sha256(url) AS sha256 FROM v_urls")
def int_history_register(spark, sf):
    rows = A.urls(spark, sf).select(F.col("ord").alias("snapshot_id"), F.sha2("url", 256).alias("sha256"))
    return integrity.register_history(rows.where("snapshot_id % 2 = 0"), rows.where("snapshot_id % 3 <> 0 or snapshot_id % 6 = 3"))


@query("int_seal_difference", """
SELECT o_orderkey, CASE WHEN o_orderkey % 97 = 0 THEN 'removed' ELSE 'changed' END AS change FROM orders WHERE o_orderkey % 97 = 0 OR o_orderkey % 89 = 0
UNION ALL SELECT -1 - o_orderkey, 'added' FROM orders WHERE o_orderkey % 101 = 0""")
def int_seal_difference(spark, sf):
    """The orders against a later state of them, through their sealed forms."""
    from ..storage import shared_folder

    rows = A.read(spark, sf, "orders")
    later = rows.where("o_orderkey % 97 <> 0").withColumn("o_comment_", F.col("o_orderkey") % 89 == 0)
    later = later.unionByName(rows.where("o_orderkey % 101 = 0").withColumns({"o_orderkey": -1 - F.col("o_orderkey"), "o_comment_": F.lit(False)}))
    folder = shared_folder(spark, "seals")
    old = seals.write_seal(rows.withColumn("o_comment_", F.lit(False)), f"{folder}/old")
    return seals.difference(old, seals.write_seal(later, f"{folder}/new"), "o_orderkey")


@query("int_bundle_build", "SELECT DISTINCT sha256(indicator) AS digest FROM v_feed")
def int_bundle_build(spark, sf):
    bad = spark.createDataFrame([("xyz",)], "digest string")
    return integrity.bundle_digests(A.digests(A.feed(spark, sf)).unionByName(bad))


_REASON = "['ok', 'unsupported_bundle_version', 'missing_payload', 'missing_integrity_block', 'integrity_digest_mismatch', 'missing_payload_sections', 'indicator_count_mismatch', 'catalog_payload_invalid', 'bundle_not_an_object'][CAST(ord % 9 AS INTEGER) + 1]"


@query("int_bundle_verify", f"SELECT ord, ord % 9 = 0 AS ok, {_REASON} AS reason FROM v_urls")
def int_bundle_verify(spark, sf):
    """Bundles of the kinds that verification tells apart, one to a row of the table."""
    whole = integrity.build_bundle(["a" * 64, "b" * 64], "2026-09-01")
    intel_, brand = whole["payload"]["threatIntel"], whole["payload"]["brands"]

    def sealed(**sections) -> dict:
        payload = {k: v for k, v in (whole["payload"] | sections).items() if v is not None}
        return whole | {"payload": payload, "integrity": whole["integrity"] | {"canonicalDigest": integrity.payload_digest(payload)}}

    kinds = [
        whole, whole | {"bundleVersion": 1}, whole | {"payload": []}, whole | {"integrity": {}}, whole | {"payload": whole["payload"] | {"x": 1}},
        sealed(shorteners=None), sealed(threatIntel=intel_ | {"indicatorCount": 7}), sealed(brands=brand | {"entries": {}}), [],
    ]
    texts = F.array(*[F.lit(integrity.canonical_json(k)) for k in kinds])
    rows = A.urls(spark, sf).select("ord", F.get(texts, (F.col("ord") % len(kinds)).cast("int")).alias("bundle"))
    return integrity.verified(rows).select("ord", "ok", "reason")


@query("int_bundle_summary", "SELECT 'ti-bundle-v1' AS version, count(*) AS indicators, 54 AS brands, 26 AS shorteners FROM (SELECT DISTINCT indicator FROM v_feed)")
def int_bundle_summary(spark, sf):
    """A bundle built of the feed's digests, which are a list that a device holds, and what it says of itself."""
    listed = [r.digest for r in integrity.bundle_digests(A.digests(A.feed(spark, sf))).collect()]
    said = integrity.bundle_summary(integrity.build_bundle(listed, "2026-09-01"))
    return spark.createDataFrame([(said["bundleVersion"], said["indicatorCount"], said["brandCount"], said["shortenerCount"])], "version string, indicators long, brands int, shorteners int")


@query("snk_comparison", "SELECT ord AS k, CASE WHEN ord % 4 = 0 OR ord % 5 = 0 THEN 'new' ELSE 'old' END AS v FROM v_urls")
def snk_comparison(spark, sf):
    rows = A.urls(spark, sf)
    old = rows.where("ord % 5 <> 0").select(F.col("ord").alias("k"), F.lit("old").alias("v"))
    return integrity.upsert(old, rows.where("ord % 4 = 0 or ord % 5 = 0").select(F.col("ord").alias("k"), F.lit("new").alias("v")), ["k"])


@query("join_range", """
SELECT k, count(*) AS n, CAST(sum(o_orderkey) AS BIGINT) AS keys FROM (SELECT k * 900.0::DOUBLE AS lo, k * 900.0 + CASE WHEN k % 3 = 0 THEN 400 ELSE 2500 END AS hi, k FROM (SELECT unnest(range(700)) AS k))
JOIN orders ON o_totalprice > lo AND o_totalprice <= hi GROUP BY 1""")
def join_range(spark, sf):
    """Orders by price intervals with gaps and overlaps."""
    k = F.col("id")
    intervals = spark.range(700).select(k.alias("k"), (k * 900.0).alias("lo"), (k * 900.0 + F.when(k % 3 == 0, 400).otherwise(2500)).alias("hi"))
    rows = joins.range_join(A.read(spark, sf, "orders").select("o_orderkey", "o_totalprice"), "o_totalprice", intervals, "lo", "hi", "right")
    return rows.groupBy("k").agg(F.count(F.lit(1)).alias("n"), F.sum("o_orderkey").alias("keys"))


@query("join_positional", """
SELECT a.o_orderkey, b.o_orderkey AS other, a.r - 1 AS row_number FROM (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) AS r FROM orders) a
JOIN (SELECT o_orderkey, row_number() OVER (ORDER BY o_totalprice, o_orderkey) AS r FROM orders) b USING (r)""")
def join_positional(spark, sf):
    """Orders by key beside orders by price."""
    rows = A.read(spark, sf, "orders")
    right = rows.select(F.col("o_orderkey").alias("other"), "o_totalprice")
    return joins.positional_join(rows.select("o_orderkey"), right, ["o_orderkey"], ["o_totalprice", "other"]).select("o_orderkey", "other", "row_number")
