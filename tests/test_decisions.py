import pytest
from pyspark.sql import functions as F

from sievework.functions.constants import DECISION_FEATURES, FEATURES, brands
from sievework.functions.features import validate_vector
from sievework.functions.urls import with_normalized
from sievework.operators import intel, policy

BRANDS = [
    ("https://google.com.attacker.example/", True, False, True, 0.85, "google@registrable_domain"),
    ("https://accounts.google.com/", True, True, False, 0.0, "google@registrable_domain"),
    ("https://google-login.example/", True, False, True, 0.85, "google@registrable_domain"),
    ("https://google.example.com/", True, False, True, 0.7, "google@subdomain"),
    ("https://apple.com.attacker.example/", True, False, True, 0.85, "apple@registrable_domain"),
    ("https://paypa1.example/", True, False, True, 0.95, "paypal@registrable_domain!"),
    ("https://micros0ft.example/", True, False, True, 0.95, "microsoft@registrable_domain!"),
    ("https://gοοgle.com/", True, False, True, 0.95, "google@registrable_domain!"),
    ("https://paypal.com.evil.com/", True, False, True, 0.7, "paypal@subdomain"),
    ("https://example.com/paypal", True, False, False, 0.35, "paypal@path"),
    ("https://example.com/?q=paypal", True, False, False, 0.35, "paypal@path"),
    ("https://example.com/page#paypal", False, False, False, 0.0, ""),
]
SHORT = [("bit.ly", "bit.ly"), ("go.bit.ly", "bit.ly"), ("sub.t.co", "t.co"), ("fake-shortener.example", None), ("bit.ly.attacker.example", None), ("bit-ly.example", None), ("example.com", None), ("youtu.be", None)]


def test_fixed_values():
    assert len(FEATURES) == 43 and len(DECISION_FEATURES) == 31 and len(brands()) == 54


def test_brands(spark):
    df = with_normalized(spark.createDataFrame([(i, b[0]) for i, b in enumerate(BRANDS)], "i int, url string"))
    out = intel.brand_assessment(df).select("i", "brand.*", intel.brand_text(F.col("brand")).alias("t")).collect()
    for r in out:
        assert (r.detected, r.official_domain, r.domain_mismatch, round(r.risk_score, 6), r.t) == BRANDS[r.i][1:], BRANDS[r.i][0]


def test_shorteners(spark):
    df = with_normalized(spark.createDataFrame([(i, f"https://{h}/abc") for i, (h, _) in enumerate(SHORT)], "i int, url string"))
    for r in df.select("i", intel.shortener(F.col("hostname"), F.col("registrable_domain")).alias("s")).collect():
        assert (r.s.domain, r.s.detected) == (SHORT[r.i][1], SHORT[r.i][1] is not None)


def decisions(spark, cases):
    names = ("phishing_probability", "known_malicious", "whitelist_hit", "brand_detected", "brand_domain_mismatch", "brand_risk_score", "shortener_detected", "cross_domain_redirect", "has_ip")
    rows = [(i, *[float(c.get(n, 0.0)) for n in names], *[c.get("off") != n for n in names]) for i, c in enumerate(cases)]
    return spark.createDataFrame(rows, "i int, " + ", ".join(f"feature__{n} double" for n in names) + ", " + ", ".join(f"available__{n} boolean" for n in names))


V2 = [
    ({"known_malicious": 1, "whitelist_hit": 1, "brand_detected": 1}, "BLOCK", "KNOWN_MALICIOUS_GUARDRAIL"),
    ({"whitelist_hit": 1, "phishing_probability": 0.99}, "ALLOW", "WHITELIST_ALLOW"),
    ({"brand_detected": 1, "phishing_probability": 0.1}, "ALLOW", "OFFICIAL_BRAND_DOMAIN_ALLOW"),
    ({"brand_detected": 1, "phishing_probability": 0.99}, "ALLOW", "OFFICIAL_BRAND_DOMAIN_ALLOW"),
    ({"brand_detected": 1, "cross_domain_redirect": 1}, "REVIEW", "CROSS_DOMAIN_REDIRECT_REVIEW"),
    ({"brand_detected": 1, "brand_domain_mismatch": 1, "phishing_probability": 0.85, "brand_risk_score": 0.85}, "BLOCK", "BRAND_IMPERSONATION_BLOCK"),
    ({"brand_detected": 1, "brand_domain_mismatch": 1, "phishing_probability": 0.35, "brand_risk_score": 0.1}, "REVIEW", "BRAND_IMPERSONATION_REVIEW"),
    ({"brand_detected": 1, "brand_domain_mismatch": 1, "phishing_probability": 0.0, "brand_risk_score": 0.5}, "REVIEW", "BRAND_IMPERSONATION_REVIEW"),
    ({"shortener_detected": 1, "phishing_probability": 0.1}, "REVIEW", "SHORTENER_REVIEW"),
    ({"shortener_detected": 1, "phishing_probability": 0.9, "has_ip": 1}, "BLOCK", "HIGH_PROBABILITY_WITH_EVIDENCE"),
    ({"phishing_probability": 0.9, "has_ip": 1, "off": "has_ip"}, "REVIEW", "ELEVATED_PROBABILITY"),
    ({"known_malicious": 1, "off": "known_malicious"}, "ALLOW", "LOW_RISK"),
    ({"cross_domain_redirect": 1, "off": "cross_domain_redirect"}, "ALLOW", "LOW_RISK"),
    ({"phishing_probability": 0.349}, "ALLOW", "LOW_RISK"),
]


def test_policies(spark):
    df = decisions(spark, [c for c, *_ in V2])
    ev = policy.evidence_count(set(df.columns))
    for r in df.select("i", policy.decide_v2(ev).alias("d"), policy.decide_v1(ev).alias("e")).collect():
        assert (r.d.action, r.d.reason) == V2[r.i][1:], V2[r.i]
    v1 = [({"phishing_probability": 0.7, "has_ip": 1}, "BLOCK"), ({"phishing_probability": 0.7}, "REVIEW"), ({"phishing_probability": 0.3}, "REVIEW"), ({"phishing_probability": 0.29, "has_ip": 1}, "ALLOW"), ({"whitelist_hit": 1, "phishing_probability": 1}, "ALLOW"), ({"known_malicious": 1, "whitelist_hit": 1}, "BLOCK")]
    df = decisions(spark, [c for c, _ in v1])
    assert [r.a for r in df.orderBy("i").select(policy.decide_v1(policy.evidence_count(set(df.columns))).action.alias("a")).collect()] == [a for _, a in v1]
    assert policy.counterfactuals(policy.decide_v2, df, ev).count() == 0
    with pytest.raises(ValueError):
        policy.decide_v2(ev, 0.9, 0.1)


def test_counterfactuals_name_each_broken_invariant(spark):
    df = decisions(spark, [c for c, *_ in V2])
    ev = policy.evidence_count(set(df.columns))
    decided = lambda risk, action: F.struct(F.lit(risk).alias("risk"), F.lit(action).alias("action"), F.lit("r").alias("reason"))
    known, white = policy.flag("known_malicious"), policy.flag("whitelist_hit")
    danger, safe, unsure = decided("DANGEROUS", "BLOCK"), decided("SAFE", "ALLOW"), decided("SUSPICIOUS", "REVIEW")
    policies = {
        "known_malicious_guardrail": lambda e: F.when(known & white, danger).otherwise(unsure),
        "whitelist_risk": lambda e: F.when(known | white, danger).otherwise(unsure),
        "whitelist_override": lambda e: F.when(known & white, decided("SUSPICIOUS", "BLOCK")).when(known, danger).otherwise(unsure),
        "unknown_not_safe": lambda e: F.when(known, danger).when(~policy.available("known_malicious"), safe).otherwise(unsure),
    }
    for name, decide in policies.items():
        got = policy.counterfactuals(decide, df, ev)
        assert got.columns == [*df.columns, "violations"]
        assert [r.violations for r in got.collect()] == [[name]] * len(V2)
        assert got.drop("violations").exceptAll(df).count() == 0
    for decide in (policy.decide_v1, policy.decide_v2):
        assert policy.counterfactuals(decide, df, ev).count() == 0


def test_intel_lattice(spark):
    feed = spark.createDataFrame([("urlhaus", " Evil.COM. ", "t2", 2), ("urlhaus", "evil.com", "t1", 1), ("threatfox", "192.0.2.1", "t3", 3), ("threatfox", "", "t", 4)], "provider string, indicator string, timestamp string, ord int")
    index = intel.build_index(feed)
    df = spark.createDataFrame([(1, "evil.com", "evil.com"), (2, "192.0.2.1", "192.0.2.1"), (3, "a.evil.com", "evil.com"), (4, "ok.com", "ok.com"), (5, " ", "x")], "i int, h string, d string")
    one = {r.i: r.ti for r in intel.lookup(df, index, "h", "urlhaus").collect()}
    assert one[1].status == "KNOWN_MALICIOUS" and one[1].timestamp == "t1" and one[1].confidence == "DOMAIN_MATCH" and one[4].status == "UNKNOWN" and one[5].status == "ERROR"
    assert {r.i: r.ti.confidence for r in intel.lookup(df, index, "h", "threatfox").collect()}[2] == "EXACT_MATCH"
    both = intel.lookup_url(df, index, "h", "d", "urlhaus", out="a")
    both = intel.lookup(both, None, "h", "off", out="b")
    both = intel.lookup(both, index, "h", "threatfox", out="c")
    merged = {r.i: r.m for r in both.select("i", intel.merge(["a", "b", "c"]).alias("m")).collect()}
    assert merged[3].status == "KNOWN_MALICIOUS" and merged[2].confidence == "EXACT_MATCH" and merged[4].status == "UNAVAILABLE"
    assert spark.range(1).select(intel.merge([]).alias("m")).first().m.status == "UNKNOWN"
    hit = intel.contains(df, intel.frozen_digests(index), "h", "d")
    assert [r.known_malicious for r in hit.orderBy("i").collect()] == [True, True, True, False, False]


def test_vector_validation():
    good = dict.fromkeys(DECISION_FEATURES, 0.0)
    assert validate_vector(good) == []
    assert validate_vector(good | {"has_ip": "x"}) == ["feature has_ip must be numeric or boolean, got str"]
    assert len(validate_vector({k: v for k, v in good.items() if k != "has_ip"} | {"extra": 1})) == 2
    assert validate_vector(good | {"phishing_probability": 1.5}) == ["feature phishing_probability is out of range"]
