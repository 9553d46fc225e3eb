import random
import time

import pytest
from pyspark.sql import functions as F

from sievework.functions import confusables as C
from sievework.functions import urls as U
from sievework.functions.features import feature_columns

LABEL = "q" * 63

# (input, outcome, normalised, registrable domain), by rule
CASES = [
    # blanks, length, control characters
    (None, "MALFORMED", None, None),
    ("", "MALFORMED", None, None),
    ("\u3000\u2009 \n", "MALFORMED", None, None),
    ("\u00a0https://wald.de/birke \u2028", "ACCEPTED", "https://wald.de/birke", "wald.de"),
    ("https://wald.de/" + "n" * 8176, "ACCEPTED", "https://wald.de/" + "n" * 8176, "wald.de"),
    ("https://wald.de/" + "n" * 8177, "MALFORMED", None, None),
    ("https://wald.de/ei\tche", "MALFORMED", None, None),
    ("https://wald.de/ei\x7fche", "MALFORMED", None, None),
    # schemes
    ("wald.de/linde", "ACCEPTED", "https://wald.de/linde", "wald.de"),
    ("hTTp://Wald.DE/Linde", "ACCEPTED", "http://wald.de/Linde", "wald.de"),
    ("wald.de:8080/linde", "UNSUPPORTED_SCHEME", None, None),
    ("gopher://wald.de/", "UNSUPPORTED_SCHEME", None, None),
    ("mailto:forst@wald.de", "UNSUPPORTED_SCHEME", None, None),
    ("https:wald.de", "MALFORMED", None, None),
    ("//wald.de/linde", "MALFORMED", None, None),
    ("http://?x=1", "MALFORMED", None, None),
    # ports and user info
    ("https://wald.de:443/", "ACCEPTED", "https://wald.de/", "wald.de"),
    ("http://wald.de:443/", "ACCEPTED", "http://wald.de:443/", "wald.de"),
    ("http://wald.de:00080/", "ACCEPTED", "http://wald.de/", "wald.de"),
    ("http://wald.de:/", "ACCEPTED", "http://wald.de/", "wald.de"),
    ("http://wald.de:65536/", "MALFORMED", None, None),
    ("http://wald.de:8o/", "MALFORMED", None, None),
    ("http://wald.de:١/", "MALFORMED", None, None),
    ("http://Förster:Axt@wald.de/", "ACCEPTED", "http://Förster:Axt@wald.de/", "wald.de"),
    ("http://a@b@wald.de#", "ACCEPTED", "http://a@b@wald.de", "wald.de"),
    # hosts
    ("http://wald.de../", "ACCEPTED", "http://wald.de/", "wald.de"),
    ("http://wald..de/", "MALFORMED", None, None),
    ("http://-wald-.de/", "ACCEPTED", "http://-wald-.de/", "-wald-.de"),
    ("http://wald_weg.de/", "MALFORMED", None, None),
    ("http://wald weg.de/", "MALFORMED", None, None),
    (f"http://{LABEL}.{LABEL}.de/", "ACCEPTED", f"http://{LABEL}.{LABEL}.de/", f"{LABEL}.de"),
    (f"http://{LABEL}q.de/", "MALFORMED", None, None),
    ("http://intranet/", "ACCEPTED", "http://intranet/", "intranet"),
    ("http://198.51.100.7:81/a", "ACCEPTED", "http://198.51.100.7:81/a", "198.51.100.7"),
    ("http://198.51.100.700/a", "ACCEPTED", "http://198.51.100.700/a", "198.51.100.700"),
    ("http://[FE80::9]:81/a", "ACCEPTED", "http://[fe80::9]:81/a", "fe80::9"),
    ("http://[::ffff:198.51.100.7]/", "ACCEPTED", "http://[::ffff:198.51.100.7]/", "::ffff:198.51.100.7"),
    ("http://[fe80:::9]/", "MALFORMED", None, None),
    ("http://[1:2:3:4:5:6:7:8:9]/", "MALFORMED", None, None),
    ("http://[198.51.100.7]/", "MALFORMED", None, None),
    ("http://[fe80::9/", "MALFORMED", None, None),
    ("http://x[fe80::9]/", "MALFORMED", None, None),
    # other scripts
    ("http://Bücher.de/Öl", "ACCEPTED", "http://xn--bcher-kva.de/Öl", "xn--bcher-kva.de"),
    ("http://bu\u0308cher.de/o\u0308l", "ACCEPTED", "http://xn--bcher-kva.de/öl", "xn--bcher-kva.de"),
    ("http://straße.de/", "ACCEPTED", "http://strasse.de/", "strasse.de"),
    ("http://дом.example/", "ACCEPTED", "http://xn--d1aqf.example/", "xn--d1aqf.example"),
    ("http://wald\uff0fde/", "MALFORMED", None, None),
    ("http://ﬁnk。de/", "ACCEPTED", "http://fink.de/", "fink.de"),
    # escapes, empty parts
    ("http://wald.de/%c3%bc?%2f=%2F#%aB", "ACCEPTED", "http://wald.de/%C3%BC?%2F=%2F#%AB", "wald.de"),
    ("http://wald.de/%c", "MALFORMED", None, None),
    ("http://wald.de/?q=%g0", "MALFORMED", None, None),
    ("http://wald.de/#%", "MALFORMED", None, None),
    ("http://wald.de??#", "ACCEPTED", "http://wald.de??", "wald.de"),
    ("http://wald.de#a?b#c", "ACCEPTED", "http://wald.de#a?b#c", "wald.de"),
    # public suffixes
    ("http://an.der.spree.co.jp/", "ACCEPTED", "http://an.der.spree.co.jp/", "spree.co.jp"),
    ("http://co.jp/", "ACCEPTED", "http://co.jp/", "co.jp"),
    ("http://am.bach.nagoya.ck/", "ACCEPTED", "http://am.bach.nagoya.ck/", "bach.nagoya.ck"),
    ("http://am.www.ck/", "ACCEPTED", "http://am.www.ck/", "www.ck"),
    ("http://am.bach.unlisted/", "ACCEPTED", "http://am.bach.unlisted/", "am.bach.unlisted"),
]


@pytest.fixture(scope="module")
def normalized(spark):
    df = spark.createDataFrame([(i, c[0], "clash") for i, c in enumerate(CASES)], "i int, url string, port string")
    return U.with_normalized(df).withColumn("outcome", U.outcome(U.scheme_outcome(F.col("url")), F.col("normalized_url"))).cache()


def test_normalisation_cases(normalized):
    got = {r.i: (r.outcome, r.normalized_url, r.registrable_domain) for r in normalized.collect()}
    for i, case in enumerate(CASES):
        assert got[i] == case[1:], case[0]


def test_normalisation_settles(normalized):
    """What was accepted is its own normal form, with the same parts but for a usual port."""
    first = {r.i: r for r in normalized.where("normalized_url is not null").collect()}
    df = normalized.where("normalized_url is not null").select("i", F.col("normalized_url").alias("url"))
    for r in U.with_normalized(df).collect():
        assert all(r[c] == first[r.i][c] for c in U.PARTS if c not in ("original_url", "port")), r.url


def test_url_work_stays_in_the_jvm(spark):
    df = U.with_normalized(spark.createDataFrame([("http://bücher.de/",)], "url string"))
    df = df.select("*", U.host_type(F.col("hostname")).alias("t"), C.skeleton(F.col("hostname")).alias("s"), C.idna_decode(F.col("hostname")).alias("d"))
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and df.first().d == "bücher.de"


@pytest.mark.parametrize("private", [False, True])
def test_suffix_file(spark, tmp_path, private):
    path = tmp_path / "suffixes.dat"
    path.write_text("// comment\n\nlocal // after\n*.wild\n!open.wild\nдом\na.b.local\n// ===BEGIN PRIVATE DOMAINS===\nblog.local\n// ===END PRIVATE DOMAINS===\n", encoding="utf-8")
    rules = U.read_suffix_rules(str(path), private)
    assert rules == ("local", "*.wild", "!open.wild", "xn--d1aqf", "a.b.local", *(["blog.local"] if private else []))
    hosts = {"x.y.local": "y.local", "x.c.wild": "x.c.wild", "w.x.c.wild": "x.c.wild", "c.wild": "c.wild", "w.open.wild": "open.wild", "x.a.b.local": "x.a.b.local", "w.x.a.b.local": "x.a.b.local", "b.local": "b.local", "x.xn--d1aqf": "x.xn--d1aqf", "me.blog.local": "me.blog.local" if private else "blog.local", "x.other": "x.other"}
    df = spark.createDataFrame([(h,) for h in hosts], "hostname string")
    assert {r.hostname: r.registrable_domain for r in U.with_domain_parts(df, rules=rules).collect()} == hosts
    spark.conf.set(U.SUFFIX_CONF, str(path))
    try:
        assert U.with_domain_parts(df).where("hostname = 'w.x.c.wild'").first().suffix == "c.wild"
    finally:
        spark.conf.unset(U.SUFFIX_CONF)
    assert [tuple(r) for r in U.unknown_endings(U.with_domain_parts(df, rules=rules)).collect()] == [("other", 1)]
    (tmp_path / "none.dat").write_text("// nothing\n")
    with pytest.raises(ValueError):
        U.read_suffix_rules(str(tmp_path / "none.dat"))


def plain_suffix(host, rules):
    """The number of labels of a host's public suffix, by going through all rules."""
    labels, best = host.split("."), 0
    for rule in rules:
        parts = rule.lstrip("!").split(".")
        if len(parts) <= len(labels) and all(p in ("*", x) for p, x in zip(reversed(parts), reversed(labels))):
            if rule[0] == "!":
                return len(parts) - 1
            best = max(best, len(parts))
    return best


def test_ten_thousand_rules_equal_brute_force(spark, tmp_path):
    rng = random.Random(6)
    tops = [f"t{k}" for k in range(300)]
    plain = [*tops, *{f"{rng.choice('abcdefghij')}{rng.randrange(60)}.{rng.choice(tops)}" for _ in range(9000)}, *{f"x{rng.randrange(40)}.y{rng.randrange(9)}.{rng.choice(tops)}" for _ in range(1500)}]
    wild = [f"*.w{k}.{t}" for k, t in enumerate(tops[:200])]
    rules = [*plain, *wild, *[f"!open.w{k}.{t}" for k, t in enumerate(tops[:200])]]
    private = [f"p{k}.t{k}" for k in range(300)]
    text = "\n".join(["// ===BEGIN ICANN DOMAINS===", *rules, "// ===END ICANN DOMAINS===", "// ===BEGIN PRIVATE DOMAINS===", *private, "// ===END PRIVATE DOMAINS==="])
    (tmp_path / "rules.dat").write_text(text)
    assert len(rules) > 10_000
    hosts = {".".join([*rng.sample(["www", "a1", "open", "x3", "b7"], rng.randrange(0, 4)), rng.choice([*rules, *private]).lstrip("!*.")]) for _ in range(300)} | {"unlisted", "a.unlisted", "t5", "w3.t3", "192.0.2.1"}
    df = spark.createDataFrame([(h,) for h in sorted(hosts)], "hostname string")
    read = U.read_suffix_rules(f"file://{tmp_path}/rules.dat")
    assert list(read) == rules
    began = time.perf_counter()
    found = U.with_domain_parts(df, rules=U.suffix_table(spark, read))
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert time.perf_counter() - began < 20 and len(plan) < 100_000  # literal lists made plans of megabytes
    for r in found.collect():
        n = 0 if r.hostname == "192.0.2.1" else plain_suffix(r.hostname, rules)
        assert r.suffix == (".".join(r.hostname.split(".")[-n:]) if n else ""), r.hostname


def test_features(spark):
    df = U.with_normalized(spark.createDataFrame([("http://user@192.0.2.20:8080/login_verify?q=%2F#x",), ("https://sub.example.com/",)], "url string"))
    first, second = df.select(*feature_columns().values()).collect()
    assert len(first) == 43
    assert all(first[c] == 1 for c in ("has_ipv4", "has_at_symbol", "has_non_default_port", "has_fragment", "contains_login", "contains_verify", "percent_encoded_count", "parameter_count"))
    assert second.subdomain_count == 1 and second.is_https == 1 and second.has_ip_address == 0 and second.parameter_count == 0


def test_host_types_and_digests(spark):
    rows = spark.createDataFrame([("1.2.3.4",), ("01.2.3.4",), ("[::1]",), ("::g",), (" ",), (None,), ("a.com",)], "h string")
    assert [r[0] for r in rows.select(U.host_type(F.col("h"))).collect()] == ["IPV4", "DOMAIN", "IPV6", "DOMAIN", "DOMAIN", "DOMAIN", "DOMAIN"]
    one = rows.limit(1).select(
        U.entropy(F.lit("google.com")).alias("e"), U.entropy(F.lit("")).alias("z"), U.indicator_digest(F.lit(" .A.com. ")).alias("d"), F.sha2(F.lit("a.com"), 256).alias("s"),
        U.redact_domain(F.lit("x.evil.com")).alias("r"), U.extracted_host(F.lit("http://a.b:81/x")).alias("x"), U.host_suffixes(F.lit("a.b.c")).alias("u"),
        U.redact_credentials(F.lit("https://u:p@h/?a=1&auth-key=zz#f")).alias("c"),
        U.url_allowlist(F.lit("https://h/p/x"), {"h": ("/p/",)}).alias("ok"), U.url_allowlist(F.lit("https://h:1/p/x"), {"h": ("/p/",)}).alias("no"),
    ).first()
    assert round(one.e, 6) == 2.646439 and one.z == 0 and one.d == one.s and one.r == "***.com" and one.x == "a.b" and one.u == ["a.b.c", "b.c", "c"]
    assert one.c == "https://***@h/?a=1&auth-key=***#f" and one.ok and not one.no


def test_confusables(spark):
    one = spark.range(1).select(
        C.skeleton(F.lit("PayPa1")).alias("a"), C.skeleton(F.lit("раypal")).alias("b"), C.variants(F.lit("rnvv")).alias("v"), C.tokens(F.lit("paypa1-log_secure")).alias("t"),
        C.looks_confusable(F.lit("paypa1")).alias("y"), C.looks_confusable(F.lit("paypal")).alias("n"), C.idna_decode(F.lit("xn--ggle-0nda")).alias("i"), C.skeleton(F.lit("é-ø")).alias("c"),
    ).first()
    assert one.a == "paypal" and one.b == "paypal" and set(one.v) == {"rnvv", "mvv", "rnw", "mw"} and set(one.t) == {"paypal", "secure"}
    assert one.y and not one.n and one.i == "gοοgle" and one.c == "eo"
