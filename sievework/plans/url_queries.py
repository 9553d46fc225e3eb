"""Queries of URL functions, features, cleaning and views."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import confusables, features, urls
from ..functions.constants import FEATURES, KEYWORDS, SUFFIX_RULES
from ..operators import audit, cleaning, intel
from . import adapters as A
from .registry import query

LABELS = "('BENIGN', 'PHISHING', 'MALWARE')"


@query("url_scheme", "SELECT ord, CASE WHEN trim(url) = '' THEN 'MALFORMED' WHEN lower(url) LIKE 'https:%' THEN 'HTTPS' WHEN lower(url) LIKE 'http:%' THEN 'HTTP' ELSE 'UNSUPPORTED_SCHEME' END AS outcome FROM v_raw")
def url_scheme(spark, sf):
    return A.raw(spark, sf).select("ord", urls.scheme_outcome(F.col("url")).alias("outcome"))


@query("url_normalize", "SELECT ord, normalized_url, scheme, hostname, CAST(NULL AS INTEGER) AS port, path, query, fragment, registrable_domain FROM v_norm")
def url_normalize(spark, sf):
    return A.normalized(spark, sf).select("ord", "normalized_url", "scheme", "hostname", "port", "path", "query", "fragment", "registrable_domain")


@query("int_corpus", "SELECT CASE WHEN lower(url) LIKE 'ftp:%' THEN 'UNSUPPORTED_SCHEME' WHEN normalized_url IS NULL THEN 'MALFORMED' ELSE 'ACCEPTED' END AS outcome, count(*) AS n FROM v_norm GROUP BY 1")
def int_corpus(spark, sf):
    return A.normalized(spark, sf).groupBy(urls.outcome(urls.scheme_outcome(F.col("url")), F.col("normalized_url")).alias("outcome")).agg(F.count(F.lit(1)).alias("n"))


@query("url_percent", "SELECT ord, ord % 3 = 0 AS bad, CASE WHEN ord % 3 <> 0 THEN url || '?q=%2F%AA' END AS fixed FROM v_urls")
def url_percent(spark, sf):
    made = F.concat("url", F.when(F.col("ord") % 3 == 0, "?q=%zz%").otherwise("?q=%2f%aa"))
    rows = A.urls(spark, sf).select("ord", made.alias("t"))
    return rows.select("ord", urls.bad_percent(F.col("t")).alias("bad"), F.when(~urls.bad_percent(F.col("t")), urls.upper_percent(F.col("t"))).alias("fixed"))


@query("url_domain_parts", "SELECT ord, CASE WHEN length(hostname) > length(registrable_domain) THEN left(hostname, length(hostname) - length(registrable_domain) - 1) ELSE '' END AS subdomain, split_part(registrable_domain, '.', 1) AS domain, split_part(registrable_domain, '.', 2) AS suffix, registrable_domain FROM v_hosts")
def url_domain_parts(spark, sf):
    return A.hosts(spark, sf).select("ord", "subdomain", "domain", "suffix", "registrable_domain")


_SUFFIX_HOSTS = ("a.b.co.uk", "co.uk", "b.com", "x.y.z.ck", "www.ck", "a.www.ck", "y.ck", "m.city.kawasaki.jp", "m.n.kawasaki.jp", "c.m.n.kawasaki.jp", "k.ne.jp", "one.two.unlisted", "printer", "192.0.2.7", "a.uk")


def _suffix_rows(spark, sf):
    return A.urls(spark, sf).select("ord", A.pick("ord", _SUFFIX_HOSTS).alias("hostname"))


_SUFFIX_SQL = f"""
WITH r AS (SELECT unnest([{', '.join(map(repr, SUFFIX_RULES))}]) AS rule),
h AS (SELECT DISTINCT {A._PICK('ord', _SUFFIX_HOSTS)} AS hostname FROM v_urls),
k AS (SELECT hostname, string_split(hostname, '.') AS l, unnest(range(1, len(string_split(hostname, '.')) + 1)) AS n FROM h WHERE NOT regexp_matches(hostname, '^[0-9.]+$')),
t AS (SELECT hostname, n, array_to_string(l[len(l) - n + 1 :], '.') AS tail, array_to_string(l[len(l) - n + 2 :], '.') AS parent FROM k),
m AS (SELECT hostname, max(CASE WHEN rule = '!' || tail THEN n - 1 END) AS but, max(CASE WHEN rule = tail OR rule = '*.' || parent THEN n END) AS longest FROM t JOIN r ON rule IN (tail, '*.' || parent, '!' || tail) GROUP BY 1),
s AS (SELECT hostname, string_split(hostname, '.') AS l, coalesce(but, longest, 0) AS n FROM h LEFT JOIN m USING (hostname))
"""


@query("url_suffixes", _SUFFIX_SQL + "SELECT ord, array_to_string(l[len(l) - n + 1 :], '.') AS suffix, CASE WHEN n = 0 OR n >= len(l) THEN hostname ELSE array_to_string(l[len(l) - n :], '.') END AS registrable_domain FROM v_urls JOIN s ON hostname = " + A._PICK("ord", _SUFFIX_HOSTS))
def url_suffixes(spark, sf):
    """Several labels, wildcards, exceptions and endings without a rule."""
    return urls.with_domain_parts(_suffix_rows(spark, sf), rules=SUFFIX_RULES).select("ord", "suffix", "registrable_domain")


@query("url_unknown_endings", f"SELECT regexp_extract(hostname, '[^.]+$') AS ending, count(*) AS n FROM (SELECT {A._PICK('ord', _SUFFIX_HOSTS)} AS hostname FROM v_urls) WHERE hostname IN ('one.two.unlisted', 'printer', 'www.ck', 'y.ck') AND hostname NOT LIKE '%.ck' GROUP BY 1")
def url_unknown_endings(spark, sf):
    return urls.unknown_endings(urls.with_domain_parts(_suffix_rows(spark, sf), rules=SUFFIX_RULES))


@query("url_domain_url", "SELECT hostname, 'https://' || hostname || '/' AS model_url, count(*) AS n FROM v_hosts GROUP BY 1")
def url_domain_url(spark, sf):
    return A.hosts(spark, sf).groupBy("hostname", urls.domain_url(F.col("hostname")).alias("model_url")).agg(F.count(F.lit(1)).alias("n"))


@query("url_hosttype", "SELECT ord, CASE WHEN ord % 2 = 0 AND ord % 300 <= 255 THEN 'IPV4' ELSE 'DOMAIN' END AS host_type FROM v_urls")
def url_hosttype(spark, sf):
    host = F.when(F.col("ord") % 2 == 0, F.concat(F.lit("192.0.2."), (F.col("ord") % 300).cast("string"))).otherwise(urls.extracted_host(F.col("url")))
    return A.urls(spark, sf).select("ord", urls.host_type(host).alias("host_type"))


@query("url_host_extract", "SELECT ord, regexp_extract(url, '^[a-zA-Z]+://([^/?#:]+)', 1) AS host, regexp_extract(url, '^https?://([^/?#]+)', 1) AS ioc_host FROM v_urls")
def url_host_extract(spark, sf):
    return A.urls(spark, sf).select("ord", urls.extracted_host(F.col("url")).alias("host"), urls.extracted_host(F.col("url"), keep_port=True).alias("ioc_host"))


_ENTROPY = "round(coalesce(-list_sum(list_transform(list_distinct(string_split({0}, '')), lambda c: (length({0}) - length(replace({0}, c, ''))) / length({0})::DOUBLE * log2((length({0}) - length(replace({0}, c, ''))) / length({0})::DOUBLE))), 0), 6)"


@query("url_entropy", f"SELECT ord, {_ENTROPY.format('url')} AS entropy FROM v_urls")
def url_entropy(spark, sf):
    return A.urls(spark, sf).select("ord", F.round(urls.entropy(F.col("url")), 6).alias("entropy"))


@query("redact_domain", "SELECT DISTINCT hostname, '***.' || split_part(registrable_domain, '.', 2) AS redacted, substr(sha256(hostname), 1, 16) AS hashed FROM v_hosts")
def redact_domain(spark, sf):
    h = F.col("hostname")
    return A.hosts(spark, sf).select("hostname", urls.redact_domain(h).alias("redacted"), urls.hash_domain(h).alias("hashed")).distinct()


@query("src_network_allowlist", "SELECT starts_with(url, 'https://') AND regexp_matches(url, '^https://[^/]*example[.]com/en/') AS allowed, count(*) AS n FROM v_urls GROUP BY 1")
def src_network_allowlist(spark, sf):
    rows = A.urls(spark, sf).withColumn("short", F.regexp_replace("url", "^https://([^/]*[.])?example[.]com", "https://example.com"))
    rows = rows.withColumn("short", F.regexp_replace("short", "^(https://[^/]*)example[.]com", "https://example.com"))
    return rows.groupBy(urls.url_allowlist(F.col("short"), {"example.com": ("/en/",)}).alias("allowed")).agg(F.count(F.lit(1)).alias("n"))


def _feature_sql() -> str:
    count = lambda ch: f"length(normalized_url) - length(replace(normalized_url, '{ch}', ''))"
    matched = lambda cls: f"length(regexp_replace(normalized_url, '[^{cls}]', '', 'g'))"
    special = "length(regexp_replace(normalized_url, '[a-zA-Z0-9]', '', 'g'))"
    known = {
        "url_length": "length(normalized_url)", "hostname_length": "length(hostname)", "registrable_domain_length": "length(registrable_domain)", "path_length": "length(path)", "query_length": "length(query)",
        "subdomain_count": "(length(hostname) - length(replace(hostname, '.', ''))) - 1", "dot_count": count("."), "hyphen_count": count("-"), "underscore_count": count("_"), "slash_count": count("/"),
        "digit_count": matched("0-9"), "letter_count": matched("a-zA-Z"), "special_character_count": special, "percent_encoded_count": "0",
        "parameter_count": "CASE WHEN query = '' THEN 0 ELSE len(string_split(query, '&')) END", "is_https": "scheme = 'https'", "is_http": "scheme = 'http'", "has_ip_address": "0", "has_ipv4": "0", "has_ipv6": "0",
        "has_punycode": "0", "has_at_symbol": "contains(normalized_url, '@')", "has_non_default_port": "0", "has_fragment": "fragment <> ''",
        "url_entropy": _ENTROPY.format("normalized_url"), "hostname_entropy": _ENTROPY.format("hostname"), "digit_ratio": f"round({matched('0-9')} / length(normalized_url)::DOUBLE, 6)",
        "special_character_ratio": f"round({special} / length(normalized_url)::DOUBLE, 6)", "hostname_to_url_length_ratio": "round(length(hostname) / length(normalized_url)::DOUBLE, 6)",
    } | {f"contains_{k}": f"contains(lower(normalized_url), '{k}')" for k in KEYWORDS}
    real = ("url_entropy", "hostname_entropy", "digit_ratio", "special_character_ratio", "hostname_to_url_length_ratio")
    return ", ".join(f"{known[f]} AS {f}" if f in real else f"CAST({known[f]} AS INTEGER) AS {f}" for f in FEATURES)


@query("feat_43", f"SELECT ord, {_feature_sql()} FROM v_hosts")
def feat_43(spark, sf):
    made = features.with_features(A.hosts(spark, sf))
    return made.select("ord", *[F.round(f, 6).alias(f) if f in features.FEATURES[-5:] else f for f in FEATURES])


@query("pred_sources", "SELECT label, source, count(*) AS n FROM v_valid WHERE (label = 'BENIGN' AND source = 'commoncrawl_tranco_candidate') OR (label = 'PHISHING' AND source IN ('openphish', 'phishtank')) OR (label = 'MALWARE' AND source = 'urlhaus') GROUP BY 1, 2")
def pred_sources(spark, sf):
    return cleaning.approved_rows(A.valid(spark, sf)).groupBy("label", "source").agg(F.count(F.lit(1)).alias("n"))


@query("proj_label_map", f"SELECT ord, CASE label WHEN 'BENIGN' THEN 0 WHEN 'PHISHING' THEN 1 WHEN 'MALWARE' THEN 2 END AS y FROM v_raw WHERE label IN {LABELS}")
def proj_label_map(spark, sf):
    table = F.create_map(*[F.lit(x) for pair in (("BENIGN", 0), ("PHISHING", 1), ("MALWARE", 2)) for x in pair])
    return A.raw(spark, sf).where(F.col("label").isin(*A.KINDS)).select("ord", F.try_element_at(table, F.col("label")).alias("y"))


@query("cln_pipeline", "SELECT ord, url, normalized_url, label, source, collected_at, registrable_domain FROM v_clean")
def cln_pipeline(spark, sf):
    return cleaning.clean(A.raw(spark, sf)).clean.select("ord", "url", "normalized_url", "label", "source", "collected_at", "registrable_domain")


@query("cln_stats", f"""
WITH r AS (SELECT count(*) AS raw_rows, count(*) FILTER (trim(url) = '') AS removed_empty, count(*) FILTER (trim(url) <> '' AND label NOT IN {LABELS}) AS removed_invalid_label FROM v_raw),
e AS (SELECT count(*) AS removed_exact_duplicates FROM v_raw WHERE trim(url) <> '' AND label IN {LABELS}),
g AS (SELECT normalized_url, count(*) AS n, min(label) AS lo, max(label) AS hi FROM v_dnorm GROUP BY 1),
t AS (SELECT CAST(coalesce(sum(n) FILTER (normalized_url IS NULL), 0) AS BIGINT) AS removed_invalid_urls, CAST(coalesce(sum(n) FILTER (lo <> hi AND normalized_url IS NOT NULL), 0) AS BIGINT) AS removed_conflicts,
      CAST(coalesce(sum(n - 1) FILTER (lo = hi AND normalized_url IS NOT NULL), 0) AS BIGINT) AS removed_normalized_duplicates, count(*) FILTER (lo = hi AND normalized_url IS NOT NULL) AS remaining_rows,
      count(*) FILTER (lo = hi AND normalized_url IS NOT NULL AND lo = 'BENIGN') AS class_benign, count(*) FILTER (lo = hi AND normalized_url IS NOT NULL AND lo = 'PHISHING') AS class_phishing, count(*) FILTER (lo = hi AND normalized_url IS NOT NULL AND lo = 'MALWARE') AS class_malware FROM g)
SELECT r.*, t.*, e.removed_exact_duplicates - (SELECT count(*) FROM v_dedup) AS removed_exact_duplicates FROM r, e, t""")
def cln_stats(spark, sf):
    return cleaning.cleaning_stats(A.raw(spark, sf))


@query("dedup_exact", "SELECT ord, url, label FROM v_dedup")
def dedup_exact(spark, sf):
    rows = A.raw(spark, sf).withColumn("url", urls.strip(F.col("url"))).where(F.col("label").isin(*A.KINDS) & (F.col("url") != ""))
    return cleaning.keep_first(rows, ["url", "label"]).select("ord", "url", "label")


@query("dedup_norm", "SELECT min(ord) AS ord, normalized_url FROM v_norm WHERE normalized_url IS NOT NULL GROUP BY 2")
def dedup_norm(spark, sf):
    return cleaning.keep_first(A.normalized(spark, sf).where("normalized_url is not null"), ["normalized_url"]).select("ord", "normalized_url")


@query("conflict_url", "SELECT ord, normalized_url, label FROM v_dnorm WHERE normalized_url IN (SELECT normalized_url FROM v_bad)")
def conflict_url(spark, sf):
    return cleaning.clean(A.raw(spark, sf)).conflicts.select("ord", "normalized_url", "label")


@query("conflict_view", "SELECT 'https://' || hostname || '/' AS model_url, count(*) AS n FROM v_valid GROUP BY 1 HAVING count(DISTINCT label) = 1")
def conflict_view(spark, sf):
    rows = A.valid(spark, sf).withColumn("model_url", urls.domain_url(F.col("hostname")))
    return cleaning.split_conflicts(rows, "model_url")[0].groupBy("model_url").agg(F.count(F.lit(1)).alias("n"))


@query("conflict_domain", "SELECT registrable_domain, count(*) AS n FROM v_valid GROUP BY 1 HAVING count(DISTINCT label) > 1")
def conflict_domain(spark, sf):
    return cleaning.domain_label_conflicts(A.valid(spark, sf)).groupBy("registrable_domain").agg(F.count(F.lit(1)).alias("n"))


@query("conflict_cross", """
WITH g AS (SELECT normalized_url, count(*) AS n, count(DISTINCT label) AS k FROM v_valid GROUP BY 1),
m AS (SELECT hostname FROM v_valid WHERE source IN ('cert_polska', 'openphish', 'phishing_database') GROUP BY 1 HAVING count(DISTINCT source) > 1)
SELECT count(*) FILTER (k > 1) AS conflicting_urls, CAST(coalesce(sum(n) FILTER (k > 1), 0) AS BIGINT) AS conflicting_rows, (SELECT count(*) FROM m) AS multi_source_domains FROM g""")
def conflict_cross(spark, sf):
    rows = A.valid(spark, sf).withColumn("registrable_domain", F.col("hostname"))
    return cleaning.cross_source_audit(rows)


@query("overlap_domains", "SELECT hostname FROM v_valid WHERE source IN ('cert_polska', 'openphish', 'phishing_database') GROUP BY 1 HAVING count(DISTINCT source) > 1")
def overlap_domains(spark, sf):
    return cleaning.multi_source_domains(A.valid(spark, sf), key="hostname")


@query("view_domain_only", "SELECT 'https://' || registrable_domain || '/' AS model_url, min(label) AS label, min(ord) AS ord FROM v_clean GROUP BY 1 HAVING count(DISTINCT label) = 1")
def view_domain_only(spark, sf):
    return cleaning.domain_only_view(cleaning.clean(A.raw(spark, sf)).clean).select("model_url", "label", "ord")


@query("view_domain_only_hosts", "SELECT 'https://' || hostname || '/' AS model_url, min(label) AS label, min(ord) AS ord FROM v_clean GROUP BY 1 HAVING count(DISTINCT label) = 1")
def view_domain_only_hosts(spark, sf):
    return cleaning.domain_only_view(cleaning.clean(A.raw(spark, sf)).clean, host="hostname").select("model_url", "label", "ord")


@query("view_domain_only_labels", "SELECT 'https://' || registrable_domain || '/' AS model_url, CASE WHEN length(registrable_domain) % 2 = 0 THEN 'BENIGN' ELSE 'PHISHING' END AS label, min(ord) AS ord FROM v_clean GROUP BY registrable_domain")
def view_domain_only_labels(spark, sf):
    """The view by registrable domain where domains agree on their label."""
    rows = cleaning.clean(A.raw(spark, sf)).clean
    rows = rows.withColumn("label", F.when(F.length("registrable_domain") % 2 == 0, "BENIGN").otherwise("PHISHING"))
    return cleaning.domain_only_view(rows).select("model_url", "label", "ord")


@query("view_full_url", "SELECT normalized_url AS model_url, label, source, ord FROM v_clean WHERE (label = 'BENIGN' AND source = 'commoncrawl_tranco_candidate') OR (label = 'PHISHING' AND source IN ('openphish', 'phishtank')) OR (label = 'MALWARE' AND source = 'urlhaus')")
def view_full_url(spark, sf):
    return cleaning.full_url_view(cleaning.clean(A.raw(spark, sf)).clean).select("model_url", "label", "source", "ord")


@query("accumulate", "SELECT url AS normalized_url, min(snapshot_date) AS first_snapshot_date FROM v_snap GROUP BY 1")
def accumulate(spark, sf):
    return cleaning.accumulate(A.snapshots(spark, sf)).select("normalized_url", "first_snapshot_date")


@query("accumulate_counts", "SELECT count(*) AS total_raw, CAST(0 AS BIGINT) AS invalid, count(*) - count(DISTINCT url) AS duplicates, count(DISTINCT url) AS unique_urls, CAST(1 AS BIGINT) AS unique_domains FROM v_snap")
def accumulate_counts(spark, sf):
    return cleaning.accumulation_counts(A.snapshots(spark, sf))


@query("accumulate_counts_mixed", """
WITH s AS (SELECT CASE WHEN ord % 17 = 0 THEN 'ftp://' || ord ELSE 'https://u' || user_id || '.e' || (user_id % 5) || '.org/' END AS url, ord % 17 = 0 AS bad, user_id FROM v_snap)
SELECT count(*) AS total_raw, count(*) FILTER (bad) AS invalid, count(*) FILTER (NOT bad) - count(DISTINCT url) FILTER (NOT bad) AS duplicates, count(DISTINCT url) FILTER (NOT bad) AS unique_urls, count(DISTINCT user_id % 5) FILTER (NOT bad) AS unique_domains FROM s""")
def accumulate_counts_mixed(spark, sf):
    """With rejected URLs and several domains."""
    url = F.concat(F.lit("https://u"), F.col("user_id").cast("string"), F.lit(".e"), (F.col("user_id") % 5).cast("string"), F.lit(".org/"))
    rows = A.snapshots(spark, sf).withColumn("url", F.when(F.col("ord") % 17 == 0, F.concat(F.lit("ftp://"), F.col("ord").cast("string"))).otherwise(url))
    return cleaning.accumulation_counts(rows)


@query("docs_dedup", "SELECT min(doc_id) AS ord, count(*) AS copies FROM documents GROUP BY text")
def docs_dedup(spark, sf):
    rows = A.read(spark, sf, "documents").groupBy(F.sha2("text", 256).alias("h")).agg(F.min("doc_id").alias("ord"), F.count(F.lit(1)).alias("copies"))
    return rows.select("ord", "copies")


@query("src_cc_domains", "SELECT hostname AS domain, min(ord) AS ord FROM v_hosts GROUP BY 1 ORDER BY sha256('42|' || hostname), 1 LIMIT 20")
def src_cc_domains(spark, sf):
    return cleaning.domain_candidates(A.urls(spark, sf).withColumn("url", F.regexp_replace("url", "[?#].*$", "")), pool=None, limit=20).select("domain", "ord")


@query("src_cc_query", "SELECT hostname, normalized_url, ord FROM (SELECT hostname, normalized_url, min(ord) AS ord, row_number() OVER (PARTITION BY hostname ORDER BY min(ord), normalized_url) AS r FROM v_hosts GROUP BY 1, 2) WHERE r <= 2")
def src_cc_query(spark, sf):
    return intel.cross_ranked(A.hosts(spark, sf), "hostname", 2)


@query("src_cc_collect", "SELECT DISTINCT hostname FROM v_hosts WHERE hostname NOT IN (SELECT hostname FROM v_hosts WHERE ord % 5 = 0)")
def src_cc_collect(spark, sf):
    rows = A.hosts(spark, sf)
    return rows.select("hostname").distinct().join(rows.where("ord % 5 = 0").select("hostname").distinct(), "hostname", "left_anti")


@query("conf_skeleton", "SELECT DISTINCT hostname, regexp_replace(translate(hostname, '013456789', 'oleasbtbg'), '[^a-z0-9]', '', 'g') AS skeleton FROM v_hosts")
def conf_skeleton(spark, sf):
    return A.hosts(spark, sf).select("hostname", confusables.skeleton(F.col("hostname")).alias("skeleton")).distinct()


@query("conf_variants", "SELECT DISTINCT hostname, array_to_string(list_sort(list_distinct([s, replace(s, 'rn', 'm'), replace(s, 'vv', 'w'), replace(replace(s, 'rn', 'm'), 'vv', 'w')])), ',') AS variants FROM (SELECT hostname, regexp_replace(hostname, '[^a-z0-9]', '', 'g') AS s FROM v_hosts)")
def conf_variants(spark, sf):
    s = F.regexp_replace("hostname", "[^a-z0-9]", "")
    return A.hosts(spark, sf).select("hostname", F.array_join(F.array_sort(confusables.variants(s)), ",").alias("variants")).distinct()


@query("conf_tokens", """
WITH h AS (SELECT DISTINCT hostname FROM v_hosts),
t AS (SELECT hostname, regexp_replace(translate(unnest(regexp_split_to_array(replace(hostname, '_', ' '), '[^a-z0-9]+')), '013456789', 'oleasbtbg'), '[^a-z0-9]', '', 'g') AS s FROM h),
v AS (SELECT hostname, unnest(list_distinct([s, replace(s, 'rn', 'm'), replace(s, 'vv', 'w'), replace(replace(s, 'rn', 'm'), 'vv', 'w')])) AS w FROM t)
SELECT hostname, string_agg(DISTINCT w, ',' ORDER BY w) AS tokens FROM v WHERE length(w) >= 4 GROUP BY 1""")
def conf_tokens(spark, sf):
    rows = A.hosts(spark, sf).select("hostname", F.array_join(F.array_sort(confusables.tokens(F.col("hostname"))), ",").alias("tokens")).distinct()
    return rows.where("tokens <> ''")


@query("conf_looks", "SELECT ord, regexp_matches(url, '[0-9]') AS looks FROM v_urls")
def conf_looks(spark, sf):
    return A.urls(spark, sf).select("ord", confusables.looks_confusable(F.col("url")).alias("looks"))


@query("conf_idna", "SELECT DISTINCT hostname, 'gοοgle.' || hostname AS decoded FROM v_hosts")
def conf_idna(spark, sf):
    return A.hosts(spark, sf).select("hostname", confusables.idna_decode(F.concat(F.lit("xn--ggle-0nda."), F.col("hostname"))).alias("decoded")).distinct()


@query("agg_distribution", "SELECT lang, count(*) AS n FROM documents WHERE lang IS NOT NULL GROUP BY 1")
def agg_distribution(spark, sf):
    return audit.distribution(A.read(spark, sf, "documents"), "lang")


@query("agg_crosstab", "SELECT CASE WHEN grouping(lang) = 1 THEN 'All' ELSE lang END AS lang, CASE WHEN grouping(source) = 1 THEN 'All' ELSE source END AS source, count(*) AS n FROM documents WHERE lang IS NOT NULL AND source IS NOT NULL GROUP BY CUBE (lang, source)")
def agg_crosstab(spark, sf):
    return audit.crosstab(A.read(spark, sf, "documents"), "lang", "source")


@query("agg_crosstab_wide", "SELECT source, count(*) FILTER (lang = 'de') AS de, count(*) FILTER (lang = 'en') AS en, count(*) FILTER (lang IN ('de', 'en')) AS \"All\" FROM documents GROUP BY 1")
def agg_crosstab_wide(spark, sf):
    return audit.crosstab_wide(A.read(spark, sf, "documents"), ["source"], "lang", ["de", "en"])


@query("agg_hosttype", "SELECT label, count(*) AS n, count(*) AS domain, CAST(0 AS BIGINT) AS ipv4, CAST(0 AS BIGINT) AS ipv6, count(DISTINCT hostname) AS unique_hosts, 1.0::DOUBLE AS domain_share, 0.0::DOUBLE AS ipv4_share, 0.0::DOUBLE AS ipv6_share FROM v_hosts GROUP BY 1")
def agg_hosttype(spark, sf):
    return audit.host_type_counts(A.hosts(spark, sf), by=["label"])


@query("agg_hosttype_mixed", """
WITH k AS (SELECT label, CASE ord % 4 WHEN 0 THEN 'IPV4' WHEN 1 THEN 'IPV6' ELSE 'DOMAIN' END AS t, CASE ord % 4 WHEN 0 THEN '192.0.2.' || (ord % 200) WHEN 1 THEN '2001:db8::' || (ord % 99) ELSE 'a.example' END AS h FROM v_urls),
c AS (SELECT label, count(*) AS n, count(*) FILTER (t = 'DOMAIN') AS domain, count(*) FILTER (t = 'IPV4') AS ipv4, count(*) FILTER (t = 'IPV6') AS ipv6, count(DISTINCT h) AS unique_hosts FROM k GROUP BY 1)
SELECT *, round(domain / n::DOUBLE, 6) AS domain_share, round(ipv4 / n::DOUBLE, 6) AS ipv4_share, round(ipv6 / n::DOUBLE, 6) AS ipv6_share FROM c""")
def agg_hosttype_mixed(spark, sf):
    k = F.col("ord") % 4
    host = F.when(k == 0, F.concat(F.lit("192.0.2."), (F.col("ord") % 200).cast("string"))).when(k == 1, F.concat(F.lit("2001:db8::"), (F.col("ord") % 99).cast("string"))).otherwise("a.example")
    return audit.host_type_counts(A.urls(spark, sf).withColumn("hostname", host), by=["label"])


@query("agg_stage_audit", """
WITH s AS (SELECT 'cleaned' AS stage, hostname FROM v_clean WHERE label = 'MALWARE' UNION ALL SELECT 'raw', regexp_extract(url, '^[a-zA-Z]+://([^/?#:]+)', 1) FROM v_raw WHERE label = 'MALWARE')
SELECT stage, count(*) AS n, count(*) AS domain, CAST(0 AS BIGINT) AS ipv4, CAST(0 AS BIGINT) AS ipv6, count(DISTINCT hostname) AS unique_hosts, 1.0::DOUBLE AS domain_share, 0.0::DOUBLE AS ipv4_share, 0.0::DOUBLE AS ipv6_share FROM s GROUP BY 1""")
def agg_stage_audit(spark, sf):
    raw = A.raw(spark, sf).withColumn("h", urls.extracted_host(F.col("url")))
    return audit.stage_audit({"raw": (raw, "h"), "cleaned": (cleaning.clean(A.raw(spark, sf)).clean, "hostname")})


def _bias_sql() -> str:
    parts = {f: part.rsplit(" AS ", 1)[0] for f, part in zip(FEATURES, _split_top(_feature_sql()))}
    cols = ["count(*) AS count"]
    for c in audit.CONTINUOUS:
        cols += [f"round(avg({c}), 6) AS {c}_mean", f"round(median({c}::DOUBLE), 6) AS {c}_median"]
    cols += [f"round(avg({c}) * 100, 6) AS {c}_percent" for c in audit.FLAGS]
    ratios = {"special_character_ratio": "length(regexp_replace(normalized_url, '[a-zA-Z0-9]', '', 'g')) / length(normalized_url)::DOUBLE", "digit_ratio": "length(regexp_replace(normalized_url, '[^0-9]', '', 'g')) / length(normalized_url)::DOUBLE"}
    wanted = [c for c in (*audit.CONTINUOUS, *audit.FLAGS) if c in parts]
    inner = ", ".join(f"{ratios.get(c, parts[c])} AS {c}" for c in wanted)
    return f"WITH f AS (SELECT label, 'FULL_URL' AS dataset_view, {inner}, CAST(path <> '' AS INTEGER) AS has_path, CAST(query <> '' AS INTEGER) AS has_query FROM v_hosts) SELECT dataset_view, label, {', '.join(cols)} FROM f GROUP BY 1, 2"


def _split_top(text: str) -> list[str]:
    out, depth, quoted, start = [], 0, False, 0
    for i, c in enumerate(text):
        if c == "'":
            quoted = not quoted
        elif not quoted and c in "(":
            depth += 1
        elif not quoted and c == ")":
            depth -= 1
        elif c == "," and not depth and not quoted:
            out.append(text[start:i].strip())
            start = i + 1
    return [*out, text[start:].strip()]


@query("agg_bias", _bias_sql())
def agg_bias(spark, sf):
    rows = A.hosts(spark, sf).withColumns({"dataset_view": F.lit("FULL_URL"), "model_url": F.col("normalized_url")})
    return audit.bias_summary(audit.enriched(rows))


@query("agg_bias_warnings", "SELECT 'FULL_URL' AS dataset_view, 'is_https_percent' AS metric, round(max(h) - min(h), 4) AS spread FROM (SELECT contains(url, 'https') = (ord % 8 <> 0) AS k, avg(CAST(contains(url, 'https') AS INTEGER)) * 100 AS h FROM v_urls GROUP BY 1) HAVING max(h) - min(h) >= 40")
def agg_bias_warnings(spark, sf):
    label = ((F.col("scheme") == "https") == (F.col("ord") % 8 != 0)).cast("string")
    rows = A.hosts(spark, sf).withColumns({"dataset_view": F.lit("FULL_URL"), "model_url": F.col("normalized_url"), "label": label})
    found = audit.bias_warnings(audit.bias_summary(audit.enriched(rows)))
    return found.where("metric = 'is_https_percent'").withColumn("spread", F.round("spread", 4))


@query("agg_source_purity", "SELECT bool_and(k = 1) AS source_confounded FROM (SELECT source, count(DISTINCT label) AS k FROM v_urls GROUP BY 1)")
def agg_source_purity(spark, sf):
    return audit.source_purity(A.urls(spark, sf).withColumn("dataset_view", F.lit("FULL_URL")))


@query("agg_histogram", """
WITH t AS (SELECT quantile_cont(length(url)::DOUBLE, 0.99) AS top, min(length(url))::DOUBLE AS low FROM v_urls)
SELECT CAST(least(floor((least(length(url)::DOUBLE, top) - low) / ((top - low) / 40)), 39) AS INTEGER) AS bin, count(*) AS n FROM v_urls, t GROUP BY 1""")
def agg_histogram(spark, sf):
    from ..operators.metrics import histogram

    return histogram(A.urls(spark, sf).select(F.length("url").alias("l")), "l")


@query("flagship", "SELECT label, count(*) AS domains, CAST(sum(length('https://' || hostname || '/')) AS BIGINT) AS total_length, round(avg(length(hostname)), 6) AS mean_host FROM (SELECT hostname, min(label) AS label FROM v_clean GROUP BY 1 HAVING count(DISTINCT label) = 1) GROUP BY 1")
def flagship(spark, sf):
    """Clean the feed, derive the domain view, extract features and summarise them by label."""
    view = cleaning.domain_only_view(cleaning.clean(A.raw(spark, sf)).clean, host="hostname").select("label", F.col("model_url").alias("url"))
    rows = features.with_features(urls.with_normalized(view))
    return rows.groupBy("label").agg(F.count(F.lit(1)).alias("domains"), F.sum("url_length").alias("total_length"), F.round(F.avg("hostname_length"), 6).alias("mean_host"))


@query("agg_sketches", "SELECT source, count(*) AS n, true AS hosts_close, true AS median_close FROM v_urls GROUP BY 1")
def agg_sketches(spark, sf):
    """Sketches by source and day, stored, merged by source and held against the rows."""
    from ..operators import sketches
    from ..storage import stored

    rows = A.urls(spark, sf).select("source", "collected_at", urls.extracted_host(F.col("url")).alias("host"), F.length("url").alias("length"))
    daily = stored(sketches.sketch(rows, ["source", "collected_at"], "host", "length"), "sketches")
    found = sketches.estimates(sketches.merge(daily, ["source"]), {"median": 0.5}).select("source", "n", "distinct_estimate", "median")
    exact = rows.join(found, "source").groupBy("source", "n", "distinct_estimate").agg(F.count_distinct("host").alias("hosts"), F.avg((F.col("length") < F.col("median")).cast("double")).alias("below"), F.avg((F.col("length") <= F.col("median")).cast("double")).alias("up_to"))
    within = (F.col("below") <= 0.5 + 0.0165) & (F.col("up_to") >= 0.5 - 0.0165)
    return exact.select("source", "n", (F.abs(F.col("distinct_estimate") / F.col("hosts") - 1) < 0.05).alias("hosts_close"), within.alias("median_close"))
