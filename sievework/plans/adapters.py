"""Views over the driver's tables that the registered queries run on, as frames and as the same SQL.

The tables hold no labelled URL feed, so labels, sources, dates and damaged variants are derived from ids. Every
view reads its whole table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.urls import extracted_host, indicator_digest, with_normalized
from ..operators.sampling import order_key

SOURCES = ("tranco", "commoncrawl_tranco_candidate", "cert_polska", "openphish", "urlhaus")
KINDS = ("BENIGN", "PHISHING", "MALWARE")


def read(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def pick(key: str, values: tuple[str, ...]) -> Column:
    return F.element_at(F.array(*map(F.lit, values)), (F.col(key) % len(values)).cast("int") + 1)


def urls(spark: SparkSession, sf: str) -> DataFrame:
    """ord, url, label, source, collected_at of pages."""
    date = F.date_format(F.date_add(F.lit("2026-09-01").cast("date"), (F.col("page_id") % 4).cast("int")), "yyyy-MM-dd")
    return read(spark, sf, "pages").select(F.col("page_id").alias("ord"), "url", pick("page_id", KINDS).alias("label"), pick("page_id", SOURCES).alias("source"), date.alias("collected_at"))


def raw(spark: SparkSession, sf: str) -> DataFrame:
    """urls with damaged and repeated variants; one pass over the table."""
    base = urls(spark, sf)
    host = F.concat(F.upper(F.substring_index("url", "/", 3)), F.substring("url", F.length(F.substring_index("url", "/", 3)) + 1, F.length("url")))
    other = F.element_at(F.array(*map(F.lit, KINDS)), ((F.col("ord") + 1) % 3).cast("int") + 1)
    row = lambda k, test, url=F.col("url"), label=F.col("label"): F.when(test, F.struct(F.lit(k).alias("k"), url.alias("url"), label.alias("label")))
    every = lambda n: F.col("ord") % n == 0
    variants = F.array(
        row(0, F.lit(True)), row(1, every(7), host), row(2, every(11)), row(3, every(13), label=other), row(4, every(17), F.lit("  ")),
        row(5, every(19), F.concat(F.lit("ftp://"), extracted_host(F.col("url")))), row(6, every(23), label=F.lit("UNKNOWN")),
    )
    each = base.select("ord", "source", "collected_at", F.explode(F.filter(variants, lambda v: v.isNotNull())).alias("v"))
    return each.select((F.col("ord") * 10 + F.col("v.k")).alias("ord"), F.col("v.url").alias("url"), F.col("v.label").alias("label"), "source", "collected_at")


def normalized(spark: SparkSession, sf: str) -> DataFrame:
    return with_normalized(raw(spark, sf))


def valid(spark: SparkSession, sf: str) -> DataFrame:
    """Normalised urls with a label among the known ones."""
    return normalized(spark, sf).where(F.col("normalized_url").isNotNull() & F.col("label").isin(*KINDS))


def hosts(spark: SparkSession, sf: str) -> DataFrame:
    """The urls of pages, normalised."""
    return with_normalized(urls(spark, sf))


def scored2(spark: SparkSession, sf: str) -> DataFrame:
    """p1, y, source and host marks of lineitem; rows have no key."""
    return read(spark, sf, "lineitem").select(
        ((F.col("l_quantity") + 10 * F.col("l_discount")) / 52).alias("score"), (F.col("l_returnflag") == "R").cast("int").alias("y"), F.col("l_linestatus").alias("source"),
        (F.col("l_suppkey") % 10 == 0).alias("on_ip"), (F.col("l_quantity") >= 26).cast("int").alias("predicted"), F.array(1 - (F.col("l_quantity") + 10 * F.col("l_discount")) / 52, (F.col("l_quantity") + 10 * F.col("l_discount")) / 52).alias("p"),
    )


def scored3(spark: SparkSession, sf: str) -> DataFrame:
    """id, y, p (softmax of four times the first components), source and half of embeddings."""
    e = lambda k: F.exp(4 * F.get(F.col("embedding"), F.lit(k)).cast("double"))
    total = e(0) + e(1) + e(2)
    rows = read(spark, sf, "embeddings").select(
        F.col("vec_id").alias("id"), (F.col("label") % 3).alias("y"), F.array(e(0) / total, e(1) / total, e(2) / total).alias("p"), F.concat(F.lit("s"), (F.col("vec_id") % 4).cast("string")).alias("source"), (F.col("vec_id") % 2).alias("half"),
    )
    return rows.withColumn("predicted", F.array_position("p", F.array_max("p")).cast("int") - 1)


def decisions(spark: SparkSession, sf: str) -> DataFrame:
    """Decision features, masks and true states of lineitem."""
    number = lambda test: test.cast("double")
    known = (F.col("l_returnflag") == "A") & (F.col("l_suppkey") % 10 == 0)
    values = {
        "phishing_probability": (F.col("l_quantity") + 10 * F.col("l_discount")) / 52,
        "known_malicious": number(known),
        "whitelist_hit": number(F.col("l_partkey") % 31 == 0),
        "has_ip": number(F.col("l_linenumber") % 3 == 0),
        "contains_login": number(F.col("l_partkey") % 4 == 1),
        "brand_detected": number(F.col("l_partkey") % 5 == 0),
        "brand_domain_mismatch": number(F.col("l_partkey") % 10 == 0),
        "brand_risk_score": F.when(F.col("l_partkey") % 10 == 0, F.when(F.col("l_partkey") % 20 == 0, 0.85).otherwise(0.35)).otherwise(0.0),
        "shortener_detected": number(F.col("l_suppkey") % 7 == 0),
        "cross_domain_redirect": number(F.col("l_orderkey") % 8 == 0),
    }
    masks = dict.fromkeys(values, F.lit(True)) | {"known_malicious": F.col("l_linenumber") != 5, "cross_domain_redirect": F.col("l_orderkey") % 4 == 0, "contains_login": F.col("l_tax") < 0.06}
    state = F.when(known, "KNOWN_MALWARE").when(F.col("l_returnflag") == "R", "PHISHING").otherwise("BENIGN")
    return read(spark, sf, "lineitem").select(*[v.alias(f"feature__{n}") for n, v in values.items()], *[m.alias(f"available__{n}") for n, m in masks.items()], state.alias("true_state"))


def snapshots(spark: SparkSession, sf: str) -> DataFrame:
    """Dated feed rows of events: one url per user."""
    return read(spark, sf, "events").select(F.col("event_id").alias("ord"), F.concat(F.lit("https://u"), F.col("user_id").cast("string"), F.lit(".example.org/")).alias("url"), F.date_format("ts", "yyyy-MM-dd").alias("snapshot_date"), F.col("event_type").alias("label"), "user_id", "ts", "value")


def feed(spark: SparkSession, sf: str) -> DataFrame:
    """(provider, indicator, timestamp, ord) of all hosts of pages."""
    return _reported(hosts(spark, sf))


def intel(spark: SparkSession, sf: str) -> DataFrame:
    """The feed that lookups search: every ninth host of pages by hash, so that they meet unknown hosts too."""
    return _reported(hosts(spark, sf).where(F.conv(F.substring(order_key(9, F.col("hostname")), 1, 6), 16, 10).cast("long") % 9 == 0))


def _reported(rows: DataFrame) -> DataFrame:
    provider = F.when(F.length("hostname") % 2 == 0, "urlhaus").otherwise("threatfox")
    return rows.where(F.col("hostname").isNotNull()).select(provider.alias("provider"), F.concat(F.lit(" "), F.upper("hostname"), F.lit(".")).alias("indicator"), F.col("collected_at").alias("timestamp"), "ord")


def branded(spark: SparkSession, sf: str) -> DataFrame:
    """Normalised urls whose hosts name brands and shorteners by page id."""
    names = ("paypal.com", "accounts.google.com", "google-login.example", "paypa1.example", "micros0ft.example", "bit.ly", "go.bit.ly", "apple.com.evil.com", "example.com", "bit-ly.example")
    rows = read(spark, sf, "pages").select(F.col("page_id").alias("ord"), F.concat(F.lit("https://"), pick("page_id", names), F.when(F.col("page_id") % 3 == 0, "/netflix/x").otherwise("/y")).alias("url"))
    return with_normalized(rows)


def digests(rows: DataFrame) -> DataFrame:
    return rows.select(indicator_digest(F.col("indicator")).alias("digest")).distinct()


# ---- The same views in SQL ----

_PICK = lambda key, values: f"list_value({', '.join(repr(v) for v in values)})[CAST({key} % {len(values)} AS INTEGER) + 1]"
_SOFT = "exp(4 * CAST(embedding[1] AS DOUBLE)) AS e0, exp(4 * CAST(embedding[2] AS DOUBLE)) AS e1, exp(4 * CAST(embedding[3] AS DOUBLE)) AS e2"
_URL = r"'^([A-Za-z][A-Za-z0-9+.-]*)://([^/?#]*)([^?#]*)([?]([^#]*))?(#(.*))?$'"


def _norm(source: str) -> str:
    return f"""
    SELECT s.* EXCLUDE (u, m, ok), CASE WHEN ok THEN lower(m.scheme) END AS scheme, CASE WHEN ok THEN rtrim(lower(m.host), '.') END AS hostname,
           CASE WHEN ok THEN m.path END AS path, CASE WHEN ok THEN m.query END AS query, CASE WHEN ok THEN m.fragment END AS fragment,
           CASE WHEN ok THEN lower(m.scheme) || '://' || rtrim(lower(m.host), '.') || m.path || CASE WHEN m.query = '' THEN '' ELSE '?' || m.query END || CASE WHEN m.fragment = '' THEN '' ELSE '#' || m.fragment END END AS normalized_url,
           CASE WHEN ok THEN regexp_extract(rtrim(lower(m.host), '.'), '([^.]+[.][^.]+)$', 1) END AS registrable_domain
    FROM (SELECT *, u <> '' AND lower(m.scheme) IN ('http', 'https') AS ok
          FROM (SELECT *, trim(url) AS u, regexp_extract(trim(url), {_URL}, ['scheme', 'host', 'path', 'q0', 'query', 'f0', 'fragment']) AS m FROM {source})) s"""


SQL = {
    "v_urls": f"SELECT page_id AS ord, url, {_PICK('page_id', KINDS)} AS label, {_PICK('page_id', SOURCES)} AS source, strftime(DATE '2026-09-01' + CAST(page_id % 4 AS INTEGER), '%Y-%m-%d') AS collected_at FROM pages",
    "v_raw": f"""
    SELECT ord * 10 AS ord, url, label, source, collected_at FROM v_urls
    UNION ALL SELECT ord * 10 + 1, upper(regexp_extract(url, '^([^/]*//[^/]*)', 1)) || substr(url, length(regexp_extract(url, '^([^/]*//[^/]*)', 1)) + 1), label, source, collected_at FROM v_urls WHERE ord % 7 = 0
    UNION ALL SELECT ord * 10 + 2, url, label, source, collected_at FROM v_urls WHERE ord % 11 = 0
    UNION ALL SELECT ord * 10 + 3, url, {_PICK('(ord + 1)', KINDS)}, source, collected_at FROM v_urls WHERE ord % 13 = 0
    UNION ALL SELECT ord * 10 + 4, '  ', label, source, collected_at FROM v_urls WHERE ord % 17 = 0
    UNION ALL SELECT ord * 10 + 5, 'ftp://' || regexp_extract(url, '://([^/?#]+)', 1), label, source, collected_at FROM v_urls WHERE ord % 19 = 0
    UNION ALL SELECT ord * 10 + 6, url, 'UNKNOWN', source, collected_at FROM v_urls WHERE ord % 23 = 0""",
    "v_norm": _norm("v_raw"),
    "v_hosts": _norm("v_urls"),
    "v_valid": "SELECT * FROM v_norm WHERE normalized_url IS NOT NULL AND label IN ('BENIGN', 'PHISHING', 'MALWARE')",
    "v_dedup": "SELECT * EXCLUDE (r) FROM (SELECT *, row_number() OVER (PARTITION BY url, label ORDER BY ord) AS r FROM (SELECT * REPLACE (trim(url) AS url) FROM v_raw WHERE trim(url) <> '' AND label IN ('BENIGN', 'PHISHING', 'MALWARE'))) WHERE r = 1",
    "v_dnorm": _norm("v_dedup"),
    "v_bad": "SELECT normalized_url FROM v_dnorm WHERE normalized_url IS NOT NULL GROUP BY 1 HAVING count(DISTINCT label) > 1",
    "v_clean": "SELECT * EXCLUDE (r) FROM (SELECT *, row_number() OVER (PARTITION BY normalized_url ORDER BY ord) AS r FROM v_dnorm WHERE normalized_url IS NOT NULL AND normalized_url NOT IN (SELECT normalized_url FROM v_bad)) WHERE r = 1",
    "v_scored2": "SELECT (l_quantity + 10 * l_discount) / 52 AS score, CAST(l_returnflag = 'R' AS INTEGER) AS y, l_linestatus AS source, l_suppkey % 10 = 0 AS on_ip, CAST(l_quantity >= 26 AS INTEGER) AS predicted FROM lineitem",
    "v_scored3": f"SELECT *, CASE WHEN p0 >= p1 AND p0 >= p2 THEN 0 WHEN p1 >= p2 THEN 1 ELSE 2 END AS predicted, greatest(p0, p1, p2) AS conf, CASE y WHEN 0 THEN p0 WHEN 1 THEN p1 ELSE p2 END AS own FROM (SELECT id, y, source, half, e0 / (e0 + e1 + e2) AS p0, e1 / (e0 + e1 + e2) AS p1, e2 / (e0 + e1 + e2) AS p2 FROM (SELECT vec_id AS id, label % 3 AS y, 's' || (vec_id % 4) AS source, vec_id % 2 AS half, {_SOFT} FROM embeddings))",
    "v_dec": """
    SELECT *, CAST(ip AND true AS INTEGER) + CAST(login AND login_seen AS INTEGER) + CAST(mismatch AS INTEGER) AS ev,
           CASE WHEN is_known THEN 'KNOWN_MALWARE' WHEN l_returnflag = 'R' THEN 'PHISHING' ELSE 'BENIGN' END AS true_state, is_known AND l_linenumber <> 5 AS known
    FROM (SELECT l_returnflag, l_linenumber, (l_quantity + 10 * l_discount) / 52 AS p, l_returnflag = 'A' AND l_suppkey % 10 = 0 AS is_known, l_partkey % 31 = 0 AS white, l_linenumber % 3 = 0 AS ip, l_partkey % 4 = 1 AS login, l_tax < 0.06::DOUBLE AS login_seen,
                 l_partkey % 5 = 0 AS brand, l_partkey % 10 = 0 AS mismatch, CASE WHEN l_partkey % 20 = 0 THEN 0.85 WHEN l_partkey % 10 = 0 THEN 0.35 ELSE 0.0 END AS brand_score, l_suppkey % 7 = 0 AS short, l_orderkey % 8 = 0 AS redirect FROM lineitem)""",
    "v_snap": "SELECT event_id AS ord, 'https://u' || user_id || '.example.org/' AS url, strftime(ts, '%Y-%m-%d') AS snapshot_date, event_type AS label, user_id, ts, value FROM events",
    "v_ti": "SELECT CASE WHEN length(hostname) % 2 = 0 THEN 'urlhaus' ELSE 'threatfox' END AS provider, hostname AS indicator, min_by(collected_at, ord) AS timestamp FROM v_hosts WHERE CAST('0x' || substr(sha256('9|' || hostname), 1, 6) AS BIGINT) % 9 = 0 GROUP BY 1, 2",
    "v_feed": "SELECT CASE WHEN length(hostname) % 2 = 0 THEN 'urlhaus' ELSE 'threatfox' END AS provider, hostname AS indicator, min_by(collected_at, ord) AS timestamp FROM v_hosts WHERE hostname IS NOT NULL GROUP BY 1, 2",
}
#: What each view reads of the others.
NEEDS = {"v_raw": ["v_urls"], "v_norm": ["v_raw"], "v_hosts": ["v_urls"], "v_valid": ["v_norm"], "v_dedup": ["v_raw"], "v_dnorm": ["v_dedup"], "v_bad": ["v_dnorm"], "v_clean": ["v_bad"], "v_ti": ["v_hosts"], "v_feed": ["v_hosts"]}


def sql(body: str) -> str:
    """A statement with the views that it names, and those that they need, as common table expressions."""
    import re

    wanted: list[str] = []

    def add(name: str) -> None:
        for other in NEEDS.get(name, []):
            add(other)
        if name not in wanted:
            wanted.append(name)

    for name in re.findall(r"\bv_\w+", body):
        if name in SQL:
            add(name)
    if not wanted:
        return body
    ctes = ",\n".join(f"{n} AS ({SQL[n]})" for n in wanted)
    return f"WITH {ctes}{',' if body.lstrip().upper().startswith('WITH ') else ''} {body.lstrip()[5:] if body.lstrip().upper().startswith('WITH ') else body}"
