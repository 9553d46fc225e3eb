"""URL expressions: scheme outcome, normalisation, public-suffix parts, host types, digests.

All of them run in the JVM. Where text is not ASCII, the Unicode normal forms and the IDNA encoding come from static
methods of libraries that Spark ships, called by try_reflect on those rows only.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .constants import MAX_URL_LENGTH, SUFFIX_RULES
from .suffixes import SuffixTable, read_suffix_rules, suffix_table, with_suffix_labels

PARTS = ("original_url", "normalized_url", "scheme", "hostname", "port", "path", "query", "fragment", "subdomain", "domain", "suffix", "registrable_domain")
#: All white space of Unicode, and the separators 0x1C to 0x1F.
_SPACE = "[\\x09-\\x0D\\x1C-\\x20\\x85\\xA0\\u1680\\u2000-\\u200A\\u2028\\u2029\\u202F\\u205F\\u3000]"
_WIDE = "[^\\x00-\\x7F]"
OCTET = "(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])"
IPV4 = f"^{OCTET}(?:\\.{OCTET}){{3}}$"


def strip(value: Column) -> Column:
    """Trim all white space."""
    return F.regexp_replace(value, f"\\A{_SPACE}+|{_SPACE}+\\z", "")


def wide(value: Column) -> Column:
    """Whether a text holds other than ASCII characters."""
    return value.rlike(_WIDE)


def composed(value: Column, compatible: bool = False) -> Column:
    """The Unicode normal form NFC, or NFKC if compatible."""
    return F.when(wide(value), F.try_reflect(F.lit("com.ibm.icu.text.Normalizer"), F.lit("compose"), value, F.lit(compatible))).otherwise(value)


def idna(host: Column) -> Column:
    """The ASCII form of a host (IDNA 2003, as browsers' older forms have it); null where there is none."""
    return F.when(wide(host), F.try_reflect(F.lit("java.net.IDN"), F.lit("toASCII"), host, F.lit(1))).otherwise(host)


def is_ipv6(value: Column) -> Column:
    """Whether a text without brackets is an IPv6 address, with or without a zone."""
    group = "[0-9A-Fa-f]{1,4}"
    body = F.regexp_replace(F.regexp_replace(value, "%[^%]+\\z", ""), f"(?<=:){OCTET}(?:\\.{OCTET}){{3}}\\z", "0:0")
    short = body.rlike(f"\\A(?:{group}(?::{group})*)?::(?:{group}(?::{group})*)?\\z") & (F.regexp_count(body, F.lit("[0-9A-Fa-f]+")) <= 7)
    return body.rlike(f"\\A{group}(?::{group}){{7}}\\z") | short


def scheme_outcome(value: Column) -> Column:
    """HTTPS, HTTP, IMPLIED_HTTPS, UNSUPPORTED_SCHEME, or MALFORMED for null and blank."""
    text = strip(F.coalesce(value, F.lit("")))
    scheme = F.lower(F.regexp_extract(text, "^([A-Za-z][A-Za-z0-9+.-]*):", 1))
    return (
        F.when(text == "", "MALFORMED")
        .when(scheme == "", "IMPLIED_HTTPS")
        .when(scheme.isin("http", "https"), F.upper(scheme))
        .otherwise("UNSUPPORTED_SCHEME")
    )


def bad_percent(value: Column) -> Column:
    return F.regexp_count(value, F.lit("%")) != F.regexp_count(value, F.lit("%[0-9A-Fa-f]{2}"))


def upper_percent(value: Column) -> Column:
    """Percent escapes in upper case."""
    pieces = F.split(value, "%", -1)
    fixed = F.transform(pieces, lambda x, i: F.when(i == 0, x).otherwise(F.concat(F.upper(F.substring(x, 1, 2)), F.substring(x, 3, F.length(x)))))
    return F.when(value.contains("%"), F.array_join(fixed, "%")).otherwise(value)


def host_type(value: Column) -> Column:
    """DOMAIN, IPV4 or IPV6 of a host with or without brackets; blank and null are DOMAIN."""
    text = F.regexp_replace(strip(F.coalesce(value, F.lit(""))), "^[\\[\\]]+|[\\[\\]]+$", "")
    return F.when(text.rlike(IPV4), "IPV4").when(text.contains(":") & is_ipv6(text), "IPV6").otherwise("DOMAIN")


SUFFIX_CONF = "spark.sievework.suffixFile"


#: More rules than that are matched by a table.
LITERAL_RULES = 500
_TABLES: dict[tuple[str, str], SuffixTable] = {}


def rules_of(spark: SparkSession) -> Sequence[str] | SuffixTable:
    """The session's public suffixes: those of the file that spark.sievework.suffixFile names, else SUFFIX_RULES.

    A file is read once an application. SUFFIX_RULES covers endings in common use only; unknown_endings counts hosts
    that no rule covers.
    """
    path = spark.conf.get(SUFFIX_CONF, None)
    if not path:
        return SUFFIX_RULES
    key = spark.sparkContext.applicationId, path
    if key not in _TABLES:
        _TABLES[key] = suffix_table(spark, read_suffix_rules(path))
    return _TABLES[key]


def suffix_labels(host: str, rules: Sequence[str] = SUFFIX_RULES) -> Column:
    """How many last labels of a host column are its public suffix: an exception wins, then the longest rule; else 0."""
    by: dict[tuple[str, int], list[str]] = {}
    for rule in rules:
        kind = rule[0] if rule[0] in "*!" else ""
        name = rule.lstrip("!*").removeprefix(".")
        by.setdefault((kind, name.count(".") + 1), []).append(name)
    tail = lambda n: f"substring_index(`{host}`, '.', -{n})"
    among = lambda kind, n: F.expr(f"{tail(n)} in ({', '.join(map(repr, by[kind, n]))})") if (kind, n) in by else F.lit(False)
    labels = F.size(F.split(host, "\\."))
    longest = max((n + (kind == "*") for kind, n in by), default=0)
    out = F.lit(0)
    for n in range(1, longest + 1):
        out = F.when((labels >= n) & (among("", n) | among("*", n - 1)), n).otherwise(out)
    for n in range(2, longest + 1):
        if ("!", n) in by:
            out = F.when((labels >= n) & among("!", n), n - 1).otherwise(out)
    return out


def unknown_endings(normalized: DataFrame) -> DataFrame:
    """(ending, n) of hosts that no suffix rule covers; the whole host is their registrable domain."""
    host = F.col("hostname")
    rows = normalized.where((F.col("suffix") == "") & ~host.rlike(IPV4) & ~host.contains(":"))
    return rows.groupBy(F.substring_index(host, ".", -1).alias("ending")).agg(F.count(F.lit(1)).alias("n"))


def staged(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """Add columns behind a one-row generator.

    Filters and projections above would otherwise be rewritten in terms of the columns' inputs, and a chain of
    such stages would grow into expressions of thousands of nodes that are computed again for every use.
    """
    return df.select("*", F.inline(F.array(F.struct(*[c.alias(n) for n, c in columns.items()]))))


def with_domain_parts(df: DataFrame, host: str = "hostname", rules: Sequence[str] | SuffixTable | None = None) -> DataFrame:
    """Add subdomain, domain, suffix and registrable_domain of a host column; without rules by those of the session."""
    rules = rules_of(df.sparkSession) if rules is None else rules
    if not isinstance(rules, SuffixTable) and len(rules) > LITERAL_RULES:
        rules = suffix_table(df.sparkSession, rules)
    h, n = F.col(host), F.col("_suffix_n")
    is_ip = h.rlike(IPV4) | h.contains(":")
    labels = F.split(h, "\\.")
    if isinstance(rules, SuffixTable):
        df = with_suffix_labels(df, host, rules, "_found_n")
        df = staged(df, {"_suffix_n": F.when(is_ip, -1).otherwise(F.col("_found_n")), "_labels": labels}).drop("_found_n")
    else:
        df = staged(df, {"_suffix_n": F.when(is_ip, -1).otherwise(suffix_labels(host, rules)), "_labels": labels})
    size = F.size("_labels")
    body = F.slice(F.col("_labels"), 1, F.greatest(size - F.greatest(n, F.lit(0)), F.lit(0)))
    df = staged(df, {"_body": body, "suffix": F.when(n <= 0, "").otherwise(F.array_join(F.slice(F.col("_labels"), size - n + 1, F.greatest(n, F.lit(1))), "."))})
    none = F.size("_body") == 0
    domain = F.when(n < 0, h).when(none, "").otherwise(F.element_at("_body", -1))
    whole = (n < 0) | (F.col("suffix") == "") | none
    df = staged(df, {
        "subdomain": F.when(n < 0, "").otherwise(F.array_join(F.slice(F.col("_body"), 1, F.greatest(F.size("_body") - 1, F.lit(0))), ".")),
        "domain": domain,
        "registrable_domain": F.when(whole, h).otherwise(F.concat_ws(".", domain, "suffix")),
    })
    return df.drop("_suffix_n", "_labels", "_body")


def domain_url(host: Column) -> Column:
    return F.concat(F.lit("https://"), F.when(host.contains(":"), F.concat(F.lit("["), host, F.lit("]"))).otherwise(host), F.lit("/"))


_PATTERN = "(?s)\\A([A-Za-z][A-Za-z0-9+.-]*)://([^/?#]*)([^?#]*)(?:\\?([^#]*))?(?:#(.*))?\\z"
# A last dot is left only where the host ended in a full stop of another script.
_LABELS = "\\A[a-z0-9-]{1,63}(?:\\.[a-z0-9-]{1,63})*\\.?\\z"


def with_normalized(df: DataFrame, url: str = "url", rules: Sequence[str] | SuffixTable | None = None) -> DataFrame:
    """Add the 12 parts of a URL column; all but original_url are null where the URL is rejected.

    Columns of df that have a part's name give way to it. Brackets belong to IPv6 hosts; elsewhere before the path they
    are an error.
    """
    df = df.drop(*[c for c in df.columns if c in PARTS and c != url])
    if url in PARTS:
        df, url = df.withColumnRenamed(url, "_url_"), "_url_"
    col = F.col
    df = df.withColumn("original_url", col(url))
    df = staged(df, {"_text": strip(composed(col(url)))})
    has_scheme = col("_text").rlike("\\A[A-Za-z][A-Za-z0-9+.-]*://")
    df = staged(df, {"_whole": F.when(has_scheme, col("_text")).otherwise(F.concat(F.lit("https://"), "_text"))})
    df = staged(df, {name: F.regexp_extract("_whole", _PATTERN, k) for k, name in enumerate(("_scheme", "_authority", "_path", "_query", "_fragment"), 1)})
    place = F.substring_index("_authority", "@", -1)
    df = staged(df, {"_place": place, "_user": F.expr("left(_authority, length(_authority) - length(substring_index(_authority, '@', -1)))")})
    bracketed = col("_authority").rlike("[\\[\\]]")
    inside = F.regexp_extract("_place", "\\A\\[([^\\[\\]]*)\\](?::.*)?\\z", 1)
    after = F.when(bracketed, F.regexp_extract("_place", "\\]:(.*)\\z", 1)).otherwise(F.regexp_extract("_place", "(?s):(.*)\\z", 1))
    name = F.regexp_replace(F.lower(F.substring_index("_place", ":", 1)), "\\.+\\z", "")
    df = staged(df, {"_six": bracketed, "_host": F.when(bracketed, F.lower(inside)).otherwise(idna(name)), "_port": after})
    number = F.when(col("_port").rlike("\\A0*[0-9]{1,9}\\z"), F.regexp_replace("_port", "\\A0+(?=[0-9])", "").cast("int"))
    df = staged(df, {"_number": number, "scheme": F.lower("_scheme")})
    # Compatible forms of characters must not bring in a delimiter.
    delimiters = wide(col("_authority")) & composed(F.translate("_authority", "@:#?", ""), True).rlike("[/?#@:]")
    ok = (
        (col("_text") != "")
        & (F.length("_text") <= MAX_URL_LENGTH)
        & ~col("_text").rlike("[\\x00-\\x1F\\x7F]")
        & (scheme_outcome(col("_text")) != "UNSUPPORTED_SCHEME")
        & col("scheme").isin("http", "https")
        & ~delimiters
        & F.when(col("_six"), is_ipv6(col("_host"))).otherwise(col("_host").rlike(_LABELS))
        & ((col("_port") == "") | F.coalesce(col("_number") <= 65535, F.lit(False)))
        & ~bad_percent(col("_path"))
        & ~bad_percent(col("_query"))
        & ~bad_percent(col("_fragment"))
    )
    df = staged(df, {"_ok": F.coalesce(ok, F.lit(False))})
    parts = {"hostname": col("_host"), "port": col("_number"), "path": upper_percent(col("_path")), "query": upper_percent(col("_query")), "fragment": upper_percent(col("_fragment"))}
    df = df.withColumn("_name", col("scheme")).drop("scheme")
    df = staged(df, {name: F.when(col("_ok"), value) for name, value in ({"scheme": col("_name")} | parts).items()})
    usual = F.coalesce(((col("scheme") == "http") & (col("port") == 80)) | ((col("scheme") == "https") & (col("port") == 443)), F.lit(False))
    built = F.concat(
        col("scheme"), F.lit("://"), col("_user"), F.when(col("_six"), F.concat(F.lit("["), "hostname", F.lit("]"))).otherwise(col("hostname")),
        F.when(col("port").isNull() | usual, "").otherwise(F.concat(F.lit(":"), col("port").cast("string"))),
        col("path"),
        F.when(col("query") == "", "").otherwise(F.concat(F.lit("?"), col("query"))),
        F.when(col("fragment") == "", "").otherwise(F.concat(F.lit("#"), col("fragment"))),
    )
    df = staged(df, {"normalized_url": F.when(col("_ok"), built)})
    df = with_domain_parts(df, "hostname", rules)
    hidden = ("_url_", "_text", "_whole", "_scheme", "_authority", "_path", "_query", "_fragment", "_place", "_user", "_six", "_host", "_port", "_number", "_name", "_ok")
    return df.drop(*[c for c in hidden if c in df.columns])


def outcome(scheme: Column, normalized: Column) -> Column:
    """ACCEPTED, UNSUPPORTED_SCHEME or MALFORMED, from the scheme outcome and the normalised URL."""
    return F.when(scheme == "UNSUPPORTED_SCHEME", scheme).when(normalized.isNull(), "MALFORMED").otherwise("ACCEPTED")


def extracted_host(url: Column, keep_port: bool = False) -> Column:
    """The host of a feed's URL by pattern; keep_port for the IOC feed, whose pattern takes only http(s)."""
    if keep_port:
        return F.regexp_extract(url, "^https?://([^/?#]+)", 1)
    return F.regexp_replace(F.regexp_extract(url, "^[a-zA-Z]+://([^/?#]+)", 1), ":[0-9]+$", "")


def entropy(value: Column) -> Column:
    """Shannon entropy in bits of a text's characters; 0 for an empty text."""
    chars = F.filter(F.split(value, ""), lambda c: c != "")
    length = F.length(value).cast("double")
    shares = F.transform(F.array_distinct(chars), lambda c: (F.length(value) - F.length(F.replace(value, c, F.lit("")))).cast("double") / length)
    return F.when(length == 0, 0.0).otherwise(F.aggregate(shares, F.lit(0.0), lambda acc, p: acc - p * F.log2(p)))


def indicator_digest(value: Column) -> Column:
    """SHA-256 of a lower-case indicator without outer white space and dots."""
    return F.sha2(F.lower(F.trim(strip(value), F.lit("."))), 256)


def redact_domain(host: Column) -> Column:
    return F.when(host_type(host) != "DOMAIN", "IP-address").otherwise(F.concat(F.lit("***."), F.substring_index(host, ".", -1)))


def hash_domain(host: Column) -> Column:
    return F.substring(F.sha2(host, 256), 1, 16)


def host_suffixes(host: Column) -> Column:
    """The host and every shorter ending of it at a dot, longest first: turns suffix tests into equality."""
    labels = F.split(host, "\\.")
    return F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))


#: Hosts and path prefixes that feeds may be fetched from.
def url_allowlist(url: Column, allowed: dict[str, tuple[str, ...]]) -> Column:
    """Whether a URL is https, without user or port, on an allowed host below one of its allowed paths."""
    host = F.regexp_extract(url, "^https://([^/?#@:]+)(?:[/?#]|$)", 1)
    path = F.regexp_extract(url, "^https://[^/?#@:]+([^?#]*)", 1)
    checks = [(host == h) & reduce(lambda a, b: a | b, [path.startswith(p) for p in paths]) for h, paths in allowed.items()]
    return F.coalesce(reduce(lambda a, b: a | b, checks, F.lit(False)), F.lit(False))


def redact_credentials(url: Column) -> Column:
    """Hide user info and values of secret-looking query parameters."""
    hidden = F.regexp_replace(url, "^([A-Za-z][A-Za-z0-9+.-]*://)[^/?#@]*@", "$1***@")
    return F.regexp_replace(hidden, "(?i)([?&](?:auth|auth-key|api_key|apikey|key|token|password)=)[^&#]*", "$1***")
