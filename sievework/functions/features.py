"""The 43 lexical features and the 31 decision features as expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .constants import DECISION_FEATURES, FEATURE_MAXIMA, FEATURES, KEYWORDS, RENAMED, TI_FEATURES, UNBUILT_FEATURES, ZSCORE_FEATURES
from .urls import IPV4, entropy

FLAG = "int"


def feature_columns() -> dict[str, Column]:
    """Expressions over the normalised parts, in feature order."""
    url, host = F.col("normalized_url"), F.col("hostname")
    count = lambda text: (F.length(url) - F.length(F.replace(url, F.lit(text), F.lit("")))).cast("int")
    match = lambda pattern: F.regexp_count(url, F.lit(pattern))
    flag = lambda test: F.coalesce(test, F.lit(False)).cast("int")
    length = F.length(url)
    six, four = host.contains(":"), host.rlike(IPV4)
    port, scheme = F.col("port"), F.col("scheme")
    usual = ((scheme == "http") & (port == 80)) | ((scheme == "https") & (port == 443))
    special = match("[^\\p{L}\\p{N}]")
    digits = match("\\p{Nd}")
    out = {
        "url_length": length,
        "hostname_length": F.length(host),
        "registrable_domain_length": F.length("registrable_domain"),
        "path_length": F.length("path"),
        "query_length": F.length("query"),
        "subdomain_count": F.size(F.filter(F.split("subdomain", "\\."), lambda x: x != "")),
        "dot_count": count("."),
        "hyphen_count": count("-"),
        "underscore_count": count("_"),
        "slash_count": count("/"),
        "digit_count": digits,
        "letter_count": match("\\p{L}"),
        "special_character_count": special,
        "percent_encoded_count": match("%[0-9A-F]{2}"),
        "parameter_count": F.when(F.col("query") == "", 0).otherwise(F.size(F.split("query", "&", -1))),
        "is_https": flag(scheme == "https"),
        "is_http": flag(scheme == "http"),
        "has_ip_address": flag(four | six),
        "has_ipv4": flag(four),
        "has_ipv6": flag(six),
        "has_punycode": flag(host.rlike("(^|\\.)xn--")),
        "has_at_symbol": flag(url.contains("@")),
        "has_non_default_port": flag(port.isNotNull() & ~usual),
        "has_fragment": flag(F.col("fragment") != ""),
        "url_entropy": entropy(url),
        "hostname_entropy": entropy(host),
        "digit_ratio": digits.cast("double") / length,
        "special_character_ratio": special.cast("double") / length,
        "hostname_to_url_length_ratio": F.length(host).cast("double") / length,
    }
    out |= {f"contains_{k}": flag(F.lower(url).contains(k)) for k in KEYWORDS}
    return {name: out[name].alias(name) for name in FEATURES}


def with_features(df: DataFrame) -> DataFrame:
    """Add the 43 features to a normalised frame by one projection."""
    return df.select("*", *[c for c in feature_columns().values()])


def decision_values(probability: str = "phishing_probability") -> dict[str, Column]:
    """The 31 decision values over lexical features, TI hits (optional columns) and a probability."""
    source = {new: old for old, new in RENAMED.items()}
    zero = F.lit(0.0)
    out: dict[str, Column] = {}
    for name in DECISION_FEATURES:
        if name == "phishing_probability":
            value = F.col(probability)
        elif name == "benign_probability":
            value = 1 - F.col(probability)
        elif name in UNBUILT_FEATURES:
            value = zero
        elif name in TI_FEATURES:
            value = F.col(name)
        else:
            value = F.col(source.get(name, name))
        out[name] = value.cast("double")
    return out


def with_decision_features(df: DataFrame, ti_available: Column | None = None) -> DataFrame:
    """Add feature__* and available__* columns: always for lexical ones, for TI where a provider is available."""
    ti = F.lit(True) if ti_available is None else ti_available
    values = {f"feature__{n}": c for n, c in decision_values().items()}
    masks = {f"available__{n}": F.lit(False) if n in UNBUILT_FEATURES else ti if n in TI_FEATURES else F.lit(True) for n in DECISION_FEATURES}
    return df.withColumns(values | masks)


def with_intel(df: DataFrame, brand: str = "brand", shortener: str = "shortener", redirect: str = "redirect") -> DataFrame:
    """Fill the brand, shortener and redirect features from assessment structs; redirects only where observed."""
    seen = F.coalesce(F.col(f"{redirect}.status") == "OBSERVED", F.lit(False))
    number = lambda c: F.coalesce(F.col(c).cast("double"), F.lit(0.0))
    return df.withColumns({
        "feature__brand_detected": number(f"{brand}.detected"),
        "feature__brand_domain_mismatch": number(f"{brand}.domain_mismatch"),
        "feature__brand_risk_score": number(f"{brand}.risk_score"),
        "feature__shortener_detected": number(f"{shortener}.detected"),
        "feature__redirect_count": F.when(seen, number(f"{redirect}.count")).otherwise(0.0),
        "feature__cross_domain_redirect": F.when(seen, number(f"{redirect}.cross_domain")).otherwise(0.0),
        "available__brand_detected": F.col(brand).isNotNull(),
        "available__brand_domain_mismatch": F.col(brand).isNotNull(),
        "available__brand_risk_score": F.col(brand).isNotNull(),
        "available__shortener_detected": F.col(shortener).isNotNull(),
        "available__redirect_count": seen,
        "available__cross_domain_redirect": seen,
    })


def validate_vector(values: dict) -> list[str]:
    """What is wrong with one decision vector; empty if nothing is."""
    expected = set(DECISION_FEATURES)
    out = [f"missing feature: {n}" for n in sorted(expected - set(values))] + [f"unexpected feature: {n}" for n in sorted(set(values) - expected)]
    for name in DECISION_FEATURES:
        v = values.get(name)
        if name in values and not isinstance(v, (bool, int, float)):
            out.append(f"feature {name} must be numeric or boolean, got {type(v).__name__}")
        elif name in values and not 0 <= float(v) <= FEATURE_MAXIMA.get(name, 1.0):
            out.append(f"feature {name} is out of range")
    return out


def fit_normalizer(train: DataFrame) -> DataFrame:
    """One row: mean_* and scale_* of the z-scored features; a spread of about zero counts as 1."""
    aggs = []
    for n in ZSCORE_FEATURES:
        spread = F.stddev_pop(f"feature__{n}")
        aggs += [F.avg(f"feature__{n}").alias(f"mean_{n}"), F.when(spread <= 1e-12, 1.0).otherwise(spread).alias(f"scale_{n}")]
    return train.agg(*aggs)


def with_encoded(df: DataFrame, normalizer: DataFrame) -> DataFrame:
    """Add encoded: 31 normalised values, zero where unavailable, followed by the 31 masks."""
    df = df.crossJoin(F.broadcast(normalizer))
    value = lambda n: (F.col(f"feature__{n}") - F.col(f"mean_{n}")) / F.col(f"scale_{n}") if n in ZSCORE_FEATURES else F.col(f"feature__{n}")
    masks = [F.col(f"available__{n}") for n in DECISION_FEATURES]
    values = [F.when(m, value(n)).otherwise(0.0).cast("double") for n, m in zip(DECISION_FEATURES, masks)]
    return df.withColumn("encoded", F.array(*values, *[m.cast("double") for m in masks])).drop(*normalizer.columns)
