"""Distribution and bias audits of dataset views."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.constants import ARTIFACT_SPREAD
from ..functions.features import with_features
from ..functions.urls import host_type, with_normalized
from ..storage import stored
from .quantiles import beside, exact_quantiles

# Measures of the bias summary.
CONTINUOUS = (
    "url_length", "hostname_length", "registrable_domain_length", "path_length", "query_length", "subdomain_count", "dot_count", "hyphen_count", "digit_count",
    "special_character_count", "special_character_ratio", "digit_ratio", "percent_encoded_count", "parameter_count",
)
FLAGS = ("is_https", "is_http", "has_ip_address", "has_ipv4", "has_ipv6", "has_punycode", "has_path", "has_query")
SPREAD_METRICS = ("has_path_percent", "has_query_percent", "is_https_percent", "has_ip_address_percent")
KINDS = ("DOMAIN", "IPV4", "IPV6")


def distribution(df: DataFrame, column: str) -> DataFrame:
    return df.where(F.col(column).isNotNull()).groupBy(column).agg(F.count(F.lit(1)).alias("n"))


def host_type_counts(df: DataFrame, host: str = "hostname", by: Sequence[str] = ()) -> DataFrame:
    """Counts and shares of all three host types, and distinct hosts."""
    kind = host_type(F.col(host))
    rows = df.select(*by, kind.alias("_k"), F.col(host).alias("_h"))
    counts = [F.count_if(F.col("_k") == k).alias(k.lower()) for k in KINDS]
    out = rows.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), *counts, F.count_distinct("_h").alias("unique_hosts"))
    share = lambda k: F.when(F.col("n") > 0, F.round(F.col(k.lower()) / F.col("n"), 6)).otherwise(0.0)
    return out.withColumns({f"{k.lower()}_share": share(k) for k in KINDS})


def stage_audit(stages: dict[str, tuple[DataFrame, str]]) -> DataFrame:
    """Host types of malware at each named stage; a stage is a frame and its host column."""
    parts = [df.where("label = 'MALWARE'").select(F.lit(name).alias("stage"), F.col(host).alias("hostname")) for name, (df, host) in stages.items()]
    whole = parts[0]
    for part in parts[1:]:
        whole = whole.unionByName(part)
    return host_type_counts(whole, by=["stage"])


def enriched(views: DataFrame, url: str = "model_url") -> DataFrame:
    """Features of the views' model URLs, with has_path and has_query."""
    kept = views.select("dataset_view", "label", "source", F.col(url).alias("url"))
    rows = with_features(with_normalized(kept))
    return rows.withColumns({"has_path": (F.col("path_length") > 0).cast("int"), "has_query": (F.col("query_length") > 0).cast("int")})


def bias_summary(rows: DataFrame) -> DataFrame:
    """Means and medians of measures and percentages of flags per (view, label); medians by selection."""
    by = ["dataset_view", "label"]
    rows = stored(rows.select(*by, *CONTINUOUS, *FLAGS), "enriched")
    aggs: list[Column] = [F.count(F.lit(1)).alias("count")]
    aggs += [F.round(F.avg(c), 6).alias(f"{c}_mean") for c in CONTINUOUS]
    aggs += [F.round(F.avg(c) * 100, 6).alias(f"{c}_percent") for c in FLAGS]
    medians = exact_quantiles(rows, CONTINUOUS, {"median": 0.5}, by, held=True)
    medians = medians.select(*by, *[F.round(f"{c}_median", 6).alias(f"{c}_median") for c in CONTINUOUS])
    return beside(rows.groupBy(*by).agg(*aggs), medians, by)


def bias_warnings(summary: DataFrame, limit: float = ARTIFACT_SPREAD) -> DataFrame:
    """(dataset_view, metric, spread) where classes differ by at least limit percentage points."""
    spreads = summary.groupBy("dataset_view").agg(*[(F.max(m) - F.min(m)).alias(m) for m in SPREAD_METRICS])
    return spreads.unpivot("dataset_view", list(SPREAD_METRICS), "metric", "spread").where(F.col("spread") >= limit)


def source_purity(rows: DataFrame) -> DataFrame:
    """One row: whether every (view, source) has a single label."""
    groups = rows.groupBy("dataset_view", "source").agg((F.min("label") == F.max("label")).alias("pure"))
    return groups.agg(F.coalesce(F.bool_and("pure"), F.lit(False)).alias("source_confounded"))


def crosstab(df: DataFrame, row: str, column: str) -> DataFrame:
    """Long crosstab with margins: the cube of two keys, margins named All."""
    name = lambda c, bit: F.when((F.col("g").bitwiseAND(bit)) != 0, "All").otherwise(F.col(c))
    found = df.where(F.col(row).isNotNull() & F.col(column).isNotNull()).cube(row, column).agg(F.grouping_id().alias("g"), F.count(F.lit(1)).alias("n"))
    return found.select(name(row, 2).alias(row), name(column, 1).alias(column), "n")


def crosstab_wide(df: DataFrame, rows: Sequence[str], column: str, values: Sequence[str]) -> DataFrame:
    """Wide crosstab over known column values, with their sum."""
    wide = df.groupBy(*rows).pivot(column, list(values)).count().fillna(0)
    return wide.withColumn("All", sum((F.col(f"`{v}`") for v in values), F.lit(0)))
