"""Cleaning, de-duplication, conflict audits and views.

"First" always means the smallest value of an order column, which comes from the data. Keep-first filters a row
number to 1, which Spark limits within map tasks already, and conflicts are found by aggregates with map-side
combining, so a key that holds a large share of the rows does not meet in one task.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.constants import APPROVED_FULL_URL, LABELS, MIN_NORMALIZED_LENGTH, PHISHING_SOURCES
from ..functions.urls import domain_url, strip, with_normalized

REQUIRED = ("url", "label", "source", "collected_at")


def keep_first(df: DataFrame, keys: Sequence[str], order: str = "ord") -> DataFrame:
    """One row per key, null keys included: that with the smallest order value."""
    by = Window.partitionBy(*keys).orderBy(order)
    return df.withColumn("_row", F.row_number().over(by)).where("_row = 1").drop("_row")


def conflict_keys(df: DataFrame, key: str) -> DataFrame:
    """Keys that occur with more than one label."""
    found = df.where(F.col(key).isNotNull()).groupBy(key).agg(F.min("label").alias("_low"), F.max("label").alias("_high"))
    return found.where("_low <> _high").select(key)


def split_conflicts(df: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """(rows without conflict, rows of conflicting keys)."""
    keys = conflict_keys(df, key)
    return df.join(keys, key, "left_anti"), df.join(keys, key, "left_semi")


def first_of_agreeing(df: DataFrame, key: str, order: str = "ord") -> DataFrame:
    """The first row of each key whose rows agree on the label, by one aggregate with map-side combining."""
    found = df.groupBy(key).agg(F.min_by(F.struct("*"), order).alias("_first"), F.min("label").alias("_low"), F.max("label").alias("_high"))
    return found.where("_low = _high").select("_first.*")


@dataclass(frozen=True)
class Cleaned:
    clean: DataFrame
    conflicts: DataFrame


def _prepared(raw: DataFrame) -> DataFrame:
    missing = sorted(set(REQUIRED) - set(raw.columns))
    if missing:
        raise ValueError(f"Missing columns: {missing}")
    return raw.withColumns({"url": strip(F.col("url")), "label": F.upper(strip(F.col("label"))), "source": strip(F.col("source"))})


_EMPTY = "url is null or url = '' or source is null or source = ''"


def _normalised(raw: DataFrame, order: str) -> DataFrame:
    """Rows that survive until normalisation; normalized_url is null where the URL is rejected."""
    rows = _prepared(raw).where(f"not ({_EMPTY})").where(F.col("label").isin(*LABELS))
    rows = with_normalized(keep_first(rows, ["url", "label"], order))
    return rows.withColumn("normalized_url", F.when(F.length("normalized_url") >= MIN_NORMALIZED_LENGTH, F.col("normalized_url")))


def clean(raw: DataFrame, order: str = "ord") -> Cleaned:
    """The cleaning pipeline in its contractual order.

    Trim; drop empty urls and sources, invalid labels, exact (url, label) copies; normalise and drop rejected or
    short urls; take out every row of a normalised url with several labels; drop normalised copies.
    """
    valid = _normalised(raw, order).where("normalized_url is not null")
    return Cleaned(first_of_agreeing(valid, "normalized_url", order), split_conflicts(valid, "normalized_url")[1])


def cleaning_stats(raw: DataFrame, order: str = "ord") -> DataFrame:
    """One row of removal counters and class counts, from one aggregation of the raw rows and one of the valid."""
    empty, bad = F.expr(_EMPTY), ~F.col("label").isin(*LABELS)
    first = _prepared(raw).agg(
        F.count(F.lit(1)).alias("raw_rows"),
        F.count_if(empty).alias("removed_empty"),
        F.count_if(~empty & F.coalesce(bad, F.lit(True))).alias("removed_invalid_label"),
    )
    groups = _normalised(raw, order).groupBy("normalized_url").agg(F.count(F.lit(1)).alias("n"), F.min("label").alias("low"), F.max("label").alias("high"))
    null, conflict = F.col("normalized_url").isNull(), F.col("low") != F.col("high")
    total = lambda test, value: F.coalesce(F.sum(F.when(test, value)), F.lit(0)).cast("long")
    then = groups.agg(
        F.coalesce(F.sum("n"), F.lit(0)).cast("long").alias("distinct_rows"),
        total(null, F.col("n")).alias("removed_invalid_urls"),
        total(~null & conflict, F.col("n")).alias("removed_conflicts"),
        total(~null & ~conflict, F.col("n") - 1).alias("removed_normalized_duplicates"),
        F.count_if(~null & ~conflict).alias("remaining_rows"),
        *[F.count_if(~null & ~conflict & (F.col("low") == label)).alias(f"class_{label.lower()}") for label in LABELS],
    )
    both = first.crossJoin(then)
    exact = F.col("raw_rows") - F.col("removed_empty") - F.col("removed_invalid_label") - F.col("distinct_rows")
    return both.withColumn("removed_exact_duplicates", exact).drop("distinct_rows")


def domain_only_view(clean_rows: DataFrame, order: str = "ord", host: str = "registrable_domain") -> DataFrame:
    """One row per (domain URL, label) without domains of several labels."""
    rows = clean_rows.withColumns({"model_url": domain_url(F.col(host)), "dataset_view": F.lit("DOMAIN_ONLY")})
    return first_of_agreeing(rows, "model_url", order)


def approved_rows(rows: DataFrame, pairs: Sequence[tuple[str, str]] = APPROVED_FULL_URL) -> DataFrame:
    """Rows of the given (label, source) pairs."""
    return rows.where(F.struct("label", "source").isin(*[F.struct(F.lit(a), F.lit(b)) for a, b in pairs]))


def full_url_view(clean_rows: DataFrame, approved: Sequence[tuple[str, str]] = APPROVED_FULL_URL, order: str = "ord") -> DataFrame:
    """One row per (normalised URL, label) of the approved (label, source) pairs; conflicts stay."""
    rows = approved_rows(clean_rows, approved).withColumns({"model_url": F.col("normalized_url"), "dataset_view": F.lit("FULL_URL")})
    return keep_first(rows, ["model_url", "label"], order)


def domain_label_conflicts(clean_rows: DataFrame) -> DataFrame:
    """Rows of registrable domains with several labels; a report only."""
    return split_conflicts(clean_rows, "registrable_domain")[1]


def multi_source_domains(rows: DataFrame, sources: Sequence[str] = PHISHING_SOURCES, key: str = "registrable_domain") -> DataFrame:
    """Domains that several of the sources list."""
    found = rows.where(F.col("source").isin(*sources)).groupBy(key).agg(F.min("source").alias("low"), F.max("source").alias("high"))
    return found.where("low <> high").select(key)


def cross_source_audit(rows: DataFrame, sources: Sequence[str] = PHISHING_SOURCES) -> DataFrame:
    """One row: conflicting URLs and their rows, and domains that several sources list."""
    groups = rows.groupBy("normalized_url").agg(F.count(F.lit(1)).alias("n"), F.min("label").alias("low"), F.max("label").alias("high"))
    both = F.col("low") != F.col("high")
    left = groups.agg(F.count_if(both).alias("conflicting_urls"), F.coalesce(F.sum(F.when(both, F.col("n"))), F.lit(0)).cast("long").alias("conflicting_rows"))
    return left.crossJoin(multi_source_domains(rows, sources).agg(F.count(F.lit(1)).alias("multi_source_domains")))


def accumulate(snapshots: DataFrame, url: str = "url", date: str = "snapshot_date") -> DataFrame:
    """Each normalised URL of dated snapshots once, with its first date."""
    distinct = snapshots.groupBy(F.col(url).alias("url")).agg(F.min(date).alias("first_"))
    rows = with_normalized(distinct).where("normalized_url is not null")
    return rows.groupBy("normalized_url", "registrable_domain").agg(F.min("first_").alias("first_snapshot_date"))


def accumulation_counts(snapshots: DataFrame, url: str = "url") -> DataFrame:
    """One row of counters of an accumulation."""
    distinct = snapshots.groupBy(F.col(url).alias("url")).agg(F.count(F.lit(1)).alias("rows_"))
    rows = with_normalized(distinct).groupBy("normalized_url", "registrable_domain").agg(F.sum("rows_").alias("n"))
    valid = F.col("normalized_url").isNotNull()
    rows = rows.groupBy("registrable_domain").agg(F.sum("n").alias("n"), F.count_if(valid).alias("urls"), F.coalesce(F.sum(F.when(valid, F.col("n"))), F.lit(0)).alias("valid"))
    long = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long")
    return rows.agg(
        long(F.col("n")).alias("total_raw"), long(F.col("n") - F.col("valid")).alias("invalid"), long(F.col("valid") - F.col("urls")).alias("duplicates"),
        long(F.col("urls")).alias("unique_urls"), F.count("registrable_domain").alias("unique_domains"),
    )


def domain_candidates(rows: DataFrame, url: str = "url", pool: int | None = 10_000, limit: int = 1_000, seed: int = 42, order: str = "ord") -> DataFrame:
    """Distinct domains of a list, in order: from the first pool of them (all without a pool), limit picked by hash."""
    from .sampling import order_key

    domain = F.substring_index(F.regexp_replace(url, "^[A-Za-z]+://", ""), "/", 1)
    found = rows.select(domain.alias("domain"), F.col(order)).where("domain <> ''").groupBy("domain").agg(F.min(order).alias(order))
    first = found if pool is None else found.orderBy(order, "domain").limit(pool)
    return first.orderBy(order_key(seed, F.col("domain")), "domain").limit(limit)
