"""Deterministic sampling, capping and splitting.

Every choice orders rows by the SHA-256 of the seed and a key from the data, so it depends neither on
partitioning nor on the engine. Caps filter row numbers, which Spark limits within map tasks.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import PySparkValueError
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.constants import LARGE_SOURCES, MAX_SOURCE_SHARE, SEED, SOURCE_CAP_MULTIPLIER, SPLIT_RATIOS
from ..functions.urls import host_type
from ..storage import stored

PARTS = ("train", "validation", "test")


def order_key(seed: int | Column, key: Column) -> Column:
    seed = F.lit(str(seed)) if isinstance(seed, int) else seed.cast("string")
    return F.sha2(F.concat_ws("|", seed, key.cast("string")), 256)


def take_per_group(df: DataFrame, groups: Sequence[str], limit: Column | int, seed: int = SEED, key: str = "ord") -> DataFrame:
    """At most limit rows of each group, by hash order; null is a group of its own."""
    by = Window.partitionBy(*groups).orderBy(order_key(seed, F.col(key)), key)
    return df.withColumn("_row", F.row_number().over(by)).where(F.col("_row") <= limit).drop("_row")


def sample_per_class(df: DataFrame, target: int, seed: int = SEED, key: str = "ord") -> DataFrame:
    return take_per_group(df, ["label"], target, seed, key)


def preselect_sources(df: DataFrame, target: int, multiplier: int = SOURCE_CAP_MULTIPLIER, large: Sequence[str] = LARGE_SOURCES, seed: int = SEED, key: str = "ord") -> DataFrame:
    """Cut each large source to target * multiplier rows; other sources stay."""
    is_large = F.coalesce(F.col("source").isin(*large), F.lit(False))
    return df.where(~is_large).unionByName(take_per_group(df.where(is_large), ["source"], target * multiplier, seed, key))


def source_quotas(df: DataFrame, label: str, target: int, share: float = MAX_SOURCE_SHARE) -> DataFrame:
    """(source, quota): sources in order each take what the cap, their rows and the open target allow."""
    if not 0 < share <= 1:
        raise ValueError("share must be in (0, 1]")
    cap = max(1, int(target * share))
    counts = df.where(F.col("label") == label).groupBy("source").agg(F.count(F.lit(1)).alias("available"))
    counts = counts.withColumn("capped", F.least(F.col("available"), F.lit(cap)))
    before = Window.orderBy("source").rowsBetween(Window.unboundedPreceding, -1)
    open_ = F.greatest(F.lit(0), F.lit(target) - F.coalesce(F.sum("capped").over(before), F.lit(0)))
    return counts.withColumn("quota", F.least("capped", open_)).select("source", "available", F.col("quota").cast("long").alias("quota"))


def capped_source_sample(df: DataFrame, label: str, target: int, share: float = MAX_SOURCE_SHARE, seed: int = SEED, key: str = "ord") -> DataFrame:
    """A sample of one label in which no source exceeds its share of the target."""
    cap = max(1, int(target * share))
    rows = take_per_group(df.where(F.col("label") == label), ["source"], cap, seed, key)
    by = Window.partitionBy("source").orderBy(order_key(seed, F.col(key)), key)
    quotas = source_quotas(df, label, target, share).select(F.col("source").alias("_source"), "quota")
    joined = rows.join(quotas, F.col("source").eqNullSafe(F.col("_source"))).withColumn("_row", F.row_number().over(by))
    return joined.where("_row <= quota").drop("_row", "quota", "_source")


def artifact_controlled(df: DataFrame, host: str = "hostname", seed: int = SEED, key: str = "ord") -> DataFrame:
    """All rows but malware on IP hosts, of which as many stay as there is malware on domains."""
    kind = df.withColumn("_type", host_type(F.col(host)))
    malware, domain = F.col("label") == "MALWARE", F.col("_type") == "DOMAIN"
    on_ip = F.coalesce(malware & ~domain, F.lit(False))
    limit = kind.agg(F.count_if(malware & domain).alias("_limit"))
    ranked = with_hash_rank(kind.where(on_ip).withColumn("_h", order_key(seed, F.col(key))), key)
    cut = ranked.crossJoin(F.broadcast(limit)).where("_rank < _limit")
    return kind.where(~on_ip).drop("_type").unionByName(cut.drop("_type", "_rank", "_n", "_limit"))


def regime(df: DataFrame, name: str, target: int, host: str = "hostname", seed: int = SEED, key: str = "ord") -> DataFrame:
    """natural: a sample per class. artifact_controlled: that of the other classes and controlled malware."""
    if name == "natural":
        return sample_per_class(df, target, seed, key)
    if name != "artifact_controlled":
        raise ValueError(f"no regime {name}")
    malware = F.coalesce(F.col("label") == "MALWARE", F.lit(False))
    controlled = sample_per_class(artifact_controlled(df.where(malware), host, seed, key), target, seed, key)
    return sample_per_class(df.where(~malware), target, seed, key).unionByName(controlled)


def with_hash_rank(df: DataFrame, key: str, by: Sequence[str] = ()) -> DataFrame:
    """Add _rank (from 0, by the hash _h and key, within by) and _n (rows within by).

    A rank is the number of rows of lower hash prefixes, of which there are 4096 whatever the size, plus a row number
    within the prefix. So the work spreads over prefixes and no task sees all rows.
    """
    df = df.withColumn("_p", F.substring("_h", 1, 3))
    counts = df.groupBy(*by, "_p").agg(F.count(F.lit(1)).alias("_c"))
    whole = Window.partitionBy(*by)
    below = whole.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select(*by, "_p", F.coalesce(F.sum("_c").over(below), F.lit(0)).alias("_below"), F.sum("_c").over(whole).alias("_n"))
    within = F.row_number().over(Window.partitionBy(*by, "_p").orderBy("_h", key)) - 1
    return df.join(counts, [*by, "_p"]).withColumn("_rank", within + F.col("_below")).drop("_p", "_h", "_below")


#: Hex digits of the hash prefixes by which groups are counted: 4096 buckets an attempt, whatever the size.
PREFIX = 3


def _parts(ratios: Sequence[float], total: Column) -> tuple[Column, Column]:
    """How many groups are the test, and how many are held out of training in all."""
    held = F.ceil(total * (ratios[1] + ratios[2]) - 1e-9)
    return F.ceil(held * (ratios[2] / (ratios[1] + ratios[2])) - 1e-9), held


def _tried(groups: DataFrame, group: str, seed: int, attempts: int) -> DataFrame:
    """Every group for every attempt with its hash and the hash's prefix; rows leave their tasks only when counted or cut down."""
    rows = groups.withColumn("attempt", F.explode(F.sequence(F.lit(0), F.lit(attempts - 1))))
    rows = rows.withColumn("_h", order_key(F.col("attempt") + seed, F.col(group)))
    return rows.withColumn("_p", F.substring("_h", 1, PREFIX))


def _cuts(buckets: DataFrame, ratios: Sequence[float]) -> DataFrame:
    """One row an attempt: the bucket that holds each cut and how many of its groups lie before it.

    buckets is (attempt, _p, n), of at most 4096 rows an attempt.
    """
    order = Window.partitionBy("attempt").orderBy("_p")
    rows = buckets.withColumns({"_to": F.sum("n").over(order.rowsBetween(Window.unboundedPreceding, 0)), "_all": F.sum("n").over(Window.partitionBy("attempt"))})
    test, held = _parts(ratios, F.col("_all"))

    def at(cut: Column, name: str) -> list[Column]:
        inside = (F.col("_to") - F.col("n") < cut) & (cut <= F.col("_to"))
        bucket = F.coalesce(F.max(F.when(inside, F.col("_p"))), F.lit(""))
        left = F.coalesce(F.max(F.when(inside, cut - F.col("_to") + F.col("n"))), F.lit(0))
        return [bucket.alias(f"_{name}_p"), left.cast("long").alias(f"_{name}_n")]

    return rows.groupBy("attempt").agg(*at(test, "test"), *at(held, "held"), F.max("_all").alias("_groups"))


def _split_of(p: Column, rank: Column) -> Column:
    """The split by prefix and, in the buckets of the cuts, the rank from 0 within the bucket."""
    before = lambda name: (p < F.col(f"_{name}_p")) | ((p == F.col(f"_{name}_p")) & (rank < F.col(f"_{name}_n")))
    return F.when(before("test"), "test").when(before("held"), "validation").otherwise("train")


def _at_cut() -> Column:
    return F.col("_p").isin(F.col("_test_p"), F.col("_held_p"))


def _settled(tried: DataFrame, cuts: DataFrame, group: str) -> DataFrame:
    """tried with its split: by the prefix alone, but in the buckets of the cuts, where groups are ranked."""
    rows = tried.join(F.broadcast(cuts), "attempt")
    plain = rows.where(~_at_cut()).withColumn("split", _split_of(F.col("_p"), F.lit(0)))
    return plain.select(*tried.columns, "split").unionByName(_ranked(rows, group).select(*tried.columns, "split"))


def _ranked(rows: DataFrame, group: str) -> DataFrame:
    """The rows in the buckets of the cuts with their split, by their rank within the bucket."""
    within = F.row_number().over(Window.partitionBy("attempt", "_p").orderBy("_h", group)) - 1
    ranked = rows.where(_at_cut()).withColumn("_rank", within)
    return ranked.withColumn("split", _split_of(F.col("_p"), F.col("_rank")))


def _check_ratios(ratios: Sequence[float]) -> None:
    if abs(sum(ratios) - 1) > 1e-9:
        raise ValueError("ratios must sum to 1")


def split_candidates(df: DataFrame, group: str, ratios: Sequence[float] = SPLIT_RATIOS, seed: int = SEED, attempts: int = 64) -> DataFrame:
    """(attempt, group, split) of every group for each attempt, by hash rank within the attempt."""
    _check_ratios(ratios)
    groups = stored(df.where(F.col(group).isNotNull()).select(group).distinct(), "groups")
    tried = _tried(groups, group, seed, attempts)
    cuts = _cuts(tried.groupBy("attempt", "_p").agg(F.count(F.lit(1)).alias("n")), ratios)
    return _settled(tried, cuts, group).select("attempt", group, "split")


def _label_counts(df: DataFrame, group: str) -> DataFrame:
    """(group, labels): rows of each label by group, written once."""
    counts = df.where(F.col(group).isNotNull()).groupBy(group, "label").agg(F.count(F.lit(1)).alias("n"))
    return stored(counts.groupBy(group).agg(F.collect_list(F.struct("label", "n")).alias("labels")), "groups")


def split_scores(df: DataFrame, group: str, ratios: Sequence[float] = SPLIT_RATIOS, seed: int = SEED, attempts: int = 64) -> DataFrame:
    """(attempt, score): distance from the ratios, from the label mix, and five for each label that a part lacks."""
    _check_ratios(ratios)
    return _scored(_label_counts(df, group), group, ratios, seed, attempts)[0]


def _scored(groups: DataFrame, group: str, ratios: Sequence[float], seed: int, attempts: int) -> tuple[DataFrame, DataFrame]:
    """Scores and cuts of all attempts from _label_counts.

    Groups and label counts are summed by (attempt, prefix), so the attempts multiply 4096 buckets and no rows or
    groups; only the groups in a cut's bucket, one in some thousand, are ranked.
    """
    tried = _tried(groups, group, seed, attempts)
    entry = lambda of_groups, label, n: F.struct(F.lit(of_groups).alias("of_groups"), label.alias("label"), n.alias("n"))
    entries = F.concat(F.array(entry(True, F.lit(None).cast("string"), F.lit(1).cast("long"))), F.transform("labels", lambda x: entry(False, x.label.cast("string"), x.n)))
    cells = tried.select("attempt", "_p", F.explode(entries).alias("e")).groupBy("attempt", "_p", "e.of_groups", "e.label").agg(F.sum("e.n").alias("n"))
    cells = stored(cells, "cells")
    cuts = _cuts(cells.where("of_groups").select("attempt", "_p", "n"), ratios)
    cuts = groups.sparkSession.createDataFrame(cuts.collect(), cuts.schema)  # one row an attempt
    counted = cells.where("not of_groups").join(F.broadcast(cuts), "attempt").where(~_at_cut()).select("attempt", _split_of(F.col("_p"), F.lit(0)).alias("split"), "label", "n")
    near = _ranked(tried.join(F.broadcast(cuts), "attempt"), group)
    near = near.select("attempt", "split", F.explode("labels").alias("e")).select("attempt", "split", F.col("e.label").cast("string").alias("label"), F.col("e.n").alias("n"))
    sums = counted.unionByName(near).groupBy("attempt", "split", "label").agg(F.sum("n").alias("n"))
    return _scores_of(sums, cells, attempts, ratios), cuts


def _scores_of(sums: DataFrame, cells: DataFrame, attempts: int, ratios: Sequence[float]) -> DataFrame:
    """(attempt, score) from label counts by (attempt, split); cells of one attempt give those of the whole."""
    counts = cells.where("not of_groups and attempt = 0")
    total = counts.agg(F.sum("n").alias("_total"))
    whole = counts.groupBy("label").agg(F.sum("n").alias("_all"))
    ratio = F.create_map(*[F.lit(x) for pair in zip(PARTS, ratios) for x in pair])
    frame = whole.withColumn("attempt", F.explode(F.sequence(F.lit(0), F.lit(attempts - 1)))).withColumn("split", F.explode(F.array(*map(F.lit, PARTS))))
    rows = frame.join(sums, ["attempt", "split", "label"], "left").fillna(0, ["n"])
    part = Window.partitionBy("attempt", "split")
    rows = rows.withColumn("_part", F.sum("n").over(part)).crossJoin(F.broadcast(total))
    drift = F.abs(F.when(F.col("_part") > 0, F.col("n") / F.col("_part")).otherwise(0.0) - F.col("_all") / F.col("_total"))
    parts = rows.groupBy("attempt", "split").agg(
        (F.abs(F.first("_part") / F.first("_total") - F.try_element_at(ratio, F.col("split"))) + F.sum(drift) + 5 * F.count_if(F.col("n") == 0)).alias("s")
    )
    return parts.groupBy("attempt").agg(F.round(F.sum("s"), 9).alias("score"))


def group_split(df: DataFrame, group: str, ratios: Sequence[float] = SPLIT_RATIOS, seed: int = SEED, attempts: int = 64) -> DataFrame:
    """(group, split) of the attempt with the lowest score, the first of equals; needs four groups."""
    _check_ratios(ratios)
    groups = _label_counts(df, group)
    scores, cuts = _scored(groups, group, ratios, seed, attempts)
    if (cuts.agg(F.max("_groups")).first()[0] or 0) < 4:
        raise PySparkValueError("a split needs at least four groups")
    best = min((r.score, r.attempt) for r in scores.collect())[1]  # a row an attempt
    rows = groups.select(group, F.lit(best).alias("attempt")).withColumn("_h", order_key(best + seed, F.col(group))).withColumn("_p", F.substring("_h", 1, PREFIX))
    return _settled(rows, cuts.where(F.col("attempt") == best), group).select(group, "split")


def with_split(df: DataFrame, assignment: DataFrame, group: str) -> DataFrame:
    """Apply one assignment to a view; rows whose group has none go."""
    return df.join(assignment, group)


def leaking_groups(split_rows: DataFrame, group: str) -> DataFrame:
    """Groups that occur in more than one split; none is the contract."""
    found = split_rows.groupBy(group).agg(F.min("split").alias("low"), F.max("split").alias("high"))
    return found.where("low <> high").select(group)


def snapshot_day(value: Column) -> Column:
    day = F.substring(value.cast("string"), 1, 10)
    return F.when(day.rlike("^[0-9]{4}-[0-9]{2}-[0-9]{2}$"), day)


def temporal_contract(df: DataFrame, date: str = "collected_at") -> DataFrame:
    """One row: distinct valid days, first and last of them, and READY or PENDING."""
    days = df.select(snapshot_day(F.col(date)).alias("d")).where("d is not null").distinct()
    found = days.agg(F.count(F.lit(1)).alias("dates"), F.min("d").alias("first_date"), F.max("d").alias("test_date"))
    return found.withColumn("status", F.when(F.col("dates") >= 2, "READY").otherwise("PENDING"))


def rows_per_date(df: DataFrame, date: str = "collected_at") -> DataFrame:
    return df.select(snapshot_day(F.col(date)).alias("date")).where("date is not null").groupBy("date").agg(F.count(F.lit(1)).alias("n"))


def temporal_split(df: DataFrame, date: str = "collected_at") -> DataFrame:
    """Rows of the last day are the test, those of earlier days train; rows without a valid day go."""
    rows = df.withColumn("_day", snapshot_day(F.col(date))).where("_day is not null")
    contract = temporal_contract(df, date)
    ready = F.assert_true(F.col("status") == "READY", F.lit("a temporal split needs two dates")).isNull()
    out = rows.crossJoin(F.broadcast(contract.select("test_date", "status"))).where(ready)
    return out.withColumn("split", F.when(F.col("_day") == F.col("test_date"), "test").otherwise("train")).drop("_day", "test_date", "status")


def group_folds(df: DataFrame, group: str, k: int, seed: int = SEED) -> DataFrame:
    """(group, fold) by hash rank."""
    if k < 2:
        raise ValueError("k must be at least 2")
    groups = df.where(F.col(group).isNotNull()).select(group).distinct().withColumn("_h", order_key(seed, F.col(group)))
    return with_hash_rank(groups, group).select(group, (F.col("_rank") % k).cast("int").alias("fold"))


def fold_check(rows: DataFrame, folds: DataFrame, group: str) -> DataFrame:
    """One row: rows, rows held out exactly once, groups in several folds."""
    per_group = folds.groupBy(group).agg(F.count_distinct("fold").alias("folds"))
    joined = rows.groupBy(group).agg(F.count(F.lit(1)).alias("n")).join(per_group, group, "left")
    once = F.coalesce(F.sum(F.when(F.col("folds") == 1, F.col("n"))), F.lit(0)).cast("long")
    return joined.agg(F.coalesce(F.sum("n"), F.lit(0)).cast("long").alias("rows"), once.alias("held_out_once"), F.count_if(F.col("folds") > 1).alias("crossing_groups"))


def source_holdout(split_rows: DataFrame, source: str) -> DataFrame:
    """Take a source out of training and validation; the test stays whole."""
    return split_rows.where((F.col("split") == "test") | ~F.col("source").eqNullSafe(F.lit(source)))
