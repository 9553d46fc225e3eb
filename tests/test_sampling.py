import hashlib
import math
from collections import Counter

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from sievework.operators import sampling


@pytest.fixture(scope="module")
def rows(spark):
    return spark.range(1200).select(F.col("id").alias("ord"), (F.col("id") % 36).alias("grp"), F.element_at(F.array(F.lit("BENIGN"), F.lit("PHISHING"), F.lit("MALWARE")), (F.col("id") % 3).cast("int") + 1).alias("label"), F.concat(F.lit("s"), (F.col("id") % 5).cast("string")).alias("source")).cache()


def test_caps_hold_and_do_not_depend_on_partitions(spark, rows):
    one = {r.ord for r in sampling.sample_per_class(rows.repartition(1), 50).collect()}
    many = {r.ord for r in sampling.sample_per_class(rows.repartition(9), 50).collect()}
    assert one == many and len(one) == 150


def test_capped_source_sample(spark):
    counts = {"a": 10_000, "b": 106, "c": 15_000}
    parts = [spark.range(n).select((F.col("id") * 10 + k).alias("ord"), F.lit("PHISHING").alias("label"), F.lit(s).alias("source")) for k, (s, n) in enumerate(counts.items())]
    df = parts[0].unionByName(parts[1]).unionByName(parts[2])
    got = {r.source: r["count"] for r in sampling.capped_source_sample(df, "PHISHING", 20_000).groupBy("source").count().collect()}
    assert got == {"a": 10_000, "b": 106, "c": 9_894}
    with pytest.raises(ValueError):
        sampling.source_quotas(df, "PHISHING", 10, 0)


def test_group_split_is_deterministic_and_does_not_leak(spark, rows):
    a = {r.grp: r.split for r in sampling.group_split(rows.repartition(3), "grp").collect()}
    b = {r.grp: r.split for r in sampling.group_split(rows.repartition(11), "grp").collect()}
    assert a == b and len(a) == 36 and set(a.values()) == set(sampling.PARTS)
    assigned = sampling.with_split(rows, sampling.group_split(rows, "grp"), "grp")
    assert sampling.leaking_groups(assigned, "grp").count() == 0
    labels = {(r.split, r.label) for r in assigned.select("split", "label").distinct().collect()}
    assert len(labels) == 9
    with pytest.raises(PySparkException):
        sampling.group_split(rows.where("grp < 3"), "grp").collect()
    with pytest.raises(ValueError):
        sampling.split_candidates(rows, "grp", (0.5, 0.1, 0.1))


def test_splits_by_boundary_buckets_equal_a_global_ranking(spark):
    """Many groups a bucket: 12,000 groups with 4096 prefixes, cuts within buckets."""
    df = spark.range(12_000).select((F.col("id") % 9_001).alias("grp"), F.when(F.col("id") % 3 == 0, "a").otherwise("b").alias("label"))
    ratios = (0.6, 0.25, 0.15)
    got = {(r.attempt, r.grp): r.split for r in sampling.split_candidates(df, "grp", ratios, attempts=3).collect()}
    labels = Counter((r.grp, r.label) for r in df.collect())
    held, test = math.ceil(9001 * 0.4 - 1e-9), math.ceil(math.ceil(9001 * 0.4 - 1e-9) * (0.15 / 0.4) - 1e-9)
    scores = {}
    for attempt in range(3):
        order = sorted(range(9_001), key=lambda g: (hashlib.sha256(f"{attempt + sampling.SEED}|{g}".encode()).hexdigest(), g))
        want = {g: "test" if k < test else "validation" if k < held else "train" for k, g in enumerate(order)}
        assert {g: got[attempt, g] for g in order} == want
        scores[attempt] = 0.0
        for part, ratio in zip(sampling.PARTS, ratios):
            n = Counter({x: sum(c for (g, y), c in labels.items() if y == x and want[g] == part) for x in "ab"})
            scores[attempt] += abs(sum(n.values()) / 12_000 - ratio) + sum(abs(n[x] / sum(n.values()) - sum(c for (_, y), c in labels.items() if y == x) / 12_000) for x in "ab")
    found = {r.attempt: r.score for r in sampling.split_scores(df, "grp", ratios, attempts=3).collect()}
    assert found == pytest.approx(scores, abs=1e-8)
    best = min(scores, key=lambda a: (round(scores[a], 9), a))
    assert {r.grp: r.split for r in sampling.group_split(df, "grp", ratios, attempts=3).collect()} == {g: got[best, g] for g in range(9_001)}


def test_artifact_control_ranks_by_prefix(spark):
    df = spark.range(3000).select(F.col("id").alias("ord"), F.lit("MALWARE").alias("label"), F.when(F.col("id") % 3 == 0, "a.com").otherwise("192.0.2.1").alias("hostname"))
    found = sampling.artifact_controlled(df)
    order = sorted((i for i in range(3000) if i % 3), key=lambda i: (hashlib.sha256(f"{sampling.SEED}|{i}".encode()).hexdigest(), i))
    assert {r.ord for r in found.where("hostname <> 'a.com'").collect()} == set(order[:1000])
    assert "windowspecdefinition(label" not in found._jdf.queryExecution().optimizedPlan().toString()


def test_temporal(spark):
    df = spark.createDataFrame([("2026-09-01T00:00:00",), ("2026-09-02",), ("bad",), (None,), ("2026-09-02x",)], "collected_at string")
    c = sampling.temporal_contract(df).first()
    assert (c.dates, c.test_date, c.status) == (2, "2026-09-02", "READY")
    assert {r.split: r["count"] for r in sampling.temporal_split(df).groupBy("split").count().collect()} == {"train": 1, "test": 2}
    one = df.limit(1)
    assert sampling.temporal_contract(one).first().status == "PENDING"
    with pytest.raises(PySparkException):
        sampling.temporal_split(one).collect()


def test_folds(spark, rows):
    folds = sampling.group_folds(rows, "grp", 5)
    sizes = sorted(r["count"] for r in folds.groupBy("fold").count().collect())
    assert sizes == [7, 7, 7, 7, 8]
    check = sampling.fold_check(rows, folds, "grp").first()
    assert (check.rows, check.held_out_once, check.crossing_groups) == (1200, 1200, 0)
    with pytest.raises(ValueError):
        sampling.group_folds(rows, "grp", 1)


def test_artifact_control_and_holdout(spark):
    rows = [(i, "MALWARE", "192.0.2.1" if i < 30 else "a.com") for i in range(40)] + [(100 + i, "BENIGN", "b.com") for i in range(5)]
    df = spark.createDataFrame(rows, "ord long, label string, hostname string")
    out = sampling.artifact_controlled(df).collect()
    assert sum(r.label == "MALWARE" and r.hostname == "a.com" for r in out) == 10 and sum(r.hostname == "192.0.2.1" for r in out) == 10 and sum(r.label == "BENIGN" for r in out) == 5
    with pytest.raises(ValueError):
        sampling.regime(df, "other", 5)
    split = spark.createDataFrame([("train", "x"), ("test", "x"), ("train", "y"), ("train", None)], "split string, source string")
    assert sampling.source_holdout(split, "x").count() == 3
