"""Merged sketches against exact results, within the stated errors."""

from pyspark.sql import functions as F

from sievework.operators import sketches


def test_merged_sketches_are_within_their_errors(spark, tmp_path):
    df = spark.range(60_000).select((F.col("id") % 3).alias("stage"), (F.col("id") % 7).alias("day"), F.concat(F.lit("h"), F.col("id") * 7919 % 20_011).alias("host"), (F.col("id") * 31 % 9973).cast("double").alias("length"))
    sketches.sketch(df, ["stage", "day"], "host", "length").write.parquet(f"{tmp_path}/sketches")
    stored = spark.read.parquet(f"{tmp_path}/sketches")
    assert stored.count() == 21
    for by in (["stage"], []):
        found = sketches.estimates(sketches.merge(stored, by), {"p10": 0.1, "p50": 0.5, "p99": 0.99})
        exact = {tuple(r[b] for b in by): r for r in df.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.count_distinct("host").alias("d")).collect()}
        rows = found.collect()
        assert len(rows) == len(exact)
        for r in rows:
            want = exact[tuple(r[b] for b in by)]
            assert r.n == want.n and abs(r.distinct_estimate / want.d - 1) < 0.05
            mine = df.where(F.col("stage") == r.stage) if by else df
            for name, p in (("p10", 0.1), ("p50", 0.5), ("p99", 0.99)):
                rank = mine.where(F.col("length") <= r[name]).count() / r.n
                assert abs(rank - p) < 0.0165 + 0.005


def test_nulls_nan_and_nothing(spark):
    df = spark.createDataFrame([("a", None, None), ("a", "x", float("nan")), ("b", "y", 2.0)], "g string, h string, v double")
    found = {r.g: r for r in sketches.estimates(sketches.sketch(df, ["g"], "h", "v"), {"mid": 0.5}).collect()}
    assert (found["a"].n, found["a"].distinct_estimate, found["a"].mid) == (2, 1, None)
    assert (found["b"].n, found["b"].distinct_estimate, found["b"].mid) == (1, 1, 2.0)
    assert sketches.sketch(df.where("false"), ["g"], "h", "v").count() == 0
