"""Range and positional joins against nested loops."""

import random

import pytest
from pyspark.sql import functions as F

from sievework.operators import joins


@pytest.mark.parametrize("closed", ["left", "right", "both", "neither"])
def test_range_join_equals_nested_loops(spark, closed):
    rng = random.Random(1)
    ivs = [(i, *sorted((rng.uniform(-50, 50), rng.uniform(-50, 50)))) for i in range(40)]
    ivs += [(100, None, -10.0), (101, 20.0, None), (102, None, None), (103, 5.0, 5.0), (104, 1.0, 1.0 + 1e-12), (105, -1e18, 1e18), (106, 7.0, 3.0), (107, 0.0, 0.0), (108, 1e9, 2e9)]
    values = [(k, rng.choice([rng.uniform(-60, 60), 5.0, 1.0, 0.0, 20.0, -10.0])) for k in range(200)] + [(900, None), (901, float("nan")), (902, 1.5e9), (903, -1e17)]
    want = set()
    for k, v in values:
        for i, a, b in ivs:
            if v is None or v != v:
                continue
            left = a is None or (v >= a if closed in ("left", "both") else v > a)
            right = b is None or (v <= b if closed in ("right", "both") else v < b)
            if left and right:
                want.add((k, i))
    df, iv = spark.createDataFrame(values, "k int, v double"), spark.createDataFrame(ivs, "i int, a double, b double")
    got = [(r.k, r.i) for r in joins.range_join(df, "v", iv, "a", "b", closed).collect()]
    assert len(got) == len(set(got)) and set(got) == want


def test_range_join_of_nothing(spark):
    df, iv = spark.createDataFrame([(1.0,)], "v double"), spark.createDataFrame([(0.0, 2.0)], "a double, b double")
    assert joins.range_join(df.where("false"), "v", iv, "a", "b").count() == 0
    assert joins.range_join(df, "v", iv.where("false"), "a", "b").count() == 0
    with pytest.raises(ValueError):
        joins.range_join(df, "v", iv, "a", "b", "upper")


def test_row_numbers_and_positional_join(spark):
    left = spark.range(5000).select(F.col("id").alias("a"), (F.col("id") * 7919 % 5003).alias("x")).repartition(9)
    numbered = joins.with_row_number(left, ["x"])
    assert [r.row_number for r in numbered.orderBy("x").collect()] == list(range(5000))
    right = spark.range(5000).select((-F.col("id")).alias("b")).repartition(4)
    both = joins.positional_join(left, right, ["x"], ["b"]).collect()
    order = sorted(r.a * 7919 % 5003 for r in both)
    assert all(order[r.row_number] == r.x and r.b == r.row_number - 4999 for r in both) and len(both) == 5000
    with pytest.raises(ValueError, match="by position"):
        joins.positional_join(left, right.limit(10), ["x"], ["b"])
    assert "Window" not in numbered._jdf.queryExecution().executedPlan().toString()
    assert joins.with_row_number(left.where("false"), ["x"]).count() == 0
