"""Exact quantiles by selection against sorted lists."""

import math
import random

import pytest

from sievework.operators import audit, metrics
from sievework.operators.quantiles import exact_quantiles

SHARES = {"low": 0.0, "q": 0.25, "mid": 0.5, "p95": 0.95, "top": 1.0}


def plain(values, p):
    values = sorted((v for v in values if v is not None), key=lambda v: (math.isnan(v), v))
    if not values:
        return None
    place = p * (len(values) - 1)
    a, b = values[math.floor(place)], values[math.ceil(place)]
    share = place - math.floor(place)
    return a if a == b or (math.isnan(a) and math.isnan(b)) else a * (1 - share) + b * share


def check(spark, groups):
    rows = [(g, v) for g, values in groups.items() for v in values]
    random.Random(1).shuffle(rows)
    found = {r.g: r for r in exact_quantiles(spark.createDataFrame(rows, "g string, v double"), ["v"], SHARES, ["g"]).collect()}
    assert set(found) == {g for g, values in groups.items() if any(v is not None for v in values)}
    for g, row in found.items():
        for name, p in SHARES.items():
            got, want = row[f"v_{name}"], plain(groups[g], p)
            assert got == pytest.approx(want, rel=1e-12, abs=1e-300, nan_ok=True), (g, name)


def test_ties_one_value_nan_infinities_and_a_group_of_most_rows(spark):
    rng = random.Random(2)
    inf, nan = float("inf"), float("nan")
    check(spark, {
        "most": [rng.choice([1.0, 2.0, 3.0, 1e9]) for _ in range(9000)],
        "ties": [5.0] * 100 + [7.0],
        "one": [42.5],
        "two": [-1.0, 4.0],
        "nan": [nan, 1.0, 2.0, nan, nan],
        "ends": [inf, -inf, 0.0, 1.0, inf],
        "nulls": [None, None],
        "some": [None, 3.0, None, -0.0, 0.0],
        None: [8.0, 9.0],
    })


def test_close_tiny_huge_and_skewed_values(spark):
    rng = random.Random(3)
    check(spark, {
        "normal": [rng.gauss(0, 1) for _ in range(999)],
        "close": [1 + k * 2.0**-52 for k in range(50)],
        "tiny": [rng.uniform(-1, 1) * 10.0 ** rng.randrange(-320, -290) for _ in range(300)],
        "huge": [rng.choice([-1, 1]) * 10.0 ** rng.randrange(0, 308) for _ in range(300)] + [1.7e308, -1.7e308],
        "scales": [rng.expovariate(1) ** 9 for _ in range(500)],
    })


def test_no_groups_several_columns_and_no_rows(spark):
    df = spark.createDataFrame([(float(k), k % 7) for k in range(101)], "a double, b int")
    row = exact_quantiles(df, ["a", "b"], {"p50": 0.5, "p90": 0.9}).first()
    assert (row.a_p50, row.a_p90, row.b_p50, row.b_p90) == (50.0, 90.0, 3.0, 6.0)
    empty = df.where("false")
    assert exact_quantiles(empty, ["a"], {"m": 0.5}, ["b"]).count() == 0
    assert metrics.token_statistics(empty, "a").first()["max"] is None
    with pytest.raises(ValueError):
        exact_quantiles(df, ["a"], {"x": 1.5})


def test_no_buffer_of_values_in_the_plans(spark):
    df = spark.createDataFrame([("x", float(k)) for k in range(50)], "g string, v double")
    for found in (metrics.latency_summary(df, "v", ["g"]), metrics.token_statistics(df, "v"), metrics.histogram(df, "v", 5)):
        plan = found._jdf.queryExecution().toString().lower()
        assert "percentile(" not in plan and "median(" not in plan
    assert audit.exact_quantiles is exact_quantiles
