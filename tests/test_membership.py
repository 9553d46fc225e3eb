"""The three ways of attaching a dimension give the same rows; what is shuffled is as stated."""

import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from sievework.operators import intel, membership

KEYS = 20_000
#: Limits that force each way: all fits; only the filter and what is found; only the filter; nothing.
LIMITS = {"broadcast": 1 << 40, "found": 2_000_000, "travel": 40_000, "shuffle": 10}


@pytest.fixture(scope="module")
def tables(spark):
    side = spark.range(KEYS).select(F.concat(F.lit("k"), F.col("id")).alias("name"), (F.col("id") * 3).alias("payload"))
    side = side.unionByName(spark.createDataFrame([(None, 1), ("k7", -1)], "name string, payload long"))
    hosts = F.when(F.col("id") % 2 == 0, F.lit("k5")).when(F.col("id") % 11 == 0, F.lit(None)).otherwise(F.concat(F.when(F.col("id") % 5 == 1, "k").otherwise("miss"), F.col("id").cast("string")))
    rows = spark.range(12_000).select("id", hosts.alias("host"))
    return rows, side


def counted(df):
    return Counter(map(tuple, df.select("id", "host", "payload").collect()))


def test_all_ways_give_the_rows_of_a_left_join(spark, tables):
    rows, side = tables
    want = counted(rows.join(side, F.col("host") == F.col("name"), "left"))
    for name, limit in LIMITS.items():
        assert counted(membership.attach(rows, F.col("host"), side, "name", limit=limit)) == want, name


def exchanges(df):
    """What the plan hashes into a shuffle, without the broadcasts."""
    plan = df._jdf.queryExecution().executedPlan().toString()
    return re.findall(r"(?<!Broadcast)Exchange (hashpartitioning\([^)]*)", plan)


def test_rows_without_a_possible_hit_are_not_shuffled(spark, tables):
    rows, side = tables
    for name in ("broadcast", "found"):
        assert not exchanges(membership.attach(rows, F.col("host"), side, "name", limit=LIMITS[name])), name
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        found = membership.attach(rows, F.col("host"), side, "name", limit=LIMITS["travel"])
        found.collect()
        plan = found._jdf.queryExecution().executedPlan().toString()
        below = re.findall(r"(?<!Broadcast)Exchange hashpartitioning\(_want.*\n(.*\n){8}", plan)
        assert len(exchanges(found)) >= 2 and "forall" in plan and below
        travelled = membership.bloom_filter(side, "name", KEYS).may_hold(rows, "host").where("_may").count()
        assert travelled < 0.65 * rows.count()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_a_hot_host_does_not_travel_by_shuffle(spark, tables):
    rows, side = tables
    bloom = membership.bloom_filter(side, "name", KEYS)
    marked = bloom.may_hold(rows.withColumn("_want", F.col("host")), "_want")
    found = rows.groupBy("host").agg(F.count(F.lit(1)).alias("_n")).join(side, F.col("host") == F.col("name")).select(F.col("name").alias("_key"), "payload", "_n")
    out = membership._travel(marked, found, 12_000)
    assert counted(out) == counted(rows.join(side, F.col("host") == F.col("name"), "left"))
    assert found.where(F.col("_n") * membership.HOT_SHARE > 12_000).select("_key").distinct().collect() == [("k5",)]


@pytest.mark.parametrize("rate", [0.1, 0.01, 0.001])
def test_the_filter_misses_no_key_and_keeps_its_rate(spark, rate):
    keys = spark.range(60_000).select(F.concat(F.lit("h"), F.col("id")).alias("name"))
    bloom = membership.bloom_filter(keys, "name", 60_000, rate)
    assert bloom.may_hold(keys, "name").where("not _may").count() == 0
    others = spark.range(200_000).select(F.concat(F.lit("other"), F.col("id")).alias("name"))
    measured = bloom.may_hold(others, "name").where("_may").count() / 200_000
    assert measured <= rate * 1.3
    assert bloom.words.count() <= bloom.buckets == membership.filter_size(60_000, rate)[0]


def test_nulls_and_empty_sides(spark, tables):
    rows, side = tables
    nothing = side.where("false")
    for limit in LIMITS.values():
        found = membership.attach(rows, F.col("host"), nothing, "name", limit=limit)
        assert found.count() == 12_000 and found.where("payload is not null").count() == 0
    assert membership.attach(rows.where("false"), F.col("host"), side, "name", limit=LIMITS["travel"]).count() == 0


def test_lookups_by_all_ways(spark):
    index = spark.createDataFrame([("a", f"h{i}.example", "t") for i in range(3000)] + [("b", "x.example", "u")], "provider string, indicator string, timestamp string")
    hosts = F.when(F.col("id") % 2 == 0, "H1.example.").when(F.col("id") % 7 == 0, "").otherwise(F.concat(F.lit("h"), (F.col("id") * 10).cast("string"), F.lit(".example")))
    rows = spark.range(2000).select("id", hosts.alias("hostname"), F.lit("x.example").alias("registrable_domain"))
    results = [
        {r.id: (r.a, r.b) for r in intel.lookup_url(intel.lookup(rows, index, "hostname", "a", out="p", limit=limit), index, "hostname", "registrable_domain", "b", limit=limit).select("id", F.col("p.status").alias("a"), F.col("ti.confidence").alias("b")).collect()}
        for limit in (1 << 40, 100_000, 9_000, 10)
    ]
    assert all(r == results[0] for r in results) and len(results[0]) == 2000
    assert results[0][0] == ("KNOWN_MALICIOUS", "DOMAIN_MATCH") and results[0][7][0] == "ERROR" and results[0][1999][0] == "UNKNOWN"
