"""Sealed tables against plain comparison, what is read of them, and the cuts that round 2 left."""

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from sievework.functions import urls
from sievework.operators import integrity, seals


def rows_of(spark, n):
    return spark.range(n).select("id", F.concat(F.lit("v"), F.col("id")).alias("v"), F.when(F.col("id") % 3 == 0, F.lit(None)).otherwise(F.col("id") * 0.5).alias("x"))


def test_difference_names_the_changed_rows_and_reads_their_prefixes_only(spark, tmp_path):
    rows = rows_of(spark, 20_000)
    old = seals.write_seal(rows, f"{tmp_path}/old")
    later = rows.where("id <> 17").withColumn("v", F.when(F.col("id") == 4321, "other").otherwise(F.col("v"))).unionByName(rows_of(spark, 1).withColumn("id", F.lit(-5).cast("long")))
    new = seals.write_seal(later, f"{tmp_path}/new")
    found = {(r.id, r.change) for r in seals.difference(old, new, "id").collect()}
    assert found == {(17, "removed"), (4321, "changed"), (-5, "added")}
    prefixes = [r.prefix for r in seals.differing_prefixes(old, new).collect()]
    assert 1 <= len(prefixes) <= 4
    within = seals.rows_within(old, prefixes)
    assert within.count() <= 10 and old.rows.count() == 20_000
    plan = within._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [_bucket" in plan


def test_roots_do_not_depend_on_layout_and_tell_tables_apart(spark, tmp_path):
    rows = rows_of(spark, 500)
    a = seals.write_seal(rows.repartition(7), f"{tmp_path}/a").root()
    b = seals.write_seal(rows.orderBy(F.desc("id")), f"{tmp_path}/b").root()
    c = seals.write_seal(rows.unionByName(rows.limit(1)), f"{tmp_path}/c").root()
    assert a == b and a[0] == 500 and c[0] == 501 and c[1] != a[1]
    again = seals.read_seal(spark, f"{tmp_path}/a", rows.schema.add("_digest", "string"))
    assert again.root() == a and seals.difference(again, again, "id").count() == 0


def test_empty_tables(spark, tmp_path):
    rows = rows_of(spark, 3)
    none = seals.write_seal(rows.where("false"), f"{tmp_path}/none")
    some = seals.write_seal(rows, f"{tmp_path}/some")
    assert none.root() == (0, "")
    assert {(r.id, r.change) for r in seals.difference(none, some, "id").collect()} == {(0, "added"), (1, "added"), (2, "added")}


def test_two_digests_of_a_new_id_are_an_error(spark):
    history = spark.createDataFrame([("a", "1")], "snapshot_id string, sha256 string")
    for rows in ([("b", "1"), ("b", "2")], [("a", "2")], [("b", None), ("b", "2")]):
        with pytest.raises(PySparkException):
            integrity.register_history(history, spark.createDataFrame(rows, history.schema)).collect()
    fine = integrity.register_history(history, spark.createDataFrame([("a", "1"), ("b", None), ("b", None), ("c", "3")], history.schema))
    assert sorted((r.snapshot_id, r.sha256 or "") for r in fine.collect()) == [("a", "1"), ("b", ""), ("c", "3")]


def test_long_texts_after_an_escape_stay_whole(spark):
    text = "a%2f" + "x" * 20_000 + "%zz%e"
    found = spark.createDataFrame([(text,), ("%",), (None,)], "u string").select(urls.upper_percent(F.col("u")).alias("u")).collect()
    assert [r.u for r in found] == ["a%2F" + "x" * 20_000 + "%ZZ%E", "%", None]
