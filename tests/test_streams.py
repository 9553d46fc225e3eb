"""Keyed state of streams: restarts, repeated and late rows, clashes and bounded state."""

import datetime
import shutil

import pytest
from pyspark.errors import StreamingQueryException
from pyspark.sql import functions as F

from sievework.streaming import incremental, state

SCHEMA = "url string, snapshot_date string, snapshot_id string, digest string, ts timestamp"


def day(n):
    return datetime.datetime(2026, 1, 1, tzinfo=datetime.timezone.utc) + datetime.timedelta(days=n)


def add(spark, path, rows):
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(f"{path}/in")


def accumulate(spark, path, **options):
    running = incremental.accumulate_into(incremental.read_snapshots(spark, f"{path}/in", SCHEMA), f"{path}/acc", f"{path}/s1", **options)
    running.awaitTermination()
    return running


def register(spark, path, **options):
    running = incremental.register_into(incremental.read_snapshots(spark, f"{path}/in", SCHEMA), f"{path}/reg", f"{path}/s2", **options)
    running.awaitTermination()
    return running


def test_first_dates_over_restarts_late_and_repeated_rows(spark, tmp_path):
    batches = [
        [("https://a.com", "2026-02-02", "x", "1", day(0)), ("https://A.com", "2026-02-03", "x", "1", day(0)), ("bad url", "2026-01-01", "y", "1", day(0))],
        [("https://a.com", "2026-01-01", "x", "1", day(1)), ("https://b.com", None, "z", "1", day(1))],
        [("https://a.com", "2026-01-01", "x", "1", day(1)), ("https://b.com", "2026-03-01", "z", "1", day(1))],
    ]
    for rows in batches:
        add(spark, tmp_path, rows)
        accumulate(spark, tmp_path)
    assert {tuple(r) for r in incremental.read_accumulated(spark, f"{tmp_path}/acc").collect()} == {("https://a.com", "2026-01-01"), ("https://b.com", "2026-03-01")}
    written = {r.batch: r.n for r in spark.read.parquet(f"{tmp_path}/acc").groupBy("batch").agg(F.count(F.lit(1)).alias("n")).collect()}
    assert written == {0: 1, 1: 2, 2: 1}  # a batch writes what changed and no more
    accumulate(spark, tmp_path)
    assert spark.read.parquet(f"{tmp_path}/acc").count() == 4


def test_a_batch_whose_commit_was_lost_is_repeated_without_a_change(spark, tmp_path):
    add(spark, tmp_path, [("https://a.com", "2026-02-02", "x", "1", day(0))])
    register(spark, tmp_path)
    add(spark, tmp_path, [("https://b.com", "2026-02-02", "y", "2", day(0)), ("https://b.com", "2026-02-02", "x", "1", day(0))])
    register(spark, tmp_path)
    before = sorted(r.snapshot_id for r in spark.read.parquet(f"{tmp_path}/reg").collect())
    for lost in (tmp_path / "s2/commits").glob("*1*"):
        lost.unlink()
    shutil.rmtree(tmp_path / "reg/batch=1")  # as if the run had ended before it wrote
    register(spark, tmp_path)
    assert sorted(r.snapshot_id for r in spark.read.parquet(f"{tmp_path}/reg").collect()) == before == ["x", "y"]


def test_another_digest_ends_the_stream(spark, tmp_path):
    add(spark, tmp_path, [("u", "d", "x", "1", day(0)), ("u", "d", "x", "1", day(0)), ("u", "d", "y", None, day(0))])
    register(spark, tmp_path, digest="digest")
    add(spark, tmp_path, [("u", "d", "x", "2", day(0))])
    with pytest.raises(StreamingQueryException, match="x is registered with another digest"):
        register(spark, tmp_path, digest="digest")
    assert sorted(r.snapshot_id for r in spark.read.parquet(f"{tmp_path}/reg").collect()) == ["x", "y"]


def test_two_digests_of_a_new_id_in_one_batch_end_the_stream(spark, tmp_path):
    add(spark, tmp_path, [("u", "d", "x", "1", day(0)), ("u", "d", "x", "2", day(0))])
    with pytest.raises(StreamingQueryException, match="another digest"):
        register(spark, tmp_path, digest="digest")


def test_a_watermark_bounds_the_state(spark, tmp_path):
    for n in range(0, 40, 10):
        add(spark, tmp_path, [(f"https://u{n}-{k}.com", "2026-01-01", f"{n}-{k}", "1", day(n)) for k in range(20)])
        running = accumulate(spark, tmp_path, watermark="2 days")
    rows = sum(op["numRowsTotal"] for p in running.recentProgress[-1:] for op in p["stateOperators"])
    assert rows <= 20 * 4  # value and timers of the last days' keys only
    assert incremental.read_accumulated(spark, f"{tmp_path}/acc").count() == 80
    assert state.retention("2 days", spark) == 2 * 86_400_000 and state.retention(None, spark) is None


def test_the_session_keeps_its_store(spark, tmp_path):
    before = spark.conf.get(state.PROVIDER)
    add(spark, tmp_path, [("https://a.com", "2026-02-02", "x", "1", day(0))])
    accumulate(spark, tmp_path)
    assert spark.conf.get(state.PROVIDER) == before
