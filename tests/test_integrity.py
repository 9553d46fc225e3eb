import copy
import json

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from sievework.operators import integrity as I
from sievework.sources import sinks


def test_digests_do_not_depend_on_order(spark):
    rows = spark.range(500).select("id", F.when(F.col("id") % 5 > 0, F.col("id").cast("string")).alias("t"), F.lit("V").alias("dataset_view"))
    one = I.manifest(rows.repartition(1), ["id", "t"]).first()
    many = I.manifest(rows.orderBy(F.col("id").desc()).repartition(7), ["id", "t"]).first()
    assert one == many and one.rows == 500
    other = I.manifest(rows.withColumn("t", F.coalesce("t", F.lit(""))), ["id", "t"]).first()
    assert other.sha256 != one.sha256
    assert len(I.combined_digest(I.manifest(rows, ["id"])).first()[0]) == 64
    assert I.assignment_digest(rows.withColumn("registrable_domain", F.col("t"))).first().rows == 401


def test_seal():
    a = {"rows": 1, "creationTime": "x"}
    assert I.seal_manifest(None, a) == a and I.seal_manifest(a, a | {"creationTime": "y"}) == a
    with pytest.raises(ValueError):
        I.seal_manifest(a, {"rows": 2})


def test_staleness(spark):
    cases = [("2026-01-01", "2026-01-31", "FRESH"), ("2026-01-01", "2026-02-01", "STALE"), ("2026-01-01", "2026-06-30T00:00:00Z", "STALE"), ("2026-01-01", "2026-07-01", "OUTDATED"), ("2026-01-02", "2026-01-01", "UNKNOWN"), ("bad", "2026-01-01", "UNKNOWN"), (None, "2026-01-01", "UNKNOWN")]
    df = spark.createDataFrame([(i, a, b) for i, (a, b, _) in enumerate(cases)], "i int, a string, b string")
    for r in df.select("i", I.staleness(F.col("a"), F.col("b")).alias("s")).collect():
        assert r.s == cases[r.i][2]


def test_history(spark):
    schema = "snapshot_id string, sha256 string"
    old = spark.createDataFrame([("a", "1")], schema)
    new = spark.createDataFrame([("a", "1"), ("b", "2"), ("b", "2")], schema)
    assert sorted(r.snapshot_id for r in I.register_history(old, new).collect()) == ["a", "b"]
    with pytest.raises(PySparkException):
        I.register_history(old, spark.createDataFrame([("a", "9")], schema)).collect()
    assert [r.previous for r in I.history_summary(spark.createDataFrame([("a", 1), ("b", 2)], "snapshot_id string, seq int")).orderBy("seq").collect()] == [None, "a"]
    merged = I.upsert(spark.createDataFrame([(1, "x"), (2, "y")], "k int, v string"), spark.createDataFrame([(2, "z")], "k int, v string"), ["k"])
    assert sorted(map(tuple, merged.collect())) == [(1, "x"), (2, "z")]


def test_bundle():
    bundle = I.build_bundle(["A" * 64, "a" * 64, "b" * 64], "2026-01-01", "V2")
    digest = bundle["integrity"]["canonicalDigest"]
    assert I.verify_bundle(bundle) == (True, "ok", digest) == I.verify_bundle(json.loads(I.canonical_json(bundle)))
    assert I.bundle_summary(bundle) == {"bundleVersion": "ti-bundle-v1", "createdAt": "2026-01-01", "policyVersion": "V2", "indicatorCount": 2, "brandCount": 54, "shortenerCount": 26, "canonicalDigest": digest}

    def broken(change):
        b = copy.deepcopy(bundle)
        change(b)
        return I.verify_bundle(b)[1]

    def resealed(change):
        def run(b):
            change(b["payload"])
            b["integrity"]["canonicalDigest"] = I.payload_digest(b["payload"])

        return broken(run)

    assert I.verify_bundle([]) == (False, "bundle_not_an_object", "") == I.verify_bundle(None)
    assert broken(lambda b: b.update(bundleVersion=1)) == "unsupported_bundle_version"
    assert broken(lambda b: b.update(payload=1)) == "missing_payload"
    assert broken(lambda b: b.pop("integrity")) == "missing_integrity_block"
    assert broken(lambda b: b["integrity"].update(algorithm="md5")) == "missing_integrity_block"
    assert broken(lambda b: b["payload"].update(x={1})) == "payload_not_canonicalisable"
    assert broken(lambda b: b["payload"]["threatIntel"]["indicatorDigests"].pop()) == "integrity_digest_mismatch"
    assert resealed(lambda p: p.pop("brands")) == "missing_payload_sections"
    assert resealed(lambda p: p["threatIntel"].update(indicatorCount=9)) == "indicator_count_mismatch"
    assert resealed(lambda p: p["threatIntel"].update(indicatorCount="2")) == "ok"
    assert resealed(lambda p: p["brands"].update(entries=None)) == "catalog_payload_invalid"
    # The first reason in order counts.
    assert broken(lambda b: b.update(bundleVersion=1, payload=1)) == "unsupported_bundle_version"
    assert resealed(lambda p: (p.pop("brands"), p["threatIntel"].update(indicatorCount=9))) == "missing_payload_sections"
    for bad in ({"x": 1.5}, {"x": "é"}, {"é": 1}, [{"x": (1,)}]):
        assert I._unfit(bad)
    with pytest.raises(ValueError):
        I.build_bundle(["nope"], "d", "p")


def test_small_documents(tmp_path):
    path = f"{tmp_path}/m.json"
    sinks.update_snapshot_metadata(path, "b", {"sha256": "1"})
    sinks.update_snapshot_metadata(path, "a", {"sha256": "2"})
    assert [s["source"] for s in sinks.update_snapshot_metadata(path, "b", {"sha256": "1"})["sources"]] == ["a", "b"]
    with pytest.raises(ValueError):
        sinks.update_snapshot_metadata(path, "b", {"sha256": "9"})
    assert sinks.record_acquisition(f"{tmp_path}/s.json", "x", {"ok": True}) == {"x": {"ok": True}}
    sinks.archive_metadata(str(tmp_path), {"version": "1"})
    sinks.archive_metadata(str(tmp_path), {"version": "2"})
    assert json.load(open(f"{tmp_path}/archive/dataset_metadata_1.json"))["version"] == "1"
