import hashlib
import json

import pytest

from sievework.operators import integrity as I
from sievework.sources import bundles, feeds, imports


def made(day, *digests):
    return I.canonical_json(I.build_bundle([d * 64 for d in digests], day, "V2")).encode()


def test_store(tmp_path):
    shipped = tmp_path / "shipped.json"
    shipped.write_bytes(made("2026-01-01", "a"))
    store = bundles.BundleStore(f"{tmp_path}/store", str(shipped))
    assert store.load()[1].source == bundles.SHIPPED and store.roll_back().error == "no_previous_bundle"
    assert bundles.BundleStore(f"{tmp_path}/none").load() == (None, bundles.Status(bundles.NONE))

    first = store.put(made("2026-02-01", "b"))
    assert (first.source, first.snapshot_id, first.previous_id) == (bundles.IMPORTED, "ti-2026-02-01", None)
    second = store.put(made("2026-03-01", "b", "c"))
    assert second.previous_id == "ti-2026-02-01" and second.summary["indicatorCount"] == 2
    assert store.put(b"{").error == "bundle_not_an_object" == store.put(b"[]").error
    assert store.put(made("2026-04-01", "d").replace(b"d" * 64, b"e" * 64)).error == "integrity_digest_mismatch"
    assert store.load()[1].snapshot_id == "ti-2026-03-01"

    back = store.roll_back()
    assert (back.source, back.snapshot_id, back.previous_id) == (bundles.ROLLED_BACK, "ti-2026-02-01", "ti-2026-03-01")
    assert store.roll_back().snapshot_id == "ti-2026-03-01"

    good, bad = tmp_path / "good.json", tmp_path / "bad.json"
    good.write_bytes(made("2026-05-01", "f"))
    bad.write_bytes(b"{}")
    bundle, status = store.load((str(good), str(bad), f"{tmp_path}/absent.json"))
    assert bundle["createdAt"] == "2026-05-01" and status.error == "unsupported_bundle_version" and not good.exists() and bad.exists()

    (tmp_path / "store" / f"{status.sha256}.json").write_bytes(made("2026-05-01", "0"))
    bundle, status = store.load()
    assert (status.source, status.error, bundle["createdAt"]) == (bundles.ROLLED_BACK, "digest", "2026-01-01")
    assert store.load()[1].source == bundles.SHIPPED


def test_frozen_copy(tmp_path):
    (tmp_path / "a").write_bytes(b"x" * 3_000_000)
    digest = hashlib.sha256(b"x" * 3_000_000).hexdigest()
    bundles.copy_frozen(str(tmp_path), f"{tmp_path}/out", {"a": digest})
    assert bundles.file_digest(f"{tmp_path}/out/a") == digest
    with pytest.raises(ValueError):
        bundles.copy_frozen(str(tmp_path), f"{tmp_path}/out2", {"a": "0" * 64})


def test_import(spark, tmp_path):
    feed = tmp_path / "feed.txt"
    feed.write_text("https://a.com/x,\"y\"\nhttps://b.com\n")
    out = imports.import_feed(spark, "openphish", str(feed), str(tmp_path), "2026-01-02", snapshot=True)
    assert {r.url for r in feeds.read_any(spark, out).collect()} == {r.url for r in feeds.openphish(spark, str(feed), "2026-01-02").collect()}
    [entry] = json.loads((tmp_path / "snapshots/2026-01-02/snapshot_metadata.json").read_text())["sources"]
    assert entry["records"] == 2 and entry["sha256"] == bundles.file_digest(str(feed))
    assert imports.import_feed(spark, "openphish", str(feed), str(tmp_path), "2026-01-02", snapshot=True) == out
    feed.write_text("https://c.com\n")
    with pytest.raises(ValueError):
        imports.import_feed(spark, "openphish", str(feed), str(tmp_path), "2026-01-02", snapshot=True)
    with pytest.raises(ValueError):
        imports.import_feed(spark, "nope", str(feed), str(tmp_path), "2026-01-02")


def test_keys(tmp_path):
    path = tmp_path / "keys"
    assert imports.read_keys(str(path)) == {}
    path.write_text("# c\n\nURLHAUS_AUTH_KEY = 'k'\n")
    assert imports.read_keys(str(path)) == {"URLHAUS_AUTH_KEY": "k"}
    for text in ("NOPE=1", "word"):
        path.write_text(text)
        with pytest.raises(ValueError):
            imports.read_keys(str(path))
