import hashlib
import zlib

import numpy as np
import pytest
from pyspark.errors import PythonException

from sievework.llm import media
from sievework.llm.archives import listed, planned


def rows():
    return [(1, "a"), (2, None), (3, ""), (4, "x" * 576), (5, "x" * 577), (6, "é🙂" * 5000), (7, "é🙂" * 5000), (None, "no id"), (8, "long " * 300000), (1, "a"), (9, "\x00\x01")] + [(100 + i, f"text {i} " * i) for i in range(200)]


@pytest.fixture
def docs(spark):
    return spark.createDataFrame([(*r, "x", 1) for r in rows()], "doc_id long, text string, payload string, offset int")


def test_png_round_trip():
    rng = np.random.default_rng(0)
    for n in (1, 2, 9):
        payload = rng.integers(0, 256, 576 * n, np.uint8).tobytes()
        stored = media.to_png(payload)
        assert media.from_png(stored) == payload
        with pytest.raises((ValueError, zlib.error)):
            media.from_png(stored[:60] + bytes([stored[60] ^ 1]) + stored[61:])


@pytest.mark.parametrize("step", ["700", "100000000"])
def test_round_trip(spark, docs, tmp_path, step):
    folder = media.write_media(docs, f"file://{tmp_path}/m")
    members = media.read_media(spark, folder, rangeBytes=step)
    got = media.measure(members).collect()
    want = []
    for i, t in rows():
        raw = (t or "").encode()
        payload = raw + b"\xff" * (-len(raw) % 576 or (0 if raw else 576))
        want.append((i, len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:])))
    assert sorted((tuple(r)[:5] for r in got), key=str) == sorted(want, key=str)
    by = {}
    for r in got:
        by.setdefault(r.payload_sha256, set()).add((r.media_bytes, r.media_sha256, r.feature))
    assert all(len(v) == 1 for v in by.values())


def test_damaged_member_is_alone(spark, docs, tmp_path):
    folder = media.write_media(docs.where("doc_id >= 100"), f"file://{tmp_path}/m")
    path = f"{tmp_path}/m/{listed(folder, '.zip')[0][0]}"
    data = bytearray(open(path, "rb").read())
    at = data.index(b"IDAT", 2000)
    data[at + 8] ^= 255
    open(path, "wb").write(data)
    got = media.read_media(spark, folder, errors="null").collect()
    assert len(got) == 200 and sum(r.payload is None for r in got) == 1 and sum(r.error is not None for r in got) == 1
    with pytest.raises(PythonException):
        media.read_media(spark, folder).collect()


def test_retry_by_member():
    calls = []

    def flaky(attempt):
        calls.append(attempt)
        if attempt < 2:
            raise OSError("lost")
        return b"ok"

    assert media.retried(flaky, 3) == (b"ok", None) and calls == [0, 1, 2]
    assert media.retried(flaky, 2)[0] is None


def test_damaged_directory_is_alone(spark, docs, tmp_path):
    folder = media.write_media(docs.where("doc_id >= 100").repartition(3), f"file://{tmp_path}/m")
    names = [path for path, _ in listed(folder, ".zip")]
    with open(f"{tmp_path}/m/{names[0]}", "r+b") as file:
        file.truncate(5000)
    got = media.read_media(spark, folder, errors="null", rangeBytes="4000")
    lost = [r for r in got.collect() if r.member is None]
    assert [(r.archive, r.payload) for r in lost] == [(names[0], None)] and lost[0].error
    whole = {r.archive for r in got.collect() if r.payload is not None}
    assert whole == set(names[1:])
    assert sum(r.doc_id is None for r in media.measure(got).collect()) == 1
    with pytest.raises(PythonException):
        media.read_media(spark, folder).collect()


def test_a_short_member_is_tried_again():
    def short(attempt):
        if not attempt:
            raise EOFError
        return b"ok"

    assert media.retried(short, 2) == (b"ok", None)


def test_plans_cover_every_byte_once():
    found = [(f"f{k}", size) for k, size in enumerate((5, 100, 1, 64, 33, 7))]
    for step in (1, 10, 50, 1000):
        for cut in (True, False):
            plan = planned(found, step, cut)
            pieces = sorted(p for part in plan for p in part)
            for path, size in found:
                mine = [(a, b) for f, a, b in pieces if f == path]
                assert mine[0][0] == 0 and mine[-1][1] == size and all(x[1] == y[0] for x, y in zip(mine, mine[1:]))
            assert all(sum(b - a for _, a, b in part) <= max(step, 0 if cut else 100) for part in plan)
    assert len(planned([(f"f{k}", 1 << 30) for k in range(3000)], 8 << 20, True)) <= 22_000
    assert planned([], 10, True) == []


def test_empty(spark, docs, tmp_path):
    folder = media.write_media(docs.limit(0), f"file://{tmp_path}/m")
    assert media.measure(media.read_media(spark, folder)).count() == 0
