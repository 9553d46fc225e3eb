"""The resumable source of dated files: ranges, growing files, and streams that are stopped half-way."""

import hashlib
import io

import pytest
from pyspark.errors import StreamingQueryException

from sievework.sources import dated, feeds


@pytest.mark.parametrize("text", [b"", b"a", b"a\n", b"\n\n", b"ab\n\ncd\r\nlast", b"x" * 50 + b"\ny\n", "é\nü\n".encode()])
def test_ranges_give_each_line_once(text):
    want = [(i, line) for i, line in zip(offsets(text), text.split(b"\n"))]
    want = want[:-1] if text.endswith(b"\n") or not text else want
    for size in (1, 2, 3, 7, 100):
        got = [x for a in range(0, max(len(text), 1), size) for x in dated.lines_between(io.BytesIO(text), a, min(a + size, len(text)), chunk=4)]
        assert got == want, size
    assert dated.last_line_end(io.BytesIO(text), len(text), chunk=3) == text.rfind(b"\n") + 1


def offsets(text):
    at = 0
    for line in text.split(b"\n"):
        yield at
        at += len(line) + 1


def write(tmp_path, day, name, text, mode="w"):
    (tmp_path / "in" / day).mkdir(parents=True, exist_ok=True)
    with open(tmp_path / "in" / day / name, mode, newline="") as file:
        file.write(text)


def run(spark, tmp_path, fail_at=None):
    def keep(batch, number):
        if number == fail_at:
            batch.limit(3).write.mode("overwrite").parquet(f"{tmp_path}/out/batch={number}")
            raise RuntimeError("killed")
        batch.write.mode("overwrite").parquet(f"{tmp_path}/out/batch={number}")

    stream = dated.read_dated(spark, f"{tmp_path}/in", f"{tmp_path}/finished")
    stream.writeStream.foreachBatch(keep).option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start().awaitTermination()


def lines(spark, tmp_path):
    return sorted((r.snapshot_date, r.line) for r in spark.read.parquet(f"{tmp_path}/out").collect())


def test_a_killed_stream_goes_on_without_loss_or_repeats(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(dated, "RANGE_BYTES", 37)
    first = [f"https://a{k}.example/é" for k in range(200)]
    write(tmp_path, "2026-01-01", "a.txt", "\n".join(first) + "\nhttps://unended")
    run(spark, tmp_path)
    assert lines(spark, tmp_path) == sorted(("2026-01-01", x) for x in first)  # the last line may still grow
    write(tmp_path, "2026-01-01", "a.txt", ".example\n", "a")
    write(tmp_path, "day=2026-01-02", "b.txt", "https://b\r\nhttps://c\n\n")
    write(tmp_path, "2026-01-03", ".hidden", "no\n")
    with pytest.raises(StreamingQueryException, match="killed"):
        run(spark, tmp_path, fail_at=1)
    write(tmp_path, "2026-01-03", "c.txt", "https://d\n")
    run(spark, tmp_path)  # the killed batch again, up to the offset that it had
    run(spark, tmp_path)
    want = [*(("2026-01-01", x) for x in [*first, "https://unended.example"]), ("2026-01-02", "https://b"), ("2026-01-02", "https://c"), ("2026-01-02", ""), ("2026-01-03", "https://d")]
    assert lines(spark, tmp_path) == sorted(want)
    run(spark, tmp_path)
    assert lines(spark, tmp_path) == sorted(want)
    assert {"2026-01-01"} <= {p.name for p in (tmp_path / "finished").iterdir()} <= {"2026-01-01", "2026-01-02"}


def test_batch_reads_and_empty_folders(spark, tmp_path):
    (tmp_path / "in").mkdir()
    assert dated.read_dated(spark, f"{tmp_path}/in", stream=False).count() == 0
    write(tmp_path, "2026-01-01", "a.txt", "x\ny\n")
    assert [(r.byte, r.line) for r in dated.read_dated(spark, f"file://{tmp_path}/in", stream=False).collect()] == [(0, "x"), (2, "y")]


def test_discovery_reads_files_in_chunks(spark, tmp_path):
    text = "# comment\nhttps://a\n\n  \nhttps://b\n"
    write(tmp_path, "2026-01-01x", "a.txt", text)
    write(tmp_path, "2026-01-01x", "a.txt.part", text)
    write(tmp_path, "other", "b.txt", text)
    found = feeds.discover_snapshots(spark, f"{tmp_path}/in").collect()
    assert [(r.snapshot_date, r.bytes, r.records, r.sha256) for r in found] == [("2026-01-01", len(text), 2, hashlib.sha256(text.encode()).hexdigest())]
