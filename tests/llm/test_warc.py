import gzip
import hashlib
import io

import pytest

from sievework.llm import warc

LONG = "<p>some page that is long enough</p>" * 10


def rows():
    out = [(1, "http://a/", LONG), (2, "http://b/", LONG), (0, "http://c/\r\nX: y", LONG + "x"), (3, None, None), (4, "u", ""), (5, "u", "short"), (6, "u", "short"), (None, "n", LONG), (9, "é", "é" * 60), (8, "é", "é" * 60), (10, "v", "z" * 99), (11, "v", "z" * 99), (12, "big", "r\r\n\r\n" * 400000), (13, "big", "r\r\n\r\n" * 400000), (1, "http://a/", LONG)]
    return out + [(100 + i, "h", LONG) for i in range(40)] + [(None, "q", "only nulls" * 20), (None, "q", "only nulls" * 20)]


@pytest.fixture
def pages(spark):
    return spark.createDataFrame([(*r, "x", 1) for r in rows()], "page_id long, url string, html string, payload string, refers_to int")


def expected():
    first = {}
    for i, _, h in rows():
        h = (h or "").encode()
        if i is not None and len(h) >= 100:
            first[h] = min(first.get(h, i), i)
    out = []
    for i, _, h in rows():
        h = (h or "").encode()
        refers = first.get(h) if i != first.get(h) else None
        out.append((i, len(h), hashlib.sha256(h).hexdigest(), "response" if refers is None else "revisit", refers))
    return sorted(out, key=str)


def test_round_trip(spark, pages, tmp_path):
    folder = warc.write_warc(pages, f"file://{tmp_path}/w")
    got = warc.read_warc(spark, folder).collect()
    assert sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got), key=str) == expected()
    texts = {(i, (h or "").encode()) for i, _, h in rows()}
    assert all((r.page_id, r.payload) in texts for r in got if r.record_type == "response")
    assert all(r.payload is None for r in got if r.record_type == "revisit")
    assert {r.url for r in got if r.page_id == 0} == {"http://c/%0D%0AX: y"} and {r.url for r in got if r.page_id == 3} == {None}


def test_pushdown(spark, pages, tmp_path):
    folder = warc.write_warc(pages, f"file://{tmp_path}/w")
    df = warc.read_warc(spark, folder, "false").where("record_type = 'revisit' and page_id in (2, 100)")
    assert sorted((r.page_id, r.refers_to) for r in df.collect()) == [(2, 1), (100, 1)]
    reader = warc.WarcReader(folder, "true")
    assert list(reader.pushFilters([warc.EqualTo(("record_type",), "response"), warc.In(("page_id",), [1, 5])])) == []
    got = [r for p in reader.partitions() for b in reader.read(p) for r in b.to_pylist()]
    assert sorted(r["page_id"] for r in got) == [1, 1, 5]


def test_unwanted_payloads_are_not_inflated():
    stream = io.BytesIO()
    writer = warc.WarcWriter(stream)
    for k in range(3):
        writer.add({"page_id": k, "url": "u", "html": "abcdefgh" * 100000, "refers_to": None})
    data = stream.getvalue()
    assert gzip.decompress(data).count(b"WARC/1.1") == 3
    import pyarrow as pa

    records = warc.Records(pa.BufferReader(data), len(data))
    assert [h["warc-record-id"] for h, _ in records] == [f"<urn:page:{k}>" for k in range(3)]
    assert records.inflated < 20_000


def test_members_without_lengths_are_read():
    stream = io.BytesIO()
    warc.WarcWriter(stream).add({"page_id": 7, "url": None, "html": "x" * 50000, "refers_to": None})
    plain = gzip.compress(gzip.decompress(stream.getvalue()))
    import pyarrow as pa

    found = [(h["warc-record-id"], len(r.payload(h))) for h, r in warc.Records(pa.BufferReader(plain * 3), 3 * len(plain))]
    assert found == [("<urn:page:7>", 50000)] * 3


def test_empty(spark, pages, tmp_path):
    folder = warc.write_warc(pages.limit(0), f"file://{tmp_path}/e")
    assert warc.read_warc(spark, folder).count() == 0
