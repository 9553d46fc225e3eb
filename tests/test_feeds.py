import json
import os

import pytest
from pyspark.errors import PySparkException

from sievework.sources import feeds
from sievework.streaming import incremental


def put(tmp_path, name, text):
    path = tmp_path / name
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(text, encoding="utf-8")
    return str(path)


def test_formats(spark, tmp_path):
    assert {r.url for r in feeds.read_any(spark, put(tmp_path, "a.txt", "﻿# c\n\n1,a.com\nhttps://b.com/x,y\n")).collect()} == {"a.com", "https://b.com/x,y"}
    assert feeds.read_any(spark, put(tmp_path, "b.json", json.dumps({"data": [{"url": "u"}, {"url": "v"}]}))).count() == 2
    assert feeds.read_any(spark, put(tmp_path, "c.json", json.dumps([{"url": "u"}]))).count() == 1
    assert feeds.read_any(spark, put(tmp_path, "d.json", json.dumps({"url": "u"}))).count() == 1
    assert feeds.read_any(spark, put(tmp_path, "e.csv", "url,label\nu#f,x\n#c\n")).first().url == "u#f"
    with pytest.raises(ValueError):
        feeds.read_any(spark, "x.xml")


def test_union(spark, tmp_path):
    put(tmp_path, "benign/one.two.csv", "Domain,extra\na.com,1\n")
    put(tmp_path, "malware/m.jsonl", '{"url": "https://m/", "class": "malware", "dateadded": "2026"}\n')
    got = {r.url: r for r in feeds.load_raw(spark, str(tmp_path), {"benign": ["one.two.csv"], "malware": ["m.jsonl"]}).collect()}
    assert got["https://a.com"].label == "BENIGN" and got["https://a.com"].source == "one" and got["https://a.com"].extra == "1"
    assert got["https://m/"].label == "malware" and got["https://m/"].collected_at == "2026"
    assert feeds.load_raw(spark, str(tmp_path), {}).columns == list(feeds.COMMON)


def test_parsers(spark, tmp_path):
    assert feeds.parse(spark, "tranco", put(tmp_path, "t.csv", "1,a.com\n2,b.com\n"), collected_at="d").count() == 2
    with pytest.raises(PySparkException):
        feeds.parse(spark, "tranco", put(tmp_path, "t2.csv", "x,a.com\n"), collected_at="d").collect()
    cert = put(tmp_path, "c.json", json.dumps([{"DomainAddress": "a.pl", "InsertDate": "i", "DeleteDate": None, "RegisterPositionId": 7}, {"DomainAddress": "b.pl", "InsertDate": "i", "DeleteDate": "x", "RegisterPositionId": 8}]))
    row = feeds.parse(spark, "cert_polska", cert, collected_at="d").collect()
    assert [(r.url, r.insert_date, r.register_position_id, r.scope) for r in row] == [("https://a.pl/", "i", "7", "poland")]
    fox = put(tmp_path, "f.json", json.dumps({"query_status": "ok", "data": [{"ioc": "evil.com.", "ioc_type": "domain", "threat_type": "Payload", "tags": ["a", "b"]}, {"ioc": "1.2.3.4", "ioc_type": "ip", "threat_type": "payload"}]}))
    assert [(r.url, r.tags) for r in feeds.parse(spark, "threatfox", fox, collected_at="d", threat_types=["payload"]).collect()] == [("https://evil.com/", "a, b")]
    with pytest.raises(ValueError):
        feeds.parse(spark, "threatfox", fox, collected_at="d", threat_types=["other"])
    with pytest.raises(ValueError):
        feeds.parse(spark, "openphish", put(tmp_path, "o.txt", "# x\n"), collected_at="d")
    with pytest.raises(PySparkException):
        feeds.parse(spark, "commoncrawl", put(tmp_path, "cc.jsonl", '{"url": "u"}\n[1]\n'), collected_at="d").collect()
    with pytest.raises(ValueError):
        feeds.parse(spark, "phishtank", put(tmp_path, "p.csv", "url\nx\n"))
    with pytest.raises(ValueError):
        feeds.parse(spark, "nope", "x")


def test_streams(spark, tmp_path):
    schema = "url string, snapshot_date string, snapshot_id string"
    for k, rows in enumerate(([("https://a.com", "2026-02-02", "x"), ("bad url", "2026-01-01", "y")], [("https://A.com", "2026-01-01", "x"), ("https://b.com", "2026-03-01", "z")])):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        stream = incremental.read_snapshots(spark, f"{tmp_path}/in", schema)
        incremental.accumulate_into(stream, f"{tmp_path}/acc", f"{tmp_path}/s1").awaitTermination()
        incremental.register_into(incremental.read_snapshots(spark, f"{tmp_path}/in", schema).select("snapshot_id"), f"{tmp_path}/hist", f"{tmp_path}/s2").awaitTermination()
    got = {r.normalized_url: r.first_snapshot_date for r in incremental.read_accumulated(spark, f"{tmp_path}/acc").collect()}
    assert got == {"https://a.com": "2026-01-01", "https://b.com": "2026-03-01"}
    assert sorted(r.snapshot_id for r in spark.read.parquet(f"{tmp_path}/hist").collect()) == ["x", "y", "z"]
    assert os.path.isdir(f"{tmp_path}/s1")
