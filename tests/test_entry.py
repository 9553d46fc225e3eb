import hashlib
import os

import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"


def test_registry():
    queries, oracle = entry.queries(), entry.oracle_sql()
    assert set(oracle) <= set(queries) and len(queries) > 140
    assert all(callable(q) for q in queries.values())


@pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")
def test_flagship(spark):
    rows = entry.entry(spark).collect()
    assert {r.label for r in rows} <= {"BENIGN", "PHISHING", "MALWARE"} and rows


@pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")
@pytest.mark.parametrize("name", ["cln_stats", "pol_v2", "met_auroc", "agg_crosstab", "ti_overlap", "brand_assess", "indicator_digest", "ti_index", "ti_freeze", "pol_guardrail_probe", "int_bundle_build", "int_bundle_summary"])
def test_queries_equal_their_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    db = duckdb.connect()
    db.execute("set timezone = 'UTC'")
    for table in ("pages", "lineitem", "documents", "events", "orders", "embeddings"):
        db.execute(f"create view {table} as select * from '{SF}/{table}.parquet'")
    want = db.sql(entry.oracle_sql()[name])
    columns = sorted(want.columns)
    got = entry.queries()[name](spark, SF).select(*columns).collect()
    order = [want.columns.index(c) for c in columns]
    same = lambda v: round(v, 6) if isinstance(v, float) else v
    assert sorted((tuple(map(same, r)) for r in got), key=str) == sorted((tuple(same(r[i]) for i in order) for r in want.fetchall()), key=str)


@pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")
def test_snapshots_hold_all_pages(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    want = {f"2026-09-0{1 + r.k}": r.n for r in pages.selectExpr("page_id % 4 k").groupBy("k").agg({"*": "count"}).withColumnRenamed("count(1)", "n").collect()}
    got = {r.snapshot_date: r.records for r in entry.queries()["src_snapshot_discover"](spark, SF).collect()}
    assert got == want and len(got) == 4


def test_domain_candidates_rank_all_hosts(spark, tmp_path):
    names = {f"h{i}.example.org": i for i in range(10_500)}
    spark.createDataFrame([(i, f"https://{h}/x?y", "") for h, i in names.items()], "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    want = sorted(names, key=lambda h: hashlib.sha256(f"42|{h}".encode()).hexdigest())[:20]
    got = entry.queries()["src_cc_domains"](spark, str(tmp_path)).collect()
    assert {r.domain: r.ord for r in got} == {h: names[h] for h in want} and max(names[h] for h in want) >= 10_000


def test_upper_cased_variants_keep_long_urls_whole(spark, tmp_path):
    tails = {7: "a" * 12_000 + "x", 14: "a" * 12_000 + "y"}
    spark.createDataFrame([(i, f"https://h.example.org/{t}", "") for i, t in tails.items()], "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    got = {r.url for r in entry.queries()["dedup_exact"](spark, str(tmp_path)).collect()}
    assert {f"HTTPS://H.EXAMPLE.ORG/{t}" for t in tails.values()} <= got


@pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")
def test_threat_index_holds_all_hosts(spark):
    hosts = {r.h for r in spark.read.parquet(f"{SF}/pages.parquet").selectExpr("lower(parse_url(url, 'HOST')) h").collect()}
    assert {r.indicator for r in entry.queries()["ti_index"](spark, SF).collect()} == hosts - {None}
