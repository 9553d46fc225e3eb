from pyspark.sql import functions as F

from sievework.operators import cleaning

RAW = [
    (0, "https://example.com/a", "BENIGN", "s", "d"),
    (1, " HTTPS://EXAMPLE.com/a#", "benign ", "s", "d"),
    (2, "https://clash.com/", "BENIGN", "s", "d"),
    (3, "https://clash.com/", "PHISHING", "s", "d"),
    (4, "ftp://example.com/a", "BENIGN", "s", "d"),
    (5, "", "BENIGN", "s", "d"),
    (6, "https://example.com/b", "NOPE", "s", "d"),
    (7, None, None, None, None),
    (8, "https://example.com/a", "BENIGN", "t", "d"),
    (9, "https://example.com/c", None, "t", "d"),
]


def frame(spark, rows=RAW):
    return spark.createDataFrame([(*r, "x") for r in rows], "ord long, url string, label string, source string, collected_at string, port string")


def test_pipeline(spark):
    out = cleaning.clean(frame(spark))
    assert [(r.ord, r.normalized_url) for r in out.clean.collect()] == [(0, "https://example.com/a")]
    assert sorted(r.ord for r in out.conflicts.collect()) == [2, 3]
    s = cleaning.cleaning_stats(frame(spark)).first()
    assert (s.raw_rows, s.removed_empty, s.removed_invalid_label, s.removed_exact_duplicates, s.removed_invalid_urls, s.removed_conflicts, s.removed_normalized_duplicates, s.remaining_rows) == (10, 2, 2, 1, 1, 2, 1, 1)
    assert (s.class_benign, s.class_phishing) == (1, 0)


def test_empty(spark):
    empty = frame(spark, RAW[:1]).limit(0)
    assert cleaning.clean(empty).clean.count() == 0
    s = cleaning.cleaning_stats(empty).first()
    assert s.raw_rows == 0 and s.remaining_rows == 0 and s.removed_exact_duplicates == 0


def test_missing_column(spark):
    try:
        cleaning.clean(spark.createDataFrame([("x",)], "url string"))
    except ValueError as error:
        assert "label" in str(error)
    else:
        raise AssertionError


def test_views(spark):
    rows = spark.createDataFrame(
        [(1, "example.com", "BENIGN", "https://example.com/x", "tranco"), (2, "example.com", "BENIGN", "https://example.com/y", "commoncrawl_tranco_candidate"), (3, "example.test", "PHISHING", "https://example.test/", "openphish"), (4, "192.0.2.1", "MALWARE", "http://192.0.2.1/a", "urlhaus"), (5, "both.com", "BENIGN", "u", "x"), (6, "both.com", "MALWARE", "v", "x"), (7, "::1", "MALWARE", "w", "cert_polska")],
        "ord long, registrable_domain string, label string, normalized_url string, source string",
    )
    assert {r.model_url for r in cleaning.domain_only_view(rows).collect()} == {"https://example.com/", "https://example.test/", "https://192.0.2.1/", "https://[::1]/"}
    assert {r.ord for r in cleaning.full_url_view(rows).collect()} == {2, 3, 4}
    assert {r.registrable_domain for r in cleaning.domain_label_conflicts(rows).collect()} == {"both.com"}


def test_keep_first_does_not_depend_on_partitions(spark):
    rows = spark.range(2000).select((F.col("id") % 7).alias("k"), F.col("id").alias("ord"))
    for n in (1, 5, 13):
        assert sorted(r.ord for r in cleaning.keep_first(rows.repartition(n), ["k"]).collect()) == list(range(7))
