import numpy as np
import pytest

from sievework.llm import quality

GOOD = "the rain fell on the quiet town and people walked home along river number {} under grey clouds"
BAD = "BUY!! NOW!! BUY!! NOW!! DEAL{}!! DEAL!! DEAL!!"


@pytest.fixture
def docs(spark):
    rows = [(i, (GOOD if i % 3 else BAD).format(i) + (" then more words followed" * (i % 7) if i % 3 else " WOW!!" * (i % 5))) for i in range(300)]
    rows += [(None, "no id here"), (1000, None), (1001, ""), (1001, ""), (1002, "long text " * 60000)]
    return spark.createDataFrame([(i, t, 0.5, 7) for i, t in rows], "doc_id long, text string, score double, quality int")


@pytest.fixture
def labels(spark):
    rows = [(i, int(i % 3 != 0), 0) for i in range(300)] + [(5, 0, 0), (7, None, None), (None, 1, 0), (9, 0, 0), (11, 3, 0)]
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")


def brute_force(docs, labels):
    """The same model fitted in one place with numpy's own covariance."""
    import zlib

    known = {}
    for r in labels.collect():
        if r.quality in (0, 1):
            known.setdefault(r.doc_id, set()).add(r.quality)
    rows = [(r.doc_id, np.array(quality.statistics(r.text))) for r in docs.collect()]
    train = [(x, min(known[i])) for i, x in rows if i is not None and len(known.get(i, ())) == 1 and zlib.crc32(str(i).encode()) % 4 != 2]
    log_p = []
    for k in (0, 1):
        x = np.array([v for v, y in train if y == k])
        cov = np.cov(x.T, bias=True)
        s = quality.SHRINKAGE
        cov = (1 - s) * cov + s * np.diag(np.maximum(np.diag(cov), 1e-4)) + 1e-6 * np.eye(len(cov))
        inv, det = np.linalg.inv(cov), np.linalg.slogdet(cov)[1]
        log_p.append([np.log(len(x) / len(train)) - 0.5 * ((v - x.mean(0)) @ inv @ (v - x.mean(0)) + det) for _, v in rows])
    return [(i, 1 / (1 + np.exp(np.clip(a - b, -500, 500)))) for (i, _), a, b in zip(rows, *log_p)]


def test_scores_equal_brute_force(spark, docs, labels):
    stats = quality.statistics_of(docs)
    got = quality.classify(stats, quality.train(stats, labels)).collect()
    want = brute_force(docs, labels)
    key = lambda p: (p[0] is None, p[0] or 0, p[1])
    got = sorted(((r.doc_id, r.score) for r in got), key=key)
    want = sorted(want, key=key)
    assert [g[0] for g in got] == [w[0] for w in want]
    np.testing.assert_allclose([g[1] for g in got], [w[1] for w in want], atol=1e-6)
    by = dict(got)
    assert all((by[i] >= 0.7) == (i % 3 != 0) for i in range(300))


def test_degenerate_inputs(spark, docs, labels):
    stats = quality.statistics_of(docs)
    assert {r.score for r in quality.classify(stats, quality.train(stats, labels.limit(0))).collect()} == {0.5}
    assert {r.score for r in quality.classify(stats, quality.train(stats, labels.where("quality = 1 and doc_id > 20"))).collect()} == {1.0}
    assert quality.classify(quality.statistics_of(docs.limit(0)), quality.train(stats, labels)).count() == 0


def test_keep_good_keeps_columns(spark, docs, labels):
    model = quality.train(quality.statistics_of(docs), labels)
    kept = quality.keep_good(docs, model)
    assert kept.columns == docs.columns
    ids = {r.doc_id for r in kept.collect()}
    assert {i for i in range(300) if i % 3} <= ids and not {i for i in range(0, 300, 3)} & ids


def test_held_out_accuracy(spark):
    import os

    sf = "/root/testdata/sf0.01"
    if not os.path.isdir(sf):
        pytest.skip("no tables")
    got = quality.op5_quality_classifier(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").where("held_out").collect()
    assert np.mean([r.predicted == r.quality for r in got]) > 0.95
