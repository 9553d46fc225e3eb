"""The field against enumeration of all labellings, and the operator's held-out accuracy and spans."""

import itertools
import math
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from sievework.llm import toxicity
from sievework.llm.quality import held_out

SF = "/root/testdata/sf0.01"


def field(k=3, seed=1):
    rng = np.random.default_rng(seed)
    move = np.array([[0.0, -1.0], [0.4, 0.7]])
    return toxicity.Field(tuple(range(k)), rng.normal(0, 1, (3, k)), -0.6, move)


def enumerated(e, move):
    """Marginals and expected moves of one document by summing over all labellings."""
    total, marginal, moves = 0.0, np.zeros(len(e)), np.zeros((2, 2))
    for y in itertools.product((0, 1), repeat=len(e)):
        w = math.exp(sum(e[t] for t in range(len(e)) if y[t]) + sum(move[i, j] for i, j in zip(y, y[1:])))
        total += w
        marginal += w * np.array(y)
        for i, j in zip(y, y[1:]):
            moves[i, j] += w
    return marginal / total, moves / total


def test_marginals_equal_enumeration_over_several_documents():
    model, rng = field(), np.random.default_rng(2)
    lengths = [1, 7, 2, 9, 1]
    e = rng.normal(0, 2, sum(lengths))
    first = np.zeros(len(e), bool)
    first[np.cumsum([0, *lengths[:-1]])] = True
    odds = model.marginals(e, first)[0]
    want = np.concatenate([enumerated(x, model.move)[0] for x in np.split(e, np.cumsum(lengths)[:-1])])
    assert np.allclose(odds / (1 + odds), want, atol=1e-12)


def test_ratios_of_one_long_sequence_equal_the_recursion():
    rng = np.random.default_rng(3)
    e, move = np.exp(rng.normal(0, 3, 5003)), np.exp(field().move)
    first = rng.random(len(e)) < 0.0005
    first[0] = True
    r, want = 1.0, []
    for t in range(len(e)):
        r = e[t] if first[t] else e[t] * (move[0, 1] + move[1, 1] * r) / (move[0, 0] + move[1, 0] * r)
        want.append(r)
    assert np.allclose(toxicity.ratios(e, first, move), want, rtol=1e-9)


def test_gradient_equals_differences_of_the_enumerated_likelihood():
    rows = [{"toxic": 1, "n": 5, "places": [1, 1, 4], "features": [0, 2, 1]}, {"toxic": 0, "n": 3, "places": [0], "features": [1]}, {"toxic": 0, "n": 0, "places": [], "features": []}, {"toxic": 1, "n": 1, "places": [0], "features": [2]}]
    kinds = [("toxic", pa.int32()), ("n", pa.int32()), ("places", pa.list_(pa.int32())), ("features", pa.list_(pa.int32()))]
    batch = pa.RecordBatch.from_pylist(rows, pa.schema(kinds))

    def model_of(v):
        return toxicity.Field((0, 1, 2), v[:9].reshape(3, 3), float(v[9]), np.array([[0.0, v[10]], [v[11], v[12]]]))

    def likelihood(v):
        model, out = model_of(v), 0.0
        for row in rows:
            n = row["n"]
            if not n:
                continue
            e = np.full(n, model.bias)
            for at, f in zip(row["places"], row["features"]):
                e[at] += model.weights[0, f]
                if at + 1 < n:
                    e[at + 1] += model.weights[1, f]
                if at:
                    e[at - 1] += model.weights[2, f]
            weigh = lambda y: sum(e[t] for t in range(n) if y[t]) + sum(model.move[i, j] for i, j in zip(y, y[1:]))  # noqa: B023, E731
            y = [int(row["toxic"] and t in row["places"]) for t in range(n)]
            out += weigh(y) - math.log(sum(math.exp(weigh(z)) for z in itertools.product((0, 1), repeat=n)))
        return out

    at = np.random.default_rng(5).normal(0, 0.7, 13)
    got = toxicity.gradient(model_of(at), batch)
    for i in range(13):
        d = np.zeros(13)
        d[i] = 1e-5
        assert got[i] == pytest.approx((likelihood(at + d) - likelihood(at - d)) / 2e-5, abs=1e-6)


def test_evidence_equals_plain_counts_and_ignores_copies(spark):
    rows: list[tuple] = [("you utter foe", 1)] * 30 + [(f"a{i} vileness b{i}", 1) for i in range(30)] + [(f"calm day {i}", 0) for i in range(90)] + [(None, 0), ("", 1)]
    counts = toxicity.evidence(spark.createDataFrame(rows, "text string, toxic int").repartition(5))
    found = {r.feature: r for r in counts.collect()}
    word = {w: found[toxicity.features_of(w)[0]] for w in ("utter", "vileness", "calm")}
    assert (word["utter"].toxic, word["utter"].clean, bin(word["utter"].contexts & (1 << 64) - 1).count("1")) == (30, 0, 1)
    assert (word["vileness"].toxic, word["calm"].clean) == (30, 90)
    kept = toxicity.kept_features(counts)
    assert (found[toxicity.ALL].toxic, found[toxicity.ALL].clean) == (61, 91)
    assert set(toxicity.features_of("VILENESS")) <= set(kept) and not set(toxicity.features_of("utter")) & set(kept)


def corpus(spark):
    rng = random.Random(4)
    plain = [f"w{i}" for i in range(300)]
    rows, labels = [], []
    for i in range(600):
        words = [rng.choice(plain) for _ in range(rng.randrange(5, 60))]
        toxic = i % 4 == 0
        if toxic:
            for _ in range(rng.randrange(1, 4)):
                words.insert(rng.randrange(len(words)), rng.choice(["Vermin", "scoundrel", "vermination"]))
        rows.append((i, " ".join(words), "x", 1.0))
        labels.append((i, int(toxic)))
    return spark.createDataFrame(rows, "doc_id long, text string, toxic string, score double"), spark.createDataFrame(labels, "doc_id long, toxic int")


def test_spans_scores_and_odd_rows(spark):
    docs, labels = corpus(spark)
    model = toxicity.train(docs, labels)
    long = "w1 " * 200_000
    odd = spark.createDataFrame([(None, "what a VERMIN, scoundrel! yes"), (-1, None), (-2, ""), (-3, "!!! ..."), (-4, long), (-5, long + "vermin"), (-6, "ünïcödé 😀 vermin"), (-6, "ünïcödé 😀 vermin"), (-7, "verminous w1")], "doc_id long, text string")
    found = {}
    for r in toxicity.tag(odd, model).collect():
        assert found.setdefault(r.doc_id, r) == r
    assert [r.predicted for r in (found[i] for i in (None, -1, -2, -3, -4, -5, -6, -7))] == [1, 0, 0, 0, 0, 1, 1, 1]
    assert [(s.start, s.stop) for s in found[None].spans] == [(7, 24)]
    assert [(s.start, s.stop) for s in found[-6].spans] == [(10, 16)]
    assert [(s.start, s.stop) for s in found[-5].spans] == [(600_000, 600_006)]
    assert all(0 <= r.score <= 1 for r in found.values()) and found[-1].score == found[-2].score
    scored = toxicity.tag(docs, model).join(labels, "doc_id").where(held_out("doc_id", 5, 0))
    assert scored.where("predicted <> toxic").count() == 0


def test_the_layout_of_rows_does_not_matter(spark):
    docs, labels = corpus(spark)
    one, many = (toxicity.train(docs.repartition(n), labels.repartition(n)) for n in (1, 9))
    assert one.keys == many.keys and np.allclose(one.weights, many.weights, atol=1e-6)


def test_without_both_classes_or_labels(spark):
    docs = spark.createDataFrame([(1, "a"), (2, "b"), (None, "c")], "doc_id long, text string")
    label = lambda rows: spark.createDataFrame(rows, "doc_id long, toxic int")
    assert toxicity.train(docs, label([])) == 0.0
    assert toxicity.train(docs, label([(1, 1), (2, 1), (2, None)])) == 1.0
    assert toxicity.train(docs, label([(1, 1), (1, 0), (None, 1), (2, 7)])) == 0.0
    assert toxicity.train(docs, label([(1, 1), (2, 0)])) == 0.5
    assert {(r.score, r.predicted) for r in toxicity.tag(docs, 0.0).collect()} == {(0.0, 0)}
    empty = docs.where("false")
    assert toxicity.train(empty, label([(1, 1)])) == 1.0 and toxicity.tag(empty, 0.3).count() == 0


def test_held_out_documents_of_the_table(spark):
    found = toxicity.op13_toxicity(spark, SF)
    labels = spark.read.parquet(f"{SF}/labels.parquet").select("doc_id", "toxic")
    wrong = found.where("held_out").join(labels, "doc_id").groupBy("toxic").agg(F.avg((F.col("predicted") != F.col("toxic")).cast("double")).alias("wrong")).collect()
    assert found.count() == spark.read.parquet(f"{SF}/documents.parquet").count()
    assert {r.toxic: r.wrong for r in wrong}[0] <= 0.02 and {r.toxic: r.wrong for r in wrong}[1] <= 0.35
