import os

from itertools import combinations

import numpy as np
import pytest

from sievework.llm import langid

TEXT = {
    "en": "the weather was good and they went with their friends through that old town {}",
    "de": "das wetter war gut und sie gingen mit ihren freunden durch die alte stadt {}",
    "fr": "le temps était beau et ils sont allés avec leurs amis dans cette vieille ville {}",
    "es": "el tiempo era bueno y ellos fueron con sus amigos por aquella ciudad antigua {}",
}


@pytest.fixture
def docs(spark):
    langs = list(TEXT)
    rows = [(i, TEXT[langs[i % 4]].format(i) + " " + TEXT[langs[i % 4]][: i % 40], langs[i % 4]) for i in range(400)]
    rows += [(None, TEXT["en"], "en"), (500, None, "en"), (501, "", "en"), (502, "123 !!", "en"), (503, TEXT["de"].upper(), None), (504, TEXT["fr"] * 3000, None), (505, TEXT["fr"], "fr"), (505, TEXT["fr"], "fr")]
    return spark.createDataFrame([(*r, 0.1, "x") for r in rows], "doc_id long, text string, lang string, score double, lang_pred string")


def test_predictions(spark, docs):
    model = langid.train(docs, per_language=50)
    rows = langid.identify(docs, model).collect()
    by = {r.doc_id: r for r in rows}
    assert len(rows) == docs.count()
    langs = list(TEXT)
    assert np.mean([by[i].lang_pred == langs[i % 4] for i in range(400)]) == 1
    assert all(by[i].lang_pred == "und" and by[i].score == 0 for i in (500, 501, 502))
    assert by[503].lang_pred == "de" and by[504].lang_pred == "fr" and by[None].lang_pred == "en"
    assert all(0 <= r.score <= 1 for r in rows)
    kept = langid.keep_identified(docs, model)
    assert kept.columns == docs.columns and {500, 501, 502}.isdisjoint({r.doc_id for r in kept.collect()})


def test_sample_is_bounded(spark, docs):
    rows = docs.select("doc_id", "text", "lang").where("lang is not null and doc_id is not null")
    taken = langid.sample(rows, 10, 1000).groupBy("lang").count().collect()
    assert {r.lang for r in taken} == set(TEXT) and all(r["count"] <= 10 for r in taken)


def test_one_or_no_language(spark, docs):
    one = langid.identify(docs, langid.train(docs.where("lang = 'en'"))).collect()
    assert {(r.lang_pred, r.score) for r in one} == {("en", 0.5), ("und", 0.0)}
    none = langid.identify(docs, langid.train(docs.limit(0))).collect()
    assert {(r.lang_pred, r.score) for r in none} == {("und", 0.0)}
    assert langid.identify(docs.limit(0), langid.train(docs)).count() == 0


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    if not os.path.isdir(sf):
        pytest.skip("no tables")
    got = langid.op9_language_id(spark, sf).join(spark.read.parquet(f"{sf}/documents.parquet"), "doc_id").where("held_out").collect()
    assert np.mean([r.lang_pred == r.lang for r in got]) > 0.95


def test_unlearned_language_goes_and_learned_ones_stay(spark):
    words = {"en": "the and of with house water which street", "de": "der und von mit haus wasser welche strasse", "fr": "le et de avec maison eau quelle rue", "es": "el y con casa agua cual calle pero"}
    rng = np.random.default_rng(5)
    text = lambda lang: " ".join(rng.choice(words[lang].split(), 40))
    learned = [(i, text(lang), lang) for i, lang in enumerate(["en", "de", "fr"] * 60)]
    schema = "doc_id long, text string, lang string"
    model = langid.train(spark.createDataFrame(learned, schema))
    fresh = [(1000 + i, text(lang), lang) for i, lang in enumerate(["en", "de", "fr", "es"] * 25)]
    kept = [r.lang for r in langid.keep_identified(spark.createDataFrame(fresh, schema), model).collect()]
    assert kept.count("es") <= 3 and all(kept.count(lang) >= 23 for lang in ("en", "de", "fr"))
    one = langid.train(spark.createDataFrame([r for r in learned if r[2] == "en"], schema))
    assert langid.keep_identified(spark.createDataFrame(fresh, schema), one).count() == len(fresh)


def test_one_letter_rule(spark, docs):
    """Number characters, marks and joiners are no letters; one letter of any script is enough."""
    model = langid.train(docs, per_language=50)
    none = ["½ ²", "Ⅷ", "١٢٣", "\u0301", "_", "①", "\u200d", " \n\t", "%$&"]
    some = ["½ a", "ʰ", "漢", "ª", "Ω²"]
    rows = [(k, t) for k, t in enumerate(none + some)]
    got = {r.doc_id: r for r in langid.identify(spark.createDataFrame(rows, "doc_id long, text string"), model).collect()}
    assert all((got[k].lang_pred, got[k].score) == ("und", 0.0) for k in range(len(none)))
    assert all(got[k].lang_pred in TEXT for k in range(len(none), len(rows)))
    only = spark.createDataFrame([(1, "½ ²", "xx"), (2, "Ⅷ", "xx")], "doc_id long, text string, lang string")
    assert langid.train(only).families is None
    kept = langid.keep_identified(spark.createDataFrame(rows, "doc_id long, text string"), model, min_score=0.0)
    assert {r.doc_id for r in kept.collect()} == set(range(len(none), len(rows)))


def test_sample_does_not_depend_on_layout(spark):
    rows = [(k % 40, f"text number {k}", "en" if k % 3 else "de") for k in range(900)] + [(5, "the same row", "en")] * 300
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    one, two = (sorted(map(tuple, langid.sample(d, 25, 1000).collect())) for d in (docs.repartition(1), docs.repartition(6).orderBy("text")))
    assert one == two and len(set(one)) == len(one)
    assert [sum(r[2] == lang for r in one) for lang in ("de", "en")] == [25, 25]
    few = [r.lang for r in langid.sample(docs.where("doc_id < 2"), 25, 1000).collect()]
    there = [lang for _, _, lang in {r for r in rows if r[0] < 2}]
    assert all(few.count(lang) == min(25, there.count(lang)) for lang in ("de", "en"))
    assert len(langid.sample(docs, 25, 6).collect()) == 6


def test_train_svm_reaches_the_optimum():
    """Against plain gradient descent on the squared hinge with the same weights of classes and the same cost."""
    rng = np.random.default_rng(4)
    x = np.vstack([rng.normal(0.6, 1, (60, 5)), rng.normal(-0.6, 1, (25, 5))]).astype(np.float32)
    y = np.array([1.0] * 60 + [-1.0] * 25)
    w = langid.train_svm(x, y, epochs=400)
    full = np.hstack([x, np.ones((85, 1))]).astype(np.float64)
    weight = np.where(y > 0, 85 / 120, 85 / 50)
    loss = lambda v: 0.5 * v @ v + (weight * np.maximum(0, 1 - y * (full @ v)) ** 2).sum()
    v = np.zeros(6)
    for _ in range(20_000):
        slack = np.maximum(0, 1 - y * (full @ v))
        v -= 1e-3 * (v - 2 * full.T @ (weight * slack * y))
    assert abs(loss(w.astype(np.float64)) - loss(v)) < 1e-3 * loss(v)


def test_votes_equal_brute_force():
    rng = np.random.default_rng(6)
    names = ("a", "b", "c", "d")
    pairs = tuple(combinations(range(4), 2))
    machines = langid.Machines(names, pairs, rng.normal(size=(4, 6)).astype(np.float32))
    x = rng.normal(size=(300, 3)).astype(np.float32)
    got, sure = machines.choose(x)
    ties = 0
    for row, k, s in zip(x, got, sure):
        margin = {p: float(row @ machines.weights[:3, n] + machines.weights[3, n]) for n, p in enumerate(pairs)}
        votes = [sum((m > 0) == (p[0] == i) for p, m in margin.items() if i in p) for i in range(4)]
        total = [sum(m if p[0] == i else -m for p, m in margin.items() if i in p) for i in range(4)]
        best = [i for i in range(4) if votes[i] == max(votes)]
        ties += len(best) > 1
        want = max(best, key=lambda i: total[i])
        least = min(m if p[0] == want else -m for p, m in margin.items() if want in p)
        assert k == want and s == pytest.approx(1 / (1 + np.exp(-4 * least)), rel=1e-4)
    assert ties > 10
