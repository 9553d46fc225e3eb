import re
import zlib
from collections import Counter
from itertools import product

import numpy as np
import pytest

from sievework.llm import hmm
from sievework.llm.common import materialize


def rows():
    rng = np.random.default_rng(2)
    words = {0: ["the", "Of", "and", "walking", "talking", "stone"], 1: ["der", "und", "ÜBER", "wandern", "gehen", "stein"]}
    out = [(i, " ".join(rng.choice(words[i % 2], rng.integers(0, 60)))) for i in range(120)]
    return out + [(None, "the stone"), (500, None), (501, ""), (502, "  \t\n"), (503, "the und " * 4000), (7, out[7][1]), (504, "never seen words xyz"), (505, "a\x0bb\x1cc")]


@pytest.fixture
def docs(spark):
    return spark.createDataFrame([(*r, "x", 1) for r in rows()], "doc_id long, text string, held string, chunk int")


def tokens_of(text):
    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) + [None]


def corpus_counts():
    c = Counter()
    for i, text in rows():
        if i is not None and zlib.crc32(str(i).encode()) % 7 != 2:
            c.update(tokens_of(text))
    return c


@pytest.mark.parametrize("chunk_bytes", [300, 1 << 20])
def test_base_and_likelihood_equal_brute_force(spark, docs, chunk_bytes):
    got = hmm.score_documents(docs, states=3, iterations=2, chunk_bytes=chunk_bytes).collect()
    made = materialize(hmm.encode(docs, chunk_bytes=chunk_bytes), "chunks")
    lists = made.where("word is not null")
    from pyspark.sql import functions as F

    by_word = lists.groupBy("word", "class").agg(F.sum("n").alias("c")).where("c > 0")
    counts = hmm.Counts.of(by_word)
    model = hmm.train(made.where("word is null"), counts, 3, 2)
    c = corpus_counts()
    n, v = sum(c.values()), len(c)
    assert (counts.tokens, counts.words) == (n, v)
    assert {bytes(r.word).decode(): r.c for r in by_word.collect()} == {" " if w is None else w: k for w, k in c.items()}
    share = (counts.once + 1e-3) / (counts.per_class + 1)
    want = []
    for i, text in rows():
        tokens = tokens_of(text)
        base = sum(np.log10((c[w] + 1) / (n + v + 1)) for w in tokens)
        alpha, total = model.start, 0.0
        for t, w in enumerate(tokens):
            b = hmm.word_class(b" " if w is None else w.encode())
            p = model.emit[b] * (1 - share[b]) * c[w] / counts.per_class[b] if c[w] else (model.emit * share[:, None]).sum(0)
            alpha = (alpha @ model.move if t else alpha) * p
            total += np.log10(alpha.sum())
            alpha = alpha / alpha.sum()
        held = i is not None and zlib.crc32(str(i).encode()) % 7 == 2
        want.append((i, held, len(tokens), sum(c[w] > 0 for w in tokens), n, base, total))
    key = lambda r: (r[0] is None, r[0] or 0, r[2])
    for g, w in zip(sorted(map(tuple, got), key=key), sorted(want, key=key)):
        assert g[:5] == w[:5]
        np.testing.assert_allclose(g[5:], w[5:], rtol=1e-6)


def test_events_sum_to_one_in_each_state():
    rng = np.random.default_rng(0)
    per_class = rng.integers(0, 50, hmm.CLASSES).astype(float)
    counts = hmm.Counts(int(per_class.sum()), 100, per_class, np.minimum(per_class, rng.integers(0, 3, hmm.CLASSES)))
    events = hmm.Model.initial(counts, 4).events(counts)
    np.testing.assert_allclose(events.sum(0), 1)


def test_expected_counts_equal_enumeration():
    rng = np.random.default_rng(1)
    counts = hmm.Counts(10, 3, np.bincount([5, 5, 9, 11, 11, 11], minlength=hmm.CLASSES).astype(float), np.zeros(hmm.CLASSES))
    model = hmm.Model.initial(counts, 2)
    seqs = [rng.choice([5, 9, 11], n) for n in (4, 1, 6)]
    first = np.concatenate([np.arange(len(s)) == 0 for s in seqs])
    got = hmm.expected(np.concatenate(seqs), first, model)
    want = np.zeros_like(got)
    for s in seqs:
        paths = list(product(range(2), repeat=len(s)))
        p = np.array([model.start[z[0]] * np.prod([model.move[a, b] for a, b in zip(z, z[1:])]) * np.prod([model.emit[x, k] for x, k in zip(s, z)]) for z in paths])
        for z, w in zip(paths, p / p.sum()):
            for x, k in zip(s, z):
                want[x, k] += w
            for a, b in zip(z, z[1:]):
                want[hmm.CLASSES + a, b] += w
            want[hmm.CLASSES + 2, z[0]] += w
    np.testing.assert_allclose(got, want, atol=1e-4)


def test_expected_counts_of_long_documents_are_whole():
    rng = np.random.default_rng(3)
    counts = hmm.Counts(10, 3, np.bincount([5, 5, 9, 11, 11, 11], minlength=hmm.CLASSES).astype(float), np.zeros(hmm.CLASSES))
    model = hmm.Model.initial(counts, 3)
    seqs = [rng.choice([5, 9, 11], n) for n in (700, 1, 129, 128, 400, 3)]
    want = np.zeros((hmm.CLASSES + 4, 3))
    for s in seqs:
        n = len(s)
        alpha, beta = np.empty((n, 3)), np.ones((n, 3))
        for t in range(n):
            alpha[t] = (alpha[t - 1] @ model.move if t else model.start) * model.emit[s[t]]
            alpha[t] /= alpha[t].sum()
        for t in range(n - 1, 0, -1):
            beta[t - 1] = model.move @ (model.emit[s[t]] * beta[t])
            beta[t - 1] /= beta[t - 1].sum()
        gamma = alpha * beta
        gamma /= gamma.sum(1, keepdims=True)
        np.add.at(want, s, gamma)
        want[hmm.CLASSES + 3] += gamma[0]
        for t in range(1, n):
            xi = np.outer(alpha[t - 1], model.emit[s[t]] * beta[t]) * model.move
            want[hmm.CLASSES : hmm.CLASSES + 3] += xi / xi.sum()
    for order in (range(6), (3, 5, 0, 2, 4, 1)):
        dealt = [seqs[i] for i in order]
        got = hmm.expected(np.concatenate(dealt), np.concatenate([np.arange(len(s)) == 0 for s in dealt]), model)
        np.testing.assert_allclose(got, want, rtol=1e-9, atol=1e-9)
        np.testing.assert_allclose(got[hmm.CLASSES : hmm.CLASSES + 3].sum(), sum(len(s) - 1 for s in seqs), rtol=1e-9)


def test_training_raises_held_out_likelihood(spark, docs):
    runs = [hmm.score_documents(docs, states=2, iterations=k).where("doc_id < 120").selectExpr("sum(score) s", "sum(base_score) b").first() for k in (0, 8)]
    assert runs[1].s > runs[0].s and runs[1].s > runs[1].b


def test_degenerate(spark, docs):
    assert hmm.score_documents(docs.limit(0)).count() == 0
    got = hmm.score_documents(docs.where("doc_id is null")).collect()
    assert [(r.n_known, r.train_tokens, r.base_score, r.held_out) for r in got] == [(0, 0, 0.0, False)]
    assert got[0].score == pytest.approx(0, abs=1e-12)


def test_scores_do_not_depend_on_layout(spark, monkeypatch):
    """Other partitions, orders, chunks and blocks give the same scores but for rounding."""
    rng = np.random.default_rng(9)
    words = [f"w{k}" for k in range(400)]
    docs = spark.createDataFrame([(k, " ".join(rng.choice(words, int(n)))) for k, n in enumerate(rng.integers(1, 90, 60))] + [(900 + k, " ".join(rng.choice(words[k::3], 1500))) for k in range(3)], "doc_id long, text string")
    score = lambda d, size: np.array([r.score for r in hmm.score_documents(d, states=3, iterations=3, chunk_bytes=size).orderBy("doc_id").collect()])
    one = score(docs.coalesce(1).sortWithinPartitions("doc_id"), 1 << 20)
    monkeypatch.setattr(hmm, "BLOCK_TOKENS", 200)
    two = score(docs.repartition(7).sortWithinPartitions("text"), 3000)
    np.testing.assert_allclose(one, two, rtol=1e-9)


def test_blocks_hold_whole_documents():
    rng = np.random.default_rng(10)
    for limit in (1, 7, 100, 10_000):
        lengths = rng.integers(1, 30, 50)
        found = [(a + s, b) for a, b, starts in hmm.blocks_of(lengths, limit) for s in starts]
        assert [f[0] for f in found] == [0, *np.cumsum(lengths)[:-1].tolist()]
        blocks = list(hmm.blocks_of(lengths, limit))
        assert blocks[-1][1] == lengths.sum() and all(x[1] == y[0] for x, y in zip(blocks, blocks[1:]))
        assert all(b - a <= limit or len(starts) == 1 for a, b, starts in blocks)
    assert list(hmm.blocks_of(np.zeros(0, np.int64), 5)) == []


def test_by_length_keeps_documents():
    rng = np.random.default_rng(11)
    docs = [rng.integers(0, 100, n) for n in rng.integers(1, 9, 40)]
    symbols, lengths = hmm.by_length(np.concatenate(docs), np.array([len(d) for d in docs]))
    assert lengths.tolist() == sorted((len(d) for d in docs), reverse=True)
    parts = np.split(symbols, np.cumsum(lengths)[:-1])
    assert sorted(p.tolist() for p in parts) == sorted(d.tolist() for d in docs)
