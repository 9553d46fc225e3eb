import hashlib
import os
import zlib
from array import array

import numpy as np
import pytest
import sentencepiece

from sievework.llm import pieces

MODEL = pieces.default_model()
SF = "/root/testdata/sf0.001"
TEXTS = ["", None, "a", " a", "a  b", "x ", "  ", "a\nb c", "été ñ ß", "日本 語", "<s> </s>", "▁a b", "🙂 🙂a", "word " * 3000, "w" * 3000, "a\tb\r\n", "the the the", "the the the"]


@pytest.fixture
def docs(spark):
    rows = [(i, t) for i, t in enumerate(TEXTS)] + [(None, "no id")]
    return spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, ids string, word int")


def test_merge_encoding_equals_the_library(spark, docs):
    model = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    got = {r.doc_id: bytes(r.ids) for r in pieces.encode_documents(docs, MODEL).collect()}
    assert len(got) == len(TEXTS) + 1
    for i, t in enumerate(TEXTS):
        assert array("I", got[i]).tolist() == model.encode(t or ""), t


def test_round_trip_and_digest(spark, docs):
    encoded = pieces.encode_documents(docs, MODEL)
    back = {r.doc_id: r.text for r in pieces.decode_documents(encoded, MODEL).collect()}
    # The model has one character for a space and for the boundary mark.
    assert all(back[i] == (t or "").replace("▁", " ") for i, t in enumerate(TEXTS))
    for r in pieces.digest(encoded, MODEL).collect():
        if r.doc_id is not None:
            ids = sentencepiece.SentencePieceProcessor(model_file=MODEL).encode(TEXTS[r.doc_id] or "")
            assert (r.n_ids, r.ids_crc32, r.decoded_sha256) == (len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()), hashlib.sha256(back[r.doc_id].encode()).hexdigest())
    assert pieces.encode_documents(docs.limit(0), MODEL).count() == 0


def viterbi(word, scores, longest, unknown):
    best = [(0.0, [])] + [None] * len(word)
    for stop in range(1, len(word) + 1):
        for at in range(max(0, stop - longest), stop):
            piece = word[at:stop]
            value = scores.get(piece, (0, unknown) if stop - at == 1 else None)
            if value and best[at] and (best[stop] is None or best[at][0] + value[1] > best[stop][0] + 1e-12):
                best[stop] = (best[at][0] + value[1], [*best[at][1], value[0]])
    return best[-1][1]


def test_lattice_equals_viterbi(spark):
    rng = np.random.default_rng(4)
    letters = list("▁abcd")
    table = {"".join(rng.choice(letters, n)): None for n in rng.integers(1, 5, 60)}
    table = {p: (k + 1, round(float(-rng.random() * 5 * len(p) ** 0.7), 6)) for k, p in enumerate(table)}
    unknown = min(s for _, s in table.values()) - pieces.UNKNOWN_PENALTY
    frame = spark.createDataFrame([(p, k, s) for p, (k, s) in table.items()], "piece string, id int, score double")
    words = sorted({"".join(rng.choice([*letters, "z"], n)) for n in rng.integers(1, 14, 150)})
    got = {r.word: r.ids for r in pieces.encode_lattice(spark.createDataFrame([(w,) for w in words], "word string"), frame, 4).collect()}
    for w in words:
        assert got[w] == viterbi(w, table, 4, unknown), w
    docs = spark.createDataFrame([(1, "ab ba"), (2, ""), (3, None), (4, "ab ba")], "doc_id long, text string")
    out = {r.doc_id: r.ids for r in pieces.unigram_documents(docs, frame, 4).collect()}
    assert out[1] == out[4] == viterbi("▁ab", table, 4, unknown) + viterbi("▁ba", table, 4, unknown) and out[2] == out[3] == []


def test_merges_over_the_lattice_equal_the_library(spark, docs):
    model = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    got = {r.doc_id: r.ids for r in pieces.merge_documents(docs, MODEL).collect()}
    assert got.pop(None) == model.encode("no id")
    assert got == {i: model.encode(t or "") for i, t in enumerate(TEXTS)}
    assert pieces.merge_documents(docs.limit(0), MODEL).count() == 0


@pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")
def test_merges_over_the_lattice_equal_the_library_on_whole_documents(spark):
    model = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = {r.doc_id: r.ids for r in pieces.merge_documents(docs, MODEL).collect()}
    assert got == {r.doc_id: model.encode(r.text or "") for r in docs.collect()}


def merges(word, scores, unknown):
    symbols = list(word)
    while True:
        pairs = [(-scores[a + b][1], i) for i, (a, b) in enumerate(zip(symbols, symbols[1:])) if a + b in scores]
        if not pairs:
            return [scores[s][0] if s in scores else unknown for s in symbols]
        i = min(pairs)[1]
        symbols[i : i + 2] = [symbols[i] + symbols[i + 1]]


def test_merges_of_random_tables_with_ties_equal_plain_merging(spark):
    rng = np.random.default_rng(9)
    table = {"".join(rng.choice(list("abc"), n)): None for n in rng.integers(1, 5, 70)}
    table = {p: (k + 1, float(rng.integers(-9, 0))) for k, p in enumerate(table)}
    rows = [(p, k, s) for p, (k, s) in table.items()]
    frame = spark.createDataFrame([*rows, *[(p, k, s - 1) for p, k, s in rows[:9]]], "piece string, id int, score double")
    words = sorted({"".join(rng.choice(list("abcz"), n)) for n in rng.integers(1, 14, 300)})
    listed = spark.createDataFrame([(w,) for w in [*words, None]], "word string")
    got = {r.word: r.ids for r in pieces.encode_merges(listed, frame, 4, 99).collect()}
    assert got == {w: merges(w, table, 99) for w in words}
    none = {r.word: r.ids for r in pieces.encode_merges(listed, frame.limit(0), 4, 99).collect()}
    assert none == {w: [99] * len(w) for w in words}
    in_bytes = pieces.encode_merges(spark.createDataFrame([("é",)], "word string"), frame, 4, 99, 1000).first().ids
    assert in_bytes == [1000 + b for b in "é".encode()]
    unigram = {r.word: r.ids for r in pieces.encode_lattice(listed, frame.limit(0), 4, 99).collect()}
    assert unigram == none
