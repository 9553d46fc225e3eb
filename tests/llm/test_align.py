"""Alignment against a brute-force version: nested loops over the libraries' own tokens."""

import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import pytest

from sievework.llm import align
from sievework.llm.packing import default_tokenizer
from sievework.llm.pieces import default_model


@pytest.fixture(scope="module")
def libraries():
    import sentencepiece
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(default_tokenizer())
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=default_model())


def spans(ids, spell):
    out, at = [], 0
    for i in ids:
        out.append((i, at, at + len(spell[i])))
        at += len(spell[i])
    return out


def brute(rows, libraries):
    a_lib, b_lib = libraries
    spell_a, spell_b = align.byte_level_tokens(default_tokenizer()), align.piece_tokens(b_lib)
    docs, held = [], defaultdict(set)
    for k, (doc, text) in enumerate(rows):
        a = a_lib.encode(" " + (text or ""), add_special_tokens=False).ids if text else []
        b = b_lib.encode(text) if text else []
        raw = (" " + (text or "")).encode()
        if not text or b"".join(spell_a[i] for i in a) != raw or b"".join(spell_b[i] for i in b) != raw:
            docs.append((doc, [], [], "", 0, []))
            continue
        left, right = spans(a, spell_a), spans(b, spell_b)
        cuts = sorted({e for _, _, e in left} & {e for _, _, e in right})
        parts, before = [], 0
        for cut in cuts:
            inside = [",".join(str(i) for i, s, e in side if before <= s and e <= cut) for side in (left, right)]
            parts.append("|".join(inside))
            before = cut
        links = [(i, j) for i, s, e in left for j, t, f in right if s < f and t < e]
        for pair in links:
            held[pair].add(k)
        docs.append((doc, a, b, hashlib.sha256(";".join(parts).encode()).hexdigest(), len(cuts), links))
    count = {pair: len(x) for pair, x in held.items()}
    most = Counter()
    for (i, _), n in count.items():
        most[i] = max(most[i], n)
    return sorted(
        ((d, len(a), len(b), groups, len(links), sum(count[p] == most[p[0]] for p in links), sum(count[p] for p in links), sha) for d, a, b, sha, groups, links in docs),
        key=str,
    )


NAMES = ("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


def run(spark, rows, **options):
    docs = spark.createDataFrame([(d, t, 1) for d, t in rows], "doc_id long, text string, n_a int")
    found = align.link_documents(docs, default_tokenizer(), default_model(), **options)
    return sorted((tuple(r[c] for c in NAMES) for r in found.collect()), key=str)


ODD = [
    (1, None), (2, ""), (3, " "), (4, "  two  spaces "), (5, "a▁b"), (6, "<s> <|endoftext|> <unk> <0x41>"), (7, "line\nnext\n\n last"), (8, "tab\there x 　y"),
    (9, "naïve 😀 façade ﬁ"), (10, "it's the same"), (11, "it's the same"), (11, "it's the same"), (None, "no id at all"), (12, "x" * 700), (13, "foo\n \nbar"), (14, "\u0000 nul é"), (15, "Trailing\n"),
]


def test_odd_texts_equal_brute_force(spark, libraries):
    assert run(spark, ODD) == brute(ODD, libraries)


def test_random_texts_in_small_blocks_and_chunks(spark, libraries):
    rng = random.Random(3)
    letters = ["a", "the", "ing", " ", " ", "é", "ß", "\n", "1", "'s", "ción", ".", "漢"]
    rows = [(i, "".join(rng.choice(letters) for _ in range(rng.randrange(60)))) for i in range(150)]
    want = brute(rows, libraries)
    assert run(spark, rows) == want
    assert run(spark, rows, chunk_links=50, block_bytes=100) == want


def test_documents_of_the_table_equal_brute_force(spark, libraries):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()
    rows = [(r.doc_id, r.text) for r in sorted(docs, key=lambda r: len(r.text or ""))[:60]]
    assert run(spark, rows) == brute(rows, libraries)


def test_empty_table(spark):
    assert run(spark, []) == []


def test_a_very_long_text(spark, libraries):
    text = "une phrase très longue, " * 20_000
    rows = run(spark, [(1, text)], chunk_links=1000, block_bytes=1000)
    a, b = libraries[0].encode(" " + text, add_special_tokens=False).ids, libraries[1].encode(text)
    assert rows[0][1:3] == (len(a), len(b)) and rows[0][4] == rows[0][6]


def test_links_of_crossing_tokens():
    a, b = np.array([7, 8, 9]), np.array([1, 2])
    cuts, group_a, group_b, link_a, link_b = align.align(a, b, np.array([2, 5, 6]), np.array([3, 6]))
    assert cuts.tolist() == [6] and group_a.tolist() == [0, 0, 0] and group_b.tolist() == [0, 0]
    assert list(zip(link_a.tolist(), link_b.tolist())) == [(0, 0), (1, 0), (1, 1), (2, 1)]
