import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from sievework.llm import packing

PATH = public_tokenizers.path("byte_bpe_50k.json")


def test_encoder_equals_the_tokenizer():
    encode, plain = packing.WordEncoder(PATH), Tokenizer.from_file(PATH)
    for text in ["", "a", " a", "a b\nc d", "a  b", "a\n\nb", "x\n", "\tq r", "it's we'll  ", "Été ñ ß b", "a \n b", "'s 't\n's x's", "12 a1b2 __ !!\n$$ .", "a<|endoftext|> b", "　x y", "é ​ z", "🙂 🙂a", "a\r\nb c"]:
        assert np.frombuffer(encode(text), "<u4").tolist() == plain.encode(text, add_special_tokens=False).ids, text


def test_lower_bound_and_best_fit():
    rng = np.random.default_rng(1)
    for _ in range(30):
        cap = 20
        lengths = np.sort(rng.integers(1, cap + 1, rng.integers(1, 40)))[::-1]
        bins, offsets, room = packing.best_fit(lengths, cap)
        for b in range(len(room)):
            mine = lengths[bins == b]
            assert mine.sum() + room[b] == cap
            assert offsets[bins == b].tolist() == [0, *np.cumsum(mine)[:-1].tolist()]
        assert packing.lower_bound(np.bincount(lengths, minlength=cap + 1)) <= len(room)
    assert packing.lower_bound(np.bincount([11, 11, 11], minlength=21)) == 3
    assert packing.lower_bound(np.zeros(21, int)) == 0


@pytest.fixture
def docs(spark):
    rows = [(1, "a b c"), (2, None), (3, ""), (3, ""), (None, "x"), (5, "word " * 5000), (6, "a b c")] + [(100 + i, "t " * (i % 90)) for i in range(300)]
    return spark.createDataFrame([(i, t, "clash", 0) for i, t in rows], "doc_id long, text string, piece string, bin_ int")


def test_pack_documents(spark, docs):
    cap = 128
    rows = packing.pack_documents(docs, PATH, capacity=cap, per_partition=50).collect()
    plain = Tokenizer.from_file(PATH)
    expected = sum(len(plain.encode(r.text or "", add_special_tokens=False).ids) + 1 for r in docs.collect())
    assert sum(r.length for r in rows) == expected
    by = {}
    for r in rows:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for places in by.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= cap
    assert len(by) <= 1.03 * expected / cap + 2
    ids = np.array(plain.encode("word " * 5000, add_special_tokens=False).ids + [0], "<u4")
    mine = sorted((r.piece, r.start, r.length, r.ids_crc32) for r in rows if r.doc_id == 5)
    assert [m[0] for m in mine] == list(range(len(mine)))
    assert all(m[2] == cap for m in mine[1:])
    for _, start, length, crc in mine:
        assert zlib.crc32(ids[start : start + length].tobytes()) == crc


def test_pack_empty(spark, docs):
    assert packing.pack_documents(docs.limit(0), PATH).count() == 0


def test_partitions():
    assert [packing.partitions_for(n, 16384) for n in (0, 1, 16385, 16384 * 5000, 1 << 32)] == [1, 1, 2, 4096, 16384]
    assert packing.partitions_for(40, 10) == 4


def fewest_bins(lengths, capacity):
    """The fewest bins of a few lengths, by trying all places of each."""
    best = len(lengths)

    def place(k, rooms):
        nonlocal best
        if len(rooms) >= best and k < len(lengths):
            return
        if k == len(lengths):
            best = min(best, len(rooms))
            return
        for i in range(len(rooms)):
            if rooms[i] >= lengths[k] and rooms[i] not in rooms[:i]:
                place(k + 1, [*rooms[:i], rooms[i] - lengths[k], *rooms[i + 1 :]])
        place(k + 1, [*rooms, capacity - lengths[k]])

    place(0, [])
    return best


def test_bound_and_packing_against_the_optimum():
    rng = np.random.default_rng(7)
    met = 0
    for _ in range(60):
        cap = 30
        lengths = np.sort(rng.integers(3, 22, rng.integers(2, 9)))[::-1]
        least = fewest_bins(lengths.tolist(), cap)
        bound = packing.lower_bound(np.bincount(lengths, minlength=cap + 1))
        used = len(packing.best_fit(lengths, cap)[2])
        assert bound <= least <= used <= least + 1
        met += bound == used
    assert met > 30


def test_exchange_lowers_the_count(spark):
    """Partitions that each leave room exchange their open bins' pieces and need fewer bins in all."""
    rng = np.random.default_rng(8)
    rows = [(k, 0, 0, int(n), 0) for k, n in enumerate(rng.integers(20, 60, 400))]
    pieces = spark.createDataFrame(rows, packing.PIECES)
    count = lambda rounds: packing.pack(pieces, 100, 10, rounds).select("sequence_id").distinct().count()
    once, exchanged, whole = count(1), count(4), count(None)
    assert exchanged < once and whole < once and min(whole, exchanged) >= packing.lower_bound(np.bincount([r[3] for r in rows], minlength=101))
    report = packing.certificate(packing.pack(pieces, 100, 10), 100).first()
    assert report.sequences < once and report.gap == report.sequences - report.bound >= 0


def test_exchange_reaches_the_optimum(spark, caplog):
    """Sizes that leave one loose bin a partition, dealt over many small partitions: the optimum is known."""
    caplog.set_level("INFO", "sievework.llm.packing")
    rows = [(k, 0, 0, (50, 25)[k % 2], 0) for k in range(600)]
    packed = packing.pack(spark.createDataFrame(rows, packing.PIECES), 100, 10)
    assert packing.certificate(packed, 100).first() == (225, 225, 0)
    assert packed.groupBy("sequence_id").agg(F.sum("length").alias("n")).where("n <> 100").count() == 0
    assert "partitions certified" in caplog.text


def test_repeated_rows_part_ways(spark):
    same = spark.createDataFrame([(1, 0, 0, 40, 5)] * 2000, packing.PIECES)
    sizes = packing.deal(same, 2000, 0, 100).mapInPandas(lambda it: ([b.groupby("doc_id", as_index=False).size() for b in it if len(b)]), "doc_id long, size long").collect()
    assert sum(r["size"] for r in sizes) == 2000 and max(r["size"] for r in sizes) < 300
    packed = packing.pack(same, 100, 100)
    # Two of them fill a sequence.
    assert packed.count() == 2000 and packed.select("sequence_id").distinct().count() == 1000
