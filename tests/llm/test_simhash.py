import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from sievework.llm import simhash
from sievework.llm.common import connected_components, least_of, meet, open_links


def slow_fingerprint(text):
    text = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(nodes, linked):
    parent = {n: n for n in nodes}

    def root(n):
        while parent[n] != n:
            n = parent[n]
        return n

    for a in nodes:
        for b in nodes:
            if a < b and linked(a, b):
                x, y = sorted((root(a), root(b)))
                parent[y] = x
    return {n: root(n) for n in nodes}


def test_fingerprint():
    rng = np.random.default_rng(0)
    texts = [None, "", " \t\n", "A", "a B c", "a b c d", "É a\x0bb\x0cc d e", "x y z w v"] + [" ".join(rng.choice(list("abcdefg"), n)) for n in (5, 200, 255, 258, 700, 5000)]
    for text in texts:
        assert simhash.fingerprint(text) == slow_fingerprint(text)


@pytest.fixture
def points():
    rng = np.random.default_rng(3)
    seeds = rng.integers(0, 2**63, 120, dtype=np.uint64)
    out = set(seeds.tolist())
    for s in seeds[:60].tolist():
        for _ in range(8):
            flips = rng.choice(64, rng.integers(1, 7), replace=False)
            out.add(s ^ int(sum(1 << int(f) for f in flips)))
    out.add((1 << 64) - 1)
    out.add(0)
    return sorted(out)


@pytest.mark.parametrize("tile,small", [(4, 32), (16, 32), (8192, 32), (8192, 1)])
def test_links_lose_nothing(spark, points, tile, small, monkeypatch):
    monkeypatch.setattr(simhash, "SMALL", small)
    want = brute_components(points, lambda a, b: (a ^ b).bit_count() <= 4)
    df = spark.createDataFrame([(int(np.uint64(p).view(np.int64)),) for p in points], "fp long")
    pairs = simhash.links(df, tile=tile).collect()
    back = lambda v: int(np.int64(v).view(np.uint64))
    found = {(back(r.a), back(r.b)) for r in pairs}
    got = brute_components(points, lambda a, b: (a, b) in found or (b, a) in found)
    assert got == want


def test_segment_counts_bound_the_distance(spark, points):
    df = spark.createDataFrame([(int(np.uint64(p).view(np.int64)),) for p in points], "fp long")
    got = {r.fp: r.c for r in df.select("fp", simhash.segment_counts(df.fp).alias("c")).collect()}
    for p in points:
        c = int(np.int64(got[int(np.uint64(p).view(np.int64))]).view(np.uint64))
        assert [(c >> 2 * k) & 3 for k in range(32)] == [((p >> 2 * k) & 3).bit_count() for k in range(32)]
    assert sum(simhash.GROUPS) == (1 << 64) - 1
    unary = simhash.unary_counts(np.array(points, np.uint64)).tolist()
    counts = [[((p >> 2 * k) & 3).bit_count() for k in range(32)] for p in points]
    for i in range(0, len(points), 7):
        for j in range(len(points)):
            apart = sum(abs(a - b) for a, b in zip(counts[i], counts[j]))
            assert (unary[i] ^ unary[j]).bit_count() == apart <= (points[i] ^ points[j]).bit_count()


def test_components(spark):
    base = "one two three four five six seven eight nine ten " * 30
    rows = [(5, base), (3, base), (3, base), (9, base + "eleven"), (None, base), (20, "something else entirely here now"), (21, None), (22, ""), (23, "  "), (None, "alone without an id at all")]
    docs = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id long, text string, fp string, component_id int")
    prints = simhash.fingerprints(docs)
    got = simhash.components(prints).collect()
    nodes = sorted({slow_fingerprint(t) for _, t in rows})
    comp = brute_components(nodes, lambda a, b: (a ^ b).bit_count() <= 4)
    least = {}
    for i, t in rows:
        if i is not None:
            c = comp[slow_fingerprint(t)]
            least[c] = min(least.get(c, i), i)
    key = lambda p: (p[0] is None, p[0] or 0, p[1] or 0)
    want = sorted(((i, least.get(comp[slow_fingerprint(t)])) for i, t in rows), key=key)
    assert sorted(((r.doc_id, r.component_id) for r in got), key=key) == want
    kept = simhash.keep_first(docs)
    assert kept.columns == docs.columns
    alone = [t for i, t in rows if i is None and comp[slow_fingerprint(t)] not in least]
    assert sorted((r.doc_id for r in kept.collect() if r.doc_id is not None)) == sorted(set(least.values()))
    assert [r.text for r in kept.collect() if r.doc_id is None] == alone
    assert simhash.components(simhash.fingerprints(docs.limit(0))).count() == 0


def brute_keep(rows):
    """For each component of (id, text) rows the one that stays: that with the smallest id, any where none has one."""
    prints = [slow_fingerprint(t) for _, t in rows]
    comp = brute_components(sorted(set(prints)), lambda a, b: (a ^ b).bit_count() <= 4)
    groups = {}
    for (i, t), p in zip(rows, prints):
        groups.setdefault(comp[p], []).append((i, t))
    return list(groups.values())


def test_keep_first_drops_only_near_duplicates(spark):
    base = "one two three four five six seven eight nine ten " * 30
    other = "a wholly different text that stands for itself alone here"
    third = "and yet another one of which nothing is shared with any"
    rows = [(1, base), (1, other), (None, third), (None, third), (None, base), (7, base + "eleven"), (8, third), (9, "x " * 400), (9, "x " * 400), (9, "x " * 400), (None, "unique words without any id to name them"), (-1, "unique words without any id to name them"), (3, None), (4, ""), (None, None)]
    docs = spark.createDataFrame([(i, t, "clash", [1], {"k": 1}, k) for k, (i, t) in enumerate(rows)], "doc_id long, text string, id_ string, hash_ array<int>, row_ map<string,int>, k int")
    kept = simhash.keep_first(docs.repartition(3))
    assert kept.columns == docs.columns
    got = [(r.doc_id, r.text) for r in kept.collect()]
    groups = brute_keep(rows)
    assert len(got) == len(groups)
    for group in groups:
        ids = [i for i, _ in group if i is not None]
        mine = [g for g in got if g in group]
        assert len(mine) == 1 and mine[0][0] == (min(ids) if ids else None)
    again = [(r.doc_id, r.text, r.k) for r in simhash.keep_first(docs.repartition(7, "k")).collect()]
    assert sorted(again, key=str) == sorted(((r.doc_id, r.text, r.k) for r in kept.collect()), key=str)
    assert simhash.keep_first(docs.limit(0)).count() == 0


def test_component_of_half_the_rows(spark):
    """The centre of a large star is a hot key: above one in HOT_SHARE of the links."""
    edges = [(0, 10 + k) for k in range(3000)] + [(10 + 7 * k, 20_000 + k) for k in range(300)] + [(50_000 + 2 * k, 50_001 + 2 * k) for k in range(2500)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    want = {n: 0 for a, b in edges[:3300] for n in (a, b)} | {n: a for a, b in edges[3300:] for n in (a, b)}
    assert got == want
    texts = [(k, "the same text again and again in many rows") for k in range(2000)] + [(5000 + k, f"text {k} of its own {k * 7} words {k * 13}") for k in range(300)]
    prints = simhash.fingerprints(spark.createDataFrame(texts, "doc_id long, text string"))
    found = {r.doc_id: r.component_id for r in simhash.components(prints).collect()}
    assert len(found) == len(texts) and all(found[k] == 0 for k in range(2000))


def test_meet_joins_each_row_once(spark):
    rows = spark.createDataFrame([(k % 7 if k % 2 else 0, k) for k in range(200)] + [(None, -1), (99, -2)], "k long, v int")
    side = spark.createDataFrame([(k, k == 0, k * 10) for k in range(7)], "k long, hot boolean, w int")
    got = sorted((r.k, r.v, r.w) for r in meet(rows, side, ["k"], F.col("hot")).collect())
    assert got == sorted((k % 7 if k % 2 else 0, k, (k % 7 if k % 2 else 0) * 10) for k in range(200))


def test_connected_components(spark):
    rng = np.random.default_rng(5)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 400, (260, 2))] + [(1000 + i, 1001 + i) for i in range(60)] + [(7, 7)]
    nodes = sorted({n for e in edges if e[0] != e[1] for n in e})
    pairs = {tuple(sorted(e)) for e in edges}
    want = brute_components(nodes, lambda a, b: (a, b) in pairs)
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == want


def test_open_links(spark):
    """Stars around their least nodes are settled; a node with two links or a link onward is not."""
    for edges, more in (([], False), ([(5, 1), (6, 1), (9, 2)], False), ([(5, 1), (5, 2)], True), ([(5, 3), (3, 1)], True)):
        assert open_links(spark.createDataFrame(edges, "u long, v long")) == (len(edges), more)


def test_least_of():
    assert least_of(np.array([0, 0, 2, 0, 2]), np.array([7, 5, -1, 9, -3])).tolist() == [5, 5, -3, 5, -3]
