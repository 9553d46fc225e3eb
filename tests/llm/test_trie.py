"""The prefix trie against a brute-force version that walks every prefix, and against its SQL."""

import hashlib
import random
import zlib
from collections import defaultdict

import duckdb
import pytest
from pyspark.sql import functions as F

from sievework.llm import trie


def brute(rows):
    turns = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            role, text = role or "", text or ""
            k = hashlib.sha256(f"{len(role.encode())}:{role}{text}".encode()).hexdigest()
            turns[conv].append((turn is not None, turn or 0, k, role, text))
    own = {c: [(r, t) for *_, r, t in sorted(x)] for c, x in turns.items()}
    convs = {}
    for c in own:
        h = zlib.crc32(str(c).encode()) % 6
        base = c - (c % 100 if c >= 0 else -(-c % 100))
        convs[c] = tuple(own.get(base, [])[:h] + own[c][h:])
    members = defaultdict(list)
    for c, seq in convs.items():
        for d in range(len(seq) + 1):
            members[seq[:d]].append(c)
    children = defaultdict(set)
    for seq in members:
        if seq:
            children[seq[:-1]].add(seq)
    leaves, saved = defaultdict(int), defaultdict(int)
    for seq, who in members.items():
        for d in range(len(seq) + 1):
            leaves[seq[:d]] += not children[seq]
            saved[seq[:d]] += (len(who) - 1) * len(seq[-1][1]) if seq else 0
    ends = defaultdict(list)
    for c, seq in convs.items():
        ends[seq].append(c)
    sha = lambda seq: hashlib.sha256(",".join(map(str, sorted(ends[seq]))).encode()).hexdigest()
    return sorted((min(w), len(s), min(members[s[:-1]]) if s else None, len(w), len(children[s]), leaves[s], saved[s], sha(s)) for s, w in list(members.items()))


def run(spark, rows, partitions=None):
    made = spark.createDataFrame([(c, t, r, x, 5, "z") for c, t, r, x in rows], "conv_id long, turn int, role string, text string, depth int, key string")
    before = spark.conf.get("spark.sql.shuffle.partitions")
    if partitions:
        spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        return sorted((tuple(r[c] for c in trie.COLUMNS) for r in trie.trie(trie.shared_heads(made)).collect()), key=lambda r: (r[0], r[1]))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def by_place(nodes):
    return sorted(nodes, key=lambda r: (r[0], r[1]))


def some_rows(seed, convs, letters="ab", longest=7):
    rng = random.Random(seed)
    rows = []
    for c in rng.sample(range(-150, 1000), convs):
        for t in range(rng.randrange(1, longest)):
            rows.append((c, t, rng.choice(["user", "assistant", None]), rng.choice([*letters, "", None])))
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("partitions", [1, 7, 40])
def test_random_conversations(spark, partitions):
    rows = some_rows(partitions, 120)
    assert run(spark, rows, partitions) == by_place(brute(rows))


def test_many_copies_over_many_ranges(spark):
    rows = [(c, t, "user", f"t{t}") for c in range(100, 400) for t in range(6)] + [(7, 0, "user", "else")]
    assert run(spark, rows, 30) == by_place(brute(rows))


def test_a_long_conversation_and_its_beginning(spark):
    rows = [(c, t, "user", f"x{t}") for c, n in ((100, 400), (111, 399), (112, 30), (113, 0)) for t in range(n)]
    assert run(spark, rows, 4) == by_place(brute(rows))


def test_nulls_ties_repeats_and_extra_columns(spark):
    rows = [(None, 1, "user", "lost"), (1, None, None, None), (1, None, None, None), (1, 1, "user", "b"), (1, 1, "user", "a"), (1, 1, "user", "a"), (2, 0, "user", "ü😀"), (200, 0, "", ""), (201, 5, "user", "")]
    assert run(spark, rows) == by_place(brute(rows))


def test_role_and_text_do_not_run_together(spark):
    rows = [(1, 0, "ab", "c"), (2, 0, "a", "bc")]
    assert run(spark, rows) == by_place(brute(rows))


def test_empty_table(spark):
    assert run(spark, []) == []
    assert run(spark, [(None, 0, "user", "x")]) == []


def test_equals_its_sql_and_brute_force_on_the_table(spark):
    path = "/root/testdata/sf0.001/conversations.parquet"
    found = by_place(tuple(r[c] for c in trie.COLUMNS) for r in trie.op11_conversation_trie(spark, "/root/testdata/sf0.001").collect())
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{path}'")
    assert found == by_place(con.execute(trie.ORACLE_SQL).fetchall())
    rows = [tuple(r) for r in spark.read.parquet(path).select("conv_id", F.col("turn").cast("int"), "role", "text").collect()]
    assert found == by_place(brute(rows))


def test_shared_turns_of_short_and_long_keys():
    a, b = bytes(16) * 100, bytes(16) * 99 + b"\x01" * 16
    assert trie.shared_turns(a, b) == 99
    assert trie.shared_turns(a[:64], b[:32]) == 2
    assert trie.shared_turns(b"", a) == 0
    assert trie.shared_turns(bytes(15) + b"\x01", bytes(16)) == 0
