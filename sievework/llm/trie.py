"""Conversation prefix trie: every distinct sequence of first turns is a node, with totals over its subtree.

Patricia construction over sorted conversations:

1. Turns become 16-byte hashes of role and text and a length; texts travel no further. A conversation is the
   concatenation of its turns' hashes, so that a prefix of a conversation is a prefix of its bytes.
2. Conversations are dealt by ranges of (bytes, id) and sorted. A task goes through its range with a stack that holds
   only points of the compressed tree (branches, ends and leaves); an edge between two points stands for a run of
   unary nodes. Totals are sums over a point's range: members, their text beyond the point, distinct text below it
   (a conversation adds what lies beyond the prefix that it shares with the one before it), leaves, children.
3. When a point is complete its edge is expanded: the unary nodes on it share its members, and their saved tokens
   follow from suffix sums of the edge's turn lengths.
4. Nodes on the path of a task's first or last conversation may go on in a neighbouring range (open nodes). Their
   totals are summed by node over the ranges, and for each boundary the part that both ranges counted goes off.
   There are at most two paths a range, so a hot turn, or a conversation of very many copies, costs its sums only.

The digest of a node's ends needs them in order: a range's part of an open node's ends is text of END_IDS ids a row,
and one task hashes a node's rows one after the other.

Defined results: rows without a conversation id belong to no conversation and are left out; a null role or text is
empty; null turns come first, and rows of one turn are ordered by the hash of role and text; repeated rows are turns
each; an empty table has no nodes, not even the root; only the named columns are read. A conversation's turns are
sorted by one task.
"""

from __future__ import annotations

import hashlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize, table

WIDTH = 16
TURNS_PER_PARTITION = 1 << 20
END_IDS = 4096
ROWS_OUT = 20_000
NO_ENDS = hashlib.sha256(b"").hexdigest()


def hashed_turns(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, k, n): the hash of role and text, and the code points of the text."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    whole = F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text).cast("binary"), 256)
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), "turn", F.substring(F.unhex(whole), 1, WIDTH).alias("k"), F.length(text).alias("n"))
    return rows.where("conv_id is not null")


def sequences(turns: DataFrame) -> DataFrame:
    """(conv_id, turns): the conversations of hashed_turns in order, as arrays of (k, n)."""
    row = F.struct(F.col("turn").isNotNull().alias("later"), "turn", "k", "n")
    gathered = turns.groupBy("conv_id").agg(F.array_sort(F.collect_list(row)).alias("t"))
    return gathered.select("conv_id", F.transform("t", lambda x: F.struct(x.k.alias("k"), x.n.alias("n"))).alias("turns"))


def rebuilt(conversations: DataFrame, base: Column, head: Column, longest_head: int) -> DataFrame:
    """(conv_id, turns) where each conversation takes its first head turns from the conversation base.

    base and head (longest_head at most) are expressions of conv_id. A base's first turns meet the conversations of
    that base by a shuffle, so these should be few.
    """
    own = sequences(hashed_turns(conversations))
    heads = own.where(F.col("conv_id") == base).select(F.col("conv_id").alias("base_"), F.slice("turns", 1, longest_head).alias("first_"))
    joined = own.withColumn("base_", base).join(heads, "base_", "left").withColumn("h_", head)
    none = F.slice("turns", 1, 0)
    first = F.when(F.col("h_") > 0, F.slice(F.coalesce("first_", none), 1, F.greatest("h_", F.lit(1)))).otherwise(none)
    rest = F.slice("turns", F.col("h_") + 1, F.greatest(F.size("turns") - F.col("h_"), F.lit(0)))
    return joined.select("conv_id", F.concat(first, rest).alias("turns"))


def keyed(rows: DataFrame) -> DataFrame:
    """(key, lengths, conv_id) of (conv_id, turns)."""
    hexed = F.unhex(F.array_join(F.transform("turns", lambda t: F.hex(t.k)), ""))
    key = F.when(F.size("turns") > 0, hexed).otherwise(F.lit(b""))
    return rows.select(key.alias("key"), F.transform("turns", lambda t: t.n).alias("lengths"), "conv_id")


def shared_turns(a: bytes, b: bytes) -> int:
    """How many first turns two keys share."""
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n // WIDTH
    if n <= 64 * WIDTH:
        d = 0
        while a[d : d + WIDTH] == b[d : d + WIDTH]:
            d += WIDTH
        return d // WIDTH
    differ = np.frombuffer(a, np.uint8, n) != np.frombuffer(b, np.uint8, n)
    return int(differ.argmax()) // WIDTH


def chain(key: bytes) -> list[bytes]:
    """The names of the nodes on a key's path, the root's first."""
    h = hashlib.blake2b(digest_size=WIDTH)
    out = [h.digest()]
    for at in range(0, len(key), WIDTH):
        h.update(key[at : at + WIDTH])
        out.append(h.digest())
    return out


class Point:
    """A point of the compressed tree while its range is read."""

    __slots__ = ("beyond", "children", "depth", "ends", "leaves", "least", "members", "text", "tops")

    def __init__(self, depth: int):
        self.depth, self.members, self.children, self.leaves = depth, 0, 0, 0
        self.least: int | None = None
        self.beyond = self.text = 0  # the members' code points in all; distinct code points below the point
        self.ends = array("q")
        self.tops: list[int] = []  # rows of the children's edges next to this point

    def take(self, other: Point, edge: int) -> None:
        """Add a child's totals; edge is the text on the edge to it."""
        self.members += other.members
        self.leaves += other.leaves
        self.beyond += other.beyond
        self.text += other.text + edge
        self.children += 1
        if other.least is not None and (self.least is None or other.least < self.least):
            self.least = other.least


def digest_of(ids: array) -> str:
    return hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest() if ids else NO_ENDS


class Range:
    """The nodes of one range of sorted conversations. name is given for open nodes, up for those below an open one."""

    NUMBERS = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "prefix", "beyond", "text")

    def __init__(self, first_key: bytes):
        self.first = chain(first_key)
        self.on_first, self.started = len(first_key) // WIDTH, False
        self.columns = {c: array("q") for c in self.NUMBERS}
        self.sha: list[str] = []
        self.name: dict[int, bytes] = {}
        self.up: dict[int, bytes] = {}
        self.parts: list[tuple[bytes, array]] = []  # the ends of open nodes
        self.stack = [Point(0)]
        self.key, self.sums = b"", array("q", [0])

    def __len__(self) -> int:
        return len(self.sha)

    def add(self, key: bytes, lengths: list[int], conv: int) -> None:
        if self.started:
            shared = shared_turns(self.key, key)
            self.fold(shared, self.first)
            self.on_first = min(self.on_first, shared)
        if not self.started or key != self.key:
            sums = array("q", [0])
            for n in lengths:
                sums.append(sums[-1] + n)
            self.key, self.sums, self.started = key, sums, True
        depth = len(key) // WIDTH
        if self.stack[-1].depth < depth:
            self.stack.append(Point(depth))
        top = self.stack[-1]
        if top.members == 0 and top.children == 0:
            top.leaves = 1
        top.members += 1
        top.beyond += self.sums[depth]
        top.least = conv if top.least is None else min(top.least, conv)
        top.ends.append(conv)

    def fold(self, shared: int, names: list[bytes]) -> None:
        """Complete the points below the first shared turns of the last conversation."""
        while self.stack[-1].depth > shared:
            point = self.stack.pop()
            above = self.stack[-1]
            if above.depth < shared:
                above = Point(shared)
                self.stack.append(above)
            if not above.children:
                above.leaves = 0  # an end with a child is no leaf
            self.expand(point, above, min(self.on_first, point.depth), names)
            above.take(point, self.sums[point.depth] - self.sums[above.depth])

    def expand(self, point: Point, above: Point, open_to: int, names: list[bytes]) -> None:
        """Rows of the nodes on point's edge; those down to the depth open_to are open."""
        sums, c = self.sums, self.columns
        for d in range(point.depth, above.depth, -1):
            here, row = d == point.depth, len(self.sha)
            text = point.text + sums[point.depth] - sums[d]
            own = sums[d] - sums[d - 1]
            saved = point.beyond - point.members * sums[d] - text + (point.members - 1) * own
            values = (point.least, d, point.least, point.members, point.children if here else 1, point.leaves, saved, sums[d], point.beyond, text)
            for column_, value in zip(c.values(), values):
                column_.append(value)
            is_open = d <= open_to
            self.sha.append("" if is_open and here and point.ends else digest_of(point.ends) if here else NO_ENDS)
            if is_open:
                self.name[row] = names[d]
                if here and point.ends:
                    self.parts.append((names[d], point.ends))
            if d - 1 <= open_to:
                self.up[row] = names[d - 1]
            elif d - 1 == above.depth:
                above.tops.append(row)
        for row in point.tops:
            c["parent_conv_id"][row] = point.least

    def close(self) -> None:
        """Complete the last conversation's path, all of whose nodes are open, and the root."""
        names = chain(self.key)
        for point in self.stack:  # rows below the last path's nodes name their parents
            for row in point.tops:
                self.up[row] = names[point.depth]
            point.tops = []
        self.on_first = self.stack[-1].depth
        self.fold(0, names)
        root = self.stack[0]
        c, row = self.columns, len(self.sha)
        saved = root.beyond - root.text
        for column_, value in zip(c.values(), (root.least, 0, root.least, root.members, root.children, root.leaves, saved, 0, root.beyond, root.text)):
            column_.append(value)
        self.sha.append("" if root.ends else NO_ENDS)
        self.name[row] = names[0]
        if root.ends:
            self.parts.append((names[0], root.ends))


NODES = "kind string, part int, conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, prefix long, beyond long, text long, ends_sha256 string, name binary, up binary, ids string, first_key binary, first_lengths array<int>, last_key binary"


def patricia(rows: DataFrame) -> DataFrame:
    """The ranges' rows: kind node (complete), open (a range's part of a node), ends (of open nodes) and edge (the range's ends)."""
    arrow = pa.schema([("kind", pa.string()), ("part", pa.int32()), *((c, pa.int64()) for c in Range.NUMBERS), ("ends_sha256", pa.string()), ("name", pa.binary()), ("up", pa.binary()), ("ids", pa.string()), ("first_key", pa.binary()), ("first_lengths", pa.list_(pa.int32())), ("last_key", pa.binary())])

    def batch_of(columns: dict[str, pa.Array], n: int) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([columns.get(f.name, pa.nulls(n, f.type)) for f in arrow], schema=arrow)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, found, first = TaskContext.get().partitionId(), None, None
        for batch in batches:
            for key, lengths, conv in zip(batch.column(0), batch.column(1), batch.column(2)):
                key, lengths = key.as_py(), lengths.as_py()
                if found is None:
                    found, first = Range(key), (key, lengths)
                found.add(key, lengths, conv.as_py())
        if found is None:
            return
        last = found.key
        found.close()
        for a in range(0, len(found), ROWS_OUT):
            b = min(len(found), a + ROWS_OUT)
            names = [found.name.get(i) for i in range(a, b)]
            columns = {"kind": pa.array(["node" if x is None else "open" for x in names]), "part": pa.array(np.full(b - a, part, np.int32)), "ends_sha256": pa.array(found.sha[a:b]), "name": pa.array(names, pa.binary()), "up": pa.array([found.up.get(i) for i in range(a, b)], pa.binary())}
            columns |= {c: pa.array(np.frombuffer(v, np.int64)[a:b]) for c, v in found.columns.items()}
            yield batch_of(columns, b - a)
        for name, ids in found.parts:
            for a in range(0, len(ids), END_IDS):
                some = ids[a : a + END_IDS]
                yield batch_of({"kind": pa.array(["ends"]), "part": pa.array([part], pa.int32()), "depth": pa.array([a]), "name": pa.array([name], pa.binary()), "ids": pa.array([",".join(map(str, some))])}, 1)
        yield batch_of({"kind": pa.array(["edge"]), "part": pa.array([part], pa.int32()), "first_key": pa.array([first[0]], pa.binary()), "first_lengths": pa.array([first[1]], pa.list_(pa.int32())), "last_key": pa.array([last], pa.binary())}, 1)

    return rows.mapInArrow(run, NODES)


def boundary_corrections(edges: DataFrame) -> DataFrame:
    """(name, n_children, n_leaves, text) to add to open nodes: what a range and the one before it both counted.

    edges has one row a range (of any rows), so their order is a window over as many rows as there are ranges.
    """
    from pyspark.sql import Window

    beside = edges.select(F.lag("last_key").over(Window.orderBy("part")).alias("before"), "first_key", "first_lengths").where("before is not null")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for before, key, lengths in zip(*(batch.column(c) for c in range(3))):
                before, key = before.as_py(), key.as_py()
                shared = shared_turns(before, key)
                sums = np.append(0, np.cumsum(lengths.as_py() or [], dtype=np.int64))
                text = sums[: shared + 1] - sums[shared]
                children = np.where(np.arange(shared + 1) < shared, -1, 0)
                leaves = np.full(shared + 1, -1 if shared == len(before) // WIDTH else 0)
                names = pa.array(chain(key)[: shared + 1], pa.binary())
                yield pa.RecordBatch.from_arrays([names, *(pa.array(x.astype(np.int64)) for x in (children, leaves, text))], ["name", "n_children", "n_leaves", "text"])

    return beside.mapInArrow(run, "name binary, n_children long, n_leaves long, text long")


def hashed_ends(parts: DataFrame) -> DataFrame:
    """(name, ends_sha256) of the ends of open nodes; a node's rows are read one after the other."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, h = None, None

        def one() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([last], pa.binary()), pa.array([h.hexdigest()])], ["name", "ends_sha256"])

        for batch in batches:
            for name, ids in zip(batch.column(0).to_pylist(), batch.column(1)):
                if name != last:
                    if last is not None:
                        yield one()
                    last, h = name, hashlib.sha256()
                else:
                    h.update(b",")
                h.update(ids.as_py().encode())
        if last is not None:
            yield one()

    ordered = parts.select("name", "ids", "part", "depth").repartition("name").sortWithinPartitions("name", "part", "depth")
    return ordered.select("name", "ids").mapInArrow(run, "name binary, ends_sha256 string")


COLUMNS = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


def trie(rows: DataFrame) -> DataFrame:
    """The nodes of the conversations (conv_id, turns), with the columns of COLUMNS."""
    spark = rows.sparkSession
    made = materialize(keyed(rows), "sequences")
    turns = made.agg(F.coalesce(F.sum(F.size("lengths") + 1), F.lit(0))).first()[0]
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-turns // TURNS_PER_PARTITION))
    dealt = made.repartitionByRange(parts, "key", "conv_id").sortWithinPartitions("key", "conv_id")
    found = materialize(patricia(dealt), "nodes")

    opened = found.where("kind = 'open'")
    corrections = boundary_corrections(found.where("kind = 'edge'").select("part", "first_key", "first_lengths", "last_key"))
    zero = {c: F.lit(None).cast("long") for c in ("conv_id", "depth", "n_convs", "prefix", "beyond")}
    summed = opened.select("name", "n_children", "n_leaves", "text", *zero, "up").unionByName(corrections.withColumns(zero | {"up": F.lit(None).cast("binary")}))
    totals = [F.sum(c).alias(c) for c in ("n_children", "n_leaves", "text", "n_convs", "beyond")]
    nodes = summed.groupBy("name").agg(*totals, F.min("conv_id").alias("conv_id"), F.max("depth").alias("depth"), F.max("prefix").alias("prefix"), F.max("up").alias("up"))
    nodes = materialize(nodes, "open")

    least = nodes.select(F.col("name").alias("up"), F.col("conv_id").alias("parent_conv_id"), F.col("prefix").alias("before"))
    ends = hashed_ends(found.where("kind = 'ends'"))
    saved = F.col("beyond") - F.col("n_convs") * F.col("prefix") - F.col("text") + (F.col("n_convs") - 1) * (F.col("prefix") - F.coalesce("before", "prefix"))
    whole = nodes.join(least, "up", "left").join(ends, "name", "left").withColumn("saved_tokens", saved).withColumn("ends_sha256", F.coalesce("ends_sha256", F.lit(NO_ENDS)))

    closed = found.where("kind = 'node'")
    # A range's rows below an open node meet it by node and range, so the children of a hot node do not meet in one task.
    seen = opened.select("part", F.col("name").alias("up")).distinct().join(least.drop("before"), "up")
    below = closed.where("up is not null").drop("parent_conv_id").join(seen, ["part", "up"])
    return closed.where("up is null").select(*COLUMNS).unionByName(below.select(*COLUMNS)).unionByName(whole.select(*COLUMNS))


def shared_heads(conversations: DataFrame) -> DataFrame:
    """The query's conversations: the first crc32(id) % 6 turns come from the conversation of the same hundred."""
    conv = F.col("conv_id")
    return rebuilt(conversations, conv - conv % 100, (F.crc32(conv.cast("string").cast("binary")) % 6).cast("int"), 5)


ORACLE_SQL = """
WITH crc_table AS (
  SELECT list(v ORDER BY i) AS t FROM (
    SELECT i, list_reduce(list_prepend(i, range(8)), lambda a, b: CASE WHEN a % 2 = 1 THEN xor(a // 2, 3988292384) ELSE a // 2 END) AS v FROM range(256) r(i))
), ids AS (
  SELECT conv_id, xor(list_reduce(list_prepend(4294967295, list_transform(string_split(conv_id::VARCHAR, ''), lambda x: ord(x)::BIGINT)),
    lambda a, b: xor(a // 256, t[(xor(a % 256, b) + 1)::INT])), 4294967295) % 6 AS h
  FROM (SELECT DISTINCT conv_id::BIGINT AS conv_id FROM conversations WHERE conv_id IS NOT NULL), crc_table
), turns AS (
  SELECT conv_id, k, n, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, k) AS p
  FROM (SELECT conv_id::BIGINT AS conv_id, turn, sha256(strlen(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS k, length(coalesce(text, '')) AS n
        FROM conversations WHERE conv_id IS NOT NULL)
), placed AS (
  SELECT i.conv_id, 0 AS part, t.p, t.k, t.n FROM ids i JOIN turns t ON t.conv_id = i.conv_id - i.conv_id % 100 AND t.p <= i.h
  UNION ALL SELECT i.conv_id, 1, t.p, t.k, t.n FROM ids i JOIN turns t ON t.conv_id = i.conv_id AND t.p > i.h
), steps AS (
  SELECT conv_id, row_number() OVER w AS d, n, sha256(string_agg(k, '') OVER w) AS key
  FROM placed WINDOW w AS (PARTITION BY conv_id ORDER BY part, p)
), paths AS (
  SELECT conv_id, d, n, key, coalesce(lag(key) OVER (PARTITION BY conv_id ORDER BY d), 'root') AS up FROM steps
  UNION ALL SELECT conv_id, 0, 0, 'root', NULL FROM ids
), nodes AS (
  SELECT key, any_value(up) AS up, min(conv_id) AS conv_id, any_value(d) AS depth, count(*) AS n_convs, any_value(n) AS n FROM paths GROUP BY key
), children AS (SELECT up AS key, count(*) AS n_children FROM nodes WHERE up IS NOT NULL GROUP BY up),
lasts AS (SELECT conv_id, arg_max(key, d) AS last FROM paths GROUP BY conv_id),
leaves AS (
  SELECT p.key, count(DISTINCT l.last) AS n_leaves FROM paths p JOIN lasts l USING (conv_id)
  WHERE l.last NOT IN (SELECT key FROM children) GROUP BY p.key
), saved AS (
  SELECT p.key, sum((v.n_convs - 1) * v.n) AS saved_tokens FROM nodes v JOIN paths p ON p.conv_id = v.conv_id AND p.d <= v.depth GROUP BY p.key
), ends AS (SELECT last AS key, sha256(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id)) AS ends_sha256 FROM lasts GROUP BY last)
SELECT v.conv_id, v.depth::BIGINT AS depth, u.conv_id AS parent_conv_id, v.n_convs::BIGINT AS n_convs, coalesce(n_children, 0)::BIGINT AS n_children, n_leaves::BIGINT AS n_leaves,
  saved_tokens::BIGINT AS saved_tokens, coalesce(ends_sha256, sha256('')) AS ends_sha256
FROM nodes v LEFT JOIN nodes u ON u.key = v.up LEFT JOIN children c ON c.key = v.key LEFT JOIN leaves l ON l.key = v.key LEFT JOIN saved s ON s.key = v.key LEFT JOIN ends e ON e.key = v.key
"""


def op11_conversation_trie(spark, sf_dir: str) -> DataFrame:
    return trie(shared_heads(table(spark, sf_dir, "conversations")))
