"""What the operators of this subpackage share: shared storage, Arrow helpers, components of links."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

CHECKPOINT_KEY = "spark.checkpoint.dir"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """A new folder under the one that the cluster names in spark.checkpoint.dir, as a URI.

    Where that is unset, a temporary folder takes its place for the session, on one machine (local mode) only.
    """
    top = spark.conf.get(CHECKPOINT_KEY, None)
    if not top:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError(f"{CHECKPOINT_KEY} must name a folder that all executors share")
        top = "file://" + tempfile.mkdtemp(prefix="sievework-")
        spark.conf.set(CHECKPOINT_KEY, top)
    return f"{top.rstrip('/')}/sievework-{spark.sparkContext.applicationId}/{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared folder and read it back: cuts lineage and survives lost executors."""
    path = f"{shared_dir(df.sparkSession)}/{name}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def column(batch: pa.RecordBatch, name: str) -> np.ndarray:
    """A column without nulls as a numpy array."""
    return batch.column(batch.schema.get_field_index(name)).to_numpy(zero_copy_only=False)


def sorted_groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[tuple, pa.Table]]:
    """The groups of a partition that is sorted by keys (without nulls), each whole, one at a time."""
    held: list[pa.RecordBatch] = []
    last: tuple | None = None
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        cols = [column(batch, k) for k in keys]
        change = np.zeros(n, bool)
        for c in cols:
            change[1:] |= c[1:] != c[:-1]
        starts = np.flatnonzero(change).tolist()
        bounds = [0, *starts, n]
        for a, b in zip(bounds, bounds[1:]):
            key = tuple(c[a] for c in cols)
            if last is not None and key != last:
                yield last, pa.Table.from_batches(held)
                held = []
            last = key
            held.append(batch.slice(a, b - a))
    if last is not None:
        yield last, pa.Table.from_batches(held)


def whole_groups(batches: Iterator[pa.RecordBatch], keys: list[str], rows: int) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Tables of about rows rows of a partition that is sorted by keys (without nulls), and where groups start in them.

    A group is never divided, so a table exceeds rows by one group at most.
    """
    held: list[pa.RecordBatch] = []

    def cut(last: bool) -> tuple[pa.Table, np.ndarray]:
        table = pa.Table.from_batches(held).combine_chunks()
        change = np.append(True, np.zeros(len(table) - 1, bool))
        for k in keys:
            values = table.column(k).to_numpy()
            change[1:] |= values[1:] != values[:-1]
        starts = np.flatnonzero(change)
        held.clear()
        if last:
            return table, starts
        held.extend(table.slice(int(starts[-1])).to_batches())
        return table.slice(0, int(starts[-1])), starts[:-1]

    held_rows = 0
    for batch in batches:
        if batch.num_rows:
            held.append(batch)
            held_rows += batch.num_rows
        if held_rows >= rows:
            table, starts = cut(False)
            if len(starts):
                yield table, starts
            held_rows = 0
    if held:
        yield cut(True)


def star_edges(matches: Iterator[tuple[int, np.ndarray]], n: int) -> np.ndarray:
    """Components of n members from (i, indexes linked with i): for each member the first of its component."""
    labels = np.arange(n)
    for i, found in matches:
        seen = labels[found]
        if len(seen) and (seen.min() != labels[i] or seen.max() != labels[i]):
            roots = np.unique(np.append(seen, labels[i]))
            labels[np.isin(labels, roots[1:])] = roots[0]
    return labels


def unite(root: np.ndarray, i: np.ndarray, j: np.ndarray) -> None:
    """Join the components of i[k] and j[k] in place; root holds for each member the first of its component."""
    while len(i):
        a, b = root[i], root[j]
        apart = a != b
        i, j, a, b = i[apart], j[apart], a[apart], b[apart]
        np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
        while (root[root] != root).any():
            root[:] = root[root]


def tiles(rows: DataFrame, keys: list[str], member: str, limit: int) -> DataFrame:
    """Deal rows that are to be compared within keys into tiles of at most about twice limit rows.

    A key with up to limit rows is one tile. A larger one is cut into blocks by the hash of member, and each
    pair of blocks is a tile of its own, so a hot key spreads over many tasks and no pair is lost. Adds
    blk_ (the row's block), lo_ and hi_ (the tile's blocks).
    """
    hot = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_")).where(F.col("n_") > limit)
    hot = hot.select(*keys, F.ceil(F.col("n_") / limit).cast("int").alias("blocks_"))
    dealt = rows.join(hot, keys, "left").withColumn("blocks_", F.coalesce("blocks_", F.lit(1)))
    dealt = dealt.withColumn("blk_", F.pmod(F.xxhash64(member), F.col("blocks_")).cast("int"))
    dealt = dealt.withColumn("with_", F.explode(F.sequence(F.lit(0), F.col("blocks_") - 1)))
    return dealt.withColumns({"lo_": F.least("blk_", "with_"), "hi_": F.greatest("blk_", "with_")}).drop("blocks_", "with_")


#: A key is hot if it holds over one in so many rows, so there are at most so many hot keys to broadcast.
HOT_SHARE = 1000


def meet(rows: DataFrame, side: DataFrame, keys: list[str], hot: Column) -> DataFrame:
    """rows joined with side, which has one row per key, so that no hot key's rows meet in one task.

    Rows of hot keys stay where they are and meet side by a broadcast, the others by a shuffle. hot is a condition on
    side's columns that holds for at most HOT_SHARE keys, such as a count above one in HOT_SHARE of all rows. Rows
    of other keys, and those with a null key, go.
    """
    few = F.broadcast(side.where(hot))
    rest = rows.join(few.select(*keys), keys, "left_anti").join(side.where(~hot), keys)
    return rows.join(few, keys).unionByName(rest)


def lowest_by(rows: DataFrame, key: str, value: Column, out: str, total: int) -> DataFrame:
    """rows (total of them at most) with the least value of their key in column out."""
    lowest = rows.groupBy(key).agg(F.min(value).alias(out), F.count(F.lit(1)).alias("n_"))
    return meet(rows, lowest, [key], F.col("n_") * HOT_SHARE > total).drop("n_")


def least_of(root: np.ndarray, nodes: np.ndarray) -> np.ndarray:
    """For each member the least node of its component, where root holds the first member of its component."""
    least = nodes.copy()
    np.minimum.at(least, root, nodes)
    return least[root]


def open_links(links: DataFrame) -> tuple[int, bool]:
    """How many links (u, v) there are, and whether they are more than stars: a node with two links or one onward."""
    ends = F.explode(F.array(F.struct(F.col("u").alias("node"), F.lit(1).alias("out"), F.lit(0).alias("in")), F.struct(F.col("v").alias("node"), F.lit(0).alias("out"), F.lit(1).alias("in"))))
    nodes = links.select(ends.alias("e")).groupBy("e.node").agg(F.sum("e.out").alias("out"), F.max("e.in").alias("in"))
    return tuple(nodes.agg(F.coalesce(F.sum("out"), F.lit(0)), F.coalesce(F.max(F.col("out") + F.col("in") * F.least("out", F.lit(1)) > 1), F.lit(False))).first())


def star_step(edges: DataFrame, total: int, small: bool) -> DataFrame:
    """One step towards stars around least nodes: links (u, v) from edges (u, v), of which there are total at most.

    Each node u takes a least node: the least that its task can reach from it, at least the least of its neighbours.
    The large step has edges in both directions and hands u's least to its greater neighbours, the small one has u > v
    and hands it to the others. All of a node's edges meet in one task, but for hot nodes, over one edge in HOT_SHARE
    of all: their least neighbours are found by an aggregate and told to all tasks, at most HOT_SHARE of them.
    """
    hot = {r.u: r.m for r in edges.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n")).where(F.col("n") * HOT_SHARE > total).collect()}
    key = F.when(F.col("u").isin(list(hot)), F.xxhash64("u", "v")).otherwise(F.xxhash64("u")) if hot else F.xxhash64("u")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [(column(b, "u"), column(b, "v")) for b in batches if b.num_rows]
        if not held:
            return
        u, v = (np.concatenate(x) for x in zip(*held))
        far, near = np.fromiter(hot.keys(), np.int64, len(hot)), np.fromiter(hot.values(), np.int64, len(hot))
        nodes = np.unique(np.concatenate([u, v, far, near]))
        at = lambda x: np.searchsorted(nodes, x)
        root = np.arange(len(nodes))
        unite(root, at(np.append(u, far)), at(np.append(v, near)))
        own = np.arange(len(nodes)) if not small else np.full(len(nodes), len(nodes))
        np.minimum.at(own, at(np.append(u, far)), at(np.append(v, near)))
        i, j = at(u), at(v)
        # What u's least node is handed to: v, and u itself where the least is no neighbour of it.
        up = np.concatenate([i[root[i] < own[i]], j[j > i]]) if not small else np.concatenate([i, j])
        down = np.concatenate([root[i[root[i] < own[i]]], root[i[j > i]]]) if not small else np.concatenate([root[i], root[i]])
        pair = np.unique((up * len(nodes) + down)[up != down])
        for k in range(0, len(pair), 100_000):
            some = pair[k : k + 100_000]
            yield pa.RecordBatch.from_arrays([pa.array(nodes[some // len(nodes)]), pa.array(nodes[some % len(nodes)])], ["u", "v"])

    return edges.select("u", "v").repartition(key).mapInArrow(run, "u long, v long")


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Components of undirected links (a long, b long), without collecting links: rows (node, component).

    component is the smallest node that links reach. Large-star and small-star steps alternate until only stars are
    left, each around its least node; each step is written to the shared folder, which cuts lineage. Links that are
    such stars already take no step. Nodes without links do not appear.
    """
    links = edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    links = materialize(links, "links")
    for _ in range(max_rounds):
        total, more = open_links(links)
        if not more:
            break
        both = links.union(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = materialize(star_step(both, 2 * total, False), "links")
        links = materialize(star_step(large, 2 * total, True).distinct(), "links")
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    members = links.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return members.union(links.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
