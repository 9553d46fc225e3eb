"""Embedding near-duplicates by int8 tile products with rigorous error bounds.

Rows are compared within a label by cosine in double precision. Equal vectors of a label (by a 128-bit hash) are one
member with a multiplicity. Each member's unit vector is quantised once to 8 bits with its own step; the products of
two tiles of codes are exact integers (they stay below 2**24, so a single-precision matrix product gives them
exactly). With x = s*q + e and y = t*r + f the true cosine is within |e|*|y'| + |f|*|x'| + |e||f| of s*t*(q.r), where
the error norms are measured per vector. Pairs that lie above the threshold with the whole interval are linked, those
below it are not, and only the others are computed again in double precision from the original components.

Members of a label are dealt into blocks, and pairs of blocks into tiles, so that a hot label spreads over many
tasks. What travels to tiles is codes, steps and error norms; the double vectors are fetched only for members of a
tile that have an unsure pair there. A tile hands on link counts per member and a star of links per component, never
pairs. Work within a label grows with the square of its distinct vectors; that is the cost of exact comparison at any
angle.

Defined results: a null label, or a vector that is null, empty, zero or holds null or non-finite components links
with nothing and is its own component; vectors of different lengths do not link; rows that repeat an id are
members of their own, and links between rows of one id count; a row with a null id links and counts for others,
and its component is the smallest id reached, null if there is none; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import HOT_SHARE, connected_components, least_of, lowest_by, materialize, meet, sorted_groups, table, tiles, unite

THRESHOLD = 0.98
TILE = 4096
#: The interval's ends are trusted beyond so much only, for the rounding of the bound itself.
MARGIN = 1e-9


def usable(vector: Column) -> Column:
    """Whether a vector can link: not null or zero, all components finite."""
    bad = F.exists(vector, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    return F.coalesce(~bad & F.exists(vector, lambda v: v != 0), F.lit(False))


def quantise(unit: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(codes as float32, step, error norm) of unit vectors; the norms are rounded up."""
    step = np.maximum(np.abs(unit).max(1), 1e-300) / 127
    codes = np.rint(unit / step[:, None])
    error = np.linalg.norm(unit - codes * step[:, None], axis=1)
    return codes.astype(np.float32), step, error * (1 + 1e-9) + 1e-12


def scaled(x: np.ndarray) -> np.ndarray:
    """Rows times the power of two that brings their largest component to one half or more, so that no square overflows or vanishes."""
    return np.ldexp(x, -np.frexp(np.abs(x).max(1, keepdims=True))[1])


def matrix(vectors: pa.ListArray, width: int) -> np.ndarray:
    return vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, width)


def with_codes(members: DataFrame) -> DataFrame:
    """Add width, codes (a byte per component), step and error of the column vector, which comes first."""
    names = ["width", "codes", "step", "error"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vectors = batch.column(0)
            widths = vectors.value_lengths().to_numpy(zero_copy_only=False).astype(np.int32)
            codes, step, error = np.empty(len(widths), object), np.empty(len(widths)), np.empty(len(widths))
            for width in np.unique(widths).tolist():
                mine = np.flatnonzero(widths == width)
                x = scaled(matrix(vectors.take(pa.array(mine)), width))
                q, step[mine], error[mine] = quantise(x / np.linalg.norm(x, axis=1)[:, None])
                codes[mine] = [row.tobytes() for row in q.astype(np.int8)]
            made = [pa.array(widths), pa.array(codes.tolist(), pa.binary()), pa.array(step), pa.array(error)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *made], [*batch.schema.names, *names])

    kept = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in members.schema)
    return members.mapInArrow(run, f"{kept}, width int, codes binary, step double, error double")


def near_pairs(rows: pa.Table, block: np.ndarray, lo: int, hi: int, threshold: float, size: int = 512) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(i, j, sure) in blocks: pairs of a tile's rows that the codes' bounds do not rule out, and which they prove."""
    first = np.flatnonzero(block == lo)
    second = first if lo == hi else np.flatnonzero(block == hi)
    joined = b"".join(rows.column("codes").to_pylist())
    codes = np.frombuffer(joined, np.int8).reshape(len(block), -1)
    codes = codes.astype(np.float32 if codes.shape[1] * 127 * 127 < 1 << 24 else np.float64)
    step, error = (rows.column(c).to_numpy() for c in ("step", "error"))
    for a in range(0, len(first), size):
        for b in range(a if lo == hi else 0, len(second), size):
            i, j = first[a : a + size], second[b : b + size]
            value = (codes[i] @ codes[j].T) * (step[i, None] * step[None, j])
            slack = error[i, None] * (1 + error[None, j]) + error[None, j] * (1 + error[i, None])
            near = value + slack >= threshold - MARGIN
            if lo == hi and a == b:
                near = np.triu(near, 1)
            r, c = np.nonzero(near)
            if len(r):
                yield i[r], j[c], value[r, c] - slack[r, c] >= threshold + MARGIN


class Found:
    """Links of one tile's rows: their counts, and the first row of each row's component."""

    def __init__(self, rows: pa.Table):
        self.nodes, self.copies = rows.column("node").to_numpy(), rows.column("copies").to_numpy()
        self.counts, self.root = np.zeros(len(rows), np.int64), np.arange(len(rows))

    def add(self, i: np.ndarray, j: np.ndarray) -> None:
        np.add.at(self.counts, i, self.copies[j])
        np.add.at(self.counts, j, self.copies[i])
        unite(self.root, i, j)

    def rows(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(node, links, its component's least node) of the rows that have links."""
        linked = self.counts > 0
        return self.nodes[linked], self.counts[linked], least_of(self.root, self.nodes)[linked]


KEYS = ["group_", "lo_", "hi_"]
LINKS = "node long, n long, other long"


def tile_links(members: DataFrame, threshold: float, tile: int) -> DataFrame:
    """Rows (node, n, other): n counts links found for node in a tile; other is its star's centre."""
    dealt = tiles(members.select(F.xxhash64("label", "width").alias("group_"), "node", "copies", "label", "width", "codes", "step", "error"), ["group_"], "node", tile)
    dealt = dealt.select(*KEYS, "blk_", "node", "copies", "label", "width", "codes", "step", "error")
    unsure_names = [*KEYS, "blk_"]

    def parts(rows: pa.Table) -> Iterator[pa.Table]:
        """A tile's rows of one label and width; there are several only where hashes of groups are the same."""
        labels, widths = rows.column("label").to_numpy(), rows.column("width").to_numpy()
        for label, width in sorted(set(zip(labels.tolist(), widths.tolist()))):
            yield rows.filter(pa.array((labels == label) & (widths == width)))

    def coarse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (_, lo, hi), whole in sorted_groups(batches, KEYS):
            for rows in parts(whole):
                found, open_ = Found(rows), np.zeros(len(rows), bool)
                for i, j, sure in near_pairs(rows, rows.column("blk_").to_numpy(), lo, hi, threshold):
                    found.add(i[sure], j[sure])
                    open_[i[~sure]] = open_[j[~sure]] = True
                nodes, n, other = found.rows()
                again = rows.filter(pa.array(open_)).combine_chunks()
                total = len(nodes) + len(again)
                if total:
                    links = [pa.array(np.concatenate([nodes, again.column("node").to_numpy()])), pa.array(np.append(n, np.zeros(len(again), np.int64))), pa.array(np.concatenate([other, again.column("node").to_numpy()]))]
                    places = [pa.concat_arrays([pa.nulls(len(nodes), again.schema.field(c).type), *again.column(c).chunks]) for c in unsure_names]
                    yield pa.RecordBatch.from_arrays([*links, *places], ["node", "n", "other", *unsure_names])

    dealt = dealt.repartition(*KEYS).sortWithinPartitions(*KEYS)
    first = materialize(dealt.mapInArrow(coarse, f"{LINKS}, group_ long, lo_ int, hi_ int, blk_ int"), "tiles")

    def exact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (_, lo, hi), whole in sorted_groups(batches, KEYS):
            for rows in parts(whole):
                x = scaled(matrix(rows.column("vector").combine_chunks(), rows.column("width")[0].as_py()))
                norm, found = np.linalg.norm(x, axis=1), Found(rows)
                for i, j, sure in near_pairs(rows, rows.column("blk_").to_numpy(), lo, hi, threshold):
                    i, j = i[~sure], j[~sure]
                    for k in range(0, len(i), 65536):
                        u, v = i[k : k + 65536], j[k : k + 65536]
                        ok = np.einsum("ij,ij->i", x[u], x[v]) / (norm[u] * norm[v]) >= threshold
                        found.add(u[ok], v[ok])
                nodes, n, other = found.rows()
                if len(nodes):
                    yield pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(n), pa.array(other)], ["node", "n", "other"])

    unsure = first.where("group_ is not null").select(*KEYS, "blk_", "node").join(members, "node")
    unsure = unsure.select(*KEYS, "blk_", "node", "copies", "label", "width", "codes", "step", "error", "vector")
    second = unsure.repartition(*KEYS).sortWithinPartitions(*KEYS).mapInArrow(exact, LINKS)
    return first.where("group_ is null").select("node", "n", "other").unionByName(second)


def near_duplicates(rows: DataFrame, threshold: float = THRESHOLD, tile: int = TILE) -> DataFrame:
    """vec_id, n_links, component_id and kept of every row of (vec_id, embedding, label)."""
    rows = rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("vector"), F.col("label").cast("long").alias("label"))
    rows = rows.withColumn("links_", usable(F.col("vector")) & F.col("label").isNotNull())
    rows = rows.withColumn("vector", F.transform("vector", lambda v: v + F.lit(0.0)))
    keys = {"low_": F.xxhash64("label", "vector"), "high_": F.xxhash64(F.lit("high"), "label", "vector")}
    keyed = materialize(rows.select("vec_id", "links_", *[c.alias(n) for n, c in keys.items()]), "keys")
    alone = keyed.where("not links_").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    able = keyed.where("links_").drop("links_")
    members = rows.where("links_").withColumns(keys).groupBy("low_", "high_").agg(F.first("vector").alias("vector"), F.first("label").alias("label"), F.min("vec_id").alias("first_"), F.count(F.lit(1)).alias("copies"))
    members = members.select("vector", "label", "low_", "high_", "first_", "copies", F.monotonically_increasing_id().alias("node"))
    members = materialize(with_codes(members), "members")
    found = materialize(tile_links(members, threshold, tile), "links")
    counts = found.groupBy("node").agg(F.sum("n").alias("others_"))
    comps = connected_components(found.select(F.col("node").alias("a"), F.col("other").alias("b"))).withColumnsRenamed({"component": "root_"})
    whole = members.select("node", "low_", "high_", "first_", "copies").join(counts, "node", "left").join(comps, "node", "left")
    whole = materialize(whole.select("low_", "high_", "first_", "copies", (F.coalesce("others_", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("root_", "node").alias("root_")), "roots")
    total, vectors = able.count(), whole.count()
    whole = lowest_by(whole, "root_", F.col("first_"), "component_id", vectors).select("low_", "high_", "copies", "n_links", "component_id")
    linked = meet(able, whole, ["low_", "high_"], F.col("copies") * HOT_SHARE > total).select("vec_id", "n_links", "component_id")
    return linked.unionByName(alone).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))


def op6_embedding_near_dedup(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "embeddings"))


ORACLE_SQL = f"""
WITH RECURSIVE r AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e, row_number() OVER () AS k FROM embeddings),
v AS (SELECT *, sqrt(list_dot_product(e, e)) AS norm FROM r WHERE label IS NOT NULL AND len(e) > 0 AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0),
l AS (SELECT a.k AS a, b.k AS b FROM v a JOIN v b ON a.label = b.label AND a.k <> b.k AND len(a.e) = len(b.e) WHERE list_dot_product(a.e, b.e) / (a.norm * b.norm) >= {THRESHOLD}),
reach(k, id) AS (SELECT k, vec_id FROM r UNION SELECT l.b, reach.id FROM reach JOIN l ON l.a = reach.k),
c AS (SELECT k, min(id) AS component_id FROM reach GROUP BY 1), n AS (SELECT a AS k, count(*) AS n_links FROM l GROUP BY 1)
SELECT vec_id, coalesce(n_links, 0) AS n_links, component_id, coalesce(vec_id = component_id, false) AS kept FROM r JOIN c USING (k) LEFT JOIN n USING (k)
"""
