"""SimHash near-duplicates by a segment-popcount embedding.

A document's fingerprint has a bit for each bit position that is set in over half of its shingles' hashes. The
fingerprint is embedded as the vector of bit counts of its 32 two-bit segments. The Manhattan distance of two
vectors never exceeds the Hamming distance of the fingerprints, so fingerprints within 4 bits have vectors within
4. The segments form 6 groups; 4 steps touch 4 of them at most, so such vectors agree in two groups at least. Each
fingerprint therefore goes to 15 grid cells (pair of groups, counts within them), and only fingerprints that share
a cell are compared: first by the Manhattan distance of their vectors, in order of the whole count, which bounds that
in turn, and where it is within 4, exactly. Of random fingerprints one pair in 2,000 meets in a cell. Crowded cells are cut into tiles of pairs of blocks. A tile hands
on a star of links for each component it sees, around its least fingerprint, not pairs, so that tiles that see the same
component name the same star; components over all tiles come from repeated joins.

Defined results: a null or empty text has fingerprint zero and links like any other; fewer words than a shingle
are one shingle; repeated rows share a fingerprint; a row with a null id gets the component of its fingerprint,
which is null if no row there has an id; an empty table gives no rows. Only the named columns are read.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, MapType, StructType, VariantType

from .common import HOT_SHARE, connected_components, least_of, lowest_by, materialize, meet, star_edges, table, tiles, unite, whole_groups

WORDS = 4
DISTANCE = 4
SEED = 42
TILE = 32768
#: Cells of up to so many fingerprints are compared side by side.
SMALL = 32
#: Of DISTANCE + AGREEING groups so many are untouched by DISTANCE steps.
AGREEING = 2
#: A mask of each group's segments: 32 segments of 2 bits in DISTANCE + AGREEING groups.
_SIZES = (6, 6, 5, 5, 5, 5)
GROUPS = tuple(((1 << 2 * n) - 1) << 2 * sum(_SIZES[:k]) for k, n in enumerate(_SIZES))
#: The masks of the cells: all choices of AGREEING groups.
CELLS = tuple(sum(chosen) for chosen in combinations(GROUPS, AGREEING))
_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def fingerprint(text: str | None, words: int = WORDS) -> int:
    """The unsigned 64-bit fingerprint of a whole text."""
    import xxhash

    tokens = (text or "").encode("utf-8", "replace").translate(_LOWER).split()
    if not tokens:
        return 0
    joined, digest = b" ".join(tokens), xxhash.xxh64_digest
    ends = np.cumsum(np.fromiter(map(len, tokens), np.int64, len(tokens)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    last = ends[words - 1 :] if len(tokens) >= words else ends[-1:]
    made = b"".join([digest(joined[a:b], SEED) for a, b in zip(starts.tolist(), last.tolist())])
    n = len(last)
    bits = np.unpackbits(np.frombuffer(made, np.uint8)).reshape(n, 64)
    even = n - n % 255
    counts = bits[:even].reshape(-1, 255, 64).sum(1, dtype=np.uint8).sum(0, dtype=np.int64) + bits[even:].sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(counts * 2 > n).tobytes(), "big")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, carried: dict[str, str] | None = None) -> DataFrame:
    """(doc_id, fp) of every row, and the carried columns (name: type); fp is the fingerprint as a signed long."""
    carried = carried or {}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = np.array([fingerprint(t.as_py(), words) for t in batch.column(1)], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(made), *batch.columns[2:]], ["doc_id", "fp", *carried])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), *carried)
    return rows.mapInArrow(run, ", ".join(["doc_id long", "fp long", *map(" ".join, carried.items())]))


def signed(mask: int) -> int:
    return mask - (1 << 64) if mask >= 1 << 63 else mask


def segment_counts(fp: Column) -> Column:
    """The embedding: the bit counts of the 2-bit segments, each in its segment's place."""
    odd = F.lit(0x5555555555555555)
    low, high = fp.bitwiseAND(odd), F.shiftrightunsigned(fp, 1).bitwiseAND(odd)
    return low.bitwiseXOR(high).bitwiseOR(F.shiftleft(low.bitwiseAND(high), 1))


def unary_counts(fp: np.ndarray) -> np.ndarray:
    """The embedding with each count in unary (0, 1, 3), so that the bits in which two differ are their Manhattan distance."""
    odd = np.uint64(0x5555555555555555)
    low, high = fp & odd, (fp >> np.uint64(1)) & odd
    return (low | high) | ((low & high) << np.uint64(1))


def compare(mine: np.ndarray, other: np.ndarray | None, distance: int, step: int = 128) -> Iterator[tuple[int, np.ndarray]]:
    """(index, indexes) of fingerprints within distance, where each side is in order of its whole bit count.

    Without other: links inside mine. With other: links from mine to other, whose indexes follow mine's.
    """
    base, b = (0, mine) if other is None else (len(mine), other)
    ones_a, ones_b = np.bitwise_count(mine), np.bitwise_count(b)
    vectors_a, vectors_b = unary_counts(mine), unary_counts(b)
    for start in range(0, len(mine), step):
        stop = min(len(mine), start + step)
        low = np.searchsorted(ones_b, max(0, int(ones_a[start]) - distance), "left")
        high = np.searchsorted(ones_b, int(ones_a[stop - 1]) + distance, "right")
        bounded = np.bitwise_count(vectors_a[start:stop, None] ^ vectors_b[None, low:high]) <= distance
        for r in np.flatnonzero(bounded.sum(1) > (other is None)).tolist():
            found = low + np.flatnonzero(bounded[r])
            found = found[np.bitwise_count(mine[start + r] ^ b[found]) <= distance]
            if len(found) > (other is None):
                yield start + r, base + found


def small_cells(cell: np.ndarray, fp: np.ndarray, distance: int) -> np.ndarray:
    """For each row the first of its component, where rows of a cell (which follow each other) link within distance."""
    root, step = np.arange(len(fp)), 1
    at, vectors = np.arange(len(fp)), unary_counts(fp)
    while len(at):
        at = at[at + step < len(fp)]
        at = at[cell[at] == cell[at + step]]
        near = at[np.bitwise_count(vectors[at] ^ vectors[at + step]) <= distance]
        near = near[np.bitwise_count(fp[near] ^ fp[near + step]) <= distance]
        unite(root, near, near + step)
        step += 1
    return root


def tile_links(fp: np.ndarray, block: np.ndarray, lo: int, hi: int, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """(fingerprints, for each the first of its component) of one tile."""
    order = np.argsort(np.bitwise_count(fp), kind="stable")
    fp, block = fp[order], block[order]
    if lo == hi:
        return fp, star_edges(compare(fp, None, distance), len(fp))
    mine, other = fp[block == lo], fp[block == hi]
    return np.concatenate([mine, other]), star_edges(compare(mine, other, distance), len(fp))


def links(points: DataFrame, distance: int = DISTANCE, tile: int = TILE) -> DataFrame:
    """Stars (a, b) that connect all fingerprints (a distinct column fp) within distance."""
    if distance != len(GROUPS) - AGREEING:
        raise ValueError("the grid's groups hold for one distance")
    counts = points.withColumn("counts_", segment_counts(F.col("fp")))
    # A cell is known by a hash; cells that share one are compared together, which the exact test makes harmless.
    found = F.array(*[F.xxhash64(F.lit(k), F.col("counts_").bitwiseAND(F.lit(signed(m)))) for k, m in enumerate(CELLS)])
    dealt = tiles(counts.select("fp", F.explode(found).alias("cell_")), ["cell_"], "fp", tile)
    keys = ["cell_", "lo_", "hi_"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def stars(nodes: np.ndarray, root: np.ndarray) -> Iterator[pa.RecordBatch]:
            nodes = nodes.view(np.int64)
            centre = least_of(root, nodes)
            far = np.flatnonzero(nodes != centre)
            if len(far):
                yield pa.RecordBatch.from_arrays([pa.array(nodes[far]), pa.array(centre[far])], ["a", "b"])

        for rows, starts in whole_groups(batches, keys, 1 << 18):
            fp, block, lo, hi = (rows.column(c).to_numpy() for c in ("fp", "blk_", "lo_", "hi_"))
            fp, sizes = fp.view(np.uint64), np.diff(np.append(starts, len(fp)))
            small = (sizes > 1) & (sizes <= SMALL) & (lo[starts] == hi[starts])
            chosen = np.repeat(small, sizes)
            yield from stars(fp[chosen], small_cells(np.repeat(np.arange(len(sizes)), sizes)[chosen], fp[chosen], distance))
            for k in np.flatnonzero((sizes > 1) & ~small).tolist():
                s = slice(starts[k], starts[k] + sizes[k])
                yield from stars(*tile_links(fp[s], block[s], lo[starts[k]], hi[starts[k]], distance))

    dealt = dealt.select(*keys, "blk_", "fp").repartition(*keys).sortWithinPartitions(*keys)
    return dealt.mapInArrow(run, "a long, b long")


def rooted(prints: DataFrame, first: Column, distance: int = DISTANCE) -> DataFrame:
    """prints with component_: the least value of first in the component of their fingerprint fp."""
    points = materialize(prints.groupBy("fp").agg(F.min(first).alias("first_"), F.count(F.lit(1)).alias("copies_")), "points")
    rows, texts = points.agg(F.coalesce(F.sum("copies_"), F.lit(0)), F.count(F.lit(1))).first()
    found = connected_components(links(points.select("fp"), distance)).withColumnsRenamed({"node": "fp", "component": "root_"})
    roots = materialize(points.join(found, "fp", "left").withColumn("root_", F.coalesce("root_", "fp")), "roots")
    whole = lowest_by(roots, "root_", F.col("first_"), "component_", texts)
    return meet(prints, whole.select("fp", "component_", "copies_"), ["fp"], F.col("copies_") * HOT_SHARE > rows).drop("copies_")


def components(prints: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """(doc_id, fp, component_id) of every row of fingerprints()."""
    return rooted(prints, F.col("doc_id"), distance).select("doc_id", "fp", F.col("component_").alias("component_id"))


def keep_first(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each group of near-duplicates, with all its columns: that with the smallest id.

    A group without ids keeps one of its rows too. Of rows that repeat id and text, which are one group, one stays,
    the same in every run where their other columns of plain types tell them apart. Rows that repeat an id with
    texts that are not near stay each.
    """
    # Rows of one id and text are told from others by 128 bits of hash, so that the text itself need not travel for it.
    text = F.col(text_col).cast("string")
    keys = {"id_": F.coalesce(F.col(id_col).cast("long"), F.lit(-1)), "hash_": F.xxhash64(text), "more_": F.xxhash64(F.lit(1), text)}
    prints = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), *[c.alias(n) for n, c in keys.items()])
    prints = materialize(fingerprints(prints, carried=dict.fromkeys(keys, "long")), "prints")
    head = F.struct(F.col("doc_id").isNull(), *keys)
    heads = rooted(prints, head).select(*[F.col(f"component_.{k}") for k in keys]).distinct()
    plain = [F.col(f"row_.`{f.name}`") for f in docs.schema if not isinstance(f.dataType, (ArrayType, MapType, StructType, VariantType))]
    by = Window.partitionBy(*keys).orderBy(F.col(f"row_.`{id_col}`").isNull(), F.xxhash64(*plain))
    rows = docs.select(F.struct("*").alias("row_"), *[c.alias(n) for n, c in keys.items()])
    first = rows.withColumn("at_", F.row_number().over(by)).where("at_ = 1")
    return first.join(heads, list(keys), "left_semi").select("row_.*")


def op8_simhash_near_dedup(spark, sf_dir: str) -> DataFrame:
    prints = materialize(fingerprints(table(spark, sf_dir, "documents")), "prints")
    return components(prints).select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
