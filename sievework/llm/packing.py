"""Best-fit packing of tokenised documents into sequences, certified by dual-feasible-function bounds.

Documents are tokenised once and cut only where they exceed the capacity; the remainder becomes the first
piece, so all later pieces are full and need no packing. The other pieces are dealt by hash into partitions of
PIECES_PER_PARTITION pieces, or of more where there would be very many partitions. Each partition is packed by
best-fit decreasing and compared with a lower bound from dual feasible functions. A partition that meets its bound
is certified; it keeps its bins but those that are loose (a quarter free). Partitions with a gap release the pieces of
all bins that have room left. What is released is dealt
anew, so partitions exchange documents, and packed again. A round that does not lower the count of bins is discarded,
and the next one's partitions are four times as large; the last is one that gains nothing in one partition, or in
partitions of LARGEST_PARTITION pieces. A round deals only what is open, so rounds shrink.

Defined results: a null text is an empty document, which is one end id; an empty table gives no rows; repeated
rows are packed each on its own; a null id is kept; only the named columns are read, so extra columns and
clashing names do not matter; a very long text is cut into capacity-sized pieces.
"""

from __future__ import annotations

import itertools
import json
import logging
import zlib
from array import array
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, table

CAPACITY = 2048
END_ID = 0
PIECES_PER_PARTITION = 16384
#: Beyond so many partitions, partitions grow instead, up to LARGEST_PARTITION pieces.
USUAL_PARTITIONS = 4096
LARGEST_PARTITION = 1 << 18
#: Certified partitions keep bins with less than one in so many parts of their room free.
LOOSE = 4
_log = logging.getLogger(__name__)


def rank_encoder(tokenizer_path: str) -> Callable[[str], list[int]] | None:
    """The same merges run by a rank-based encoder, many times as fast; None where the file does not allow it.

    It does where the model is byte-level BPE with the usual pre-tokeniser, has no normaliser, and numbers its
    merges in their order, so that a token's id is its rank.
    """
    import public_tokenizers
    import tiktoken

    with open(tokenizer_path, encoding="utf-8") as file:
        spec = json.load(file)
    model, pre = spec["model"], spec.get("pre_tokenizer") or {}
    if model.get("type", "BPE") != "BPE" or spec.get("normalizer") or pre.get("type") != "ByteLevel" or pre.get("add_prefix_space"):
        return None
    joined = ["".join(m if isinstance(m, list) else m.split(" ")) for m in model["merges"]]
    order = [model["vocab"][t] for t in joined]
    if any(a >= b for a, b in zip(order, order[1:])):
        return None
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in printable]
    byte = {chr(b): b for b in printable} | {chr(256 + k): b for k, b in enumerate(hidden)}
    special = {t["content"] for t in spec.get("added_tokens", [])}
    ranks = {bytes(byte[c] for c in t): i for t, i in model["vocab"].items() if t not in special}
    return tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary


class WordEncoder:
    """Byte-level BPE ids of whole texts as little-endian 32-bit bytes, with a cache by word.

    The pre-tokeniser never joins characters across a single space or newline between two other characters, so
    texts whose white space is only such are encoded word by word from the cache. All other texts go to the
    tokenizer whole. Both ways give the same ids.
    """

    def __init__(self, tokenizer_path: str, cache_words: int = 400_000):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(tokenizer_path)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        fast = rank_encoder(tokenizer_path)
        ids = (lambda text: array("I", fast(text)).tobytes()) if fast else self.ids

        class Inner(dict):
            def __init__(self, lead: str):
                self.lead = lead

            def __missing__(self, word: str) -> bytes:
                if len(self) >= cache_words:
                    self.clear()
                value = self[word] = ids(self.lead + word)
                return value

        self.inner, self.first, self.plain = Inner(" "), Inner(""), ids
        self.newline = ids("\n")

    def ids(self, text: str) -> bytes:
        return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def __call__(self, text: str) -> bytes:
        if not text:
            return b""
        if any(s in text for s in self.special):
            return self.ids(text)
        out: list[bytes] = []
        for k, line in enumerate(text.split("\n")):
            words = line.split(" ")
            if words != line.split():
                return self.plain(text)
            if k:
                out.append(self.newline)
            out.append(self.first[words[0]])
            out.extend(map(self.inner.__getitem__, words[1:]))
        return b"".join(out)


PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def cut(ids: bytes, capacity: int = CAPACITY) -> list[tuple[int, int, int, int]]:
    """(piece, start, length, crc) of a document's ids; the first piece takes the remainder."""
    n = len(ids) // 4
    head = n % capacity or min(n, capacity)
    bounds = [0, *range(head, n + 1, capacity)]
    return [(k, a, b - a, zlib.crc32(memoryview(ids)[4 * a : 4 * b])) for k, (a, b) in enumerate(zip(bounds, bounds[1:]))]


def pieces_of(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY) -> DataFrame:
    """Pieces of all documents, before they are placed."""
    end = array("I", [END_ID]).tobytes()

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = WordEncoder(tokenizer_path)
        for batch in batches:
            rows = [(i, *p) for i, t in zip(batch.column(0).to_pylist(), batch.column(1)) for p in cut(encoder(t.as_py() or "") + end, capacity)]
            cols = list(zip(*rows)) if rows else [()] * 5
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(encode, PIECES)


def lower_bound(counts: np.ndarray) -> int:
    """Bins that items with counts[length] need at least: the best of the dual feasible functions u_k.

    u_k maps lengths above C-k to a whole bin, those from k to C-k to their share, smaller ones to nothing. As k
    falls, more small items count but fewer large ones are rounded up; the maximum over all k holds as a bound.
    """
    capacity = len(counts) - 1
    sizes = np.arange(capacity + 1)
    n_from = np.append(np.cumsum(counts[::-1])[::-1], 0)
    mass_from = np.append(np.cumsum((counts * sizes)[::-1])[::-1], 0)
    k = np.arange(0, capacity // 2 + 1)
    whole = n_from[capacity - k + 1]
    part = mass_from[k] - mass_from[capacity - k + 1]
    return int(np.max(whole + -(-part // capacity))) if counts.sum() else 0


def best_fit(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Best-fit for lengths in falling order: (bin, offset) of each and the room left in each bin."""
    bins, offsets = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    room: list[int] = []
    by_room: list[list[int]] = [[] for _ in range(capacity + 1)]
    mask = 0
    for i, size in enumerate(lengths.tolist()):
        fits = mask >> size
        if fits:
            r = size + (fits & -fits).bit_length() - 1
            b = by_room[r].pop()
            if not by_room[r]:
                mask &= ~(1 << r)
        else:
            r, b = capacity, len(room)
            room.append(capacity)
        bins[i], offsets[i] = b, capacity - r
        left = r - size
        room[b] = left
        if left:
            by_room[left].append(b)
            mask |= 1 << left
    return bins, offsets, np.array(room, np.int64)


PLACED = "doc_id long, piece int, start long, length long, ids_crc32 long, bin_ long, offset long, open_ boolean, bins_ long, bound_ long"


def pack_round(items: DataFrame, number: int, capacity: int) -> DataFrame:
    """One round of best-fit decreasing on hash-dealt partitions; open_ marks pieces that may be exchanged."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        held = [b for b in batches if b.num_rows]
        if not held:
            return
        data = pa.Table.from_batches(held).sort_by([("length", "descending"), ("doc_id", "ascending"), ("piece", "ascending"), ("ids_crc32", "ascending")])
        lengths = data.column("length").to_numpy()
        bins, offsets, room = best_fit(lengths, capacity)
        bound = lower_bound(np.bincount(lengths, minlength=capacity + 1))
        # A certified partition needs its bins, but what is loose in it may fill what is loose in others.
        opened = (room >= (1 if len(room) > bound else max(1, capacity // LOOSE)))[bins]
        part = TaskContext.get().partitionId()
        first = np.zeros(len(bins), np.int64)
        first[0] = len(room)
        low = np.zeros(len(bins), np.int64)
        low[0] = bound
        for name, values in (("bin_", ((number + 1) << 52) + (part << 32) + bins), ("offset", offsets), ("open_", opened), ("bins_", first), ("bound_", low)):
            data = data.append_column(name, pa.array(values))
        yield from data.to_batches(max_chunksize=50_000)

    return items.mapInArrow(pack, PLACED)


def partitions_for(n: int, per_partition: int) -> int:
    """How many partitions n pieces are dealt into; a shuffle into very many small ones would cost more than packing."""
    return max(1, min(-(-n // per_partition), USUAL_PARTITIONS), -(-n // max(per_partition, LARGEST_PARTITION)))


def deal(items: DataFrame, n: int, number: int, per_partition: int) -> DataFrame:
    """Deal pieces by hash, and by their place in the table too, so that rows that repeat id and text part ways."""
    dealt = items.withColumn("at_", F.monotonically_increasing_id())
    dealt = dealt.repartition(partitions_for(n, per_partition), F.xxhash64("doc_id", "piece", "ids_crc32", "at_", F.lit(number)))
    return dealt.drop("at_")


def pack(pieces: DataFrame, capacity: int = CAPACITY, per_partition: int = PIECES_PER_PARTITION, rounds: int | None = None) -> DataFrame:
    """Place pieces (of pieces_of) in sequences of at most capacity ids; adds sequence_id and offset.

    Rounds go on until more of them or larger partitions gain nothing, or for so many rounds. Each logs its bins, their lower bound and how many
    partitions are certified.
    """
    full = pieces.where(F.col("length") == capacity)
    done = [full.withColumns({"sequence_id": -1 - F.monotonically_increasing_id(), "offset": F.lit(0).cast("long")})]
    final = lambda df: df.select(*pieces.columns, F.col("bin_").alias("sequence_id"), "offset")
    items = pieces.where(F.col("length") < capacity)
    n = items.count()
    placed, spent = None, None
    for number in itertools.count() if rounds is None else range(rounds):
        if not n:
            break
        now = materialize(pack_round(deal(items, n, number, per_partition), number, capacity), "placed")
        certified = F.count_if((F.col("bins_") > 0) & (F.col("bins_") <= F.col("bound_")))
        found = now.agg(F.sum("bins_").alias("bins"), F.sum(F.col("open_").cast("long")).alias("open"), F.sum("bound_").alias("bound"), F.count_if(F.col("bins_") > 0).alias("parts"), certified.alias("certified")).first()
        _log.info("round %d: %d bins, at least %d, %d of %d partitions certified", number, found.bins, found.bound, found.certified, found.parts)
        if placed is not None and found.bins >= spent:
            if found.parts <= 1 or per_partition >= LARGEST_PARTITION:
                break
            per_partition *= 4  # the same pieces once more, more of them side by side
            continue
        if placed is not None:
            done.append(final(placed.where("not open_")))
        placed, n = now, found.open
        items = placed.where("open_").select(*pieces.columns)
        spent = placed.where("open_").agg(F.count_distinct("bin_")).first()[0]
    if placed is not None:
        done.append(final(placed))
    out = done[0]
    for df in done[1:]:
        out = out.unionByName(df)
    return out


def certificate(placed: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """One row: sequences of packed pieces, the whole table's lower bound, and the gap between them.

    The bound needs the number of pieces of each length only, of which there are capacity at most.
    """
    counts = np.zeros(capacity + 1, np.int64)
    for r in placed.groupBy("length").count().collect():
        counts[r.length] = r["count"]
    bound = lower_bound(counts)
    return placed.agg(F.count_distinct("sequence_id").alias("sequences")).select("sequences", F.lit(bound).cast("long").alias("bound"), (F.col("sequences") - bound).alias("gap"))


def pack_documents(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, per_partition: int = PIECES_PER_PARTITION) -> DataFrame:
    """Tokenise and pack: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    return pack(materialize(pieces_of(docs, tokenizer_path, id_col, text_col, capacity), "pieces"), capacity, per_partition)


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op10_best_fit_packing(spark, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"), default_tokenizer())
