"""Alignment of two tokenizers: which tokens of one overlap which of the other, and how often documents agree on a pair.

1. A task encodes its documents by both tokenizers, a block of documents at a time. In a block, cumulative sums of
   token lengths are token ends; the ends that both share (intersect1d) cut it into groups, and a document's end is
   always such a cut. searchsorted labels tokens with their groups and finds, for each token of A, the tokens of B
   that its bytes meet; repeat expands these into links.
2. Documents of about CHUNK_LINKS links make a chunk, whose distinct id pairs are numbered. A document keeps its
   distinct pairs as such numbers and how often it has each; a chunk keeps in how many of its documents a pair is.
3. Pairs are summed over chunks in two stages, salted and then whole, as frequent pairs are in every chunk. The
   highest count of each id of A comes from the sums.
4. A chunk's pairs take their sums by a join and go back to the chunk, where documents add them up. A pair has one
   row per chunk in that join, so no pair holds a large share of its rows.

A document costs the shuffle its distinct pairs only, and a task holds one chunk: CHUNK_LINKS links, or one longer
document.

Defined results: a null or empty text has no tokens, nor has one that the tokens of a tokenizer do not spell (byte by
byte, a boundary mark counting as a space): counts are 0 and groups are ''; a null id is kept; repeated rows count
each; an empty table gives no rows; only the named columns are read.
"""

from __future__ import annotations

import hashlib
import json
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, table
from .packing import default_tokenizer, rank_encoder
from .pieces import BOUNDARY, default_model

CHUNK_LINKS = 1 << 21
#: Documents are aligned together up to so many bytes of text, or one that is longer.
BLOCK_BYTES = 1 << 20
CACHE_WORDS = 300_000
SALTS = 16


def byte_level_tokens(tokenizer_path: str) -> list[bytes]:
    """The bytes of each id of a byte-level tokenizer file; an id without an entry has none."""
    with open(tokenizer_path, encoding="utf-8") as file:
        spec = json.load(file)
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in printable]
    byte = {chr(b): b for b in printable} | {chr(256 + k): b for k, b in enumerate(hidden)}
    added = {t["content"]: t["content"].encode() for t in spec.get("added_tokens", [])}
    entries = {i: added[t] if t in added else bytes(byte[c] for c in t) for t, i in spec["model"]["vocab"].items()}
    return [entries.get(i, b"") for i in range(max(entries, default=-1) + 1)]


def piece_tokens(model) -> list[bytes]:
    """The bytes of each piece of a SentencePiece model: <0xHH> is its byte, the boundary mark a space."""
    pieces = ((i, model.id_to_piece(i)) for i in range(model.get_piece_size()))
    return [bytes([int(p[3:5], 16)]) if model.is_byte(i) else p.replace(BOUNDARY, " ").encode() for i, p in pieces]


class PairEncoder:
    """Ids of space + text under A and of text under B, which adds the space itself; None where B's do not spell it.

    Neither tokenizer joins characters across a single space between two words, so texts whose words are parted so
    are encoded word by word, from a cache. All other texts are encoded whole. Both ways give the same ids.
    """

    def __init__(self, tokenizer_path: str, model_file: str, cache_words: int = CACHE_WORDS):
        import sentencepiece
        from tokenizers import Tokenizer

        fast = rank_encoder(tokenizer_path)
        if fast is None:
            slow = Tokenizer.from_file(tokenizer_path)
            slow.encode_special_tokens = True
            fast = lambda text: slow.encode(text, add_special_tokens=False).ids
        model = sentencepiece.SentencePieceProcessor(model_file=model_file)
        self.a_bytes, self.b_bytes = byte_level_tokens(tokenizer_path), piece_tokens(model)
        plain = (model.id_to_piece(i) for i in range(model.get_piece_size()))
        self.by_word = not any(BOUNDARY in p[1:] and p.strip(BOUNDARY) for p in plain)
        spell_a, spell_b = self.a_bytes.__getitem__, self.b_bytes.__getitem__

        def whole(text: str) -> tuple[bytes, bytes] | None:
            a, b = fast(" " + text), model.encode(text)
            raw = b" " + text.encode("utf-8", "replace")
            same = b"".join(map(spell_a, a)) == raw and b"".join(map(spell_b, b)) == raw
            return (array("i", a).tobytes(), array("i", b).tobytes()) if same else None

        class Cache(dict):
            def __missing__(self, word: str) -> tuple[bytes, bytes] | None:
                if len(self) >= cache_words:
                    self.clear()
                value = self[word] = whole(word)
                return value

        self.whole, self.cache = whole, Cache()

    def __call__(self, text: str) -> tuple[bytes, bytes] | None:
        if not text:
            return None
        words = text.split(" ")
        if not self.by_word or "" in words or BOUNDARY in text or any(w[0].isspace() for w in words):
            return self.whole(text)
        found = list(map(self.cache.__getitem__, words))
        if None in found:
            return None
        a, b = zip(*found)
        return b"".join(a), b"".join(b)


class Names:
    """Decimal ids with what follows them in the text of groups: a comma, a bar, a semicolon or nothing."""

    def __init__(self, n: int):
        self.of = [f"{i}{end}" for end in (",", "|", ";", "") for i in range(n)]


def align(a: np.ndarray, b: np.ndarray, ends_a: np.ndarray, ends_b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Cuts, groups of A's and of B's tokens, and links as numbers of A's and of B's tokens.

    ends_a and ends_b are cumulative ends of tokens that hold at least a byte each; both end at the same byte.
    """
    cuts = np.intersect1d(ends_a, ends_b, assume_unique=True)
    group_a, group_b = np.searchsorted(cuts, ends_a), np.searchsorted(cuts, ends_b)
    first = np.searchsorted(ends_b, np.append(0, ends_a[:-1]), "right")
    times = np.searchsorted(ends_b, ends_a, "left") - first + 1
    link_a = np.repeat(np.arange(len(a)), times)
    link_b = np.arange(len(link_a)) + np.repeat(first - np.cumsum(times) + times, times)
    return cuts, group_a, group_b, link_a, link_b


def group_texts(a: np.ndarray, b: np.ndarray, group_a: np.ndarray, group_b: np.ndarray, last_b: np.ndarray, names: Names, n_names: int) -> tuple[list[str], np.ndarray]:
    """The parts of a1,a2|b1;a3|b2 in order, and where in them each token of B stands; last_b marks documents' last."""
    ends_a = np.append(group_a[1:] != group_a[:-1], True)
    ends_b = np.append(group_b[1:] != group_b[:-1], True)
    at_a = np.arange(len(a)) + np.searchsorted(group_b, group_a, "left")
    at_b = np.arange(len(b)) + np.searchsorted(group_a, group_b, "right")
    codes = np.empty(len(a) + len(b), np.int64)
    codes[at_a] = a + n_names * ends_a
    codes[at_b] = b + n_names * np.where(last_b, 3, 2 * ends_b)
    return list(map(names.of.__getitem__, codes.tolist())), at_b


COUNTS = ("n_a", "n_b", "n_groups", "n_links")
ALIGNED = "chunk long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, codes array<int>, times array<int>, pairs array<long>, n_docs array<int>"


class Block:
    """Aligned documents of one block: per document counts, digests and where its links (as pairs) end."""

    def __init__(self, texts: list[str | None], encoder: PairEncoder, lengths: tuple[np.ndarray, np.ndarray], names: Names, n_names: int):
        n = len(texts)
        coded = [encoder(t) if t else None for t in texts]
        self.has = np.array([c is not None for c in coded], bool)
        self.counts = {c: np.zeros(n, np.int64) for c in COUNTS}
        self.sha = [""] * n
        self.pairs = np.empty(0, np.int64)
        found = [c for c in coded if c is not None]
        if not found:
            return
        a, b = (np.frombuffer(b"".join(c[k] for c in found), np.int32).astype(np.int64) for k in (0, 1))
        n_a, n_b = (np.array([len(c[k]) // 4 for c in found]) for k in (0, 1))
        cuts, group_a, group_b, link_a, link_b = align(a, b, np.cumsum(lengths[0][a]), np.cumsum(lengths[1][b]))
        stop_a, stop_b = np.cumsum(n_a), np.cumsum(n_b)
        last_b = np.zeros(len(b), bool)
        last_b[stop_b - 1] = True
        parts, at_b = group_texts(a, b, group_a, group_b, last_b, names, n_names)
        stops = np.append(0, at_b[stop_b - 1] + 1).tolist()
        rows = np.flatnonzero(self.has)
        for row, i, j in zip(rows.tolist(), stops, stops[1:]):
            self.sha[row] = hashlib.sha256("".join(parts[i:j]).encode()).hexdigest()
        groups = group_b[stop_b - 1] + 1
        links = np.searchsorted(link_a, stop_a, "left")
        for name, values in zip(COUNTS, (n_a, n_b, np.diff(groups, prepend=0), np.diff(links, prepend=0))):
            self.counts[name][rows] = values
        self.pairs = a[link_a] << 32 | b[link_b]


def aligned(docs: DataFrame, tokenizer_path: str, model_file: str, chunk_links: int = CHUNK_LINKS, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Documents (rows with codes) and chunks (rows with pairs)."""
    arrow = pa.schema([("chunk", pa.int64()), ("doc_id", pa.int64()), *((c, pa.int64()) for c in COUNTS), ("groups_sha256", pa.string()), ("codes", pa.list_(pa.int32())), ("times", pa.list_(pa.int32())), ("pairs", pa.list_(pa.int64())), ("n_docs", pa.list_(pa.int32()))])

    def batch_of(n: int, **columns: pa.Array) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([columns.get(f.name, pa.nulls(n, f.type)) for f in arrow], schema=arrow)

    def rows_of(chunk: int, held: list[tuple[list, Block]]) -> Iterator[pa.RecordBatch]:
        """The rows of a chunk: its pairs are numbered in their order."""
        links = np.concatenate([block.pairs for _, block in held])
        counts = {c: np.concatenate([block.counts[c] for _, block in held]) for c in COUNTS}
        n = len(counts["n_a"])
        pairs, numbers = np.unique(links, return_inverse=True)
        spread = np.repeat(np.arange(n), counts["n_links"])
        own, times = np.unique(spread * max(1, len(pairs)) + numbers, return_counts=True)
        codes, owner = own % max(1, len(pairs)), own // max(1, len(pairs))
        offsets = np.searchsorted(owner, np.arange(n + 1)).astype(np.int32)
        lists = lambda values: pa.ListArray.from_arrays(pa.array(offsets), pa.array(values.astype(np.int32)))
        columns = {c: pa.array(v) for c, v in counts.items()}
        columns |= {"chunk": pa.array(np.full(n, chunk)), "doc_id": pa.array([i for ids, _ in held for i in ids], pa.int64()), "groups_sha256": pa.array([s for _, block in held for s in block.sha]), "codes": lists(codes), "times": lists(times)}
        yield batch_of(n, **columns)
        n_docs = np.bincount(codes, minlength=len(pairs)).astype(np.int32)
        yield batch_of(1, chunk=pa.array([chunk]), pairs=pa.array([pairs], pa.list_(pa.int64())), n_docs=pa.array([n_docs], pa.list_(pa.int32())))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encoder = PairEncoder(tokenizer_path, model_file)
        lengths = tuple(np.array(list(map(len, x)), np.int64) for x in (encoder.a_bytes, encoder.b_bytes))
        n_names = max(map(len, lengths))
        names = Names(n_names)
        chunk, held, links = TaskContext.get().partitionId() << 32, [], 0
        ids, texts, size = [], [], 0

        def block() -> int:
            held.append((list(ids), Block(texts, encoder, lengths, names, n_names)))
            ids.clear()
            texts.clear()
            return len(held[-1][1].pairs)

        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                ids.append(doc)
                texts.append(text.as_py())
                size += len(texts[-1] or "") + 16
                if size >= block_bytes:
                    links, size = links + block(), 0
                if links >= chunk_links:
                    yield from rows_of(chunk, held)
                    chunk, held, links = chunk + 1, [], 0
        if ids:
            block()
        if held:
            yield from rows_of(chunk, held)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, ALIGNED)


def pair_counts(chunks: DataFrame) -> DataFrame:
    """(pair, n, best) from (chunk, pair, n_docs): in how many documents a pair is, and whether no pair of its A id is in more."""
    salted = chunks.groupBy("pair", F.pmod(F.xxhash64("chunk"), F.lit(SALTS)).alias("salt")).agg(F.sum("n_docs").alias("n"))
    whole = salted.groupBy("pair").agg(F.sum("n").alias("n"))
    counts = materialize(whole, "pairs")
    a = F.shiftright("pair", 32).alias("a")
    most = counts.groupBy(a).agg(F.max("n").alias("most"))
    return counts.select("pair", "n", a).join(most, "a").select("pair", "n", (F.col("n") == F.col("most")).alias("best"))


RESULT = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"


def link_documents(docs: DataFrame, tokenizer_path: str, model_file: str, chunk_links: int = CHUNK_LINKS, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The columns of RESULT for every row of (doc_id, text)."""
    made = materialize(aligned(docs, tokenizer_path, model_file, chunk_links, block_bytes), "aligned")
    chunks = made.where("pairs is not null").select("chunk", F.posexplode(F.arrays_zip("pairs", "n_docs")).alias("code", "p")).select("chunk", "code", F.col("p.pairs").alias("pair"), F.col("p.n_docs").alias("n_docs"))
    counts = pair_counts(chunks)
    known = chunks.select(F.col("chunk").alias("of_"), "code", "pair").join(counts, "pair").select("of_", "code", "n", "best")
    kept = made.where("pairs is null").select("chunk", "doc_id", *COUNTS, "groups_sha256", "codes", "times")
    names = [f.split()[0] for f in RESULT.split(", ")]

    def add_up(rows: pa.Table, sums: pa.Table) -> pa.Table:
        n, best = np.zeros(len(sums), np.int64), np.zeros(len(sums), np.int64)
        at = sums.column("code").to_numpy()
        n[at], best[at] = sums.column("n").to_numpy(), sums.column("best").to_numpy()
        codes, times = (rows.column(c).combine_chunks() for c in ("codes", "times"))
        many = times.flatten().to_numpy().astype(np.int64)
        code = codes.flatten().to_numpy()
        stops = np.append(0, np.cumsum(codes.value_lengths().to_numpy()))
        total = lambda values: np.diff(np.append(0, np.cumsum(values))[stops])
        columns = {"n_best": pa.array(total(many * best[code])), "count_sum": pa.array(total(many * n[code]))}
        return pa.table({c: columns.get(c, rows.column(c) if c in rows.column_names else None) for c in names})

    return kept.groupBy("chunk").cogroup(known.groupBy("of_")).applyInArrow(add_up, RESULT)


def op12_tokenizer_alignment(spark, sf_dir: str) -> DataFrame:
    return link_documents(table(spark, sf_dir, "documents"), default_tokenizer(), default_model())
