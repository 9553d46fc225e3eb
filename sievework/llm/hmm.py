"""Hidden Markov language model over words, trained by Baum-Welch, with exact sequence likelihoods.

Events are the V words seen in training, the document's end among them, and one event for any other word. A state
emits a word class, the class a word: P(w | state) = P(class | state) * (1 - d) * c(w) / C, with c the word's and
C the class's training count. The share d of a class, the Good-Turing estimate from its words seen once, goes to
the unseen event, so the probabilities of a state sum to one. A class is a short word itself or a longer word's
last three bytes, folded into CLASSES slots; so what a task and the driver hold of a model is of fixed size,
however many words the corpus has, while all word counts come from all documents by shuffles.

1. Each task tokenises its documents once, in chunks of CHUNK_BYTES of text: a chunk keeps its tokens as numbers
   of its own word list. Chunks and word lists are a written table.
2. Word lists are summed by word into corpus counts.
3. Every iteration, tasks add up Baum-Welch counts of their chunks in double precision, and a shuffle adds up the
   tasks' counts as whole numbers and whole multiples of 2**-40, so that the sum does not depend on its order. How
   rows are dealt into tasks and chunks changes scores by rounding only.
4. Word lists take their corpus counts by a join, meet their chunk again, and the scaled forward recursion over
   whole documents gives the exact likelihood. A word has one row per chunk that holds it and a chunk has as many
   rows as distinct words, so no word holds a large share of the rows that meet in that join.

Defined results: a null or empty text is the end alone; a row with a null id is scored and not learned from;
repeated rows count each; with nothing to learn from every event is the unseen one with probability 1; an empty
table gives no rows. Only the named columns are read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import column, materialize, sorted_groups, table

STATES = 8
CLASSES = 8192
ITERATIONS = 6
CHUNK_BYTES = 8 << 20
#: Tokens whose messages a task holds at a time, but for a single document that is longer.
BLOCK_TOKENS = 1 << 19
SMOOTHING = 50.0
UNIT = 1 << 40
#: Stands for a document's end; no word holds a space.
END = b" "
_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def word_class(word: bytes) -> int:
    return zlib.crc32(word if len(word) <= 4 else b"~" + word[-3:]) % CLASSES


class WordList(dict):
    """Numbers words as they come."""

    def __missing__(self, word: bytes) -> int:
        self[word] = number = len(self)
        return number


CHUNKS = "chunk long, doc_ids array<long>, lengths array<int>, held array<boolean>, tokens binary, classes binary, local int, word binary, class int, n long"


def encode(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", modulus: int = 7, remainder: int = 2, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """Chunks (rows without word) and their word lists (rows with word; n counts the word in training documents)."""
    arrow = pa.schema([("chunk", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("lengths", pa.list_(pa.int32())), ("held", pa.list_(pa.bool_())), ("tokens", pa.binary()), ("classes", pa.binary()), ("local", pa.int32()), ("word", pa.binary()), ("class", pa.int32()), ("n", pa.int64())])

    def rows_of(chunk: int, words: WordList, ids: list, held: list, parts: list) -> Iterator[pa.RecordBatch]:
        size = len(words)
        classes = np.fromiter(map(word_class, words), np.int32, size)
        learned = [p for p, h, i in zip(parts, held, ids) if not h and i is not None]
        n = np.bincount(np.concatenate(learned), minlength=size) if learned else np.zeros(size, np.int64)
        one = {"chunk": chunk, "doc_ids": ids, "lengths": [len(p) for p in parts], "held": held, "tokens": np.concatenate(parts).astype("<i4").tobytes(), "classes": classes.astype("<u2").tobytes()}
        yield pa.RecordBatch.from_pylist([one], arrow)
        columns = {"chunk": pa.array(np.full(size, chunk)), "local": pa.array(np.arange(size, dtype=np.int32)), "word": pa.array(list(words), pa.binary()), "class": pa.array(classes), "n": pa.array(n.astype(np.int64))}
        whole = pa.RecordBatch.from_arrays([columns.get(f.name, pa.nulls(size, f.type)) for f in arrow], schema=arrow)
        for a in range(0, size, 50_000):
            yield whole.slice(a, 50_000)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        chunk = TaskContext.get().partitionId() << 32
        words, ids, held, parts, size = WordList(), [], [], [], 0
        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                raw = (text.as_py() or "").encode("utf-8", "replace")
                tokens = raw.translate(_LOWER).split()
                tokens.append(END)
                parts.append(np.fromiter(map(words.__getitem__, tokens), np.int32, len(tokens)))
                ids.append(doc)
                held.append(doc is not None and zlib.crc32(str(doc).encode()) % modulus == remainder)
                size += len(raw) + 16
                if size >= chunk_bytes:
                    yield from rows_of(chunk, words, ids, held, parts)
                    chunk, words, ids, held, parts, size = chunk + 1, WordList(), [], [], [], 0
        if ids:
            yield from rows_of(chunk, words, ids, held, parts)

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, CHUNKS)


@dataclass(frozen=True)
class Counts:
    """What the corpus counts say in fixed size: all tokens, distinct words, and per class tokens and words seen once."""

    tokens: int
    words: int
    per_class: np.ndarray
    once: np.ndarray

    @staticmethod
    def of(counts: DataFrame) -> Counts:
        by = counts.groupBy("class").agg(F.sum("c").alias("c"), F.count(F.lit(1)).alias("v"), F.sum((F.col("c") == 1).cast("long")).alias("h")).collect()
        per_class, once = np.zeros(CLASSES), np.zeros(CLASSES)
        for r in by:
            per_class[r["class"]], once[r["class"]] = r.c, r.h
        return Counts(int(sum(r.c for r in by)), int(sum(r.v for r in by)), per_class, once)


@dataclass(frozen=True)
class Model:
    """start (K), move (K x K) and emit (CLASSES x K): probabilities of classes; each column of emit sums to one."""

    start: np.ndarray
    move: np.ndarray
    emit: np.ndarray

    @staticmethod
    def initial(counts: Counts, states: int) -> Model:
        """Persistent states whose class probabilities are scattered around the corpus frequencies."""
        rng = np.random.default_rng(7)
        emit = usual(counts)[:, None] * np.exp(rng.normal(0, 1.0, (CLASSES, states)))
        move = np.full((states, states), 0.1 / max(1, states - 1)) if states > 1 else np.ones((1, 1))
        if states > 1:
            np.fill_diagonal(move, 0.9)
        return Model(np.full(states, 1 / states), move, emit / emit.sum(0))

    def next(self, sums: np.ndarray, counts: Counts) -> Model:
        """The maximisation step from expected counts: CLASSES rows, then a row per state's moves, then the starts."""
        k = len(self.start)
        emit = sums[:CLASSES] + SMOOTHING * usual(counts)[:, None]
        move, start = sums[CLASSES : CLASSES + k] + 1, sums[CLASSES + k] + 1
        return Model(start / start.sum(), move / move.sum(1, keepdims=True), emit / emit.sum(0))

    def events(self, counts: Counts) -> np.ndarray:
        """P(known word's class | state) less the unseen share, and in the last row the unseen event's probability."""
        if not counts.tokens:
            return np.vstack([np.zeros_like(self.emit), np.ones(len(self.start))])
        share = ((counts.once + 1e-3) / (counts.per_class + 1))[:, None]
        return np.vstack([self.emit * (1 - share), (self.emit * share).sum(0)])


def usual(counts: Counts) -> np.ndarray:
    """The corpus frequencies of classes, none of them zero."""
    return (counts.per_class + 1 / CLASSES) / (counts.tokens + 1)


def expected(symbols: np.ndarray, first: np.ndarray, model: Model) -> np.ndarray:
    """Expected counts (see Model.next) of documents, their class numbers one after the other; first marks their starts.

    Whole documents are worked on side by side, the longest first: place t of all that have one is one block.
    """
    k = len(model.start)
    move, start = model.move, model.start
    begins = np.flatnonzero(first)
    lengths = np.diff(np.append(begins, len(symbols)))
    order = np.argsort(-lengths, kind="stable")
    active = len(lengths) - np.searchsorted(lengths[order][::-1], np.arange(lengths[order[0]]), "right")
    at = np.append(0, np.cumsum(active))
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    x = np.empty(len(symbols), np.int64)
    x[at[np.arange(len(symbols)) - np.repeat(begins, lengths)] + np.repeat(rank, lengths)] = symbols
    emit = model.emit[x]
    alpha, scale = np.empty_like(emit), np.empty((len(x), 1))
    ones = np.ones((k, 1))
    blocks = list(zip(at[:-1].tolist(), at[1:].tolist()))
    for t, (i, j) in enumerate(blocks):
        a = alpha[before : before + j - i] @ move if t else np.tile(start, (j, 1))
        a *= emit[i:j]
        np.maximum(a @ ones, 1e-300, out=scale[i:j])
        np.divide(a, scale[i:j], out=alpha[i:j])
        before = i
    emit /= scale
    moves = np.zeros((k, k))
    beta = np.ones((len(order), k))
    back = move.T.copy()
    for t in range(len(blocks) - 1, 0, -1):
        (i, j), before = blocks[t], blocks[t - 1][0]
        now = beta[: j - i]
        ahead = emit[i:j]
        ahead *= now
        moves += alpha[before : before + j - i].T @ ahead
        alpha[i:j] *= now
        np.matmul(ahead, back, out=now)
    gamma = alpha
    gamma[: len(order)] *= beta
    out = np.empty((CLASSES + k + 1, k))
    for s in range(k):
        out[:CLASSES, s] = np.bincount(x, weights=gamma[:, s], minlength=CLASSES)
    out[CLASSES : CLASSES + k] = moves * model.move
    out[CLASSES + k] = gamma[: len(order)].sum(0)
    return out


def baum_welch(chunks: DataFrame, model: Model) -> np.ndarray:
    """The expected counts of all training documents: summed within tasks, then by a shuffle."""
    k = len(model.start)

    names = [f"{kind}{s}" for kind in "wf" for s in range(k)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((CLASSES + k + 1, k))
        for batch in batches:
            for lengths, held, ids, tokens, classes in zip(*(batch.column(c) for c in range(5))):
                n = lengths.values.to_numpy()
                use = np.array([not h and i is not None for h, i in zip(held.as_py(), ids.as_py())], bool)
                symbols = np.frombuffer(classes.as_py(), "<u2")[np.frombuffer(tokens.as_py(), "<i4")][np.repeat(use, n)].astype(np.int64)
                symbols, n = by_length(symbols, n[use].astype(np.int64))
                for a, b, starts in blocks_of(n, BLOCK_TOKENS):
                    first = np.zeros(b - a, bool)
                    first[starts] = True
                    total += expected(symbols[a:b], first, model)
        rows = np.flatnonzero(total.any(1))
        whole = np.floor(total[rows])
        parts = [*whole.T.astype(np.int64), *np.rint((total[rows] - whole) * UNIT).T.astype(np.int64)]
        yield pa.RecordBatch.from_arrays([pa.array(rows.astype(np.int32)), *map(pa.array, parts)], ["row", *names])

    parts = chunks.select("lengths", "held", "doc_ids", "tokens", "classes").mapInArrow(run, "row int, " + ", ".join(f"{n} long" for n in names))
    out = np.zeros((CLASSES + k + 1, k))
    for r in parts.groupBy("row").agg(*[F.sum(n).alias(n) for n in names]).collect():
        out[r["row"]] = [r[f"w{s}"] + r[f"f{s}"] / UNIT for s in range(k)]
    return out


def by_length(symbols: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Documents (one after the other) with the longest first: documents of like lengths keep all of a block's lanes busy."""
    order = np.argsort(-lengths, kind="stable")
    begins, sorted_lengths = (np.cumsum(lengths) - lengths)[order], lengths[order]
    shift = begins - (np.cumsum(sorted_lengths) - sorted_lengths)
    return symbols[np.repeat(shift, sorted_lengths) + np.arange(len(symbols))], sorted_lengths


def blocks_of(lengths: np.ndarray, tokens: int) -> Iterator[tuple[int, int, np.ndarray]]:
    """(first, end, starts of documents from first) of runs of documents of up to so many tokens, or of a longer one."""
    ends = np.cumsum(lengths)
    at = 0
    while at < len(ends):
        begin = int(ends[at - 1]) if at else 0
        stop = max(at + 1, int(np.searchsorted(ends, begin + tokens, "right")))
        yield begin, int(ends[stop - 1]), ends[at:stop] - lengths[at:stop] - begin
        at = stop


def log_likelihoods(symbols: np.ndarray, lengths: np.ndarray, model: Model, events: np.ndarray) -> np.ndarray:
    """Natural log-likelihoods of documents (their symbols one after the other) by the scaled forward recursion."""
    order = np.argsort(-lengths, kind="stable")
    begins = (np.cumsum(lengths) - lengths)[order]
    sorted_lengths = lengths[order]
    active = np.searchsorted(-sorted_lengths, -np.arange(1, (sorted_lengths[0] if len(lengths) else 0) + 1), "right")
    total = np.zeros(len(lengths))
    ones = np.ones(len(model.start))
    alpha = np.empty((0, len(ones)))
    for t, n in enumerate(active.tolist()):
        a = events[symbols[begins[:n] + t]]
        a *= alpha[:n] @ model.move if t else model.start
        scale = a @ ones
        total[:n] += np.log(scale)
        a /= scale[:, None]
        alpha = a
    out = np.empty(len(lengths))
    out[order] = total
    return out


SCORES = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def packed(word_counts: DataFrame, limit: int = 1 << 21) -> DataFrame:
    """Rows (chunk, local, c) gathered within tasks into rows (chunk, locals, cs) of little-endian arrays.

    A task hands on what it holds after limit rows, so its memory is bounded.
    """

    def emit(held: list[tuple[np.ndarray, ...]]) -> pa.RecordBatch:
        chunk, local, c = (np.concatenate(parts) for parts in zip(*held))
        order = np.argsort(chunk, kind="stable")
        chunk, local, c = chunk[order], local[order].astype("<i4"), c[order].astype("<i8")
        starts = np.flatnonzero(np.append(True, chunk[1:] != chunk[:-1]))
        stops = np.append(starts[1:], len(chunk))
        parts = [(local[i:j].tobytes(), c[i:j].tobytes()) for i, j in zip(starts.tolist(), stops.tolist())]
        return pa.RecordBatch.from_arrays([pa.array(chunk[starts]), pa.array([x for x, _ in parts], pa.binary()), pa.array([y for _, y in parts], pa.binary())], ["chunk", "locals", "cs"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows = [], 0
        for batch in batches:
            if batch.num_rows:
                held.append(tuple(column(batch, name) for name in ("chunk", "local", "c")))
                rows += batch.num_rows
            if rows >= limit:
                yield emit(held)
                held, rows = [], 0
        if held:
            yield emit(held)

    return word_counts.select("chunk", "local", "c").mapInArrow(run, "chunk long, locals binary, cs binary")


def score(chunks: DataFrame, word_counts: DataFrame, model: Model, counts: Counts) -> DataFrame:
    """The scores of all documents; word_counts is (chunk, local, c) for all known words of the chunks' lists."""
    payload = chunks.select("chunk", F.lit(0).alias("part"), F.lit(None).cast("binary").alias("locals"), F.lit(None).cast("binary").alias("cs"), "doc_ids", "lengths", "held", "tokens", "classes")
    listed = packed(word_counts).select("chunk", F.lit(1).alias("part"), "locals", "cs", *[F.lit(None).cast(payload.schema[c].dataType).alias(c) for c in payload.columns[4:]])
    events = model.events(counts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, rows in sorted_groups(batches, ["chunk"]):
            head = rows.slice(0, 1).to_pylist()[0]
            c = np.zeros(len(head["classes"]) // 2, np.int64)
            for local, n in zip(rows.column("locals").to_pylist()[1:], rows.column("cs").to_pylist()[1:]):
                c[np.frombuffer(local, "<i4")] = np.frombuffer(n, "<i8")
            classes = np.frombuffer(head["classes"], "<u2").astype(np.int64)
            tokens, lengths = np.frombuffer(head["tokens"], "<i4"), np.array(head["lengths"], np.int64)
            known = c > 0
            symbol = np.where(known, classes, CLASSES)
            within = np.where(known, np.log10(np.maximum(c, 1) / np.maximum(counts.per_class[classes], 1)), 0.0)
            base = np.log10((c + 1) / (counts.tokens + counts.words + 1))
            starts = np.cumsum(lengths) - lengths
            add = lambda values: np.add.reduceat(values[tokens], starts)
            likely = log_likelihoods(symbol[tokens], lengths, model, events) / np.log(10) + add(within)
            cols = [pa.array(head["doc_ids"], pa.int64()), pa.array(head["held"], pa.bool_()), pa.array(lengths), pa.array(add(known.astype(np.int64))), pa.array(np.full(len(lengths), counts.tokens)), pa.array(add(base)), pa.array(likely)]
            yield pa.RecordBatch.from_arrays(cols, [f.split()[0] for f in SCORES.split(", ")])

    dealt = payload.unionByName(listed).repartition("chunk").sortWithinPartitions("chunk", "part")
    return dealt.mapInArrow(run, SCORES)


def train(chunks: DataFrame, counts: Counts, states: int = STATES, iterations: int = ITERATIONS) -> Model:
    model = Model.initial(counts, states)
    for _ in range(iterations if counts.tokens else 0):
        model = model.next(baum_welch(chunks, model), counts)
    return model


def score_documents(docs: DataFrame, states: int = STATES, iterations: int = ITERATIONS, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """Train on the documents that are not held out and score all of (doc_id, text)."""
    made = materialize(encode(docs, chunk_bytes=chunk_bytes), "chunks")
    chunks, lists = made.where("word is null"), made.where("word is not null").select("chunk", "local", "word", "class", "n")
    by_word = materialize(lists.groupBy("word", "class").agg(F.sum("n").alias("c")).where("c > 0"), "counts")
    counts = Counts.of(by_word)
    model = train(chunks, counts, states, iterations)
    joined = lists.select("chunk", "local", "word").join(by_word.select("word", "c"), "word").select("chunk", "local", "c")
    return score(chunks, joined, model, counts)


def op1_lm_scoring(spark, sf_dir: str) -> DataFrame:
    return score_documents(table(spark, sf_dir, "documents"))
