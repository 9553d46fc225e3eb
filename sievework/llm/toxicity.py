"""Toxicity: a linear-chain conditional random field tags toxic spans, and its marginals give scores of documents.

Labels are known by document, so tokens are labelled first:

1. Over labelled training documents (EVIDENCE_PER_CLASS of a class at most, by the hash of their ids), a word's
   features (itself and its beginnings) are counted by the documents that hold them. Of toxic documents only as many count as show the feature between different neighbours, so that
   the chance words of a much copied text gain nothing by its copies. Features whose likelihood ratio is beyond what
   the number of features of their kind makes likely by chance, and that are far more frequent in toxic documents, are kept.
2. In toxic documents, words with a kept feature are toxic tokens; all other tokens are clean ones.
3. A field of two states is fitted to whole sampled documents: weights of the features of a token and of the words
   beside it, and of transitions. Tasks sum gradients by forward-backward.
4. Forward-backward over a whole text gives each token's marginal. Tokens of 0.5 or more are spans; the largest
   marginal and the expected number of toxic tokens give the document's score by a logistic fitted on the sample.

With two states, messages are ratios, and a step is a fractional linear map. Texts are worked on as one sequence of
documents, cut into as many lanes as a lane has tokens: maps of lanes are composed side by side and joined by a scan,
so one very long text takes no longer than many short ones.

Defined results: null and empty texts are scored like any text, without tokens; repeated rows score alike; a null id
is never learned from but scored; an empty table gives no rows; labels other than 0 and 1, null labels and ids whose
labels disagree are left out; where an id repeats, learning counts its rows each, and the sample takes one; without
training rows of both classes, or without a kept feature, every score is the share of toxic labels, 0 without labels.
Only the named columns are read.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, table
from .quality import held_out

THRESHOLD = 0.5
#: Lengths of the beginnings that are features beside the whole word.
BEGINNINGS = (4, 5, 6)
#: Features are counted on about so many documents of a class, and the field is fitted on about so many of them.
EVIDENCE_PER_CLASS = 100_000
SAMPLE_PER_CLASS = 2000
SAMPLE_PARTITIONS = 16
#: A field has at most so many features, those of the best evidence.
MOST_FEATURES = 1 << 14
#: A kept feature is so many times as frequent in toxic documents, at least.
LEAST_RATIO = 9.0
ITERATIONS = 25
RIDGE = 0.02
#: Features that a task counts before it hands them on.
HELD_FEATURES = 400_000
CACHE_WORDS = 400_000
#: Tokens that are worked on together, but for a longer text.
BLOCK_TOKENS = 1 << 18
_WORD = re.compile(r"[^\W_]+")
_SIGN = 1 << 63


#: Counts documents among the features; no word is empty.
ALL = ""


def features_of(word: str) -> tuple[str, ...]:
    """The features of a word without regard to case: itself, and its beginnings with a star."""
    word = word.lower()
    return (word, *(word[:k] + "*" for k in BEGINNINGS if len(word) >= k))


def evidence(labelled: DataFrame) -> DataFrame:
    """(feature, contexts, toxic, clean) of (text, toxic): bits of neighbours in toxic documents, and documents by class."""

    class Features(dict):
        def __missing__(self, word: str) -> tuple[str, ...]:
            if len(self) >= CACHE_WORDS:
                self.clear()
            value = self[word] = features_of(word)
            return value

    def batch_of(docs: list[Counter], bits: dict[str, int]) -> Iterator[pa.RecordBatch]:
        keys = list(docs[0] | docs[1])
        signed = [v - 2 * _SIGN if (v := bits.get(k, 0)) >= _SIGN else v for k in keys]
        columns = [pa.array(keys, pa.string()), *(pa.array(x, pa.int64()) for x in (signed, [docs[1][k] for k in keys], [docs[0][k] for k in keys]))]
        whole = pa.RecordBatch.from_arrays(columns, ["feature", "contexts", "toxic", "clean"])
        for a in range(0, len(keys), 50_000):
            yield whole.slice(a, 50_000)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features, docs, bits = Features(), [Counter(), Counter()], {}
        for batch in batches:
            for text, toxic in zip(batch.column(0), batch.column(1).to_pylist()):
                words = _WORD.findall(text.as_py() or "")
                docs[toxic][ALL] += 1
                docs[toxic].update(set(chain.from_iterable(map(features.__getitem__, set(words)))))
                if toxic:
                    near = [0, *(crc32(w.encode("utf-8", "replace")) for w in words), 0]
                    for left, word, right in zip(near, words, near[2:]):
                        bit = 1 << ((left * 0x9E3779B1 + right * 0x85EBCA77) >> 24 & 63)
                        for f in features[word]:
                            bits[f] = bits.get(f, 0) | bit
                if len(docs[0]) + len(docs[1]) >= HELD_FEATURES:
                    yield from batch_of(docs, bits)
                    docs, bits = [Counter(), Counter()], {}
        yield from batch_of(docs, bits)

    parts = labelled.select(F.col("text"), F.col("toxic")).mapInArrow(run, "feature string, contexts long, toxic long, clean long")
    return parts.groupBy("feature").agg(F.bit_or("contexts").alias("contexts"), F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))


def kept_features(counts: DataFrame) -> list[str]:
    """The features of best evidence, at most MOST_FEATURES of them; none without documents of both classes."""
    all_ = counts.where(F.col("feature") == ALL).first()
    if all_ is None or not all_.toxic or not all_.clean:
        return []
    counts = counts.where(F.col("feature") != ALL)
    share = all_.toxic / (all_.toxic + all_.clean)
    filled = F.bit_count("contexts")
    seen = F.when(filled < 64, -64 * F.log(1 - filled / 64)).otherwise(F.col("toxic"))
    a, b = F.col("a"), F.col("clean").cast("double")
    ratio = (a / all_.toxic) / ((b + 0.5) / all_.clean)
    b_part = F.when(b > 0, b * F.log(b / ((a + b) * (1 - share)))).otherwise(0.0)
    gain = 2 * (a * F.log(a / ((a + b) * share)) + b_part)
    kind = F.when(F.endswith("feature", F.lit("*")), F.length("feature")).otherwise(0)
    least = F.lit(0.0)
    for r in counts.groupBy(kind.alias("kind")).count().collect():
        least = F.when(kind == r.kind, 2 * math.log(max(r["count"], 2)) + 4).otherwise(least)
    rated = counts.where("toxic > 0").withColumn("a", F.least(seen, F.col("toxic")).cast("double")).where(a > 0)
    best = rated.select("feature", ratio.alias("ratio"), gain.alias("gain"), least.alias("least")).where((F.col("ratio") >= LEAST_RATIO) & (F.col("gain") >= F.col("least")))
    return [r.feature for r in best.orderBy(F.desc("gain"), "feature").limit(MOST_FEATURES).collect()]


def ratios(e: np.ndarray, first: np.ndarray, move: np.ndarray) -> np.ndarray:
    """r[t] = e[t] * (move[0,1] + move[1,1] r[t-1]) / (move[0,0] + move[1,0] r[t-1]), and e[t] where first[t].

    The sequence is cut into lanes that are worked on side by side; the maps of whole lanes are joined by a scan.
    """
    n = len(e)
    steps = max(1, math.isqrt(n))
    lanes = -(-n // steps)
    wide = np.ones(lanes * steps)
    wide[:n] = e
    new = np.ones(lanes * steps, bool)
    new[:n] = first
    wide, new = np.ascontiguousarray(wide.reshape(lanes, steps).T), np.ascontiguousarray(new.reshape(lanes, steps).T)
    (m00, m01), (m10, m11) = move.tolist()
    a, b = np.array([[1.0], [0.0]]).repeat(lanes, 1), np.array([[0.0], [1.0]]).repeat(lanes, 1)
    any_new = new.any(1)
    for t in range(steps):
        clean, toxic = a * m00 + b * m10, (a * m01 + b * m11) * wide[t]
        if any_new[t]:
            total = a + b
            clean, toxic = np.where(new[t], total, clean), np.where(new[t], total * wide[t], toxic)
        scale = 1 / (clean + toxic).sum(0)
        a, b = clean * scale, toxic * scale
    enter, r = np.empty(lanes), 1.0
    for lane, (a0, a1, b0, b1) in enumerate(zip(a[0].tolist(), a[1].tolist(), b[0].tolist(), b[1].tolist())):
        enter[lane] = r
        r = (b0 + r * b1) / (a0 + r * a1)
    out, r = np.empty_like(wide), enter
    for t in range(steps):
        r = wide[t] * (m01 + m11 * r) / (m00 + m10 * r)
        if any_new[t]:
            r = np.where(new[t], wide[t], r)
        out[t] = r
    return out.T.reshape(-1)[:n]


@dataclass(frozen=True)
class Field:
    """A fitted field: weights of features of the token, of the word before and of the word after; bias; log moves."""

    keys: tuple[str, ...]
    weights: np.ndarray  # 3 x features
    bias: float
    move: np.ndarray  # 2 x 2 log potentials from state to state, clean first; that of clean to clean is 0
    logistic: tuple[float, float, float] = (0.0, 1.0, 0.0)

    def marginals(self, e: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Odds of the toxic state, and the forward and backward ratios, from log emissions."""
        factors, move = np.exp(np.clip(e, -30, 30)), np.exp(self.move)
        last = np.append(first[1:], True)
        ahead = ratios(factors, first, move)
        back = ratios(factors[::-1], last[::-1], np.ascontiguousarray(move.T))[::-1]
        return ahead * back / factors, ahead, back

    def score(self, top: np.ndarray, expected: np.ndarray) -> np.ndarray:
        base, by_top, by_expected = self.logistic
        return 1 / (1 + np.exp(-np.clip(base + by_top * top + by_expected * np.log1p(expected), -500, 500)))


def summaries(odds: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """By document: the largest log odds, between -12 and 12, and the expected number of toxic tokens."""
    top, expected = np.full(len(lengths), -12.0), np.zeros(len(lengths))
    filled = np.flatnonzero(lengths)
    if len(filled):
        starts = (np.cumsum(lengths) - lengths)[filled]
        top[filled] = np.clip(np.log(np.maximum.reduceat(odds, starts)), -12, 12)
        expected[filled] = np.add.reduceat(odds / (1 + odds), starts)
    return top, expected


SPARSE = "toxic int, n int, places array<int>, features array<int>"


def encoded(sample: DataFrame, keys: list[str]) -> DataFrame:
    """(toxic, n, places, features) of (text, toxic): where in n tokens kept features are, by number."""
    arrow = pa.schema([("toxic", pa.int32()), ("n", pa.int32()), ("places", pa.list_(pa.int32())), ("features", pa.list_(pa.int32()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = {k: i for i, k in enumerate(keys)}
        for batch in batches:
            rows = []
            for text, toxic in zip(batch.column(0), batch.column(1).to_pylist()):
                words = _WORD.findall(text.as_py() or "")
                hits = [(at, number[f]) for at, w in enumerate(words) for f in features_of(w) if f in number]
                rows.append({"toxic": toxic, "n": len(words), "places": [a for a, _ in hits], "features": [f for _, f in hits]})
            yield pa.RecordBatch.from_pylist(rows, arrow)

    return sample.select("text", "toxic").mapInArrow(run, SPARSE)


def flat(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Toxic, lengths, places in the batch's tokens and features of rows of encoded."""
    toxic, n = (batch.column(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in (0, 1))
    many = batch.column(2).value_lengths().to_numpy(zero_copy_only=False)
    places = batch.column(2).flatten().to_numpy(zero_copy_only=False) + np.repeat(np.cumsum(n) - n, many)
    return toxic, n, places, batch.column(3).flatten().to_numpy(zero_copy_only=False)


def emissions(field: Field, n: np.ndarray, places: np.ndarray, features: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Log emissions, starts of documents, and which entries have a token after and one before in their document."""
    size = int(n.sum())
    first = np.zeros(size + 1, bool)
    first[(np.cumsum(n) - n)[n > 0]] = True
    first[size] = True
    after, before = ~first[places + 1], ~first[places]
    e = np.full(size, field.bias)
    e += np.bincount(places, field.weights[0][features], size)
    e += np.bincount(places[after] + 1, field.weights[1][features[after]], size)
    e += np.bincount(places[before] - 1, field.weights[2][features[before]], size)
    return e, first[:size], after, before


def gradient(field: Field, batch: pa.RecordBatch) -> np.ndarray:
    """Of the log-likelihood: 3 x features, then the bias, then the moves to toxic, from toxic and within it."""
    toxic, n, places, features = flat(batch)
    k = field.weights.shape[1]
    if not n.sum():
        return np.zeros(3 * k + 4)
    e, first, after, before = emissions(field, n, places, features)
    odds, ahead, back = field.marginals(e, first)
    y = np.zeros(len(e))
    owner = np.repeat(np.arange(len(n)), batch.column(2).value_lengths().to_numpy(zero_copy_only=False))
    y[places[toxic[owner] == 1]] = 1
    g = y - odds / (1 + odds)
    parts = [np.bincount(features, g[places], k), np.bincount(features[after], g[places[after] + 1], k), np.bincount(features[before], g[places[before] - 1], k), [g.sum()]]
    inner = np.flatnonzero(~first)
    move = np.exp(field.move)
    left, right = ahead[inner - 1], back[inner]
    weights = [move[0, 0] * np.ones(len(inner)), move[0, 1] * right, move[1, 0] * left, move[1, 1] * left * right]
    total = sum(weights)
    seen = [((y[inner - 1] == i) & (y[inner] == j)).sum() for i, j in ((0, 1), (1, 0), (1, 1))]
    parts.append([s - (w / total).sum() for s, w in zip(seen, weights[1:])])
    return np.concatenate(parts)


def fit_field(rows: DataFrame, keys: list[str], iterations: int = ITERATIONS) -> Field:
    """Fit weights by gradients that tasks sum over all rows of encoded; each weight has a step of its own (Rprop)."""
    k = len(keys)
    size = 3 * k + 4
    at, step, before = np.zeros(size), np.full(size, 0.5), np.zeros(size)
    at[3 * k] = -4.0

    def field_of(values: np.ndarray) -> Field:
        move = np.array([[0.0, values[3 * k + 1]], [values[3 * k + 2], values[3 * k + 3]]])
        return Field(tuple(keys), values[: 3 * k].reshape(3, k), float(values[3 * k]), move)

    for _ in range(iterations):
        field = field_of(at)

        def run(batches: Iterator[pa.RecordBatch], field: Field = field) -> Iterator[pa.RecordBatch]:
            total = np.zeros(size)
            for batch in batches:
                total += gradient(field, batch)
            yield pa.RecordBatch.from_arrays([pa.array([total], pa.list_(pa.float64()))], ["g"])

        g = np.sum([r.g for r in rows.mapInArrow(run, "g array<double>").collect()], axis=0) - RIDGE * at
        turned = g * before
        step = np.clip(np.where(turned > 0, step * 1.3, np.where(turned < 0, step * 0.5, step)), 1e-4, 2.0)
        at, before = at + np.sign(g) * step, g
    return field_of(at)


def fit_logistic(x: np.ndarray, y: np.ndarray, rounds: int = 30) -> tuple[float, float, float]:
    """Newton steps of a ridge logistic regression with two inputs; classes weigh alike."""
    design = np.column_stack([np.ones(len(x)), x])
    weight = np.where(y == 1, 0.5 / max((y == 1).sum(), 1), 0.5 / max((y == 0).sum(), 1)) * len(y)
    beta = np.array([0.0, 0.1, 0.0])
    ridge = np.diag([1e-3, 1.0, 1.0])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(design @ beta, -30, 30)))
        slope = design.T @ (weight * (y - p)) - ridge @ beta
        curve = (design * (weight * p * (1 - p))[:, None]).T @ design + ridge
        move = np.linalg.solve(curve, slope)
        beta = beta + move * min(1.0, 2.0 / max(np.abs(move).max(), 1e-12))
    return tuple(beta.tolist())


def calibrated(field: Field, rows: DataFrame) -> Field:
    """The field with its logistic, fitted on the sample."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            toxic, n, places, features = flat(batch)
            e, first, _, _ = emissions(field, n, places, features)
            odds = field.marginals(e, first)[0] if len(e) else e
            top, expected = summaries(odds, n)
            yield pa.RecordBatch.from_arrays([pa.array(toxic), pa.array(top), pa.array(expected)], ["toxic", "top", "expected"])

    found = rows.mapInArrow(run, "toxic long, top double, expected double").collect()
    x = np.array([[r.top, math.log1p(r.expected)] for r in found])
    return Field(field.keys, field.weights, field.bias, field.move, fit_logistic(x, np.array([r.toxic for r in found])))


def train(docs: DataFrame, labels: DataFrame, modulus: int = 5, remainder: int = 0, iterations: int = ITERATIONS) -> Field | float:
    """The field learned from labelled rows of (doc_id, text) outside the held-out remainder, or else the share of toxic rows."""
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).where("doc_id is not null and toxic in (0, 1)")
    known = known.groupBy("doc_id").agg(F.min("toxic").alias("toxic"), F.max("toxic").alias("top_")).where("toxic = top_").drop("top_")
    known = known.where(~held_out("doc_id", modulus, remainder))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where("doc_id is not null")
    n = {r.toxic: r["count"] for r in known.groupBy("toxic").count().collect()}
    if len(n) < 2:
        return n.get(1, 0) / max(1, sum(n.values()))

    def about(limit: int) -> DataFrame:
        """About limit ids of each class at most, by their hash: few enough to broadcast, and no task ranks ids."""
        least = F.when(F.col("toxic") == 1, min(1.0, limit / n[1]) * (1 << 31)).otherwise(min(1.0, limit / n[0]) * (1 << 31))
        return F.broadcast(known.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 31)) < least))

    keys = kept_features(materialize(evidence(rows.join(about(EVIDENCE_PER_CLASS), "doc_id")), "evidence"))
    if not keys:
        return n[1] / (n[0] + n[1])
    sample = rows.join(about(SAMPLE_PER_CLASS), "doc_id").groupBy("doc_id").agg(F.min("toxic").alias("toxic"), F.min_by("text", F.xxhash64("text")).alias("text"))
    coded = materialize(encoded(sample.repartition(SAMPLE_PARTITIONS, "doc_id"), keys), "sample")
    return calibrated(fit_field(coded, keys, iterations), coded)


class Words(dict):
    """Numbers words with kept features as they come, other words being 0; sums holds their weights for a token and those beside it."""

    def __init__(self, field: Field):
        self.number = {k: i for i, k in enumerate(field.keys)}
        self.starts = {k[: BEGINNINGS[0]] for k in field.keys}
        self.weights = field.weights
        self.clear_all()

    def clear_all(self) -> None:
        self.clear()
        self.sums: list[np.ndarray] = [np.zeros(3)]

    def __missing__(self, word: str) -> int:
        value = 0
        if word.lower()[: BEGINNINGS[0]] in self.starts:
            found = [self.number[f] for f in features_of(word) if f in self.number]
            if found:
                value = len(self.sums)
                self.sums.append(self.weights[:, found].sum(1))
        self[word] = value
        return value


def spans_of(text: str, toxic: np.ndarray) -> list[dict[str, int]]:
    """Code point offsets of runs of toxic tokens, from the number of each toxic token in the text."""
    wanted, out, last = set(toxic.tolist()), [], None
    for at, m in enumerate(_WORD.finditer(text)):
        if at in wanted:
            if out and last == at - 1:
                out[-1]["stop"] = m.end()
            else:
                out.append({"start": m.start(), "stop": m.end()})
            last = at
    return out


SCORED = "doc_id long, score double, predicted int, n_toxic double, spans array<struct<start:int,stop:int>>"


def tag(docs: DataFrame, model: Field | float, threshold: float = THRESHOLD) -> DataFrame:
    """Score, expected toxic tokens and toxic spans (code point offsets) of every row of (doc_id, text)."""
    arrow = pa.schema([("doc_id", pa.int64()), ("score", pa.float64()), ("predicted", pa.int32()), ("n_toxic", pa.float64()), ("spans", pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32())])))])

    def block(ids: list, texts: list[str], counts: list[int], numbers: list[np.ndarray], words: Words) -> pa.RecordBatch:
        lengths = np.array(counts, np.int64)
        spans: list[list] = [[] for _ in ids]
        top, expected = summaries(np.empty(0), np.zeros(len(ids), np.int64))
        if lengths.sum():
            x = np.concatenate(numbers)
            first = np.zeros(len(x), bool)
            starts = np.cumsum(lengths) - lengths
            first[starts[lengths > 0]] = True
            own, left, right = np.array(words.sums).T
            e = model.bias + own[x]
            e[1:] += np.where(first[1:], 0, left[x[:-1]])
            e[:-1] += np.where(first[1:], 0, right[x[1:]])
            odds = model.marginals(e, first)[0]
            top, expected = summaries(odds, lengths)
            hits = np.flatnonzero(odds >= 1)
            owner = np.searchsorted(starts + lengths, hits, "right")
            for doc in np.unique(owner).tolist():
                spans[doc] = spans_of(texts[doc], hits[owner == doc] - starts[doc])
        score = model.score(top, expected)
        return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(score), pa.array((score >= threshold).astype(np.int32)), pa.array(expected), pa.array(spans, arrow.field("spans").type)], schema=arrow)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not isinstance(model, Field):
            for batch in batches:
                n = batch.num_rows
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.full(n, model)), pa.array(np.full(n, int(model >= threshold), np.int32)), pa.array(np.zeros(n)), pa.array([[]] * n, arrow.field("spans").type)], schema=arrow)
            return
        words = Words(model)
        ids, texts, counts, numbers, held = [], [], [], [], 0
        for batch in batches:
            for doc, value in zip(batch.column(0).to_pylist(), batch.column(1)):
                text = value.as_py() or ""
                found = _WORD.findall(text)
                ids.append(doc)
                texts.append(text)
                counts.append(len(found))
                numbers.append(np.fromiter(map(words.__getitem__, found), np.int64, len(found)))
                held += len(found) + 16
                if held >= BLOCK_TOKENS:
                    yield block(ids, texts, counts, numbers, words)
                    ids, texts, counts, numbers, held = [], [], [], [], 0
                    if len(words) >= CACHE_WORDS:
                        words.clear_all()
        if ids:
            yield block(ids, texts, counts, numbers, words)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, SCORED)


def op13_toxicity(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    tagged = tag(docs, train(docs, table(spark, sf_dir, "labels")))
    return tagged.select("doc_id", held_out("doc_id", 5, 0).alias("held_out"), "score", "predicted", "n_toxic", "spans")
