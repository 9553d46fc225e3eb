"""Language identification by hierarchical discrimination.

Whole texts become hashed byte n-gram profiles (lengths 1 to 3, letters only, lower case, square-rooted
frequencies of unit length). Linear support vector machines first choose the language family; one-versus-one
machines inside that family then separate its languages by votes, and summed margins break ties. The machines are
fitted on the driver from a bounded sample: at most SAMPLE_PER_LANGUAGE rows of each language and SAMPLE_ROWS
rows in all, those with the smallest hashes of id and text. Prediction covers all rows and whole texts.

Defined results: a null text or one without a letter (Unicode's L, for training and prediction alike) gets `und` and
score 0; without training rows everything is `und`; with one learned language every text with a letter gets it with
score 0.5; rows with a null language or null id are not learned from; rows that repeat id and text count once in the
sample; repeated rows are predicted alike; an empty table gives no rows. Only the named columns are read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize, table
from .quality import held_out

DIMENSIONS = 4096
SAMPLE_PER_LANGUAGE = 600
SAMPLE_ROWS = 6000
UNDETERMINED = "und"
#: Of texts of a language left out of training about 3 % reach it; under 1 % of whole texts of learned ones do not.
MIN_SCORE = 0.7

#: Families of related languages; a language that is not listed is a family of its own.
FAMILIES = {
    "germanic": ("en", "de", "nl", "sv", "da", "no", "is", "af"),
    "romance": ("fr", "es", "it", "pt", "ro", "ca", "gl"),
    "slavic": ("ru", "uk", "pl", "cs", "sk", "bg", "sr", "hr", "sl"),
    "uralic": ("fi", "et", "hu"),
}
_FAMILY = {lang: family for family, langs in FAMILIES.items() for lang in langs}
_TO_SPACE = np.array([b if b >= 128 or 97 <= b <= 122 else 32 for b in range(256)], np.uint32)


def family_of(lang: str) -> str:
    return _FAMILY.get(lang, lang)


def profile(text: str) -> np.ndarray:
    """The hashed n-gram profile of a whole text."""
    codes = _TO_SPACE[np.frombuffer(f" {text.lower()} ".encode("utf-8", "replace"), np.uint8)]
    keep = np.ones(len(codes), bool)
    keep[1:] = (codes[1:] != 32) | (codes[:-1] != 32)
    codes = codes[keep]
    two = codes[:-1] << np.uint32(8) | codes[1:]
    three = two[:-1] << np.uint32(8) | codes[2:]
    grams = np.concatenate([codes, two | np.uint32(1 << 24), three | np.uint32(2 << 24)])
    counts = np.bincount((grams * np.uint32(2654435761)) >> np.uint32(20), minlength=DIMENSIONS)
    vector = np.sqrt(counts.astype(np.float32))
    return vector / np.float32(np.linalg.norm(vector))


def train_svm(x: np.ndarray, y: np.ndarray, cost: float = 1.0, epochs: int = 12) -> np.ndarray:
    """Linear support vector machine (squared hinge) by dual coordinate descent; y is +1 or -1, the bias comes last."""
    x = np.hstack([x, np.ones((len(x), 1), np.float32)])
    w, alpha = np.zeros(x.shape[1], np.float32), np.zeros(len(x))
    weight = np.where(y > 0, len(y) / (2 * max(1, (y > 0).sum())), len(y) / (2 * max(1, (y < 0).sum())))
    soft = 1 / (2 * cost * weight)
    q = (x * x).sum(1) + soft
    rng = np.random.default_rng(0)
    for _ in range(epochs):
        for i in rng.permutation(len(x)):
            g = y[i] * float(w @ x[i]) - 1 + soft[i] * alpha[i]
            new = max(0.0, alpha[i] - g / q[i])
            if new != alpha[i]:
                w += np.float32((new - alpha[i]) * y[i]) * x[i]
                alpha[i] = new
    return w


@dataclass(frozen=True)
class Machines:
    """One-versus-one machines between names: pairs[k] = (i, j), weights[:, k] decides for i where positive."""

    names: tuple[str, ...]
    pairs: tuple[tuple[int, int], ...]
    weights: np.ndarray

    @staticmethod
    def fit(x: np.ndarray, labels: np.ndarray) -> Machines:
        names = tuple(sorted(set(labels.tolist())))
        pairs = tuple(combinations(range(len(names)), 2))
        weights = []
        for i, j in pairs:
            mine = (labels == names[i]) | (labels == names[j])
            weights.append(train_svm(x[mine], np.where(labels[mine] == names[i], 1.0, -1.0)))
        return Machines(names, pairs, np.array(weights, np.float32).T.reshape(x.shape[1] + 1, len(pairs)))

    def choose(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The index of the name with most votes, and a confidence: the logistic of its smallest margin."""
        n = len(x)
        if not self.pairs:
            return np.zeros(n, int), np.full(n, 1.0)
        margins = x @ self.weights[:-1] + self.weights[-1]
        votes, total = np.zeros((n, len(self.names))), np.zeros((n, len(self.names)))
        least = np.full((n, len(self.names)), np.inf)
        for k, (i, j) in enumerate(self.pairs):
            m = margins[:, k]
            votes[:, i] += m > 0
            votes[:, j] += m <= 0
            total[:, i] += m
            total[:, j] -= m
            least[:, i] = np.minimum(least[:, i], m)
            least[:, j] = np.minimum(least[:, j], -m)
        best = np.argmax(votes + 1e-3 * np.tanh(total), axis=1)
        return best, 1 / (1 + np.exp(-4 * least[np.arange(n), best]))


@dataclass(frozen=True)
class Model:
    families: Machines | None
    within: dict[str, Machines]

    def predict(self, x: np.ndarray) -> tuple[list[str], np.ndarray]:
        if self.families is None:
            return [UNDETERMINED] * len(x), np.zeros(len(x))
        family, sure = self.families.choose(x)
        out = np.empty(len(x), object)
        for k, name in enumerate(self.families.names):
            mine = family == k
            if mine.any():
                chosen, more = self.within[name].choose(x[mine])
                out[mine] = np.array(self.within[name].names, object)[chosen]
                sure[mine] *= more
        if sum(len(m.names) for m in self.within.values()) == 1:
            sure = np.full(len(x), 0.5)
        return out.tolist(), sure


def has_letter(text: Column) -> Column:
    """Whether a text has a letter; false for null."""
    return F.coalesce(text.rlike(r"\p{L}"), F.lit(False))


def predict_texts(model: Model, texts: pa.Array, size: int = 128) -> tuple[list[str], np.ndarray]:
    """Predictions for a column of whole texts (null for those without a letter), in small blocks that bound the matrix."""
    langs, scores = [UNDETERMINED] * len(texts), np.zeros(len(texts))
    for a in range(0, len(texts), size):
        block = [(a + k, t.as_py()) for k, t in enumerate(texts[a : a + size])]
        block = [(i, t) for i, t in block if t is not None]
        if block:
            found, sure = model.predict(np.array([profile(t) for _, t in block]))
            for (i, _), lang, s in zip(block, found, sure):
                langs[i], scores[i] = lang, s
    return langs, scores


def sample(rows: DataFrame, per_language: int, total: int) -> DataFrame:
    """At most per_language rows of each language, total in all: those with the smallest hashes of id and text.

    A hash's level is the number of its leading zero bits. Rows are counted by language and level first, which is an
    aggregate of at most 64 rows a language, merged in map tasks; then only rows of a level that few rows reach are
    looked at, so no task ranks a language's rows however many there are.
    """
    hashed = rows.withColumn("h_", F.xxhash64(F.col("doc_id").cast("string"), "text").bitwiseAND(F.lit((1 << 63) - 1)))
    level = F.lit(63) - F.length(F.bin("h_"))
    reached: dict[str, list[int]] = {}
    for r in hashed.groupBy("lang", level.alias("level")).agg(F.approx_count_distinct("h_").alias("n")).collect():
        reached.setdefault(r.lang, [0] * 64)[r.level] = r.n
    if not reached:
        return rows.limit(0)
    each = max(1, min(per_language, total // len(reached)))
    # Counts are approximate, so the level is one that twice as many rows reach.
    floors = {lang: max((k for k in range(64) if sum(n[k:]) >= 2 * each), default=0) for lang, n in reached.items()}
    near = F.coalesce(*[F.when(F.col("lang") == lang, level >= k) for lang, k in floors.items()], F.lit(False))
    found = hashed.where(near).groupBy("lang", "h_").agg(F.min(F.struct("doc_id", "text")).alias("row_"))
    found = materialize(found.select("row_.*", "lang", "h_"), "sample")
    hashes: dict[str, list[int]] = {}
    for r in found.select("lang", "h_").collect():
        hashes.setdefault(r.lang, []).append(r.h_)
    tops = {lang: sorted(h)[:each][-1] for lang, h in hashes.items()}
    near = F.coalesce(*[F.when(F.col("lang") == lang, F.col("h_") <= top) for lang, top in tops.items()], F.lit(False))
    return found.where(near).drop("h_")


def train(docs: DataFrame, modulus: int = 5, remainder: int = 0, per_language: int = SAMPLE_PER_LANGUAGE, total: int = SAMPLE_ROWS) -> Model:
    """Fit on labelled rows outside the held-out remainder."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    rows = rows.where(F.col("doc_id").isNotNull() & F.col("lang").isNotNull() & ~held_out("doc_id", modulus, remainder))
    rows = rows.where(has_letter(F.col("text")))

    def profiles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [profile(t.as_py()).tobytes() for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(made, pa.binary()), batch.column(2)], ["doc_id", "profile", "lang"])

    found = sample(rows, per_language, total).mapInArrow(profiles, "doc_id long, profile binary, lang string").toArrow()
    found = found.sort_by([("lang", "ascending"), ("doc_id", "ascending"), ("profile", "ascending")])
    if not len(found):
        return Model(None, {})
    x = np.array([np.frombuffer(p, np.float32) for p in found.column("profile").to_pylist()])
    langs = np.array(found.column("lang").to_pylist(), object)
    groups = np.array([family_of(lang) for lang in langs], object)
    return Model(Machines.fit(x, groups), {g: Machines.fit(x[groups == g], langs[groups == g]) for g in set(groups.tolist())})


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, lang_pred and score of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs, scores = predict_texts(model, batch.column(1))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(langs, pa.string()), pa.array(scores, pa.float64())], ["doc_id", "lang_pred", "score"])

    text = F.col("text").cast("string")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.when(has_letter(text), text).alias("text"))
    return rows.mapInArrow(run, "doc_id long, lang_pred string, score double")


def keep_identified(docs: DataFrame, model: Model, min_score: float = MIN_SCORE) -> DataFrame:
    """The rows of docs whose language is determined with at least min_score, with all their columns.

    With one learned language there is no margin to score by, so every text with a letter stays.
    """
    if sum(len(m.names) for m in model.within.values()) == 1:
        min_score = 0.0
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs, scores = predict_texts(model, batch.column(at))
            yield batch.filter(pa.array([lang != UNDETERMINED and s >= min_score for lang, s in zip(langs, scores)], pa.bool_()))

    return docs.where(has_letter(F.col("text"))).mapInArrow(run, docs.schema)


def op9_language_id(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = identify(docs, train(docs))
    return found.select("doc_id", held_out("doc_id", 5, 0).alias("held_out"), "lang_pred", "score")
