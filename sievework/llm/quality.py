"""Quality classifier: regularised quadratic discriminant over transformed document statistics.

Every whole text becomes a vector of statistics. Class means and covariances come from sums over all labelled
training rows; each covariance is shrunk towards its diagonal and its Cholesky factor is computed once and kept.
A document's score is the logistic of the difference of the two Mahalanobis log-densities plus the log prior odds.

Defined results: null and empty texts have the statistics of an empty document and get a score like any other;
repeated rows score alike; a null id is never a training row but is scored; an empty table gives no rows; without
training rows of both classes every score is the share of class 1 (0.5 without labels). Ids whose labels disagree
are left out of training; labels other than 0 and 1 and null labels too. Only the named columns are read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from .common import materialize, table

FEATURES = ("log_words", "word_length", "upper", "symbols", "marks", "bars", "digits", "repeats", "distinct", "lines")
THRESHOLD = 0.7
SHRINKAGE = 0.1
#: Rates are computed as if so many words with usual values came on top, so that short texts do not stand out.
PRIOR_WORDS = 20

_UPPER = bytes(range(65, 91))
_LETTER = _UPPER + bytes(range(97, 123))
_DIGIT = b"0123456789"
_SYMBOL = b"#$%&*+/<=>@[\\]^_`{}~"
_WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def statistics(text: str | None) -> list[float]:
    """The transformed statistics of one whole text; rates are smoothed and compressed by square roots."""
    raw = (text or "").encode("utf-8", "replace")
    words = _WORD.findall(raw)
    n, size = len(words), len(raw)
    count = lambda chars: size - len(raw.translate(None, chars))
    letters, upper = count(_LETTER), count(_UPPER)
    filled = sum(map(len, words))
    rate = lambda found, of, usual: ((found + PRIOR_WORDS * usual) / (of + PRIOR_WORDS)) ** 0.5
    return [
        float(np.log1p(n)),
        rate(filled, n, 5.5),
        rate(upper, letters, 0.03),
        rate(count(_SYMBOL), size, 0.0),
        rate(raw.count(b"!") + raw.count(b"?"), n, 0.0),
        rate(raw.count(b"|"), n, 0.0),
        rate(count(_DIGIT), size, 0.0),
        rate(sum(map(eq, words, words[1:])), n, 0.01),
        float(np.log1p(len(set(words)) + PRIOR_WORDS) - np.log1p(n + PRIOR_WORDS)),
        rate(raw.count(b"\n"), n, 0.02),
    ]


def statistics_of(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, statistics) of all rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [statistics(t.as_py()) for t in batch.column(1)]
            values = np.array(rows, np.float64).reshape(len(rows), len(FEATURES))
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(values[:, k]) for k in range(len(FEATURES)))], ["doc_id", *FEATURES])

    schema = "doc_id long, " + ", ".join(f"{f} double" for f in FEATURES)
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, schema)


def held_out(id_col: str, modulus: int, remainder: int):
    """Whether crc32 of the id as text leaves the remainder; false for a null id."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % modulus == remainder, F.lit(False))


@dataclass(frozen=True)
class Gaussian:
    mean: np.ndarray
    factor: np.ndarray  # lower Cholesky factor of the shrunk covariance
    log_det: float
    log_prior: float

    def log_density(self, x: np.ndarray) -> np.ndarray:
        z = np.linalg.solve(self.factor, (x - self.mean).T)
        return self.log_prior - 0.5 * ((z * z).sum(0) + self.log_det)


@dataclass(frozen=True)
class Discriminant:
    """The fitted model; classes is None where the training rows do not hold both classes."""

    classes: tuple[Gaussian, Gaussian] | None
    share: float

    def scores(self, x: np.ndarray) -> np.ndarray:
        if self.classes is None:
            return np.full(len(x), self.share)
        low, high = (c.log_density(x) for c in self.classes)
        return 1 / (1 + np.exp(np.clip(low - high, -500, 500)))


def fit(rows: DataFrame, shrinkage: float = SHRINKAGE) -> Discriminant:
    """Fit from (quality, statistics) rows by one aggregation; what comes back is two rows of fixed width."""
    d = len(FEATURES)
    pairs = [(i, j) for i in range(d) for j in range(i + 1)]
    sums = [F.sum(f).alias(f"s{i}") for i, f in enumerate(FEATURES)]
    sums += [F.sum(F.col(FEATURES[i]) * F.col(FEATURES[j])).alias(f"p{i}_{j}") for i, j in pairs]
    found = {r.quality: r for r in rows.groupBy("quality").agg(F.count(F.lit(1)).alias("n"), *sums).collect()}
    n = {k: found[k].n if k in found else 0 for k in (0, 1)}
    if not n[0] or not n[1]:
        return Discriminant(None, 0.5 if not sum(n.values()) else n[1] / sum(n.values()))
    classes = []
    for k in (0, 1):
        row = found[k]
        mean = np.array([row[f"s{i}"] for i in range(d)]) / n[k]
        second = np.zeros((d, d))
        for i, j in pairs:
            second[i, j] = second[j, i] = row[f"p{i}_{j}"] / n[k]
        cov = second - np.outer(mean, mean)
        diagonal = np.diag(np.maximum(np.diag(cov), 1e-4))
        factor = np.linalg.cholesky((1 - shrinkage) * cov + shrinkage * diagonal + 1e-6 * np.eye(d))
        classes.append(Gaussian(mean, factor, 2 * float(np.log(np.diag(factor)).sum()), float(np.log(n[k] / sum(n.values())))))
    return Discriminant((classes[0], classes[1]), n[1] / sum(n.values()))


def train(stats: DataFrame, labels: DataFrame, modulus: int = 4, remainder: int = 2) -> Discriminant:
    """Learn from the statistics of labelled rows outside the held-out remainder."""
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality")).where("quality in (0, 1)")
    known = known.groupBy("doc_id").agg(F.min("quality").alias("quality"), F.max("quality").alias("top_")).where("quality = top_").drop("top_")
    known = known.where(~held_out("doc_id", modulus, remainder))
    return fit(stats.join(known, "doc_id"))


def classify(stats: DataFrame, model: Discriminant, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, score and predicted of every row of statistics_of."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.column_stack([batch.column(1 + k).to_numpy(zero_copy_only=False) for k in range(len(FEATURES))])
            score = model.scores(x)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(score), pa.array((score >= threshold).astype(np.int32))], ["doc_id", "score", "predicted"])

    return stats.mapInArrow(run, "doc_id long, score double, predicted int")


def beside_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """row_ (all columns of docs), doc_id and the statistics of every row; written, they serve training and filtering."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = np.array([statistics(t.as_py()) for t in batch.column(2)], np.float64).reshape(batch.num_rows, len(FEATURES))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array(values[:, k]) for k in range(len(FEATURES)))], ["row_", "doc_id", *FEATURES])

    rows = docs.select(F.struct("*").alias("row_"), F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    schema = StructType([*rows.schema.fields[:2], *(StructField(f, DoubleType()) for f in FEATURES)])
    return rows.mapInArrow(run, schema)


def keep_good(docs: DataFrame, model: Discriminant, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs whose whole text scores at least the threshold, with all their columns."""
    return keep_scored(beside_rows(docs), model, threshold)


def keep_scored(beside: DataFrame, model: Discriminant, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of beside_rows that score at least the threshold, with all their columns."""
    wanted = beside.select("row_", *FEATURES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.column_stack([batch.column(1 + k).to_numpy(zero_copy_only=False) for k in range(len(FEATURES))])
            yield batch.select([0]).filter(pa.array(model.scores(x) >= threshold))

    return wanted.mapInArrow(run, StructType(wanted.schema.fields[:1])).select("row_.*")


def op5_quality_classifier(spark, sf_dir: str) -> DataFrame:
    stats = materialize(statistics_of(table(spark, sf_dir, "documents")), "statistics")
    model = train(stats, table(spark, sf_dir, "labels"))
    return classify(stats, model).select("doc_id", held_out("doc_id", 4, 2).alias("held_out"), "score", "predicted")
