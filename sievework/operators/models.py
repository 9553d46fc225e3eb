"""Training and scoring surface on pyspark.ml, and batch scoring slots for exported networks."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.constants import FEATURES, LABELS
from ..functions.features import with_features
from ..functions.urls import with_normalized
from .metrics import class_weights
from .sampling import group_folds, order_key


def assembled(df: DataFrame, columns: Sequence[str], y: str = "y", weights: int = 0) -> DataFrame:
    """Add features (a vector) and weight (balanced over so many classes, else 1)."""
    from pyspark.ml.feature import VectorAssembler

    out = VectorAssembler(inputCols=list(columns), outputCol="features").transform(df)
    if not weights:
        return out.withColumn("weight", F.lit(1.0))
    table = class_weights(df, weights, y).where("weight is not null").select(F.col("cls").alias(y), "weight")
    return out.join(F.broadcast(table), y)


class OneVersusRest:
    """Two-class models, one per class, whose probabilities of their class are scaled to sum to one."""

    def __init__(self, models: Sequence):
        self.models = models

    def transform(self, df: DataFrame) -> DataFrame:
        from pyspark.ml.functions import array_to_vector, vector_to_array

        for k, model in enumerate(self.models):
            df = model.setProbabilityCol(f"_p{k}").setRawPredictionCol(f"_r{k}").setPredictionCol(f"_c{k}").transform(df)
        own = F.array(*[F.get(vector_to_array(f"_p{k}"), F.lit(1)) for k in range(len(self.models))])
        df = df.withColumn("_own", own).withColumn("_sum", F.aggregate("_own", F.lit(0.0), lambda acc, x: acc + x))
        df = df.withColumn("_own", F.transform("_own", lambda x: x / F.col("_sum")))
        return df.withColumns({"probability": array_to_vector("_own"), "prediction": (F.array_position("_own", F.array_max("_own")) - 1).cast("double")})


def fit_trees(df: DataFrame, columns: Sequence[str], classes: int, y: str = "y", seed: int = 42, rounds: int = 20, without: Sequence[str] = ()):
    """Gradient-boosted trees with balanced weights: one model for two classes, one against the rest for each of more.

    without names columns to leave out (IP_FEATURES for the variant without them); predict takes the same columns.
    """
    from pyspark.ml.classification import GBTClassifier

    rows = assembled(df, [c for c in columns if c not in without], y, classes)
    fit = lambda frame, label: GBTClassifier(maxIter=rounds, seed=seed, featuresCol="features", labelCol=label, weightCol="weight").fit(frame)
    if classes == 2:
        return fit(rows, y)
    return OneVersusRest([fit(rows.withColumn("_is", (F.col(y) == k).cast("int")), "_is") for k in range(classes)])


def fit_logistic(df: DataFrame, columns: Sequence[str], y: str = "y"):
    """Multinomial logistic regression; the penalty falls with the number of rows."""
    from pyspark.ml.classification import LogisticRegression

    n = df.count()
    return LogisticRegression(family="multinomial", labelCol=y, regParam=1 / max(1, n), standardization=False, maxIter=100).fit(assembled(df, columns, y))


def predict(model, df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Add p (an array of probabilities) and predicted."""
    from pyspark.ml.functions import vector_to_array

    kept = df.columns
    out = model.transform(assembled(df, columns))
    return out.select(*kept, vector_to_array("probability").alias("p"), F.col("prediction").cast("int").alias("predicted"))


def out_of_fold(df: DataFrame, columns: Sequence[str], group: str, k: int = 5, y: str = "y", fit: Callable | None = None) -> DataFrame:
    """Probabilities of each row from a model that did not see its group; the loop is over k folds."""
    fit = fit or fit_logistic
    rows = df.join(group_folds(df, group, k), group)
    out = None
    for fold in range(k):
        part = predict(fit(rows.where(F.col("fold") != fold), columns, y), rows.where(F.col("fold") == fold), columns)
        out = part if out is None else out.unionByName(part)
    return out


def predict_url(spark: SparkSession, model, url: str, columns: Sequence[str] = FEATURES, names: Sequence[str] = LABELS) -> dict:
    """One URL's normal form, features, probabilities by class and likeliest class; an error where the URL is rejected."""
    rows = with_features(with_normalized(spark.createDataFrame([(url,)], "url string")).where("normalized_url is not null"))
    found = predict(model, rows, columns).first()
    if found is None:
        raise ValueError("the URL is rejected")
    return {
        "resultType": "Model prediction", "normalizedUrl": found["normalized_url"], "registrableDomain": found["registrable_domain"], "features": {f: found[f] for f in FEATURES},
        "probabilities": dict(zip(names, found["p"])), "predictedClass": names[found["predicted"]],
    }


class Network:
    """A dense trunk with GELU and softmax heads, run by numpy on batches; weights are plain arrays."""

    def __init__(self, layers: Sequence[tuple[np.ndarray, np.ndarray]], heads: dict[str, tuple[np.ndarray, np.ndarray]]):
        self.layers, self.heads = layers, heads

    @staticmethod
    def random(widths: Sequence[int] = (62, 128, 128, 64), heads: dict[str, int] | None = None, seed: int = 42) -> Network:
        rng = np.random.default_rng(seed)
        make = lambda a, b: (rng.normal(0, a**-0.5, (a, b)), np.zeros(b))
        heads = heads or {"risk": 3, "action": 3, "threat": 4}
        return Network([make(a, b) for a, b in zip(widths, widths[1:])], {n: make(widths[-1], k) for n, k in heads.items()})

    def run(self, x: np.ndarray) -> dict[str, np.ndarray]:
        for w, b in self.layers:
            x = x @ w + b
            x = 0.5 * x * (1 + np.tanh(0.7978845608028654 * (x + 0.044715 * x**3)))
        out = {}
        for name, (w, b) in self.heads.items():
            z = x @ w + b
            z = np.exp(z - z.max(1, keepdims=True))
            out[name] = z / z.sum(1, keepdims=True)
        return out


    def arrays(self) -> list[np.ndarray]:
        return [a for pair in (*self.layers, *self.heads.values()) for a in pair]

    def moved(self, flat: np.ndarray) -> Network:
        """The same shapes with other values, given one after the other."""
        cuts = np.cumsum([a.size for a in self.arrays()])[:-1]
        made = [v.reshape(a.shape) for v, a in zip(np.split(flat, cuts), self.arrays())]
        pairs = list(zip(made[::2], made[1::2]))
        return Network(pairs[: len(self.layers)], dict(zip(self.heads, pairs[len(self.layers) :])))

    def gradient(self, x: np.ndarray, targets: dict[str, np.ndarray], weights: dict[str, np.ndarray]) -> tuple[float, np.ndarray]:
        """(loss, its gradient, flat): cross entropies of all heads, summed over rows; a target below 0 does not count."""
        inputs, slopes = [x], []
        for w, b in self.layers:
            z = inputs[-1] @ w + b
            t = np.tanh(0.7978845608028654 * (z + 0.044715 * z**3))
            slopes.append(0.5 * (1 + t) + 0.5 * z * (1 - t * t) * 0.7978845608028654 * (1 + 3 * 0.044715 * z * z))
            inputs.append(0.5 * z * (1 + t))
        loss, back, heads = 0.0, np.zeros_like(inputs[-1]), []
        for name, (w, b) in self.heads.items():
            z = inputs[-1] @ w + b
            z = z - z.max(1, keepdims=True)
            p = np.exp(z) / np.exp(z).sum(1, keepdims=True)
            y = np.maximum(targets[name], 0)
            scale = weights[name][y] * (targets[name] >= 0)
            rows = np.arange(len(x))
            loss -= float((scale * np.log(np.maximum(p[rows, y], 1e-300))).sum())
            p[rows, y] -= 1
            p *= scale[:, None]
            heads += [inputs[-1].T @ p, p.sum(0)]
            back += p @ w.T
        layers: list[np.ndarray] = []
        for (w, _), slope, below in zip(reversed(self.layers), reversed(slopes), reversed(inputs[:-1])):
            back = back * slope
            layers = [below.T @ back, back.sum(0), *layers]
            back = back @ w.T
        return loss, np.concatenate([a.ravel() for a in (*layers, *heads)])


def _summed_gradient(rows: DataFrame, network: Network, weights: dict[str, np.ndarray], encoded: str) -> tuple[float, np.ndarray]:
    """Loss and gradient over all rows: summed within tasks, then by slot in a shuffle; the network's size comes back."""
    size, names = sum(a.size for a in network.arrays()), list(network.heads)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(size + 1)
        for batch in batches:
            if len(batch):
                loss, found = network.gradient(np.stack(batch[encoded].to_numpy()), {n: batch[n].fillna(-1).to_numpy(int) for n in names}, weights)
                total += np.append(found, loss)
        yield pd.DataFrame({"slot": np.arange(size + 1, dtype=np.int32), "value": total})

    out = np.zeros(size + 1)
    for r in rows.select(encoded, *names).mapInPandas(run, "slot int, value double").groupBy("slot").agg(F.sum("value").alias("value")).collect():
        out[r.slot] = r["value"]
    return out[-1], out[:-1]


def fit_network(train: DataFrame, validation: DataFrame, start: Network, epochs: int = 50, rate: float = 0.01, decay: float = 1e-4, patience: int = 8, encoded: str = "encoded") -> tuple[Network, list[float]]:
    """Train a network's heads on columns of their names (class numbers, null where unknown), with balanced weights.

    An epoch is one step of Adam on the gradient over all rows, which tasks sum, under a cosine schedule; the network of
    lowest validation loss is kept, and training ends when it has not fallen for patience epochs. Returns the network
    and the validation losses. There is no dropout, and steps are whole passes, not small batches.
    """
    weights, counts = {}, {}
    for name, (_, b) in start.heads.items():
        found = {r[name]: r["count"] for r in train.where(F.col(name).isNotNull()).groupBy(name).count().collect()}
        counts[name] = max(1, sum(found.values()))
        weights[name] = np.array([counts[name] / (len(b) * max(1, found.get(k, 0))) for k in range(len(b))])
    share = {n: w / counts[n] for n, w in weights.items()}
    flat = np.concatenate([a.ravel() for a in start.arrays()]).astype(float)
    first, second = np.zeros_like(flat), np.zeros_like(flat)
    best, kept, losses = np.inf, start, []
    for epoch in range(epochs):
        _, slope = _summed_gradient(train, start.moved(flat), share, encoded)
        first, second = 0.9 * first + 0.1 * slope, 0.999 * second + 0.001 * slope * slope
        step = (first / (1 - 0.9 ** (epoch + 1))) / (np.sqrt(second / (1 - 0.999 ** (epoch + 1))) + 1e-8)
        now = rate * 0.5 * (1 + np.cos(np.pi * epoch / epochs))
        flat = flat - now * (step + decay * flat)
        losses.append(_summed_gradient(validation, start.moved(flat), share, encoded)[0])
        if losses[-1] < best:
            best, kept = losses[-1], start.moved(flat)
        elif epoch - int(np.argmin(losses)) >= patience:
            break
    return kept, losses


def score_network(df: DataFrame, network: Network, encoded: str = "encoded") -> DataFrame:
    """Add one probability array per head, in Arrow batches."""
    heads = ", ".join(f"{n}: array<double>" for n in network.heads)

    @F.pandas_udf(f"struct<{heads}>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = network.run(np.stack(batch.to_numpy())) if len(batch) else {n: np.zeros((0, 1)) for n in network.heads}
            yield pd.DataFrame({n: list(v) for n, v in found.items()})

    return df.withColumn("_heads", run(encoded)).select(*df.columns, *[F.col(f"_heads.{n}").alias(n) for n in network.heads])


def score_onnx(df: DataFrame, model_file: str, column: str, out: str = "p") -> DataFrame:
    """Softmax of an exported network's logits over an array column; each task opens the model once."""

    @F.pandas_udf("array<double>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        import onnxruntime

        session = onnxruntime.InferenceSession(model_file, providers=["CPUExecutionProvider"])
        name = session.get_inputs()[0].name
        for batch in batches:
            logits = session.run(None, {name: np.stack(batch.to_numpy()).astype(np.float32)})[0].astype(np.float64)
            z = np.exp(logits - logits.max(1, keepdims=True))
            yield pd.Series(list(z / z.sum(1, keepdims=True)))

    return df.withColumn(out, run(column))


def ablate(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """Zero a set of decision features and their masks."""
    return df.withColumns({f"feature__{n}": F.lit(0.0) for n in names} | {f"available__{n}": F.lit(False) for n in names})


def permutation_importance(df: DataFrame, columns: Sequence[str], score: Callable[[DataFrame], DataFrame], key: str, seed: int = 42, top: int = 10) -> DataFrame:
    """(feature, change_rate): how often a prediction changes when a feature's values are dealt anew by hash.

    A value moves to the row of the same rank within its hash bucket under another hash, so the pairing is a join
    on (bucket, rank) and no task sees all rows.
    """
    from pyspark.sql import Window

    base = score(df).select(key, F.col("predicted").alias("_before"))
    out = None
    for k, name in enumerate(columns):
        buckets = F.conv(F.substring(order_key(seed + k, F.col(key)), 1, 2), 16, 10).cast("int")
        rows = df.withColumn("_b", buckets)
        rank = lambda s: F.row_number().over(Window.partitionBy("_b").orderBy(order_key(s, F.col(key)), key))
        left = rows.withColumn("_r", rank(seed + 1000 + k)).drop(name)
        right = rows.select("_b", name, rank(seed + 2000 + k).alias("_r"))
        moved = score(left.join(right, ["_b", "_r"]).drop("_b", "_r"))
        rate = moved.select(key, "predicted").join(base, key).agg(F.lit(name).alias("feature"), F.avg((F.col("predicted") != F.col("_before")).cast("double")).alias("change_rate"))
        out = rate if out is None else out.unionByName(rate)
    return out.orderBy(F.col("change_rate").desc(), "feature").limit(top)


class ByteBpe:
    """Byte-level BPE of lower-case text between [CLS] and [SEP], cut and padded to a length."""

    def __init__(self, vocab: dict[str, int], merges: Sequence[tuple[str, str]], length: int = 32, special: Sequence[str] = ("[CLS]", "[SEP]", "[PAD]")):
        self.vocab, self.rank, self.length = vocab, {m: k for k, m in enumerate(merges)}, length
        self.cls, self.sep, self.pad = (vocab[s] for s in special)
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
        hidden = (b for b in range(256) if b not in shown)
        self.byte = {b: chr(b) for b in shown} | {b: chr(256 + k) for k, b in enumerate(hidden)}
        self.cache: dict[str, list[int]] = {}

    def word(self, text: str) -> list[int]:
        if text not in self.cache:
            parts = [self.byte[b] for b in text.encode("utf-8")]
            while len(parts) > 1:
                best = min(zip(parts, parts[1:]), key=lambda p: self.rank.get(p, len(self.rank)))
                if best not in self.rank:
                    break
                merged, i = [], 0
                while i < len(parts):
                    two = i + 1 < len(parts) and (parts[i], parts[i + 1]) == best
                    merged.append(parts[i] + parts[i + 1] if two else parts[i])
                    i += 2 if two else 1
                parts = merged
            self.cache[text] = [self.vocab[p] for p in parts if p in self.vocab]
        return self.cache[text]

    def encode(self, text: str) -> tuple[list[int], list[int]]:
        import unicodedata

        import regex

        words = regex.findall(r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+", unicodedata.normalize("NFC", text.lower()))
        ids = [self.cls, *[i for w in words for i in self.word(w)][: self.length - 2], self.sep]
        return ids + [self.pad] * (self.length - len(ids)), [1] * len(ids) + [0] * (self.length - len(ids))


def tokenize(df: DataFrame, tokenizer: ByteBpe, column: str) -> DataFrame:
    """Add token_ids and attention_mask."""

    @F.pandas_udf("struct<token_ids: array<int>, attention_mask: array<int>>")
    def run(values: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([tokenizer.encode(v or "") for v in values], columns=["token_ids", "attention_mask"])

    return df.withColumn("_t", run(column)).select(*df.columns, "_t.token_ids", "_t.attention_mask")


def final_action(action_probabilities: Column, known_malicious: Column) -> Column:
    """BLOCK under the guardrail, else the likeliest action."""
    names = F.array(F.lit("ALLOW"), F.lit("REVIEW"), F.lit("BLOCK"))
    likeliest = F.get(names, F.array_position(action_probabilities, F.array_max(action_probabilities)).cast("int") - 1)
    return F.when(known_malicious, "BLOCK").otherwise(likeliest)
