"""Calibration of probability arrays: temperature, losses, reliability, thresholds."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.constants import ECE_BINS, EPSILON, TEMPERATURES
from .metrics import argmax, ratio


def clip(p: Column) -> Column:
    return F.least(F.greatest(p, F.lit(EPSILON)), F.lit(1.0))


def apply_temperature(p: Column, t: Column | float) -> Column:
    """softmax(log(p) / t), shifted by the largest logit."""
    if isinstance(t, (int, float)):
        if t <= 0:
            raise ValueError("a temperature must be positive")
        t = F.lit(float(t))
    logits = F.transform(p, lambda x: F.log(clip(x)) / t)
    powers = F.transform(logits, lambda x: F.exp(x - F.array_max(logits)))
    total = F.aggregate(powers, F.lit(0.0), lambda a, x: a + x)
    return F.transform(powers, lambda x: x / total)


def nll(p: Column, y: Column) -> Column:
    return -F.log(clip(F.get(p, y)))


def brier(p: Column, y: Column) -> Column:
    return F.aggregate(F.transform(p, lambda x, i: F.pow(x - (i == y).cast("double"), F.lit(2.0))), F.lit(0.0), lambda a, x: a + x)


def losses(df: DataFrame, p: str = "p", y: str = "y") -> DataFrame:
    return df.agg(F.avg(nll(F.col(p), F.col(y))).alias("nll"), F.avg(brier(F.col(p), F.col(y))).alias("brier"))


def fit_temperature(df: DataFrame, p: str = "p", y: str = "y", grid: Sequence[float] = TEMPERATURES) -> DataFrame:
    """(temperature, nll) of lowest loss, the lower of equal temperatures.

    Tasks add up losses of all temperatures batch by batch and hand on one row each, so rows are not multiplied by the
    grid. Rows without probabilities or with a label outside them count for none.
    """
    temperatures = [float(t) for t in grid]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, n = np.zeros(len(temperatures)), 0
        for batch in batches:
            if not batch.num_rows:
                continue
            starts = np.append(0, np.cumsum(batch.column(0).value_lengths().to_numpy(zero_copy_only=False)))[:-1]
            below, own = batch.column(0).flatten().to_numpy(zero_copy_only=False), batch.column(1).to_numpy(zero_copy_only=False)
            n += batch.num_rows
            sums += [(np.log(np.add.reduceat(np.exp(below / t), starts)) - own / t).sum() for t in temperatures]
        yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64()), pa.array([sums], pa.list_(pa.float64()))], ["n", "sums"])

    logs = F.transform(p, lambda x: F.log(clip(x)))
    rows = df.select(logs.alias("l"), F.get(logs, F.col(y)).alias("own"), F.array_max(logs).alias("top")).where("own is not null")
    parts = rows.select(F.transform("l", lambda x: x - F.col("top")).alias("l"), (F.col("own") - F.col("top")).alias("own")).mapInArrow(run, "n long, sums array<double>")
    whole = parts.select("n", F.posexplode("sums").alias("k", "s")).groupBy("k").agg(F.round(F.sum("s") / F.sum("n"), 12).alias("nll"))
    of = F.array(*map(F.lit, temperatures))
    return whole.agg(F.min(F.struct("nll", F.get(of, F.col("k")).alias("temperature"))).alias("b")).select("b.temperature", "b.nll")


def edges(bins: int = ECE_BINS) -> list[float]:
    return [k / bins for k in range(bins + 1)]


def bin_of(confidence: Column, bins: int = ECE_BINS) -> Column:
    """The bin (lo, hi] of a confidence by comparison with the edges; the first bin takes its lower edge too."""
    return sum(((confidence > e).cast("int") for e in edges(bins)[1:-1]), F.lit(0))


def reliability(df: DataFrame, p: str = "p", y: str = "y", bins: int = ECE_BINS) -> DataFrame:
    """(bin, low, high, n, confidence, accuracy) of every bin; empty bins have no means."""
    rows = df.select(F.array_max(p).alias("c"), (argmax(F.col(p)) == F.col(y)).cast("double").alias("hit"))
    found = rows.groupBy(bin_of(F.col("c"), bins).alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.avg("c").alias("confidence"), F.avg("hit").alias("accuracy"))
    all_ = df.sparkSession.createDataFrame([(k, lo, hi) for k, (lo, hi) in enumerate(zip(edges(bins), edges(bins)[1:]))], "bin int, low double, high double")
    return F.broadcast(all_).join(found, "bin", "right").unionByName(all_.join(found, "bin", "left_anti"), allowMissingColumns=True).fillna(0, ["n"])


def ece(df: DataFrame, p: str = "p", y: str = "y", bins: int = ECE_BINS) -> DataFrame:
    table = reliability(df, p, y, bins)
    total = F.sum("n")
    return table.agg((F.sum(F.when(F.col("n") > 0, F.col("n") * F.abs(F.col("accuracy") - F.col("confidence"))).otherwise(0.0)) / total).alias("ece"))


def threshold_table(df: DataFrame, score: Column, positive: Column, thresholds: Sequence[float]) -> DataFrame:
    """Counts and ratios at each threshold (score >= threshold flags a row), from one pass over the rows."""
    if not thresholds:
        raise ValueError("no thresholds")
    at = sorted(thresholds)
    level = sum(((score >= t).cast("int") for t in at), F.lit(0))
    cells = df.select(level.alias("level"), positive.alias("pos")).groupBy("level").agg(F.count_if("pos").alias("p"), F.count_if(~F.col("pos")).alias("q"))
    grid = df.sparkSession.createDataFrame([(k + 1, float(t)) for k, t in enumerate(at)], "need int, threshold double")
    total = lambda test, c: F.coalesce(F.sum(F.when(test, F.col(c))), F.lit(0)).cast("long")
    over = F.col("level") >= F.col("need")
    sums = cells.crossJoin(F.broadcast(grid)).groupBy("threshold").agg(total(over, "p").alias("tp"), total(over, "q").alias("fp"), total(~over, "p").alias("fn"), total(~over, "q").alias("tn"))
    tp, fp, fn, tn = (F.col(k) for k in ("tp", "fp", "fn", "tn"))
    return sums.select(
        "threshold", "tp", "fp", "fn", "tn", ratio(tp, tp + fn).alias("tpr"), ratio(fp, fp + tn).alias("fpr"), ratio(fn, tp + fn).alias("fnr"),
        ratio(tp, tp + fp).alias("precision"), ratio(tp, tp + fn).alias("recall"), ratio(tp + fp, tp + fp + fn + tn).alias("flagged_share"),
    )


def summary(df: DataFrame, p: str = "p", y: str = "y", bins: int = ECE_BINS) -> DataFrame:
    """One row: nll, brier and ece."""
    return losses(df, p, y).crossJoin(ece(df, p, y, bins))


def calibrate(validation: DataFrame, test: DataFrame, p: str = "p", y: str = "y") -> DataFrame:
    """Fit the temperature on validation rows and apply it to the test once: (stage, temperature, nll, brier, ece)."""
    fitted = fit_temperature(validation, p, y)
    scaled = test.crossJoin(F.broadcast(fitted.select("temperature"))).withColumn("_q", apply_temperature(F.col(p), F.col("temperature")))
    before = summary(test, p, y).select(F.lit("before").alias("stage"), F.lit(1.0).alias("temperature"), "nll", "brier", "ece")
    after = summary(scaled, "_q", y).crossJoin(F.broadcast(fitted.select("temperature"))).select(F.lit("after").alias("stage"), "temperature", "nll", "brier", "ece")
    return before.unionByName(after)


def select_probabilities(summaries: DataFrame) -> DataFrame:
    """The stage of lowest (ece, brier, nll); on a tie the uncalibrated one."""
    order = F.struct("ece", "brier", "nll", (F.col("stage") != "before").cast("int").alias("late"))
    return summaries.agg(F.min_by("stage", order).alias("selected"))
