"""Classification metrics from small aggregates.

Confusion counts come first and all ratios are computed on them. Ranking metrics first count rows by distinct
score, then run over ranges of scores: running sums within a range plus the sums of the ranges before it, so no
task sees all scores.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..storage import stored
from .quantiles import beside, exact_quantiles


def ratio(a: Column, b: Column) -> Column:
    """a / b, and 0 where b is 0."""
    return F.when(b == 0, 0.0).otherwise(a / b)


def confusion(df: DataFrame, y: str = "y", predicted: str = "predicted", by: Sequence[str] = ()) -> DataFrame:
    return df.groupBy(*by, F.col(y).alias("y"), F.col(predicted).alias("predicted")).agg(F.count(F.lit(1)).alias("n"))


def class_report(df: DataFrame, classes: int, y: str = "y", predicted: str = "predicted", by: Sequence[str] = ()) -> DataFrame:
    """Precision, recall, F1 and support of each class, 0 where undefined."""
    cells = confusion(df, y, predicted, by)
    each = cells.withColumn("cls", F.explode(F.sequence(F.lit(0), F.lit(classes - 1))))
    count = lambda test: F.coalesce(F.sum(F.when(test, F.col("n"))), F.lit(0))
    t, p = F.col("y") == F.col("cls"), F.col("predicted") == F.col("cls")
    sums = each.groupBy(*by, "cls").agg(count(t & p).alias("tp"), count(~t & p).alias("fp"), count(t & ~p).alias("fn"))
    precision, recall = ratio(F.col("tp"), F.col("tp") + F.col("fp")), ratio(F.col("tp"), F.col("tp") + F.col("fn"))
    return sums.select(*by, "cls", precision.alias("precision"), recall.alias("recall"), ratio(2.0 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn")).alias("f1"), (F.col("tp") + F.col("fn")).alias("support"), "tp")


def multiclass_metrics(df: DataFrame, classes: int = 3, y: str = "y", predicted: str = "predicted", by: Sequence[str] = ()) -> DataFrame:
    """Accuracy, macro precision, recall and F1, weighted F1, benign FPR and malicious FNR (class 0 is benign)."""
    report = class_report(df, classes, y, predicted, by)
    total = F.sum("support")
    benign = lambda c: F.sum(F.when(F.col("cls") == 0, F.col(c)))
    cells = confusion(df, y, predicted, by).groupBy(*by).agg(
        F.coalesce(F.sum(F.when((F.col("y") != 0) & (F.col("predicted") == 0), F.col("n"))), F.lit(0)).alias("missed"),
        F.coalesce(F.sum(F.when(F.col("y") != 0, F.col("n"))), F.lit(0)).alias("bad"),
    )
    out = report.groupBy(*by).agg(
        (F.sum("tp") / total).alias("accuracy"), F.avg("precision").alias("macro_precision"), F.avg("recall").alias("macro_recall"), F.avg("f1").alias("macro_f1"),
        (F.sum(F.col("f1") * F.col("support")) / total).alias("weighted_f1"), ratio(benign("support") - benign("tp"), benign("support")).alias("benign_fpr"), total.alias("n"),
    )
    joined = out.join(cells, list(by)) if by else out.crossJoin(cells)
    return joined.withColumn("malicious_fnr", ratio(F.col("missed"), F.col("bad"))).drop("missed", "bad")


def binary_metrics(df: DataFrame, y: str = "y", predicted: str = "predicted", by: Sequence[str] = ()) -> DataFrame:
    """Counts and ratios of a binary prediction; class 1 is positive."""
    cells = confusion(df, y, predicted, by)
    count = lambda a, b: F.coalesce(F.sum(F.when((F.col("y") == a) & (F.col("predicted") == b), F.col("n"))), F.lit(0))
    c = cells.groupBy(*by).agg(count(1, 1).alias("tp"), count(0, 0).alias("tn"), count(0, 1).alias("fp"), count(1, 0).alias("fn"))
    tp, tn, fp, fn = (F.col(k) for k in ("tp", "tn", "fp", "fn"))
    recall, specificity = ratio(tp, tp + fn), ratio(tn, tn + fp)
    return c.select(
        *by, "tp", "tn", "fp", "fn", (tp + fn).alias("support_positive"), (tn + fp).alias("support_negative"),
        ratio(tp + tn, tp + tn + fp + fn).alias("accuracy"), ratio(tp, tp + fp).alias("precision"), recall.alias("recall"), ratio(2.0 * tp, 2 * tp + fp + fn).alias("f1"),
        specificity.alias("specificity"), ratio(fp, fp + tn).alias("fpr"), ratio(fn, fn + tp).alias("fnr"), ((recall + specificity) / 2).alias("balanced_accuracy"),
    )


#: Ranges of scores that ranking_metrics works through apart.
RANGES = 4096


def ranking_metrics(df: DataFrame, y: str = "y", score: str = "score", by: Sequence[str] = ()) -> DataFrame:
    """AUROC with ties averaged and average precision; null where one of the two classes is missing."""
    cells = df.where(F.col(score).isNotNull()).groupBy(*by, F.col(score).cast("double").alias("s")).agg(F.sum(F.col(y).cast("long")).alias("pos"), F.count(F.lit(1)).alias("n"))
    # Ranges in the order of scores of any size, a quarter of them between 0 and 1; not-a-number is the largest score.
    cells = cells.withColumn("range_", F.when(F.isnan("s"), RANGES).otherwise(F.floor((F.atan("s") / math.pi + 0.5) * RANGES)))
    ranges = cells.groupBy(*by, "range_").agg(F.sum("pos").alias("rp"), F.sum("n").alias("rn"))
    above = Window.partitionBy(*by).orderBy(F.col("range_").desc()).rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*by)
    zero = lambda c: F.coalesce(c, F.lit(0))
    ranges = ranges.select(*by, "range_", zero(F.sum("rp").over(above)).alias("above_pos"), zero(F.sum("rn").over(above)).alias("above_n"), F.sum("rp").over(whole).alias("all_pos"), F.sum("rn").over(whole).alias("all_n"))
    upto = Window.partitionBy(*by, "range_").orderBy(F.col("s").desc()).rowsBetween(Window.unboundedPreceding, 0)
    cells = cells.join(ranges, [*by, "range_"]).withColumns({"tp": F.sum("pos").over(upto) + F.col("above_pos"), "all": F.sum("n").over(upto) + F.col("above_n")})
    negatives = F.col("n") - F.col("pos")
    below = (F.col("all_n") - F.col("all_pos")) - (F.col("all") - F.col("tp"))  # negatives with lower scores
    out = cells.groupBy(*by).agg(F.sum(F.col("pos") * (below + negatives / 2)).alias("u"), F.sum(F.col("pos") * F.col("tp") / F.col("all")).alias("ap"), F.max("all_pos").alias("all_pos"), F.max("all_n").alias("all_n"))
    both = (F.col("all_pos") > 0) & (F.col("all_pos") < F.col("all_n"))
    return out.select(*by, F.when(both, F.col("u") / F.col("all_pos") / (F.col("all_n") - F.col("all_pos"))).alias("auroc"), F.when(both, F.col("ap") / F.col("all_pos")).alias("auprc"))


def one_vs_rest(df: DataFrame, classes: int = 3, y: str = "y", p: str = "p") -> DataFrame:
    """Macro AUROC and AUPRC over classes from a probability array; classes seen alone count as null."""
    each = df.select(F.posexplode(p).alias("cls", "score"), F.col(y).alias("_y")).where(F.col("cls") < classes)
    each = each.select("cls", "score", (F.col("_y") == F.col("cls")).cast("int").alias("y"))
    return ranking_metrics(each, by=["cls"]).agg(F.avg("auroc").alias("macro_auroc"), F.avg("auprc").alias("macro_auprc"))


def argmax(p: Column) -> Column:
    """Index of the largest element, the first of equals."""
    return F.array_position(p, F.array_max(p)).cast("int") - 1


def subgroup_metrics(df: DataFrame, tags: dict[str, Column], y: str = "y", predicted: str = "predicted") -> DataFrame:
    """Binary metrics of overlapping subgroups: each row counts in every group whose test holds."""
    held = F.filter(F.array(*[F.when(test, F.lit(name)) for name, test in tags.items()]), lambda t: t.isNotNull())
    rows = df.select(F.explode(held).alias("subgroup"), F.col(y).alias("y"), F.col(predicted).alias("predicted"))
    names = df.sparkSession.createDataFrame([(n,) for n in tags], "subgroup string")
    found = binary_metrics(rows, by=["subgroup"])
    return names.join(found, "subgroup", "left").fillna(0, ["tp", "tn", "fp", "fn", "support_positive", "support_negative"])


def error_summary(df: DataFrame, y: str = "y", predicted: str = "predicted", names: Sequence[str] = ("benign", "phishing", "malware")) -> DataFrame:
    """(error, n, rate): errors by true and predicted class, as shares of the true class."""
    cells = confusion(df, y, predicted)
    total = Window.partitionBy("y")
    name = F.array(*map(F.lit, names))
    cells = cells.withColumn("of", F.sum("n").over(total)).where("y <> predicted")
    kind = F.concat_ws("_as_", F.get(name, F.col("y")), F.get(name, F.col("predicted")))
    return cells.select(kind.alias("error"), "n", (F.col("n") / F.col("of")).alias("rate"))


def source_bias(df: DataFrame, host_is_ip: Column, y: str = "y", predicted: str = "predicted", p: str = "p") -> DataFrame:
    """(source, y): rows, accuracy, share of IP hosts, mean probability of the true class."""
    return df.groupBy("source", F.col(y).alias("y")).agg(
        F.count(F.lit(1)).alias("n"), F.avg((F.col(y) == F.col(predicted)).cast("double")).alias("accuracy"), F.avg(host_is_ip.cast("double")).alias("ip_share"),
        F.avg(F.get(F.col(p), F.col(y))).alias("mean_true_probability"),
    )


def class_weights(df: DataFrame, classes: int, y: str = "y", floor: bool = False) -> DataFrame:
    """(cls, weight): n / (classes * count); without floor an absent class has no weight."""
    counts = df.groupBy(F.col(y).alias("cls")).agg(F.count(F.lit(1)).alias("n"))
    all_ = df.sparkSession.range(classes).select(F.col("id").cast("int").alias("cls")).join(counts, "cls", "left").fillna(0, ["n"])
    total = F.sum("n").over(Window.partitionBy())
    count = F.greatest(F.col("n"), F.lit(1)) if floor else F.when(F.col("n") > 0, F.col("n"))
    return all_.select("cls", (total / (classes * count)).alias("weight"))


def top_share(df: DataFrame, name: str, value: str, k: int = 20) -> DataFrame:
    """The k largest values with rank and share of the whole."""
    total = df.agg(F.sum(value).alias("_t"))
    top = df.orderBy(F.col(value).desc(), name).limit(k)
    ranked = top.withColumn("rank", F.row_number().over(Window.orderBy(F.col(value).desc(), name)))
    return ranked.crossJoin(F.broadcast(total)).select(name, value, "rank", ratio(F.col(value), F.col("_t")).alias("share"))


def latency_summary(df: DataFrame, column: str, by: Sequence[str] = ()) -> DataFrame:
    """Mean, exact P50 and P95 by selection, minimum and maximum."""
    found = exact_quantiles(df, [column], {"p50": 0.5, "p95": 0.95}, by).withColumnsRenamed({f"{column}_{p}": p for p in ("p50", "p95")})
    whole = beside(df.groupBy(*by).agg(F.avg(column).alias("mean"), F.min(column).alias("min"), F.max(column).alias("max")), found, by)
    return whole.select(*by, "mean", "p50", "p95", "min", "max")


def histogram(df: DataFrame, column: str, bins: int = 40, quantile: float = 0.99, by: Sequence[str] = ()) -> DataFrame:
    """Counts of equal bins after clipping at a quantile: the data of the distribution plots."""
    df = stored(df.select(*by, column), "histogram")
    found = exact_quantiles(df, [column], {"top": quantile}, by, held=True).withColumnRenamed(f"{column}_top", "_top")
    limits = beside(df.groupBy(*by).agg(F.min(column).alias("_low")), found, by)
    joined = beside(df, limits, by)
    clipped = F.least(F.col(column).cast("double"), F.col("_top"))
    width = (F.col("_top") - F.col("_low")) / bins
    slot = F.when(width <= 0, 0).otherwise(F.least(F.floor((clipped - F.col("_low")) / width), F.lit(bins - 1)))
    return joined.groupBy(*by, slot.cast("int").alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def parity(left: DataFrame, right: DataFrame, key: str = "id", p: str = "p") -> DataFrame:
    """One row: largest and mean absolute difference of two models' probabilities, and how often they agree."""
    both = left.select(key, F.col(p).alias("_a")).join(right.select(key, F.col(p).alias("_b")), key)
    gaps = F.zip_with("_a", "_b", lambda a, b: F.abs(a - b))
    mean = F.aggregate(gaps, F.lit(0.0), lambda acc, x: acc + x) / F.size(gaps)
    return both.agg(F.max(F.array_max(gaps)).alias("max_abs_error"), F.avg(mean).alias("mean_abs_error"), F.avg((argmax(F.col("_a")) == argmax(F.col("_b"))).cast("double")).alias("agreement"))


def token_statistics(df: DataFrame, column: str) -> DataFrame:
    """Exact percentiles by selection, maximum and mean of a count column."""
    shares = {"p50": 0.5, "p90": 0.9, "p95": 0.95, "p99": 0.99}
    found = exact_quantiles(df, [column], shares).withColumnsRenamed({f"{column}_{n}": n for n in shares})
    whole = beside(df.agg(F.max(column).alias("max"), F.avg(column).alias("mean")), found, ())
    return whole.select(*shares, "max", "mean")
