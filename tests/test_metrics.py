import numpy as np
import pytest
from pyspark.sql import functions as F

from sievework.operators import calibration, metrics


@pytest.fixture(scope="module")
def three(spark):
    rng = np.random.default_rng(0)
    y = rng.integers(0, 3, 600)
    p = np.full((600, 3), 0.05)
    p[np.arange(600), np.where(rng.random(600) < 0.6, y, (y + 1) % 3)] = 0.9
    return spark.createDataFrame([(int(a), [float(x) for x in b], int(np.argmax(b))) for a, b in zip(y, p)], "y int, p array<double>, predicted int").cache()


def auroc(y, s):
    pos, neg = s[y == 1], s[y == 0]
    return ((pos[:, None] > neg[None, :]).sum() + 0.5 * (pos[:, None] == neg[None, :]).sum()) / (len(pos) * len(neg))


def average_precision(y, s):
    out, last = 0.0, 0.0
    for t in sorted(set(s.tolist()), reverse=True):
        tp, n = int(y[s >= t].sum()), int((s >= t).sum())
        out += (tp / y.sum() - last) * tp / n
        last = tp / y.sum()
    return out


def test_ranking(spark):
    rng = np.random.default_rng(1)
    y, s = rng.integers(0, 2, 500), np.round(rng.random(500), 2)
    got = metrics.ranking_metrics(spark.createDataFrame([(int(a), float(b)) for a, b in zip(y, s)], "y int, score double")).first()
    assert got.auroc == pytest.approx(auroc(y, s)) and got.auprc == pytest.approx(average_precision(y, s))
    logits = 20 * s - 10
    logits[:3] = 1e9, -1e9, np.inf
    got = metrics.ranking_metrics(spark.createDataFrame([(int(a), float(b)) for a, b in zip(y, logits)], "y int, score double")).first()
    assert got.auroc == pytest.approx(auroc(y, logits)) and got.auprc == pytest.approx(average_precision(y, logits))
    highest = metrics.ranking_metrics(spark.createDataFrame([(1, float("nan")), (0, 0.5), (0, float("inf"))], "y int, score double")).first()
    assert highest.auroc == 1.0
    one = metrics.ranking_metrics(spark.createDataFrame([(1, 0.5), (1, 0.7)], "y int, score double")).first()
    assert one.auroc is None and one.auprc is None


def test_binary_and_subgroups(spark):
    df = spark.createDataFrame([(1, 1, "a"), (1, 0, "a"), (0, 0, "b"), (0, 1, "b"), (0, 0, "b")], "y int, predicted int, source string")
    m = metrics.binary_metrics(df).first()
    assert (m.tp, m.tn, m.fp, m.fn) == (1, 2, 1, 1) and m.precision == 0.5 and m.specificity == pytest.approx(2 / 3)
    groups = {r.subgroup: r for r in metrics.subgroup_metrics(df, {"a": F.col("source") == "a", "none": F.lit(False)}).collect()}
    assert groups["a"].tp == 1 and groups["none"].tp == 0 and groups["none"].f1 is None
    zero = metrics.binary_metrics(df.where("y = 9")).first()
    assert zero.tp == 0 and zero.precision == 0


def test_calibration(three):
    fitted = calibration.fit_temperature(three).first()
    p = np.array([r.p for r in three.collect()])
    y = np.array([r.y for r in three.collect()])

    def nll(t):
        z = np.log(np.clip(p, 1e-12, 1)) / t
        z -= z.max(1, keepdims=True)
        return float(np.mean(np.log(np.exp(z).sum(1)) - z[np.arange(len(y)), y]))

    best = min(calibration.TEMPERATURES, key=nll)
    assert fitted.temperature == pytest.approx(best) and fitted.nll == pytest.approx(nll(best), abs=1e-9) and best > 1
    same = three.select(calibration.apply_temperature(F.col("p"), 1.0).alias("q"), "p").first()
    assert same.q == pytest.approx(same.p)
    with pytest.raises(ValueError):
        calibration.apply_temperature(F.col("p"), 0)
    stages = {r.stage: r for r in calibration.calibrate(three, three).collect()}
    assert stages["after"].nll < stages["before"].nll and stages["after"].ece < stages["before"].ece
    assert calibration.select_probabilities(calibration.calibrate(three, three)).first().selected == "after"


def test_reliability(spark):
    df = spark.createDataFrame([([1.0, 0.0], 0), ([1.0, 0.0], 0), ([0.4, 0.6], 1), ([0.4, 0.6], 0)], "p array<double>, y int")
    rows = calibration.reliability(df).orderBy("bin").collect()
    assert len(rows) == 15 and rows[0].n == 0 and rows[0].confidence is None and rows[14].n == 2 and rows[8].n == 2
    assert calibration.ece(df).first().ece == pytest.approx(0.5 * 0.1)
    perfect = spark.createDataFrame([([1.0, 0.0], 0)], "p array<double>, y int")
    assert calibration.ece(perfect).first().ece == 0


def test_thresholds(spark):
    df = spark.createDataFrame([(0.9, True), (0.8, True), (0.6, True), (0.1, False)], "s double, pos boolean")
    rows = {r.threshold: r for r in calibration.threshold_table(df, F.col("s"), F.col("pos"), [0.5, 0.99]).collect()}
    assert (rows[0.5].tp, rows[0.5].fp, rows[0.5].precision, rows[0.5].recall) == (3, 0, 1, 1)
    assert (rows[0.99].tp, rows[0.99].fn, rows[0.99].precision) == (0, 3, 0)


def test_weights_errors_and_shares(spark, three):
    w = {r.cls: r.weight for r in metrics.class_weights(spark.createDataFrame([(0,), (0,), (1,)], "y int"), 3).collect()}
    assert w[0] == 0.5 and w[1] == 1.0 and w[2] is None
    assert metrics.class_weights(spark.createDataFrame([(0,)], "y int"), 2, floor=True).count() == 2
    top = metrics.top_share(spark.createDataFrame([("a", 3.0), ("b", 1.0)], "name string, gain double"), "name", "gain", 1).first()
    assert (top.name, top["rank"], top.share) == ("a", 1, 0.75)
    assert metrics.multiclass_metrics(three).first().accuracy == pytest.approx(np.mean([r.y == r.predicted for r in three.collect()]))
    assert metrics.parity(three.withColumn("id", F.monotonically_increasing_id()), three.withColumn("id", F.monotonically_increasing_id())).first().agreement == 1
