import numpy as np
import pytest
from pyspark.sql import functions as F

from sievework.operators import models


def frame(spark):
    rng = np.random.default_rng(0)
    rows = [(i, int(i % 2), float(i % 2 + rng.normal(0, 0.3)), float(rng.normal()), i % 11) for i in range(300)]
    return spark.createDataFrame(rows, "id int, y int, a double, b double, grp int")


def test_fit_predict_and_importance(spark):
    df = frame(spark)
    for model in (models.fit_logistic(df, ["a", "b"]), models.fit_trees(df, ["a", "b"], 2, rounds=3)):
        out = models.predict(model, df, ["a", "b"])
        assert out.where("predicted = y").count() > 270 and len(out.first().p) == 2
    oof = models.out_of_fold(df, ["a", "b"], "grp", 3)
    assert oof.count() == 300 and oof.select("fold").distinct().count() == 3
    top = models.permutation_importance(df, ["a", "b"], lambda d: d.withColumn("predicted", (F.col("a") > 0.5).cast("int")), "id").collect()
    assert top[0].feature == "a" and top[0].change_rate > 0.2 and top[1].change_rate == 0


def test_network_and_tokenizer(spark):
    net = models.Network.random((4, 8), {"action": 3}, seed=1)
    df = spark.createDataFrame([([0.1, 0.2, 0.3, 0.4],), ([1.0, 0.0, 0.0, 0.0],)], "encoded array<double>")
    got = np.array([r.action for r in models.score_network(df, net).collect()])
    want = net.run(np.array([[0.1, 0.2, 0.3, 0.4], [1.0, 0, 0, 0]]))["action"]
    np.testing.assert_allclose(got, want)
    act = spark.range(1).select(models.final_action(F.array(F.lit(0.2), F.lit(0.5), F.lit(0.3)), F.lit(False)).alias("a"), models.final_action(F.array(F.lit(1.0), F.lit(0.0), F.lit(0.0)), F.lit(True)).alias("b")).first()
    assert (act.a, act.b) == ("REVIEW", "BLOCK")
    vocab = {"[CLS]": 0, "[SEP]": 1, "[PAD]": 2, "a": 3, "b": 4, "ab": 5, "abab": 6, "Ġ": 7}
    t = models.ByteBpe(vocab, [("a", "b"), ("ab", "ab")], length=6)
    assert t.encode("ABab a") == ([0, 6, 7, 3, 1, 2], [1, 1, 1, 1, 1, 0])
    assert t.encode("ababababababab" * 9)[0][-1] == 1
    row = models.tokenize(spark.createDataFrame([("ab",), (None,)], "text string"), t, "text").collect()
    assert row[0].token_ids == [0, 5, 1, 2, 2, 2] and row[1].attention_mask == [1, 1, 0, 0, 0, 0]


def test_trees_for_three_classes(spark):
    rng = np.random.default_rng(2)
    rows = [(i, i % 3, float(i % 3 + rng.normal(0, 0.2)), float(i % 3 == 1), 0) for i in range(240)]
    df = spark.createDataFrame(rows, "id int, y int, a double, ip double, has_ipv4 int")
    model = models.fit_trees(df, ["a", "ip"], 3, rounds=2, without=["ip"])
    out = models.predict(model, df, ["a"]).collect()
    assert np.mean([r.predicted == r.y for r in out]) > 0.95 and all(abs(sum(r.p) - 1) < 1e-9 for r in out)


def test_predict_url(spark):
    class Longer:
        """Class 1 where a URL is longer than 40 characters."""

        def transform(self, df):
            from pyspark.ml.functions import array_to_vector, vector_to_array

            one = (F.element_at(vector_to_array("features"), 1) > 40).cast("double")
            return df.withColumns({"probability": array_to_vector(F.array(1 - one, one, F.lit(0.0))), "prediction": one})

    short, long_ = (models.predict_url(spark, Longer(), u) for u in ("HTTP://Wald.de/a", "wald.de/" + "b" * 60))
    assert (short["normalizedUrl"], short["predictedClass"], long_["predictedClass"]) == ("http://wald.de/a", "BENIGN", "PHISHING")
    assert short["features"]["url_length"] == 16 and set(short["probabilities"]) == {"BENIGN", "PHISHING", "MALWARE"} and len(short["features"]) == 43
    with pytest.raises(ValueError):
        models.predict_url(spark, Longer(), "ftp://wald.de/")


def test_network_gradient_equals_differences():
    rng = np.random.default_rng(3)
    net = models.Network.random((5, 6, 4), {"risk": 3, "action": 2}, seed=2)
    x = rng.normal(size=(9, 5))
    targets = {"risk": np.array([0, 1, 2, -1, 0, 1, 2, 2, -1]), "action": rng.integers(0, 2, 9)}
    weights = {"risk": np.array([1.0, 2.0, 0.5]), "action": np.array([0.3, 1.7])}
    loss, slope = net.gradient(x, targets, weights)
    flat = np.concatenate([a.ravel() for a in net.arrays()])
    for k in rng.choice(len(flat), 40, replace=False):
        up, down = flat.copy(), flat.copy()
        up[k] += 1e-6
        down[k] -= 1e-6
        numeric = (net.moved(up).gradient(x, targets, weights)[0] - net.moved(down).gradient(x, targets, weights)[0]) / 2e-6
        assert abs(numeric - slope[k]) < 1e-5 * max(1, abs(slope[k]))


def test_fit_network(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(160, 4))
    rows = [(v.tolist(), int(v[0] > 0), int(v[1] > 0) if k % 5 else None) for k, v in enumerate(x)]
    df = spark.createDataFrame(rows, "encoded array<double>, risk int, action int")
    start = models.Network.random((4, 8), {"risk": 2, "action": 2}, seed=3)
    net, losses = models.fit_network(df, df, start, epochs=16, rate=0.05)
    found = net.run(x)
    assert losses[-1] < 0.6 * losses[0]
    assert np.mean(found["risk"].argmax(1) == (x[:, 0] > 0)) > 0.85 and np.mean(found["action"].argmax(1) == (x[:, 1] > 0)) > 0.85
    again = models.fit_network(df.repartition(5), df, start, epochs=2, rate=0.05)[1]
    np.testing.assert_allclose(again, models.fit_network(df, df, start, epochs=2, rate=0.05)[1], rtol=1e-9)
