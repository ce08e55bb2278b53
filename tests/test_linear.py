"""Linear models of all runs at once, against their optimum conditions in NumPy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from cellgrove.operators import linear, pipelines
from cellgrove.operators import metrics as me


def sample(n, p, classes, seed):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, p))
    truth = (x @ rng.normal(size=(p, len(classes))) + rng.gumbel(size=(n, len(classes)))).argmax(axis=1)
    return x, truth, rng.uniform(0.5, 2.0, n)


def table(spark, runs, classes):
    rows = [(run, i, x.tolist(), classes[y], float(w)) for run, (xs, ys, ws) in runs.items() for i, (x, y, w) in enumerate(zip(xs, ys, ws, strict=True))]
    return spark.createDataFrame(rows, "run int, region_id int, x array<double>, label string, weight double").repartition(3)


def gradient(beta, x, y, w):
    """Of the weighted log loss, without penalty."""
    x = np.c_[np.ones(len(x)), x]
    z = x @ beta.T
    p = 1 / (1 + np.exp(-z)) if len(beta) == 1 else np.exp(z - z.max(1, keepdims=True))
    p = p if len(beta) == 1 else p / p.sum(1, keepdims=True)
    hit = (y == 1)[:, None] if len(beta) == 1 else y[:, None] == np.arange(len(beta))
    return ((p - hit) * w[:, None]).T @ x


@pytest.mark.parametrize(("classes", "l1_ratio"), [(["a", "b", "c"], 0.0), (["a", "b", "c", "d"], 0.6), (["a", "b"], 0.5), (["a", "b"], 1.0)])
def test_all_runs_reach_their_optimum(spark, classes, l1_ratio):
    runs, c = {0: sample(300, 4, classes, 1), 1: sample(90, 7, classes, 2), 5: sample(60, 1, classes, 3)}, 0.05 if l1_ratio else 1.0
    rows = table(spark, runs, classes)
    betas = linear.fit_softmax(rows, classes, keys=["run"], c=c, l1_ratio=l1_ratio)
    found = {r.run: np.array(r.beta) for r in betas.collect()}
    assert set(found) == set(runs)
    zeros = 0
    for run, (x, y, w) in runs.items():
        g, b = gradient(found[run], x, y, w), found[run]
        assert np.abs(g[:, 0]).max() < 1e-5
        smooth = g[:, 1:] + (1 - l1_ratio) / c * b[:, 1:]
        zero = b[:, 1:] == 0
        zeros += zero.sum()
        assert np.abs(smooth[~zero] + l1_ratio / c * np.sign(b[:, 1:][~zero])).max(initial=0) < 1e-5
        assert np.abs(smooth[zero]).max(initial=0) <= l1_ratio / c + 1e-5
    assert (zeros > 0) == (l1_ratio > 0)
    proba = linear.predict_softmax(rows, betas, classes, keys=["run"]).collect()
    x, y, _ = runs[0]
    b = found[0]
    z = b[:, 0] + x @ b[:, 1:].T
    p = np.exp(z) / np.exp(z).sum(1, keepdims=True) if len(classes) > 2 else np.c_[1 / (1 + np.exp(z)), 1 / (1 + np.exp(-z))]
    got = {(r.region_id, r["class"]): r.proba for r in proba if r.run == 0}
    assert len(got) == p.size and all(got[i, k] == pytest.approx(p[i, j]) for i in range(len(x)) for j, k in enumerate(classes))


def cox_gradient(beta, x, time, event):
    """Of the log partial likelihood with Efron's rule for ties."""
    w, g = np.exp(x @ beta), np.zeros(len(beta))
    for t in np.unique(time[event == 1]):
        risk, dead = time >= t, (time == t) & (event == 1)
        d = dead.sum()
        for k in range(d):
            own = w * risk - k / d * w * dead
            g -= own @ x / own.sum()
        g += x[dead].sum(axis=0)
    return g


def survival(n, p, seed, times):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, p))
    time = rng.exponential(np.exp(-x[:, 0] / 2)) if times is None else rng.integers(1, times, n).astype(float)
    return x, time, (rng.random(n) < 0.6).astype(int)


def test_cox_models_of_all_runs_reach_their_optimum(spark):
    runs = {0: survival(250, 3, 1, None), 1: survival(300, 5, 2, 12), 2: survival(40, 2, 3, 4)}
    rows = [(run, v.tolist(), float(t), int(e)) for run, (x, time, event) in runs.items() for v, t, e in zip(x, time, event, strict=True)]
    df = spark.createDataFrame(rows, "run int, x array<double>, time double, event int").repartition(3)
    found = {r.run: np.array(r.beta) for r in linear.fit_cox(df, keys=["run"]).collect()}
    for run, (x, time, event) in runs.items():
        assert np.abs(cox_gradient(found[run], x, time, event) / len(x) - 0.1 * found[run]).max() < 1e-6


def test_cox_model_of_two_hundred_features(spark):
    x, time, event = survival(500, 200, 4, 60)
    df = spark.createDataFrame([(0, v.tolist(), float(t), int(e)) for v, t, e in zip(x, time, event, strict=True)], "run int, x array<double>, time double, event int")
    beta = np.array(linear.fit_cox(df, keys=["run"]).first().beta)
    assert len(beta) == 200 and np.abs(cox_gradient(beta, x, time, event) / len(x) - 0.1 * beta).max() < 1e-6


def test_failed_runs_say_why_and_user_features_are_normalised(spark):
    cells = spark.createDataFrame([(r, m, float(v)) for r in range(40) for m, v in (("p", r % 7 + 1), ("q", r % 3 + 1), ("p", 50))], "region_id long, marker string, value double")
    meta = spark.range(40).select(F.col("id").alias("region_id"), F.col("id").cast("string").alias("patient_id"), (F.col("id") % 7 > 2).cast("int").alias("label"))
    largest = lambda e: e.groupBy("region_id", F.concat(F.lit("max_"), "marker").alias("feature")).agg(F.max("value").alias("value"))
    mean = lambda e: e.groupBy("region_id", F.col("marker").alias("feature")).agg(F.avg("value").alias("value"))
    for featurise, least in ((mean, 0.9), (largest, 0.0)):
        got = pipelines.cross_validate(cells, meta, meta.select("region_id", "label"), kind="binary", seeds=[0], k=4, featurise=featurise, normalization={"method": "arcsinh", "cofactor": 5.0}, fill=None).collect()
        assert len(got) == 12 and all(r.error is None and r.value >= least for r in got if r.metric == "auc_roc")
    f = mean(cells)
    runs = meta.select("region_id", F.when(F.col("region_id") % 4 == 0, "val").otherwise("train").alias("role"), F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))).alias("run"))
    runs = runs.join(meta, "region_id").filter("run <> 1 OR role = 'val' OR label = 1").filter("run <> 2 OR role = 'val' OR region_id = 1").select("region_id", "role", "run")
    got = pipelines.evaluate(f, runs, meta.select("region_id", "label"), keys=["run"], kind="binary").collect()
    why = {r.run: r.error for r in got}
    assert why == {0: None, 1: "one class among the training rows", 2: "no feature varies among the training rows"}
    assert all((r.value is None) == (r.run > 0) for r in got) and {r.metric for r in got} == set(me.METRICS["binary"])
    with pytest.raises(ValueError, match="featuriser"):
        pipelines.cross_validate(cells, meta, meta, kind="binary", seeds=[0], normalization={"method": "arcsinh"})
