"""Closed-form fixtures of the single-cell operators."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from cellgrove import fixtures as fx
from cellgrove.operators import features as fe
from cellgrove.operators import metrics as me
from cellgrove.operators import mil, models, normalize, prep, spatial, splits, targets


def rows(df, *order):
    return [tuple(r) for r in df.orderBy(*order).collect()]


def test_composition_counts_unseen_types_but_not_nulls(spark):
    cells = spark.createDataFrame([(1, "a"), (1, "a"), (1, "b"), (1, None), (1, "z"), (2, None)], "region_id int, cell_type string")
    vocab = spark.createDataFrame([("a",), ("b",), ("q",)], "cell_type string")
    assert rows(fe.composition(cells, vocab, keys=["region_id"]), "region_id", "feature") == [(1, "a", 0.5), (1, "b", 0.25), (1, "q", 0.0), (2, "a", 0.0), (2, "b", 0.0), (2, "q", 0.0)]


def test_panel_is_the_intersection(spark):
    e = spark.createDataFrame([("A", "m1", 1.0), ("A", "m2", 2.0), ("B", "m2", None), ("B", "m3", 3.0)], "region_id string, marker string, value double")
    assert rows(fe.marker_panel(e, keys=["region_id"]), "marker") == [("m2",)]
    assert fe.shared_panel(e.filter("region_id = 'A'"), e.filter("false"), keys=["region_id"]).count() == 0


def test_adaptive_cofactor(spark):
    e = spark.createDataFrame([(1, "m", v) for v in (1.0, 2.0, 4.0, 9.0)] + [(1, "n", 1.0), (1, "n", None)], "region_id int, marker string, value double")
    out = normalize.normalize(e, keys=["region_id"], cofactor="adaptive")
    assert [round(r.value, 9) for r in out.filter("marker = 'm'").orderBy("value").collect()] == [round(math.asinh(v / 8.00001), 9) for v in (1, 2, 4, 9)]
    assert out.filter("marker = 'n' AND value IS NOT NULL").count() == 0
    with pytest.raises(ValueError):
        normalize.normalize(e, keys=["region_id"], method="other")


def test_square_with_hole(spark):
    points = {1: (50.0, 50.0, True), 2: (500.0, 500.0, False), 3: (400.0, 500.0, False), 4: (0.0, 10.0, False), 5: (1000.0, 1000.0, False), 6: (1500.0, 5.0, False), 7: (400.0, 100.0, True)}
    cells = spark.createDataFrame([(0, k, x, y) for k, (x, y, _) in points.items()], "region_id int, cell_id int, x double, y double")
    polygons = spark.sql(f"SELECT 0 AS region_id, inline(array(named_struct('kind', 'tissue', 'rings', array(array({fx.square(0, 1000)}, {fx.square(400, 600)}))), named_struct('kind', 'tumor', 'rings', array(array({fx.square(0, 500)})))))")
    a = spatial.areas_mm2(cells, polygons, mpp=0.5)
    assert tuple(a.first()) == (0, 0.24, 0.0625)
    assert round(fe.tumour_ratio(a, keys=["region_id"]).first()["value"], 6) == 0.260417
    found = {r.cell_id: r.inside for r in spatial.inside_polygon(cells, polygons, kind="tissue").collect()}
    assert found == {k: v[2] for k, v in points.items()}
    over = polygons.filter("kind = 'tumor'").select(*[spatial.disk_overlap(F.lit(x), F.lit(y), r, spatial.edges(F.col("rings"))) for x, y, r in ((250.0, 250.0, 100.0), (0.0, 0.0, 100.0), (250.0, 250.0, 1000.0), (900.0, 900.0, 10.0))]).first()
    assert np.allclose(list(over), [math.pi * 1e4, math.pi * 1e4 / 4, 250_000, 0], atol=1e-6)


def test_grid_join_is_the_brute_join(spark):
    rng = np.random.default_rng(0)
    at = [(int(i % 2), i, "ab"[i % 2], float(x), float(y)) for i, (x, y) in enumerate(rng.integers(-40, 40, (120, 2)))]
    at += [(0, 900, "a", 0.0, 0.0), (0, 901, "a", 10.0, 0.0), (0, 902, "a", 10.0001, 0.0)]
    a, b = spatial.sides(spark.createDataFrame(at, "region_id int, cell_id int, cell_type string, x double, y double"))
    got = {(r.a_id, r.b_id) for r in spatial.close_pairs(a, b, 10.0).collect()}
    want = {(p[1], q[1]) for p in at for q in at if p[0] == q[0] and (p[3] - q[3]) ** 2 + (p[4] - q[4]) ** 2 <= 100}
    assert got == want and (900, 901) in got and (900, 902) not in got


def test_nearest_proximity_and_ripley(spark):
    schema = "region_id int, cell_id int, cell_type string, x double, y double"
    c = spark.createDataFrame([(0, 1, "A", 0.0, 0.0), (0, 2, "A", 703.0, 0.0), (0, 3, "B", 3.0, 0.0)], schema)
    got = {(r.a_type, r.b_type): (r.min_dist, r.mean_dist) for r in spatial.nearest_distances(c).collect()}
    assert got["A", "B"] == (3.0, 251.5) and got["A", "A"] == (0.0, 0.0)
    c = spark.createDataFrame([(0, i, "A", float(i), 0.0) for i in range(3)] + [(0, 8, "B", 900.0, 0.0), (0, 9, "B", 901.0, 0.0)], schema)
    got = {(r.a_type, r.b_type): r.value for r in spatial.proximity(c, radii=(20.0,)).collect()}
    assert got == {("A", "A"): 2.0, ("A", "B"): 0.0, ("B", "A"): None, ("B", "B"): None}
    c = spark.createDataFrame([(0, i, "A", float(i % 2), float(i // 2)) for i in range(4)], schema)
    r = spatial.ripley(c, spatial.box_area(c), radii=(1.0,)).first()
    assert math.isclose(r.k, 8 / 12) and math.isclose(r.l, math.sqrt(8 / 12 / math.pi) - 1)
    assert spatial.hull_area(c).first().area == 1.0


def test_folds(spark):
    meta = spark.createDataFrame([(i, p, s) for i, (p, s) in enumerate([("a", 1), ("a", 2), ("a", 2), ("b", 2), ("b", 1), ("c", 1), ("d", 1), ("e", 2), ("f", 2), ("g", None), (None, 1)])], "region_id int, patient_id string, label int")
    strata = splits.patient_strata(meta, "label")
    assert dict(rows(strata, "patient_id")) == {"a": 2, "b": 1, "c": 1, "d": 1, "e": 2, "f": 2, "g": None}
    f = splits.fold_patients(strata, seeds=[0, 1], k=5, stratified=False)
    sizes = [r["count"] for r in f.groupBy("seed", "fold").count().collect()]
    assert max(sizes) - min(sizes) <= 1 and sum(sizes) == 14
    a = splits.assignments(meta, f, k=5)
    assert a.join(meta, "region_id").groupBy("seed", "fold", "patient_id").agg(F.count_distinct("role").alias("n")).filter("n > 1").count() == 0
    one = spark.createDataFrame([("a",)], "patient_id string")
    assert splits.fold_patients(one, seeds=[0], k=5, stratified=False).count() == 0


def test_preprocessing(spark):
    data = [(i, "train" if i < 4 else "val", f, v) for f, vs in {"const": [1.0] * 5, "null": [None] * 5, "half": [1.0, 3.0, None, None, None], "normal": [1.0, 2.0, 3.0, 4.0, 5.0]}.items() for i, v in enumerate(vs)]
    t = spark.createDataFrame(data, "region_id int, role string, feature string, value double")
    fitted = prep.fit_prep(t, keys=[])
    assert [r.feature for r in fitted.orderBy("feature").collect()] == ["half", "normal"]
    x = prep.assemble(prep.apply_prep(t, fitted, keys=[]), keys=[]).filter("region_id = 4").first().x
    assert np.allclose(x, [0.0, (5 - 2.5) / np.std([1, 2, 3, 4])])


def test_metrics_with_ties_and_one_class(spark):
    s = "run int, truth int, score double"
    p = spark.createDataFrame([(0, 1, 0.5), (0, 0, 0.5), (0, 1, 0.9), (0, 0, 0.1), (1, 1, 0.9), (1, 1, 0.2)], s)
    got = {r.run: r for r in me.binary_metrics(p, keys=["run"]).collect()}
    assert got[0].auc_roc == 0.875 and got[0].balanced_acc == 0.75 and math.isclose(got[0].avg_precision, 0.5 + 0.5 * 2 / 3)
    assert got[1].auc_roc is None and got[1].avg_precision is None and got[1].balanced_acc == 0.5
    c = "run int, time double, event int, risk double"
    r = spark.createDataFrame([(0, 1.0, 1, 3.0), (0, 1.0, 0, 1.0), (0, 1.0, 1, 2.0), (0, 5.0, 0, 3.0), (1, 1.0, 0, 1.0), (1, 2.0, 0, 1.0)], c)
    got = {x.run: x.c_index for x in me.concordance(r, keys=["run"]).collect()}
    assert math.isclose(got[0], (1 + 0.5 + 1 + 0) / 4) and got[1] is None
    v = spark.createDataFrame([("a", "m", 0.5), ("a", "m", None), ("a", "m", 0.7), ("b", "m", 0.5), ("c", "m", None)], "run string, metric string, value double")
    got = {x.run: (x.mean, x.sd, x.n) for x in me.summarize(v, keys=["run"]).collect()}
    assert np.allclose(got["a"], (0.6, 0.141421, 3), atol=1e-6) and got["b"] == (0.5, 0.0, 1) and got["c"] == (None, None, 1)


def test_pooling(spark):
    p = spark.createDataFrame([(1, "i", "x", 0.2), (1, "i", "y", 0.8), (1, "j", "x", 0.6), (1, "j", "y", 0.4)], "region_id int, instance_id string, class string, proba double")
    regions = spark.createDataFrame([(1,), (2,)], "region_id int")
    mean = [r[2] for r in rows(mil.pool(p, regions, ["x", "y"]).select("region_id", "class", "proba"), "region_id", "class")]
    assert np.allclose(mean, [0.4, 0.6, 0.5, 0.5])
    top = [r[2] for r in rows(mil.pool(p, regions, ["x", "y"], agg="max").select("region_id", "class", "proba"), "region_id", "class")]
    assert np.allclose(top[:2], [0.428571, 0.571429], atol=1e-6)


def test_targets(spark):
    m = spark.createDataFrame([(1, "1.0", 2.0), (2, None, None), (3, "x", 1.0)], "region_id int, label string, time double")
    assert [r[1] for r in rows(targets.build_target(m, {"type": "binary", "label_col": "label", "positive_class": 1}), "region_id")] == [1, 0, 0]
    assert targets.row_filter(m, "time.notna() and label == 'x'").count() == 1
    with pytest.raises(KeyError):
        targets.load_regions(m, spark.createDataFrame([(9,)], "region_id int"))
    with pytest.raises(ValueError):
        targets.task_rows(m, {"type": "survival", "time_col": "time"})


def _simulated(n=80, p=3, seed=1):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, p))
    return x, x @ np.array([1.0, -0.5, 0.0]) + 0.5 * rng.normal(size=n), rng


def test_logistic_reaches_the_optimum(spark):
    x, z, rng = _simulated()
    y = (z + rng.logistic(size=len(z)) > 0).astype(int)
    df = spark.createDataFrame([(0, i, x[i].tolist(), int(y[i]), 1.0) for i in range(len(y))], "run int, region_id int, x array<double>, label int, weight double")
    b = np.array(models.fit_logistic(df, keys=["run"]).first().beta)
    d = np.c_[np.ones(len(y)), x]
    gradient = d.T @ (y - 1 / (1 + np.exp(-d @ b))) - np.r_[0, b[1:]]
    assert np.abs(gradient).max() < 1e-4


def test_cox_reaches_the_optimum(spark):
    x, z, rng = _simulated(60)
    t, e = np.ceil(rng.exponential(np.exp(-z)) * 5), (rng.random(60) < 0.7).astype(float)
    df = spark.createDataFrame([(0, x[i].tolist(), float(t[i]), float(e[i])) for i in range(60)], "run int, x array<double>, time double, event double")
    b = np.array(models.fit_cox(df, keys=["run"]).first().beta)

    def objective(beta):
        w, total = np.exp(x @ beta), 0.0
        for u in np.unique(t[e == 1]):
            dead = (t == u) & (e == 1)
            total += (x[dead] @ beta).sum() - sum(np.log(w[t >= u].sum() - i / dead.sum() * w[dead].sum()) for i in range(dead.sum()))
        return total / 60 - 0.05 * beta @ beta

    best = objective(b)
    assert all(objective(b + d) <= best + 1e-9 for d in np.r_[np.eye(3), -np.eye(3)] * 1e-3)
