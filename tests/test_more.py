"""Bucketed metrics, specs, per-run failures and instance models against brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from cellgrove.operators import metrics as me
from cellgrove.operators import mil, models, normalize, pipelines, spatial, splits, targets


def c_index(time, event, risk):
    a, b = np.meshgrid(np.arange(len(time)), np.arange(len(time)), indexing="ij")
    pair = (event[a] == 1) & ((time[a] < time[b]) | ((time[a] == time[b]) & (event[b] == 0)))
    good = np.where(risk[a] > risk[b], 1.0, np.where(risk[a] == risk[b], 0.5, 0.0))
    return (good * pair).sum() / pair.sum() if pair.any() else None


def test_concordance_by_buckets(spark):
    rng = np.random.default_rng(3)
    rows, want = [], {}
    for run, (n, ties) in enumerate([(1, 2), (40, 5), (900, 10**6), (1500, 60), (6, 3)]):
        time, risk, event = rng.integers(0, ties, n).astype(float), rng.integers(0, ties, n).astype(float), rng.integers(0, 2, n)
        event = event if run < 4 else 0 * event
        want[run] = c_index(time, event, risk)
        rows += [(run, float(t), int(e), float(r)) for t, e, r in zip(time, event, risk, strict=True)]
    got = {r.run: r.c_index for r in me.concordance(spark.createDataFrame(rows, "run int, time double, event int, risk double"), keys=["run"]).collect()}
    assert set(got) == set(want)
    assert all(got[k] is None if v is None else got[k] == pytest.approx(v) for k, v in want.items())


def test_concordance_of_a_large_run(spark):
    """100,000 rows without ties: the risks are the times' order with some swaps, whose number is known."""
    n = 100_000
    rows = spark.range(n).select(F.lit(0).alias("run"), F.col("id").cast("double").alias("time"), F.lit(1).alias("event"), (-(F.col("id").bitwiseXOR(F.lit(1)))).cast("double").alias("risk"))
    got = me.concordance(rows, keys=["run"]).first().c_index
    assert got == pytest.approx(1 - (n / 2) / (n * (n - 1) / 2), abs=1e-12)


@pytest.mark.parametrize("ties", ["two risks", "two times"])
def test_concordance_of_a_million_rows(spark, ties):
    """A million rows whose risks or times are nearly all tied take time in proportion, as no pairs are made."""
    n, i = 1_000_000, F.col("id")
    time, risk = {"two risks": (i, (i % 2)), "two times": (i % 2, i)}[ties]
    rows = spark.range(n).select(F.lit(0).alias("run"), time.cast("double").alias("time"), F.lit(1).alias("event"), risk.cast("double").alias("risk"))
    h = n // 2
    wanted = {
        # Odd ids have the higher risk: pairs of one parity tie, an odd id before an even one is right, an even one before an odd one wrong.
        "two risks": (0.5 * h * (h - 1) + h * (h - 1) / 2) / (n * (n - 1) / 2),
        # Time 0 before time 1, risks 2k against 2m + 1.
        "two times": (h * (h - 1) / 2) / (h * h),
    }[ties]
    assert me.concordance(rows, keys=["run"]).first().c_index == pytest.approx(wanted, abs=1e-12)


def test_rank_metrics_by_buckets(spark):
    rng = np.random.default_rng(4)
    rows, want = [], {}
    for run, n in enumerate([2000, 30, 5]):
        score, truth = rng.random(n).round(2 if run else 6), rng.integers(0, 2, n)
        truth = truth if run < 2 else 0 * truth
        a, b = score[truth == 1], score[truth == 0]
        auc = ((a[:, None] > b).mean() + (a[:, None] == b).mean() / 2) if len(a) and len(b) else None
        ap = sum((score >= s)[truth == 1].sum() / (score >= s).sum() * (a == s).sum() / len(a) for s in np.unique(score)) if len(a) else None
        want[run] = (auc, ap)
        rows += [(run, int(t), float(s)) for t, s in zip(truth, score, strict=True)]
    got = {r.run: (r.auc_roc, r.avg_precision) for r in me.binary_metrics(spark.createDataFrame(rows, "run int, truth int, score double"), keys=["run"]).collect()}
    for run, (auc, ap) in want.items():
        assert got[run] == ((None, None) if auc is None else (pytest.approx(auc), pytest.approx(ap)))


def test_tasks_as_specs_state_them(spark):
    meta = spark.createDataFrame([("a", "x", 1, None), ("b", "y", 0, 2.0), ("c", "x", None, 3.0), ("d", "x", 0, 4.0)], "region_id string, cohort string, label int, t double")
    task = {"id": "k", "type": "binary_classification", "label_col": "label", "positive_class": 1, "row_filter": "cohort == 'x'"}
    assert [r.region_id for r in targets.task_rows(meta, task).orderBy("region_id").collect()] == ["a", "d"]
    assert [r.region_id for r in targets.task_rows(meta, {**task, "drop_na_cols": ["t"]}).collect()] == ["d"]
    for wrong in ({**task, "filter": "cohort == 'x'"}, {**task, "type": "other"}, {k: v for k, v in task.items() if k != "label_col"}, {**task, "label_col": "none"}, {"type": "survival", "time_col": "t"}):
        with pytest.raises(ValueError):
            targets.task_rows(meta, wrong)
    with pytest.raises(KeyError):
        targets.find_task({"tasks": [task]}, "other")
    asked = spark.createDataFrame([("d", 0), ("a", 1)], "region_id string, place int")
    assert [tuple(r) for r in targets.build_target(meta, task, asked).orderBy("place").collect()] == [("d", 0, 0), ("a", 1, 1)]
    with pytest.raises(KeyError):
        targets.build_target(meta, task, spark.createDataFrame([("z",)], "region_id string"))


def test_polygons_of_a_subset(spark):
    polygons = spark.createDataFrame([(1, "tissue"), (2, "tissue")], "region_id int, kind string")
    chosen = spark.createDataFrame([(1, 5), (1, 5)], "region_id int, cell_id int")
    assert [tuple(r) for r in targets.subset_polygons(polygons, chosen, new_region="_s").collect()] == [("1_s", "tissue")]
    assert targets.subset_polygons(polygons, chosen, use="drop").count() == 0
    assert targets.subset_polygons(polygons, chosen, use=polygons) is polygons
    with pytest.raises(ValueError):
        targets.subset_polygons(polygons, chosen, use="other")


def runs_of(spark, n=60, seed=0):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, 2))
    label = (x[:, 0] + rng.normal(size=n) > 0).astype(int)
    features = [(i, f"f{j}", float(x[i, j])) for i in range(n) for j in range(2)]
    meta = [(i, str(i // 2), int(label[i]), "ab"[i % 2], float(i)) for i in range(n)]
    return spark.createDataFrame(features, "region_id int, feature string, value double"), spark.createDataFrame(meta, "region_id int, patient_id string, label int, cohort string, t double")


def test_runs_that_fail_are_null(spark):
    f, m = runs_of(spark)
    runs = m.select("region_id", F.when(F.col("region_id") % 3 == 0, "val").otherwise("train").alias("role"), F.explode(F.array(F.lit(0), F.lit(1))).alias("run"))
    one_class = runs.join(m, "region_id").filter("run = 0 OR role = 'val' OR label = 1").select("region_id", "role", "run")
    for model in ("logistic", "forest", "elastic_net", "boosting", "forest_ml"):
        options = {"forest": {"trees": 5, "max_depth": 3}, "forest_ml": {"trees": 5, "max_depth": 3}, "boosting": {"rounds": 3, "min_leaf": 2}}.get(model, {})
        got = {(r.run, r.metric): r.value for r in pipelines.evaluate(f, one_class, m.select("region_id", "label"), keys=["run"], kind="binary_classification", model=model, **options).collect()}
        assert len(got) == 6 and got[0, "auc_roc"] > 0.5 and all(got[1, k] is None for k in me.METRICS["binary"]), model
    failed = {}
    bad = spark.createDataFrame([(0, [1.0, float("nan")], 1, 1.0), (0, [1.0, 2.0], 0, 1.0), (1, [1.0, 0.5], 1, 1.0), (1, [-1.0, 0.1], 0, 1.0)], "run int, x array<double>, label int, weight double")
    assert [r.run for r in models.fit_logistic(bad, keys=["run"], failed=failed).collect()] == [1] and set(failed) == {(0,)}
    with pytest.raises(ValueError):
        pipelines.evaluate(f, one_class, m, keys=["run"], kind="survival", model="forest")


def test_spec_options_of_cross_validation(spark):
    f, m = runs_of(spark)
    spec = {"cv_filter": "cohort == 'none such'", "tasks": [{"id": "k", "type": "binary", "label_col": "label", "positive_class": 1, "row_filter": "t >= 10"}]}
    every = pipelines.cross_validate_task(f, m, spec, "k", seeds=[0], k=3).filter("metric = 'auc_roc'").collect()
    assert len(every) == 3 and sum(r.n_val for r in every) == 50
    half = pipelines.cross_validate_task(f, m, {**spec, "cv_filter": "cohort == 'a'"}, "k", seeds=[0], k=3).filter("metric = 'auc_roc'").collect()
    assert sum(r.n_val for r in half) == 25
    e = f.withColumnRenamed("feature", "marker")
    panel = e.select("marker").distinct()
    plain, done = pipelines.expression_features(e, panel), pipelines.expression_features(e, panel, normalization={"cofactor": 0.5})
    both = plain.join(done.withColumnRenamed("value", "v"), ["region_id", "feature"]).collect()
    assert len(both) == 120 and all(r.v == pytest.approx(np.arcsinh(r.value / 0.5)) for r in both)
    assert splits.both_sides(splits.cohort_roles(m, column="cohort", train=["a"], test=["z"])).count() == 0


def test_newton_steps_end_at_the_optimum(spark):
    """Gradient zero for two runs of different widths."""
    rng = np.random.default_rng(2)
    rows = [(run, [float(v) for v in x], int(x[0] + rng.normal() > 0), 1.0) for run, p in ((0, 2), (1, 5)) for x in rng.normal(size=(80, p))]
    got = {r.run: np.array(r.beta) for r in models.fit_logistic(spark.createDataFrame(rows, "run int, x array<double>, label int, weight double"), keys=["run"]).collect()}
    for run in (0, 1):
        x = np.array([[1, *r[1]] for r in rows if r[0] == run])
        y = np.array([r[2] for r in rows if r[0] == run])
        g = x.T @ (y - 1 / (1 + np.exp(-x @ got[run])))
        g[1:] -= got[run][1:]
        assert np.abs(g).max() < 1e-4


def test_instances_of_regions(spark):
    """Cells of regions with the label lie in clumps of one type; regions without a full neighbourhood get 0.5."""
    rng = np.random.default_rng(1)
    cells = [(r, i, "a" if (r % 2 and i % 5) or i % 4 == 0 else "b", float(x), float(y)) for r in range(24) for i, (x, y) in enumerate(rng.uniform(0, 60, (40 if r < 22 else 2, 2)))]
    meta = [(r, str(r), r % 2) for r in range(24)]
    c = spark.createDataFrame(cells, "region_id int, cell_id int, cell_type string, x double, y double")
    m = spark.createDataFrame(meta, "region_id int, patient_id string, label int")
    got = mil.cross_validate(c, m, seeds=[0], k=3, n_samples=6, radius_um=30.0, min_cells=5, agg="max").collect()
    assert len(got) == 3 and np.mean([r.auc_roc for r in got]) > 0.8
    swept = mil.sweep(c, m, [{"radius_um": 30.0}, {"radius_um": 40.0}], seeds=[0], k=3, n_samples=4, min_cells=5)
    assert swept.groupBy("variant").count().count() == 2


def test_nearest_by_rings(spark):
    rng = np.random.default_rng(7)
    at = [(int(i % 2), i, "abc"[i % 3] if i % 2 else "ab"[i % 4 // 2], float(x), float(y)) for i, (x, y) in enumerate(rng.uniform(0, 300, (90, 2)))]
    cells = spark.createDataFrame(at, "region_id int, cell_id int, cell_type string, x double, y double")
    got = {(r.region_id, r.a_type, r.b_type): (r.min_dist, r.mean_dist) for r in spatial.nearest_distances(cells, max_dist=60.0, sample_n=None).collect()}
    assert len(got) == 18
    for region in (0, 1):
        for a in "abc":
            for b in "abc":
                p = np.array([x[3:] for x in at if x[0] == region and x[2] == a]).reshape(-1, 2)
                q = np.array([x[3:] for x in at if x[0] == region and x[2] == b]).reshape(-1, 2)
                if not len(p) or not len(q):
                    assert got[region, a, b] == (None, None)
                    continue
                near = np.minimum(np.hypot(p[:, None, 0] - q[:, 0], p[:, None, 1] - q[:, 1]).min(axis=1), 60)
                assert got[region, a, b] == pytest.approx((near.min(), near.mean()))
    some = spatial.nearest_distances(cells, max_dist=60.0, sample_n=None, pairs=[("a", "b"), ("c", "a")]).collect()
    assert {(r.a_type, r.b_type) for r in some} == {("a", "b"), ("c", "a")} and all(got[r.region_id, r.a_type, r.b_type][0] == (None if r.min_dist is None else pytest.approx(r.min_dist)) for r in some)


def test_range_check_and_zero_markers(spark):
    e = spark.createDataFrame([(r, "m", float(v * (r + 1))) for r in range(9) for v in range(11)] + [(0, "z", 0.0), (0, "z", 5.0)], "region_id int, marker string, value double")
    got = normalize.range_check(e, regions=9).filter("marker = 'm'").first()
    values = [v * (r + 1) for r in range(9) for v in range(11)]
    assert (got.p50, got.p99, got.max_value) == (pytest.approx(np.quantile(values, 0.5)), pytest.approx(np.quantile(values, 0.99)), 90.0)
    assert tuple(normalize.markers_at_zero(e.withColumn("d", F.lit(1)), keys=["d"]).first()) == (1, 2, 0)
