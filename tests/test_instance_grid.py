"""The grid of variants: its instances against single joins, its results against separate runs, several classes, runs that fail."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from cellgrove.operators import mil, spatial


@pytest.fixture(scope="module")
def bags(spark):
    """Regions of three classes whose cells of type a, b or c prevail; the last two have two cells only."""
    rng = np.random.default_rng(1)
    cells = []
    for r in range(26):
        for i, (x, y) in enumerate(rng.uniform(0, 60, (40 if r < 24 else 2, 2))):
            cells.append((r, 100 * r + i, "abc"[r % 3] if rng.random() < 0.6 else "abc"[rng.integers(3)], float(x), float(y)))
    c = spark.createDataFrame(cells, "region_id int, cell_id int, cell_type string, x double, y double")
    m = spark.createDataFrame([(r, str(r), "uvw"[r % 3]) for r in range(26)], "region_id int, patient_id string, label string")
    return c, m


def test_views_equal_single_joins(spark, bags):
    views = [{"n_samples": n, "radius": r, "min_cells": 5, "draw": d} for n, r, d in ((6, 30.0, 0), (3, 20.0, 0), (0.1, 30.0, 1))]
    got = mil.view_instances(bags[0], views)
    for i, v in enumerate(views):
        own = {"sample_ratio": v["n_samples"]} if v["n_samples"] < 1 else {"n_samples": v["n_samples"]}
        want = mil.instances(bags[0], mil.focal_cells(bags[0], seed=v["draw"], **own), radius_um=v["radius"], min_cells=5)
        rows = lambda df: sorted((r.region_id, r.instance_id.split(":")[-1], r.cell_id) for r in df.collect())
        assert rows(got.filter(F.col("view") == i)) == rows(want) != []


def test_grid_equals_separate_runs(spark, bags, monkeypatch):
    c, m = bags
    m = m.withColumn("label", (F.col("label") == "u").cast("int"))
    joins = []
    monkeypatch.setattr(mil, "close_pairs", lambda *a: joins.append(a[2]) or spatial.close_pairs(*a))
    variants = [{"radius_um": 30.0}, {"radius_um": 20.0, "agg": "max"}, {"radius_um": 30.0, "n_samples": 0.1, "predict_samples": 5}]
    fixed = {"n_samples": 6, "min_cells": 5}
    got = mil.sweep(c, m, variants, seeds=[0], k=3, **fixed).collect()
    assert joins == [30.0] and len(got) == 9 and all(r.error is None for r in got)
    assert np.mean([r.auc_roc for r in got]) > 0.7
    alone = {(r.fold): r for r in mil.cross_validate(c, m, seeds=[0], k=3, **fixed, **variants[1]).collect()}
    for r in got:
        if r.variant == mil.variant_name(variants[1]):
            assert (r.auc_roc, r.avg_precision, r.balanced_acc) == pytest.approx((alone[r.fold].auc_roc, alone[r.fold].avg_precision, alone[r.fold].balanced_acc))


def test_several_classes_models_and_failures(spark, bags):
    c, m = bags
    variants = [{"name": "linear"}, {"name": "forest", "model": "forest", "options": {"trees": 20}}, {"name": "none", "min_cells": 1000}]
    got = mil.sweep(c, m, variants, seeds=[0], k=3, n_samples=6, radius_um=30.0, **{"min_cells": 5}).collect()
    by = {n: [r for r in got if r.variant == n] for n in ("linear", "forest", "none")}
    assert all(len(v) == 3 for v in by.values())
    for n in ("linear", "forest"):
        assert np.mean([r.macro_auc for r in by[n]]) > 0.7 and np.mean([r.balanced_acc for r in by[n]]) > 0.5
    assert all(r.balanced_acc is None and r.error == "no training instances of two classes" for r in by["none"])
    with pytest.raises(ValueError, match="same name"):
        mil.sweep(c, m, [{}, {}], seeds=[0])
    with pytest.raises(ValueError, match="no model"):
        mil.sweep(c, m, [{"model": "cox"}], seeds=[0])


def test_counts_equal_the_members_of_the_views(spark, bags):
    c = bags[0].withColumn("cell_type", F.when(F.col("cell_id") % 7 > 0, F.col("cell_type")))
    views = [{"n_samples": n, "radius": r, "min_cells": 5, "draw": d} for n, r, d in ((6, 30.0, 0), (3, 20.0, 0), (0.1, 30.0, 1))]
    want = mil.view_instances(c, views).groupBy("view", "region_id", "instance_id", "cell_type").agg(F.count("*").alias("n"))
    rows = lambda df: sorted(map(str, df.select("view", "region_id", "instance_id", "cell_type", "n").collect()))
    assert rows(mil.view_counts(c, views)) == rows(want) != []
    some = mil.view_instances(c, views, {1}).groupBy("view", "region_id", "instance_id", "cell_type").agg(F.count("*").alias("n"))
    assert rows(some) == rows(want.filter("view = 1")) != []


def test_labels_of_one_class_say_why(spark, bags):
    c, m = bags
    featurise = lambda i: i.groupBy("instance_id", F.lit("n").alias("feature")).agg(F.count("*").cast("double").alias("value"))
    variants = [{"name": "linear"}, {"name": "forest", "model": "forest"}, {"name": "boosting", "model": "boosting"}, {"name": "size", "featurise": featurise}]
    got = mil.sweep(c, m.withColumn("label", F.lit(1)), variants, seeds=[0, 1], k=3, n_samples=6, radius_um=30.0, min_cells=5)
    assert got.columns == ["variant", "seed", "fold", "auc_roc", "avg_precision", "balanced_acc", "error"]
    got = got.collect()
    assert len(got) == 24 and {(r.auc_roc, r.avg_precision, r.balanced_acc, r.error) for r in got} == {(None, None, None, "no training instances of two classes")}
