"""Forests of all runs at once, against a tree grown in NumPy and against themselves on one partition."""

import inspect

import numpy as np
import pytest
from pyspark.sql import functions as F

from cellgrove import fixtures as fx
from cellgrove import queries
from cellgrove.operators import boosting, models, trees


def sample(spark, runs, classes=("a", "b", "c")):
    rows, data = [], {}
    for run, (n, p) in runs.items():
        rng = np.random.default_rng(run)
        x = rng.integers(0, 9, (n, p)).astype(float)
        y = np.clip((x[:, 0] > 4).astype(int) + (x[:, -1] > 6) + (rng.random(n) < 0.1), 0, len(classes) - 1)
        w = rng.integers(1, 4, n).astype(float)
        data[run] = x, y, w
        rows += [(run, i, x[i].tolist(), classes[y[i]], float(w[i]), i % 4 == 0) for i in range(n)]
    return spark.createDataFrame(rows, "run int, region_id int, x array<double>, label string, weight double, test boolean"), data


def grow(x, y, w, k, depth):
    """(feature, cut, left, right) or shares of classes: the cut that lessens the weighted Gini impurity most, of equal ones the first."""
    totals = np.bincount(y, w, k)
    best, chosen = 1e-9, None
    for f in range(x.shape[1]):
        for c in np.unique(x[:, f])[:-1]:
            left = x[:, f] <= c
            a, b = np.bincount(y[left], w[left], k), np.bincount(y[~left], w[~left], k)
            gain = round((a**2).sum() / a.sum() + (b**2).sum() / b.sum() - (totals**2).sum() / totals.sum(), 9)
            if gain > best:
                best, chosen = gain, (f, c, left)
    if chosen is None or not depth:
        return totals / totals.sum()
    f, c, left = chosen
    return f, c, grow(x[left], y[left], w[left], k, depth - 1), grow(x[~left], y[~left], w[~left], k, depth - 1)


def follow(tree, v):
    while isinstance(tree, tuple):
        tree = tree[2] if v[tree[0]] <= tree[1] else tree[3]
    return tree


@pytest.mark.parametrize(("depth", "local"), [(0, 5000), (9, 5000), (2, 0), (9, 30)])
def test_whole_trees_equal_those_grown_in_one_place(spark, depth, local):
    rows, data = sample(spark, {0: (160, 3), 1: (90, 2)})
    got = trees.forest_predictions(rows.filter("NOT test"), rows.filter("test"), ["a", "b", "c"], keys=["run"], trees=1, max_depth=depth, max_features=None, bootstrap=False, local_rows=local).collect()
    found = {(r.run, r.region_id, r["class"]): r.proba for r in got}
    for run, (x, y, w) in data.items():
        test = np.arange(len(x)) % 4 == 0
        tree = grow(x[~test], y[~test], w[~test], 3, depth)
        for i in np.flatnonzero(test):
            assert [found[run, i, c] for c in "abc"] == pytest.approx(follow(tree, x[i]).tolist())
    assert {(r.run, r.region_id): r.truth for r in got} == {(run, i): "abc"[y[i]] for run, (_, y, _) in data.items() for i in range(0, len(y), 4)}


def test_forests_do_not_depend_on_partitions_or_on_other_runs(spark):
    rows, data = sample(spark, {0: (200, 6), 1: (120, 4), 7: (60, 2)})
    fit = lambda df, **o: {(r.run, r.region_id, r["class"]): round(r.proba, 9) for r in trees.forest_predictions(df.filter("NOT test"), df.filter("test"), ["a", "b", "c"], keys=["run"], trees=25, max_depth=6, **o).collect()}
    got = fit(rows.repartition(7))
    assert got == fit(rows.coalesce(1)) and {k: v for k, v in got.items() if k[0] == 1} == fit(rows.filter("run = 1"))
    assert got != fit(rows, seed=1)
    for run, (x, y, _) in data.items():
        test = range(0, len(y), 4)
        hits = [max("abc", key=lambda c: got[run, i, c]) == "abc"[y[i]] for i in test]
        assert np.mean(hits) >= 0.65 and all(sum(got[run, i, c] for c in "abc") == pytest.approx(1) for i in test)


def test_bootstrap_draws_are_poisson(spark):
    u = spark.range(40_000).select(trees._uniform(F.lit(3), "id").alias("u"))
    shares = [u.filter((F.col("u") >= a) & (F.col("u") < b)).count() / 40_000 for a, b in zip([0, *trees._POISSON[:2]], trees._POISSON[:3], strict=True)]
    assert shares == pytest.approx([0.3679, 0.3679, 0.1839], abs=0.01)


def boosted(x, y, w, test_x, k, *, rounds, rate, depth, least):
    """Boosting in one place: exact cuts at the values, trees of a round one after another on the scores before it."""
    def fit(x, g, h, depth):
        best, chosen = 1e-9, None
        for f in range(x.shape[1]):
            for c in np.unique(x[:, f])[:-1]:
                a = x[:, f] <= c
                if min(a.sum(), (~a).sum()) >= least:
                    gain = round(g[a].sum() ** 2 / h[a].sum() + g[~a].sum() ** 2 / h[~a].sum() - g.sum() ** 2 / h.sum(), 9)
                    if gain > best:
                        best, chosen = gain, (f, c, a)
        if chosen is None or not depth:
            return -rate * g.sum() / h.sum()
        f, c, a = chosen
        return f, c, fit(x[a], g[a], h[a], depth - 1), fit(x[~a], g[~a], h[~a], depth - 1)

    prior = np.bincount(y, w, max(k, 2)) + 1e-9
    base = np.log(prior[1:] / prior[0]) if k == 1 else np.log(prior / prior.sum())
    s, t = np.tile(base, (len(x), 1)), np.tile(base, (len(test_x), 1))
    for _ in range(rounds):
        p, trees_ = boosting.probabilities(s), []
        for c in range(k):
            q = p[:, c]
            tree = fit(x, w * (q - (y == (1 if k == 1 else c))), w * q * (1 - q), depth)
            trees_.append(tree if isinstance(tree, tuple) else 0.0)
        for c, tree in enumerate(trees_):
            s[:, c] += [follow(tree, v) for v in x]
            t[:, c] += [follow(tree, v) for v in test_x]
    p = boosting.probabilities(t)
    return np.c_[1 - p, p] if k == 1 else p


@pytest.mark.parametrize("classes", [("a", "b"), ("a", "b", "c")])
def test_boosting_equals_that_in_one_place(spark, monkeypatch, classes):
    monkeypatch.setattr(boosting, "KEEP", 3)
    rows, data = sample(spark, {0: (170, 3), 4: (120, 2)}, classes)
    options = {"rounds": 7, "rate": 0.3, "max_depth": 3, "min_leaf": 9}
    got = boosting.boosting_predictions(rows.filter("NOT test").repartition(5), rows.filter("test"), list(classes), keys=["run"], **options).collect()
    found = {(r.run, r.region_id, r["class"]): r.proba for r in got}
    for run, (x, y, w) in data.items():
        test = np.arange(len(x)) % 4 == 0
        want = boosted(x[~test], y[~test], w[~test], x[test], 1 if len(classes) == 2 else 3, rounds=7, rate=0.3, depth=3, least=9)
        assert np.array([[found[run, i, c] for c in classes] for i in np.flatnonzero(test)]) == pytest.approx(want, abs=1e-6)


def test_a_forest_grows_with_different_rows(spark, monkeypatch):
    rows, data = sample(spark, {0: (40, 2)})
    copies = rows.withColumn("region_id", F.explode(F.transform(F.sequence(F.lit(0), F.lit(29)), lambda i: F.col("region_id") + 40 * i)))
    seen, real = [], trees._finished
    monkeypatch.setattr(trees, "_finished", lambda state, *a, **o: seen.append(state.count()) or real(state, *a, **o))
    fit = lambda df: {(r.region_id, r["class"]): r.proba for r in trees.forest_predictions(df.filter("NOT test"), df.filter("test"), ["a", "b", "c"], keys=["run"], trees=3, max_features=None, bootstrap=False).collect()}
    few, many = fit(rows), fit(copies)
    assert seen[0] == seen[1] <= 3 * 40 and len(many) == 30 * len(few)
    assert all(many[r, c] == pytest.approx(few[r % 40, c]) for r, c in many)


def test_a_forest_is_the_same_wherever_its_trees_grow(spark):
    rows, _ = sample(spark, {0: (260, 6), 3: (120, 5)})
    fit = lambda n: {(r.run, r.region_id, r["class"]): r.proba for r in trees.forest_predictions(rows.filter("NOT test"), rows.filter("test"), ["a", "b", "c"], keys=["run"], trees=7, max_depth=5, local_rows=n).collect()}
    want = fit(1000)
    assert len(want) == (65 + 30) * 3
    for few in (0, 25, 100):
        assert fit(few) == pytest.approx(want)


def test_rows_are_sent_packed_to_some_tasks_and_not_to_each_tree(spark, monkeypatch):
    rows, _ = sample(spark, {0: (4000, 6)})
    copies = rows.withColumn("region_id", F.explode(F.array("region_id", F.col("region_id") + 4000)))
    seen, real = [], trees._finished
    monkeypatch.setattr(trees, "_finished", lambda state, *a, **o: seen.append(state) or real(state, *a, **o))
    fit = lambda df: trees.forest_predictions(df.filter("NOT test"), df.filter("test"), ["a", "b", "c"], keys=["run"], trees=100, max_depth=4).count()
    assert (fit(rows), fit(copies)) == (3000, 6000)
    assert max(s.count() for s in seen) < 4000
    few, many = [s.filter("NOT _asked").agg(F.sum(F.size("c")), F.sum(F.size("u"))).first() for s in seen]
    assert few[0] == many[0] and 2 * few[1] == many[1]


def test_boundaries_of_blocks_and_runs_without_draws(spark, monkeypatch):
    rows, data = sample(spark, {0: (160, 3), 5: (4, 2)})
    fit = lambda **o: {(r.run, r.region_id, r["class"]): r.proba for r in trees.forest_predictions(rows.filter("NOT test"), rows.filter("test"), ["a", "b", "c"], keys=["run"], trees=30, **o).collect()}
    whole = fit()
    assert all(sum(whole[run, i, c] for c in "abc") == pytest.approx(1) for run, i, _ in whole)
    monkeypatch.setattr(trees, "NUMBERS", 20)
    assert fit() == pytest.approx(whole)


def test_a_run_s_forest_predicts_what_spark_ml_s_does(spark):
    rows, _ = sample(spark, {0: (900, 5)})
    train, test = rows.filter("NOT test"), rows.filter("test")
    of = lambda df: {(r.region_id, r["class"]): r.proba for r in df.collect()}
    want = of(models.fit_predict_ml(train.drop("run"), test.drop("run"), models.forest(trees=100, max_depth=8), ["a", "b", "c"]))
    got = of(trees.forest_predictions(train, test, ["a", "b", "c"], keys=["run"], trees=100, max_depth=8, max_features="sqrt_up"))
    assert got.keys() == want.keys() and np.mean([abs(got[k] - want[k]) for k in want]) < 0.05
    best = lambda p, i: max("abc", key=lambda c: p[i, c])
    assert np.mean([best(got, i) == best(want, i) for i in {i for i, _ in want}]) > 0.93


def test_features_tried_at_a_node():
    nodes = np.arange(1, 2001, dtype=np.uint64)
    got = trees.tried_features(5, 3, nodes, 5, 3)
    assert all(len(set(r)) == 3 for r in got.tolist()) and np.bincount(got.ravel()) == pytest.approx([1200] * 5, rel=0.1)
    assert (trees.tried_features(5, 3, nodes, 4, 4) == np.arange(4)).all() and (got != trees.tried_features(5, 4, nodes, 5, 3)).any()


@pytest.mark.parametrize("classes", [("a", "b"), ("a", "b", "c")])
def test_boosting_is_the_same_wherever_a_run_grows(spark, monkeypatch, classes):
    monkeypatch.setattr(boosting, "KEEP", 3)
    rows, data = sample(spark, {0: (170, 3), 4: (120, 2), 6: (30, 2)}, classes)  # the last has no cut
    options, k = {"rounds": 7, "rate": 0.3, "max_depth": 3, "min_leaf": 12}, 1 if len(classes) == 2 else 3
    fit = lambda **o: {(r.run, r.region_id, r["class"]): r.proba for r in boosting.boosting_predictions(rows.filter("NOT test").repartition(5), rows.filter("test"), list(classes), keys=["run"], **options, **o).collect()}
    found = [fit(local_rows=n) for n in (0, 100, 1000)]  # all by all tasks, one run so, none
    monkeypatch.setattr(boosting, "LOCAL_NUMBERS", 180)
    found.append(fit())
    for run, (x, y, w) in data.items():
        test = np.arange(len(x)) % 4 == 0
        want = boosted(x[~test], y[~test], w[~test], x[test], k, rounds=7, rate=0.3, depth=3, least=12)
        for f in found:
            assert len(f) == (43 + 30 + 8) * len(classes)
            assert np.array([[f[run, i, c] for c in classes] for i in np.flatnonzero(test)]) == pytest.approx(want, abs=1e-6)


def test_rounds_of_a_run_in_one_task_make_no_jobs(spark, monkeypatch):
    rows, _ = sample(spark, {0: (170, 3), 4: (120, 2)}, ("a", "b"))
    seen, real = [], boosting.sums_by_run
    monkeypatch.setattr(boosting, "sums_by_run", lambda *a, **o: seen.append(1) or real(*a, **o))
    fit = lambda **o: boosting.boosting_predictions(rows.filter("NOT test"), rows.filter("test"), ["a", "b"], keys=["run"], max_depth=2, **o).count()
    assert fit() == 2 * (43 + 30) and not seen
    assert fit(rounds=2, local_rows=0) == 2 * (43 + 30) and len(seen) == 4


def test_the_boosting_query_has_all_rounds(spark, monkeypatch):
    asked, real = [], models.boosting_predictions

    def seen(*a, **o):
        asked.append(inspect.signature(real).bind(*a, **o))
        asked[-1].apply_defaults()
        return real(*a, **o)

    monkeypatch.setattr(models, "boosting_predictions", seen)
    rows = queries.QUERIES["m4_boosting"](spark, "/root/testdata/sf0.01").collect()
    default = {n: p.default for n, p in inspect.signature(real).parameters.items() if p.default is not p.empty}
    assert default["rounds"] == 300 and default["max_depth"] == 5  # as in the reference: 300 rounds
    assert len(asked) == 1 and {n: asked[0].arguments[n] for n in default} == default
    regions = fx.event_metadata(spark, "/root/testdata/sf0.01").count()
    assert len(rows) == 2 * 3 * regions and len({(r.seed, r.fold) for r in rows}) == 15  # each region once a seed
    assert len({round(r.proba, 3) for r in rows}) > 100
