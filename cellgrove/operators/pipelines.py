"""Cross-validation and cohort tests: features once, folds as data, all runs fitted in the same jobs."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellgrove.operators import features as fe
from cellgrove.operators import metrics as me
from cellgrove.operators import models as mo
from cellgrove.operators import normalize, prep, spatial, splits, targets
from cellgrove.scratch import materialize


def run_features(features: DataFrame, runs: DataFrame, *, keys: list[str], fill: float | None, vocab: DataFrame | None = None) -> DataFrame:
    """(keys, region_id, role, feature, value): the run's vocabulary for each of its regions.

    The vocabulary are features that training regions of the run have (or ``vocab``, shared by all runs); a
    feature a region lacks is ``fill`` (0 for shares, null for means).
    """
    joined = runs.join(features, "region_id")
    words = joined.filter("role = 'train' AND value IS NOT NULL").select(*keys, "feature").distinct() if vocab is None else runs.select(*keys).distinct().crossJoin(F.broadcast(vocab.select("feature")))
    grid = runs.join(words, keys)
    return grid.join(features, ["region_id", "feature"], "left").withColumn("value", F.coalesce("value", F.lit(fill).cast("double")))


def run_vectors(features: DataFrame, runs: DataFrame, *, keys: list[str], fill: float | None, vocab: DataFrame | None = None) -> DataFrame:
    """(keys, region_id, role, x): the prepared values of `run_features` as an array in the order of feature names.

    The values of a region stay together, written once with its runs; only sums by run and feature leave the tasks, and the features of a run with what they are prepared by (a
    row a run, no longer than the vocabulary) are broadcast.
    """
    by_region = features.filter("feature IS NOT NULL").groupBy("region_id").agg(F.map_from_entries(F.collect_list(F.struct("feature", "value"))).alias("_values"))
    rows = materialize(runs.select(*keys, "region_id", "role").join(by_region, "region_id", "left"), "run-values")
    train = rows.filter("role = 'train'")
    if vocab is None:
        words = train.select(*keys, F.explode("_values").alias("feature", "value")).filter("value IS NOT NULL").select(*keys, "feature").distinct()
    else:
        words = rows.select(*keys).distinct().crossJoin(F.broadcast(vocab.select("feature").distinct()))
    words = words.groupBy(*keys).agg(F.collect_list("feature").alias("_words"))
    value = lambda f: F.coalesce(F.try_element_at("_values", f), F.lit(fill).cast("double"))
    long = train.join(F.broadcast(words), keys).select(*keys, "role", F.inline(F.transform("_words", lambda f: F.struct(f.alias("feature"), value(f).alias("value")))))
    by_name = F.array_sort(F.collect_list(F.struct("feature", "median", "mean", "scale")))
    fitted = materialize(prep.fit_prep(long, keys=keys).groupBy(*keys).agg(by_name.alias("_prep")), "prepared-by")
    x = F.transform("_prep", lambda p: (F.coalesce(value(p["feature"]), p["median"]) - p["mean"]) / p["scale"])
    return rows.join(F.broadcast(fitted), keys).select(*keys, "region_id", "role", x.alias("x"))


def evaluate(features: DataFrame, runs: DataFrame, target: DataFrame, *, keys: list[str], kind: str, fill: float | None = 0.0, vocab: DataFrame | None = None, model: str | None = None, **options) -> DataFrame:
    """(keys, n_train, n_val, metric, value, error) of every run: prepare on training rows, fit, predict, score.

    ``model`` is "cox", "logistic", "elastic_net", "forest" or "boosting" (all runs in the same jobs), or "forest_ml" or "boosting_ml" (Spark ML, several runs at
    a time, for few large ones) with its options. A run whose training rows have one class, no event or no varying feature, or whose fit fails, gets null metrics and the reason
    as ``error``; the others go on.
    """
    kind, model = me.kind_of(kind), model or mo.model_for(kind)
    if (kind == "survival") != (model == "cox") or model not in ("cox", "logistic", "elastic_net", *mo.ENSEMBLES, *mo.ESTIMATORS):
        raise ValueError(f"no model {model!r} for {kind} tasks")
    rows = materialize(run_vectors(features, runs, keys=keys, fill=fill, vocab=vocab).join(target, "region_id"), "run-rows")
    train, test = rows.filter("role = 'train'"), rows.filter("role <> 'train'")
    sizes = runs.groupBy(*keys).agg(F.count_if(F.col("role") == "train").alias("n_train"), F.count_if(F.col("role") != "train").alias("n_val"))
    failed: dict[tuple, str] = {}
    if kind == "survival":
        checked = train.groupBy(*keys).agg((F.sum("event") > 0).alias("_ok"))
        why = "no event among the training rows"
    else:
        checked = train.groupBy(*keys).agg((F.count_distinct("label") > 1).alias("_ok"))
        why = "one class among the training rows"
    checked = materialize(checked, "usable-runs")
    train = train.join(checked.filter("_ok").select(*keys), keys, "left_semi")
    if kind == "survival":
        scores = me.concordance(mo.predict_risk(test, mo.fit_cox(train, keys=keys, failed=failed, **options), keys=keys), keys=keys)
    else:
        train = prep.balanced_weights(train, keys=keys)
        if model == "logistic" and kind == "binary":
            pred = mo.predict_logistic(test, mo.fit_logistic(train, keys=keys, failed=failed, **options), keys=keys).withColumn("truth", F.col("label"))
        elif model in ("logistic", "elastic_net", *mo.ENSEMBLES):
            classes = [r[0] for r in train.select("label").distinct().orderBy("label").collect()]  # the classes
            if model in mo.ENSEMBLES:
                proba = mo.ENSEMBLES[model](train, test.join(checked.filter("_ok").select(*keys), keys, "left_semi"), classes, keys=keys, **options)
            else:
                proba = mo.predict_softmax(test, mo.fit_softmax(train, classes, keys=keys, failed=failed, **options), classes, keys=keys)
        else:
            proba = mo.fit_predict_runs(materialize(train, "train-rows"), test, lambda n: mo.ESTIMATORS[model](**options), keys=keys, failed=failed)
        if kind == "binary":
            if model != "logistic":
                pred = proba.filter("class = 1").withColumnRenamed("proba", "score")
            scores = me.binary_metrics(pred, keys=keys)
        else:
            scores = me.balanced_accuracy(me.argmax_class(proba, keys=keys), keys=keys).join(me.macro_auc(proba, keys=keys), keys)
    schema = ", ".join(f"`{k}` {runs.schema[k].dataType.simpleString()}" for k in keys) + ", _text string"
    texts = F.broadcast(runs.sparkSession.createDataFrame([(*k, v) for k, v in failed.items()], schema))  # a row a failed run
    error = F.when(F.col("_ok").isNull(), "no feature varies among the training rows").when(~F.col("_ok"), why).otherwise(F.col("_text"))
    long = F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).alias("value")) for m in me.METRICS[kind]])
    found = sizes.join(scores, keys, "left").join(checked, keys, "left").join(texts, keys, "left").withColumn("error", error)
    return found.select(*keys, "n_train", "n_val", "error", F.inline(long)).select(*keys, "n_train", "n_val", "metric", "value", "error")


def prepared_features(table: DataFrame, featurise: Callable | None, normalization: dict | None) -> DataFrame:
    """The features of a pipeline, written once: ``table`` itself, or what ``featurise`` makes of it.

    ``featurise`` takes the table (cells or intensities) and gives (region_id, feature, value). With ``normalization`` (the options of
    `normalize.normalize`) the table has (region_id, marker, value) and its values are normalised before.
    """
    if normalization:
        table = normalize.normalize(table, keys=["region_id"], **normalization)
    if normalization and not featurise:
        raise ValueError("normalised intensities need a featuriser")
    return materialize((featurise(table) if featurise else table).select("region_id", "feature", "value"), "features")


def cross_validate(features: DataFrame, meta: DataFrame, target: DataFrame, *, kind: str, seeds: list[int], k: int = 5, stratify: str | None = None, cv_filter: str | None = None, featurise: Callable | None = None, normalization: dict | None = None, **options) -> DataFrame:
    """Patient-level folds for all seeds: (seed, fold, n_train, n_val, metric, value, error).

    ``cv_filter`` is a condition on the metadata, ignored if no row meets it. ``featurise`` and ``normalization`` are those of `prepared_features`, other
    options those of `evaluate`.
    """
    if featurise or normalization:
        features = prepared_features(features, featurise, normalization)
    meta = targets.filter_unless_empty(meta, cv_filter)
    patients = splits.patient_strata(meta, stratify) if stratify else meta.filter("patient_id IS NOT NULL").select("patient_id").distinct()
    folds = splits.fold_patients(patients, seeds=seeds, k=k, stratified=bool(stratify))
    runs = materialize(splits.assignments(meta, folds, k=k), "runs")
    return evaluate(features, runs, target, keys=["seed", "fold"], kind=kind, **options)


def cross_validate_task(features: DataFrame, meta: DataFrame, spec: dict, task_id: str, *, seeds: list[int], k: int = 5, **options) -> DataFrame:
    """`cross_validate` of a task as a spec states it: its rows, target, stratification and the spec's ``cv_filter``."""
    task = targets.find_task(spec, task_id)
    rows = targets.task_rows(meta, task)
    return cross_validate(features, rows, targets.build_target(rows, task), kind=task["type"], seeds=seeds, k=k, stratify=splits.stratify_column(task), cv_filter=spec.get("cv_filter"), **options)


def cohort_test(features: DataFrame, meta: DataFrame, target: DataFrame, *, kind: str, column: str, train: list, test: list, seeds: list[int], featurise: Callable | None = None, normalization: dict | None = None, **options) -> DataFrame:
    """A model of some cohorts tested on others: (seed, n_train, n_val, metric, value, error); no rows if either side is empty."""
    if featurise or normalization:
        features = prepared_features(features, featurise, normalization)
    roles = splits.both_sides(splits.cohort_roles(meta, column=column, train=train, test=test))
    runs = materialize(roles.withColumn("seed", F.explode(F.array(*[F.lit(s) for s in seeds]))), "runs")
    return evaluate(features, runs, target, keys=["seed"], kind=kind, **options)


def expression_features(expression: DataFrame, panel: DataFrame, *, normalization: dict | None = None) -> DataFrame:
    """Mean intensities by region of the markers of ``panel``, after the normalisation that a spec states (none if None)."""
    ready = normalize.normalize(expression, keys=["region_id"], **normalization) if normalization else expression
    return fe.mean_expression(ready, panel, keys=["region_id"])


def density_features(cells: DataFrame, polygons: DataFrame, *, mpp: float) -> DataFrame:
    """Tissue and tumour densities of all types and the tumour ratio, by region."""
    areas = materialize(spatial.areas_mm2(cells, polygons, mpp=mpp), "areas")
    vocab, out = fe.vocabulary(cells, keys=[]), fe.tumour_ratio(areas, keys=["region_id"])
    for kind in ("tissue", "tumour"):
        flags = spatial.inside_polygon(cells, polygons, kind=kind)
        out = out.unionByName(fe.densities(flags, areas.select("region_id", F.col(kind).alias("area_mm2")), vocab, keys=["region_id"], kind=kind))
    return out


def composition_features(cells: DataFrame) -> DataFrame:
    """Shares of all types in all regions, once for all folds."""
    return fe.composition(cells, fe.vocabulary(cells, keys=[]), keys=["region_id"])


def baseline(results: DataFrame) -> DataFrame:
    """Summary over runs with the printed score."""
    return me.with_score_text(me.summarize(results.withColumn("scheme", F.coalesce("scheme", F.lit("cv"))), keys=["task", "scheme"]))
