"""Models fitted for all runs at once by iterated grouped sums (batched), or one large run by Spark ML.

Batched fits keep the run in the data: each Newton step is one job whose groups are runs, and the driver gets one small
gradient and Hessian a run (at most ``p`` x ``p`` numbers, p the vocabulary), never rows.
"""

from __future__ import annotations

from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor

import numpy as np
from pyspark import inheritable_thread_target
from pyspark.ml.classification import GBTClassifier, OneVsRest, RandomForestClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.errors import IllegalArgumentException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cellgrove.operators.blocks import packed, sums_by_run
from cellgrove.operators.boosting import boosting_predictions
from cellgrove.operators.linear import fit_cox, fit_softmax, logistic_sums, predict_softmax, widths  # noqa: F401
from cellgrove.operators.trees import forest_predictions
from cellgrove.scratch import materialize

CUTOFF = 1e-6


def _dot(beta: Column, x: Column) -> Column:
    return F.aggregate(F.zip_with(beta, x, lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v)


def _solve(h: np.ndarray, g: np.ndarray) -> np.ndarray:
    step = np.linalg.solve(h, g)
    if not np.isfinite(step).all():
        raise np.linalg.LinAlgError("the step isn't finite")
    return step


def fit_logistic(rows: DataFrame, *, keys: list[str], c: float = 1.0, max_iter: int = 25, failed: dict | None = None) -> DataFrame:
    """(keys, beta): L2 logistic regressions of (keys, x, label 0/1, weight), intercept first and not penalised.

    Minimises sum(weight * log loss) + |beta|^2 / (2 c), as Newton steps for all runs in one job each: a gradient and the upper half of
    a Hessian for each run, summed up as vectors. A run that can't be solved has no row and goes to ``failed`` with its error.
    """
    failed = {} if failed is None else failed
    rows = packed(rows.select(*keys, "x", F.col("label").cast("int").alias("label"), F.col("weight").cast("double").alias("weight")), keys=keys, columns=["label", "weight"])
    betas = {run: np.zeros(p + 1) for run, (p, _) in widths(rows, keys, "label").items()}
    done: dict[tuple, np.ndarray] = {}
    for _ in range(max_iter):
        if not betas:
            break
        now = dict(betas)
        sums = sums_by_run(rows, keys=keys, columns=["label", "weight"], of=lambda run, x, y, w: logistic_sums(now[run][None], x, y, w) if run in now else None)  # noqa: B023
        for k, v in sums.items():
            p = len(betas[k])
            pen = np.eye(p) / c
            pen[0, 0] = 1e-9
            try:
                step = _solve(v[p + 1 :].reshape(p, p) + pen, -v[1 : p + 1] - pen @ betas[k])
            except np.linalg.LinAlgError as e:
                failed[k] = str(e)
                del betas[k]
                continue
            betas[k] = betas[k] + step
            if float(np.abs(step).max()) < CUTOFF:  # a run that has ended takes no part in later steps
                done[k] = betas.pop(k)
    return _beta_table(rows, done | betas, keys)


def _beta_table(rows: DataFrame, betas: dict, keys: list[str]) -> DataFrame:
    schema = ", ".join(f"{k} {rows.schema[k].dataType.simpleString()}" for k in keys) + ", beta array<double>"
    return rows.sparkSession.createDataFrame([(*k, b.tolist()) for k, b in betas.items()], schema)


def predict_logistic(rows: DataFrame, betas: DataFrame, *, keys: list[str]) -> DataFrame:
    """Rows with ``score``, the probability of label 1."""
    z = _dot(F.col("beta"), F.concat(F.array(F.lit(1.0)), "x"))
    return rows.join(F.broadcast(betas), keys).withColumn("score", 1 / (1 + F.exp(-z))).drop("beta")


def predict_risk(rows: DataFrame, betas: DataFrame, *, keys: list[str]) -> DataFrame:
    """Rows with ``risk``, the partial hazard."""
    return rows.join(F.broadcast(betas), keys).withColumn("risk", F.exp(_dot(F.col("beta"), F.col("x")))).drop("beta")


def ml_rows(rows: DataFrame, classes: list | None = None) -> DataFrame:
    """(..., features, label) for Spark ML; labels become their place in ``classes``."""
    out = rows.withColumn("features", array_to_vector("x"))
    if classes is None:
        return out.withColumn("label", F.col("label").cast("double"))
    return out.withColumn("label", (F.array_position(F.array(*[F.lit(c) for c in classes]), F.col("label")) - 1).cast("double"))


def forest(*, trees: int = 300, max_depth: int = 15, seed: int = 0) -> RandomForestClassifier:
    return RandomForestClassifier(numTrees=trees, featureSubsetStrategy="sqrt", maxDepth=max_depth, weightCol="weight", seed=seed)


def boosting(*, rounds: int = 300, rate: float = 0.1, max_depth: int = 5, seed: int = 0) -> GBTClassifier:
    return GBTClassifier(maxIter=rounds, stepSize=rate, maxDepth=max_depth, weightCol="weight", seed=seed)


def fit_predict_ml(train: DataFrame, test: DataFrame, estimator, classes: list) -> DataFrame:
    """(region_id, truth, class, proba) of one run by a Spark ML classifier; boosting of several classes goes one against rest."""
    several = len(classes) > 2 and isinstance(estimator, GBTClassifier)
    name = F.array(*[F.lit(c) for c in classes])
    fit_rows, rows = ml_rows(train, classes), test.withColumn("features", array_to_vector("x"))
    if not several:
        scored = estimator.fit(fit_rows).transform(rows).select("region_id", F.col("label").alias("truth"), F.posexplode(vector_to_array("probability")).alias("i", "proba"))
    else:
        model = OneVsRest(classifier=estimator, weightCol="weight").fit(fit_rows)
        scored = None
        for i, m in enumerate(model.models):
            one = m.transform(rows).select("region_id", F.col("label").alias("truth"), F.lit(i).alias("i"), F.get(vector_to_array("probability"), F.lit(1)).alias("proba"))
            scored = one if scored is None else scored.union(one)
        total = F.sum("proba").over(Window.partitionBy("region_id"))
        scored = scored.withColumn("proba", F.col("proba") / total)
    return scored.select("region_id", "truth", F.get(name, F.col("i")).alias("class"), "proba")


#: Ensembles of trees for all runs at once: (train, test, classes) to probabilities.
ENSEMBLES = {"forest": forest_predictions, "boosting": boosting_predictions}
#: Models that the pipelines offer besides those of all runs at once: Spark ML estimators, fitted several runs at a time.
ESTIMATORS = {"forest_ml": forest, "boosting_ml": boosting}
#: Runs whose Spark ML jobs are under way at the same time.
RUNS_AT_ONCE = 8


def guarded(runs: list, one: Callable, *, session: SparkSession | None = None, at_once: int = RUNS_AT_ONCE) -> list[tuple]:
    """(run, result or None, error text or None) for each run: a run that fails doesn't end the others."""
    def attempt(r) -> tuple:
        try:
            return r, one(r), None
        except (ValueError, np.linalg.LinAlgError, IllegalArgumentException) as e:
            return r, None, str(e)

    with ThreadPoolExecutor(at_once) as pool:
        call = inheritable_thread_target(session)(attempt) if session else attempt
        return [f.result() for f in [pool.submit(call, r) for r in runs]]


def model_for(kind: str) -> str:
    """The model of a kind of task if none is asked for."""
    return "cox" if kind.startswith("survival") else "logistic"


def fit_predict_runs(train: DataFrame, test: DataFrame, make: Callable, *, keys: list[str], failed: dict | None = None) -> DataFrame:
    """(keys, region_id, truth, class, proba) of every run by the Spark ML classifier that ``make`` gives for the run's number of rows.

    Runs that fail have no rows and go to ``failed``. Predictions of a run are written when its model is fitted.
    """
    info = train.groupBy(*keys).agg(F.count("*").alias("n"), F.array_sort(F.collect_set("label")).alias("classes")).collect()  # one row a run
    names = ", ".join(f"`{k}` {train.schema[k].dataType.simpleString()}" for k in keys)
    label = train.schema["label"].dataType.simpleString()
    out = train.sparkSession.createDataFrame([], f"{names}, region_id {train.schema['region_id'].dataType.simpleString()}, truth {label}, class {label}, proba double")
    same = lambda df, r: df.filter(_all_equal([F.col(k).eqNullSafe(F.lit(r[k])) for k in keys]))
    own = lambda r: fit_predict_ml(same(train, r).drop(*keys), same(test, r).drop(*keys), make(r["n"]), r["classes"])
    one = lambda r: materialize(own(r).select(*[F.lit(r[k]).cast(train.schema[k].dataType).alias(k) for k in keys], "*"), "run-predictions")
    for r, scored, error in guarded(info, one, session=train.sparkSession):
        if scored is not None:
            out = out.unionByName(scored)
        elif failed is not None:
            failed[tuple(r[k] for k in keys)] = error
    return out


def _all_equal(conditions: list[Column]) -> Column:
    out = F.lit(True)
    for c in conditions:
        out = out & c
    return out
