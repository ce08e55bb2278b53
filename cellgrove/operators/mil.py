"""Multiple-instance learning: neighbourhoods of sampled cells as instances of a region."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cellgrove.operators import features as fe
from cellgrove.operators import metrics as me
from cellgrove.operators import models, pipelines, prep, splits
from cellgrove.operators.spatial import close_pairs, neighbourhood, sides
from cellgrove.scratch import materialize


def focal_cells(cells: DataFrame, *, n_samples: int | None = 16, sample_ratio: float | None = None, seed: int = 0) -> DataFrame:
    """(region_id, cell_id) of a sample of each region in the order of md5(seed:cell_id): n_samples, or ceil(ratio * n), 1 at least."""
    order = F.md5(F.concat_ws(":", F.lit(seed), F.col("cell_id").cast("string")).cast("binary"))
    k = F.lit(n_samples) if sample_ratio is None else F.greatest(F.lit(1), F.ceil(F.col("_n") * sample_ratio))
    region = Window.partitionBy("region_id")
    ranked = cells.select("region_id", "cell_id", F.row_number().over(region.orderBy(order, "cell_id")).alias("_r"), F.count("*").over(region).alias("_n"))
    return ranked.filter(F.col("_r") <= k).select("region_id", "cell_id")


def instances(cells: DataFrame, focal: DataFrame, *, radius_um: float = 100.0, mpp: float = 1.0, min_cells: int = 10) -> DataFrame:
    """(region_id, instance_id, cell_id, cell_type): members of the neighbourhoods that have ``min_cells`` cells."""
    members = neighbourhood(cells, focal, radius_um=radius_um, mpp=mpp).withColumn("instance_id", F.concat_ws("#inst", F.col("region_id").cast("string"), F.col("focal_cell_id").cast("string")))
    full = members.groupBy("region_id", "instance_id").agg(F.count("*").alias("_n")).filter(F.col("_n") >= min_cells).select("region_id", "instance_id")
    return members.join(full, ["region_id", "instance_id"], "left_semi").select("region_id", "instance_id", "cell_id", "cell_type")


def pool(proba: DataFrame, regions: DataFrame, classes: list, *, agg: str = "mean", keys: tuple[str, ...] = ("region_id",)) -> DataFrame:
    """(keys, class, proba) from (keys, instance_id, class, proba): mean, or max scaled to sum 1; uniform without instances."""
    if agg not in ("mean", "max"):
        raise ValueError(f"unknown pooling {agg!r}")
    p = proba.groupBy(*keys, "class").agg((F.avg if agg == "mean" else F.max)("proba").alias("proba"))
    if agg == "max":
        p = p.withColumn("proba", F.col("proba") / F.sum("proba").over(Window.partitionBy(*keys)))
    grid = regions.select(*keys).distinct().withColumn("class", F.explode(F.array(*[F.lit(c) for c in classes])))
    return grid.join(p, [*keys, "class"], "left").withColumn("proba", F.coalesce("proba", F.lit(1.0 / len(classes))))


def bag_labels(instances: DataFrame, labels: DataFrame) -> DataFrame:
    """(region_id, instance_id, label): each instance has the label of its region."""
    return instances.select("region_id", "instance_id").distinct().join(labels.select("region_id", "label"), "region_id")


#: Options of a variant with fixed default values: neighbourhoods a region, radius in micrometres, fewest cells, pooling and the seed of the draw.
N_SAMPLES, RADIUS_UM, MIN_CELLS, AGG, DRAW = 16, 100.0, 10, "mean", 0
KEYS = ["variant", "seed", "fold"]
ONE_CLASS = "no training instances of two classes"


def draws(cells: DataFrame, views: list[dict], only: set[int] | None = None) -> DataFrame:
    """(region_id, cell_id, _views): the focal cells of all views (or of those whose numbers are in ``only``), each with the views (number, squared radius) that take it.

    Draws of one seed are nested: a smaller sample is the beginning of a larger one. ``n_samples`` of at most 1 is a share of a region's cells, one cell at least.
    """
    region, out = Window.partitionBy("region_id"), None
    numbered = [(i, v) for i, v in enumerate(views) if only is None or i in only]
    for seed in sorted({v["draw"] for _, v in numbered}):
        order = F.md5(F.concat_ws(":", F.lit(seed), F.col("cell_id").cast("string")).cast("binary"))
        ranked = cells.select("region_id", "cell_id", F.row_number().over(region.orderBy(order, "cell_id")).alias("_r"), F.count("*").over(region).alias("_n"))
        size = lambda v: F.greatest(F.lit(1), F.ceil(F.col("_n") * v["n_samples"])) if v["n_samples"] <= 1 else F.lit(int(v["n_samples"]))
        takes = F.array_compact(F.array(*[F.when(F.col("_r") <= size(v), F.struct(F.lit(i).alias("view"), F.lit(v["radius"] ** 2).alias("r2"))) for i, v in numbered if v["draw"] == seed]))
        own = ranked.select("region_id", "cell_id", takes.alias("_views")).filter(F.size("_views") > 0)
        out = own if out is None else out.unionByName(own)
    return out.groupBy("region_id", "cell_id").agg(F.flatten(F.collect_list("_views")).alias("_views"))


#: The name of an instance, from its view, region and focal cell.
_INSTANCE = "format_string('v%d:%s#inst%s', view, CAST(region_id AS STRING), CAST(a_id AS STRING))"


def _full(sized: DataFrame, views: list[dict], n: Column) -> DataFrame:
    """(view, region_id, a_id) of the neighbourhoods that have their view's ``min_cells``; ``n`` counts cells."""
    least = F.element_at(F.array(*[F.lit(v["min_cells"]) for v in views]), F.col("view") + 1)
    return sized.groupBy("view", "region_id", "a_id").agg(n.alias("_n")).filter(F.col("_n") >= least).drop("_n")


def view_instances(cells: DataFrame, views: list[dict], only: set[int] | None = None) -> DataFrame:
    """(view, region_id, instance_id, cell_id, cell_type): the neighbourhoods of all views (or of those in ``only``) that have the view's ``min_cells``, from one join of close cells.

    The join has the largest radius; pairs count for the views whose radius holds them.
    """
    a, b = sides(cells)
    focal = draws(cells, views, only).withColumnRenamed("cell_id", "a_id")
    chosen = a.select("region_id", "a_id", "ax", "ay").join(focal, ["region_id", "a_id"])
    largest = max(v["radius"] for i, v in enumerate(views) if only is None or i in only)
    near = close_pairs(chosen, b, largest).withColumn("_v", F.explode(F.filter("_views", lambda v: v["r2"] >= F.col("d2"))))
    members = near.select(F.col("_v.view").alias("view"), "region_id", "a_id", F.col("b_id").alias("cell_id"), F.col("b_type").alias("cell_type"))
    members = members.join(_full(members, views, F.count("*")), ["view", "region_id", "a_id"], "left_semi")
    return members.select("view", "region_id", F.expr(_INSTANCE).alias("instance_id"), "cell_id", "cell_type")


def view_counts(cells: DataFrame, views: list[dict]) -> DataFrame:
    """(view, region_id, instance_id, cell_type, n): the cells of each type in the instances of `view_instances`, whose members aren't written.

    Pairs of the join are counted by focal cell, type and the smallest radius that holds them in the task that finds them, so what leaves a task doesn't grow with the
    density of cells; views take their share of these counts.
    """
    a, b = sides(cells)
    focal = materialize(draws(cells, views).withColumnRenamed("cell_id", "a_id"), "focal-cells")
    chosen = a.select("region_id", "a_id", "ax", "ay").join(focal, ["region_id", "a_id"], "left_semi")
    radii = sorted({v["radius"] for v in views})
    band = F.coalesce(*[F.when(F.col("d2") <= r * r, F.lit(r**2)) for r in radii])
    near = close_pairs(chosen, b.select("region_id", "b_type", "bx", "by"), radii[-1])
    counts = near.groupBy("region_id", "a_id", F.col("b_type").alias("cell_type"), band.alias("_band")).agg(F.count("*").alias("n"))
    taken = counts.join(focal, ["region_id", "a_id"]).withColumn("_v", F.explode(F.filter("_views", lambda v: v["r2"] >= F.col("_band"))))
    by_type = materialize(taken.groupBy(F.col("_v.view").alias("view"), "region_id", "a_id", "cell_type").agg(F.sum("n").alias("n")), "instance-counts")
    full = by_type.join(_full(by_type, views, F.sum("n")), ["view", "region_id", "a_id"], "left_semi")
    return full.select("view", "region_id", F.expr(_INSTANCE).alias("instance_id"), "cell_type", "n")


def variant_name(v: dict) -> str:
    """The ``name`` of a variant, else its options."""
    return v.get("name") or ", ".join(f"{k}={getattr(x, '__name__', x)}" for k, x in sorted(v.items()) if k != "options")


def sweep(cells: DataFrame, meta: DataFrame, variants: list[dict], *, seeds: list[int], k: int = 5, mpp: float = 1.0, **fixed) -> DataFrame:
    """(variant, seed, fold, metrics, error): models of instances, scored by region, for all variants, seeds and folds in the same jobs.

    A variant may state ``name``, ``n_samples`` (a share if at most 1), ``predict_samples``, ``radius_um``, ``min_cells``, ``agg``, ``draw``, ``featurise``, ``fill``, ``model``
    ("logistic", "forest" or "boosting") and the model's ``options``; ``fixed`` are those of all. ``meta`` has (region_id, patient_id, label), two or more classes; folds are of patients.
    Training regions draw focal cells by the seed ``draw``, scored regions by the next one. ``featurise`` makes (instance_id, feature, value) of
    (view, region_id, instance_id, cell_id, cell_type), by default their composition. Neighbours are counted by one join, whatever the number of variants, and one more gives the members of the views that
    have a featuriser; features are made once
    for each featuriser and models fitted once for each kind. A scored region without an instance gets equal probabilities. A run without training
    instances of two classes has null metrics and the reason; so have all runs of labels with one class or none, and metrics are those of two classes then.
    """
    asked = [{"n_samples": N_SAMPLES, "radius_um": RADIUS_UM, "min_cells": MIN_CELLS, "agg": AGG, "draw": DRAW, "featurise": None, "fill": 0.0, "model": "logistic", "options": {}} | fixed | v for v in variants]
    names = [variant_name(v) for v in variants]
    if len(set(names)) < len(names):
        raise ValueError("two variants have the same name")
    if bad := {v["model"] for v in asked} - {"logistic", *models.ENSEMBLES}:
        raise ValueError(f"no model of instances {sorted(bad)}")
    if bad := {v["agg"] for v in asked} - {"mean", "max"}:
        raise ValueError(f"unknown pooling {sorted(bad)}")
    views: list[dict] = []

    def view(v: dict, n: float, draw: int) -> int:
        own = {"n_samples": n, "radius": v["radius_um"] / mpp, "min_cells": v["min_cells"], "draw": draw}
        if own not in views:
            views.append(own)
        return views.index(own)

    used = [(name, role, i) for name, v in zip(names, asked) for role, i in (("train", view(v, v["n_samples"], v["draw"])), ("val", view(v, v.get("predict_samples") or v["n_samples"], v["draw"] + 1)))]
    spark = cells.sparkSession
    cells = cells.join(meta.select("region_id").distinct(), "region_id", "left_semi")
    classes = [r[0] for r in meta.select("label").dropna().distinct().orderBy("label").collect()]  # the classes
    kind = "multiclass" if len(classes) > 2 else "binary"
    folds = splits.fold_patients(splits.patient_strata(meta, "label"), seeds=seeds, k=k, stratified=True)
    roles = materialize(splits.assignments(meta, folds, k=k), "mil-roles")
    by_role = spark.createDataFrame(used, "variant string, role string, view int")  # two rows a variant
    wanted = roles.join(F.broadcast(by_role), "role").select(*KEYS, "region_id", "role", "view")
    every = roles.select("seed", "fold").distinct().join(F.broadcast(by_role.select("variant").distinct()), how="cross").select(*KEYS)
    if len(classes) < 2:
        return every.select(*KEYS, *[F.lit(None).cast("double").alias(m) for m in me.METRICS[kind]], F.lit(ONE_CLASS).alias("error"))
    counts = materialize(view_counts(cells, views), "instances")
    bags = materialize(counts.select("view", "region_id", "instance_id").distinct().join(meta.select("region_id", "label"), "region_id"), "bags")
    made = {names.index(n) for n, v in zip(names, asked) if v["featurise"]}
    members = None
    if made:
        members = materialize(view_instances(cells, views, {i for n, _, i in used if names.index(n) in made}), "instance-members")
    runs = materialize(wanted.join(bags.withColumnRenamed("region_id", "bag"), (F.col("region_id") == F.col("bag")) & (wanted["view"] == bags["view"])).select(*KEYS, "bag", F.col("instance_id").alias("region_id"), "role", "label"), "mil-runs")
    usable = runs.filter("role = 'train'").groupBy(*KEYS).agg(F.count_distinct("label").alias("_classes"))
    usable = materialize(usable.filter("_classes > 1").select(*KEYS), "mil-usable")
    proba, failed = None, {}
    for f, fill in {(v["featurise"], v["fill"]) for v in asked}:
        own = [(n, v) for n, v in zip(names, asked) if (v["featurise"], v["fill"]) == (f, fill)]
        found = f(members) if f else fe.composition_of_counts(counts, fe.vocabulary(counts, keys=[]), keys=["instance_id"])
        found = materialize(found.select(F.col("instance_id").alias("region_id"), "feature", "value"), "instance-features")
        part = runs.filter(F.col("variant").isin([n for n, _ in own])).join(usable, KEYS, "left_semi")
        ready = pipelines.run_vectors(found, part, keys=KEYS, fill=fill)
        rows = materialize(ready.join(part.select(*KEYS, "region_id", "role", "label", "bag"), [*KEYS, "region_id", "role"]), "mil-rows")
        kinds: list[tuple] = []
        for _, v in own:
            if (v["model"], v["options"]) not in kinds:
                kinds.append((v["model"], v["options"]))
        for model, options in kinds:
            same = rows.filter(F.col("variant").isin([n for n, v in own if (v["model"], v["options"]) == (model, options)]))
            train, test = prep.balanced_weights(same.filter("role = 'train'"), keys=KEYS), same.filter("role = 'val'")
            if model == "logistic":
                one = models.predict_softmax(test, models.fit_softmax(train, classes, keys=KEYS, failed=failed, **options), classes, keys=KEYS)
            else:
                one = models.ENSEMBLES[model](train, test, classes, keys=KEYS, **options)
            one = one.select(*KEYS, F.col("region_id").alias("instance_id"), "class", "proba")
            proba = one if proba is None else proba.unionByName(one)
    proba = proba.join(runs.filter("role = 'val'").select(*KEYS, "bag", F.col("region_id").alias("instance_id")), [*KEYS, "instance_id"])
    proba = materialize(proba.select(*KEYS, F.col("bag").alias("region_id"), "instance_id", "class", "proba"), "instance-scores")
    texts = F.broadcast(spark.createDataFrame([(*r, t) for r, t in failed.items()], "variant string, seed int, fold int, _text string"))  # a row a failed run
    every = every.join(usable.withColumn("_ok", F.lit(True)), KEYS, "left").join(texts, KEYS, "left")
    every = every.withColumn("error", F.when(F.col("_ok").isNull(), ONE_CLASS).otherwise(F.col("_text"))).drop("_ok", "_text")
    truth = wanted.filter("role = 'val'").join(every.filter("error IS NULL").select(*KEYS), KEYS, "left_semi").join(meta.select("region_id", F.col("label").alias("truth")), "region_id").select(*KEYS, "region_id", "truth")
    pooled = None
    for agg in {v["agg"] for v in asked}:
        of_agg = F.col("variant").isin([n for n, v in zip(names, asked) if v["agg"] == agg])
        one = pool(proba.filter(of_agg), truth.filter(of_agg), classes, agg=agg, keys=(*KEYS, "region_id"))
        pooled = one if pooled is None else pooled.unionByName(one)
    scored = materialize(truth.join(pooled, [*KEYS, "region_id"]), "bag-scores")
    if len(classes) == 2:
        hits = scored.filter(F.col("class") == classes[1]).select(*KEYS, (F.col("truth") == classes[1]).cast("int").alias("truth"), F.col("proba").alias("score"))
        scores = me.binary_metrics(hits, keys=KEYS)
    else:
        scores = me.balanced_accuracy(me.argmax_class(scored, keys=KEYS), keys=KEYS).join(me.macro_auc(scored, keys=KEYS), KEYS, "left")
    return every.join(scores, KEYS, "left").select(*KEYS, *me.METRICS[kind], "error")


def cross_validate(cells: DataFrame, meta: DataFrame, *, seeds: list[int], **options) -> DataFrame:
    """`sweep` of one variant: (seed, fold, metrics, error)."""
    steps = {n: options.pop(n) for n in ("k", "mpp") if n in options}
    return sweep(cells, meta, [options | {"name": "one"}], seeds=seeds, **steps).drop("variant")
