"""Exact metrics by run keys. Ranks come from counts by distinct score, so that ties and large runs need no pairs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellgrove.operators.ranks import dense_ranks, running_sums
from cellgrove.scratch import materialize

# Metrics of each kind of task, and the one that is reported first.
PRIMARY = {"survival": "c_index", "survival_regression": "c_index", "binary": "auc_roc", "binary_classification": "auc_roc", "multiclass": "balanced_acc", "multiclass_classification": "balanced_acc"}
METRICS = {"survival": ["c_index"], "binary": ["auc_roc", "avg_precision", "balanced_acc"], "multiclass": ["balanced_acc", "macro_auc"]}


def kind_of(task_type: str) -> str:
    """survival, binary or multiclass, for any name of the type."""
    return task_type.split("_")[0]


def _by_score(pred: DataFrame, keys: list[str]) -> DataFrame:
    """Counts by distinct score, with those of the scores from there up and of all."""
    counts = pred.groupBy(*keys, "score").agg(F.sum("truth").alias("_ones"), F.sum(1 - F.col("truth")).alias("_zeros"))
    ranked = running_sums(counts, keys=keys, order=["score"], sums=["_ones", "_zeros"], descending=True)
    totals = ranked.groupBy(*keys).agg(F.sum("_ones").alias("_pos"), F.sum("_zeros").alias("_neg"))
    return ranked.join(totals, keys).select(*keys, "_ones", "_zeros", F.col("upto__ones").alias("_tp"), F.col("upto__zeros").alias("_fp"), "_pos", "_neg")


def rank_metrics(pred: DataFrame, *, keys: list[str]) -> DataFrame:
    """(keys, auc_roc, avg_precision) of (keys, truth 0/1, score); null with one class.

    Ties count half in the area under the curve; the average precision is the sum of recall steps times precision.
    """
    c = _by_score(pred, keys)
    wins = F.sum(F.col("_ones") * (F.col("_neg") - F.col("_fp") + F.col("_zeros") / 2.0))
    precision = F.sum(F.when(F.col("_pos") > 0, F.col("_ones") / F.col("_pos") * F.col("_tp") / (F.col("_tp") + F.col("_fp"))))
    both = (F.col("_pos") > 0) & (F.col("_neg") > 0)
    out = c.groupBy(*keys, "_pos", "_neg").agg(wins.alias("_w"), precision.alias("_ap"))
    return out.select(*keys, F.when(both, F.col("_w") / (F.col("_pos") * F.col("_neg"))).alias("auc_roc"), F.when(both, F.col("_ap")).alias("avg_precision"))


def roc_auc(pred: DataFrame, *, keys: list[str]) -> DataFrame:
    """(keys, auc_roc) of `rank_metrics`."""
    return rank_metrics(pred, keys=keys).select(*keys, "auc_roc")


def average_precision(pred: DataFrame, *, keys: list[str]) -> DataFrame:
    """(keys, avg_precision) of `rank_metrics`."""
    return rank_metrics(pred, keys=keys).select(*keys, "avg_precision")


def balanced_accuracy(pred: DataFrame, *, keys: list[str], truth: str = "truth", predicted: str = "predicted") -> DataFrame:
    """(keys, balanced_acc): mean recall of the classes that the truth has."""
    recall = pred.groupBy(*keys, truth).agg(F.avg((F.col(truth) == F.col(predicted)).cast("double")).alias("_r"))
    return recall.groupBy(*keys).agg(F.avg("_r").alias("balanced_acc"))


def binary_metrics(pred: DataFrame, *, keys: list[str]) -> DataFrame:
    """(keys, auc_roc, avg_precision, balanced_acc at score > 0.5)."""
    hard = pred.withColumn("predicted", (F.col("score") > 0.5).cast("int"))
    return balanced_accuracy(hard, keys=keys).join(rank_metrics(pred, keys=keys), keys)


def argmax_class(proba: DataFrame, *, keys: list[str]) -> DataFrame:
    """(keys, region_id, truth, predicted): the class with the highest probability, the first in order of several."""
    best = F.min(F.struct((-F.col("proba")).alias("p"), F.col("class").alias("c")))
    return proba.groupBy(*keys, "region_id", "truth").agg(best.alias("_b")).select(*keys, "region_id", "truth", F.col("_b.c").alias("predicted"))


def macro_auc(proba: DataFrame, *, keys: list[str]) -> DataFrame:
    """(keys, macro_auc): the mean one-against-rest AUC over classes; null if one is undefined."""
    each = proba.select(*keys, "class", (F.col("truth") == F.col("class")).cast("int").alias("truth"), F.col("proba").alias("score"))
    a = roc_auc(each, keys=[*keys, "class"])
    return a.groupBy(*keys).agg(F.when(F.count("auc_roc") == F.count("*"), F.avg("auc_roc")).alias("macro_auc"))


def concordance(pred: DataFrame, *, keys: list[str]) -> DataFrame:
    """(keys, c_index) of (keys, time, event, risk); null without comparable pairs.

    A pair counts if the earlier subject has the event, or at equal times if exactly one has it; risk ties count half.

    No pair is made. Subjects have dense ranks of (time, event first) and of risk in their run. Two time ranks differ first in one bit: for each bit
    the ranks that agree in all higher bits are a group, those with 0 there come before those with 1, and a running sum over risks
    counts for each event among the former how many of the latter have a lower risk. Rows with the same risk in a group are
    added up before, so n rows make at most n rows a bit, however many share a time or a risk.
    """
    counts = pred.groupBy(*keys, "time", (F.col("event") == 1).alias("_event"), "risk").agg(F.count("*").alias("_n"))
    counts = materialize(counts.withColumn("_open", F.coalesce(~F.col("_event"), F.lit(True)).cast("int")).drop("_event"), "subjects")
    times = dense_ranks(counts, keys=keys, order=["time", "_open"], name="_t")
    risks = dense_ranks(counts, keys=keys, order=["risk"], name="_r")
    bits = times.groupBy(*keys).agg(F.length(F.bin(F.max("_t"))).alias("_bits"))  # a row a run
    ranked = counts.join(times, [*keys, "time", "_open"]).join(risks, [*keys, "risk"]).join(bits, keys)
    each = ranked.select(*keys, "_t", "_r", "_open", "_n", F.explode(F.sequence(F.lit(0), F.col("_bits") - 1)).alias("_bit"))
    later = F.expr("shiftright(_t, _bit) & 1") == 1
    halves = each.select(
        *keys, "_bit", F.expr("shiftright(_t, _bit + 1)").alias("_prefix"), "_r",
        F.when(~later & (F.col("_open") == 0), F.col("_n")).otherwise(0).alias("_events"), F.when(later, F.col("_n")).otherwise(0).alias("_later"))
    group = [*keys, "_bit", "_prefix"]
    halves = halves.filter("_events > 0 OR _later > 0").groupBy(*group, "_r").agg(F.sum("_events").alias("_events"), F.sum("_later").alias("_later"))
    sums = running_sums(halves, keys=group, order=["_r"], sums=["_later"])
    good = F.sum(F.col("_events") * (F.col("upto__later") - F.col("_later") / 2.0))
    of_group = sums.groupBy(*group).agg(good.alias("_good"), (F.sum("_events").cast("double") * F.sum("_later")).alias("_pairs"))
    total = of_group.groupBy(*keys).agg(F.sum("_good").alias("_good"), F.sum("_pairs").alias("_pairs"))
    found = total.select(*keys, F.when(F.col("_pairs") > 0, F.col("_good") / F.col("_pairs")).alias("c_index"))
    return bits.select(*keys).join(found, keys, "left")


def null_metrics(runs: DataFrame, kind: str) -> DataFrame:
    """(..., metric, value) of runs that failed: null for each metric of the kind of task."""
    return runs.withColumn("metric", F.explode(F.array(*[F.lit(m) for m in METRICS[kind_of(kind)]]))).withColumn("value", F.lit(None).cast("double"))


def primary(scores: DataFrame, task_types: dict[str, str]) -> DataFrame:
    """The rows of each task's primary metric; ``task_types`` has the type of each task."""
    wanted = F.create_map(*[x for t, kind in task_types.items() for x in (F.lit(t), F.lit(PRIMARY[kind]))])
    return scores.filter(F.col("metric") == wanted[F.col("task")])


def summarize(scores: DataFrame, *, keys: list[str]) -> DataFrame:
    """(keys, metric, mean, sd, n) of (keys, metric, value): nulls are skipped but counted in n; one value has sd 0."""
    sd = F.when(F.count("value") == 1, 0.0).otherwise(F.stddev_samp("value"))
    return scores.groupBy(*keys, "metric").agg(F.avg("value").alias("mean"), sd.alias("sd"), F.count("*").alias("n"))


def with_score_text(summary: DataFrame) -> DataFrame:
    return summary.withColumn("score", F.format_string("%.3f ± %.3f", "mean", "sd"))
