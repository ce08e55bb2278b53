"""Preprocessing of long feature tables (run keys, region_id, role, feature, value), fitted on training rows only."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def fit_prep(features: DataFrame, *, keys: list[str]) -> DataFrame:
    """(keys, feature, median, mean, scale) of columns whose imputed training values vary (sample deviation over 0).

    ``value`` is null where it is missing, one row for each region and feature.
    """
    train = features.filter("role = 'train'")
    found = train.groupBy(*keys, "feature").agg(
        F.percentile("value", F.lit(0.5)).alias("median"), F.count("value").alias("_n"), F.count("*").alias("_all"), F.avg("value").alias("_avg"), F.var_pop("value").alias("_var"),
        (F.min("value") < F.max("value")).alias("_varies"))
    # Missing values, which become the median, move mean and deviation by their share.
    lacking = F.col("_all") - F.col("_n")
    mean = (F.col("_n") * F.col("_avg") + lacking * F.col("median")) / F.col("_all")
    squares = F.col("_n") * F.col("_var") + F.col("_n") * lacking / F.col("_all") * (F.col("_avg") - F.col("median")) ** 2
    return found.filter("_varies").select(*keys, "feature", "median", mean.alias("mean"), F.sqrt(squares / F.col("_all")).alias("scale"))


def apply_prep(features: DataFrame, fitted: DataFrame, *, keys: list[str]) -> DataFrame:
    """Imputed and standardised values of the kept columns, training and other rows alike."""
    out = features.join(fitted, [*keys, "feature"])
    return out.withColumn("value", (F.coalesce("value", "median") - F.col("mean")) / F.col("scale")).drop("median", "mean", "scale")


def assemble(features: DataFrame, *, keys: list[str]) -> DataFrame:
    """(keys, region_id, role, x): the values as an array in the order of feature names."""
    rows = F.array_sort(F.collect_list(F.struct("feature", "value")))  # no longer than the vocabulary
    return features.groupBy(*keys, "region_id", "role").agg(F.transform(rows, lambda e: e["value"]).alias("x"))


def balanced_weights(rows: DataFrame, *, keys: list[str], label: str = "label") -> DataFrame:
    """Add ``weight`` = n / (classes * n of the class), from counts by class joined back."""
    counts = rows.groupBy(*keys, label).agg(F.count("*").alias("_nc"))
    w = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(1))
    weights = counts.withColumn("weight", F.sum("_nc").over(w) / (F.count("*").over(w) * F.col("_nc"))).drop("_nc")
    return rows.join(F.broadcast(weights), [*keys, label])
