"""Leakage-free folds of patients and splits by cohort. Orders come from md5 of seed and key, so they are the same everywhere."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def hash_order(seed: Column | int, key: str) -> Column:
    return F.md5(F.concat_ws(":", F.lit(seed) if isinstance(seed, int) else seed.cast("string"), F.col(key).cast("string")).cast("binary"))


def patient_strata(meta: DataFrame, column: str) -> DataFrame:
    """(patient_id, stratum): the most frequent value of a patient's regions, the smallest of several; null patients drop out."""
    named = meta.filter(F.col("patient_id").isNotNull())
    return named.groupBy("patient_id").agg(F.mode(column, deterministic=True).alias("stratum"))


def stratify_column(task: dict) -> str:
    return task["event_col"] if task["type"].startswith("survival") else task["label_col"]


def fold_patients(patients: DataFrame, *, seeds: list[int], k: int, stratified: bool) -> DataFrame:
    """(seed, patient_id, fold): shuffled folds whose sizes differ by one at most, within strata if ``stratified``.

    Places in the order are found in 256 hash buckets first and joined up by the buckets' counts, so no task has to order all
    patients. With fewer than two patients there are no folds, with fewer than ``k`` as many folds as patients. A
    stratified split whose strata are all smaller than that falls back to the plain one.
    """
    seeded = patients.withColumn("seed", F.explode(F.array(*[F.lit(s) for s in seeds])))
    seeded = seeded.withColumn("_h", hash_order(F.col("seed"), "patient_id"))
    counts = patients.groupBy(*(["stratum"] if stratified else [])).agg(F.count("*").alias("_n"))
    whole = counts.agg(F.sum("_n").alias("_total"), F.max("_n").alias("_most"))
    seeded = seeded.crossJoin(F.broadcast(whole)).filter("_total >= 2")  # one row
    folds = F.least(F.lit(k), F.col("_total"))
    group = F.when(F.col("_most") >= folds, F.coalesce(F.col("stratum").cast("string"), F.lit(""))).otherwise("") if stratified else F.lit("")
    seeded = seeded.withColumn("_g", group).withColumn("_b", F.substring("_h", 1, 2))
    inside = F.row_number().over(Window.partitionBy("seed", "_g", "_b").orderBy("_h", "patient_id"))
    sizes = seeded.groupBy("seed", "_g", "_b").agg(F.count("*").alias("_c"))
    before = F.sum("_c").over(Window.partitionBy("seed").orderBy("_g", "_b")) - F.col("_c")  # at most 256 rows a stratum
    starts = sizes.withColumn("_start", before).drop("_c")
    placed = seeded.withColumn("_i", inside).join(starts, ["seed", "_g", "_b"])
    return placed.select("seed", "patient_id", ((F.col("_start") + F.col("_i") - 1) % folds).cast("int").alias("fold"))


def assignments(meta: DataFrame, folds: DataFrame, *, k: int) -> DataFrame:
    """(seed, fold, region_id, role) for every seed and fold: a region is in val where its patient is, else in train."""
    regions = meta.select("region_id", "patient_id").join(folds.withColumnRenamed("fold", "_own"), "patient_id")
    n = folds.groupBy("seed").agg((F.max("fold") + 1).alias("_k"))
    every = regions.join(F.broadcast(n), "seed").withColumn("fold", F.explode(F.sequence(F.lit(0), F.col("_k") - 1)))
    return every.select("seed", "fold", "region_id", F.when(F.col("_own") == F.col("fold"), "val").otherwise("train").alias("role"))


def cohort_roles(meta: DataFrame, *, column: str, train: list | None = None, test: list | None = None) -> DataFrame:
    """(region_id, role) by lists of cohorts; a list left out is everything that isn't in the other."""
    if train is None and test is None:
        raise ValueError("give train or test cohorts")
    c = F.col(column)
    in_train = c.isin(train) if train is not None else ~c.isin(test)
    in_test = c.isin(test) if test is not None else ~c.isin(train)
    role = F.when(in_train, "train").when(in_test, "test")
    return meta.select("region_id", role.alias("role")).filter(F.col("role").isNotNull())


def both_sides(roles: DataFrame) -> DataFrame:
    """The roles, or none of them if the train or the test side is empty."""
    sides = roles.agg(F.count_distinct("role").alias("_sides"))
    return roles.crossJoin(F.broadcast(sides)).filter("_sides = 2").drop("_sides")  # one row


def fold_path(patients: DataFrame, *, k: int, stratified: bool) -> DataFrame:
    """(patients, folds, path) of `fold_patients`: "none" for fewer than two patients, "stratified", or "plain", also as the fallback."""
    counts = patients.groupBy(*(["stratum"] if stratified else [])).agg(F.count("*").alias("_n"))
    total, folds = F.coalesce(F.sum("_n"), F.lit(0)), F.least(F.lit(k), F.coalesce(F.sum("_n"), F.lit(0)))
    path = F.when(total < 2, "none").when(F.lit(stratified) & (F.max("_n") >= folds), "stratified").otherwise("plain")
    return counts.agg(total.alias("patients"), F.when(total < 2, 0).otherwise(folds).cast("int").alias("folds"), path.alias("path"))
