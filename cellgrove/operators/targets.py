"""Task rows, filters and targets of region metadata."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# What the task of a spec may be and say.
SURVIVAL = ("survival", "survival_regression")
TYPES = (*SURVIVAL, "binary", "binary_classification", "multiclass", "multiclass_classification")
TASK_KEYS = ("id", "name", "description", "type", "label_col", "positive_class", "time_col", "event_col", "row_filter", "drop_na_cols")


def row_filter(meta: DataFrame, condition: str | None) -> DataFrame:
    """Rows that meet a condition; ``a.notna()`` and ``a.isna()`` are read as null tests."""
    if not condition:
        return meta
    condition = re.sub(r"([\w.`]+)\.notna\(\)", r"\1 IS NOT NULL", condition)
    return meta.filter(re.sub(r"([\w.`]+)\.isna\(\)", r"\1 IS NULL", condition))


def filter_unless_empty(meta: DataFrame, condition: str | None) -> DataFrame:
    """The condition, ignored where it would leave no rows: decided by one count within the plan."""
    if not condition:
        return meta
    some = row_filter(meta, condition).agg((F.count("*") > 0).alias("_some"))
    hit = row_filter(meta.withColumn("_hit", F.lit(True)), condition)
    return hit.drop("_hit").unionByName(meta.crossJoin(F.broadcast(some.filter("NOT _some"))).drop("_some"))


def find_task(spec: dict, task_id: str) -> dict:
    """The task of a spec by its id."""
    found = [t for t in spec.get("tasks", []) if t.get("id") == task_id]
    if not found:
        raise KeyError(f"no task {task_id!r}; there are {[t.get('id') for t in spec.get('tasks', [])]}")
    return found[0]


def validate_task(meta: DataFrame, task: dict) -> None:
    """Raise for a task of unknown type, with keys that nothing reads, or with columns that the metadata lack."""
    if task.get("type") not in TYPES:
        raise ValueError(f"the task has the type {task.get('type')!r}")
    if unknown := sorted(set(task) - set(TASK_KEYS)):
        raise ValueError(f"the task has unknown keys {unknown}")
    for c in [*label_columns(task), *task.get("drop_na_cols", [])]:
        if c not in meta.columns:
            raise ValueError(f"the metadata have no column {c!r}")


def label_columns(task: dict) -> list[str]:
    wanted = ("time_col", "event_col") if task["type"] in SURVIVAL else ("label_col",)
    if missing := [k for k in wanted if not task.get(k)]:
        raise ValueError(f"a task of type {task['type']} needs {' and '.join(missing)}")
    return [task[k] for k in wanted]


def task_rows(meta: DataFrame, task: dict) -> DataFrame:
    """Rows of a task: its ``row_filter``, without rows that lack a label or a column in ``drop_na_cols``."""
    validate_task(meta, task)
    return row_filter(meta, task.get("row_filter")).na.drop(subset=[*label_columns(task), *task.get("drop_na_cols", [])])


def binary_target(label: Column, positive) -> Column:
    """1 where the label is the positive class, 0 elsewhere, also for null; both sides are compared as numbers or as text."""
    same = label.try_cast("double").eqNullSafe(F.lit(positive).cast("double")) if isinstance(positive, (int, float)) else label.cast("string").eqNullSafe(F.lit(str(positive)))
    return F.coalesce(same, F.lit(False)).cast("int")


def build_target(meta: DataFrame, task: dict, ids: DataFrame | None = None) -> DataFrame:
    """(region_id, label) or (region_id, time, event) of the asked regions.

    Unknown ids raise. Other columns of ``ids``, such as places in an order, stay.
    """
    rows, more = meta, []
    if ids is not None:
        require_known(ids, meta)
        more = [c for c in ids.columns if c != "region_id"]
        rows = ids.select("region_id", *[F.col(c).alias(f"_id_{c}") for c in more]).join(meta, "region_id")
    named = ["region_id", *[F.col(f"_id_{c}").alias(c) for c in more]]
    if task["type"] in SURVIVAL:
        return rows.select(*named, F.col(task["time_col"]).cast("double").alias("time"), F.col(task["event_col"]).cast("double").alias("event"))
    if task["type"].startswith("binary"):
        return rows.select(*named, binary_target(F.col(task["label_col"]), task["positive_class"]).alias("label"))
    return rows.select(*named, F.col(task["label_col"]).alias("label"))


def require_known(ids: DataFrame, known: DataFrame, *, on: str = "region_id") -> None:
    """Raise for ids that ``known`` lacks."""
    missing = [r[0] for r in ids.select(on).distinct().join(known.select(on), on, "left_anti").limit(5).collect()]
    if missing:
        raise KeyError(f"unknown {on}: {missing}")


def subset_cells(cells: DataFrame, chosen: DataFrame, *, new_region: str | None = None) -> DataFrame:
    """The chosen (region_id, cell_id), once each, as regions of their own if ``new_region`` is a suffix."""
    out = cells.join(chosen.select("region_id", "cell_id").distinct(), ["region_id", "cell_id"], "left_semi")
    return out if new_region is None else out.withColumn("region_id", F.concat(F.col("region_id").cast("string"), F.lit(new_region)))


def subset_polygons(polygons: DataFrame, chosen: DataFrame, *, new_region: str | None = None, use: str | DataFrame = "inherit") -> DataFrame:
    """Polygons of the regions of `subset_cells`: those of the regions they come from ("inherit"), none ("drop"), or a table that replaces them."""
    if isinstance(use, DataFrame):
        return use
    if use not in ("inherit", "drop"):
        raise ValueError(f"unknown use of polygons {use!r}")
    out = polygons.join(chosen.select("region_id").distinct(), "region_id", "left_semi").filter(F.lit(use == "inherit"))
    return out if new_region is None else out.withColumn("region_id", F.concat(F.col("region_id").cast("string"), F.lit(new_region)))


def load_regions(cells: DataFrame, ids: DataFrame) -> DataFrame:
    """The cells of the asked regions; an unknown region is an error."""
    require_known(ids, cells)
    return cells.join(ids.select("region_id").distinct(), "region_id", "left_semi")


def cell_counts(cells: DataFrame, *, keys: list[str]) -> DataFrame:
    return cells.groupBy(*keys).agg(F.count("*").alias("n_cells"))


def pixels(um: Column, mpp: float) -> Column:
    return um / F.lit(mpp)


def square_mm(pixel_area: Column, mpp: float) -> Column:
    return pixel_area * F.lit(mpp * mpp) / F.lit(1e6)
