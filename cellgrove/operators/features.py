"""Region features in long form (keys, feature, value). ``keys`` may be regions, instances or runs."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

#: States of a group that a task of `custom_merged` holds before it merges them, and groups it holds before it sends them on.
HELD_STATES, HELD_GROUPS = 16, 1000
#: Tasks that share the first merge of a group's states.
MERGE_SALTS = 32


def type_column(df: DataFrame, wanted: str | None) -> str:
    """The configured type column, else ``cell_type``, else an error."""
    for c in (wanted, "cell_type"):
        if c and c in df.columns:
            return c
    raise ValueError("there is no cell type column")


def vocabulary(cells: DataFrame, *, keys: list[str], type_col: str = "cell_type") -> DataFrame:
    """(keys, cell_type): the types that the cells of each run have; nulls don't count."""
    return cells.filter(F.col(type_col).isNotNull()).select(*keys, F.col(type_col).alias("cell_type")).distinct()


def composition(cells: DataFrame, vocab: DataFrame, *, keys: list[str], type_col: str = "cell_type") -> DataFrame:
    """Share of each type of ``vocab`` (cell_type) among all typed cells; 0 where absent or without typed cells."""
    counts = cells.groupBy(*keys, F.col(type_col).alias("cell_type")).agg(F.count("*").alias("n"))
    return composition_of_counts(counts, vocab, keys=keys)


def composition_of_counts(counts: DataFrame, vocab: DataFrame, *, keys: list[str]) -> DataFrame:
    """`composition` of counted cells (keys, cell_type, n), a row a group and type."""
    counts = counts.select(*keys, F.col("cell_type").alias("feature"), F.col("n").alias("_n"))
    # One map of counts a group, then the vocabulary is laid out within the row: no join of groups and types.
    typed = F.filter(F.collect_list(F.struct("feature", "_n")), lambda e: e["feature"].isNotNull())
    groups = counts.groupBy(*keys).agg(F.map_from_entries(typed).alias("_counts"))
    types = vocab.select("cell_type").distinct().agg(F.array_sort(F.collect_set("cell_type")).alias("_types"))  # the vocabulary, not the cells
    total = F.aggregate(F.map_values("_counts"), F.lit(0).cast("long"), lambda a, x: a + x)
    laid = groups.crossJoin(F.broadcast(types)).withColumn("_total", total)
    share = lambda t: F.struct(t.alias("feature"), F.when(F.col("_total") > 0, F.coalesce(F.try_element_at("_counts", t), F.lit(0)) / F.col("_total")).otherwise(0.0).alias("value"))
    return laid.select(*keys, F.inline(F.transform("_types", share)))


def marker_panel(expression: DataFrame, *, keys: list[str]) -> DataFrame:
    """(marker): those that every group has."""
    by_marker = expression.select(*keys, "marker").distinct().groupBy("marker").agg(F.count("*").alias("_n"))
    groups = expression.select(*keys).distinct().agg(F.count("*").alias("_all"))
    return by_marker.crossJoin(F.broadcast(groups)).filter("_n = _all").select("marker")


def mean_expression(expression: DataFrame, panel: DataFrame, *, keys: list[str]) -> DataFrame:
    """Mean of each marker of the panel, nulls skipped."""
    return expression.join(F.broadcast(panel), "marker", "left_semi").groupBy(*keys, F.col("marker").alias("feature")).agg(F.avg("value").alias("value"))


def shared_panel(train: DataFrame, test: DataFrame, *, keys: list[str]) -> DataFrame:
    """The panel over both sides; none if either is empty."""
    both = train.select(*keys, "marker").union(test.select(*keys, "marker"))
    some = train.limit(1).select(F.lit(1).alias("_a")).crossJoin(test.limit(1).select(F.lit(1).alias("_b")))
    return marker_panel(both, keys=keys).join(F.broadcast(some), how="cross").select("marker")


def wide_table(features: DataFrame, names: list[str], *, keys: list[str]) -> DataFrame:
    """A row a group, a column a feature, in the order of ``names``."""
    return features.groupBy(*keys).pivot("feature", names).agg(F.first("value"))


def align_types(coordinates: DataFrame, types: DataFrame) -> DataFrame:
    """Coordinates with the type of the cell, null where it has none."""
    return coordinates.join(types, ["region_id", "cell_id"], "left")


def densities(flags: DataFrame, areas: DataFrame, vocab: DataFrame, *, keys: list[str], kind: str) -> DataFrame:
    """Thousands of cells a mm2 within polygons of ``kind``, by type: (keys, feature, value).

    ``flags`` has (keys, cell_type, inside), ``areas`` (keys, area_mm2) for all groups, null where there is no polygon.
    Null without a polygon or with an area of 0.
    """
    counts = flags.groupBy(*keys, "cell_type").agg(F.count_if("inside").alias("_n"))
    grid = areas.select(*keys, "area_mm2").crossJoin(F.broadcast(vocab.select("cell_type").distinct()))
    value = F.when(F.col("area_mm2") > 0, F.coalesce("_n", F.lit(0)) / 1000.0 / F.col("area_mm2"))
    return grid.join(counts, [*keys, "cell_type"], "left").select(*keys, F.concat(F.lit(f"{kind}_density_"), "cell_type").alias("feature"), value.alias("value"))


def tumour_ratio(areas: DataFrame, *, keys: list[str]) -> DataFrame:
    """Tumour area over tissue area from (keys, tissue, tumour): null without usable tissue, 0 without tumour."""
    value = F.when(F.col("tissue") > 0, F.coalesce("tumour", F.lit(0.0)) / F.col("tissue"))
    return areas.select(*keys, F.lit("tumour_ratio").alias("feature"), value.alias("value"))


def custom(cells: DataFrame, extract: Callable, *, keys: list[str], schema: str) -> DataFrame:
    """A user's featuriser, a pandas function of the cells of one group, which one task holds whole: for large groups there is `custom_merged`."""
    return cells.groupBy(*keys).applyInPandas(extract, schema)


def custom_merged(cells: DataFrame, *, partial: Callable, merge: Callable, finish: Callable, keys: list[str], state: str, schema: str) -> DataFrame:
    """A user's featuriser in three steps, for groups of any size: (keys, columns of ``schema``).

    ``partial`` makes rows of ``state`` from some of a group's cells, ``merge`` makes fewer rows of ``state`` from those of several, and ``finish`` makes rows of ``schema`` from
    all that is left of a group; each is a function of a pandas frame without the keys. Merging must not depend on the order. Cells are read in Arrow batches where they lie and aren't shuffled:
    a task sends on a state a group, these are merged by group and salt and then by group, so no task holds more than a batch of cells and some states, however many cells a group has.
    Null keys are a group of their own.
    """
    state_schema, out_schema = T.StructType.fromDDL(state), T.StructType.fromDDL(schema)
    state_arrow, out_arrow = to_arrow_schema(state_schema), to_arrow_schema(out_schema)
    key_schema = T.StructType([cells.schema[k] for k in keys])
    others = [c for c in cells.columns if c not in keys]

    def labelled(values: list[pa.Scalar], rows: pd.DataFrame, arrow: pa.Schema) -> pa.Table:
        table = pa.Table.from_pandas(rows[arrow.names], schema=arrow, preserve_index=False).replace_schema_metadata(None)
        columns = [pa.array([v.as_py()] * table.num_rows, v.type) for v in values]
        return pa.Table.from_arrays([*columns, *table.columns], names=[*keys, *arrow.names])

    def partials(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, tuple[list[pa.Scalar], list[pd.DataFrame]]] = {}

        def sent() -> Iterator[pa.RecordBatch]:
            for values, states in held.values():
                one = states[0] if len(states) == 1 else merge(pd.concat(states, ignore_index=True))
                yield from labelled(values, one, state_arrow).to_batches()
            held.clear()

        for batch in batches:
            table = pa.Table.from_batches([batch])
            named = table.select(keys).append_column("_row", pa.array(range(batch.num_rows), pa.int64()))
            groups = named.group_by(keys, use_threads=False).aggregate([("_row", "list")])
            for g in range(groups.num_rows):
                values = [groups[k][g] for k in keys]
                cells_of = table.select(others).take(groups["_row_list"][g].values)
                _, states = held.setdefault(tuple(v.as_py() for v in values), (values, []))
                states.append(partial(cells_of.to_pandas()))
                if len(states) >= HELD_STATES:
                    states[:] = [merge(pd.concat(states, ignore_index=True))]
            if len(held) > HELD_GROUPS:
                yield from sent()
        yield from sent()

    def merged(table: pa.Table) -> pa.Table:
        return labelled([table[k][0] for k in keys], merge(table.select(state_arrow.names).to_pandas()), state_arrow)

    def finished(table: pa.Table) -> pa.Table:
        return labelled([table[k][0] for k in keys], finish(merge(table.select(state_arrow.names).to_pandas())), out_arrow)

    states_of = T.StructType([*key_schema, *state_schema])
    states = cells.mapInArrow(partials, states_of).withColumn("_salt", F.pmod(F.spark_partition_id(), F.lit(MERGE_SALTS)))
    return states.groupBy(*keys, "_salt").applyInArrow(merged, states_of).groupBy(*keys).applyInArrow(finished, T.StructType([*key_schema, *out_schema]))
