"""Ranks and running sums of groups of any size: groups are cut to ranges of their order, so that no task orders a whole group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cellgrove.scratch import materialize


def in_ranges(rows: DataFrame, *, keys: list[str], order: list[Column], name: str = "_range") -> DataFrame:
    """``rows``, written as a table, with the number of the range that each lies in.

    Ranges hold similar numbers of rows, as many ranges as there are shuffle partitions. Within a group of ``keys`` they follow the order, and rows
    that are equal in it share a range.
    """
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return materialize(rows.repartitionByRange(n, *keys, *order).withColumn(name, F.spark_partition_id()), "ranges")


def running_sums(rows: DataFrame, *, keys: list[str], order: list[str], sums: list[str], descending: bool = False) -> DataFrame:
    """``rows`` with ``upto_<s>``, for each of ``sums`` the sum up to this row in its group's order, itself included.

    Sums by range come first; their running sums (a row a range and group) are joined to those within the ranges. No two
    rows of a group may be equal in ``order``.
    """
    by = [F.col(c).desc() if descending else F.col(c).asc() for c in order]
    placed = in_ranges(rows, keys=keys, order=by)
    totals = placed.groupBy(*keys, "_range").agg(*[F.sum(s).alias(f"_sum_{s}") for s in sums])
    ranges, inside = Window.partitionBy(*keys).orderBy("_range"), Window.partitionBy(*keys, "_range").orderBy(*by)
    starts = totals.select(*keys, "_range", *[(F.sum(f"_sum_{s}").over(ranges) - F.col(f"_sum_{s}")).alias(f"_before_{s}") for s in sums])
    within = placed.withColumns({f"upto_{s}": F.sum(s).over(inside) for s in sums}).join(starts, [*keys, "_range"])
    return within.withColumns({f"upto_{s}": F.col(f"upto_{s}") + F.col(f"_before_{s}") for s in sums}).drop("_range", *[f"_before_{s}" for s in sums])


def dense_ranks(rows: DataFrame, *, keys: list[str], order: list[str], name: str) -> DataFrame:
    """(keys, order, name): the place of each distinct value of ``order`` in its group, from 0."""
    values = rows.select(*keys, *order).distinct().withColumn("_one", F.lit(1).cast("long"))
    return running_sums(values, keys=keys, order=order, sums=["_one"]).select(*keys, *order, (F.col("upto__one") - 1).alias(name))


def exact_percentiles(rows: DataFrame, *, keys: list[str], value: str, percentiles: dict[str, float]) -> DataFrame:
    """(keys, a column for each of ``percentiles``) of the values that aren't null, interpolated between neighbours as ``percentile`` does.

    Counts of distinct values and their running sums over ranges take the place of a buffer with all values of a group, so a group may be of any size.
    Keys may be null; groups without a value have no row.
    """
    group = F.to_json(F.struct(*keys)) if keys else F.lit("{}")
    counts = rows.filter(F.col(value).isNotNull()).groupBy(*keys, F.col(value).alias("_value")).agg(F.count("*").alias("_n"))
    placed = materialize(running_sums(counts.withColumn("_group", group), keys=["_group"], order=["_value"], sums=["_n"]), "value-counts")
    totals = placed.groupBy("_group").agg((F.sum("_n") - 1).alias("_last"))  # a row a group
    pos = {name: F.col("_last") * p for name, p in percentiles.items()}
    first = lambda at: F.min(F.when(F.col("upto__n") > at, F.col("_value")))  # noqa: E731  the value at a place, from 0
    ends = [e for name, at in pos.items() for e in (first(F.floor(at)).alias(f"_lo_{name}"), first(F.ceil(at)).alias(f"_hi_{name}"))]
    found = placed.join(totals, "_group").groupBy(*keys, "_last").agg(*ends)
    between = lambda name, at: (F.col(f"_lo_{name}") + (F.col(f"_hi_{name}") - F.col(f"_lo_{name}")) * (at - F.floor(at))).alias(name)
    return found.select(*keys, *[between(name, at) for name, at in pos.items()])
