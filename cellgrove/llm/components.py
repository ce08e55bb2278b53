"""Connected components of links, as alternating large-star and small-star steps."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellgrove.scratch import materialize


def _both_ways(edges: DataFrame) -> DataFrame:
    return edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))


def _parted(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The edges of components that are a star about their smallest node, and all others."""
    degree = _both_ways(edges).groupBy("u").agg(F.count("*").alias("d"))
    centres = edges.join(degree, "u").groupBy("v").agg(F.min(F.col("d") == 1).alias("alone"), F.count("*").alias("n")).filter("alone")
    ended = centres.join(degree.withColumnRenamed("u", "v"), "v").filter("n = d").select("v", F.lit(True).alias("ended"))
    marked = materialize(edges.join(ended, "v", "left").select("u", "v", F.coalesce("ended", F.lit(False)).alias("ended")), "marked-edges")
    return marked.filter("ended").select("u", "v"), marked.filter("NOT ended").select("u", "v")


def connected_components(links: DataFrame) -> DataFrame:
    """(node, comp) for every node of ``links`` (a, b: long); comp is the smallest node it is linked to.

    Each step keeps at most as many edges as it gets and works by minima (summed before the shuffle) and joins on
    nodes, so that a node with very many links is no hot group. A component that is a star takes no part in later steps, which end when all
    are: most components are a few nodes, so most edges are in one step or none. Self links and repeated links do no harm; no links give no rows.
    """
    edges = links.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    stars, edges = _parted(materialize(edges, "edges"))
    ended = [stars]
    while not edges.isEmpty():
        both = _both_ways(edges)
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.filter("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        pairs = F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct(F.col("u").alias("u"), F.col("m").alias("v")))
        stars, edges = _parted(materialize(large.join(low, "u").select(F.inline(pairs).alias("u", "v")).filter("u <> v").distinct(), "edges"))
        ended.append(stars)
    found = reduce(DataFrame.union, ended)
    roots = found.select(F.col("v").alias("node")).distinct().select("node", F.col("node").alias("comp"))
    return found.select(F.col("u").alias("node"), F.col("v").alias("comp")).union(roots)
