"""Reading trees of region CSVs and GeoJSON into tables, and writing summaries."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cellgrove.sources.tree import NULL_TOKENS, read_tree

REGION = r"/regions/([^/]+)/"
POINT = "struct<x:double,y:double>"


def region_of(path: Column | None = None) -> Column:
    return F.regexp_extract(F.col("_metadata.file_path") if path is None else path, REGION, 1)


def null_tokens(df: DataFrame) -> DataFrame:
    """String columns with the usual spellings of a missing value set to null."""
    return df.withColumns({c: F.when(~F.col(f"`{c}`").isin(NULL_TOKENS), F.col(f"`{c}`")) for c, t in df.dtypes if t == "string"})


def read_metadata(spark: SparkSession, paths: list[str]) -> DataFrame:
    """The union of metadata files by column name; ids are never inferred as numbers."""
    frames = []
    for p in paths:
        text = null_tokens(spark.read.csv(p, header=True))
        kinds = spark.read.csv(p, header=True, inferSchema=True, nullValue="NA").dtypes
        frames.append(text.select(*[F.col(f"`{c}`") if c in ("patient_id", "region_id") else F.col(f"`{c}`").try_cast(t).alias(c) for c, t in kinds]))
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def read_coordinates(spark: SparkSession, root: str) -> DataFrame:
    schema = "cell_id long, x double, y double"
    rows = spark.read.schema(schema).csv(f"{root}/regions/*/coordinates.csv", header=True, enforceSchema=False)
    return rows.select(region_of().alias("region_id"), "cell_id", F.nanvl("x", F.lit(None).cast("double")).alias("x"), F.nanvl("y", F.lit(None).cast("double")).alias("y"))


def read_expression(spark: SparkSession, root: str, *, regions: list[str] | None = None) -> DataFrame:
    """(region_id, cell_id, marker, value): panels differ between regions. With ``regions`` only their folders are opened."""
    return read_tree(spark, root, "expression", regions=regions)


def read_cell_types(spark: SparkSession, root: str, *, column: str = "cell_type", regions: list[str] | None = None) -> DataFrame:
    """(region_id, cell_id, <column>): files without the configured column give their ``cell_type``."""
    return read_tree(spark, root, "cell_types", regions=regions, column=column)


def read_polygons(spark: SparkSession, root: str, *, name: str = "tissue_polygons.geojson") -> DataFrame:
    """(region_id, kind, rings): of several features of a kind the last counts; the kind is tissue where it isn't given."""
    text = spark.read.text(f"{root}/regions/*/{name}", wholetext=True).select(region_of().alias("region_id"), "value")
    feature = "struct<properties:struct<kind:string>,geometry:struct<type:string,coordinates:string>>"
    rows = text.select("region_id", F.posexplode(F.from_json("value", f"struct<features:array<{feature}>>")["features"]).alias("pos", "f"))
    point = lambda p: F.struct(F.get(p, F.lit(0)).alias("x"), F.get(p, F.lit(1)).alias("y"))
    shape = lambda polygons: F.transform(polygons, lambda rings: F.transform(rings, lambda ring: F.transform(ring, point)))
    c = F.col("f.geometry.coordinates")
    one = F.array(F.from_json(c, "array<array<array<double>>>"))
    many = F.from_json(c, "array<array<array<array<double>>>>")
    rings = F.when(F.col("f.geometry.type") == "Polygon", shape(one)).when(F.col("f.geometry.type") == "MultiPolygon", shape(many))
    kind = F.coalesce("f.properties.kind", F.lit("tissue"))
    kept = rows.select("region_id", "pos", F.when(kind == "tumor", "tumour").otherwise(kind).alias("kind"), rings.alias("rings")).filter("rings IS NOT NULL")
    return kept.groupBy("region_id", "kind").agg(F.max_by("rings", "pos").alias("rings"))


def region_ids(coordinates: DataFrame) -> DataFrame:
    return coordinates.select("region_id").distinct().orderBy("region_id")


def ingest(spark: SparkSession, root: str, out: str, *, dataset: str) -> None:
    """Write the tree once as Parquet by dataset: many small text files become columns that later scans can prune."""
    for name, df in (("coordinates", read_coordinates(spark, root)), ("expression", read_expression(spark, root)), ("cell_types", read_cell_types(spark, root))):
        df.withColumn("dataset", F.lit(dataset)).write.mode("append").partitionBy("dataset").parquet(f"{out}/{name}")


def write_summary(summary: DataFrame, path: str) -> None:
    """The scores as one CSV file: a row a task and scheme."""
    summary.coalesce(1).write.mode("overwrite").csv(path, header=True)
