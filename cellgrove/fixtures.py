"""The driver's tables in the roles of cells, expression, polygons, metadata, scores and instances."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cellgrove.scratch import new_path


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def line_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Typed cells of 100s of regions, without ids or places."""
    return read(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("region_id"), F.concat("l_returnflag", "l_linestatus").alias("cell_type"))


def line_expression(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(region_id, marker, value) with four markers."""
    markers = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
    pairs = F.array(*[F.struct(F.lit(m).alias("marker"), F.col(m).alias("value")) for m in markers])
    return read(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("region_id"), F.inline(pairs))


def event_cells(spark: SparkSession, sf_dir: str, regions: int | None = None) -> DataFrame:
    """Cells with places; ``regions`` folds them into so many regions."""
    region = F.col("user_id") if regions is None else F.col("user_id") % regions
    return read(spark, sf_dir, "events").select(
        region.alias("region_id"), F.col("event_id").alias("cell_id"), F.col("event_type").alias("cell_type"), "value",
        ((F.col("event_id") * 7919) % 1009).cast("double").alias("x"), ((F.col("event_id") * 104729) % 1013).cast("double").alias("y"))


def embedding_expression(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(region_id, cell_id, marker, value) with 64 markers, negative values too."""
    e = read(spark, sf_dir, "embeddings")
    long = e.select((F.col("vec_id") % 20).alias("region_id"), F.col("vec_id").alias("cell_id"), F.posexplode("embedding").alias("m", "value"))
    return long.select("region_id", "cell_id", F.concat(F.lit("m"), F.col("m").cast("string")).alias("marker"), F.col("value").cast("double").alias("value"))


def event_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row a region of `event_cells` with patient, cohort, labels and survival."""
    users = read(spark, sf_dir, "events").select("user_id").distinct()
    c = users.join(read(spark, sf_dir, "customer"), F.col("user_id") == F.col("c_custkey"))
    c = c.join(read(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(read(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return c.select(
        F.col("user_id").alias("region_id"), (F.col("user_id") % 60).cast("string").alias("patient_id"), F.col("c_mktsegment").alias("cohort"),
        (F.col("c_acctbal") > 4000).cast("int").alias("label"), F.col("r_name").alias("multi"), F.abs("c_acctbal").alias("time"), (F.col("c_nationkey") % 2).cast("double").alias("event"))


def order_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metadata at scale: a region an order, a patient a customer."""
    return read(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("region_id"), F.col("o_custkey").cast("string").alias("patient_id"), F.col("o_orderstatus").alias("label"),
        F.col("o_orderpriority").alias("cohort"), F.col("o_totalprice").alias("time"), (F.col("o_orderstatus") == "F").cast("double").alias("event"))


def scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(run, truth, score) with many ties, a run for each label."""
    s = read(spark, sf_dir, "labels").join(read(spark, sf_dir, "documents").select("doc_id", "n_chars"), "doc_id")
    pairs = F.array(*[F.struct(F.lit(k).alias("run"), F.col(k).alias("truth")) for k in ("quality", "toxic")])
    return s.select(F.inline(pairs), ((F.col("n_chars") % 97) / 97.0).alias("score"))


def risks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(run, region_id, time, event, risk) with ties."""
    m = event_metadata(spark, sf_dir)
    return m.select((F.col("region_id") % 3).alias("run"), "region_id", "time", "event", (F.col("region_id") % 17).cast("double").alias("risk"))


def probabilities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(run, region_id, truth, class, proba) in long form."""
    o = read(spark, sf_dir, "orders")
    k = F.col("o_orderkey")
    parts = {"F": k % 7 + 1, "O": k % 5 + 1, "P": k % 3 + 1}
    total = parts["F"] + parts["O"] + parts["P"]
    rows = F.array(*[F.struct(F.lit(c).alias("class"), (v / total).alias("proba")) for c, v in parts.items()])
    return o.select((k % 4).alias("run"), k.alias("region_id"), F.col("o_orderstatus").alias("truth"), F.inline(rows))


#: Corners of the tissue square, its hole and the tumour square, in pixels; and the pixel size in micrometres.
TISSUE, HOLE, TUMOUR, MPP = 1000.0, (400.0, 600.0), 500.0, 0.5


def square(lo: float, hi: float) -> str:
    at = [(lo, lo), (hi, lo), (hi, hi), (lo, hi), (lo, lo)]
    return "array(" + ", ".join(f"named_struct('x', {x}D, 'y', {y}D)" for x, y in at) + ")"


def event_polygons(spark: SparkSession, sf_dir: str, regions: int = 10) -> DataFrame:
    """(region_id, kind, rings): tissue with a hole in all regions but the last, a tumour in those with an even id."""
    ids = event_cells(spark, sf_dir, regions).select("region_id").distinct()
    tissue = f"named_struct('kind', 'tissue', 'rings', array(array({square(0, TISSUE)}, {square(*HOLE)})))"
    tumour = f"named_struct('kind', 'tumour', 'rings', array(array({square(0, TUMOUR)})))"
    both = F.expr(f"CASE WHEN region_id = {regions - 1} THEN array() WHEN region_id % 2 = 0 THEN array({tissue}, {tumour}) ELSE array({tissue}) END")
    return ids.select("region_id", F.inline(both))


def region_polygons(spark: SparkSession, cells: DataFrame) -> DataFrame:
    """(region_id, kind, rings): a tissue square for every region, and a tumour square of a size that differs between regions."""
    tissue = f"named_struct('kind', 'tissue', 'rings', array(array({square(0, TISSUE)})))"
    side = "CAST(300 + 50 * (region_id % 7) AS DOUBLE)"
    ring = "array(" + ", ".join(f"named_struct('x', {x}, 'y', {y})" for x, y in (("0D", "0D"), (side, "0D"), (side, side), ("0D", side), ("0D", "0D"))) + ")"
    tumour = f"named_struct('kind', 'tumour', 'rings', array(array({ring})))"
    return cells.select("region_id").distinct().select("region_id", F.inline(F.expr(f"array({tissue}, {tumour})")))


def csv_tree(spark: SparkSession, sf_dir: str, regions: int = 4) -> str:
    """Write a tree of region files from the events, and two metadata files, to the shared folder; returns its root.

    Panels of markers differ between regions, every fifth cell type is a null token, and one region has no tumour.
    """
    root = new_path(spark, "tree")
    cells = event_cells(spark, sf_dir, regions)
    marker = lambda i: (F.col("value") * i).alias(f"m{i}")
    text = lambda df, at: df.coalesce(1).write.option("header", True).csv(f"{root}/{at}")
    for r in range(regions):
        own, at = cells.filter(F.col("region_id") == r), f"regions/r{r}"
        text(own.select("cell_id", "x", "y"), f"{at}/coordinates.csv")
        text(own.select("cell_id", marker(1 + r % 2), marker(2 + r % 2)), f"{at}/expression.csv")
        text(own.select("cell_id", F.when(F.col("cell_id") % 5 == 0, "NA").otherwise(F.col("cell_type")).alias("cell_type")), f"{at}/cell_types.csv")
        ring = lambda s: f"[[[0, 0], [{s}, 0], [{s}, {s}], [0, {s}], [0, 0]]]"
        feature = lambda s, kind: f'{{"type": "Feature", "properties": {{{kind}}}, "geometry": {{"type": "Polygon", "coordinates": {ring(s)}}}}}'
        both = [feature(900 + r, ""), *([feature(100 * r, '"kind": "tumor"')] if r else [])]
        spark.createDataFrame([(f'{{"type": "FeatureCollection", "features": [{", ".join(both)}]}}',)], "value string").coalesce(1).write.text(f"{root}/{at}/tissue_polygons.geojson")
    m = event_metadata(spark, sf_dir)
    text(m.filter("region_id % 2 = 0").select("region_id", F.concat(F.lit("00"), "patient_id").alias("patient_id"), "cohort", "time"), "meta_a.csv")
    text(m.filter("region_id % 2 = 1").select("region_id", "patient_id", "label", F.when(F.col("region_id") % 3 == 0, "n/a").otherwise(F.col("cohort")).alias("cohort")), "meta_b.csv")
    return root
