"""The polygon index against the plain even-odd rule over all edges, and percentiles of groups of any size."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from cellgrove.operators import normalize, ranks, spatial

RINGS = "region_id int, kind string, rings array<array<array<struct<x: double, y: double>>>>"


def ring(points):
    at = [(float(x), float(y)) for x, y in points]
    return [*at, at[0]]


def star(rng, n, *, centre=(50, 50), whole=True):
    """A ring around a centre; whole coordinates make edges run through grid lines, points and each other's corners."""
    angle, r = np.sort(rng.uniform(0, 2 * np.pi, n)), rng.uniform(5, 45, n)
    at = np.c_[centre[0] + r * np.cos(angle), centre[1] + r * np.sin(angle)]
    return ring(np.round(at) if whole else at)


@pytest.fixture(scope="module")
def shapes(spark):
    rng = np.random.default_rng(3)
    rows = [(i, "tissue", [[star(rng, n, whole=i % 2 == 0)]]) for i, n in enumerate((3, 4, 7, 20, 60, 200))]
    square = ring([(0, 0), (100, 0), (100, 100), (0, 100)])
    rows.append((6, "tissue", [[square, ring([(40, 40), (60, 40), (60, 60), (40, 60)])], [ring([(45, 45), (55, 45), (50, 55)])]]))  # a hole and an island in it
    rows.append((7, "tissue", [[ring([(0, 0), (50, 100), (100, 0), (0, 60), (100, 60)])]]))  # crosses itself
    rows.append((8, "tissue", [[ring([(10, 10), (90, 10)])]]))  # without an area
    rows += [(9, "tissue", []), (10, "tumour", [[square]])]
    return spark.createDataFrame(rows, RINGS)


def test_inside_equals_the_plain_rule(spark, shapes):
    side = spark.range(101).select(F.col("id").cast("double").alias("v"))
    grid = side.select(F.col("v").alias("x")).crossJoin(side.select(F.col("v").alias("y")))
    rng = np.random.default_rng(4)
    more = spark.createDataFrame(rng.uniform(-5, 105, (2000, 2)).tolist(), "x double, y double")
    cells = grid.unionByName(more).crossJoin(spark.range(11).select(F.col("id").cast("int").alias("region_id")))
    got = spatial.inside_polygon(cells, shapes, kind="tissue").groupBy("region_id", "x", "y").agg(F.min("inside").alias("inside"))
    plain = cells.join(shapes.filter("kind = 'tissue'").withColumn("_e", spatial.edges(F.col("rings"))), "region_id", "left")
    plain = plain.select("region_id", "x", "y", spatial.strictly_inside(F.col("x"), F.col("y"), F.col("_e")).alias("want"))
    both = got.join(plain, ["region_id", "x", "y"])
    differ = both.filter(~F.col("inside").eqNullSafe(F.col("want")))
    assert differ.collect() == []
    by = {r.region_id: (r.n, r.known) for r in both.groupBy("region_id").agg(F.count_if("inside").alias("n"), F.count("inside").alias("known")).collect()}
    assert all(by[i][0] > 100 for i in (3, 4, 5, 6, 7)) and by[8][0] == by[9][0] == 0 and by[9][1] > 0 and by[10] == (0, 0)


def test_cells_without_a_place_and_other_columns(spark, shapes):
    cells = spark.createDataFrame([(6, None, 50.0, "a"), (6, 10.0, None, "b"), (6, 10.0, 10.0, None), (None, 1.0, 1.0, "d"), (6, 10.0, 10.0, None)], "region_id int, x double, y double, n string")
    got = spatial.inside_polygon(cells, shapes, kind="tissue")
    assert got.columns == ["region_id", "x", "y", "n", "inside"]
    assert sorted((str(r.n), r.inside) for r in got.collect()) == [("None", True), ("None", True), ("a", False), ("b", False), ("d", None)]
    assert spatial.inside_polygon(cells.limit(0), shapes, kind="tissue").count() == 0
    assert {r.inside for r in spatial.inside_polygon(cells, shapes.limit(0), kind="tissue").collect()} == {None}


def test_a_million_edges(spark):
    """A ring of a million edges about (0, 0) whose radius waves between 0.8 and 1: no grid cell holds more than a few hundred of them."""
    n = 1_000_000
    angle = F.col("i") * (2 * np.pi / n)
    radius = 0.9 + 0.1 * F.cos(angle * 40)
    corner = lambda i: F.struct((radius * F.cos(angle)).alias("x"), (radius * F.sin(angle)).alias("y"))
    points = spark.range(1).select(F.explode(F.sequence(F.lit(0), F.lit(n))).alias("i")).withColumn("i", F.col("i") % n + F.lit(0))
    points = points.withColumn("o", F.monotonically_increasing_id()).withColumn("p", corner(F.col("i")))
    one = points.agg(F.transform(F.array_sort(F.collect_list(F.struct("o", "p"))), lambda e: e["p"]).alias("ring"))
    polygon = one.select(F.lit(1).alias("region_id"), F.lit("tissue").alias("kind"), F.array(F.array("ring")).alias("rings"))
    rng = np.random.default_rng(5)
    at = rng.uniform(-1.1, 1.1, (20_000, 2))
    cells = spark.createDataFrame(at.tolist(), "x double, y double").withColumn("region_id", F.lit(1))
    got = spatial.inside_polygon(cells, polygon, kind="tissue").toPandas()
    r, bound = np.hypot(got.x, got.y), 0.9 + 0.1 * np.cos(40 * np.arctan2(got.y, got.x))
    clear = np.abs(r - bound) > 1e-6
    assert (got.inside[clear] == (r < bound)[clear]).all() and 8_000 < got.inside.sum() < 14_000
    grids, index = spatial.polygon_index(polygon, kind="tissue")
    assert grids.first()._side == 1000 and index.agg(F.max(F.size("_edges"))).first()[0] < 2000


def test_percentiles_of_groups_of_any_size(spark):
    rng = np.random.default_rng(6)
    groups = {"a": rng.normal(size=1001), "b": rng.integers(0, 3, 500).astype(float), "c": np.array([2.5]), None: np.array([1.0, 2.0, 4.0])}
    rows = [(k, float(v)) for k, vs in groups.items() for v in vs] + [("a", None), ("d", None)]
    df = spark.createDataFrame(rows, "marker string, value double")
    got = {r.marker: r for r in ranks.exact_percentiles(df, keys=["marker"], value="value", percentiles={"low": 0.2, "mid": 0.5, "top": 0.99, "end": 1.0}).collect()}
    assert set(got) == set(groups)
    for k, v in groups.items():
        assert (got[k].low, got[k].mid, got[k].top, got[k].end) == pytest.approx(tuple(np.quantile(v, (0.2, 0.5, 0.99, 1.0))))
    p = {r.marker: r for r in normalize.profile(df, keys=["marker"]).collect()}
    assert (p["d"].n, p["d"].p50) == (0, None) and p[None].p50 == 2.0 and p["a"].n == 1001 and p["b"].zero_share == pytest.approx(float((groups["b"] == 0).mean()))
    assert "percentile" not in normalize.profile(df, keys=["marker"])._jdf.queryExecution().toString()
    assert ranks.exact_percentiles(df, keys=[], value="value", percentiles={"mid": 0.5}).first().mid == pytest.approx(np.quantile(np.concatenate(list(groups.values())), 0.5))
