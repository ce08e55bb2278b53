"""Polygons, neighbourhoods and point patterns of cells. Close pairs come from an equi-join on grid cells, never from all pairs."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cellgrove.operators import tiles
from cellgrove.scratch import at_most, materialize

#: Edges in the cells of polygon grids: a table of up to so many (some 20 MB) is broadcast to the cells, a larger one is joined by shuffle.
BROADCAST_EDGES = 500_000

#: Cells in a square as wide as the largest radius: where there are more, pairs are counted by tiles and not one by one.
CROWD = 50

#: rings: array (polygons) of array (shell, then holes) of array of (x, y); areas and tests are sums over edges.


def edges(rings: Column) -> Column:
    """All edges (ax, ay, bx, by, hole) of nested rings."""
    def of_ring(ring: Column, hole: Column) -> Column:
        n = F.size(ring)
        steps = F.when(n > 1, F.sequence(F.lit(0), n - 2)).otherwise(F.array().cast("array<int>"))
        return F.transform(steps, lambda i: F.struct(
            F.get(ring, i)["x"].alias("ax"), F.get(ring, i)["y"].alias("ay"), F.get(ring, i + 1)["x"].alias("bx"), F.get(ring, i + 1)["y"].alias("by"), hole.alias("hole")))

    return F.flatten(F.transform(rings, lambda polygon: F.flatten(F.transform(polygon, lambda ring, i: of_ring(ring, i > 0)))))


def polygon_area(rings: Column) -> Column:
    """Shells less holes, by the shoelace formula for each ring."""
    def of_ring(ring: Column) -> Column:
        steps = F.sequence(F.lit(0), F.size(ring) - 2)
        cross = F.transform(steps, lambda i: F.get(ring, i)["x"] * F.get(ring, i + 1)["y"] - F.get(ring, i + 1)["x"] * F.get(ring, i)["y"])
        return F.abs(F.aggregate(cross, F.lit(0.0), lambda a, v: a + v)) / 2

    parts = F.transform(rings, lambda polygon: F.aggregate(F.transform(polygon, lambda ring, i: F.when(i == 0, of_ring(ring)).otherwise(-of_ring(ring))), F.lit(0.0), lambda a, v: a + v))
    return F.aggregate(parts, F.lit(0.0), lambda a, v: a + v)


def areas_mm2(regions: DataFrame, polygons: DataFrame, *, mpp: float) -> DataFrame:
    """(region_id, tissue, tumour) in mm2 for all regions; null where there is no polygon. ``tumor`` is ``tumour``."""
    kind = F.when(F.col("kind") == "tumor", "tumour").otherwise(F.col("kind"))
    a = polygons.select("region_id", kind.alias("kind"), (polygon_area(F.col("rings")) * (mpp * mpp / 1e6)).alias("a"))
    wide = a.groupBy("region_id").agg(*[F.max(F.when(F.col("kind") == k, F.col("a"))).alias(k) for k in ("tissue", "tumour")])
    return regions.select("region_id").distinct().join(wide, "region_id", "left")


def strictly_inside(x: Column, y: Column, edge_list: Column) -> Column:
    """Even-odd rule over the edges of shells and holes, false on an edge."""
    def crosses(e: Column) -> Column:
        over = (e["ay"] > y) != (e["by"] > y)
        return F.when(over & (x < (e["bx"] - e["ax"]) * (y - e["ay"]) / (e["by"] - e["ay"]) + e["ax"]), 1).otherwise(0)

    def on(e: Column) -> Column:
        flat = (e["bx"] - e["ax"]) * (y - e["ay"]) == (e["by"] - e["ay"]) * (x - e["ax"])
        return flat & x.between(F.least(e["ax"], e["bx"]), F.greatest(e["ax"], e["bx"])) & y.between(F.least(e["ay"], e["by"]), F.greatest(e["ay"], e["by"]))

    odd = F.aggregate(edge_list, F.lit(0), lambda n, e: n + crosses(e)) % 2 == 1
    return odd & ~F.exists(edge_list, on)


def _place(at: Column, low: Column, width: Column, n: Column) -> Column:
    """Number of the grid column (or row) of a coordinate, from 0 to n - 1."""
    return F.greatest(F.lit(0).cast("long"), F.least(n.cast("long") - 1, F.floor((at - low) / width)))


def polygon_index(polygons: DataFrame, *, kind: str) -> tuple[DataFrame, DataFrame]:
    """Grids over the polygons of a kind: (region_id, _x0, _y0, _x1, _y1, _w, _h, _side) and the index (region_id, _i, _j, _odd, _edges).

    A polygon of n edges has a grid of sqrt(n) by sqrt(n) cells. A cell has the edges that touch it (``low`` marks those that cross the line of its lower side
    within the cell) and ``_odd``, whether an odd number of edges crosses that line to the right of the cell. Cells without edges are wholly inside or wholly outside;
    those outside are left out. Edges with a null end are skipped. The index has some n rows and as many edges as cells are touched: about n for short edges.
    """
    own = polygons.filter(F.col("kind") == kind)
    e = own.select("region_id", F.inline(edges(F.col("rings")))).drop("hole").dropna(subset=["ax", "ay", "bx", "by"])
    e = materialize(e, "polygon-edges")
    ends = e.groupBy("region_id").agg(F.count("*").alias("_n"), *[f(g(f"a{c}", f"b{c}")).alias(f"_{c}{i}") for c in "xy" for i, f, g in ((0, F.min, F.least), (1, F.max, F.greatest))])
    side = F.ceil(F.sqrt(F.coalesce("_n", F.lit(1)))).cast("int")
    wide = lambda c: F.when(F.col(f"_{c}1") > F.col(f"_{c}0"), (F.col(f"_{c}1") - F.col(f"_{c}0")) / F.col("_side")).otherwise(1.0)
    grids = own.select("region_id").distinct().join(ends, "region_id", "left").withColumn("_side", side).withColumns({"_w": wide("x"), "_h": wide("y")})
    grids = materialize(grids.drop("_n"), "polygon-grids")
    small = at_most(grids, BROADCAST_EDGES)  # a row of numbers a region
    x0, y0, w, h, n = (F.col(c) for c in ("_x0", "_y0", "_w", "_h", "_side"))
    ax, ay, bx, by, floor_y = (F.col(c) for c in ("ax", "ay", "bx", "by", "_low_y"))
    slack = 1e-6  # of a cell: an edge near a border is in the cells of both sides
    bands = F.sequence(_place(F.least(ay, by) - slack * h, y0, h, n), _place(F.greatest(ay, by) + slack * h, y0, h, n))
    cut = e.join(F.broadcast(grids) if small else grids, "region_id").withColumn("_j", F.explode(bands)).withColumn("_low_y", y0 + F.col("_j") * h)
    at = lambda y: F.when(by == ay, ax).otherwise(ax + (bx - ax) * (y - ay) / (by - ay))
    clip = lambda y: F.greatest(F.least(ay, by), F.least(F.greatest(ay, by), y))
    one, two = at(clip(floor_y - slack * h)), at(clip(floor_y + (1 + slack) * h))
    left = F.when(by == ay, F.least(ax, bx)).otherwise(F.least(one, two)) - slack * w
    right = F.when(by == ay, F.greatest(ax, bx)).otherwise(F.greatest(one, two)) + slack * w
    cut = cut.withColumns({"_from": _place(left, x0, w, n), "_to": _place(right, x0, w, n)})
    crossing = F.when((ay > floor_y) != (by > floor_y), F.greatest(F.col("_from"), F.least(F.col("_to"), _place(at(floor_y), x0, w, n))))
    touched = cut.withColumn("_cross", crossing).withColumn("_i", F.explode(F.sequence("_from", "_to")))
    edge = F.struct("ax", "ay", "bx", "by", F.coalesce(F.col("_i") == F.col("_cross"), F.lit(False)).alias("low"))
    held = touched.select("region_id", "_i", "_j", edge.alias("_e")).groupBy("region_id", "_i", "_j").agg(F.collect_list("_e").alias("_edges"), F.count_if("_e.low").alias("_low"))
    places = F.sequence(F.lit(0).cast("long"), n.cast("long") - 1)
    every = grids.filter(F.col("_x0").isNotNull()).select("region_id", "_side", F.explode(places).alias("_j")).select("region_id", "_j", F.explode(places).alias("_i"))
    beyond = Window.partitionBy("region_id", "_j").orderBy(F.col("_i").desc()).rowsBetween(Window.unboundedPreceding, -1)
    odd = F.coalesce(F.sum(F.coalesce("_low", F.lit(0))).over(beyond), F.lit(0)) % 2 == 1
    index = every.join(held, ["region_id", "_i", "_j"], "left").withColumn("_odd", odd).filter("_odd OR _edges IS NOT NULL")
    return grids, materialize(index.select("region_id", "_i", "_j", "_odd", "_edges"), "polygon-index")


def _inside_cell(x: Column, y: Column, low_y: Column, odd: Column, edge_list: Column) -> Column:
    """Even-odd rule within a grid cell: crossings of the way from the cell's lower right corner along its lower side to x and up to y.

    A point at the height or place of a corner counts as a little higher and, still more, to the right, on both parts of the way. So what is between the two agrees.
    """
    def turn(e: Column, at: Column) -> Column:
        return (e["bx"] - e["ax"]) * (at - e["ay"]) - (e["by"] - e["ay"]) * (x - e["ax"])

    def flips(e: Column) -> Column:
        corner, here, run = turn(e, low_y), turn(e, y), e["bx"] - e["ax"]
        along = e["low"] & (corner * (e["by"] - e["ay"]) > 0)
        over = ((corner * run < 0) | ((corner == 0) & (run * (e["by"] - e["ay"]) > 0))) != (here * run < 0)
        up = ((e["ax"] > x) != (e["bx"] > x)) & over
        return F.when(along != up, 1).otherwise(0)

    def on(e: Column) -> Column:
        return (turn(e, y) == 0) & x.between(F.least(e["ax"], e["bx"]), F.greatest(e["ax"], e["bx"])) & y.between(F.least(e["ay"], e["by"]), F.greatest(e["ay"], e["by"]))

    crossed = F.aggregate(edge_list, F.lit(0), lambda k, e: k + flips(e)) % 2 == 1
    return F.when(edge_list.isNull(), odd).otherwise((odd != crossed) & ~F.exists(edge_list, on))


def inside_polygon(cells: DataFrame, polygons: DataFrame, *, kind: str) -> DataFrame:
    """``cells`` with ``inside``: strictly inside by the even-odd rule, false on an edge and without a place; null in regions without a polygon of that kind.

    Cells meet the few edges of their grid cell of `polygon_index`, on (region_id, grid cell): no row holds all edges of a polygon, and a large region spreads
    over many tasks. The grids' numbers, a row a region, are broadcast up to a counted size.
    """
    grids, index = polygon_index(polygons, kind=kind)
    grids = F.broadcast(grids.withColumn("_has", F.lit(True))) if at_most(grids, BROADCAST_EDGES) else grids.withColumn("_has", F.lit(True))
    index = F.broadcast(index) if at_most(index.select("_odd", F.explode_outer("_edges")), BROADCAST_EDGES) else index
    x, y = F.col("x").cast("double"), F.col("y").cast("double")
    box = x.between(F.col("_x0"), F.col("_x1")) & y.between(F.col("_y0"), F.col("_y1"))
    i, j = (F.when(box, _place(v, F.col(f"_{c}0"), F.col(w), F.col("_side"))) for c, v, w in (("x", x, "_w"), ("y", y, "_h")))
    placed = cells.join(grids, "region_id", "left").withColumns({"_i": i, "_j": j})
    found = placed.join(index, ["region_id", "_i", "_j"], "left")
    low_y = F.col("_y0") + F.col("_j") * F.col("_h")
    flag = F.when(F.col("_has"), F.coalesce(_inside_cell(x, y, low_y, F.col("_odd"), F.col("_edges")), F.lit(False)))
    return found.select(*cells.columns, flag.alias("inside"))


def disk_overlap(x: Column, y: Column, radius: float, edge_list: Column) -> Column:
    """Exact area of the polygon within the disk about (x, y): a sum over edges of triangles and sectors (Green's theorem).

    Edges must run counter-clockwise on shells and clockwise on holes, or the other way round on both.
    """
    r2 = radius * radius

    def part(e: Column) -> Column:
        ax, ay, bx, by = e["ax"] - x, e["ay"] - y, e["bx"] - x, e["by"] - y
        dx, dy = bx - ax, by - ay
        a, b, c = dx * dx + dy * dy, ax * dx + ay * dy, ax * ax + ay * ay - r2
        root = F.sqrt(F.greatest(b * b - a * c, F.lit(0.0)))
        t1, t2 = F.greatest(F.lit(0.0), (-b - root) / a), F.least(F.lit(1.0), (-b + root) / a)
        sector = lambda px, py, qx, qy: r2 / 2 * F.atan2(px * qy - py * qx, px * qx + py * qy)
        ix, iy, jx, jy = ax + t1 * dx, ay + t1 * dy, ax + t2 * dx, ay + t2 * dy
        cut = sector(ax, ay, ix, iy) + (ix * jy - iy * jx) / 2 + sector(jx, jy, bx, by)
        return F.when(a == 0, 0.0).when((b * b > a * c) & (t1 < t2), cut).otherwise(sector(ax, ay, bx, by))

    return F.abs(F.aggregate(edge_list, F.lit(0.0), lambda s, e: s + part(e)))


def close_pairs(left: DataFrame, right: DataFrame, radius: float) -> DataFrame:
    """Pairs of a left (region_id, ax, ay, ...) and a right (region_id, bx, by, ...) row of one region within ``radius``, as d2.

    Grid cells are as wide as the radius; the left side is copied to nine cells, so it should be the smaller one.
    Grid cells are part of the join key: a large region spreads over many tasks.
    """
    around = F.sequence(F.lit(-1), F.lit(1))
    l = left.withColumns({"_gx": F.explode(F.transform(around, lambda d: F.floor(F.col("ax") / radius) + d))})
    l = l.withColumn("_gy", F.explode(F.transform(around, lambda d: F.floor(F.col("ay") / radius) + d)))
    r = right.withColumns({"_gx": F.floor(F.col("bx") / radius), "_gy": F.floor(F.col("by") / radius)})
    d2 = (F.col("ax") - F.col("bx")) ** 2 + (F.col("ay") - F.col("by")) ** 2
    return l.join(r, ["region_id", "_gx", "_gy"]).withColumn("d2", d2).filter(F.col("d2") <= radius * radius).drop("_gx", "_gy")


def half_pairs(cells: DataFrame, radius: float) -> DataFrame:
    """Each unordered pair of different cells of a region within ``radius`` once: the columns of both `sides` and d2.

    A grid cell meets itself and four of its eight neighbours, so a cell is copied five times and half as many candidates are compared as by `close_pairs`.
    """
    left, right = sides(cells)
    ahead = F.array(*[F.struct(F.lit(dx).alias("dx"), F.lit(dy).alias("dy")) for dx, dy in ((0, 0), (0, 1), (1, -1), (1, 0), (1, 1))])
    l = left.withColumn("_s", F.explode(ahead)).withColumns({"_gx": F.floor(F.col("ax") / radius) + F.col("_s.dx"), "_gy": F.floor(F.col("ay") / radius) + F.col("_s.dy")})
    r = right.withColumns({"_gx": F.floor(F.col("bx") / radius), "_gy": F.floor(F.col("by") / radius)})
    d2 = (F.col("ax") - F.col("bx")) ** 2 + (F.col("ay") - F.col("by")) ** 2
    once = (F.col("a_id") < F.col("b_id")) | ((F.col("a_id") != F.col("b_id")) & ((F.col("_s.dx") != 0) | (F.col("_s.dy") != 0)))
    return l.join(r, ["region_id", "_gx", "_gy"]).withColumn("d2", d2).filter((F.col("d2") <= radius * radius) & once).drop("_gx", "_gy", "_s")


def sides(cells: DataFrame) -> tuple[DataFrame, DataFrame]:
    a = cells.select("region_id", F.col("cell_id").alias("a_id"), F.col("cell_type").alias("a_type"), F.col("x").alias("ax"), F.col("y").alias("ay"))
    b = cells.select("region_id", F.col("cell_id").alias("b_id"), F.col("cell_type").alias("b_type"), F.col("x").alias("bx"), F.col("y").alias("by"))
    return a, b


def neighbourhood(cells: DataFrame, focal: DataFrame, *, radius_um: float = 100.0, mpp: float = 1.0) -> DataFrame:
    """Members of the disk about each focal (region_id, cell_id), itself included: focal_cell_id, neighbourhood_id and the cell."""
    r = radius_um / mpp
    a, b = sides(cells)
    chosen = a.join(focal.select("region_id", F.col("cell_id").alias("a_id")), ["region_id", "a_id"], "left_semi").select("region_id", "a_id", "ax", "ay")
    name = F.format_string("%s___nbhd-cell%d-r%dum", F.col("region_id").cast("string"), F.col("a_id"), F.lit(int(radius_um)))
    return close_pairs(chosen, b, r).select("region_id", F.col("a_id").alias("focal_cell_id"), name.alias("neighbourhood_id"), F.col("b_id").alias("cell_id"), F.col("b_type").alias("cell_type"), F.col("bx").alias("x"), F.col("by").alias("y"))


def subsample(cells: DataFrame, n: int, *, seed: int = 42) -> DataFrame:
    """Up to ``n`` cells of each region and type, in the order of md5(seed:cell_id)."""
    order = F.md5(F.concat_ws(":", F.lit(seed), F.col("cell_id").cast("string")).cast("binary"))
    return cells.withColumn("_r", F.row_number().over(Window.partitionBy("region_id", "cell_type").orderBy(order, "cell_id"))).filter(F.col("_r") <= n).drop("_r")


def type_pairs(cells: DataFrame, chosen: list[tuple[str, str]] | None = None) -> DataFrame:
    """Ordered pairs of the types in the data, or the pairs of a list."""
    t = cells.filter("cell_type IS NOT NULL").select("cell_type").distinct()
    if chosen is not None:
        return cells.sparkSession.createDataFrame(chosen, "a_type string, b_type string")
    return t.select(F.col("cell_type").alias("a_type")).crossJoin(F.broadcast(t.select(F.col("cell_type").alias("b_type"))))


def nearest_distances(cells: DataFrame, *, max_dist: float = 500.0, sample_n: int | None = 500, seed: int = 42, pairs: list[tuple[str, str]] | None = None) -> DataFrame:
    """(region_id, a_type, b_type, min_dist, mean_dist) over A-cells of the distance to the nearest B, capped; A to A is 0.

    Every region has a row for each pair of types (or of ``pairs``), null where either side is absent. Sums come from
    `tiles.nearest_sums`, so no row a cell and type is joined; the cap bounds the result and not the work. A cell without a place is near nothing.
    """
    some = subsample(cells.filter("cell_type IS NOT NULL"), sample_n, seed=seed) if sample_n else cells.filter("cell_type IS NOT NULL")
    some = materialize(some.select("region_id", "cell_id", "cell_type", "x", "y"), "typed-cells")
    wanted = type_pairs(some, pairs)
    differ = wanted.filter("a_type <> b_type")
    listed = lambda side: some if pairs is None else some.join(F.broadcast(differ.select(F.col(side).alias("cell_type")).distinct()), "cell_type", "left_semi")
    near = tiles.nearest_sums(listed("a_type"), listed("b_type"), max_dist)
    own = some.groupBy("region_id", F.col("cell_type").alias("a_type")).agg(F.count("*").alias("_n"))
    types = own.select("region_id", F.col("a_type").alias("b_type"))
    every = own.join(types, "region_id").join(near, ["region_id", "a_type", "b_type"], "left")  # types of a region
    same, cap, n = F.col("a_type") == F.col("b_type"), F.lit(float(max_dist)), F.coalesce("n", F.lit(0))
    least = F.when(same, 0.0).otherwise(F.coalesce("least", cap))
    mean = F.when(same, 0.0).otherwise((F.coalesce("total", F.lit(0.0)) + cap * (F.col("_n") - n)) / F.col("_n"))
    values = every.select("region_id", "a_type", "b_type", least.alias("min_dist"), mean.alias("mean_dist"))
    grid = cells.select("region_id").distinct().crossJoin(F.broadcast(wanted))  # pairs of types
    return grid.join(values, ["region_id", "a_type", "b_type"], "left")


def _hits(radii: tuple[float, ...]) -> Column:
    return F.array(*[F.struct(F.lit(float(r)).alias("radius"), F.count_if(F.col("d2") <= r * r).alias("pairs")) for r in radii]).alias("_c")


def crowded(cells: DataFrame, radius: float) -> bool:
    """Whether a cell has more than `CROWD` cells in its own square of a grid as wide as the radius, on average over the cells."""
    squares = cells.groupBy("region_id", F.floor(F.col("x") / radius), F.floor(F.col("y") / radius)).agg(F.count("*").cast("double").alias("n"))
    return (squares.agg(F.sum(F.col("n") * F.col("n")) / F.sum("n")).first()[0] or 0) > CROWD


def counted_pairs(cells: DataFrame, radii: tuple[float, ...], *, across: bool = False) -> DataFrame:
    """`tiles.pair_counts` of the cells of each type (as ``group``), from one join of close cells unless the cells are `crowded`. Both plans give the same rows."""
    if crowded(cells, max(radii)):
        return tiles.pair_counts(cells.withColumnRenamed("cell_type", "group"), radii, across=across)
    pairs = half_pairs(cells.filter("cell_type IS NOT NULL"), max(radii))
    pairs = pairs if across else pairs.filter("a_type = b_type")
    counts = pairs.groupBy("region_id", F.least("a_type", "b_type").alias("a_group"), F.greatest("a_type", "b_type").alias("b_group")).agg(_hits(radii))
    return counts.select("region_id", "a_group", "b_group", F.inline("_c"))


def proximity(cells: DataFrame, *, radii: tuple[float, ...] = (20.0, 50.0, 100.0), min_cells: int = 3) -> DataFrame:
    """(region_id, a_type, b_type, radius, value): mean over A-cells of B-cells within the radius, itself not counted.

    Null with fewer than ``min_cells`` A-cells, 0 without B-cells near. All radii come from one pass of `counted_pairs`.
    """
    typed = cells.filter("cell_type IS NOT NULL")
    counts = counted_pairs(typed, radii, across=True)
    # A pair of different types counts for either; a pair of one type for both of its cells.
    same = F.col("a_group") == F.col("b_group")
    one, two = (F.struct(F.col(f"{a}_group").alias("a_type"), F.col(f"{b}_group").alias("b_type"), F.when(same, 2).otherwise(1).alias("_k")) for a, b in ("ab", "ba"))
    counts = counts.select("region_id", "radius", "pairs", F.inline(F.when(same, F.array(one)).otherwise(F.array(one, two))))
    counts = counts.select("region_id", "a_type", "b_type", "radius", (F.col("pairs") * F.col("_k")).alias("n"))
    own = typed.groupBy("region_id", F.col("cell_type").alias("a_type")).agg(F.count("*").alias("_n"))
    types = typed.select(F.col("cell_type").alias("b_type")).distinct()
    grid = own.crossJoin(F.broadcast(types)).withColumn("radius", F.explode(F.array(*[F.lit(r) for r in radii])))
    value = F.when(F.col("_n") >= min_cells, F.coalesce("n", F.lit(0)) / F.col("_n"))
    return grid.join(counts, ["region_id", "a_type", "b_type", "radius"], "left").select("region_id", "a_type", "b_type", "radius", value.alias("value"))


def box_area(cells: DataFrame) -> DataFrame:
    """(region_id, area) of the bounding boxes, 1 at least."""
    w, h = F.max("x") - F.min("x"), F.max("y") - F.min("y")
    return cells.groupBy("region_id").agg(F.greatest(w * h, F.lit(1.0)).alias("area"))


def _hull(points: np.ndarray) -> np.ndarray:
    """Corners of the convex hull, by monotone chains."""
    points = np.unique(points, axis=0)
    if len(points) < 3:
        return points
    chains = []
    for run in (points, points[::-1]):
        chain: list[np.ndarray] = []
        for p in run:
            while len(chain) > 1 and (chain[-1][0] - chain[-2][0]) * (p[1] - chain[-2][1]) - (chain[-1][1] - chain[-2][1]) * (p[0] - chain[-2][0]) <= 0:
                chain.pop()
            chain.append(p)
        chains.append(chain[:-1])
    return np.array(chains[0] + chains[1])


def hull_area(cells: DataFrame, *, salts: int = 16) -> DataFrame:
    """(region_id, area) of the convex hulls; the bounding box for fewer than four cells or a flat hull.

    Hulls of salted parts are taken first and then the hull of their corners, so no task holds a whole region.
    """
    def corners(pdf: pd.DataFrame) -> pd.DataFrame:
        h = _hull(pdf[["x", "y"]].to_numpy())
        return pd.DataFrame({"region_id": pdf["region_id"].iat[0], "x": h[:, 0], "y": h[:, 1]})

    def area(pdf: pd.DataFrame) -> pd.DataFrame:
        h = _hull(pdf[["x", "y"]].to_numpy())
        x, y = h[:, 0], h[:, 1]
        return pd.DataFrame({"region_id": [pdf["region_id"].iat[0]], "_hull": [abs(np.dot(x, np.roll(y, -1)) - np.dot(y, np.roll(x, -1))) / 2]})

    kind = cells.schema["region_id"].dataType.simpleString()
    salted = cells.withColumn("_salt", F.pmod(F.xxhash64("x", "y"), F.lit(salts)))
    parts = salted.groupBy("region_id", "_salt").applyInPandas(corners, f"region_id {kind}, x double, y double")
    hulls = parts.groupBy("region_id").applyInPandas(area, f"region_id {kind}, _hull double")
    n = cells.groupBy("region_id").agg(F.count("*").alias("_n"))
    return box_area(cells).join(hulls, "region_id").join(n, "region_id").select("region_id", F.when((F.col("_n") >= 4) & (F.col("_hull") > 0), F.col("_hull")).otherwise(F.col("area")).alias("area"))


def _k_and_l(own: DataFrame, counts: DataFrame, area: DataFrame, radii: tuple[float, ...], min_cells: Column) -> DataFrame:
    """K and L of (region_id, cell_type, _n) from unordered pairs (region_id, cell_type, radius, _pairs)."""
    out = own.withColumn("radius", F.explode(F.array(*[F.lit(r) for r in radii]))).join(counts, ["region_id", "cell_type", "radius"], "left").join(area, "region_id")
    k = F.when(F.col("_n") >= min_cells, F.col("area") * 2 * F.coalesce("_pairs", F.lit(0)) / (F.col("_n") * (F.col("_n") - 1)))
    return out.select("region_id", "cell_type", "radius", k.alias("k")).withColumn("l", F.sqrt(F.greatest("k", F.lit(0.0)) / math.pi) - F.col("radius"))


def _same_type(counts: DataFrame) -> DataFrame:
    return counts.select("region_id", F.col("a_group").alias("cell_type"), "radius", F.col("pairs").alias("_pairs"))


def ripley(cells: DataFrame, area: DataFrame, *, radii: tuple[float, ...] = (20.0, 50.0, 100.0, 200.0), by_type: bool = False, min_cells: int = 2, sample_n: int | None = None) -> DataFrame:
    """(region_id, cell_type, radius, k, l): Ripley's K without edge correction and Besag's L less r, all radii from one pass of `counted_pairs`.

    ``cell_type`` is "all" unless ``by_type``. Null with fewer than ``min_cells`` cells.
    """
    c = cells.filter("cell_type IS NOT NULL") if by_type else cells.withColumn("cell_type", F.lit("all"))
    c = subsample(c, sample_n) if sample_n and by_type else c
    counts = _same_type(counted_pairs(c, radii))
    own = c.groupBy("region_id", "cell_type").agg(F.count("*").cast("double").alias("_n"))
    return _k_and_l(own, counts, area, radii, F.lit(min_cells))


def ripley_and_by_type(cells: DataFrame, area: DataFrame, *, radii: tuple[float, ...] = (20.0, 50.0, 100.0, 200.0), min_cells: int = 2, min_typed: int = 4, sample_n: int = 1000) -> DataFrame:
    """`ripley` of all cells ("all") and by type with samples of ``sample_n``, from one join of close cells, or one `tiles.pair_counts` where they are `crowded`.

    A cell belongs to the group "all", and a sampled one to that of its type too. A type called "all" would meet the total's rows and is an error of the data.
    """
    order = F.md5(F.concat_ws(":", F.lit(42), F.col("cell_id").cast("string")).cast("binary"))
    place = F.row_number().over(Window.partitionBy("region_id", "cell_type").orderBy(order, "cell_id"))
    marked = materialize(cells.select("region_id", "cell_id", "x", "y", F.when(place <= sample_n, F.col("cell_type")).alias("cell_type")), "sampled-cells")
    if not crowded(marked, max(radii)):  # a pair of sampled cells of one type adds to that type, any other to none, and all add up to "all"
        pairs = half_pairs(marked, max(radii)).groupBy("region_id", F.when(F.col("a_type") == F.col("b_type"), F.col("a_type")).alias("cell_type")).agg(_hits(radii))
        pairs = materialize(pairs.select("region_id", "cell_type", F.inline("_c")), "pair-counts")
        total = pairs.groupBy("region_id", F.lit("all").alias("cell_type"), "radius").agg(F.sum("pairs").alias("_pairs"))
        counts = total.unionByName(pairs.filter("cell_type IS NOT NULL").withColumnRenamed("pairs", "_pairs"))
    else:
        groups = marked.select("region_id", "x", "y", F.explode(F.array_compact(F.array(F.lit("all"), F.col("cell_type").cast("string")))).alias("group"))
        counts = _same_type(tiles.pair_counts(groups, radii))
    size = F.count("*").cast("double").alias("_n")
    own = marked.groupBy("region_id", F.lit("all").alias("cell_type")).agg(size).union(marked.filter("cell_type IS NOT NULL").groupBy("region_id", "cell_type").agg(size))
    least = F.when(F.col("cell_type") == "all", min_cells).otherwise(min_typed)
    return _k_and_l(own, counts, area, radii, least)


def pair_correlation(k: DataFrame) -> DataFrame:
    """(region_id, cell_type, mid, g): the slope of K between neighbouring radii over 2 pi mid; the first bin starts at 0."""
    w = Window.partitionBy("region_id", "cell_type").orderBy("radius")
    r0, k0 = F.lag("radius", 1, 0.0).over(w), F.lag("k", 1, 0.0).over(w)
    mid = (F.col("radius") + r0) / 2
    return k.select("region_id", "cell_type", mid.alias("mid"), ((F.col("k") - k0) / (2 * math.pi * mid * (F.col("radius") - r0))).alias("g"))
