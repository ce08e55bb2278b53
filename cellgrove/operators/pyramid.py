"""Counts and distances of pairs of cells from pyramids of grids: pairs of whole grid cells are judged by their boxes, and few pairs of cells are compared.

A pyramid has one grid a level, each half as wide as the one before. Two nodes (the cells of a region and group in one grid cell) have the least and the largest
distance that their boxes allow. Boxes are those of the cells, not of the grid, and differences, squares and sums keep their order when they are rounded, so what a box
decides is what comparing each of its cells would give, to the last bit. Nodes meet on (region, group, grid cell): a large region spreads over many tasks. Cells without a place are in no pair.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cellgrove.scratch import at_most, materialize

#: Levels of a pyramid; the finest grid is 2**DEPTH times as narrow as the radius.
DEPTH = 16
#: Two nodes with at most so many pairs of cells are compared cell by cell; opening them further costs more than it saves.
SMALL = 1024
NODE = ("group", "ix", "iy", "n", "x0", "x1", "y0", "y1")


def _points(cells: DataFrame, width: float, *keep: str) -> DataFrame:
    """(region_id, group, x, y, _px, _py, ...): cells with a place, and their place in the finest grid."""
    x, y = F.col("x").cast("double"), F.col("y").cast("double")
    placed = cells.select("region_id", "group", *keep, x.alias("x"), y.alias("y")).filter("x IS NOT NULL AND y IS NOT NULL AND NOT isnan(x) AND NOT isnan(y)")
    return placed.withColumns({"_px": F.floor(F.col("x") / width * 2**DEPTH), "_py": F.floor(F.col("y") / width * 2**DEPTH)})


def _nodes(points: DataFrame, level: int, side: str) -> DataFrame:
    """The nodes of a level with columns named ``side_...``, and their place in the level above (``side_ux``, ``side_uy``)."""
    at = [F.shiftright(c, DEPTH - level).alias(i) for c, i in (("_px", "ix"), ("_py", "iy"))]
    boxes = [f(c).alias(f"{c}{i}") for c in "xy" for i, f in ((0, F.min), (1, F.max))]
    nodes = points.groupBy("region_id", "group", *at).agg(F.count("*").alias("n"), *boxes)
    above = [F.shiftright(i, 1).alias(f"{side}_{u}") for i, u in (("ix", "ux"), ("iy", "uy"))]
    return nodes.select("region_id", *[F.col(c).alias(f"{side}_{c}") for c in NODE], *above)


def _square(v: Column) -> Column:
    return v * v


def _least() -> Column:
    """Squared distance of the boxes of both nodes."""
    gap = lambda c: F.greatest(F.lit(0.0), F.col(f"a_{c}0") - F.col(f"b_{c}1"), F.col(f"b_{c}0") - F.col(f"a_{c}1"))
    return _square(gap("x")) + _square(gap("y"))


def _largest() -> Column:
    """Squared distance of the furthest corners of both boxes."""
    span = lambda c: F.greatest(F.col(f"a_{c}1") - F.col(f"b_{c}0"), F.col(f"b_{c}1") - F.col(f"a_{c}0"))
    return _square(span("x")) + _square(span("y"))


def _neighbours(a: DataFrame, b: DataFrame, on: list[str]) -> DataFrame:
    """Nodes of the top level and those of the nine grid cells around."""
    around = F.sequence(F.lit(-1), F.lit(1))
    near = lambda c: F.explode(F.transform(around, lambda d: F.col(f"a_{c}") + d))
    spread = a.withColumn("b_ix", near("ix")).withColumn("b_iy", near("iy"))
    return spread.join(b, ["region_id", "b_ix", "b_iy", *on])


def _opened(pairs: DataFrame, a: DataFrame, b: DataFrame, *, keep: list[str]) -> DataFrame:
    """Pairs of the nodes that lie in each pair of nodes of the level above."""
    up = [F.col(f"{s}_{i}").alias(f"{s}_{u}") for s in "ab" for i, u in (("ix", "ux"), ("iy", "uy"))]
    above = pairs.select("region_id", "a_group", "b_group", *up, *keep)
    return above.join(a, ["region_id", "a_group", "a_ux", "a_uy"]).join(b, ["region_id", "b_group", "b_ux", "b_uy"])


def _compared(small: list[tuple[int, DataFrame]], a: DataFrame, b: DataFrame, *, keep: list[str], a_keep: tuple[str, ...] = ()) -> DataFrame:
    """Pairs of cells of small pairs of nodes of all levels: their columns and d2. A cell is copied once a level."""
    pairs = reduce(DataFrame.unionByName, [p.select("region_id", "a_group", "a_ix", "a_iy", "b_group", "b_ix", "b_iy", *keep, F.lit(k).alias("_level")) for k, p in small])

    def cells(points: DataFrame, side: str, *more: str) -> DataFrame:
        at = lambda c: F.expr(f"shiftright({c}, {DEPTH} - _level)")
        spread = points.withColumn("_level", F.explode(F.array(*[F.lit(k) for k, _ in small])))
        return spread.select("region_id", "_level", F.col("group").alias(f"{side}_group"), at("_px").alias(f"{side}_ix"), at("_py").alias(f"{side}_iy"), F.col("x").alias(f"{side}x"), F.col("y").alias(f"{side}y"), *more)

    on = lambda s: ["region_id", "_level", f"{s}_group", f"{s}_ix", f"{s}_iy"]
    found = pairs.join(cells(a, "a", *a_keep), on("a")).join(cells(b, "b"), on("b"))
    return found.withColumn("d2", _square(F.col("ax") - F.col("bx")) + _square(F.col("ay") - F.col("by")))


def pair_counts(cells: DataFrame, radii: tuple[float, ...], *, across: bool = False) -> DataFrame:
    """(region_id, a_group, b_group, radius, pairs): unordered pairs of different rows within each radius, of (region_id, group, x, y).

    Pairs of one group, or of any two groups (``a_group`` the smaller) with ``across``. Rows without a group are left out, and groups without a pair near have
    no row. All radii are counted in one descent: a pair of nodes within a radius counts as a product of sizes, one beyond it not at all, and only those that a radius cuts are
    opened, for those radii alone. So the work grows with the circles' rims, not with the pairs.
    """
    radii = tuple(sorted(radii))
    width = radii[-1] * (1 + 1e-9)  # so that rounding leaves no pair beyond the neighbours
    points = materialize(_points(cells.filter("group IS NOT NULL"), width), "pyramid-points")
    a, b = _nodes(points, 0, "a"), _nodes(points, 0, "b")
    place = lambda s: F.struct(*[f"{s}_{c}" for c in ("group", "ix", "iy")])
    ordered = place("a") <= place("b")
    if across:
        pairs = _neighbours(a, b, []).filter(ordered)
    else:
        pairs = _neighbours(a.withColumn("b_group", F.col("a_group")), b, ["b_group"]).filter(ordered)
    pairs = pairs.withColumns({"_lo": F.lit(0), "_hi": F.lit(len(radii)), "_own": place("a") == place("b")})
    keys, keep = ["region_id", "a_group", "b_group"], ["_lo", "_hi", "_own"]
    decided, small, level = [], [], 0
    while True:
        beyond, not_within = (reduce(lambda s, v: s + v, [F.when(d > r * r, 1).otherwise(0) for r in radii]) for d in (_least(), _largest()))
        lo = F.least("_hi", F.greatest("_lo", beyond))  # radii up to here end before the other node, those from hi on hold both
        n = F.when(F.col("_own"), F.col("a_n") * (F.col("a_n") - 1) / 2).otherwise(F.col("a_n") * F.col("b_n")).cast("long")
        judged = pairs.withColumns({"_was": F.col("_hi"), "_n": n, "_new": lo}).withColumn("_hi", F.greatest("_new", F.least("_hi", not_within)))
        judged = judged.withColumn("_lo", F.col("_new")).filter("_n > 0 AND (_lo < _hi OR _hi < _was)")
        judged = materialize(judged.select(*keys, "a_ix", "a_iy", "b_ix", "b_iy", "a_n", *keep, "_was", "_n"), "pyramid-pairs")
        sums = [F.sum(F.when((F.col("_hi") <= k) & (k < F.col("_was")), F.col("_n")).otherwise(0)) for k in range(len(radii))]
        decided.append(judged.groupBy(*keys).agg(F.array(*[2 * s for s in sums]).alias("_c")))
        open_ = judged.filter("_lo < _hi")
        large = open_.filter(F.col("_n") > SMALL)
        more = level < DEPTH and not at_most(large, 0)
        small.append((level, open_.filter(F.col("_n") <= SMALL) if more else open_))
        if not more:
            break
        level += 1
        pairs = _opened(large, _nodes(points, level, "a"), _nodes(points, level, "b"), keep=keep).filter(~F.col("_own") | ordered)
        pairs = pairs.withColumn("_own", F.col("_own") & (place("a") == place("b")))
    # In a node's pair with itself each pair of cells comes twice and each cell with itself; elsewhere each pair comes once.
    asked = lambda k: (F.col("_lo") <= k) & (k < F.col("_hi"))
    hits = [F.sum(F.when(asked(k) & (F.col("d2") <= r * r), F.when(F.col("_own"), 1).otherwise(2)).otherwise(0)) for k, r in enumerate(radii)]
    decided.append(_compared(small, points, points, keep=keep).groupBy(*keys).agg(F.array(*hits).alias("_c")))
    selves = reduce(DataFrame.unionByName, [p.filter("_own") for _, p in small])
    decided.append(selves.groupBy(*keys).agg(F.array(*[F.sum(F.when(asked(k), -F.col("a_n")).otherwise(0)) for k in range(len(radii))]).alias("_c")))
    total = reduce(DataFrame.unionByName, decided).groupBy(*keys).agg(F.array(*[F.sum(F.get("_c", F.lit(k))) for k in range(len(radii))]).alias("_c"))
    rows = F.array(*[F.struct(F.lit(float(r)).alias("radius"), F.expr(f"_c[{k}] div 2").alias("pairs")) for k, r in enumerate(radii)])
    return total.select(*keys, F.inline(rows)).filter("pairs > 0")


def nearest(cells: DataFrame, others: DataFrame, cap: float) -> DataFrame:
    """(region_id, cell_id, group, dist): from each of ``cells`` (region_id, cell_id, x, y) to the nearest row of each group of ``others`` (region_id, group, x, y).

    Groups farther than ``cap`` have no row. ``cell_id`` tells the cells of a region apart. A node of cells has candidates among the nodes of a group: those not
    farther from it than the furthest corner of the candidate that is nearest by this measure. The levels narrow that bound, whatever the distance, so a cell meets only what may be its
    nearest; there are no rings to grow.
    """
    width = cap * (1 + 1e-9)
    a_points = materialize(_points(cells.withColumn("group", F.lit(0)), width, "cell_id"), "nearest-cells")
    b_points = materialize(_points(others.filter("group IS NOT NULL"), width), "nearest-others")
    pairs = _neighbours(_nodes(a_points, 0, "a"), _nodes(b_points, 0, "b"), []).withColumn("_bound", F.lit(cap * cap))
    asks = Window.partitionBy("region_id", "a_ix", "a_iy", "b_group")
    small, level = [], 0
    while True:
        judged = pairs.withColumns({"_low": _least(), "_bound": F.least("_bound", F.min(_largest()).over(asks))}).filter("_low <= _bound")
        judged = materialize(judged.select("region_id", "a_group", "a_ix", "a_iy", "b_group", "b_ix", "b_iy", "_bound", (F.col("a_n") * F.col("b_n")).alias("_n")), "nearest-nodes")
        large = judged.filter(F.col("_n") > SMALL)
        more = level < DEPTH and not at_most(large, 0)
        small.append((level, judged.filter(F.col("_n") <= SMALL) if more else judged))
        if not more:
            break
        level += 1
        pairs = _opened(large, _nodes(a_points, level, "a"), _nodes(b_points, level, "b"), keep=["_bound"])
    found = _compared(small, a_points, b_points, keep=[], a_keep=("cell_id",)).filter(F.col("d2") <= cap * cap)
    return found.groupBy("region_id", "cell_id", F.col("b_group").alias("group")).agg(F.sqrt(F.min("d2")).alias("dist"))
