"""Counts and nearest distances of cells by square tiles: a task holds the cells of a tile and those near it, in arrays.

A tile is as wide as some `TILE_CELLS` cells need, and no narrower than the radius; cells are copied to the tiles they are near. So what is shuffled grows with the
cells alone, whatever the radius and the density, and a large region spreads over many tasks. Cells without a place are in no pair.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cellgrove.scratch import materialize

#: Cells of a tile, on average over the cells.
TILE_CELLS = 20_000
#: Places that a task has around a tile; where there are more, they are dealt to several tasks by hash.
NEAR_PLACES = 2_000_000
#: Cells, and pairs of cells, that are looked at by one operation on arrays.
ROWS, PAIRS = 20_000, 2_000_000
#: A `Lattice` has at most so many places a point, and so many numbers.
SPARSE, LATTICE = 4, 5_000_000
KEY = ["_tx", "_ty", "_s"]


def _placed(cells: DataFrame, *keep: str) -> DataFrame:
    x, y = F.col("x").cast("double"), F.col("y").cast("double")
    some = lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))
    return cells.filter(F.col("region_id").isNotNull() & some(x) & some(y)).select("region_id", *keep, x.alias("x"), y.alias("y"))


def tile_width(points: DataFrame, radius: float) -> float:
    """The radius, or wider where cells are so few that a tile of `TILE_CELLS` is."""
    squares = points.groupBy("region_id", F.floor(F.col("x") / radius), F.floor(F.col("y") / radius)).agg(F.count("*").cast("double").alias("n"))
    own = squares.agg(F.sum(F.col("n") * F.col("n")) / F.sum("n")).first()[0] or 1.0
    return radius * max(1.0, (TILE_CELLS / own) ** 0.5)


def _near(points: DataFrame, width: float, radius: float) -> DataFrame:
    """The points, once for each tile that they are in or within the radius of."""
    far = radius * (1 + 1e-9)
    span = lambda c: F.explode(F.sequence(F.floor((F.col(c) - far) / width), F.floor((F.col(c) + far) / width)))
    return points.withColumn("_tx", span("x")).withColumn("_ty", span("y"))


def _own(points: DataFrame, width: float) -> DataFrame:
    return points.withColumns({"_tx": F.floor(F.col("x") / width), "_ty": F.floor(F.col("y") / width)})


def _by_tile(own: DataFrame, near: DataFrame):
    """Both sides by tile. The tasks are many whatever the bytes, since their work is in arrays."""
    both, spark = own.withColumn("_own", F.lit(True)).unionByName(near.withColumn("_own", F.lit(False))), own.sparkSession
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism)
    return both.repartition(tasks, "region_id", *KEY).groupBy("region_id", *KEY)


def _flat(lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(which range, place) of all places of the ranges from lo to before hi."""
    n = np.maximum(hi - lo, 0)
    which = np.repeat(np.arange(len(n)), n)
    return which, np.arange(len(which)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(lo, n)


def _pieces(n: np.ndarray) -> list[tuple[int, int]]:
    """Stretches of rows with some PAIRS pairs each."""
    at = np.r_[0, np.flatnonzero(np.diff(np.cumsum(n) // PAIRS)) + 1, len(n)]
    return list(zip(at[:-1].tolist(), at[1:].tolist(), strict=True))


class Strips:
    """Weighted points in strips of their height, sorted along x. Counts within a radius are differences of running sums; points near the rim are compared one by one."""

    def __init__(self, x: np.ndarray, y: np.ndarray, g: np.ndarray, n: np.ndarray, groups: int):
        rows = np.unique(y)
        width, height = np.ptp(x), np.ptp(y)
        # A strip costs four searches, a point near the rim some 1.5: of height h, 2 r / h strips and 4 r h points of unit density.
        high = (4 / 3 * max(width, 1e-300) * max(height, 1e-300) / len(x)) ** 0.5
        strip = np.searchsorted(rows, y) if len(rows) * high <= 2 * height + high else np.floor((y - rows[0]) / high).astype(np.int64)
        strip = np.unique(strip, return_inverse=True)[1]
        order = np.lexsort((x, strip))
        self.x, self.y, self.g, self.n, strip = x[order], y[order], g[order], n[order], strip[order]
        starts = np.flatnonzero(np.r_[True, strip[1:] != strip[:-1]])
        self.low, self.high = np.minimum.reduceat(self.y, starts), np.maximum.reduceat(self.y, starts)
        self.x0, self.width, self.gap = x.min(), width, max(1.0, width / 1000)
        self.key = strip * (width + self.gap) + (self.x - self.x0)
        self.slack = 2**-48 * (len(starts) + 1) * (width + self.gap + abs(self.x0))
        self.sums = np.zeros((len(x) + 1, groups), dtype=np.int64)
        self.sums[np.arange(1, len(x) + 1), self.g] = self.n
        np.cumsum(self.sums, axis=0, out=self.sums)

    def _find(self, strip: np.ndarray, x: np.ndarray, side: str) -> np.ndarray:
        at = np.clip(x - self.x0, -self.gap / 4, self.width + self.gap / 4)
        return np.searchsorted(self.key, strip * (self.width + self.gap) + at, side)

    def counts(self, x: np.ndarray, y: np.ndarray, g: np.ndarray, n: np.ndarray, radius: float) -> np.ndarray:
        """Sums of n * n of pairs of a given point and one of the strips within the radius, by both groups."""
        groups = self.sums.shape[1]
        out, r2 = np.zeros((groups, groups), dtype=np.int64), radius * radius
        order = np.lexsort((x, y))
        for i in range(0, len(order), ROWS):
            rows = order[i : i + ROWS]
            ax, ay, ag, an = x[rows], y[rows], g[rows], n[rows]
            far = radius * (1 + 1e-9) + self.slack
            first, last = np.searchsorted(self.high, ay - far), np.searchsorted(self.low, ay + far, "right")
            inner = np.zeros((len(rows), groups), dtype=np.int64)
            for d in range(int((last - first).max(initial=0))):
                own = np.flatnonzero(first + d < last)
                s, px, py = first[own] + d, ax[own], ay[own]
                low, high = self.low[s], self.high[s]
                nearest, farthest = np.maximum(0.0, np.maximum(low - py, py - high)), np.maximum(np.abs(py - low), np.abs(py - high))
                reach = np.sqrt(np.maximum(0.0, r2 - nearest * nearest)) + 1e-9 * radius + self.slack
                sure = np.sqrt(np.maximum(0.0, r2 - farthest * farthest)) - 1e-9 * radius - self.slack
                lo, hi = self._find(s, px - reach, "left"), self._find(s, px + reach, "right")
                lo_in, hi_in = self._find(s, px - sure, "left"), self._find(s, px + sure, "right")
                none = (sure <= 0) | (lo_in >= hi_in)
                lo_in, hi_in = np.where(none, hi, lo_in), np.where(none, hi, hi_in)
                inner[own] += self.sums[hi_in] - self.sums[lo_in]
                for a, b in ((lo, lo_in), (hi_in, hi)):
                    for p, q in _pieces(b - a) if (b > a).any() else ():
                        of, at = _flat(a[p:q], b[p:q])
                        of += p
                        dx, dy = px[of] - self.x[at], py[of] - self.y[at]
                        hit = dx * dx + dy * dy <= r2
                        of, at = own[of[hit]], at[hit]
                        np.add.at(out, (ag[of], self.g[at]), an[of] * self.n[at])
            for k in np.unique(ag):
                out[k] += an[ag == k] @ inner[ag == k]
        return out


class Lattice:
    """Weighted points at the places of rows and columns, which aren't many more than the points (as with whole pixels). Counts within a radius are differences of running
    sums along rows, of all places of the own points at once, between columns that are found once for each distance of two rows: exact, with no search a point."""

    def __init__(self, x: np.ndarray, y: np.ndarray, g: np.ndarray, n: np.ndarray, groups: int):
        self.xs, ix = np.unique(x, return_inverse=True)
        self.ys, iy = np.unique(y, return_inverse=True)
        sums = np.zeros((len(self.ys), len(self.xs) + 1, groups), dtype=np.int64)
        sums[iy, ix + 1, g] = n
        few = n.sum() < 2**31  # then so are all sums
        self.sums = np.cumsum(sums, axis=1).reshape(-1, groups).astype(np.int32 if few else np.int64)

    @staticmethod
    def fits(own: tuple[np.ndarray, np.ndarray], near: tuple[np.ndarray, np.ndarray], groups: int, radius: float) -> bool:
        """Whether places of either side are at most SPARSE times its points, and distances of rows no more than some rows."""
        rows = []
        for x, y in (own, near):
            ys = np.unique(y)
            places = len(np.unique(x)) * len(ys)
            if places > SPARSE * len(x) or places * groups > LATTICE:
                return False
            rows.append(ys)
        return len(np.unique(_row_distances(*rows, radius)[1])) <= 2 * sum(map(len, rows))

    def _columns(self, x: np.ndarray, d2: np.ndarray, r2: float) -> tuple[np.ndarray, np.ndarray]:
        """The columns from lo to before hi that are within the radius of each x, for each squared distance of rows."""
        last = len(self.xs) - 1
        reach = np.sqrt(np.maximum(0.0, r2 - d2))[:, None]
        lo, hi = np.searchsorted(self.xs, x - reach, "left"), np.searchsorted(self.xs, x + reach, "right")

        def hit(k: np.ndarray) -> np.ndarray:
            dx = x - self.xs[np.clip(k, 0, last)]
            return (dx * dx + d2[:, None] <= r2) & (k >= 0) & (k <= last)

        while (more := hit(lo - 1)).any():
            lo -= more
        while (less := (lo < hi) & ~hit(lo)).any():
            lo += less
        while (more := hit(hi)).any():
            hi += more
        while (less := (lo < hi) & ~hit(hi - 1)).any():
            hi -= less
        return lo, np.maximum(lo, hi)

    def counts(self, x: np.ndarray, y: np.ndarray, g: np.ndarray, n: np.ndarray, radius: float) -> np.ndarray:
        """As `Strips.counts`."""
        groups = self.sums.shape[1]
        ax, jx = np.unique(x, return_inverse=True)
        ay, jy = np.unique(y, return_inverse=True)
        first, apart = _row_distances(ay, self.ys, radius)
        each, which = np.unique(apart, return_inverse=True)
        lo, hi = self._columns(ax, each * each, radius * radius)
        which, within = which.reshape(apart.shape), np.zeros((len(ay), len(ax), groups), dtype=self.sums.dtype)
        for d in range(apart.shape[1]):
            own = np.flatnonzero(np.isfinite(apart[:, d]))
            start, w = (first[own] + d)[:, None] * (len(self.xs) + 1), which[own, d]
            within[own] += self.sums.take(start + hi[w], axis=0) - self.sums.take(start + lo[w], axis=0)
        inner, out = within[jy, jx].astype(np.int64), np.zeros((groups, groups), dtype=np.int64)
        for k in np.unique(g):
            out[k] = n[g == k] @ inner[g == k]
        return out


def _row_distances(own: np.ndarray, rows: np.ndarray, radius: float) -> tuple[np.ndarray, np.ndarray]:
    """For each of ``own`` the first of the sorted ``rows`` within the radius, and the distances to it and those after it, infinite beyond the radius."""
    far = radius * (1 + 1e-9) + 2**-48 * max(np.abs(own).max(), np.abs(rows).max())
    first, last = np.searchsorted(rows, own - far), np.searchsorted(rows, own + far, "right")
    at = first[:, None] + np.arange(int((last - first).max(initial=0)))
    return first, np.where(at < last[:, None], np.abs(own[:, None] - rows[np.minimum(at, len(rows) - 1)]), np.inf)


def _codes(values: pa.ChunkedArray) -> tuple[list, np.ndarray]:
    """The values that occur, and the place of each row's."""
    coded = pc.dictionary_encode(values.combine_chunks() if isinstance(values, pa.ChunkedArray) else values)
    coded = coded.combine_chunks() if isinstance(coded, pa.ChunkedArray) else coded
    return coded.dictionary, coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)


def pair_counts(cells: DataFrame, radii: tuple[float, ...], *, across: bool = False) -> DataFrame:
    """(region_id, a_group, b_group, radius, pairs): unordered pairs of different rows within each radius, of (region_id, group, x, y).

    Pairs of one group, or of any two groups (``a_group`` the smaller) with ``across``; groups without a pair near have no row. Rows of a group at one place are one
    point with a number. A task counts the pairs of the points of a tile with those in and around it by `Strips`: some r times the root of the density for each point; or, where
    points fill rows and columns, by a `Lattice`, whose work doesn't grow with the points but with the places: some r for each.
    """
    radii = tuple(sorted(float(r) for r in radii))
    points = _placed(cells.filter("group IS NOT NULL"), "group").groupBy("region_id", "group", "x", "y").agg(F.count("*").alias("n"))
    points = materialize(points, "tile-points")
    width = tile_width(points, radii[-1])
    tiles = points.groupBy("region_id", F.floor(F.col("x") / width), F.floor(F.col("y") / width)).agg(F.count("*").alias("n"))
    salts = -(-9 * (tiles.agg(F.max("n")).first()[0] or 1) // NEAR_PLACES)  # a tile has no more than eight around it
    own = _own(points, width).withColumn("_s", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    near = _near(points, width, radii[-1]).withColumn("_s", F.pmod(F.xxhash64("x", "y"), F.lit(salts)).cast("int"))
    kinds = {c: points.schema[c].dataType.simpleString() for c in ("region_id", "group")}

    def count(t: pa.Table) -> pa.Table:
        names, g = _codes(t.column("group"))
        x, y, n, is_own = (t.column(c).to_numpy() for c in ("x", "y", "n", "_own"))
        near, found = ~is_own, []
        first_task = t.column("_s")[0].as_py() == 0  # of those of a tile
        parts = [np.arange(len(names))] if across else [np.array([k]) for k in range(len(names))]
        for part in parts if is_own.any() and near.any() else ():
            mine, others = is_own & np.isin(g, part), near & np.isin(g, part)
            if not mine.any() or not others.any():
                continue
            code = np.searchsorted(part, g)
            lattice = Lattice.fits((x[mine], y[mine]), (x[others], y[others]), len(part), radii[-1])
            points_near = (Lattice if lattice else Strips)(x[others], y[others], code[others], n[others], len(part))
            for k, r in enumerate(radii):
                m = points_near.counts(x[mine], y[mine], code[mine], n[mine], r)
                found += [(part[i], part[j], k, int(m[i, j])) for i, j in zip(*np.nonzero(m), strict=True)]
        if first_task:  # without each row's pair with itself
            itself = np.bincount(g[is_own], n[is_own], len(names)).astype(np.int64)
            found += [(i, i, k, -int(v)) for i, v in enumerate(itself) if v for k in range(len(radii))]
        a, b, k, m = (np.array(v, dtype=np.int64) for v in zip(*found, strict=True)) if found else (np.zeros(0, dtype=np.int64),) * 4
        region = t.column("region_id").slice(0, 1).combine_chunks().take(pa.array(np.zeros(len(a), dtype=np.int64)))
        return pa.Table.from_arrays([region, names.take(pa.array(a)), names.take(pa.array(b)), pa.array(k), pa.array(m)], ["region_id", "a_group", "b_group", "k", "m"])

    counted = _by_tile(own, near).applyInArrow(count, f"region_id {kinds['region_id']}, a_group {kinds['group']}, b_group {kinds['group']}, k long, m long")
    total = counted.filter("a_group <= b_group").groupBy("region_id", "a_group", "b_group", "k").agg(F.sum("m").alias("m"))
    radius = F.element_at(F.array(*[F.lit(r) for r in radii]), (F.col("k") + 1).cast("int"))
    pairs = F.when(F.col("a_group") == F.col("b_group"), F.expr("m div 2")).otherwise(F.col("m"))  # a pair of one group comes from both of its cells
    return total.select("region_id", "a_group", "b_group", radius.alias("radius"), pairs.alias("pairs")).filter("pairs > 0")


def nearest_squares(ax: np.ndarray, ay: np.ndarray, bx: np.ndarray, by: np.ndarray, radius: float) -> np.ndarray:
    """Squared distance from each a to the nearest b, infinite if none is within the radius: looks at squares of a fine grid around each a, twice as wide each time."""
    x0, y0 = bx.min(), by.min()
    w, h = max(np.ptp(bx), 1e-9), max(np.ptp(by), 1e-9)
    fine = max((w * h / len(bx)) ** 0.5, max(w, h) / 2000, radius / 2000)
    nx, ny = int(w / fine) + 1, int(h / fine) + 1
    cell = np.minimum(ny - 1, ((by - y0) / fine).astype(np.int64)) * nx + np.minimum(nx - 1, ((bx - x0) / fine).astype(np.int64))
    order = np.argsort(cell, kind="stable")
    bx, by = bx[order], by[order]
    starts = np.r_[0, np.cumsum(np.bincount(cell, minlength=nx * ny))]
    ix, iy = np.floor((ax - x0) / fine).astype(np.int64), np.floor((ay - y0) / fine).astype(np.int64)
    best, active, k = np.full(len(ax), np.inf), np.arange(len(ax)), 1
    while len(active):
        for i in range(0, len(active), ROWS):
            own = active[i : i + ROWS]
            left, right = np.clip(ix[own] - k, 0, nx), np.clip(ix[own] + k + 1, 0, nx)
            for d in range(-k, k + 1):
                row = iy[own] + d
                in_grid = np.flatnonzero((row >= 0) & (row < ny) & (left < right))
                lo, hi = starts[row[in_grid] * nx + left[in_grid]], starts[row[in_grid] * nx + right[in_grid]]
                some = np.flatnonzero(hi > lo)
                of_rows, lo, hi = own[in_grid[some]], lo[some], hi[some]
                for p, q in _pieces(hi - lo) if len(lo) else ():
                    of, at = _flat(lo[p:q], hi[p:q])
                    dx, dy = ax[of_rows[p + of]] - bx[at], ay[of_rows[p + of]] - by[at]
                    least = np.minimum.reduceat(dx * dx + dy * dy, np.cumsum(hi[p:q] - lo[p:q]) - (hi[p:q] - lo[p:q]))
                    best[of_rows[p:q]] = np.minimum(best[of_rows[p:q]], least)
        sure = k * fine * (1 - 1e-9)  # what wasn't looked at is farther
        active = active[(best[active] > sure * sure) & (sure <= radius)]
        k *= 2
    return np.where(best <= radius * radius, best, np.inf)


def nearest_sums(cells: DataFrame, others: DataFrame, cap: float) -> DataFrame:
    """(region_id, a_type, b_type, total, least, n): of the distances from ``cells`` (region_id, cell_type, x, y) to the nearest of each other type of ``others``, those up to ``cap``.

    A tile looks first a quarter of its width around; cells that find a type no nearer are asked again with four times the radius and tiles in proportion, with those types alone. Tasks
    add up distances and send on only the cells to ask again.
    """
    asked = materialize(_placed(cells.filter("cell_type IS NOT NULL"), "cell_type"), "nearest-cells")
    points = materialize(_placed(others.filter("cell_type IS NOT NULL"), "cell_type").distinct(), "nearest-others")
    types = [r[0] for r in points.select("cell_type").distinct().orderBy("cell_type").collect()]  # the types
    base = tile_width(points, cap / 16) if types else cap
    region, kind = asked.schema["region_id"].dataType.simpleString(), asked.schema["cell_type"].dataType.simpleString()
    every = list(range(len(types)))
    code = F.array_position(F.array(*[F.lit(t) for t in types]), F.col("cell_type")) - 1 if types else F.lit(0)
    # ``ask``: the place of the type that a cell looks for, -1 for all.
    asked = asked.select("region_id", F.coalesce(code, F.lit(-1)).cast("int").alias("type"), "x", "y", "cell_type", F.lit(-1).alias("ask"))
    points = points.select("region_id", code.cast("int").alias("type"), "x", "y", F.lit(None).cast(kind).alias("cell_type"), F.lit(-1).alias("ask"))
    def looking(radius: float, ends: bool):
        def look(t: pa.Table) -> pa.Table:
            is_own = t.column("_own").to_numpy()
            x, y, kinds, ask = (t.column(c).to_numpy() for c in ("x", "y", "type", "ask"))
            labels = t.column("cell_type").combine_chunks()
            of_label, label = _codes(t.column("cell_type").filter(pa.array(is_own)))
            mine, rows, sums = np.flatnonzero(is_own), [], []
            for b in every:
                use = np.flatnonzero((ask[mine] < 0) | (ask[mine] == b))
                use = use[kinds[mine[use]] != b]
                near = np.flatnonzero(~is_own & (kinds == b))
                if not len(use):
                    continue
                a = mine[use]
                d2 = nearest_squares(x[a], y[a], x[near], y[near], radius) if len(near) else np.full(len(a), np.inf)
                hit = np.isfinite(d2)
                for k in np.unique(label[use[hit]]):
                    d = np.sqrt(d2[hit & (label[use] == k)])
                    sums.append((k, b, float(d.sum()), float(d.min()), len(d)))
                if not ends:
                    rows.append((a[~hit], np.full((~hit).sum(), b)))
            again, ask_b = (np.concatenate(v) for v in zip(*rows, strict=True)) if rows else (np.zeros(0, dtype=np.int64),) * 2
            n, m = len(sums), len(again)
            k, b, total, least, count = zip(*sums, strict=True) if sums else ((),) * 5
            null = lambda v, to: pa.nulls(v, to)
            region_of = t.column("region_id").slice(0, 1).combine_chunks().take(pa.array(np.zeros(n + m, dtype=np.int64)))
            label_of = pa.concat_arrays([of_label.take(pa.array(k, pa.int64())), labels.take(pa.array(again))])
            both = lambda one, two, to: pa.concat_arrays([pa.array(one, to) if one is not None else null(n, to), pa.array(two, to) if two is not None else null(m, to)])
            return pa.Table.from_arrays([
                region_of, both(None, kinds[again], pa.int32()), both(None, x[again], pa.float64()), both(None, y[again], pa.float64()), label_of, both(b, ask_b, pa.int32()),
                both(total, None, pa.float64()), both(least, None, pa.float64()), both(count, None, pa.int64())], ["region_id", "type", "x", "y", "cell_type", "ask", "total", "least", "n"])

        return look

    radius, found, near = min(cap, base / 4), [], points
    while types:
        width, ends = max(base, 2 * radius), radius >= cap

        s = F.lit(0).alias("_s")
        tiled = _by_tile(_own(asked, width).withColumn("_s", s), _near(near, width, radius).withColumn("_s", s))
        schema = f"region_id {region}, type int, x double, y double, cell_type {kind}, ask int, total double, least double, n long"
        out = materialize(tiled.applyInArrow(looking(radius, ends), schema), "nearest-sums")
        found.append(out.filter("n IS NOT NULL"))
        asked = out.filter("n IS NULL").select("region_id", "type", "x", "y", "cell_type", "ask")
        if ends or asked.isEmpty():
            break
        radius = min(cap, 4 * radius)
        # Only those others go on that a cell asks for in a tile near them.
        width = max(base, 2 * radius)
        wanted = _own(asked, width).select("region_id", "_tx", "_ty", F.col("ask").alias("type")).distinct()
        near = materialize(_near(points, width, radius).join(wanted, ["region_id", "_tx", "_ty", "type"], "left_semi").select(points.columns).distinct(), "nearest-others")
    if not found:
        return asked.select("region_id", F.col("cell_type").alias("a_type"), F.col("cell_type").alias("b_type"), F.lit(0.0).alias("total"), F.lit(0.0).alias("least"), F.lit(0).cast("long").alias("n")).limit(0)
    sums = reduce(DataFrame.unionByName, found)
    b_type: Column = F.get(F.array(*[F.lit(t) for t in types]), F.col("ask"))
    return sums.groupBy("region_id", F.col("cell_type").alias("a_type"), b_type.alias("b_type")).agg(F.sum("total").alias("total"), F.min("least").alias("least"), F.sum("n").alias("n"))
