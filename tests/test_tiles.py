"""Counts and nearest distances by tiles against all pairs, on integer and other places, sparse and dense."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from cellgrove.operators import spatial, tiles


@pytest.fixture(scope="module")
def cells(spark):
    rng = np.random.default_rng(5)
    places = [*rng.integers(-60, 60, (700, 2)), *rng.normal(20, 0.3, (200, 2)), *rng.uniform(-900, 900, (60, 2)), *np.full((30, 2), 7.0), *[(i, 3.0) for i in range(40)]]
    rows = [(r, i, "abc"[i % 3] if i % 5 else "d", float(x), float(y)) for r in (0, 1) for i, (x, y) in enumerate(places) if r == 0 or i > 700]
    rows += [(0, 9000, "a", None, 1.0), (0, 9001, "b", float("inf"), 1.0), (0, 9002, None, 1.0, 1.0), (2, 0, "a", 0.0, 0.0), (2, 1, "b", 300.0, 400.0), (None, 1, "b", 0.0, 0.0), (3, 5, "c", 1.0, 2.0)]
    return spark.createDataFrame(rows, "region_id int, cell_id int, cell_type string, x double, y double").repartition(3)


def by_region(cells):
    some = cells.filter("cell_type IS NOT NULL AND x IS NOT NULL AND x < 1e300 AND region_id IS NOT NULL")
    for key, c in some.toPandas().groupby("region_id"):
        dx, dy = c.x.to_numpy()[:, None] - c.x.to_numpy(), c.y.to_numpy()[:, None] - c.y.to_numpy()
        yield int(key), c.cell_type.to_numpy(), dx * dx + dy * dy


@pytest.mark.parametrize("across", [False, True])
@pytest.mark.parametrize("tile,near", [(50, 60), (20_000, 2_000_000)])
def test_pair_counts(cells, monkeypatch, across, tile, near):
    """Small tiles with their surroundings dealt to several tasks, and one large tile; 5 and 25 are distances of many pairs of integer places."""
    monkeypatch.setattr(tiles, "TILE_CELLS", tile)
    monkeypatch.setattr(tiles, "NEAR_PLACES", near)
    radii = (5.0, 25.0, 0.5)
    got = {(r.region_id, r.a_group, r.b_group, r.radius): r.pairs for r in tiles.pair_counts(cells.withColumnRenamed("cell_type", "group"), radii, across=across).collect()}
    want = {}
    for key, t, d2 in by_region(cells):
        for a in "abcd":
            for b in "abcd" if across else a:
                for r in radii:
                    n = int((d2[np.ix_(t == a, t == b)] <= r * r).sum())
                    n = (n - int((t == a).sum())) // 2 if a == b else n
                    if a <= b and n:
                        want[key, a, b, r] = n
    assert got == want


@pytest.mark.parametrize("tile", [50, 20_000])
def test_nearest_sums(cells, monkeypatch, tile):
    """Several rounds of radii, and one."""
    monkeypatch.setattr(tiles, "TILE_CELLS", tile)
    got = {(r.region_id, r.a_type, r.b_type): (r.total, r.least, r.n) for r in tiles.nearest_sums(cells, cells, 500.0).collect()}
    want = {}
    for key, t, d2 in by_region(cells):
        for a in set(t):
            for b in set(t) - {a}:
                d = np.sqrt(d2[np.ix_(t == a, t == b)].min(axis=1))
                if (d <= 500).any():
                    want[key, a, b] = (d[d <= 500].sum(), d.min(), int((d <= 500).sum()))
    flat = lambda found: {(*k, i): v for k, values in found.items() for i, v in enumerate(values)}
    assert flat(got) == pytest.approx(flat(want))


def test_nothing(cells):
    none = cells.filter(F.lit(False))
    assert tiles.nearest_sums(none, none, 5.0).count() == 0 and tiles.pair_counts(none.withColumnRenamed("cell_type", "group"), (5.0,)).count() == 0


def test_nearest_makes_no_row_a_cell_and_type(spark, monkeypatch):
    """3,000 cells of three types have 9,000 distances; a row a tile and pair of types is written, besides the cells themselves."""
    written, write = {}, tiles.materialize
    monkeypatch.setattr(tiles, "materialize", lambda df, name: written.setdefault(name, write(df, name)))
    at = np.random.default_rng(1).uniform(0, 300, (3000, 2))
    cells = spark.createDataFrame([(0, i, "abc"[i % 3], float(x), float(y)) for i, (x, y) in enumerate(at)], "region_id int, cell_id int, cell_type string, x double, y double")
    assert spatial.nearest_distances(cells, sample_n=None).count() == 9
    assert written["nearest-sums"].count() <= 100


def lattice(rng, columns, rows, groups, share):
    x, y, g = (v.ravel() for v in np.meshgrid(columns, rows, np.arange(groups), indexing="ij"))
    keep = rng.random(len(x)) < share
    return x[keep], y[keep], g[keep], rng.integers(1, 5, keep.sum())


@pytest.mark.parametrize("scale,start", [(1.0, 0.0), (0.1, 1e7), (1 / 3, -3e5)])
def test_a_lattice_counts_as_strips_and_as_all_pairs(scale, start):
    rng = np.random.default_rng(8)
    columns, rows = (start + np.sort(rng.choice(45, 40, replace=False)) * scale for _ in range(2))  # some are missing
    x, y, g, n = lattice(rng, columns, rows, 3, 0.3)
    own = (x > columns[9]) & (x < columns[31]) & (y > rows[12]) & (y < rows[28])
    mine = [v[own] for v in (x, y, g, n)]
    dx, dy = mine[0][:, None] - x, mine[1][:, None] - y
    near = tiles.Lattice(x, y, g, n, 3)
    for r in (scale, 5 * scale, 10 * scale, 0.3, 7.3, 1000.0):  # 3, 4, 5: many pairs are at the radius
        want = [[int((mine[3][:, None] * n * (dx * dx + dy * dy <= r * r))[np.ix_(mine[2] == a, g == b)].sum()) for b in range(3)] for a in range(3)]
        assert near.counts(*mine, r).tolist() == want == tiles.Strips(x, y, g, n, 3).counts(*mine, r).tolist()
    near.sums = near.sums.astype(np.int64)
    assert near.counts(*mine, 1000.0).tolist() == want


def test_points_in_rows_and_columns_make_a_lattice():
    rng = np.random.default_rng(9)
    x, y, _, _ = lattice(rng, np.arange(60.0), np.arange(60.0), 3, 0.2)
    scattered = rng.uniform(0, 60, (2, len(x)))
    assert tiles.Lattice.fits((x, y), (x, y), 3, 9.0) and not tiles.Lattice.fits(tuple(scattered), tuple(scattered), 3, 9.0)
    assert not tiles.Lattice.fits((x[::100], y[::100]), (x, y), 3, 9.0) and not tiles.Lattice.fits((x, y), (x, y), 2000, 9.0)
    y = np.sort(rng.uniform(0, 60, 60))[y.astype(int)]
    assert not tiles.Lattice.fits((x, y), (x, y), 3, 9.0)  # distances of rows are all different


@pytest.mark.parametrize("across", [False, True])
def test_pair_counts_of_crowded_pixels(spark, monkeypatch, across):
    monkeypatch.setattr(tiles, "TILE_CELLS", 300)
    rng = np.random.default_rng(10)
    points = [(r, "abc"[g], float(x), float(y)) for r, size in ((0, 40), (1, 25)) for x, y, g in zip(*rng.integers(0, size, (2, size * size)), rng.integers(0, 3, size * size), strict=True)]
    cells = spark.createDataFrame(points, "region_id int, group string, x double, y double").repartition(3)
    radii, want = (5.0, 2.0, 10.0), {}
    for key, t, d2 in by_region(cells.withColumnRenamed("group", "cell_type")):
        for r in radii:
            for a in "abc":
                for b in "abc" if across else a:
                    n = int((d2[np.ix_(t == a, t == b)] <= r * r).sum())
                    if a <= b:
                        want[key, a, b, r] = (n - int((t == a).sum())) // 2 if a == b else n
    got = {(r.region_id, r.a_group, r.b_group, r.radius): r.pairs for r in tiles.pair_counts(cells, radii, across=across).collect()}
    assert got == want
