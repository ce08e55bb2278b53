"""Counts and distances from pyramids against all pairs."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from cellgrove.operators import pyramid, spatial


@pytest.fixture(scope="module")
def cells(spark):
    """A wide region with ties, a dense spot and many cells at one place; cells without place, type or number; a region of one cell."""
    rng = np.random.default_rng(21)
    places = [*rng.integers(-300, 300, (500, 2)), *rng.normal(40, 0.5, (300, 2)), *np.full((60, 2), 7.0), *rng.uniform(-2000, 2000, (40, 2))]
    rows = [(0, i, "abc"[i % 3] if i % 11 else None, float(x), float(y)) for i, (x, y) in enumerate(places)]
    rows += [(0, 5000, "a", None, 1.0), (0, 5001, "b", 1.0, float("nan")), (1, 0, "a", 3.0, 4.0), (2, 0, "a", 0.0, 0.0), (2, 1, "b", 3.0, 4.0), (2, 2, "b", 500.0, 0.0)]
    return spark.createDataFrame(rows, "region_id int, cell_id int, cell_type string, x double, y double").repartition(3)


def by_region(cells):
    for key, c in cells.filter("cell_type IS NOT NULL AND x IS NOT NULL AND NOT isnan(y)").toPandas().groupby("region_id"):
        dx, dy = c.x.to_numpy()[:, None] - c.x.to_numpy(), c.y.to_numpy()[:, None] - c.y.to_numpy()
        yield key, c, dx * dx + dy * dy


RADII = (5.0, 0.5, 50.0, 200.0)


@pytest.mark.parametrize("across", [False, True])
@pytest.mark.parametrize("limit", [0, 1024])
def test_pair_counts(cells, monkeypatch, across, limit):
    monkeypatch.setattr(pyramid, "SMALL", limit)
    monkeypatch.setattr(pyramid, "DEPTH", 16 if limit else 5)  # a pair of cells at one place is never small
    got = {(r.region_id, r.a_group, r.b_group, r.radius): r.pairs for r in pyramid.pair_counts(cells.withColumnRenamed("cell_type", "group"), RADII, across=across).collect()}
    want = {}
    for key, c, d2 in by_region(cells):
        t = c.cell_type.to_numpy()
        for a in "abc":
            for b in "abc" if across else a:
                for r in RADII:
                    n = int((d2[np.ix_(t == a, t == b)] <= r * r).sum())
                    n = (n - int((t == a).sum())) // 2 if a == b else n
                    if a <= b and n:
                        want[key, a, b, r] = n
    assert got == want


def test_few_rows_for_many_pairs(spark, monkeypatch):
    """20,000 cells have some 30 million pairs within the radius; fewer than half as many are compared (a join on grid cells compares some 89 million)."""
    rng = np.random.default_rng(3)
    at = rng.uniform(0, 1000, (20_000, 2))
    cells = spark.createDataFrame([(0, "a", float(x), float(y)) for x, y in at], "region_id int, group string, x double, y double")
    compared, seen = pyramid._compared, []
    monkeypatch.setattr(pyramid, "_compared", lambda *a, **k: seen.append(compared(*a, **k)) or seen[-1])
    [row] = pyramid.pair_counts(cells, (250.0,)).collect()
    d2 = ((at[:, None, 0] - at[None, :, 0]) ** 2 + (at[:, None, 1] - at[None, :, 1]) ** 2)
    assert row.pairs == ((d2 <= 250.0**2).sum() - len(at)) // 2
    assert seen[0].count() * 2 < row.pairs


@pytest.mark.parametrize("limit", [0, 1024])
def test_nearest(cells, monkeypatch, limit):
    monkeypatch.setattr(pyramid, "SMALL", limit)
    monkeypatch.setattr(pyramid, "DEPTH", 16 if limit else 5)  # a pair of cells at one place is never small
    typed = cells.filter("cell_type IS NOT NULL")
    got = {(r.region_id, r.cell_id, r.group): r.dist for r in pyramid.nearest(typed, typed.withColumnRenamed("cell_type", "group"), 500.0).collect()}
    want = {}
    for key, c, d2 in by_region(cells):
        for t in set(c.cell_type):
            for i, d in zip(c.cell_id, d2[:, c.cell_type.to_numpy() == t].min(axis=1)):
                if d <= 250_000:
                    want[key, i, t] = np.sqrt(d)
    assert got == pytest.approx(want) and len(got) == len(want)


def test_nothing(spark, cells):
    none = cells.filter(F.lit(False)).withColumnRenamed("cell_type", "group")
    assert pyramid.pair_counts(none, (5.0,)).count() == 0 and pyramid.nearest(none, none, 5.0).count() == 0


@pytest.mark.parametrize("crowd", [0, 10**9])
def test_operators_agree_with_all_pairs(cells, monkeypatch, crowd):
    """Distances of pairs of types and proximity, with either plan; Ripley's K of both plans is the same."""
    monkeypatch.setattr(spatial, "CROWD", crowd)
    assert spatial.crowded(cells, 100.0) == (crowd == 0)
    k = {(r.region_id, r.cell_type, r.radius): r.k for r in spatial.ripley_and_by_type(cells, spatial.box_area(cells.filter("NOT isnan(y)")), sample_n=100).collect()}
    monkeypatch.setattr(spatial, "CROWD", 10**9 - crowd)
    assert k == {(r.region_id, r.cell_type, r.radius): r.k for r in spatial.ripley_and_by_type(cells, spatial.box_area(cells.filter("NOT isnan(y)")), sample_n=100).collect()}
    monkeypatch.setattr(spatial, "CROWD", crowd)
    d = {(r.region_id, r.a_type, r.b_type): (r.min_dist, r.mean_dist) for r in spatial.nearest_distances(cells.filter("x IS NOT NULL AND NOT isnan(y)"), sample_n=None).collect()}
    p = {(r.region_id, r.a_type, r.b_type, r.radius): r.value for r in spatial.proximity(cells).collect()}
    for key, c, d2 in by_region(cells):
        t = c.cell_type.to_numpy()
        for a in set(t):
            for b in set(t):
                near = np.minimum(500.0, np.sqrt(d2[np.ix_(t == a, t == b)].min(axis=1)))
                assert d[key, a, b] == pytest.approx((near.min(), near.mean()))
                for r in (20.0, 50.0, 100.0):
                    n = (d2[np.ix_(t == a, t == b)] <= r * r).sum() - (a == b) * (t == a).sum()
                    own = (t == a).sum() + (key == 0 and a in "ab")  # cells without a place count as cells
                    assert p[key, a, b, r] == (pytest.approx(n / own) if own >= 3 else None)
