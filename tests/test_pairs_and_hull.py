"""Pairs counted once, and hulls, against brute force."""

import numpy as np
import pytest

from cellgrove.operators import spatial


@pytest.fixture(scope="module")
def cells(spark):
    """Two regions with ties, negative places, cells at the same place and without a type; the second has few cells."""
    rng = np.random.default_rng(9)
    at = [(0, i, "ab"[i % 2] if i % 7 else None, float(x), float(y)) for i, (x, y) in enumerate(rng.integers(-40, 40, (150, 2)))]
    at += [(1, i, "a", float(i), -float(i)) for i in range(3)]
    return spark.createDataFrame(at, "region_id int, cell_id int, cell_type string, x double, y double")


def distances(c):
    return np.hypot(c.x.to_numpy()[:, None] - c.x.to_numpy(), c.y.to_numpy()[:, None] - c.y.to_numpy())


def test_pairs_come_once(spark, cells):
    for radius in (1.0, 10.0, 35.5):
        got = [(r.region_id, *sorted((r.a_id, r.b_id))) for r in spatial.half_pairs(cells, radius).collect()]
        want = {(k, *sorted((int(c.cell_id.iat[i]), int(c.cell_id.iat[j])))) for k, c in cells.toPandas().groupby("region_id") for i, j in zip(*np.nonzero(distances(c) <= radius)) if i < j}
        assert len(got) == len(set(got)) and set(got) == want


def test_ripley_of_all_and_by_type(spark, cells):
    area = spatial.box_area(cells)
    one = {(r.region_id, r.cell_type, r.radius): r.k for r in spatial.ripley_and_by_type(cells, area, radii=(5.0, 20.0), sample_n=40).collect()}
    two = spatial.ripley(cells, area, radii=(5.0, 20.0)).union(spatial.ripley(cells, area, radii=(5.0, 20.0), by_type=True, min_cells=4, sample_n=40))
    assert one == pytest.approx({(r.region_id, r.cell_type, r.radius): r.k for r in two.collect()}) and one[1, "a", 5.0] is None and one[1, "all", 5.0] > 0
    c = cells.filter("region_id = 0").toPandas()
    box = (c.x.max() - c.x.min()) * (c.y.max() - c.y.min())
    assert one[0, "all", 20.0] == pytest.approx(box * ((distances(c) <= 20).sum() - len(c)) / (len(c) * (len(c) - 1)))


def test_hull_area_by_all_pairs(spark):
    """The hull's edges are the pairs with all other points on one side; the area is half the sum of their cross products."""
    rng = np.random.default_rng(10)
    clouds = [rng.normal(size=(60, 2)), rng.uniform(-5, 90, (200, 2)), np.array([[0, 0], [4, 0], [4, 3], [0, 3.0]]), np.repeat(rng.uniform(0, 9, (5, 2)), 4, axis=0)]
    flat = [[float(i), 2.0 * i] for i in range(6)]
    rows = [(k, float(x), float(y)) for k, cloud in enumerate([*clouds, flat]) for x, y in cloud]
    got = {r.region_id: r.area for r in spatial.hull_area(spark.createDataFrame(rows, "region_id int, x double, y double")).collect()}
    for k, cloud in enumerate(clouds):
        p = np.unique(cloud, axis=0)
        twice = 0.0
        for i in range(len(p)):
            for j in range(len(p)):
                turn = (p[j, 0] - p[i, 0]) * (p[:, 1] - p[i, 1]) - (p[j, 1] - p[i, 1]) * (p[:, 0] - p[i, 0])
                if i != j and (turn >= -1e-12).all():
                    twice += p[i, 0] * p[j, 1] - p[j, 0] * p[i, 1]
        assert got[k] == pytest.approx(twice / 2)
    assert got[4] == 50.0  # a flat hull: the box
