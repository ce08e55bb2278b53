"""The whole jobs of n2, d2, d4, d6 to d9 against brute force on the smallest tables."""

import numpy as np
import pytest

from cellgrove import fixtures as fx
from cellgrove.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"


def test_all_markers(spark):
    e = fx.line_expression(spark, SF).toPandas()
    cofactor = 5 * e.groupby(["region_id", "marker"])["value"].transform(lambda v: np.quantile(v, 0.2)) + 1e-5
    want = np.arcsinh(e["value"] / cofactor).groupby([e["region_id"], e["marker"]]).mean()
    got = {(r.region_id, r.marker): r.mean_value for r in QUERIES["n2_adaptive_arcsinh_all_markers"](spark, SF).collect()}
    assert set(got) == set(want.index) and len({m for _, m in got}) == 4
    assert all(got[k] == pytest.approx(v, abs=1e-3) for k, v in want.items())


def test_full_radii(spark):
    cells = fx.event_cells(spark, SF, 10).toPandas()
    d2 = {(r.region_id, r.a_type, r.b_type): (r.min_dist, r.mean_dist) for r in QUERIES["d2_nearest_full_radius"](spark, SF).collect()}
    d4 = {(r.region_id, r.a_type, r.b_type, r.radius): r.value for r in QUERIES["d4_proximity_full_radii"](spark, SF).collect()}
    d6 = {(r.region_id, r.cell_type, r.radius): r.k for r in QUERIES["d6_d8_ripley_full_radii"](spark, SF).collect()}
    d7 = {(r.region_id, r.cell_type, r.mid): r.g for r in QUERIES["d7_d9_pair_correlation_full_radii"](spark, SF).collect()}
    radii, types, above = (20.0, 50.0, 100.0, 200.0), sorted(cells.cell_type.unique()), 0
    for region, c in cells.groupby("region_id"):
        x, y, t = c.x.to_numpy(), c.y.to_numpy(), c.cell_type.to_numpy()
        dist = np.hypot(x[:, None] - x, y[:, None] - y)
        area = max((x.max() - x.min()) * (y.max() - y.min()), 1.0)
        other = ~np.eye(len(x), dtype=bool)
        for a in set(t):
            for b in types:
                near = dist[np.ix_(t == a, t == b)]
                if near.size:
                    best = np.minimum(near.min(axis=1), 500)
                    above += best.max() > 40
                    assert d2[region, a, b] == pytest.approx((best.min(), best.mean()), abs=2e-6)
                if (t == a).sum() >= 3:
                    assert d4[region, a, b, 100.0] == pytest.approx((near <= 100).sum() / (t == a).sum() - (a == b), abs=2e-6)
        for name in ["all", *set(t)]:
            on = np.ones(len(t), dtype=bool) if name == "all" else t == name
            n, before = on.sum(), (0.0, 0.0)
            for r in radii if n >= (2 if name == "all" else 4) else ():
                k = area * ((dist <= r) & other)[np.ix_(on, on)].sum() / (n * (n - 1))
                assert d6[region, name, r] == pytest.approx(k, abs=1e-3)
                mid = (r + before[0]) / 2
                assert d7[region, name, mid] == pytest.approx((k - before[1]) / (2 * np.pi * mid * (r - before[0])), abs=1e-5)
                before = (r, k)
    assert above and {k[1] for k in d6} == {"all", *types}


def test_proximity_counts_within_all_radii(spark):
    cells = fx.event_cells(spark, SF, 10).toPandas()
    got = {(r.region_id, r.a_type, r.b_type, r.radius): r.value for r in QUERIES["d4_proximity"](spark, SF).collect()}
    types, want = sorted(cells.cell_type.unique()), {}
    for region, c in cells.groupby("region_id"):
        x, y, t = c.x.to_numpy(), c.y.to_numpy(), c.cell_type.to_numpy()
        dist = np.hypot(x[:, None] - x, y[:, None] - y)
        for a in set(t):
            on = t == a
            for b in types:
                for r in (20.0, 50.0, 100.0):
                    want[region, a, b, r] = (dist[np.ix_(on, t == b)] <= r).sum() / on.sum() - (a == b) if on.sum() >= 3 else None
    assert got.keys() == want.keys()
    for k, v in want.items():
        assert got[k] == (v if v is None else pytest.approx(v, abs=2e-6))
    assert any(want[k] for k in want if k[3] == 100.0)
    duckdb = pytest.importorskip("duckdb").connect()
    duckdb.execute(f"CREATE VIEW events AS SELECT * FROM '{SF}/events.parquet'")
    assert {tuple(r[:4]): r[4] for r in duckdb.execute(ORACLES["d4_proximity"]).fetchall()} == {k: v if v is None else pytest.approx(v, abs=2e-6) for k, v in got.items()}
