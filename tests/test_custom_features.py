"""A user's featuriser in three steps."""

import pandas as pd
from pyspark.sql import functions as F

from cellgrove.operators import features as fe

BATCH = 10_000


def spread_of(cells):
    assert len(cells) <= BATCH  # never a whole group
    return pd.DataFrame({"n": [len(cells)], "lo": [cells.x.min()], "hi": [cells.x.max()]})


def wider(states):
    return pd.DataFrame({"n": [states.n.sum()], "lo": [states.lo.min()], "hi": [states.hi.max()]})


def spread(s):
    return pd.DataFrame({"feature": ["n", "spread"], "value": [float(s.n[0]), s.hi[0] - s.lo[0]]})


def run(cells, keys):
    return fe.custom_merged(cells, partial=spread_of, merge=wider, finish=spread, keys=keys, state="n long, lo double, hi double", schema="feature string, value double")


def test_a_region_of_ten_million_cells(spark):
    """One region holds nearly all rows; each call sees a batch and few states, and cells aren't shuffled."""
    cells = spark.range(10_000_050).select(F.when(F.col("id") < 10_000_000, "big").otherwise("small").alias("region_id"), F.col("id").cast("double").alias("x"))
    out = run(cells, ["region_id"])
    assert {(r.region_id, r.feature): r.value for r in out.collect()} == {("big", "n"): 1e7, ("big", "spread"): 9_999_999.0, ("small", "n"): 50.0, ("small", "spread"): 49.0}


def test_keys_of_any_type_and_null(spark, monkeypatch):
    """Two keys, one a long beyond a double's digits or null; many groups, more than a task holds; no rows give none."""
    monkeypatch.setattr(fe, "HELD_GROUPS", 3)
    big = 2**60 + 1
    rows = [(big + i % 5 if i % 7 else None, f"r{i % 3}", float(i)) for i in range(2000)]
    cells = spark.createDataFrame(rows, "k long, region_id string, x double").repartition(5)
    got = {(r.k, r.region_id, r.feature): r.value for r in run(cells, ["k", "region_id"]).collect()}
    want = {}
    for k, r in {(k, r) for k, r, _ in rows}:
        xs = [x for a, b, x in rows if (a, b) == (k, r)]
        want |= {(k, r, "n"): float(len(xs)), (k, r, "spread"): max(xs) - min(xs)}
    assert got == want
    assert run(cells.filter("false"), ["k"]).count() == 0
