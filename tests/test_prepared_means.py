"""Means enter the preparation as they are: those that differ by less than their printed digits still vary."""

import numpy as np
import pytest

from cellgrove.queries import QUERIES


def test_means_are_not_rounded_before_preparation(spark, tmp_path):
    rows = [(s, 1.0 + i % 2, 100.0 + s, 0.05, 0.01 + s * 1e-6) for s in range(1, 13) for i in range(4)]
    spark.createDataFrame(rows, "l_suppkey long, l_quantity double, l_extendedprice double, l_discount double, l_tax double").write.parquet(str(tmp_path / "lineitem.parquet"))
    got = {(r.region_id, r.feature): r.value for r in QUERIES["t3_prepared"](spark, str(tmp_path)).collect()}
    s = np.arange(1, 13)
    value = np.where(s % 7 != 3, 0.01 + s * 1e-6, np.nan)
    train = s % 5 != 0
    value = np.where(np.isnan(value), np.nanmedian(value[train]), value)
    want = (value - value[train].mean()) / value[train].std()
    assert [got[k, "l_tax"] for k in s.tolist()] == pytest.approx(want, abs=1e-3)
    assert {f for _, f in got} == {"l_extendedprice", "l_tax"}
