"""Values prepared with the rows of their runs, against the long tables, and steps on blocks that no task orders or holds whole."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from cellgrove.operators import blocks, linear, pipelines, prep
from tests.test_linear import cox_gradient, survival


@pytest.mark.parametrize(("fill", "shared"), [(0.0, False), (None, False), (None, True)])
def test_vectors_equal_the_long_tables_prepared(spark, fill, shared):
    rng = np.random.default_rng(0)
    rows = [(r, f, None if rng.random() < 0.2 else 7.0 if f == "d" else float(rng.integers(0, 9))) for r in range(60) for f in "abcde" if rng.random() < 0.7 and (f != "e" or r % 3 == 0)]
    f = spark.createDataFrame(rows, "region_id long, feature string, value double")
    runs = spark.range(63).crossJoin(spark.range(3).select(F.col("id").alias("run"))).select("run", F.col("id").alias("region_id"), F.when(F.col("id") % 3 == F.col("run"), "val").otherwise("train").alias("role"))
    vocab = spark.createDataFrame([("a",), ("e",), ("z",)], "feature string") if shared else None
    t = pipelines.run_features(f, runs, keys=["run"], fill=fill, vocab=vocab)
    train = t.filter("role = 'train'").join(medians := t.filter("role = 'train'").groupBy("run", "feature").agg(F.percentile("value", F.lit(0.5)).alias("median")), ["run", "feature"])
    filled = train.withColumn("value", F.coalesce("value", "median")).groupBy("run", "feature", "median").agg(F.stddev_samp("value").alias("_sd"), F.avg("value").alias("mean"), F.stddev_pop("value").alias("scale")).filter("_sd > 1e-12")
    want = {(r.run, r.region_id, r.role): r.x for r in prep.assemble(prep.apply_prep(t, filled, keys=["run"]), keys=["run"]).collect()}
    got = {(r.run, r.region_id, r.role): r.x for r in pipelines.run_vectors(f, runs, keys=["run"], fill=fill, vocab=vocab).collect()}
    assert got.keys() == want.keys() and len(got) == 189 and medians.count() > 0
    assert all(got[k] == pytest.approx(want[k], abs=1e-9) for k in want)


def test_cox_models_over_many_blocks(spark, monkeypatch):
    monkeypatch.setattr(blocks, "NUMBERS", 60)
    runs = {0: survival(250, 3, 1, None), 1: survival(300, 5, 2, 12), 3: survival(90, 2, 3, 2)}
    rows = [(run, v.tolist(), float(t), int(e)) for run, (x, time, event) in runs.items() for v, t, e in zip(x, time, event, strict=True)]
    df = spark.createDataFrame(rows, "run int, x array<double>, time double, event int").repartition(3)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 20)
    packed = blocks.packed_in_order(df, keys=["run"], columns=["time", "event"], by="time")
    assert packed.groupBy("run").count().filter("run < 2").agg(F.min("count")).first()[0] > 5
    assert packed.select("run", F.explode(F.array_distinct("time")).alias("t")).groupBy("run", "t").count().agg(F.max("count")).first()[0] == 1
    found = {r.run: np.array(r.beta) for r in linear.fit_cox(df, keys=["run"]).collect()}
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    for run, (x, time, event) in runs.items():
        assert np.abs(cox_gradient(found[run], x, time, event) / len(x) - 0.1 * found[run]).max() < 1e-6
