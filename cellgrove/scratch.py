"""Intermediate tables in the folder that driver and executors share.

Cutting lineage through a written table (instead of a cache or a local
checkpoint) keeps a long job alive when executors are lost: the rows are in
shared storage and nothing before them has to be computed again.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_DIR = "spark.checkpoint.dir"


def shared_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``.

    Where it is unset a temporary folder is made, but only in local mode (tests):
    on a cluster a machine-local folder would be invisible to other executors.
    """
    found = spark.sparkContext.getConf().get(CHECKPOINT_DIR) or spark.conf.get(CHECKPOINT_DIR, None)
    if found:
        return found.rstrip("/")
    master = spark.sparkContext.master
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise ValueError(f"set {CHECKPOINT_DIR} to a folder that all executors share")
    own = tempfile.mkdtemp(prefix="cellgrove-")
    spark.conf.set(CHECKPOINT_DIR, own)
    return own


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/cellgrove/{uuid.uuid4().hex[:12]}-{name}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def at_most(df: DataFrame, rows: int) -> bool:
    """Whether ``df`` has at most ``rows`` rows, reading no more than needed."""
    return df.limit(rows + 1).count() <= rows
