"""Sharding by a two-pass external shuffle."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cellgrove.llm.text import shields_names, whole
from cellgrove.scratch import at_most, materialize, new_path

SHARDS, SEED = 16, 20240
#: Text bytes that one bucket of the first pass is meant to hold, and the fewest buckets.
BUCKET_BYTES, MIN_BUCKETS = 16 << 20, 64
#: Overfull buckets: a table of up to so many (under 10 MB) is broadcast, a longer one is joined by shuffle.
BROADCAST_BUCKETS = 100_000


def _starts(counts: DataFrame, n: str, width: int = 4096) -> DataFrame:
    """(_b, _start): the sum of ``n`` over all lower buckets of ``counts``, by two levels, so that no task sums up all buckets."""
    level = counts.withColumn("_level", F.floor(F.col("bucket") / width))
    upper = level.groupBy("_level").agg(F.sum(n).alias("_all"))  # a row for `width` buckets
    upper = upper.select("_level", (F.sum("_all").over(Window.orderBy("_level")) - F.col("_all")).alias("_before"))
    inside = F.sum(n).over(Window.partitionBy("_level").orderBy("bucket")) - F.col(n)
    return level.withColumn("_inside", inside).join(upper, "_level").select(F.col("bucket").alias("_b"), (F.col("_before") + F.col("_inside")).alias("_start"))


@shields_names
def with_shards(docs: DataFrame, *, n_shards: int = SHARDS, seed: int = SEED, bucket_bytes: int = BUCKET_BYTES, carry: list[str] | None = None) -> DataFrame:
    """A uniform random order of all rows, cut into ``n_shards`` equal parts: counts differ by one at most.

    Pass one scatters rows into memory-sized buckets by a seeded hash; pass two Fisher-Yates shuffles each
    bucket. A row's rank is its bucket's start plus its place within; shard = rank * n_shards div rows, so a bucket falls
    into one shard, or two at their border. Adds ``size`` (UTF-8 bytes plus 1), ``text_crc32``, ``law``, ``shard``, ``slot`` and
    ``bucket``; other columns pass through (all, or those in ``carry``, doc_id among them), clashing ones are replaced.

    Null text counts as empty; null doc_ids are a value like any other; an empty table gives no rows. Rows equal in doc_id and text have
    interchangeable places. A doc_id and text that alone overfill a bucket (very many repeats) are
    spread over as many further buckets as they fill; one text that is larger than a bucket has a larger bucket.
    """
    docs = docs.drop("size", "text_crc32", "law", "shard", "slot", "bucket")
    rows = docs.withColumns({"size": F.octet_length(whole()).cast("long") + 1, "text_crc32": F.crc32(whole().cast("binary"))})
    rows = rows if carry is None else rows.select(*carry, "size", "text_crc32")
    total, n_rows = rows.agg(F.sum("size"), F.count("*")).first()
    total, n_rows = total or 0, max(1, n_rows)
    n_buckets = max(MIN_BUCKETS, math.ceil(total / bucket_bytes))
    rows = rows.withColumn("_home", F.pmod(F.xxhash64(F.lit(seed), "doc_id", "text_crc32"), F.lit(n_buckets)).cast("long"))
    # A bucket holds about n/n_buckets rows; one that repeats of a row overfill is split, the others stay whole.
    homes = rows.groupBy("_home").agg(F.sum("size").alias("_bytes"))
    parts = homes.withColumn("_parts", F.floor(F.col("_bytes") / (4 * max(bucket_bytes, total // n_buckets)))).filter("_parts > 1").select("_home", "_parts")
    parts = materialize(parts, "overfull-buckets")  # fewer than n_buckets / 4 rows, since each has over four buckets' bytes
    if parts.isEmpty():
        rows = rows.withColumnRenamed("_home", "bucket")
    else:  # the spread depends on the order of rows, so it is decided once
        split = F.pmod(F.monotonically_increasing_id(), F.coalesce("_parts", F.lit(1)))
        parts = F.broadcast(parts) if at_most(parts, BROADCAST_BUCKETS) else parts
        rows = materialize(rows.join(parts, "_home", "left").withColumn("bucket", F.col("_home") + n_buckets * split).drop("_home", "_parts"), "shard-buckets")

    # Starts are joined before the rows are grouped, so that texts are moved once.
    starts = _starts(rows.groupBy("bucket").agg(F.count("*").alias("_n")), "_n").withColumnRenamed("_b", "bucket")
    rows = rows.join(starts, "bucket")
    schema = T.StructType([*rows.schema.fields, T.StructField("_place", T.LongType())])

    def shuffled(pdf: pd.DataFrame) -> pd.DataFrame:
        bucket = int(pdf["bucket"].iat[0])
        ids = pd.to_numeric(pdf["doc_id"], errors="coerce").fillna(-1).to_numpy()
        pdf = pdf.iloc[np.lexsort((pdf["size"].to_numpy(), pdf["text_crc32"].to_numpy(), ids))]  # arrival order must not matter
        order = np.random.default_rng([seed, bucket]).permutation(len(pdf))  # Fisher-Yates
        return pdf.iloc[order].assign(_place=np.arange(len(pdf), dtype=np.int64))

    placed = rows.groupBy("bucket").applyInPandas(shuffled, schema)
    rank = F.col("_start") + F.col("_place")
    placed = placed.withColumns({"law": F.lit("rows"), "_rank": rank, "shard": F.floor(rank * n_shards / n_rows).cast("int")})
    return placed.withColumn("slot", (F.col("_rank") - F.ceil(F.col("shard") * F.lit(n_rows) / n_shards)).cast("long")).drop("_start", "_place", "_rank").select(*[c for c in rows.columns if c not in ("bucket", "_start")], "law", "shard", "slot", "bucket")


def write_shards(docs: DataFrame, path: str, **options) -> DataFrame:
    """Write the shards, a folder each, whole rows in the order of their slots within a file; returns what is read back."""
    out = with_shards(docs, **options)
    out.sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)
    return docs.sparkSession.read.schema(out.schema).parquet(path)


def op3_shuffle_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    out = write_shards(docs, new_path(spark, "shards"))
    size, crc = F.octet_length(whole()).cast("long") + 1, F.crc32(whole().cast("binary"))
    return out.select("doc_id", size.alias("size"), crc.alias("text_crc32"), "law", "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
