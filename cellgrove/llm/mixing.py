"""Mixing sources to target weights."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cellgrove.llm.text import shields_names, whole, words
from cellgrove.scratch import at_most, materialize

CYCLE, MAX_EPOCHS, SEED = (5, 2, 1), 3, "mix-1"
#: Times that the order goes on past a document that doesn't fit.
PASSES = 3
#: Buckets a natural-log unit of the sampling key: the one bucket a source that holds its cut has about 1/2800 of its documents.
BUCKETS_A_UNIT = 1024
#: A table of sources of up to so many rows (under 20 MB) is broadcast; a longer one is joined by shuffle.
BROADCAST_ROWS = 200_000
SYMBOLS = "#*$%&|<>"


def quality_weight() -> Column:
    """1 for plain prose, less with the share of mark-up symbols in the text, 0.1 at least."""
    n = F.length(whole())
    symbols = n - F.length(F.translate(whole(), SYMBOLS, ""))
    return F.greatest(F.lit(0.1), F.lit(1.0) - 10 * symbols / F.greatest(n, F.lit(1)))


def sampling_key(seed: str, weight: Column) -> Column:
    """Efraimidis-Spirakis: -ln(u) / weight, u from the seeded md5 of doc_id; the smallest keys are drawn first."""
    drawn = F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(seed), F.col("doc_id").cast("string")).cast("binary")), 1, 13), 16, 10).cast("double")
    return -F.log((drawn + 0.5) / 2.0**52) / weight


def source_targets(sizes: DataFrame, cycle: tuple[int, ...], cap: float) -> DataFrame:
    """Targets of sources (``source``, ``source_size``): shares by weight of all words, none above ``cap`` times its size.

    Resharing the excess by weight until none is above ends at min(cap * size, level * weight); sources in
    order of cap * size / weight fill up first, and the level is that of the first that doesn't.
    """
    order = Window.orderBy(F.col("source").isNull(), F.col("source"))  # one row a source, not a document
    weights = F.array(*[F.lit(float(w)) for w in cycle])
    ranked = sizes.withColumn("_w", F.get(weights, (F.row_number().over(order) - 1) % len(cycle)))
    ranked = ranked.withColumn("_cap", cap * F.col("source_size"))
    by_fill = Window.orderBy(F.col("_cap") / F.col("_w"), F.col("source").isNull(), F.col("source"))
    every = Window.partitionBy(F.lit(1))
    filled = F.coalesce(F.sum("_cap").over(by_fill.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    open_weight = F.sum("_w").over(by_fill.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    level = (F.sum("source_size").over(every) - filled) / open_weight
    levels = ranked.withColumn("_level", level)
    fits = F.when(F.col("_level") <= F.col("_cap") / F.col("_w"), F.col("_level"))
    first = F.first(fits, ignorenulls=True).over(by_fill.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    return levels.withColumn("_top", first).select(
        "source", "source_size", F.least(F.col("_cap"), F.coalesce(F.col("_top") * F.col("_w"), F.col("_cap"))).alias("target"))


def _fill(rows: DataFrame, gaps: DataFrame, small, nearest: bool) -> DataFrame:
    """How far a source's ``rows`` (source, doc_id, size, _key, _bucket), in key order, fill its gap (_s, _gap).

    Gives (_s, _b, _last, _filled): rows in buckets before _b, and in _b up to _last, are taken. Sums by bucket find the one
    bucket with the cut, so only that is put in order. The row at the cut is left, or, with ``nearest``,
    taken if that ends nearer to the gap.
    """
    sums = rows.groupBy("source", "_bucket").agg(F.sum("size").alias("_sum"))
    upto = F.sum("_sum").over(Window.partitionBy("source").orderBy("_bucket"))
    over = sums.withColumn("_end", upto).join(small(gaps), F.col("source").eqNullSafe(F.col("_s"))).filter((F.col("_end") > F.col("_gap")) & (F.col("_gap") > 0))
    bucket = over.groupBy("_s").agg(F.min_by(F.struct(F.col("_bucket").alias("_b"), (F.col("_end") - F.col("_sum")).alias("_start"), "_gap"), "_bucket").alias("c")).select("_s", "c.*")
    bucket = materialize(bucket, "mix-cut")
    here = rows.join(small(bucket), F.col("source").eqNullSafe(F.col("_s")) & (F.col("_bucket") == F.col("_b")))
    to_here = F.col("_start") + F.sum("size").over(Window.partitionBy("source").orderBy("_key", "doc_id").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    fits = 2 * F.col("_to") - F.col("size") <= 2 * F.col("_gap") if nearest else F.col("_to") <= F.col("_gap")
    last = here.withColumn("_to", to_here).filter(fits).groupBy(F.col("_s").alias("_t")).agg(F.max(F.struct("_key", "doc_id")).alias("_last"), F.max("_to").alias("_to"))
    return bucket.join(last, F.col("_s").eqNullSafe(F.col("_t")), "left").select("_s", "_b", "_last", F.coalesce("_to", "_start").alias("_filled"))


def _taken(i: int) -> Column:
    """Whether a row is within the cut of pass ``i``; without a cut all rows fit into the gap."""
    within = F.coalesce(F.struct("_key", "doc_id") <= F.col(f"_last{i}"), F.lit(False))
    cut = F.col(f"_b{i}")
    return F.coalesce(F.when(cut.isNull(), F.col(f"_gap{i}") > 0).otherwise((F.col("_bucket") < cut) | ((F.col("_bucket") == cut) & within)), F.lit(False))


@shields_names
def mix_sources(docs: DataFrame, *, cycle: tuple[int, ...] = CYCLE, cap: int = MAX_EPOCHS, seed: str = SEED, weight: Column | None = None, carry: list[str] | None = None) -> DataFrame:
    """Say how often the mix takes each document.

    Sources, in code point order with null last, have the weights of ``cycle`` in turn and share all words.
    A source first gives whole epochs of its documents; the rest of its target is filled by documents in
    order of their exponential keys scaled by quality weight. A document that doesn't fit any more is passed over and
    the order goes on with those that do, PASSES times; the last may end beyond the target if that is nearer.
    Adds ``size``, ``source_size``, ``target``, ``copies`` and ``taken`` (= copies * size) to all columns, or to those in ``carry``.

    Texts are read once for sizes and keys, which are written without the texts, and sums by source and key bucket find
    the cuts; no source is put in order as a whole. Null text has size 0. An empty table gives no rows. Documents
    with equal keys are ordered by doc_id, null first; rows with one doc_id and one key are taken
    together. Clashing columns are replaced.
    """
    added = ["size", "source_size", "target", "copies", "taken"]
    docs = docs.drop(*added)
    weight = quality_weight() if weight is None else weight
    sized = docs.withColumns({"size": F.size(words(whole())).cast("long"), "_key": sampling_key(seed, weight)})
    sized = sized.withColumn("_bucket", F.floor(F.log("_key") * BUCKETS_A_UNIT))
    kept = ["source", "doc_id", *[c for c in carry or [] if c not in ("source", "doc_id")]]
    keyed = materialize(sized.select(*kept, "size", "_key", "_bucket"), "mix-keys")
    targets = source_targets(keyed.groupBy("source").agg(F.sum("size").alias("source_size")), cycle, float(cap))
    targets = targets.withColumn("_epochs", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0))
    plan = materialize(targets.withColumn("_gap0", F.col("target") - F.col("_epochs") * F.col("source_size")).withColumnRenamed("source", "_source"), "mix-targets")
    small = (lambda df: F.broadcast(df)) if at_most(plan, BROADCAST_ROWS) else (lambda df: df)
    same = F.col("source").eqNullSafe(F.col("_source"))

    for i in range(PASSES):
        rest = keyed.select("source", "doc_id", "size", "_key", "_bucket").join(small(plan), same)
        for before in range(i):
            rest = rest.filter(F.col(f"_b{before}").isNotNull() & ~_taken(before))
        rest = rest.filter(F.col("size") <= F.col(f"_gap{i}")) if i else rest
        cut = _fill(rest.select("source", "doc_id", "size", "_key", "_bucket"), plan.select(F.col("_source").alias("_s"), F.col(f"_gap{i}").alias("_gap")), small, i == PASSES - 1)
        plan = plan.join(cut, F.col("_source").eqNullSafe(F.col("_s")), "left").withColumn(f"_gap{i + 1}", F.col(f"_gap{i}") - F.col("_filled"))
        plan = materialize(plan.withColumnsRenamed({"_b": f"_b{i}", "_last": f"_last{i}"}).drop("_s", "_filled"), "mix-plan")

    drawn, passed = F.lit(False), F.lit(True)
    for i in range(PASSES):
        fits = (F.col("size") <= F.col(f"_gap{i}")) if i else F.lit(True)
        drawn = drawn | (passed & F.coalesce(fits, F.lit(False)) & _taken(i))
        passed = passed & ~_taken(i) & F.col(f"_b{i}").isNotNull()
    out = sized if carry is None else keyed
    names = docs.columns if carry is None else carry
    out = out.join(small(plan), same).withColumn("copies", (F.col("_epochs") + drawn.cast("long")).cast("int"))
    return out.withColumn("taken", F.col("copies") * F.col("size")).select(*names, *added)


@shields_names
def mixed_rows(docs: DataFrame, **options) -> DataFrame:
    """The mixture itself: each document as often as the mix takes it, in the columns of ``docs``."""
    out = mix_sources(docs, **options)
    return out.withColumn("_copy", F.explode(F.array_repeat(F.lit(1), F.col("copies")))).select(*docs.columns)


def op1_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source")
    return mix_sources(docs, carry=["doc_id"]).select("doc_id", "size", "source_size", F.round("target", 4).alias("target"), "taken")


OP1_SQL = r"""
WITH sized AS (
  SELECT doc_id, source,
    CASE WHEN text IS NULL THEN 0 ELSE len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) END::BIGINT AS size,
    -ln((('0x' || substr(md5('mix-1:' || doc_id::VARCHAR), 1, 13))::BIGINT::DOUBLE + 0.5) / 4503599627370496.0)
      / greatest(0.1, 1.0 - 10 * (length(coalesce(text, '')) - length(translate(coalesce(text, ''), '#*$%&|<>', '')))::DOUBLE
                               / greatest(length(coalesce(text, '')), 1)) AS key
  FROM documents),
sources AS (
  SELECT source, sum(size)::DOUBLE AS source_size,
    CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5.0 WHEN 1 THEN 2.0 ELSE 1.0 END AS w
  FROM sized GROUP BY source),
levels AS (
  SELECT *, (sum(source_size) OVER () - coalesce(sum(3 * source_size) OVER (ORDER BY 3 * source_size / w, source NULLS LAST
      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
    / sum(w) OVER (ORDER BY 3 * source_size / w, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM sources),
targets AS (
  SELECT source, source_size, least(3 * source_size, coalesce(first_value(CASE WHEN level <= 3 * source_size / w THEN level END IGNORE NULLS)
      OVER (ORDER BY 3 * source_size / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) * w, 3 * source_size)) AS target
  FROM levels),
parts AS (
  SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END AS epochs FROM targets),
one AS (
  SELECT s.doc_id, s.source, s.size, s.key, p.source_size, p.target, p.epochs, p.target - p.epochs * p.source_size AS gap,
    sum(s.size) OVER (PARTITION BY s.source ORDER BY s.key, s.doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto
  FROM sized s JOIN parts p ON s.source IS NOT DISTINCT FROM p.source),
gap_one AS (SELECT *, gap > 0 AND upto <= gap AS t1, gap - coalesce(max(upto) FILTER (upto <= gap) OVER (PARTITION BY source), 0) AS gap2 FROM one),
two AS (
  SELECT *, gap > 0 AND NOT t1 AND size <= gap2 AS e2,
    sum(CASE WHEN NOT t1 AND size <= gap2 THEN size ELSE 0 END) OVER (PARTITION BY source ORDER BY key, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto2
  FROM gap_one),
gap_two AS (SELECT *, e2 AND upto2 <= gap2 AS t2, gap2 - coalesce(max(upto2) FILTER (upto2 <= gap2) OVER (PARTITION BY source), 0) AS gap3 FROM two),
three AS (
  SELECT *, e2 AND NOT t2 AND size <= gap3 AS e3,
    sum(CASE WHEN e2 AND NOT t2 AND size <= gap3 THEN size ELSE 0 END) OVER (PARTITION BY source ORDER BY key, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto3
  FROM gap_two)
SELECT doc_id, size, source_size::BIGINT AS source_size, round(target, 4) AS target,
  (epochs * size + CASE WHEN t1 OR t2 OR (e3 AND 2 * upto3 - size <= 2 * gap3) THEN size ELSE 0 END)::BIGINT AS taken
FROM three
"""
