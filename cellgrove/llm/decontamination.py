"""Benchmark decontamination with a distributed positional inverted index."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cellgrove.llm.text import ascii_lower, row_key, shields_names, whole
from cellgrove.scratch import at_most, materialize

SPAN = 10
#: Words of the test set: up to so many (under 100 MB) its tables are broadcast, more are joined by shuffle.
BROADCAST_TERMS = 500_000
#: Row keys of texts with an alignment: up to so many (under 50 MB) are broadcast to the index, more are joined by shuffle.
BROADCAST_ROWS = 300_000
BREAKS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def terms(c: Column) -> Column:
    """Lower-cased words: runs of ASCII letters, digits and all non-ASCII characters."""
    return F.filter(F.split(ascii_lower(c), BREAKS), lambda w: w != "")


def item_words(items: DataFrame) -> DataFrame:
    """A row a word of (item_id, text): ``item`` (of its own for each id and text), item_id, ``len`` (words of the item), ipos, term, tid."""
    w = items.select(F.xxhash64("item_id", whole()).alias("item"), "item_id", terms(whole()).alias("w")).distinct()
    return w.select("item", "item_id", F.size("w").alias("len"), F.posexplode("w").alias("ipos", "term")).withColumn("tid", F.xxhash64("term"))


def postings(docs: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """The positional index over the texts for the terms of ``vocabulary`` (term, tid): row key, pos, tid."""
    every = docs.select(*row_key(), F.posexplode(terms(whole())).alias("pos", "term"))
    return every.join(vocabulary, "term").select("_k1", "_k2", "pos", "tid")


def rarest_anchors(words: DataFrame, counts: DataFrame, span: int) -> DataFrame:
    """The places (item, p1, tid1, p2, tid2) of the two rarest terms of each window of ``span`` words; p2 is null in a window of one word.

    A window with a term that no text has is left out.
    """
    starts = F.sequence(F.greatest(F.lit(0), F.col("ipos") - span + 1), F.least(F.col("ipos"), F.greatest(F.lit(0), F.col("len") - span)))
    inside = words.join(counts, "tid").select("item", F.explode(starts).alias("start"), F.least("len", F.lit(span)).alias("n"), "ipos", "tid", "df")
    window = Window.partitionBy("item", "start")
    ranked = inside.withColumns({"rank": F.row_number().over(window.orderBy("df", "tid", "ipos")), "found": F.count("*").over(window)}).filter("found = n")
    pair = lambda r: F.max(F.when(F.col("rank") == r, F.struct("ipos", "tid")))
    both = ranked.filter("rank <= 2").groupBy("item", "start").agg(pair(1).alias("a"), pair(2).alias("b"))
    return both.select("item", F.col("a.ipos").alias("p1"), F.col("a.tid").alias("tid1"), F.col("b.ipos").alias("p2"), F.col("b.tid").alias("tid2")).distinct()


def phrase_matches(docs: DataFrame, items: DataFrame, *, span: int = SPAN, slop: int = 0) -> DataFrame:
    """Where the texts hold ``span`` consecutive words of an item (all words of a shorter one): row key, item_id, start, end (words).

    The index is read first for the rarest term of each window: its postings less the term's offset give candidate
    alignments of item and text. They are intersected with the offset-adjusted postings of the second rarest term,
    and the alignments that are left with those of all words of the item; runs of ``span`` or more matched words are
    the phrases. ``slop`` > 0 gives proximity matches: each word within ``slop`` words of its place.
    """
    words = materialize(item_words(items), "test-words")
    vocabulary = materialize(words.select("term", "tid").distinct(), "test-terms")
    small = at_most(words, BROADCAST_TERMS)
    hint = (lambda df: F.broadcast(df)) if small else (lambda df: df)
    index = materialize(postings(docs, hint(vocabulary)), "postings")
    anchors = materialize(rarest_anchors(words, index.groupBy("tid").agg(F.count("*").alias("df")), span), "test-anchors")

    key = ["_k1", "_k2"]
    shifts = F.sequence(F.lit(-slop), F.lit(slop))
    aligned = index.join(hint(anchors), F.col("tid") == F.col("tid1")).select(*key, "item", (F.col("pos") - F.col("p1")).alias("delta"), "p2", "tid2")
    alone = aligned.filter("tid2 IS NULL").select(*key, "item", "delta")
    wanted = aligned.filter("tid2 IS NOT NULL").withColumn("pos", F.explode(F.transform(shifts, lambda d: F.col("delta") + F.col("p2") + d)))
    second = index.join(hint(anchors.select(F.col("tid2").alias("tid")).distinct()), "tid", "left_semi").select(*key, "pos", F.col("tid").alias("tid2"))
    paired = wanted.join(second, [*key, "pos", "tid2"], "left_semi").select(*key, "item", "delta")
    alignments = materialize(paired.union(alone).distinct(), "alignments")

    holders = materialize(alignments.select(*key).distinct(), "alignment-rows")
    holders = F.broadcast(holders) if at_most(holders, BROADCAST_ROWS) else holders
    wanted = alignments.join(hint(words.select("item", "len", "ipos", "tid")), "item").withColumn("pos", F.explode(F.transform(shifts, lambda d: F.col("delta") + F.col("ipos") + d)))
    held = wanted.join(index.join(holders, key, "left_semi"), [*key, "pos", "tid"], "left_semi")
    held = held.select(*key, "item", "delta", "len", "ipos").distinct() if slop else held.select(*key, "item", "delta", "len", "ipos")
    along = Window.partitionBy(*key, "item", "delta").orderBy("ipos")  # no longer than an item
    runs = held.withColumn("run", F.col("ipos") - F.row_number().over(along)).groupBy(*key, "item", "delta", "run", "len").agg(F.min("ipos").alias("first"), F.count("*").alias("n"))
    ids = words.select("item", "item_id").distinct()
    found = runs.filter(F.col("n") >= F.least("len", F.lit(span))).join(hint(ids), "item")
    return found.select(*key, "item_id", (F.col("first") + F.col("delta")).alias("start"), (F.col("first") + F.col("delta") + F.col("n")).alias("end"))


@shields_names
def contamination(docs: DataFrame, items: DataFrame, *, span: int = SPAN, slop: int = 0) -> DataFrame:
    """Add ``n_words``, ``n_hit`` (words inside occurrences of test windows), ``items`` (sorted ids) and ``contaminated``.

    Null text has no words and null items have no windows. Rows that repeat, doc_ids that repeat and null
    doc_ids are told apart by their texts, so each row gets the result of its own text. With an empty
    benchmark nothing is hit; an empty table gives no rows. Very long texts are indexed word by word. Columns named like an added one are
    replaced; others pass through.
    """
    docs = docs.drop("n_words", "n_hit", "items", "contaminated")
    hits = materialize(phrase_matches(docs, items, span=span, slop=slop), "phrase-matches")
    key = ["_k1", "_k2"]
    spans = hits.groupBy(*key, "start").agg(F.max("end").alias("end"))
    before = F.max("end").over(Window.partitionBy(*key).orderBy("start").rowsBetween(Window.unboundedPreceding, -1))
    covered = spans.withColumn("_new", F.greatest(F.lit(0), F.col("end") - F.greatest("start", F.coalesce(before, F.lit(0)))))
    covered = covered.groupBy(*key).agg(F.sum("_new").alias("n_hit"))
    held = hits.groupBy(*key).agg(F.array_sort(F.collect_set(F.col("item_id").cast("string"))).alias("items"))
    found = covered.join(held, key)
    k1, k2 = row_key()
    return (
        docs.withColumns({"_k1": k1, "_k2": k2, "n_words": F.size(terms(whole())).cast("long")}).join(found, key, "left")
        .withColumns({"n_hit": F.coalesce("n_hit", F.lit(0)).cast("long"), "items": F.coalesce("items", F.array().cast("array<string>"))})
        .withColumn("contaminated", F.col("n_hit") > 0).drop(*key)
    )


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    out = contamination(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return out.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")


OP7_SQL = r"""
WITH low AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '') AS w FROM documents),
bench AS (
  SELECT item_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '') AS w FROM benchmark),
windows AS (
  SELECT DISTINCT item_id, least(10, len(w)) AS n, array_to_string(w[i:i + 9], ' ') AS g
  FROM (SELECT item_id, w, unnest(range(1, greatest(1, len(w) - 9) + 1)) AS i FROM bench WHERE len(w) > 0)),
grams AS (
  SELECT doc_id, i, n, array_to_string(w[i:i + n - 1], ' ') AS g
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM low, (SELECT DISTINCT n FROM windows) WHERE len(w) >= n)),
hits AS (SELECT doc_id, i, g.n, item_id FROM grams g JOIN windows b USING (n, g)),
hit_words AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM hits) GROUP BY doc_id),
hit_items AS (SELECT doc_id, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS ids FROM hits GROUP BY doc_id)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM low LEFT JOIN hit_words USING (doc_id) LEFT JOIN hit_items USING (doc_id)
"""
