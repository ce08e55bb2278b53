"""Deduplication of repeated passages, by MinHash banding of paragraphs."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cellgrove.llm.similarity import SETS, SHINGLE_WORDS, SIGNATURES, hash_rows, linked_classes, mix, shared_stars, shingle_hashes, signature_rows, text_slices, word_hashes
from cellgrove.llm.text import own_key, same_key, whole
from cellgrove.scratch import materialize

NUM, DEN = 75, 100
#: A pair at Jaccard 0.75 meets in one of BANDS bands of BAND_ROWS minima with probability 1 - (1 - 0.75^2)^6 = 0.993; equal paragraphs always do.
BANDS, BAND_ROWS = 6, 2
#: A paragraph begins where the hash of three words is the least within so many words on either side. Long paragraphs (some 41 words) are
#: banded: one changed word inside leaves them a similarity of 0.75. Short ones (some 11 words) are too short to be similar without being equal: they
#: are matched by equality, and find passages of 50 words or more wherever these begin.
SHORT, LONG = 5, 20
#: Longer paragraphs are cut at every so many radii; those of fewer words than a shingle are no paragraphs.
LONGEST = 12
#: Runs with fewer words in repeated paragraphs are set phrases, not passages.
MIN_RUN = 16
#: Repeated paragraphs of the same text with up to so many other words between them are one run (the words between stay).
GAP = 24
_A = np.random.default_rng(7).integers(1, 2**63, BANDS * BAND_ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def paragraph_starts(w: np.ndarray, at: np.ndarray, radius: int) -> np.ndarray:
    """Word positions at which the paragraphs of texts begin; text i has the word hashes ``w[at[i] : at[i + 1]]``.

    The cuts depend on the words around them alone, so a passage that is copied into another text is cut there
    in the same places, but for ``radius`` + 2 words at its ends. Texts of fewer than 2 * ``radius`` words are one paragraph.
    """
    never, counts, longest = np.iinfo(np.uint64).max, np.diff(at), LONGEST * radius
    h = np.full(len(w), never)
    h[:-2] = mix(w[:-2] * _A[0] + w[1:-1] * _A[1] + w[2:] * _A[2])
    filled = counts > 0
    firsts, lasts = at[:-1][filled], at[1:][filled] - 1
    h[np.r_[lasts, np.maximum(lasts - 1, firsts)]] = never
    h[np.repeat(counts < 2 * radius, counts)] = never
    # Texts lie apart by radius places, so that no place looks into another text.
    places = np.arange(len(w)) + radius * (1 + np.repeat(np.arange(len(counts)), counts))
    full = np.full(len(w) + radius * (len(counts) + 1), never)
    full[places] = h
    least = full[: len(full) - radius + 1].copy()
    for i in range(1, radius):
        np.minimum(least, full[i : len(full) - radius + 1 + i], out=least)
    begins = (h < least[places - radius]) & (h <= least[places + 1])
    begins[firsts] = True
    cuts = np.flatnonzero(begins)
    pieces = -(-np.diff(np.r_[cuts, len(w)]) // longest)
    within = np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    return np.repeat(cuts, pieces) + longest * within


def paragraphs(w: np.ndarray, at: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of the paragraphs of a shingle's length or more: texts, first words, ends, keys, and all their shingle hashes with the places where each begins.

    Texts are as in `paragraph_starts`. A key is a hash of the sum of the mixed shingle hashes, so paragraphs of either length
    have equal keys if they have equal shingles.
    """
    none = np.zeros(0, dtype=np.int64)
    if len(w) < SHINGLE_WORDS:
        return none, none, none, none.view(np.uint64), none.view(np.uint64), none
    starts = paragraph_starts(w, at, radius)
    ends = np.r_[starts[1:], len(w)]
    counts = np.maximum(0, ends - starts - SHINGLE_WORDS + 1)
    kept = counts > 0
    if not kept.any():
        return none, none, none, none.view(np.uint64), none.view(np.uint64), none
    h = shingle_hashes(w)
    across = (ends[:, None] - np.arange(1, SHINGLE_WORDS)).ravel()
    inside = np.ones(len(h), dtype=bool)
    inside[across[(across >= 0) & (across < len(h))]] = False
    h = h[inside]
    places = np.r_[0, np.cumsum(counts[kept])[:-1]]
    starts, ends = starts[kept], ends[kept]
    of = np.searchsorted(at, starts, "right") - 1
    return of, starts - at[of], ends - at[of], mix(np.add.reduceat(mix(h), places)), h, places


def _occurrences(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["_k1", "_k2", "first_word", "end_word", "sk", "banded"]
    for b in text_slices(batches):
        w = word_hashes(b.column("text"))
        for radius in (SHORT, LONG):
            of, first, end, keys, _, _ = paragraphs(*w, radius)
            at = pa.array(of)
            yield pa.RecordBatch.from_arrays([b.column("_k1").take(at), b.column("_k2").take(at), pa.array(first.astype(np.int32)), pa.array(end.astype(np.int32)), pa.array(keys.view(np.int64)), pa.array(np.full(len(of), radius == LONG))], names)


def band_signatures(flat: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """A row of BANDS signatures for each set of hashes: each hashes BAND_ROWS minima."""
    minima = np.stack([np.minimum.reduceat(mix(flat * c), starts) for c in _A])
    out = np.zeros((BANDS, len(starts)), dtype=np.uint64)
    for band in range(BANDS):
        for r in range(BAND_ROWS):
            out[band] = mix(out[band] + minima[band * BAND_ROWS + r] + np.uint64(band + 1))
    return out.T


def _signatures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in text_slices(batches):
        _, _, _, keys, h, places = paragraphs(*word_hashes(b.column("text")), LONG)
        if len(keys):
            yield pa.RecordBatch.from_pydict(signature_rows(band_signatures(h, places).reshape(-1), np.repeat(keys, BANDS)))


def _contents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The sets of the wanted paragraphs of the texts."""
    for b in text_slices(batches):
        _, _, _, keys, h, places = paragraphs(*word_hashes(b.column("text")), LONG)
        keys, ends = keys.view(np.int64), np.r_[places[1:], len(h)]
        wanted = b.column("wanted").flatten().to_numpy(zero_copy_only=False).astype(np.int64)
        found = np.flatnonzero(np.isin(keys, wanted))
        rows = found[np.unique(keys[found], return_index=True)[1]]
        if len(rows):
            yield hash_rows(keys[rows], [np.unique(h[places[i] : ends[i]]) for i in rows])


def repeated_passages(docs: DataFrame, *, min_run: int = MIN_RUN) -> DataFrame:
    """Passages that repeat, as runs of repeated paragraphs: one row a run.

    Paragraphs are content-defined stretches of some 41 words, and again of some 11, whatever line breaks a text has. Long ones
    that share a band of MinHash values are compared; a Jaccard similarity of 0.75 or more of their five-word shingles links them. Of
    each component of links (or of equal paragraphs) that two or more texts hold, the first occurrence in the smallest
    row stays and all others are removed; what only repeats within one text stays.
    Repeated paragraphs that overlap, follow each other or, with at most GAP words between them, stay in the same text make a run;
    runs of fewer than ``min_run`` words in such paragraphs are left out.

    Returns doc_id, _k1, _k2, first_word, end_word (exclusive), n_removed_words, removed (word ranges to cut; they may overlap) and
    first_doc_id (the smallest doc_id that holds one of its paragraphs). Words are runs of other characters than ASCII
    white space. Null, empty and very short texts have no paragraphs; very long ones are cut as others are. Rows that repeat in doc_id and text
    count once. doc_ids may have any type that can be ordered; null ones come first in the order. An empty table has no passages. Other columns are not read, so their names don't matter.
    """
    keyed, kind = docs.select(*own_key(), whole().cast("binary").alias("text")), docs.schema["doc_id"].dataType.simpleString()
    places = materialize(keyed.select("_k1", "_k2", "text").mapInArrow(_occurrences, f"_k1 {kind}, _k2 long, first_word int, end_word int, sk long, banded boolean"), "paragraphs")
    stars = shared_stars(keyed.select("text").mapInArrow(_signatures, SIGNATURES))
    in_stars = materialize(stars.select("sk").union(stars.select(F.col("hub").alias("sk"))).distinct(), "star-keys")
    holding = materialize(places.filter("banded").join(in_stars, "sk", "left_semi").groupBy("sk").agg(F.min(F.struct("_k1", "_k2")).alias("r")), "star-rows")

    def fetch(keys: DataFrame) -> DataFrame:
        holders = holding.join(keys, "sk", "left_semi").groupBy("r").agg(F.collect_list("sk").alias("wanted"))  # a text's own paragraphs
        holders = materialize(holders.select(F.col("r._k1").alias("_o1"), F.col("r._k2").alias("_o2"), "wanted"), "candidate-rows")
        return materialize(keyed.join(holders, same_key()).select("text", "wanted").mapInArrow(_contents, SETS), "candidate-sets")

    comps = linked_classes(stars, fetch, num=NUM, den=DEN)

    # Firsts and holders of a class are minima taken before the shuffle, so that a passage that very many documents have is no hot group.
    order, text = F.struct("_k1", "_k2", "first_word"), F.struct("_k1", "_k2")
    classes = places.groupBy("sk").agg(F.min(order).alias("first"), F.max(text).alias("hi"))
    classes = classes.join(comps.withColumnRenamed("node", "sk"), "sk", "left")
    # Most paragraphs are linked with no other and found in one text; they need not meet others.
    classes = classes.filter(F.col("comp").isNotNull() | (F.struct("first._k1", "first._k2") != F.col("hi")))
    classes = materialize(classes.withColumn("comp", F.coalesce("comp", "sk")), "classes")
    several = classes.groupBy("comp").agg(F.min("first").alias("keeper"), F.max("hi").alias("hi")).filter(F.struct("keeper._k1", "keeper._k2") != F.col("hi"))
    repeated = materialize(classes.select("sk", "comp").join(several, "comp").select("sk", "keeper"), "repeated-classes")
    marked = places.join(repeated, "sk").select("_k1", "_k2", "first_word", "end_word", "keeper", (order != F.col("keeper")).alias("cut")).distinct()  # rows may repeat
    in_text = Window.partitionBy("_k1", "_k2").orderBy("first_word", "end_word", "keeper", "cut")
    before = in_text.rowsBetween(Window.unboundedPreceding, -1)
    home = F.struct("keeper._k1", "keeper._k2")
    ends = marked.withColumns({
        "_end": F.coalesce(F.max("end_word").over(before), F.lit(-GAP - 1)), "_cut_end": F.coalesce(F.max(F.when(F.col("cut"), F.col("end_word"))).over(before), F.lit(0)),
        "_same": F.coalesce(F.lag(home).over(in_text) == home, F.lit(False))})
    begins = F.col("first_word") > F.col("_end") + F.when(F.col("_same"), GAP).otherwise(0)
    runs = ends.withColumn("_run", F.sum(begins.cast("int")).over(in_text))
    new = lambda end: F.greatest(F.lit(0), F.col("end_word") - F.greatest("first_word", F.col(end)))
    out = runs.groupBy("_k1", "_k2", "_run").agg(
        F.min("first_word").alias("first_word"), F.max("end_word").alias("end_word"), F.sum(F.when(F.col("cut"), new("_cut_end")).otherwise(0)).alias("n_removed_words"),
        F.array_sort(F.collect_set(F.when(F.col("cut"), F.struct("first_word", "end_word")))).alias("removed"), F.min("keeper._k1").alias("first_doc_id"), F.sum(new("_end")).alias("_covered"))
    return out.filter(F.col("_covered") >= min_run).drop("_run", "_covered").withColumn("doc_id", F.col("_k1"))


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = repeated_passages(docs)
    return found.select("doc_id", "first_word", "end_word", F.col("n_removed_words").cast("long").alias("n_removed_words"), "first_doc_id")
