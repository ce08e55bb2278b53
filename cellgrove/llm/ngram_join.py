"""Exact Jaccard join of documents on word shingles, by PartEnum signatures."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cellgrove.llm.similarity import SETS, SHINGLE_WORDS, SIGNATURES, bin_counts, hash_rows, linked_classes, mix, shared_stars, shingle_hashes, signature_rows, text_slices, word_hashes
from cellgrove.llm.text import row_key, shields_names, whole
from cellgrove.scratch import at_most, materialize

NUM, DEN = 75, 100
#: Parts of the shingle domain for each unit of the largest size of a band.
PARTS = 0.42
#: Row keys of sets to look at again: up to so many (about 20 MB) are broadcast, more are joined by shuffle.
BROADCAST_KEYS = 300_000
#: Shingles of passages that many documents share make poor signatures. One shingle in SAMPLED (by hash) is counted over all
#: documents; those of COMMON documents or more, the MOST_COMMON most frequent, mark what is within NEARBY words of them in one document
#: as common (at most 81 * 20,000 hashes, 13 MB, sent to the tasks). Which shingles are marked changes the cost, never the result.
SAMPLED, COMMON, MOST_COMMON, NEARBY = 16, 12, 20_000, 40


@lru_cache(maxsize=None)
def _band(size: int, num: int, den: int) -> tuple[int, int, int]:
    """Number, least and largest size of the band of ``size``; the ends are (den/num)^2 apart."""
    number, low = 0, 1
    while True:
        high = max(low, low * den * den // (num * num))
        if low <= size <= high:
            return number, low, high
        number, low = number + 1, high + 1


def set_signatures(a: np.ndarray, num: int = NUM, den: int = DEN, common: np.ndarray | None = None) -> np.ndarray:
    """PartEnum signatures of a sorted array of distinct 64-bit hashes.

    A band of sizes splits the hash domain into parts. Two sets with den * |A and B| >= num * |A or B| differ in at most
    d = (|A| + |B|) * (den - num) / (den + num) elements, so in at most d parts; the signature of a
    non-empty part hashes all its elements. Of the parts in domain order, the first that agrees and isn't empty
    has at most d non-empty parts before it in either set, so each set gives its first d + 1, with d for its
    largest possible partner. A set with only d non-empty parts or fewer also enumerates single elements,
    since such a pair might agree in empty parts only. A set near its band's end gives signatures in the next band too.
    Elements in ``common`` (sorted, the same for all sets) belong to no part and come last among single elements.
    """
    s = len(a)
    order = a
    if common is not None and len(common):
        marked = common[np.minimum(np.searchsorted(common, a), len(common) - 1)] == a
        if marked.any():
            a = a[~marked]
            order = np.r_[a, order[marked]]
    most = s * den // num  # the largest partner
    out, mixed = [], mix(a)
    own, _, high = _band(s, num, den)
    ends = [(own, high)]
    if most > high:
        ends.append((own + 1, _band(high + 1, num, den)[2]))
    for number, end in ends:
        d = (s + min(most, end)) * (den - num) // (den + num)
        parts = max(1, int(PARTS * end))
        at = ((a >> np.uint64(32)) * np.uint64(parts)) >> np.uint64(32)
        starts = np.flatnonzero(np.r_[True, at[1:] != at[:-1]]) if len(a) else np.zeros(0, dtype=np.int64)
        if len(starts):
            sums = np.add.reduceat(mixed, starts)[: d + 1]
            out.append(mix(sums ^ mix((at[starts][: d + 1] << np.uint64(8)) + np.uint64(number + 1))))
        if len(starts) <= d:
            out.append(mix(order[: d + 1] ^ np.uint64(0x5BD1E995 + number)))
    return np.concatenate(out)


def _shingles(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[tuple[pa.RecordBatch, list[np.ndarray]]]:
    """Rows with the shingle hashes of each text, in order."""
    for b in text_slices(batches):
        w, at = word_hashes(b.column("text"))
        yield b, [shingle_hashes(w[i:j], k) for i, j in zip(at[:-1], at[1:], strict=True)]


def _document_sets(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[tuple[pa.RecordBatch, list[np.ndarray]]]:
    for b, found in _shingles(batches, k):
        yield b, [np.unique(h) for h in found]


def _set_key(a: np.ndarray) -> int:
    return xxhash.xxh3_64_intdigest(a.tobytes()) if len(a) else 0


def _int64(keys: list[int]) -> np.ndarray:
    return np.array(keys, dtype=np.uint64).view(np.int64)


def _common_shingles(nodes: DataFrame, keyed: DataFrame, k: int) -> np.ndarray:
    """Hashes of shingles in passages that many documents share; see SAMPLED."""
    counts = nodes.select("_k1", "_k2", F.explode("sampled").alias("h")).groupBy("h").agg(F.count("*").alias("n"), F.min(F.struct("_k1", "_k2")).alias("r"))
    top = counts.filter(F.col("n") >= COMMON).orderBy(F.desc("n"), "h").limit(MOST_COMMON)
    marks = materialize(top.groupBy("r").agg(F.collect_list("h").alias("marks")).select("r.*", "marks"), "common-marks")

    def nearby(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, found in _shingles(batches, k):
            for h, m in zip(found, b.column("marks").to_pylist(), strict=True):
                at = np.flatnonzero(np.isin(h, np.array(m, dtype=np.int64).view(np.uint64)))
                around = np.zeros(len(h) + 1, dtype=np.int64)
                np.add.at(around, np.maximum(at - NEARBY, 0), 1)
                np.add.at(around, np.minimum(at + NEARBY + 1, len(h)), -1)
                yield pa.RecordBatch.from_pydict({"h": pa.array(np.unique(h[np.cumsum(around[:-1]) > 0]).view(np.int64))})

    found = keyed.join(F.broadcast(marks), ["_k1", "_k2"]).select("text", "marks").mapInArrow(nearby, "h long").distinct()
    return np.sort(found.toPandas()["h"].to_numpy(dtype=np.int64).view(np.uint64))


def jaccard_components(docs: DataFrame, *, num: int = NUM, den: int = DEN, k: int = SHINGLE_WORDS) -> DataFrame:
    """(doc_id, _k1, _k2, n_shingles, comp, component_id) of every row.

    A document's set are its distinct k-word shingles, as 64-bit hashes (a document of fewer words is one shingle). Rows
    link when den * intersection >= num * union; component_id is the smallest doc_id reachable. Equal
    sets are one node. Candidates come from `set_signatures`, each is verified, and no pair is skipped but within
    what is one component already. Null or empty texts have no shingles and are linked with nothing.
    Repeated rows are equal sets. A null doc_id is never the smallest of a component. comp tells components apart
    whatever their ids are (null without shingles). Very long texts are one set as others are; an empty table gives no rows. Only doc_id and
    text are read, so other columns may have any name.
    """
    keyed = docs.select("doc_id", *row_key(), whole().cast("binary").alias("text"))

    def shape(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, sets in _document_sets(batches, k):
            columns = [b.column(c) for c in ("doc_id", "_k1", "_k2")]
            sampled = pa.array([a[a % np.uint64(SAMPLED) == 0].view(np.int64) for a in sets], pa.list_(pa.int64()))
            facts = [pa.array([len(a) for a in sets], pa.int64()), pa.array(_int64([_set_key(a) for a in sets])), pa.array([bin_counts(a) for a in sets], pa.binary()), sampled]
            yield pa.RecordBatch.from_arrays([*columns, *facts], ["doc_id", "_k1", "_k2", "n_shingles", "sk", "bins", "sampled"])

    id_type = keyed.schema["doc_id"].dataType.simpleString()
    nodes = materialize(keyed.mapInArrow(shape, f"doc_id {id_type}, _k1 long, _k2 long, n_shingles long, sk long, bins binary, sampled array<long>"), "shingle-sets")
    spark = docs.sparkSession
    common = spark.sparkContext.broadcast(_common_shingles(nodes, keyed, k))

    def signatures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, sets in _document_sets(batches, k):
            keys = {_set_key(a): a for a in sets if len(a)}
            if keys:
                own = [set_signatures(a, num, den, common.value) for a in keys.values()]
                of = np.repeat(np.array(list(keys), dtype=np.uint64), [len(x) for x in own])
                yield pa.RecordBatch.from_pydict(signature_rows(np.concatenate(own), of))

    def contents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()  # rows may repeat
        for _, sets in _document_sets(batches, k):
            new = {key: a for a in sets if (key := _set_key(a)) not in seen}
            seen |= new.keys()
            yield hash_rows(_int64(list(new)), list(new.values()))

    stars = shared_stars(keyed.select("text").mapInArrow(signatures, SIGNATURES))
    # A row of each set; equal sets are summed up before the shuffle.
    firsts = materialize(nodes.filter("n_shingles > 0").groupBy("sk").agg(F.min("doc_id").alias("first"), F.min(F.struct("_k1", "_k2")).alias("r")), "sets")
    nodes_of = nodes.select(F.struct("_k1", "_k2").alias("r"), "sk", F.col("n_shingles").alias("n"), "bins")
    in_stars = stars.select("sk").union(stars.select(F.col("hub").alias("sk"))).distinct()
    bounds = materialize(nodes_of.join(firsts.join(in_stars, "sk", "left_semi").select("sk", "r"), ["sk", "r"], "left_semi").select("sk", "n", "bins").distinct(), "set-bounds")

    def fetch(keys: DataFrame) -> DataFrame:
        rows = materialize(firsts.join(keys, "sk", "left_semi").select("r.*"), "candidate-rows")
        rows = F.broadcast(rows) if at_most(rows, BROADCAST_KEYS) else rows
        return materialize(keyed.join(rows, ["_k1", "_k2"], "left_semi").select("text").mapInArrow(contents, SETS), "candidate-sets")

    comps = linked_classes(stars, fetch, num=num, den=den, bounds=bounds)
    placed = firsts.drop("r").join(comps.withColumnRenamed("node", "sk"), "sk", "left").withColumn("comp", F.coalesce("comp", "sk"))
    lowest = placed.groupBy("comp").agg(F.min("first").alias("component_id"))
    named = placed.join(lowest, "comp").select("sk", "comp", "component_id")
    own = F.col("n_shingles") > 0
    return nodes.join(named, "sk", "left").select("doc_id", "_k1", "_k2", "n_shingles", F.when(own, F.col("comp")).alias("comp"), F.when(own, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))


@shields_names
def keep_one(docs: DataFrame, **options) -> DataFrame:
    """Of each component one document: the smallest doc_id (null last), then the smallest _k2; of repeated rows one.

    Rows without shingles are linked with nothing and all stay, but for repeated ones. All columns pass through; an empty table stays empty.
    """
    found = jaccard_components(docs, **options)
    lone = F.col("comp").isNull()
    row = F.struct(F.col("doc_id").isNull().alias("unnamed"), "_k1", "_k2")
    firsts = found.groupBy("comp", F.when(lone, F.col("_k1")).alias("l1"), F.when(lone, F.col("_k2")).alias("l2")).agg(F.min(row).alias("r")).select("r._k1", "r._k2")
    k1, k2 = row_key()
    kept = docs.withColumns({"_k1": k1, "_k2": k2}).join(firsts, ["_k1", "_k2"], "left_semi")
    one = Window.partitionBy("_k1", "_k2").orderBy(F.col("doc_id").asc_nulls_last())
    return kept.withColumn("_n", F.row_number().over(one)).filter("_n = 1").select(*docs.columns)


def op6_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return jaccard_components(docs).select("doc_id", "n_shingles", "component_id")
