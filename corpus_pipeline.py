"""A training-corpus pipeline over ``documents``: rules, near duplicates, decontamination, mixture, shards.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame. All but the last return the columns of ``documents``;
the last adds the place of each row in its shard. Between stages rows are written as Parquet and read again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from cellgrove.llm.decontamination import contamination
from cellgrove.llm.mixing import mixed_rows
from cellgrove.llm.ngram_join import keep_one
from cellgrove.llm.quality_rules import assess
from cellgrove.llm.sharding import with_shards
from cellgrove.llm.text import set_aside
from cellgrove.scratch import materialize


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the base rules or the thresholds of their language and source go.

    Null and empty texts fail. Very long texts are counted whole. Null languages and sources are groups. Repeated rows stay or go
    together. An empty table stays empty; other columns, whatever their names, pass through.
    """
    own, back = set_aside(docs, ["doc_id", "text", "lang", "source"])
    return back(assess(own).filter("kept"))


def ngram_jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of near duplicates the document with the smallest doc_id stays.

    Null ids come last, and ties go to the text with the smallest hash. Texts without words are near nothing; repeated rows leave one. Very
    long texts are one set of shingles. An empty table stays empty; other columns pass through.
    """
    return keep_one(docs)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a window of a benchmark item go.

    Null and empty texts, and all documents if the benchmark is empty, stay. Very long texts are searched whole. Rows that repeat have
    the same fate. An empty table stays empty; other columns pass through.
    """
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    own, back = set_aside(docs, ["doc_id", "text"])
    return back(contamination(own, items).filter("NOT contaminated"))


def mixing_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mixture takes it.

    Texts without words fill no budget and come as often as their source has whole epochs. Null sources are one source, the last. Equal keys go by doc_id, repeated
    rows together. Very long texts are taken whole or passed over. An empty table stays empty; other columns pass through.
    """
    own, back = set_aside(docs, ["doc_id", "text", "source"])
    return back(mixed_rows(own))


def sharding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows in a random order, dealt to the shards.

    Null and empty texts have size 1; repeated rows, also very many, are spread; a very long text has its bucket for itself. Input columns named
    like an added one are replaced. An empty table stays empty.
    """
    return with_shards(docs).drop("bucket")


STAGES = [
    ("quality rules", quality_rules),
    ("n-gram Jaccard join", ngram_jaccard_join),
    ("benchmark decontamination", benchmark_decontamination),
    ("mixing sources", mixing_sources),
    ("sharding", sharding),
]

#: Thresholds from sketches, components of links and seeded shuffles have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{i}")
    return docs
