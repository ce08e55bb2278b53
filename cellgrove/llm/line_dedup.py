"""Line deduplication across documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cellgrove.llm.text import ascii_lower, lines, own_key, same_key, shields_names, strip_space, whole

MIN_KEY_CHARS, MIN_DOCS = 20, 3


def _keyed_lines(docs: DataFrame, min_chars: int) -> DataFrame:
    """One row a line whose key is long enough: row key (doc_id and hash of the text), position, and the key's 128-bit hash."""
    keys = F.transform(lines(ascii_lower(whole())), lambda line, i: F.struct(i.alias("pos"), strip_space(line).alias("key")))
    long_keys = F.filter(keys, lambda x: F.length(x["key"]) >= min_chars)
    hashed = F.transform(long_keys, lambda x: F.struct(x["pos"].alias("pos"), F.xxhash64(x["key"]).alias("h1"), F.xxhash64(F.lit(7), x["key"]).alias("h2")))
    return docs.select(*own_key(), F.inline(hashed).alias("pos", "h1", "h2"))


@shields_names
def dedup_lines(docs: DataFrame, *, min_chars: int = MIN_KEY_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """Drop lines that many documents share.

    A line's key is the line stripped of ASCII white space and with A-Z lower-cased. Keys of at least
    ``min_chars`` code points found in at least ``min_docs`` distinct documents lose all their lines,
    except in the largest ``doc_id`` that holds them. Returns ``docs`` with ``text`` replaced by the
    kept lines, plus ``n_lines``, ``n_dropped`` and ``dropped`` (positions).

    Null or empty text is one empty line. A ``doc_id`` may have any type that can be ordered; a null one counts as no document and is never the
    largest. Rows that share a ``doc_id`` count as one document; each is rewritten on its own. Columns
    of the input named like an added one are replaced; other columns pass through. Very long texts are exploded by line, never by prefix; an
    empty table gives no rows.
    """
    found = _keyed_lines(docs, min_chars)
    # Two phases (key and document, then key) with map-side sums: a line that every document has makes no hot task.
    common = (
        found.groupBy("h1", "h2").agg(F.count_distinct("_k1").alias("n_docs"), F.max("_k1").alias("keeper"))
        .filter(F.col("n_docs") >= min_docs).select("h1", "h2", "keeper")
    )
    drops = (
        found.join(common, ["h1", "h2"]).filter(~F.col("_k1").eqNullSafe(F.col("keeper")))
        .groupBy(F.col("_k1").alias("_o1"), F.col("_k2").alias("_o2")).agg(F.collect_set("pos").alias("_drop"))
    )
    docs = docs.drop("n_lines", "n_dropped", "dropped")
    none = F.array().cast("array<int>")
    own, k1, k2 = lines(whole()), *own_key()
    kept = F.transform(F.array_except(F.sequence(F.lit(0), F.size("_lines") - 1), F.col("_drop")), lambda i: F.get(F.col("_lines"), i))
    return (
        docs.withColumns({"_k1": k1, "_k2": k2}).join(drops, same_key(), "left")
        .withColumns({"_lines": own, "_drop": F.coalesce("_drop", none)})
        .withColumns({
            "n_lines": F.size("_lines").cast("long"), "n_dropped": F.size("_drop").cast("long"), "dropped": F.array_sort("_drop"),
            "text": F.when(F.size("_drop") == 0, whole()).otherwise(F.array_join(kept, "\n")),
        })
        .drop("_k1", "_k2", "_o1", "_o2", "_lines", "_drop")
    )


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return dedup_lines(docs).select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


OP2_SQL = r"""
WITH split AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos
  FROM documents),
keyed AS (
  SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM split),
common AS (
  SELECT key, max(doc_id) AS keeper FROM keyed WHERE length(key) >= 20
  GROUP BY key HAVING count(DISTINCT doc_id) >= 3),
marked AS (
  SELECT k.doc_id, k.pos, k.line, c.key IS NOT NULL AND k.doc_id IS DISTINCT FROM c.keeper AS dropped
  FROM keyed k LEFT JOIN common c ON k.key = c.key)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (dropped) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT dropped), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""
