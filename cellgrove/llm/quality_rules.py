"""Quality rules with thresholds that adapt to language and source."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cellgrove.llm.text import SPACE, let, lines, shields_names, strip_space, whole, words
from cellgrove.scratch import at_most, materialize

WINDOW, MIN_WORDS, MAX_REPEAT = 8, 20, 30
#: Distinct words are counted in windows of so many words, since their share in a whole text falls with its length.
SHARE_WORDS = 100
SYMBOLS = "#*$%&|<>"
#: A bucket of the sketch spans values within a factor GAMMA (0.1 % relative error, as errors of spreads count SPREADS times); values below ZERO share one bucket.
GAMMA, ZERO = 1.002, 1e-4
#: Limits of a group are shrunk towards those of its language as if it had SHRINK documents more with these, languages towards all documents,
#: and all documents towards a limit given beforehand.
SHRINK = 200
#: A limit is the median and SPREADS times the distance from there to the quartile on the side of the limit.
SPREADS = 8
#: A threshold table of up to so many rows (some 10 MB) is broadcast.
BROADCAST_ROWS = 100_000
#: metric: (side, limit given beforehand, least spread, outermost limit). A document fails above (side 1) or below (side -1) the limit of its group.
#: Where more than three quarters of the documents have the same value, the least spread takes the place of the spread.
RULES = {
    "symbol_ratio": (1, 0.02, 0.0025, 0.50),
    "dup_line_ratio": (1, 0.50, 0.05, 0.90),
    "repeat_ratio": (1, 0.25, 0.025, 0.29),
    "distinct_share": (-1, 0.30, 0.01, 0.05),
    "mean_word_chars": (1, 9.0, 0.1, 20.0),
    "short_word_chars": (-1, 3.0, 0.1, 1.0),
}


def _covered_words(w: Column) -> Column:
    """Words in WINDOW-word windows that occur twice or more among the windows of array ``w``."""
    grams = F.transform(F.sequence(F.lit(0), F.size(w) - WINDOW), lambda i: F.xxhash64(F.slice(w, i + 1, WINDOW)))

    def repeated(exact: Column) -> Column:
        def at(sorted_grams: Column) -> Column:
            same = lambda x, i: F.coalesce(x["g"] == F.get(sorted_grams, i - 1)["g"], F.lit(False)) | F.coalesce(x["g"] == F.get(sorted_grams, i + 1)["g"], F.lit(False))
            starts = F.array_sort(F.transform(F.filter(sorted_grams, same), lambda x: x["i"]))
            first = F.struct(F.lit(-WINDOW).alias("at"), F.lit(0).alias("n"))
            return F.aggregate(starts, first, lambda a, x: F.struct(x.alias("at"), (a["n"] + F.least(F.lit(WINDOW), x - a["at"])).alias("n")), lambda a: a["n"])

        return let(F.array_sort(exact), at)

    # The windows themselves are compared only in texts where hashes say that some window repeats.
    exact = F.transform(F.sequence(F.lit(0), F.size(w) - WINDOW), lambda i: F.struct(F.array_join(F.slice(w, i + 1, WINDOW), " ").alias("g"), i.alias("i")))
    hashes = let(grams, lambda g: F.size(F.array_distinct(g)) < F.size(g))
    return F.when(F.size(w) <= WINDOW, 0).when(hashes, repeated(exact)).otherwise(0).cast("long")


def _distinct_share(w: Column) -> Column:
    """Mean share of distinct words over the SHARE_WORDS-word windows that follow each other in array ``w``.

    The last window ends with the text, so that all have the same length; a shorter text is one window.
    """
    n = F.size(w)
    starts = F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0)), F.lit(SHARE_WORDS))
    counts = F.transform(starts, lambda i: F.size(F.array_distinct(F.slice(w, F.greatest(F.least(i, n - SHARE_WORDS), F.lit(0)) + 1, SHARE_WORDS))))
    share = let(counts, lambda c: F.aggregate(c, F.lit(0).cast("long"), lambda a, x: a + x) / (F.size(c) * F.least(n, F.lit(SHARE_WORDS))))
    return F.when(n > 0, share).otherwise(1.0)


def with_statistics(docs: DataFrame) -> DataFrame:
    """Add ``n_words``, ``word_chars``, ``n_symbols``, ``n_lines``, ``n_dup_lines``, ``n_repeat_words``, ``n_distinct_words`` and ``distinct_share`` of the whole texts."""
    full = docs.withColumns({"_t": whole(), "_w": words(whole()), "_l": F.filter(lines(whole()), lambda x: strip_space(x) != "")})
    length = F.length("_t")
    return full.withColumns({
        "n_words": F.size("_w").cast("long"),
        "word_chars": F.length(F.translate("_t", SPACE, "")).cast("long"),
        "n_symbols": (length - F.length(F.translate("_t", SYMBOLS, ""))).cast("long"),
        "n_lines": F.size("_l").cast("long"),
        "n_dup_lines": (F.size("_l") - F.size(F.array_distinct("_l"))).cast("long"),
        "n_repeat_words": _covered_words(F.col("_w")),
        "n_distinct_words": F.size(F.array_distinct("_w")).cast("long"),
        "distinct_share": _distinct_share(F.col("_w")),
    }).drop("_t", "_w", "_l")


def _values() -> dict[str, Column]:
    """The metrics of the rules."""
    n, chars = F.greatest(F.col("n_words"), F.lit(1)), F.greatest(F.col("word_chars"), F.lit(1))
    return {
        "symbol_ratio": F.col("n_symbols") / chars,
        "dup_line_ratio": F.col("n_dup_lines") / F.greatest(F.col("n_lines"), F.lit(1)),
        "repeat_ratio": F.col("n_repeat_words") / n,
        "distinct_share": F.col("distinct_share"),
        "mean_word_chars": F.col("word_chars") / n,
        "short_word_chars": F.col("word_chars") / n,
    }


def quantile_sketch(stats: DataFrame, keys: list[str]) -> DataFrame:
    """Counts by ``keys``, metric and logarithmic bucket: sketches merge by adding counts, whatever the grouping."""
    bucket = F.when(F.col("value") < ZERO, F.lit(None).cast("long")).otherwise(F.ceil(F.log("value") / math.log(GAMMA)))
    metrics = F.array(*[F.struct(F.lit(k).alias("metric"), v.cast("double").alias("value")) for k, v in _values().items()])
    return stats.select(*keys, F.inline(metrics)).groupBy(*keys, "metric", bucket.alias("bucket")).agg(F.count("*").alias("n"))


def adaptive_thresholds(sketch: DataFrame) -> DataFrame:
    """One row a (lang, source) with the limits of its metrics, from medians and quartiles of merged sketches, shrunk upwards by count."""
    levels = []
    for level, keys in enumerate((["lang", "source"], ["lang"], [])):
        own = [F.col(k) for k in keys] + [F.lit(None).cast("string").alias(k) for k in ("lang", "source") if k not in keys]
        merged = sketch.groupBy(*keys, "metric", "bucket").agg(F.sum("n").alias("n")).select(*own, "metric", "bucket", "n").withColumn("level", F.lit(level))
        levels.append(merged.select("level", "lang", "source", "metric", "bucket", "n"))
    every = levels[0].union(levels[1]).union(levels[2])
    group = Window.partitionBy("level", "lang", "source", "metric")
    ranked = every.withColumns({"upto": F.sum("n").over(group.orderBy(F.col("bucket").asc_nulls_first())), "total": F.sum("n").over(group)})

    def rule(i: int) -> Column:
        return F.create_map(*[x for k, v in RULES.items() for x in (F.lit(k), F.lit(v[i]))])[F.col("metric")]

    def quantile(share: Column) -> Column:
        bucket = F.min(F.when(F.col("upto") >= share * F.col("total"), F.struct("upto", "bucket")))["bucket"]
        return F.coalesce(2 * F.pow(F.lit(GAMMA), bucket) / (GAMMA + 1), F.lit(0.0))

    values = ranked.groupBy("level", "lang", "source", "metric").agg(F.first("total").alias("total"), quantile(F.lit(0.5)).alias("median"), quantile(0.5 + 0.25 * rule(0)).alias("quartile"))
    spread = F.greatest(rule(0) * (F.col("quartile") - F.col("median")), rule(2))
    own = F.col("median") + rule(0) * SPREADS * spread
    own = F.when(rule(0) > 0, F.least(own, rule(3))).otherwise(F.greatest(own, rule(3)))
    limits = values.select("level", "lang", "source", "metric", "total", own.alias("limit"))
    groups, langs, top = (limits.filter(F.col("level") == i) for i in range(3))
    langs = langs.select(F.col("lang").alias("_l"), F.col("metric").alias("_m"), F.col("total").alias("_ln"), F.col("limit").alias("_ll"))
    top = top.select("metric", F.col("total").alias("_tn"), F.col("limit").alias("_tl"))
    joined = groups.join(langs, F.col("lang").eqNullSafe(F.col("_l")) & (F.col("metric") == F.col("_m")), "left").join(F.broadcast(top), "metric")  # one row a metric
    shrunk = rule(1)
    for n, limit in (("_tn", "_tl"), ("_ln", "_ll"), ("total", "limit")):
        shrunk = (F.col(n) * F.col(limit) + SHRINK * shrunk) / (F.col(n) + SHRINK)
    found = joined.select("lang", "source", F.struct("metric", shrunk.alias("limit")).alias("m")).groupBy("lang", "source").agg(F.map_from_entries(F.collect_list("m")).alias("_limits"))  # one entry a rule
    return found.select(F.col("lang").alias("_lang"), F.col("source").alias("_source"), "_limits")


@shields_names
def assess(docs: DataFrame, *, carry: list[str] | None = None) -> DataFrame:
    """Statistics and verdict of every document.

    ``base_failed`` is true for fewer than 20 words, or more than 30 % of words in repeated 8-word windows.
    ``kept`` is false for those and for documents beyond a limit of their (lang, source): the median and a
    multiple of the spread of that group, read from a mergeable logarithmic-bucket sketch and shrunk by count
    towards those of the language and of all documents. Returns the columns in ``carry`` (all by default) with both and the statistics.

    Null or empty text has no words and fails; null lang or source form groups of their own. Very long texts are counted whole, by shares
    that don't depend on length. Repeated rows have equal results, and count each in the sketches; an empty table gives no rows. The texts are read once:
    statistics are written to the shared folder, and sketches and verdicts come from there. Columns named
    like an added one are replaced.
    """
    added = ["n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "n_distinct_words", "distinct_share", "base_failed", "kept"]
    kept_columns = [c for c in (carry or docs.columns) if c not in added]
    keyed = docs.drop(*added).withColumns({"_lang": F.col("lang"), "_source": F.col("source")})
    stats = with_statistics(keyed).select(*kept_columns, "_lang", "_source", *added[:-2])
    stats = materialize(stats, "quality-statistics")
    sketch = quantile_sketch(stats.withColumns({"lang": F.col("_lang"), "source": F.col("_source")}), ["lang", "source"])
    limits = materialize(adaptive_thresholds(sketch), "quality-thresholds")
    limits = F.broadcast(limits) if at_most(limits, BROADCAST_ROWS) else limits
    limits = limits.select(F.col("_lang").alias("_gl"), F.col("_source").alias("_gs"), "_limits")
    beyond = F.lit(False)
    for metric, (side, *_) in RULES.items():
        limit = F.col("_limits")[metric]
        value = _values()[metric]
        beyond = beyond | F.coalesce(value > limit if side > 0 else value < limit, F.lit(False))
    base = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT * F.col("n_words"))
    return (
        stats.join(limits, F.col("_lang").eqNullSafe(F.col("_gl")) & F.col("_source").eqNullSafe(F.col("_gs")), "left")
        .withColumn("base_failed", base).withColumn("kept", ~(F.col("base_failed") | beyond))
        .select(*kept_columns, *added)
    )


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang", "source")
    return assess(docs, carry=["doc_id"]).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
