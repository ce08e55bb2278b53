"""A sparse rule ensemble for document quality, compiled to column expressions."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.ml.classification import GBTClassifier, LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cellgrove.llm.text import SPACE, lines, strip_space, whole, words

#: Labelled rows that a model is fitted on, at most; those with the smallest hashes of their doc_id.
TRAIN_ROWS = 20_000
TREES, DEPTH, SEED = 12, 3, 11
#: Strength of the lasso on the rules' weights.
LASSO = 0.0005
THRESHOLD = 0.3
FOLDS = 5
SYMBOLS, DIGITS, UPPER = "#*$%&|<>", "0123456789", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % FOLDS == 0, F.lit(False))


def statistics(docs: DataFrame) -> DataFrame:
    """``docs`` with a double column for each of `STATISTICS`, of the whole text alone."""
    cut = docs.withColumns({"_t": whole(), "_w": words(whole()), "_l": F.filter(lines(whole()), lambda x: strip_space(x) != "")})
    n, length = F.greatest(F.size("_w"), F.lit(1)), F.length("_t")
    without = lambda chars: length - F.length(F.translate("_t", chars, ""))
    chars = F.greatest(F.length(F.translate("_t", SPACE, "")), F.lit(1))
    values = {
        "n_words": F.size("_w"),
        "mean_word_chars": chars / n,
        "symbol_ratio": without(SYMBOLS) / chars,
        "digit_ratio": without(DIGITS) / chars,
        "upper_ratio": without(UPPER) / chars,
        "period_ratio": without(".") / n,
        "comma_ratio": without(",") / n,
        "dup_line_ratio": 1 - F.size(F.array_distinct("_l")) / F.greatest(F.size("_l"), F.lit(1)),
        "words_per_line": n / F.greatest(F.size("_l"), F.lit(1)),
        "distinct_word_ratio": F.size(F.array_distinct("_w")) / n,
        "bytes_per_char": F.octet_length("_t") / F.greatest(length, F.lit(1)),
    }
    return cut.withColumns({k: v.cast("double") for k, v in values.items()}).drop("_t", "_w", "_l")


STATISTICS = ["n_words", "mean_word_chars", "symbol_ratio", "digit_ratio", "upper_ratio", "period_ratio", "comma_ratio", "dup_line_ratio", "words_per_line", "distinct_word_ratio", "bytes_per_char"]

Rule = tuple[tuple[int, bool, float], ...]


def tree_paths(tree: str) -> list[Rule]:
    """The conjunctions on the paths of a tree, inner nodes' too, from its printed form: (statistic, at most?, split)."""
    path: list[tuple[int, bool, float]] = []
    found: list[Rule] = []
    for line in tree.splitlines():
        m = re.match(r"( *)(?:If|Else) \(feature (\d+) (<=|>) ([-+.\dE]+)\)", line)
        if m:
            depth = (len(m[1]) - 3) // 1
            path = [p for p in path if p[3] < depth]  # type: ignore[misc]
            path.append((int(m[2]), m[3] == "<=", float(m[4]), depth))  # type: ignore[arg-type]
            found.append(tuple(p[:3] for p in path))  # type: ignore[misc]
    return found


def simplified(rule: Rule) -> Rule:
    """The tightest condition a statistic and side, in order."""
    best: dict[tuple[int, bool], float] = {}
    for i, below, at in rule:
        best[i, below] = min(best.get((i, below), at), at) if below else max(best.get((i, below), at), at)
    return tuple(sorted((i, below, at) for (i, below), at in best.items()))


def rule_column(rule: Rule) -> Column:
    conditions = [F.col(STATISTICS[i]) <= at if below else F.col(STATISTICS[i]) > at for i, below, at in rule]
    return reduce(lambda a, b: a & b, conditions)


def fit_rules(labelled: DataFrame, *, seed: int = SEED) -> tuple[float, list[tuple[float, Rule]]]:
    """(intercept, [(weight, rule)]) from rows with the statistics and ``label`` (0 or 1).

    Boosted trees of depth 3 propose rules (all their paths); a logistic regression with a lasso on them keeps few.
    With fewer than two labels in the rows there are no rules and the intercept is the log odds of the labels.
    """
    n, ones = labelled.agg(F.count("*"), F.sum("label")).first()
    ones = ones or 0
    if not 0 < ones < n:
        return (2.0 if ones else -2.0 if n else 0.0), []
    rows = VectorAssembler(inputCols=STATISTICS, outputCol="features").transform(labelled).cache()
    trees = GBTClassifier(maxIter=TREES, maxDepth=DEPTH, stepSize=0.3, subsamplingRate=0.7, featureSubsetStrategy="onethird", seed=seed).fit(rows)
    rules = sorted({simplified(r) for t in trees.trees for r in tree_paths(t.toDebugString)})
    held = rows.select("label", *[rule_column(r).cast("double").alias(f"r{i}") for i, r in enumerate(rules)])
    held = VectorAssembler(inputCols=[f"r{i}" for i in range(len(rules))], outputCol="features").transform(held).select("label", "features").cache()
    model = LogisticRegression(elasticNetParam=1.0, regParam=LASSO, maxIter=200, standardization=False).fit(held)
    rows.unpersist(), held.unpersist()
    return float(model.intercept), [(float(w), r) for w, r in zip(model.coefficients.toArray(), rules, strict=True) if w]


def score_column(intercept: float, rules: list[tuple[float, Rule]]) -> Column:
    total = F.lit(intercept)
    for w, r in rules:
        total = total + F.when(rule_column(r), F.lit(w)).otherwise(0.0)
    return 1 / (1 + F.exp(-total))


def training_rows(docs: DataFrame, labels: DataFrame, *, limit: int = TRAIN_ROWS) -> DataFrame:
    """Statistics and label of at most ``limit`` labelled documents that aren't held out; rows with a null doc_id or label don't count.

    Of rows that share a doc_id one counts, with the first text in code point order.
    """
    usable = labels.filter(F.col("doc_id").isNotNull() & F.col("quality").isNotNull() & ~held_out(F.col("doc_id")))
    usable = usable.groupBy("doc_id").agg(F.max("quality").alias("label"))
    sample = usable.withColumn("_h", F.xxhash64("doc_id")).orderBy("_h", "doc_id").limit(limit).select("doc_id", F.col("label").cast("double").alias("label"))
    rows = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.max("label").alias("label"))
    return statistics(rows).select("label", *STATISTICS)  # at most `limit` rows


def score_quality(docs: DataFrame, labels: DataFrame, *, limit: int = TRAIN_ROWS) -> DataFrame:
    """Add ``held_out``, ``score`` (0 to 1) and ``predicted`` (score >= 0.3) to every document.

    Scores depend on the text alone: doc_id, lang and source are no inputs. Null and empty texts are scored as
    texts without words, very long ones as a whole. Repeated rows have equal scores; an empty table gives no rows. Without usable labels every
    score is 0.5. Clashing columns are replaced.
    """
    spark = docs.sparkSession
    rows = spark.createDataFrame(training_rows(docs, labels, limit=limit).toPandas(), "label double, " + ", ".join(f"{c} double" for c in STATISTICS))
    intercept, rules = fit_rules(rows)
    names = docs.drop("held_out", "score", "predicted").columns
    inner = docs.select(*[F.col(c) for c in names]).select(F.struct(*names).alias("_doc"), "text")
    return statistics(inner).select("_doc.*", held_out(F.col("_doc.doc_id")).alias("held_out"), score_column(intercept, rules).alias("score")).withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))


def op4_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return score_quality(docs, labels).select("doc_id", "held_out", "score", "predicted")
