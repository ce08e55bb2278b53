"""Column expressions on whole texts, shared by the corpus operators."""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The ASCII white space of every contract: space and \x09-\x0D.
SPACE = " \t\n\x0b\x0c\r"
SPACES = r"[\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def whole(text: str = "text") -> Column:
    """The text, empty where it is null."""
    return F.coalesce(F.col(text), F.lit(""))


def ascii_lower(c: Column) -> Column:
    """A-Z lower-cased; other letters stay as they are."""
    return F.translate(c, UPPER, LOWER)


def strip_space(c: Column) -> Column:
    return F.btrim(c, F.lit(SPACE))


def words(c: Column) -> Column:
    """The runs of other characters than ASCII white space, in order."""
    stripped = strip_space(c)
    return F.when(stripped == "", F.array().cast("array<string>")).otherwise(F.split(stripped, SPACES))


def lines(c: Column) -> Column:
    return F.split(c, "\n")


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once a row, although ``body`` uses it within lambdas."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def row_key(doc_id: str = "doc_id", text: str = "text") -> list[Column]:
    """Two longs that tell rows apart as far as results that depend on the text alone can differ; ids that are no number count as -1."""
    return [F.coalesce(F.col(doc_id).try_cast("long"), F.lit(-1)).alias("_k1"), F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("_k2")]


def own_key(doc_id: str = "doc_id", text: str = "text") -> list[Column]:
    """What tells rows apart: doc_id as it is, of any type and null too, and a hash of the text. Joins on it must be null-safe, as `same_key` is."""
    return [F.col(doc_id).alias("_k1"), F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("_k2")]


def same_key(k1: str = "_k1", k2: str = "_k2", other1: str = "_o1", other2: str = "_o2") -> Column:
    return F.col(k1).eqNullSafe(F.col(other1)) & (F.col(k2) == F.col(other2))


def set_aside(docs: DataFrame, read: list[str]) -> tuple[DataFrame, Callable]:
    """``docs`` with all columns but those in ``read`` under names that no operator uses, and a function that gives back the columns of ``docs``."""
    hidden = {c: f"kept_aside_{i}" for i, c in enumerate(docs.columns) if c not in read}
    return docs.withColumnsRenamed(hidden), lambda out: out.select(*[F.col(hidden.get(c, c)).alias(c) for c in docs.columns])


def shields_names(operator: Callable) -> Callable:
    """Keeps input columns whose names begin with an underscore, as those of helpers do, out of the operator's way; they come back under their names."""

    @functools.wraps(operator)
    def call(docs: DataFrame, *args, **options) -> DataFrame:
        prefix = "kept"
        while any(c.lower().startswith(prefix) for c in docs.columns):
            prefix += "x"
        hidden = {c: prefix + c for c in docs.columns if c.startswith("_")}
        if not hidden:
            return operator(docs, *args, **options)
        if options.get("carry"):
            options["carry"] = [hidden.get(c, c) for c in options["carry"]]
        return operator(docs.withColumnsRenamed(hidden), *args, **options).withColumnsRenamed({v: k for k, v in hidden.items()})

    return call
