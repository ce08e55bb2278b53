"""Normalisation and profiles of marker intensities in long form (keys, marker, value)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellgrove.operators.ranks import exact_percentiles

#: Of the adaptive method: scale, quantile and the least cofactor.
SCALE, QUANTILE, EPS = 5.0, 0.2, 1e-5
NUMERIC = ("tinyint", "smallint", "int", "bigint", "float", "double")


def numeric_markers(wide: DataFrame, *, skip: tuple[str, ...] = ("cell_id",)) -> list[str]:
    """Names of the numeric columns other than ids."""
    return [c for c, t in wide.dtypes if c not in skip and (t in NUMERIC or t.startswith("decimal"))]


def melt(wide: DataFrame, *, keys: list[str]) -> DataFrame:
    """Wide marker columns to (keys, marker, value); NaN becomes null."""
    out = wide.unpivot(keys, numeric_markers(wide, skip=tuple(keys)), "marker", "value")
    return out.withColumn("value", F.nanvl(F.col("value").cast("double"), F.lit(None).cast("double")))


def normalize(expression: DataFrame, *, keys: list[str], method: str | None = "arcsinh", cofactor: float | str = 1.0, scale: float = SCALE, quantile: float = QUANTILE, eps: float = EPS) -> DataFrame:
    """asinh(value / cofactor); the cofactor is fixed, or of each group and marker scale * quantile + eps.

    With an adaptive cofactor a group and marker that has a null stays null. None or "none" passes values through.
    """
    if method is None or method in ("none", "raw"):
        return expression
    if method not in ("arcsinh", "asinh"):
        raise ValueError(f"unknown normalisation {method!r}")
    if not isinstance(cofactor, str):
        return expression.withColumn("value", F.asinh(F.col("value") / F.lit(float(cofactor))))
    if cofactor not in ("quantile", "adaptive", "auto"):
        raise ValueError(f"unknown cofactor {cofactor!r}")
    whole = F.count("value") == F.count("*")
    q = expression.groupBy(*keys, "marker").agg(F.when(whole, F.percentile("value", F.lit(quantile))).alias("_q"))
    named = [F.col(c).alias(f"_{c}") for c in (*keys, "marker")]
    q = q.select(*named, "_q")
    same = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in (*keys, "marker")]
    out = expression.join(q, on=_all(same))
    return out.withColumn("value", F.asinh(F.col("value") / (scale * F.col("_q") + eps))).select(*expression.columns)


def _all(conditions):
    out = conditions[0]
    for c in conditions[1:]:
        out = out & c
    return out


def range_check(expression: DataFrame, *, regions: int = 6, seed: int = 0) -> DataFrame:
    """(marker, p50, p99, p999, max_value) of normalised values over some regions, the first in the order of md5(seed:region_id)."""
    order = F.md5(F.concat_ws(":", F.lit(seed), F.col("region_id").cast("string")).cast("binary"))
    some = expression.select("region_id").distinct().orderBy(order, "region_id").limit(regions)
    e = expression.join(F.broadcast(some), "region_id", "left_semi")  # at most `regions` rows
    quantiles = exact_percentiles(e, keys=["marker"], value="value", percentiles={"p50": 0.5, "p99": 0.99, "p999": 0.999})
    return _same_group(e.groupBy("marker").agg(F.max("value").alias("max_value")), quantiles, ["marker"]).select("marker", "p50", "p99", "p999", "max_value")


def markers_at_zero(expression: DataFrame, *, keys: list[str], quantile: float = QUANTILE) -> DataFrame:
    """(keys, n_markers, n_at_zero): how many markers have 0 as that quantile."""
    q = expression.groupBy(*keys, "marker").agg(F.percentile("value", F.lit(quantile)).alias("_q"))
    return q.groupBy(*keys).agg(F.count("*").alias("n_markers"), F.count_if(F.col("_q") == 0).alias("n_at_zero"))


def profile(expression: DataFrame, *, keys: list[str], percentiles: tuple[float, ...] = (0.2, 0.5, 0.99)) -> DataFrame:
    """Range, percentiles and share of exact zeros of the values by ``keys``. Percentiles are exact for groups of any size."""
    some = {f"p{round(100 * p)}": p for p in percentiles}
    span = expression.groupBy(*keys).agg(F.count("value").alias("n"), F.min("value").alias("min_value"), F.max("value").alias("max_value"), F.avg((F.col("value") == 0).cast("double")).alias("zero_share"))
    joined = _same_group(span, exact_percentiles(expression, keys=keys, value="value", percentiles=some), keys)
    return joined.select(*keys, "n", "min_value", "max_value", *some, "zero_share")


def _same_group(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """``left`` with the columns of ``right`` for equal keys, null equal to null."""
    named = right.withColumnsRenamed({k: f"_{k}" for k in keys})
    return left.join(named, _all([F.lit(True), *[F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys]]), "left").drop(*[f"_{k}" for k in keys])
