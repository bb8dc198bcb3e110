"""Percentile-robust scaling, closeness, direction inference and weighted scores.

Percentiles come from order.with_percentiles: one aggregate for a small input, refined histograms of
all metrics at once for a large one. Other statistics are one-row aggregates that are cross-joined back by
broadcast: their size does not depend on the data. NaN is read as null throughout.
"""

from __future__ import annotations

import functools
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .order import with_percentiles

POLICIES = ("keep_null", "impute_median", "impute_median_or_half")


def finite(c: Column) -> Column:
    """The value as a double; NaN, infinities and what is no number as null."""
    d = c.try_cast("double")
    return F.when(F.isnan(d) | (F.abs(d) == float("inf")), F.lit(None)).otherwise(d)


def clip(c: Column) -> Column:
    return F.when(c.isNotNull(), F.least(F.greatest(c, F.lit(0.0)), F.lit(1.0)))


def with_statistics(df: DataFrame, *stats: Column) -> DataFrame:
    """Every row with the one-row aggregates `stats`."""
    return df.crossJoin(F.broadcast(df.agg(*stats)))


def imputed(df: DataFrame, columns: list[str]) -> DataFrame:
    """df with the nulls of each column replaced by its median."""
    medians = {f"_m_{c}": (F.col(f"`{c}`"), (0.5,)) for c in columns}
    return with_percentiles(df, medians).withColumns({c: F.coalesce(F.col(f"`{c}`"), F.get(f"`_m_{c}`", F.lit(0))) for c in columns}).drop(*medians)


def robust_scale(df: DataFrame, column: str, out: str, lower_better: bool = False, policy: str = "keep_null") -> DataFrame:
    """Scale between the 5th and 95th percentile to 0..1, clipped.

    keep_null: percentiles of the finite values, nulls stay null, a flat column gives 0.5.
    impute_median: nulls become the median first; all null stays null. impute_median_or_half: the
    same, but all null gives 0.5.
    """
    if policy not in POLICIES:
        raise ValueError(f"unknown policy {policy}")
    base = df.withColumn("_x", finite(F.col(column)))
    if policy != "keep_null":
        base = imputed(base, ["_x"])
    base = with_percentiles(base, {"_q": (F.col("_x"), (0.05, 0.95))}).withColumns({"_lo": F.get("_q", F.lit(0)), "_hi": F.get("_q", F.lit(1))}).drop("_q")
    ratio = clip((F.col("_x") - F.col("_lo")) / F.nullif(F.col("_hi") - F.col("_lo"), F.lit(0.0)))
    value = 1 - ratio if lower_better else ratio
    scaled = F.when(F.col("_x").isNull(), F.lit(None).cast("double")).when(F.col("_hi") == F.col("_lo"), F.lit(0.5)).otherwise(value)
    if policy == "impute_median_or_half":
        scaled = F.coalesce(scaled, F.lit(0.5))
    return base.withColumn(out, scaled).drop("_x", "_lo", "_hi")


def closeness(df: DataFrame, column: str, out: str, policy: str = "keep_null") -> DataFrame:
    """1 - |x| / p95(|x|), clipped.

    keep_null: null stays null, 1 where that percentile is zero. Otherwise nulls become the median
    first, and 0.5 stands where the percentile is zero; all null stays null.
    """
    base = df.withColumn("_x", F.abs(finite(F.col(column))))
    if policy != "keep_null":
        base = imputed(base, ["_x"])
    base = with_percentiles(base, {"_q": (F.col("_x"), (0.95,))}).withColumn("_hi", F.get("_q", F.lit(0))).drop("_q")
    return base.withColumn(out, _close(F.col("_x"), F.col("_hi"), policy)).drop("_x", "_hi")


def _close(x: Column, high: Column, policy: str) -> Column:
    flat = F.lit(1.0 if policy == "keep_null" else 0.5)
    return F.when(x.isNull(), F.lit(None).cast("double")).when(high == 0, flat).otherwise(clip(1 - x / F.nullif(high, F.lit(0.0))))


def scale_all(df: DataFrame, metrics: list[str], lower: list[str], centred: list[str], inferred: tuple[str, tuple[str, ...]], policy: str, prefix: str) -> DataFrame:
    """df with each metric scaled to 0..1 under prefix + metric, all statistics from one aggregate.

    Metrics in `lower` are better low, those in `centred` near zero. inferred: a reference and
    metrics that are better low if the first of them rises with it over at least five pairs. With a
    policy that imputes, medians come from one aggregate before. See robust_scale for the policies.
    """
    if not metrics:
        return df
    value = lambda m: F.abs(finite(F.col(f"`{m}`"))) if m in centred else finite(F.col(f"`{m}`"))
    rows = df.withColumns({f"_x_{i}": value(m) for i, m in enumerate(metrics)})
    if policy != "keep_null":
        rows = imputed(rows, [f"_x_{i}" for i in range(len(metrics))])
    statistics = []
    reference, follow = inferred
    follow = [m for m in follow if m in metrics]
    guess = bool(follow) and reference in df.columns and follow[0] == inferred[1][0]
    if guess:
        x, y = finite(F.col(f"`{follow[0]}`")), finite(F.col(f"`{reference}`"))
        x, y = F.when(y.isNotNull(), x), F.when(x.isNotNull(), y)
        rising = (F.count(x) >= 5) & (F.stddev_pop(x) > 0) & (F.stddev_pop(y) > 0) & (F.covar_pop(x, y) > 0)
        statistics.append(F.coalesce(rising, F.lit(False)).alias("_rising"))
    rows = with_percentiles(rows, {f"_q_{i}": (F.col(f"_x_{i}"), (0.05, 0.95)) for i in range(len(metrics))})
    rows = with_statistics(rows, *statistics) if statistics else rows
    out = {}
    for i, m in enumerate(metrics):
        x, low, high = F.col(f"_x_{i}"), F.get(f"_q_{i}", F.lit(0)), F.get(f"_q_{i}", F.lit(1))
        if m in centred:
            out[prefix + m] = _close(x, high, policy)
            continue
        ratio = clip((x - low) / F.nullif(high - low, F.lit(0.0)))
        down = F.col("_rising") if guess and m in follow else F.lit(m in lower)
        scaled = F.when(x.isNull(), F.lit(None).cast("double")).when(high == low, F.lit(0.5)).otherwise(F.when(down, 1 - ratio).otherwise(ratio))
        out[prefix + m] = F.coalesce(scaled, F.lit(0.5)) if policy == "impute_median_or_half" else scaled
    return rows.withColumns(out).drop("_rising", *[f"_{c}_{i}" for i in range(len(metrics)) for c in "xq"])


def lower_is_better(df: DataFrame, column: str, reference: str, least_pairs: int = 5) -> DataFrame:
    """One row: n, r, lower_better. True for r > 0 over at least least_pairs pairs; flat columns have no r."""
    x, y = finite(F.col(column)), finite(F.col(reference))
    both = df.select(x.alias("x"), y.alias("y")).where("x is not null and y is not null")
    spread = (F.stddev_pop("x") > 0) & (F.stddev_pop("y") > 0)
    r = F.when(spread, F.covar_pop("x", "y") / F.nullif(F.stddev_pop("x") * F.stddev_pop("y"), F.lit(0.0)))
    return both.agg(F.count("*").alias("n"), r.alias("r")).withColumn("lower_better", F.coalesce((F.col("n") >= least_pairs) & (F.col("r") > 0), F.lit(False)))


def weighted_mean(parts: Mapping[str, float]) -> Column:
    """Mean of the non-null columns by weight, renormalised per row; null if all are."""
    total = functools.reduce(lambda a, b: a + b, (F.coalesce(F.col(c) * w, F.lit(0.0)) for c, w in parts.items()))
    weight = functools.reduce(lambda a, b: a + b, (F.when(F.col(c).isNotNull(), F.lit(w)).otherwise(F.lit(0.0)) for c, w in parts.items()))
    return total / F.nullif(weight, F.lit(0.0))


def weighted_with_half(df: DataFrame, parts: Mapping[str, float], out: str) -> DataFrame:
    """Weighted mean over the columns that hold any value, nulls counting 0.5; 0.5 if none does."""
    base = with_statistics(df, *[(F.count(c) > 0).cast("double").alias("_has_" + c) for c in parts])
    total = functools.reduce(lambda a, b: a + b, (F.coalesce(F.col(c), F.lit(0.5)) * F.col("_has_" + c) * w for c, w in parts.items()))
    weight = functools.reduce(lambda a, b: a + b, (F.col("_has_" + c) * w for c, w in parts.items()))
    return base.withColumn(out, F.coalesce(total / F.nullif(weight, F.lit(0.0)), F.lit(0.5))).drop(*["_has_" + c for c in parts])


def gate(limits: Mapping[str, float]) -> Column:
    """1 if every value is null or within its limit, else 0."""
    return functools.reduce(lambda a, b: a * b, (F.when(F.col(c).isNull() | (F.col(c) <= v), F.lit(1.0)).otherwise(F.lit(0.0)) for c, v in limits.items()))


def band(c: Column, cuts: list[tuple[float, str]], below: str, unknown: str | None = None) -> Column:
    """The first band whose lower bound the value reaches; null gives `unknown`, or counts as zero."""
    value = c if unknown is not None else F.coalesce(c, F.lit(0.0))
    out = F.when(c.isNull(), F.lit(unknown)) if unknown is not None else F
    for least, name in sorted(cuts, reverse=True):
        out = out.when(value >= least, F.lit(name))
    return out.otherwise(F.lit(below))
