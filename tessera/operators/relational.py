"""Checked joins, per-column firsts, ranked picks, runs and merged ranges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.order import carried, merge_ranges, runs  # noqa: F401  they are relational operators as well


def join_all(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Inner join that fails, with count and five smallest examples, if left has keys right lacks."""
    missing = left.select(key).distinct().join(right, key, "left_anti")
    found = missing.count()
    if found:
        first = [str(r[0]) for r in missing.orderBy(key).limit(5).collect()]
        raise ValueError(f"{found} {key} values are missing, e.g. {', '.join(first)}")
    return left.join(right, key)


def missing_keys(left: DataFrame, right: DataFrame, key: str, other: str) -> DataFrame:
    """Keys of left without a partner in right."""
    return left.join(right.select(F.col(other).alias("_k")).distinct(), F.col(key) == F.col("_k"), "left_anti")


def outer_coalesce(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Full outer join on key; columns of both sides take the left value, else the right one."""
    shared = [c for c in left.columns if c in right.columns and c != key]
    renamed = right.withColumnsRenamed({c: f"_r_{c}" for c in shared})
    joined = left.join(renamed, key, "full_outer")
    return joined.withColumns({c: F.coalesce(F.col(c), F.col(f"_r_{c}")) for c in shared}).drop(*[f"_r_{c}" for c in shared])


def merged(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Two tables by their key; where one lacks it, the rows of both, with nulls for columns of the other."""
    if key in left.columns and key in right.columns:
        return outer_coalesce(left, right, key)
    return left.unionByName(right, allowMissingColumns=True)


def first_non_null(df: DataFrame, keys: list[str], order: list[Column], columns: list[str]) -> DataFrame:
    """Per group and column, the first non-null value in the given order."""
    rank = F.struct(*order)
    return df.groupBy(*keys).agg(*[F.min_by(c, F.when(F.col(c).isNotNull(), rank)).alias(c) for c in columns])


def top(df: DataFrame, keys: list[str], order: list[Column], k: int = 1, rank: str = "rank") -> DataFrame:
    """The first k rows of each group (null keys form a group)."""
    return df.withColumn(rank, F.row_number().over(W.partitionBy(*keys).orderBy(*order))).where(F.col(rank) <= k)


def filter_or_all(df: DataFrame, keys: list[str], condition: Column) -> DataFrame:
    """Rows that fulfil the condition; all rows of groups in which none does."""
    ok = F.coalesce(condition, F.lit(False))
    some = F.max(ok.cast("int")).over(W.partitionBy(*keys))
    return df.withColumns({"_ok": ok, "_some": some}).where("_ok or _some = 0").drop("_ok", "_some")


def moving_max(df: DataFrame, keys: list[str], order: list[str], value: str, width: int) -> DataFrame:
    """Per group the greatest mean of `width` successive values and its first position."""
    by = W.partitionBy(*keys).orderBy(*order)
    ahead = by.rowsBetween(0, width - 1)
    rows = df.select(*keys, F.row_number().over(by).alias("pos"), F.avg(value).over(ahead).alias("mean"), F.count("*").over(ahead).alias("n")).where(F.col("n") == width)
    return rows.groupBy(*keys).agg(F.max("mean").alias("best"), F.max_by("pos", F.struct("mean", -F.col("pos"))).cast("int").alias("start"))
