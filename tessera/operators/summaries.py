"""Distribution statistics, position slices, trimmed means, column profiles and pivots."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.scaling import finite


def distribution(c: str) -> list[Column]:
    """n, mean, sd (sample, 0 for one value), sem, median, quartiles, min and max."""
    sd = F.coalesce(F.stddev_samp(c), F.when(F.count(c) > 0, F.lit(0.0)))
    return [
        F.count(c).alias("n"), F.avg(c).alias("mean"), sd.alias("sd"), (sd / F.sqrt(F.nullif(F.count(c), F.lit(0)))).alias("sem"), F.median(c).alias("median"),
        F.percentile(c, F.lit(0.25)).alias("q1"), F.percentile(c, F.lit(0.75)).alias("q3"), F.min(c).alias("least"), F.max(c).alias("most"),
    ]


def series(df: DataFrame, keys: list[str], order: list[str], value: str) -> DataFrame:
    """Per group: statistics with population deviation, and means of the first and last fifth.

    A fifth has at least three rows; groups of fewer than five rows have no fifths.
    """
    by = W.partitionBy(*keys)
    rows = df.withColumns({"_i": F.row_number().over(by.orderBy(*order)), "_n": F.count("*").over(by)})
    rows = rows.withColumn("_k", F.greatest(F.lit(3), F.floor(F.col("_n") * 0.2)))
    first, last = (F.avg(F.when((F.col("_n") >= 5) & c, F.col(value))) for c in (F.col("_i") <= F.col("_k"), F.col("_i") > F.col("_n") - F.col("_k")))
    return rows.groupBy(*keys).agg(
        F.avg(value).alias("mean"), F.median(value).alias("median"), F.stddev_pop(value).alias("std"), F.min(value).alias("least"), F.max(value).alias("most"),
        F.percentile(value, F.lit(0.1)).alias("q10"), F.percentile(value, F.lit(0.9)).alias("q90"), first.alias("first_mean"), last.alias("last_mean"), (last - first).alias("drift"),
    )


def slices(df: DataFrame, keys: list[str], order: list[str], value: str) -> DataFrame:
    """Per group: rows, and population deviations of the first and last fifth (at least three rows; none below five rows)."""
    by = W.partitionBy(*keys)
    rows = df.withColumns({"_i": F.row_number().over(by.orderBy(*order)), "_n": F.count("*").over(by)})
    rows = rows.withColumn("_k", F.greatest(F.lit(3), F.floor(F.col("_n") * 0.2)))
    part = lambda c: F.stddev_pop(F.when((F.col("_n") >= 5) & c, F.col(value)))
    return rows.groupBy(*keys).agg(F.count("*").alias("n"), part(F.col("_i") <= F.col("_k")).alias("first_std"), part(F.col("_i") > F.col("_n") - F.col("_k")).alias("last_std"))


def trimmed_mean(df: DataFrame, keys: list[str], value: str, share: float = 0.1) -> DataFrame:
    """Mean without the floor(n * share) least and greatest values of each group, and n.

    Rows are counted per distinct value first; only values are ordered, and each weighs what of it
    lies between the cuts. What is no finite number is left out.
    """
    x = finite(F.col(value))
    counts = df.where(x.isNotNull()).groupBy(*keys, x.alias("_v")).agg(F.count("*").alias("_k"))
    by = W.partitionBy(*keys)
    rows = counts.withColumns({"_n": F.sum("_k").over(by), "_end": F.sum("_k").over(by.orderBy("_v"))})
    cut = F.floor(F.col("_n") * share)
    inside = F.greatest(F.least("_end", F.col("_n") - cut) - F.greatest(F.col("_end") - F.col("_k"), cut), F.lit(0))
    return rows.groupBy(*keys).agg((F.sum(F.col("_v") * inside) / F.sum(inside)).alias("trimmed"), F.max("_n").alias("n"))


def column_profile(df: DataFrame, text: str) -> DataFrame:
    """Per position of aligned strings: rows, greatest share of one character, entropy in bits."""
    chars = df.select(F.posexplode(F.split(text, "")).alias("pos", "c")).where("c <> ''")
    counts = chars.groupBy("pos", "c").agg(F.count("*").alias("k"))
    total = counts.groupBy("pos").agg(F.sum("k").alias("n"), F.max("k").alias("most"), F.sum(F.col("k") * F.log2("k")).alias("s"))
    return total.select((F.col("pos") + 1).alias("pos"), "n", (F.col("most") / F.col("n")).alias("frequency"), (F.log2("n") - F.col("s") / F.col("n")).alias("entropy"))


def column_counts(df: DataFrame, text: str, letters: str, gaps: str = "-.") -> DataFrame:
    """Per position of aligned strings: rows, gaps, and the number of each letter (whatever its case)."""
    chars = df.select(F.posexplode(F.split(text, "")).alias("pos", "c")).where("c <> ''").withColumn("c", F.upper("c"))
    return chars.groupBy((F.col("pos") + 1).alias("pos")).agg(F.count("*").alias("n"), F.count_if(F.col("c").isin(*gaps)).alias("gaps"), *[F.count_if(F.col("c") == x).alias(x) for x in letters])


def pivot(df: DataFrame, rows: str, columns: str, values: Sequence[str], value: str) -> DataFrame:
    """Mean of value by row and the stated column values."""
    return df.groupBy(rows).pivot(columns, list(values)).agg(F.avg(value))


def occupancy(condition: Column) -> Column:
    """Per cent of rows that fulfil the condition; null counts as not."""
    return 100 * F.avg(F.coalesce(condition, F.lit(False)).cast("double"))
