"""Checks of keys, sets and poses: what must hold before a join or a write."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def one_to_one(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Inner join that fails if a side repeats a key or the sides' keys differ."""
    for side, name in ((left, "left"), (right, "right")):
        twice = side.groupBy(key).agg(F.count("*").alias("n")).where("n > 1").orderBy(key).limit(5).collect()
        if twice:
            raise ValueError(f"the {name} side repeats {key}: {', '.join(str(r[0]) for r in twice)}")
    same_keys(left, right, key)
    return left.join(right, key)


def same_keys(left: DataFrame, right: DataFrame, key: str) -> None:
    """Fails, with up to five examples, if one side has keys that the other lacks; one pass over both."""
    both = left.select(key, F.lit(1).alias("s")).unionByName(right.select(key, F.lit(2).alias("s")))
    odd = both.groupBy(key).agg(F.min("s").alias("least"), F.max("s").alias("most")).where("least = most").orderBy(key).limit(5).collect()
    if odd:
        raise ValueError(f"keys on one side only: {', '.join(str(r[0]) for r in odd)}")


def permutes(values: Column, n: Column) -> Column:
    """Whether an array holds each of 1..n once."""
    return F.coalesce(F.array_sort(values) == F.when(n >= 1, F.sequence(F.lit(1), F.greatest(n, F.lit(1)))).otherwise(F.array().cast("array<int>")), F.lit(False))


def pairs(values: Column) -> Column:
    """Consecutive pairs of a flat array; an odd length raises."""
    n = F.size(values)
    found = F.when(n == 0, F.array().cast("array<struct<first:int,second:int>>")).otherwise(
        F.transform(F.sequence(F.lit(0), F.greatest(n - 2, F.lit(0)), F.lit(2)), lambda i: F.struct(F.get(values, i).cast("int").alias("first"), F.get(values, i + 1).cast("int").alias("second")))
    )
    return F.when(n % 2 == 0, found).otherwise(F.raise_error(F.lit("an odd number of values")))


def all_equal(df: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Per group: whether each of the columns has one value throughout (null is a value)."""
    return df.groupBy(*keys).agg(*[(F.countDistinct(F.coalesce(F.to_json(F.struct(c)), F.lit(""))) == 1).alias(c) for c in columns])


def unique_atoms(atoms: DataFrame, pose: str, names: Sequence[str]) -> DataFrame:
    """(pose, coordinates) in the order of the names; a pose that lacks or repeats one raises."""
    wanted = F.array(*[F.lit(n.upper()) for n in names])
    kept = atoms.withColumn("_n", F.upper(F.trim("name"))).where(F.col("_n").isin(*[n.upper() for n in names]))
    grouped = kept.groupBy(pose).agg(F.collect_list(F.struct(F.array_position(wanted, F.col("_n")).alias("at"), "x", "y", "z")).alias("a"))
    right = (F.size("a") == len(names)) & (F.size(F.array_distinct(F.transform("a", lambda x: x["at"]))) == len(names))
    fault = F.raise_error(F.concat(F.lit("missing or repeated atoms in pose "), F.col(pose).cast("string")))
    return grouped.select(pose, F.when(right, F.transform(F.array_sort("a"), lambda x: F.struct(x["x"], x["y"], x["z"]))).otherwise(fault).alias("coordinates"))


def heavy_atoms(atoms: DataFrame, pose: str) -> DataFrame:
    """(pose, coordinates, n) of atoms that are no hydrogen, by serial; poses of different numbers raise."""
    found = atoms.where(F.col("element") != "H").groupBy(pose).agg(F.array_sort(F.collect_list(F.struct("serial", "x", "y", "z"))).alias("a"))
    found = found.select(pose, F.transform("a", lambda x: F.struct(x["x"], x["y"], x["z"])).alias("coordinates"), F.size("a").alias("n"))
    ends = found.agg(F.min("n").alias("least"), F.max("n").alias("most")).first()
    if ends["least"] != ends["most"]:
        raise ValueError(f"poses have {ends['least']} to {ends['most']} heavy atoms")
    return found


def valid_files(files: DataFrame, text: str, least_bytes: int = 200) -> DataFrame:
    """Files of at least so many bytes that hold an atom line."""
    return files.where((F.octet_length(text) >= least_bytes) & F.col(text).rlike("(?m)^(ATOM|HETATM)"))


def inputs_exist(spark, paths: Sequence[str]) -> None:
    """Fails, naming them, if any of the paths is missing."""
    fs, conf = spark._jvm.org.apache.hadoop.fs, spark._jsc.hadoopConfiguration()
    missing = [p for p in paths if not (path := fs.Path(p)).getFileSystem(conf).exists(path)]
    if missing:
        raise FileNotFoundError(", ".join(missing))


def skipped_small(df: DataFrame, key: str, least: int = 3) -> DataFrame:
    """(key, n, status) per group: ok, or skipped because it has fewer than `least` rows."""
    counts = df.groupBy(key).agg(F.count("*").alias("n"))
    return counts.withColumn("status", F.when(F.col("n") < least, F.lit(f"skipped_less_than_{least}_sequences")).otherwise(F.lit("ok")))


def none_empty(df: DataFrame, key: str, expected: Sequence[str]) -> DataFrame:
    """df, after failing if an expected key has no row."""
    seen = {r[0] for r in df.select(key).where(F.col(key).isin(*expected)).distinct().collect()}
    gone = [k for k in expected if k not in seen]
    if gone:
        raise ValueError(f"no rows for {', '.join(map(str, gone))}")
    return df
