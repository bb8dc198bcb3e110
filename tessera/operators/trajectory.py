"""Trajectory tables: wide to long, frame criteria, contact summaries, frame contacts, matrices."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scaling, tables
from . import geometry, summaries

# Columns that are no measurement.
INDEX = ("Frame", "Time (ps)", "Time_ps", "Time_ns", "Residue#", "Residue_Number", "Residue_Name", "Residue_ID", "Atom", "Index")


def with_time(df: DataFrame) -> DataFrame:
    """df with Time_ns: as it is, a thousandth of a picosecond column, else the frame number."""
    if "Time_ns" in df.columns:
        return df
    for c, unit in (("Time (ps)", 1000.0), ("Time_ps", 1000.0), ("Frame", 1.0)):
        if c in df.columns:
            return df.withColumn("Time_ns", scaling.finite(F.col(f"`{c}`")) / unit)
    return df


def long(df: DataFrame, keep: Sequence[str], name: str = "System", value: str = "Value") -> DataFrame:
    """One row per measurement column: keep, its name, its value as a double."""
    measured = tables.value_columns(df, INDEX)
    rows = df.select(*keep, *[scaling.finite(F.col(f"`{c}`")).alias(c) for c in measured if c not in keep])
    return rows.unpivot([F.col(c) for c in keep], [F.col(f"`{c}`") for c in measured if c not in keep], name, value)


def summary(df: DataFrame, keys: Sequence[str], value: str, time: str, start: float) -> DataFrame:
    """Distribution of the values from `start` on; rows without time or value take no part."""
    late = df.where((scaling.finite(F.col(time)) >= start) & F.col(value).isNotNull())
    return late.groupBy(*keys).agg(*summaries.distribution(value))


def frame_criteria(df: DataFrame, distances: Sequence[str], bond: float, attack: float, oxyanion: float) -> DataFrame:
    """df with one flag per distance and the joint flags of a catalytic frame.

    A distance's kind and limit follow from its name: ser with his, and his with glu or acid, are
    bonds; carbonyl, c26 or attack the attack; gly, oxyanion or o2 the oxyanion hole; others count
    as bonds. A kind that no column has is fulfilled for the triad, not for the others; null is not.
    """
    bare = lambda c: c.lower()
    ser = lambda c: "ser" in bare(c) and "his" in bare(c)
    acid = lambda c: "his" in bare(c) and ("glu" in bare(c) or "acid" in bare(c))
    strike = lambda c: any(x in bare(c) for x in ("carbonyl", "c26", "attack"))
    hole = lambda c: any(x in bare(c) for x in ("gly", "oxyanion", "o2"))

    def limit(c: str) -> float:
        if ser(c) or acid(c):
            return bond
        return attack if strike(c) else oxyanion if hole(c) else bond

    there = [c for c in distances if c in df.columns]
    flags = {c: F.coalesce(scaling.finite(F.col(f"`{c}`")) <= limit(c), F.lit(False)) for c in there}
    any_of = lambda cs, none: _fold(cs, lambda a, b: a | b, none)
    both = lambda kind: [flags[c] for c in there if kind(c)]
    triad = any_of(both(ser), True) & any_of(both(acid), True)
    struck, held = any_of(both(strike), False), any_of(both(hole), False)
    full = _fold(both(hole), lambda a, b: a & b, False) if len(both(hole)) >= 2 else held
    score = sum((f.cast("int") for f in flags.values()), F.lit(0))
    return df.withColumns(
        {f"{c}_ok": f for c, f in flags.items()}
        | {"Triad_contact_ok": triad, "Attack_distance_ok": struck, "Oxyanion_any_ok": held, "Oxyanion_both_ok": full, "Partial_catalytic_ok": triad & struck & held, "Fully_productive_ok": triad & struck & full, "Catalytic_score_0_to_5": score, "Catalytic_score_fraction": score / max(len(there), 1)}
    )


def _fold(columns: Sequence[Column], f, none: bool) -> Column:
    out = None
    for c in columns:
        out = c if out is None else f(out, c)
    return F.lit(none) if out is None else out


def criteria_summary(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Per group: frames, mean score and the per cent of frames that fulfil each flag (rows with null keys left out)."""
    flags = [c for c in df.columns if c.endswith("_ok")]
    rows = df
    for k in keys:
        rows = rows.where(F.col(k).isNotNull())
    return rows.groupBy(*keys).agg(F.count("*").alias("N_frames"), F.avg("Catalytic_score_0_to_5").alias("Mean_catalytic_score_0_to_5"), F.avg("Catalytic_score_fraction").alias("Mean_catalytic_score_fraction"), *[summaries.occupancy(F.col(c)).alias(c + "_percent") for c in flags])


def distance_summary(df: DataFrame, keys: Sequence[str], distances: Sequence[str]) -> DataFrame:
    """Distribution of every distance per group; distances without a value give no row."""
    rows = df.select(*keys, *[scaling.finite(F.col(f"`{c}`")).alias(c) for c in distances]).unpivot([F.col(k) for k in keys], [F.col(f"`{c}`") for c in distances], "Distance", "_v")
    return rows.where("_v is not null").groupBy(*keys, "Distance").agg(*summaries.distribution("_v"))


def with_contact_columns(df: DataFrame) -> DataFrame:
    """Contacts with Residue_ID, Distance_Range and Distance_Midpoint; rows without residue or occupancy go."""
    rows = df.withColumns({c: scaling.finite(F.col(c)) for c in ("Occupancy_Percent", "Minimum_Distance", "Maximum_Distance")}).withColumn("Residue_Number", F.expr("try_cast(Residue_Number as bigint)"))
    rows = rows.withColumns({"Residue_ID": F.concat(F.col("Residue_Name"), F.col("Residue_Number").cast("string")), "Distance_Range": F.col("Maximum_Distance") - F.col("Minimum_Distance"), "Distance_Midpoint": (F.col("Maximum_Distance") + F.col("Minimum_Distance")) / 2})
    return rows.dropna(subset=["Residue_Number", "Occupancy_Percent"])


def contact_summary(df: DataFrame) -> DataFrame:
    """Per residue: systems, mean and greatest occupancy, least and greatest distance."""
    return df.groupBy("Residue_ID", "Residue_Name", "Residue_Number").agg(
        F.countDistinct("System").alias("Systems_present"), F.avg("Occupancy_Percent").alias("Mean_occupancy_percent"), F.max("Occupancy_Percent").alias("Max_occupancy_percent"), F.min("Minimum_Distance").alias("Min_distance"), F.max("Maximum_Distance").alias("Max_distance")
    )


def matrix(df: DataFrame, rows: str, columns: str, values: Sequence[str], value: str, how: str = "max", fill: float | None = None) -> DataFrame:
    """rows by the stated column values: the greatest, first or mean value; missing cells null or `fill`. Null rows go."""
    f = {"max": F.max, "first": lambda c: F.first(c, ignorenulls=True), "mean": F.avg}[how]
    out = df.where(F.col(rows).isNotNull()).groupBy(rows).pivot(columns, list(values)).agg(f(value))
    return out if fill is None else out.fillna(fill, subset=[c for c in out.columns if c != rows])


def frame_contacts(protein: DataFrame, ligand: DataFrame, cutoff: float, reach: float, stride: int = 1) -> DataFrame:
    """Occupancy of each residue over every stride-th frame, with its least and greatest distance within `reach`.

    protein: frame, id, residue, x, y, z; ligand: frame, id, x, y, z. Frames are the key of the join, so no frame is a task of its own.
    """
    kept = lambda df: df.where(F.col("frame") % stride == 0)
    p, l = kept(protein), kept(ligand)
    frames = p.agg(F.countDistinct("frame").alias("Frames_Analyzed"))
    near = geometry.contacts(p, l, reach, by="frame")
    named = near.join(p.select("frame", F.col("id").alias("left_id"), "residue"), ["frame", "left_id"]).groupBy("frame", "residue").agg(F.min("distance").alias("d"))
    found = named.groupBy("residue").agg(F.count_if(F.col("d") <= cutoff).alias("n"), F.min("d").alias("Minimum_Distance_A"), F.max("d").alias("Maximum_Distance_A")).where("n > 0")
    occupied = found.crossJoin(F.broadcast(frames))
    return occupied.select("residue", F.round(100 * F.col("n") / F.col("Frames_Analyzed"), 2).alias("Occupancy_Percent"), F.round("Minimum_Distance_A", 3).alias("Minimum_Distance_A"), F.round("Maximum_Distance_A", 3).alias("Maximum_Distance_A"), "Frames_Analyzed")


def comparative(summary_: DataFrame, keys: Sequence[str], metrics: Sequence[str], extra: DataFrame, on: str) -> DataFrame:
    """Means by metric as columns, with the columns of `extra` (a row per `on`) to the left rows."""
    wide = summary_.groupBy(*keys).pivot("Metric", list(metrics)).agg(F.first("mean", ignorenulls=True))
    return wide.join(extra, on, "left")


def parameters(spark, values: Mapping[str, tuple[str, str]]) -> DataFrame:
    """The run's parameters as a table: Parameter, Value, Meaning."""
    return spark.createDataFrame([(k, str(v), m) for k, (v, m) in values.items()], "Parameter string, Value string, Meaning string")
