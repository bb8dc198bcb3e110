"""Poses: ranking, score-space clusters, cluster summaries, contacts, site geometry, log summaries."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import order, scaling
from . import geometry, relational, selection, summaries

# Names and weights of pose columns, residue names of water.
POSE_NAMES = {"receptor": "Receptor", "ligand": "Ligand", "prediction": "Prediction", "diffdock confidence": "DiffDock_Confidence", "diffdock_confidence": "DiffDock_Confidence", "smina minimized affinity": "SMINA_Minimized_Affinity", "smina_minimized_affinity": "SMINA_Minimized_Affinity", "smina minimized rmsd": "SMINA_Minimized_RMSD", "smina_minimized_rmsd": "SMINA_Minimized_RMSD", "smina affinity": "SMINA_Affinity", "smina_affinity": "SMINA_Affinity"}
POSE_WEIGHTS = {"affinity_scaled": 0.55, "rmsd_scaled": 0.25, "confidence_scaled": 0.20}
WATER = ("HOH", "WAT", "SOL", "TIP", "TIP3", "TIP3P")


def rank_poses(df: DataFrame, affinity: str, rmsd: str, confidence: str, out: str = "global_pose_score") -> DataFrame:
    """df with the three columns scaled over the whole table and their weighted sum.

    Low affinity and RMSD are better; so is low confidence if it rises with affinity over at least
    five poses. Filters belong after: the scales are those of all poses.
    """
    rows = scaling.scale_all(df, [affinity, rmsd], [affinity, rmsd], [], ("", ()), "impute_median_or_half", "_s_")
    rows = scaling.scale_all(rows, [confidence], [], [], (affinity, (confidence,)), "impute_median_or_half", "_s_")
    named = rows.withColumnsRenamed({"_s_" + affinity: "affinity_scaled", "_s_" + rmsd: "rmsd_scaled", "_s_" + confidence: "confidence_scaled"})
    total: Column = F.lit(0.0)
    for c, w in POSE_WEIGHTS.items():
        total = total + w * F.col(c)
    return named.withColumn(out, total)


def without_zero(df: DataFrame, column: str) -> DataFrame:
    """Rows whose value is not zero; null stays."""
    return df.where((F.col(column) != 0) | F.col(column).isNull())


def score_bins(df: DataFrame, keys: Sequence[str], axes: Sequence[tuple[str, float]], out: str = "ClusterID") -> DataFrame:
    """Per group, the number (from 1) of each row's bin in the space of the axes (column, least width).

    A bin is as wide as half the population deviation, or the least width; it counts from the
    minimum. Nulls are the group's median, 0 in a group without any value.
    """
    rows = df
    stats = []
    for i, (c, _) in enumerate(axes):
        rows = rows.withColumn(f"_x{i}", scaling.finite(F.col(c)))
        stats.append(F.coalesce(F.median(f"_x{i}"), F.lit(0.0)).alias(f"_m{i}"))
    medians = rows.groupBy(*keys).agg(*stats)
    rows = _back(rows, medians, keys).withColumns({f"_x{i}": F.coalesce(f"_x{i}", f"_m{i}") for i in range(len(axes))})
    spread = rows.groupBy(*keys).agg(*[f.alias(n) for i, (_, least) in enumerate(axes) for f, n in ((F.min(f"_x{i}"), f"_o{i}"), (F.greatest(F.lit(float(least)), F.stddev_pop(f"_x{i}") / 2), f"_w{i}"))])
    rows = _back(rows, spread, keys)
    rows = rows.withColumns({f"_b{i}": F.floor((F.col(f"_x{i}") - F.col(f"_o{i}")) / F.col(f"_w{i}")) for i in range(len(axes))})
    bins = [f"_b{i}" for i in range(len(axes))]
    # Only the bins are ordered, not their rows.
    numbers = rows.select(*keys, *bins).distinct().withColumn(out, F.row_number().over(W.partitionBy(*keys).orderBy(*bins)))
    extra = [f"_{p}{i}" for i in range(len(axes)) for p in "xmowb"]
    return _back(rows, numbers, [*keys, *bins]).drop(*extra)


def _back(rows: DataFrame, found: DataFrame, keys: Sequence[str]) -> DataFrame:
    """rows with found's columns, null keys equal."""
    named = found.withColumnsRenamed({k: f"_k_{i}" for i, k in enumerate(keys)})
    same = F.lit(True)
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"_k_{i}"))
    return rows.join(named, same).drop(*[f"_k_{i}" for i in range(len(keys))])


def cluster_summary(df: DataFrame, keys: Sequence[str], cluster: str, best: Sequence[Column], shown: Sequence[str], medians: Sequence[str]) -> DataFrame:
    """Per cluster: size, the shown columns of its best row, medians."""
    return df.groupBy(*keys, cluster).agg(
        F.count("*").alias("ClusterSize"), F.min_by(F.struct(*shown), F.struct(*best)).alias("_best"), *[F.median(scaling.finite(F.col(c))).alias("Median_" + c) for c in medians]
    ).select(*keys, cluster, "ClusterSize", *[F.col(f"_best.{c}").alias("Best_" + c) for c in shown], *["Median_" + c for c in medians])


def relabelled(df: DataFrame, keys: Sequence[str], cluster: str, score: str, tie: str) -> DataFrame:
    """df with clusters numbered from 1 by their least score, then their least tie value."""
    order = df.groupBy(*keys, cluster).agg(F.min(score).alias("_s"), F.min(tie).alias("_t"))
    ranked = order.withColumn("_new", F.row_number().over(W.partitionBy(*keys).orderBy("_s", "_t", cluster))).drop("_s", "_t")
    return _back(df, ranked, [*keys, cluster]).drop(cluster).withColumnRenamed("_new", cluster)


def log_summary(modes: DataFrame, key: str, share: float = 0.1) -> DataFrame:
    """Per ligand of a mode table (Mode, Affinity, RMSD_lb, RMSD_ub): first mode, best, means, trimmed means, number."""
    top = F.min_by(F.struct("Affinity", "RMSD_lb", "RMSD_ub"), F.struct("Mode", "Affinity", "RMSD_lb", "RMSD_ub"))
    plain = modes.groupBy(key).agg(top.alias("_t"), F.min("Affinity").alias("Best_Affinity"), F.avg("Affinity").alias("Mean_Affinity"), F.avg("RMSD_lb").alias("Mean_RMSD_lb"), F.count("*").alias("NumModes"))
    plain = plain.select(key, *[F.col("_t." + c).alias("Top1_" + c) for c in ("Affinity", "RMSD_lb", "RMSD_ub")], "Best_Affinity", "Mean_Affinity", "Mean_RMSD_lb", "NumModes")
    for c in ("Affinity", "RMSD_lb"):
        plain = plain.join(summaries.trimmed_mean(modes, [key], c, share).select(key, F.col("trimmed").alias("TrimmedMean_" + c)), key, "left")
    return plain


def contact_statistics(contacts: DataFrame, keys: Sequence[str], pose: str, residue: str, distance: str, high: float = 0.8) -> tuple[DataFrame, DataFrame]:
    """(frequency per residue, statistics per group) of pose contacts.

    frequency is the share of the group's poses with any contact that touch the residue. Statistics:
    poses, mean frequency, residues of at least `high`, entropy (natural logarithm) of the
    frequencies' shares.
    """
    touched = contacts.groupBy(*keys, residue).agg(F.countDistinct(pose).alias("ContactCount"), F.min(distance).alias("MinDistance"), F.avg(distance).alias("MeanDistance"))
    poses = contacts.groupBy(*keys).agg(F.countDistinct(pose).alias("PoseCount"))
    frequency = _back(touched, poses, keys).withColumn("Frequency", F.col("ContactCount") / F.col("PoseCount"))
    totals = frequency.groupBy(*keys).agg(F.sum("Frequency").alias("_total"))
    shares = _back(frequency, totals, keys).withColumn("_p", F.col("Frequency") / F.col("_total"))
    statistics = shares.groupBy(*keys).agg(F.max("PoseCount").alias("PoseCount"), F.avg("Frequency").alias("MeanFrequency"), F.count_if(F.col("Frequency") >= high).alias("HighFreqResidues"), (-F.sum(F.col("_p") * F.ln(F.col("_p") + 1e-9))).alias("Entropy"))
    return frequency, statistics


def frequent(frequency: DataFrame, least: float) -> DataFrame:
    """Residues touched by more than the share `least` of the poses."""
    return frequency.where(F.col("Frequency") > least)


def residue_contacts(protein: DataFrame, ligand: DataFrame, group: str, residue: str, cutoff: float) -> DataFrame:
    """(group, residue, MinDistance) of residues within the cutoff of a ligand atom; atoms: id, group, x, y, z (protein: residue)."""
    near = geometry.contacts(protein, ligand, cutoff, by=group)
    return near.join(protein.select(F.col("id").alias("left_id"), F.col(group).alias("_g"), residue), ["left_id"]).where(F.col(group) == F.col("_g")).groupBy(group, residue).agg(F.min("distance").alias("MinDistance"))


def is_water(residue_name: Column) -> Column:
    return F.upper(residue_name).isin(*WATER)


def ligand_residues(atoms: DataFrame, pose: str = "pose") -> DataFrame:
    """Atoms of each pose's ligand: the HETATM residue, water apart, with the most atoms that are no hydrogen.

    Of equals the one that comes first (by serial, chain, number) counts. Atoms: pose, record, chain, resid, resname, element, serial.
    """
    other = atoms.where((F.col("record") == "HETATM") & ~is_water(F.col("resname")))
    sizes = other.groupBy(pose, "chain", "resid", "resname").agg(F.count_if(F.col("element") != "H").alias("heavy"), F.min("serial").alias("first"))
    best = sizes.groupBy(F.col(pose).alias("_pose")).agg(F.min_by(F.struct("chain", "resid", "resname"), F.struct(-F.col("heavy"), "first", "chain", "resid")).alias("_r"))
    same = (F.col(pose) == F.col("_pose")) & F.col("chain").eqNullSafe(F.col("_r.chain")) & (F.col("resid") == F.col("_r.resid")) & (F.col("resname") == F.col("_r.resname"))
    return other.join(best, same).drop("_pose", "_r")


def named_atoms(atoms: DataFrame, resid: int, names: Sequence[str]) -> DataFrame:
    """Atoms of one residue number and of the names, whatever their case."""
    return atoms.where((F.col("resid") == resid) & F.upper("name").isin(*[n.upper() for n in names]))


def bonds(carbon: DataFrame, oxygen: DataFrame, group: str, low: float = 1.15, high: float = 1.35) -> DataFrame:
    """Pairs of a group whose distance lies in the band, ends included."""
    return geometry.contacts(carbon, oxygen, high, by=group).where(F.col("distance") >= low)


def triangular(value: Column, ideal: float, tolerance: float) -> Column:
    """1 at the ideal value, 0 from `tolerance` away on; 0 for null."""
    x = scaling.finite(value)
    return F.coalesce(F.greatest(F.lit(0.0), 1 - F.abs(x - ideal) / tolerance), F.lit(0.0))


def competence(ser: Column, angle: Column, oxyanion: Column, ser_his: Column, acid_his: Column) -> Column:
    """Catalytic competence of a pose, 0..1, from distances, the attack angle and the oxyanion contacts."""
    bent = F.when(scaling.finite(angle).between(90, 120), triangular(angle, 105.0, 75.0)).otherwise(F.lit(0.0))
    held = F.least(F.greatest(F.coalesce(oxyanion.cast("double"), F.lit(0.0)), F.lit(0.0)) / 2, F.lit(1.0))
    triad = 0.6 * triangular(ser_his, 3.0, 2.0) + 0.4 * triangular(acid_his, 2.8, 1.5)
    return 0.30 * triangular(ser, 3.0, 2.5) + 0.20 * bent + 0.30 * held + 0.20 * triad


def pose_state(ser: Column, angle: Column, oxyanion: Column, ser_his: Column, acid_his: Column, contact: float = 4.5) -> Column:
    """catalytically-competent, near-reactive, binding or distant; null distances fulfil nothing."""
    yes = lambda c: F.coalesce(c, F.lit(False))
    near = yes(scaling.finite(ser) <= 4.0)
    nac = near & yes(scaling.finite(angle).between(90, 120)) & yes(oxyanion >= 2) & yes(scaling.finite(ser_his) <= 3.5) & yes(scaling.finite(acid_his) <= 3.5)
    return F.when(nac, F.lit("catalytically-competent")).when(near & yes(scaling.finite(ser_his) <= 3.5), F.lit("near-reactive")).when(yes(scaling.finite(ser) <= contact), F.lit("binding")).otherwise(F.lit("distant"))


def best_candidate(df: DataFrame, pose: str, score: str, order: str) -> DataFrame:
    """Per pose the row of the greatest score, the first in order of equals."""
    rest = [c for c in df.columns if c != pose]
    return df.groupBy(pose).agg(F.min_by(F.struct(*rest), F.struct(-F.col(score), F.col(order))).alias("_x")).select(pose, "_x.*")


def matched_files(poses: DataFrame, files: DataFrame, prediction: str = "Prediction", path: str = "path") -> tuple[DataFrame, DataFrame]:
    """(poses with PosePath, dropped ones with Reason).

    A pose's file is, in this order: the path itself, its file name, either with .sdf, else any file
    of the same stem; the least path of several.
    """
    def base(c: Column) -> Column:
        return F.substring_index(c, "/", -1)

    stemmed = lambda c: F.regexp_replace(base(c), "(?<=.)\\.[^.]*$", "")
    p = F.col(prediction)
    wanted = [p, base(p), F.concat(p, F.lit(".sdf")), F.concat(stemmed(p), F.lit(".sdf")), stemmed(p)]
    asked = poses.select(p.alias("_p")).distinct().withColumnRenamed("_p", prediction)
    asked = asked.select(p.alias("_asked"), F.posexplode(F.array(*wanted)).alias("_rank", "_name"))
    # A path offered many times is one file, and a name needs only its least path.
    offered = files.select(F.col(path).alias("_path")).distinct().withColumnRenamed("_path", path)
    offered = offered.select(F.col(path).alias("_path"), F.explode(F.array_distinct(F.array(F.col(path), base(F.col(path)), stemmed(F.col(path))))).alias("_n")).groupBy("_n").agg(F.min("_path").alias("_path"))
    hit = asked.join(offered, F.col("_name") == F.col("_n")).groupBy("_asked").agg(F.min_by("_path", F.struct("_rank", "_path")).alias("PosePath"))
    joined = poses.join(hit, p == F.col("_asked"), "left").drop("_asked")
    return joined.where("PosePath is not null"), joined.where("PosePath is null").drop("PosePath").withColumn("Reason", F.lit("SDF_not_found"))


def work_grid(proteins: DataFrame, ligands: DataFrame, done: DataFrame, protein: str, ligand: str) -> DataFrame:
    """Every protein with every ligand, and why a pair is skipped (null: it is not).

    The grid is the result; whether a side is small enough to broadcast is left to the optimizer. done: protein, ligand, reason.
    """
    grid = proteins.select(protein).distinct().crossJoin(ligands.select(ligand).distinct())
    return grid.join(done.select(protein, ligand, "reason"), [protein, ligand], "left")


def held_oxyanions(nitrogens: DataFrame, oxygens: DataFrame, group: str, low: float = 2.5, high: float = 3.5) -> DataFrame:
    """(group, id, n_held): how many nitrogens of its group an oxygen has in the band, ends included; oxygens without any have 0."""
    near = geometry.contacts(nitrogens, oxygens, high, by=group).where(F.col("distance") >= low)
    counts = near.groupBy(group, F.col("right_id").alias("id")).agg(F.count("*").alias("n_held"))
    return oxygens.select(group, "id").join(counts, [group, "id"], "left").withColumn("n_held", F.coalesce("n_held", F.lit(0)))


def final_screen(vina: DataFrame, diffdock: DataFrame, catalytic: DataFrame, key: str, weights: Mapping[str, float], out: str) -> DataFrame:
    """All ligands of three tables, by two full outer joins, with the weighted score and its rank (the best first, ties by key)."""
    merged = relational.outer_coalesce(relational.outer_coalesce(vina, diffdock, key), catalytic, key)
    scored = selection.screen(merged, weights, out)
    return order.row_numbers(scored.withColumn("_down", -F.round(out, 9)), ["_down", key], "Rank").drop("_down")


def cluster_sizes(assigned: DataFrame, outer: str, inner: str) -> DataFrame:
    """(outer, inner, size) of nested clusters."""
    return assigned.groupBy(outer, inner).agg(F.count("*").alias("size"))


def combined_representatives(assigned: DataFrame, clusters: Sequence[str], rank: Sequence[str]) -> DataFrame:
    """The first row of each combination of clusters in the order of the columns (nulls last), with the size of its cluster."""
    best = [F.col(c).asc_nulls_last() for c in rank]
    sizes = assigned.groupBy(*clusters).agg(F.count("*").alias("size"))
    return _back(assigned.withColumn("_i", F.row_number().over(W.partitionBy(*clusters).orderBy(*best))).where("_i = 1").drop("_i"), sizes, clusters)


def from_template(template: str, values: Mapping[str, str | Column]) -> Column:
    """A path in which each {name} of the template is the value of that name."""
    out = F.lit(template)
    for name, value in values.items():
        out = F.replace(out, F.lit("{" + name + "}"), value if isinstance(value, Column) else F.col(value))
    return out
