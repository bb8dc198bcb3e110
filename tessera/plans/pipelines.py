"""Whole runs: from the files of a study to its tables, each as one lazy plan per table."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import order, scaling, sequences, tables
from ..operators import checks, docking, relational, selection, trajectory
from ..operators.motifs import scan
from ..sources import structures, text_tables


def candidates(spark: SparkSession, sheet: str, families: str, cutoff: float = 1e-5) -> dict[str, DataFrame]:
    """Candidate proteins of every sample: `candidates` (species, family, protein_id) and `counts`.

    Hits up to the cutoff meet the family map; each protein must be among its sample's sequences. A
    sample without sequences or without candidates fails the run.
    """
    listed = text_tables.samples(spark, sheet).collect()
    checks.inputs_exist(spark, [p for r in listed for p in (r["fasta"], r["domtblout"]) if p])
    hadoop = spark._jvm.org.apache.hadoop.fs.Path

    def full(path: str) -> str:
        """The path with its file system, but for local ones, as files are named when they are read."""
        system = hadoop(path).getFileSystem(spark._jsc.hadoopConfiguration())
        return re.sub("^file:/+", "/", system.makeQualified(hadoop(path)).toString())

    def of(column: str) -> DataFrame:
        """Whole files with their species, by their full path."""
        paths = [r[column] for r in listed if r[column]]
        given = spark.createDataFrame([(r["species"], full(r[column])) for r in listed if r[column]], "species string, _p string")
        return text_tables.files(spark, *paths).join(given, F.regexp_replace("path", "^file:/+", "/") == F.col("_p"))

    records, found = of("fasta"), of("domtblout")
    known = text_tables.fasta(records.select(F.col("species").alias("path"), "value"), strict=True).select(F.col("path").alias("species"), F.col("seq_id").alias("protein_id")).distinct()
    hits = text_tables.domain_hits(text_tables.lines(found.select(F.col("species").alias("path"), "value")), keep="path").where(F.col("evalue") <= cutoff)
    named = hits.join(F.broadcast(text_tables.families(spark, families)), "accession").select(F.col("path").alias("species"), "family", "protein_id").distinct()
    key = F.concat_ws("|", "species", "protein_id").alias("_key")
    checked = relational.join_all(named.withColumn("_key", key), known.select(key).distinct(), "_key").drop("_key")
    checks.none_empty(checked, "species", [r["species"] for r in listed])
    return {"candidates": checked, "counts": checked.groupBy("species", "family").agg(F.countDistinct("protein_id").alias("candidate_count"))}


def annotation(records: DataFrame, motifs: Sequence[tuple[str, str]], signals: DataFrame, membranes: DataFrame, width: int = 19, threshold: float = 1.6) -> dict[str, DataFrame]:
    """`hits` of every motif, `features` of every sequence (seq_id, family, sequence) and a `summary` by family.

    signals: (id, found, cut); membranes: (id, ranges); evidence goes before what the sequence itself tells.
    """
    library = records.sparkSession.createDataFrame([(n, p, False) for n, p in motifs], "motif string, pattern string, literal boolean")
    found = scan(records, library, "seq_id", "sequence")
    s, m = signals.select(F.col("id").alias("_s"), F.struct("found", "cut").alias("_signal")), membranes.select(F.col("id").alias("_m"), F.col("ranges").alias("_ranges"))
    rows = records.join(s, F.col("seq_id") == F.col("_s"), "left").join(m, F.col("seq_id") == F.col("_m"), "left")
    sequence = F.col("sequence")
    own = sequences.signal(sequence)
    signal = sequences.preferred(("given", F.col("_signal").isNotNull(), F.col("_signal")), ("heuristic", F.lit(True), own))
    passes = sequences.preferred(("given", F.col("_ranges").isNotNull(), F.col("_ranges")), ("hydropathy", F.lit(True), sequences.segments(sequence, width, threshold)))
    counts = found.groupBy("seq_id").agg(F.count("*").alias("hits"), F.array_join(F.array_sort(F.collect_set("motif")), ";").alias("motifs")).withColumnRenamed("seq_id", "_h")
    features = rows.select("seq_id", "family", F.length("sequence").alias("length"), signal.alias("signal"), passes.alias("passes"), sequences.tail_anchor(sequence, 50, 18, 25, 0.7).alias("anchor"))
    features = features.select("seq_id", "family", "length", F.col("signal.value.found").alias("signal"), F.col("signal.source").alias("signal_source"), F.size("passes.value").alias("passes"), sequences.rendered(F.col("passes.value")).alias("ranges"), F.col("anchor.found").alias("anchored"))
    features = features.join(counts, F.col("seq_id") == F.col("_h"), "left").drop("_h").withColumns({"hits": F.coalesce("hits", F.lit(0)), "motifs": F.coalesce("motifs", F.lit(""))})
    summary = features.groupBy("family").agg(F.count("*").alias("n"), F.round(F.avg("length"), 2).alias("mean_length"), F.sum(F.col("signal").cast("int")).alias("signals"), F.count_if(F.col("passes") > 0).alias("membrane"), F.sum("hits").alias("hits"))
    return {"hits": found, "features": features, "summary": summary, "families": checks.skipped_small(records, "family")}


# Weights of the parts of a model's quality, and its bands.
QUALITY = {"structure": 0.35, "motif": 0.25, "json_plddt": 0.20, "iptm": 0.15, "ptm": 0.10, "ranking": 0.10, "pae": 0.10}
BANDS = [(90.0, "very_high"), (70.0, "confident"), (50.0, "low")]
LOWEST, NO_VALUE = "very_low", "not_available"


def quality(models: DataFrame) -> DataFrame:
    """models with the integrated score, 0 to 100: parts clamped to their range, weights renormalised over those there are.

    Columns: structure, motif, json_plddt (counts where there is no motif), iptm, ptm, ranking (0 to 1.5 read as
    a share), pae (30 and more count nothing).
    """
    clamp = lambda c, most: F.when(c.isNotNull(), F.least(F.greatest(c, F.lit(0.0)), F.lit(most)))
    ranking = F.when(F.col("ranking") <= 1.5, F.col("ranking") * 100).otherwise(F.col("ranking"))
    parts = {
        "structure": clamp(F.col("structure"), 100.0), "motif": clamp(F.col("motif"), 100.0), "json_plddt": F.when(F.col("motif").isNull(), clamp(F.col("json_plddt"), 100.0)),
        "iptm": clamp(F.col("iptm"), 1.0) * 100, "ptm": clamp(F.col("ptm"), 1.0) * 100, "ranking": clamp(ranking, 100.0), "pae": clamp(100.0 - F.col("pae") / 30.0 * 100.0, 100.0),
    }
    rows = models.withColumns({"_p_" + k: c for k, c in parts.items()})
    return rows.withColumn("integrated_quality_score_0_100", scaling.weighted_mean({"_p_" + k: w for k, w in QUALITY.items()})).drop(*["_p_" + k for k in parts])


def motif_values(atoms: DataFrame, residues: DataFrame, chains: DataFrame, motifs: Sequence[str], literal: bool = True) -> DataFrame:
    """Per hit of a motif in a chain: start, end, residue labels, and statistics of the values of its atoms."""
    session = atoms.sparkSession
    library = session.createDataFrame([(m, m, literal) for m in motifs], "motif string, pattern string, literal boolean")
    named = chains.select(F.to_json(F.struct("model", "chain")).alias("key"), "model", "chain", "sequence")
    hits = scan(named, library, "key", "sequence").join(named.drop("sequence"), "key").drop("key")
    place = W.partitionBy("model", "chain").orderBy("order", "resname")
    placed = residues.select("model", "chain", "resid", "resname", "residue_name_1", F.row_number().over(place).alias("position"))
    inside = hits.select("model", "chain", "motif", "start", "end", "hit", F.explode(F.sequence("start", "end")).alias("position")).join(placed, ["model", "chain", "position"])
    each = inside.join(atoms, ["model", "chain", "resid", "resname"])
    label = F.struct("position", F.concat("residue_name_1", "resid").alias("label"))
    found = each.groupBy("model", "chain", "motif", "start", "end", "hit").agg(
        F.array_join(F.transform(F.array_sort(F.collect_set(label)), lambda x: x["label"]), ";").alias("residue_labels"), F.count("*").alias("atom_count"),
        F.avg("value").alias("mean_plddt"), F.median("value").alias("median_plddt"), F.min("value").alias("min_plddt"), F.max("value").alias("max_plddt"),
    )
    return found.withColumn("quality_band", scaling.band(F.col("mean_plddt"), BANDS, LOWEST, NO_VALUE))


def evaluation(spark: SparkSession, path: str, motifs: Sequence[str] = ()) -> dict[str, DataFrame]:
    """The tables of the structure files, confidence JSON and array archives below path, by model.

    `residues`, `chains`, `motifs` (hits with their values), `confidences`, `pairs` (matrices over chains), `arrays`,
    and `models`: files of each kind, means, bands and the integrated score, scored models first, best first.
    """
    model = tables.group_stem(F.col("path")).alias("model")
    files = structures.files(spark, [path], [e for ends in structures.KINDS.values() for e in ends])
    grouped = structures.grouped_files(files, tables.group_stem(F.col("path"))).withColumnRenamed("key", "model")
    told = structures.texts(spark, path, "*.json").select(model, "text")
    atoms = structures.loop_atoms(structures.texts(spark, path, "*.cif").select(model, "text"), "model", "text")
    residues = structures.residues(atoms, "model")
    chains = structures.chains(residues, "model")
    hits = motif_values(atoms, residues, chains, motifs)
    confidences = structures.value_statistics(structures.json_values(told, "model", "text"), ["model", "metric"])
    held = structures.arrays(spark, path).select(model, "path", "name", "values", "status")
    arrays = structures.value_statistics(held, ["model", "path", "name", "status"]).withColumn("metric_guess", tables.first_rule(F.col("name"), tables.METRIC_RULES, "unknown"))
    means = {"plddt": "json_plddt", "pae": "pae", "iptm": "iptm", "ptm": "ptm", "ranking_score": "ranking"}
    by_model = confidences.groupBy("model").pivot("metric", list(means)).agg(F.avg("mean")).withColumnsRenamed(means)
    structure = chains.groupBy("model").agg(F.avg("mean_plddt").alias("structure"))
    motif = hits.groupBy("model").agg(F.avg("mean_plddt").alias("motif"))
    joined = grouped.join(structure, "model", "left").join(motif, "model", "left").join(by_model, "model", "left")
    bands = {c + "_band": scaling.band(F.col(c), BANDS, LOWEST, NO_VALUE) for c in ("structure", "motif")}
    models = quality(joined).withColumns(bands).withColumn("mean_plddt", F.col("structure"))
    ordered = order.row_numbers(models.withColumn("_down", -F.col("integrated_quality_score_0_100")).withColumn("_none", F.col("_down").isNull()), ["_none", "_down", "model"], "place").drop("_down", "_none")
    return {"residues": residues, "chains": chains, "motifs": hits, "confidences": confidences, "pairs": structures.chain_pairs(told, "model", "text"), "arrays": arrays, "models": ordered}


def choice(metrics: DataFrame, key: str, groups: dict[str, str], engine: str = "auto", first: int = 10) -> dict[str, DataFrame]:
    """`scored` models, their `representatives` and the `decisions`, by the engine that the columns ask for."""
    scored = selection.scores(metrics, selection.engine_for(metrics, engine), [key])
    there = {c: n for c, n in groups.items() if c in metrics.columns}
    return {"scored": scored, "representatives": selection.representatives(scored, key, "SelectionScore", there, first), "decisions": selection.decision_counts(scored)}


def docking_run(poses: DataFrame, first: int = 10) -> dict[str, DataFrame]:
    """`members` in score-space clusters, `clusters` and the `top` poses per receptor and ligand."""
    keys = ["Receptor", "Ligand"]
    plain = tables.conformed(poses, docking.POSE_NAMES, [*keys, "Prediction"], ["DiffDock_Confidence", "SMINA_Minimized_Affinity", "SMINA_Minimized_RMSD"])
    ranked = docking.rank_poses(plain, "SMINA_Minimized_Affinity", "SMINA_Minimized_RMSD", "DiffDock_Confidence")
    members = docking.score_bins(ranked, keys, [("SMINA_Minimized_Affinity", 0.25), ("SMINA_Minimized_RMSD", 0.5)])
    best_first = [F.desc("global_pose_score"), F.asc_nulls_last("SMINA_Minimized_Affinity"), F.asc_nulls_last("SMINA_Minimized_RMSD"), F.col("Prediction")]
    best = [-F.col("global_pose_score"), F.coalesce("SMINA_Minimized_Affinity", F.lit(float("inf"))), F.coalesce("SMINA_Minimized_RMSD", F.lit(float("inf"))), F.col("Prediction")]
    clusters = docking.cluster_summary(members, keys, "ClusterID", best, ["Prediction", "global_pose_score"], ["SMINA_Minimized_Affinity", "SMINA_Minimized_RMSD"])
    return {"members": members, "clusters": clusters, "top": relational.top(members, keys, best_first, first, "TopPoseRank")}


def trajectory_run(series: dict[str, DataFrame], start: float) -> dict[str, DataFrame]:
    """`summary` of every metric's wide table (time and a column per system) from `start` on, and the `comparative` table of means."""
    long = None
    for metric, df in series.items():
        one = trajectory.long(trajectory.with_time(df), ["Time_ns"]).withColumn("Metric", F.lit(metric))
        long = one if long is None else long.unionByName(one)
    summary = trajectory.summary(long, ["Metric", "System"], "Value", "Time_ns", start)
    wide = summary.groupBy("System").pivot("Metric", list(series)).agg(F.first("mean", ignorenulls=True))
    return {"summary": summary, "comparative": wide}
