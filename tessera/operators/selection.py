"""Composite scores of models: metrics scaled by their direction, combined by weight, gated and ranked.

An engine is a table of weights. The percentiles of all metrics are found together; every further step
is a projection, but for the ranks.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import order, scaling


@dataclass(frozen=True)
class Engine:
    """Weights of the components and of their metrics, limits of the gate, decision cuts."""

    name: str
    components: Mapping[str, tuple[float, Mapping[str, float]]]
    limits: Mapping[str, float]
    lower: Sequence[str]
    #: Of these the distance from zero counts.
    centred: Sequence[str] = ()
    #: Their direction follows from their correlation with a reference metric.
    inferred: tuple[str, Sequence[str]] = ("", ())
    #: Columns of counts that complete the score.
    complete: Sequence[str] | None = None
    policy: str = "keep_null"
    cuts: Sequence[tuple[float, str]] = field(default=())


# Weights, limits and decisions of the engines.
DECISIONS = ((75.0, "High-confidence representative"), (60.0, "Representative candidate"), (45.0, "Borderline; inspect/refine"))
REJECTED = "Reject or remodel"
LOWER = ("rmsd", "global_rmsd_A", "pocket_rmsd_A", "molprobity_score", "clashscore", "rama_outliers", "rotamer_outliers", "cbeta_deviations", "rms_bonds", "rms_angles", "cablam_disfavored", "cablam_outliers", "cablam_severe", "voro_energy_norm", "voro_clash", "voro_std")
GENERAL = Engine(
    "general",
    {
        "S_geometry": (0.28, {"clashscore": 0.20, "rama_favored": 0.20, "rotamer_outliers": 0.10, "molprobity_score": 0.20, "cbeta_deviations": 0.10, "rama_outliers": 0.10, "rms_bonds": 0.05, "rms_angles": 0.05}),
        "S_backbone": (0.22, {"cablam_disfavored": 0.20, "cablam_outliers": 0.30, "cablam_severe": 0.50}),
        "S_topology": (0.20, {"tm_score": 0.55, "q_score": 0.25, "cmo": 0.10, "rmsd": 0.10}),
        "S_packing": (0.20, {"voro_dark": 0.20, "voro_light": 0.20, "voro_mean": 0.20, "voro_energy_norm": 0.10, "voro_clash": 0.10, "voro_std": 0.10, "pocket_score": 0.05, "pocket_score_z": 0.05}),
        "S_confidence": (0.10, {"plddt_mean": 0.40, "ptm": 0.25, "iptm": 0.25, "ranking_score": 0.10}),
    },
    {"molprobity_score": 3.0, "clashscore": 20.0, "rama_outliers": 2.0, "cablam_severe": 2.0}, LOWER, inferred=("molprobity_score", ("voro_light",)), cuts=DECISIONS,
)
SITE = Engine(
    "hydrolase",
    {
        "S_validation": (0.35, {"molprobity_score": 0.20, "clashscore": 0.10, "rama_outliers": 0.10, "rotamer_outliers": 0.05, "cbeta_deviations": 0.03, "cablam_severe": 0.20, "cablam_outliers": 0.10, "cablam_disfavored": 0.05, "voro_light": 0.12, "perres_q10_mean": 0.05}),
        "S_ensemble": (0.35, {"pocket_rmsd_A": 0.45, "catalytic_distance_delta_A": 0.35, "global_rmsd_A": 0.20}),
        "S_functional_site": (0.30, {"HGG_plddt_mean": 0.30, "GESAG_plddt_mean": 0.30, "plddt_mean": 0.20, "ptm": 0.10, "iptm": 0.10}),
    },
    {"molprobity_score": 2.5, "clashscore": 15.0, "rama_outliers": 1.0, "cablam_severe": 1.0}, LOWER, ("catalytic_distance_delta_A",), ("molprobity_score", ("voro_light", "perres_q10_mean")), ("HGG_plddt_count", "GESAG_plddt_count"), cuts=DECISIONS,
)
_VALIDATION = {"molprobity": 0.22, "clashscore": 0.16, "rama_outliers": 0.14, "rama_favored": 0.08, "rotamer_outliers": 0.08, "cablam_severe": 0.18, "cablam_outliers": 0.08, "packing": 0.06}
_STABILITY = {"global_rmsd": 0.25, "rmsd_stability": 0.30, "rmsf": 0.20, "rg_stability": 0.15, "sasa_stability": 0.10}
_FOLD = {"tm_score": 0.50, "q_score": 0.25, "cmo": 0.25}
_POCKET = {"pocket_rmsd": 0.32, "catalytic_distance_delta": 0.26, "catalytic_distance_stability": 0.16, "hgg_plddt": 0.13, "nuc_loop_plddt": 0.13}
_RECEPTOR_LOWER = ("molprobity", "clashscore", "rama_outliers", "rotamer_outliers", "cablam_severe", "cablam_outliers", "global_rmsd", "rmsd_stability", "rmsf", "rg_stability", "sasa_stability", "pocket_rmsd", "catalytic_distance_stability")
RECEPTOR = Engine(
    "general receptor docking-readiness engine",
    {"S_validation": (0.45, _VALIDATION), "S_md_stability": (0.30, _STABILITY), "S_fold_agreement": (0.25, _FOLD)},
    {"molprobity": 3.0, "clashscore": 25.0, "rama_outliers": 2.0, "cablam_severe": 2.0}, _RECEPTOR_LOWER, policy="impute_median",
)
RECEPTOR_SITE = Engine(
    "CEH/hydrolase catalytic-geometry engine",
    {"S_validation": (0.34, _VALIDATION), "S_md_stability": (0.18, _STABILITY), "S_fold_agreement": (0.10, _FOLD), "S_ceh_geometry": (0.38, _POCKET)},
    {"molprobity": 2.5, "clashscore": 15.0, "rama_outliers": 1.0, "cablam_severe": 1.0}, _RECEPTOR_LOWER, ("catalytic_distance_delta",), policy="impute_median",
)
#: Columns that show that a table is of the site-specific kind.
SITE_COLUMNS = ("pocket_rmsd_A", "catalytic_distance_delta_A", "HGG_plddt_mean", "GESAG_plddt_mean")


def engine_for(df: DataFrame, asked: str = "auto") -> Engine:
    """The asked engine, or the site-specific one if any of its own columns is there."""
    known = {e.name: e for e in (GENERAL, SITE)}
    return known.get(asked) or (SITE if any(c in df.columns for c in SITE_COLUMNS) else GENERAL)


def scaled(df: DataFrame, engine: Engine, prefix: str = "_s_") -> DataFrame:
    """df with every present metric of the engine scaled to 0..1, in its own column."""
    metrics = [m for _, weights in engine.components.values() for m in weights if m in df.columns]
    metrics = list(dict.fromkeys(metrics))
    return scaling.scale_all(df, metrics, [m for m in metrics if m in engine.lower], [m for m in metrics if m in engine.centred], engine.inferred, engine.policy, prefix)


def scores(df: DataFrame, engine: Engine, key: Sequence[str]) -> DataFrame:
    """df with the components, the gate, SelectionScore, SelectionDecision (if the engine has cuts) and Rank.

    Absent metrics take no part. Where values are kept null, weights are renormalised per row, a row
    without any score has 0; where they are imputed, absent columns are renormalised away and what
    is still null counts 0.5. Equal scores share a dense rank.
    """
    rows = scaled(df, engine)
    keep = engine.policy == "keep_null"
    there = {c: {"_s_" + m: w for m, w in weights.items() if m in df.columns} for c, (_, weights) in engine.components.items()}
    none = F.lit(None).cast("double")
    if keep:
        rows = rows.withColumns({c: scaling.weighted_mean(parts) if parts else none for c, parts in there.items()})
        raw = scaling.weighted_mean({c: w for c, (w, _) in engine.components.items()})
    else:
        for c, parts in there.items():
            rows = scaling.weighted_with_half(rows, parts, c) if parts else rows.withColumn(c, F.lit(0.5))
        raw = sum((F.col(c) * w for c, (w, _) in engine.components.items()), F.lit(0.0))
    limits = {c: v for c, v in engine.limits.items() if c in df.columns}
    gate = scaling.gate(limits) if limits else F.lit(1.0)
    rows = rows.withColumns({"validation_gate": gate, "SelectionScore_raw": raw})
    factor = F.lit(1.0)
    if engine.complete is not None:
        counts = [c for c in engine.complete if c in df.columns]
        share = sum(((F.coalesce(scaling.finite(F.col(c)), F.lit(0.0)) > 0).cast("double") for c in counts), F.lit(0.0)) / max(len(counts), 1)
        factor = 0.75 + 0.25 * share if counts else F.lit(0.90)
        rows = rows.withColumn("motif_completeness_modifier", factor)
    total = 100.0 * F.col("validation_gate") * factor * F.coalesce("SelectionScore_raw", F.lit(0.0))
    rows = rows.withColumn("SelectionScore", total).drop(*[c for c in rows.columns if c.startswith("_s_")])
    if engine.cuts:
        rows = rows.withColumn("SelectionDecision", scaling.band(F.col("SelectionScore"), list(engine.cuts), REJECTED))
    return dense_rank(rows, "SelectionScore", "Rank")


def dense_rank(df: DataFrame, score: str, out: str) -> DataFrame:
    """df with the dense rank of the score, greatest first, null as 0; scores count to nine digits."""
    return order.dense_ranks(df, -F.round(F.coalesce(F.col(score), F.lit(0.0)), 9), out)


def representatives(scored: DataFrame, key: str, score: str, groups: Mapping[str, str], first: int = 10) -> DataFrame:
    """The best `first` rows and the best of each group (null is a group), each once, with its classes.

    groups: class name by column. Ties go to the smallest key.
    """
    best_first = [F.desc(score), F.col(key)]
    found = [scored.orderBy(*best_first).limit(first).select(key, F.lit("overall_top").alias("why"))]
    for column, name in groups.items():
        best = scored.groupBy(column).agg(F.min_by(key, F.struct(-F.col(score), F.col(key))).alias(key))
        found.append(best.select(key, F.lit(name).alias("why")))
    rows = found[0]
    for f in found[1:]:
        rows = rows.unionByName(f)
    classes = rows.groupBy(F.col(key).alias("_key")).agg(F.array_join(F.array_sort(F.collect_set("why")), ";").alias("RepresentativeClass"))
    return scored.join(classes, F.col(key) == F.col("_key")).drop("_key")


def decision_counts(scored: DataFrame, decision: str = "SelectionDecision") -> DataFrame:
    return scored.groupBy(decision).agg(F.count("*").alias("n"))


def screen(parts: DataFrame, weights: Mapping[str, float], out: str) -> DataFrame:
    """Weighted sum of the columns, null replaced by the column's median, 0.5 where it has none."""
    there = [c for c in weights if c in parts.columns]
    rows = order.with_percentiles(parts, {"_m_" + c: (scaling.finite(F.col(c)), (0.5,)) for c in there})
    value = lambda c: F.coalesce(scaling.finite(F.col(c)), F.get("_m_" + c, F.lit(0)), F.lit(0.5)) if c in there else F.lit(0.5)
    total: Column = F.lit(0.0)
    for c, w in weights.items():
        total = total + w * value(c)
    return rows.withColumn(out, total / sum(weights.values())).drop(*["_m_" + c for c in there])


# Weights of the last screen.
SCREEN = {"vina_affinity": 0.45, "diffdock_pose": 0.30, "vina_rmsd": 0.15, "ceh_catalytic": 0.10}
SCREEN_SITE = {"ceh_catalytic": 0.45, "vina_affinity": 0.30, "diffdock_pose": 0.15, "vina_rmsd": 0.10}
