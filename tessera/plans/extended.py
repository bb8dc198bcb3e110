"""Queries of the evidence, scoring, docking, trajectory and sink operators over the shared tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import order, scaling, sequences, tables
from ..operators import checks, clusters, docking, geometry, motifs, relational, selection, summaries, trajectory
from ..sinks import files as sinks
from ..sources import structures
from .catalogue import query, r6, rounded, table

# --- annotation -----------------------------------------------------------------------------------

_KD = "CASE upper(c) " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in sequences.HYDROPATHY.items()) + " ELSE 0.0 END"


@query(f"SELECT item_id, round(coalesce(list_avg(list_transform(string_split(substring(text, 1, 30), ''), lambda c: CAST({_KD} AS double))), 0), 6) AS start_mean FROM benchmark")
def ann_hydropathy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select("item_id", r6(sequences.leading_mean(F.col("text"))).alias("start_mean"))


@query(None)
def ann_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sequential segments over whole texts; the test holds it against a loop."""
    text = F.upper("text")
    return table(spark, sf_dir, "benchmark").select("item_id", sequences.rendered(sequences.segments(text, 9, 0.3)).alias("segments"))


@query(None)
def ann_signal(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.upper("text")
    return table(spark, sf_dir, "benchmark").select("item_id", sequences.signal(text, 0.2).alias("s"), sequences.tail_anchor(text, 50, 18, 25, 0.3).alias("t")).select("item_id", "s.found", "s.cut", F.col("t.omega").alias("omega"), F.col("t.start").alias("tail_start"), F.col("t.end").alias("tail_end"))


@query(
    "WITH f AS (SELECT o_custkey, count(*) n FROM orders WHERE o_orderstatus = 'F' GROUP BY 1), o AS (SELECT o_custkey, count(*) n FROM orders WHERE o_orderstatus = 'O' GROUP BY 1) "
    "SELECT c_custkey, CASE WHEN f.n IS NOT NULL THEN 'first' WHEN o.n IS NOT NULL THEN 'second' ELSE 'fallback' END AS source, CASE WHEN f.n IS NOT NULL THEN f.n WHEN o.n IS NOT NULL THEN o.n ELSE 0 END AS value FROM customer LEFT JOIN f ON f.o_custkey = c_custkey LEFT JOIN o ON o.o_custkey = c_custkey"
)
def ann_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders")
    by = lambda s, n: orders.where(F.col("o_orderstatus") == s).groupBy(F.col("o_custkey").alias("k_" + n)).agg(F.count("*").alias(n))
    rows = table(spark, sf_dir, "customer").join(by("F", "f"), F.col("c_custkey") == F.col("k_f"), "left").join(by("O", "o"), F.col("c_custkey") == F.col("k_o"), "left")
    found = sequences.preferred(("first", F.col("f").isNotNull(), F.col("f")), ("second", F.col("o").isNotNull(), F.col("o")), ("fallback", F.lit(True), F.lit(0).cast("long")))
    return rows.select("c_custkey", found.alias("e")).select("c_custkey", "e.source", "e.value")


_FLAGS = "max(CASE WHEN l_tax > 0.06 THEN 1 ELSE 0 END) sp, max(CASE WHEN l_discount > 0.08 THEN 1 ELSE 0 END) gpi, count(*) FILTER (WHERE l_quantity > 45) tm, max(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END) gxs, max(CASE WHEN l_returnflag = 'A' THEN 1 ELSE 0 END) hgg, max(CASE WHEN l_linestatus = 'O' THEN 1 ELSE 0 END) hggg"


@query(
    f"SELECT l_orderkey, CASE WHEN sp = 1 AND gpi = 1 AND tm <= 1 THEN '{sequences.CLASSES[0]}' WHEN sp = 1 AND tm = 1 THEN '{sequences.CLASSES[1]}' WHEN sp = 1 AND tm = 0 THEN '{sequences.CLASSES[2]}' WHEN sp = 0 AND tm = 0 AND hggg = 1 AND gxs = 1 THEN '{sequences.CLASSES[3]}' WHEN sp = 0 AND tm = 0 AND gxs = 1 THEN '{sequences.CLASSES[4]}' WHEN gxs = 1 OR hgg = 1 THEN '{sequences.CLASSES[5]}' ELSE '{sequences.CLASSES[6]}' END AS class FROM (SELECT l_orderkey, {_FLAGS} FROM lineitem GROUP BY 1)"
)
def ann_triage(spark: SparkSession, sf_dir: str) -> DataFrame:
    has = lambda c: F.max(F.expr(c).cast("int")) == 1
    flags = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(has("l_tax > 0.06").alias("sp"), has("l_discount > 0.08").alias("gpi"), F.count_if(F.col("l_quantity") > 45).alias("tm"), has("l_returnflag = 'R'").alias("gxs"), has("l_returnflag = 'A'").alias("hgg"), has("l_linestatus = 'O'").alias("hggg"))
    return flags.select("l_orderkey", sequences.triage(*[F.col(c) for c in ("sp", "gpi", "tm", "gxs", "hgg", "hggg")]).alias("class"))


@query("WITH h AS (SELECT l_orderkey, l_returnflag, l_shipdate, p_type FROM lineitem JOIN part ON p_partkey = l_partkey) SELECT o_orderkey, count(p_type) hits, count(*) FILTER (WHERE l_returnflag = 'R') AS elbow, coalesce(string_agg(DISTINCT p_type, ';' ORDER BY p_type), '') AS ids FROM orders LEFT JOIN h ON l_orderkey = o_orderkey GROUP BY 1")
def ann_hit_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey"))
    # Hits are gathered by their sequence before they meet the sequences.
    found = hits.groupBy("l_orderkey").agg(F.count("*").alias("hits"), F.count_if(F.col("l_returnflag") == "R").alias("elbow"), F.array_join(F.array_sort(F.collect_set("p_type")), ";").alias("ids"))
    joined = table(spark, sf_dir, "orders").join(found, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    return joined.select("o_orderkey", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("hits", "elbow")], F.coalesce("ids", F.lit("")).alias("ids"))


# --- structures -----------------------------------------------------------------------------------


@query("WITH r AS (SELECT l_orderkey, l_linenumber, l_returnflag, avg(l_quantity) m, count(*) n FROM lineitem GROUP BY ALL) SELECT l_orderkey, string_agg(CASE l_returnflag WHEN 'A' THEN 'A' WHEN 'N' THEN 'N' ELSE 'X' END, '' ORDER BY l_linenumber, l_returnflag) AS sequence, round(avg(m), 6) mean, round(median(m), 6) median, min(m) least, max(m) most, CAST(sum(n) AS bigint) atoms FROM r GROUP BY 1")
def str_chains(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", F.lit("A").alias("chain"), F.col("l_linenumber").cast("string").alias("resid"), F.when(F.col("l_returnflag") == "A", "ALA").when(F.col("l_returnflag") == "N", "ASN").otherwise("UNK").alias("resname"), F.col("l_quantity").alias("value"))
    found = structures.chains(structures.residues(rows, "l_orderkey"), "l_orderkey")
    return found.select("l_orderkey", "sequence", r6("mean_plddt").alias("mean"), r6("median_plddt").alias("median"), F.col("min_plddt").alias("least"), F.col("max_plddt").alias("most"), F.col("atom_count").alias("atoms"))


@query("SELECT event_id, metric, round(mean, 6) mean, round(median, 6) median, count FROM (SELECT event_id, 'ptm' metric, value mean, value median, 1 count FROM events UNION ALL SELECT event_id, 'iptm', (value + value / 2 + value / 4) / 3, value / 2, 3 FROM events UNION ALL SELECT event_id, 'ranking_score', user_id, user_id, 1 FROM events UNION ALL SELECT event_id, m, NULL, NULL, 0 FROM events, (SELECT unnest(['pae', 'pde', 'plddt', 'contact_prob', 'fraction_disordered', 'has_clash', 'num_recycles', 'affinity_pred_value', 'affinity_probability_binary']) m))")
def str_json_harvest(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = F.col("value")
    nested = F.struct(F.array(F.array(v), F.array(v / 2)).alias("chain_pair_iptm"), F.struct((v / 4).alias("ipTM"), F.lit("text").alias("note")).alias("deep"))
    texts = table(spark, sf_dir, "events").select("event_id", F.to_json(F.struct(v.alias("pTM"), nested.alias("inner"), F.col("user_id").cast("string").alias("score"))).alias("text"))
    # A text has each metric once, so its numbers are together already.
    found = structures.row_statistics(F.col("values"))
    return structures.json_values(texts, "event_id", "text").select("event_id", "metric", r6(found["mean"]).alias("mean"), r6(found["median"]).alias("median"), found["count"].cast("int").alias("count"))


@query("SELECT p_brand, CASE WHEN t LIKE '%1%' THEN 'one' WHEN t LIKE '%2%' OR t LIKE '%3%' THEN 'two' ELSE 'none' END AS rule, n FROM (SELECT p_brand, lower(string_agg(p_type, ' ' ORDER BY p_type)) || lower(p_brand) t, count(*) n FROM part GROUP BY 1)")
def str_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    grouped = table(spark, sf_dir, "part").groupBy("p_brand").agg(F.array_join(F.array_sort(F.collect_list("p_type")), " ").alias("t"), F.count("*").alias("n"))
    return grouped.select("p_brand", tables.first_rule(F.concat("t", "p_brand"), ((("1",), "one"), (("2", "3"), "two")), "none").alias("rule"), "n")


# --- selection ------------------------------------------------------------------------------------


def engine_sql(source: str, key: str, engine: selection.Engine, metrics: dict[str, str]) -> str:
    """The scores of an engine over metrics (name: SQL) of a grouped source."""
    keep = engine.policy == "keep_null"
    x = lambda m: f"abs({metrics[m]})" if m in engine.centred else metrics[m]
    used = list(dict.fromkeys(m for _, ws in engine.components.values() for m in ws if m in metrics))
    raw = ", ".join(f'{metrics[m]} AS "{m}"' for m in metrics)
    base = ", ".join(f'{x(m)} AS "x_{m}"' for m in used)
    filled = ", ".join(f'"x_{m}"' if keep else f'coalesce("x_{m}", (SELECT median("x_{m}") FROM a)) AS "x_{m}"' for m in used)
    stats = ", ".join(f'quantile_cont("x_{m}", 0.05) AS "l_{m}", quantile_cont("x_{m}", 0.95) AS "h_{m}"' for m in used)

    def scaled(m: str) -> str:
        up = f'least(greatest(("x_{m}" - "l_{m}") / nullif("h_{m}" - "l_{m}", 0), 0), 1)'
        if m in engine.centred:
            value = f'CASE WHEN "h_{m}" = 0 THEN {1.0 if keep else 0.5} ELSE least(greatest(1 - "x_{m}" / nullif("h_{m}", 0), 0), 1) END'
        elif m in engine.inferred[1] and engine.inferred[1][0] in metrics and engine.inferred[0] in metrics:
            value = f"CASE WHEN (SELECT corr(\"{engine.inferred[1][0]}\", \"{engine.inferred[0]}\") FROM a) > 0 THEN 1 - {up} ELSE {up} END"
        else:
            value = f"1 - {up}" if m in engine.lower else up
        flat = "" if m in engine.centred else f'WHEN "h_{m}" = "l_{m}" THEN 0.5 '
        return f'CASE WHEN "x_{m}" IS NULL THEN NULL {flat}ELSE {value} END AS "s_{m}"'

    def mean(parts: list[tuple[str, float]], null: str) -> str:
        if not parts:
            return null
        if not keep:
            total = sum(w for _, w in parts)
            return "(" + " + ".join(f"coalesce({c}, 0.5) * {w}" for c, w in parts) + f") / {total}"
        return "(" + " + ".join(f"coalesce({c} * {w}, 0)" for c, w in parts) + ") / nullif(" + " + ".join(f"CASE WHEN {c} IS NULL THEN 0 ELSE {w} END" for c, w in parts) + ", 0)"

    components = ", ".join(f'{mean([(f"""\"s_{m}\"""", w) for m, w in ws.items() if m in metrics], "NULL" if keep else "0.5")} AS "{c}"' for c, (_, ws) in engine.components.items())
    total = mean([(f'"{c}"', w) for c, (w, _) in engine.components.items()], "NULL") if keep else " + ".join(f'"{c}" * {w}' for c, (w, _) in engine.components.items())
    gate = " * ".join([f'CASE WHEN "{m}" IS NULL OR "{m}" <= {v} THEN 1.0 ELSE 0.0 END' for m, v in engine.limits.items() if m in metrics] or ["1.0"])
    counts = [c for c in engine.complete or () if c in metrics]
    factor = "1.0" if engine.complete is None else "0.9" if not counts else "(0.75 + 0.25 * (" + " + ".join(f'CASE WHEN coalesce("{c}", 0) > 0 THEN 1.0 ELSE 0.0 END' for c in counts) + f") / {len(counts)})"
    shown = ", ".join(f'round("{c}", 6) AS "{c}"' for c in engine.components)
    return f"WITH a AS (SELECT {key} k, {raw}, {base} FROM {source}), b AS (SELECT a.* REPLACE ({filled if not keep else base and ', '.join(f'{chr(34)}x_{m}{chr(34)} AS {chr(34)}x_{m}{chr(34)}' for m in used)}) FROM a), q AS (SELECT {stats} FROM b), s AS (SELECT b.*, {', '.join(scaled(m) for m in used)} FROM b, q), c AS (SELECT *, {components}, {gate} g FROM s) SELECT k, {shown}, round(100 * g * {factor} * coalesce({total}, 0), 6) score FROM c"


_PARTS = "(SELECT l_partkey, avg(l_discount) d, avg(l_tax) t, avg(l_quantity) q, avg(l_extendedprice) e, count(*) FILTER (WHERE l_returnflag = 'R') r, count(*) FILTER (WHERE l_returnflag = 'A') a FROM lineitem GROUP BY 1)"
_SITE = {"molprobity_score": "t * 60", "clashscore": "q / 2.5", "voro_light": "e", "perres_q10_mean": "nullif(d, 0.05)", "pocket_rmsd_A": "d * 10", "catalytic_distance_delta_A": "t - 0.04", "HGG_plddt_mean": "CASE WHEN r > 0 THEN e / 1000 END", "GESAG_plddt_mean": "q", "HGG_plddt_count": "r", "GESAG_plddt_count": "a"}


def metrics_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    l = table(spark, sf_dir, "lineitem")
    return l.groupBy("l_partkey").agg(F.avg("l_discount").alias("d"), F.avg("l_tax").alias("t"), F.avg("l_quantity").alias("q"), F.avg("l_extendedprice").alias("e"), F.count_if(F.col("l_returnflag") == "R").alias("r"), F.count_if(F.col("l_returnflag") == "A").alias("a"))


def _scored(spark: SparkSession, sf_dir: str, engine: selection.Engine, metrics: dict[str, str]) -> DataFrame:
    rows = metrics_of(spark, sf_dir).select(F.col("l_partkey").alias("k"), *[F.expr(x).alias(m) for m, x in metrics.items()])
    return selection.scores(rows, engine, ["k"])


def _shown(scored: DataFrame, engine: selection.Engine) -> DataFrame:
    return scored.select("k", *[r6(c).alias(c) for c in engine.components], r6("SelectionScore").alias("score"))


@query(engine_sql(_PARTS, "l_partkey", selection.SITE, _SITE))
def sel_site_specific(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shown(_scored(spark, sf_dir, selection.SITE, _SITE), selection.SITE)


_ALL = {"clashscore": "q / 2", "rama_favored": "e", "rotamer_outliers": "nullif(d, 0.05)", "molprobity_score": "t * 60", "cablam_severe": "d * 25", "tm_score": "t", "q_score": "CAST(NULL AS double)", "voro_light": "e * 2", "pocket_score": "q", "plddt_mean": "e / 1000", "ptm": "CAST(1 AS double)"}


@query(engine_sql(_PARTS, "l_partkey", selection.GENERAL, _ALL))
def sel_all_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shown(_scored(spark, sf_dir, selection.GENERAL, _ALL), selection.GENERAL)


_RECEPTOR = {"molprobity": "t * 60", "clashscore": "q / 2", "rama_outliers": "nullif(d, 0.05) * 20", "packing": "e", "global_rmsd": "d", "rmsd_stability": "CASE WHEN r > 0 THEN t END", "rmsf": "q", "tm_score": "CAST(0.5 AS double)", "q_score": "e / 2", "pocket_rmsd": "d", "catalytic_distance_delta": "t - 0.04", "hgg_plddt": "q"}


@query(engine_sql(_PARTS, "l_partkey", selection.RECEPTOR, _RECEPTOR))
def rec_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shown(_scored(spark, sf_dir, selection.RECEPTOR, _RECEPTOR), selection.RECEPTOR)


@query(engine_sql(_PARTS, "l_partkey", selection.RECEPTOR_SITE, _RECEPTOR))
def rec_site_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shown(_scored(spark, sf_dir, selection.RECEPTOR_SITE, _RECEPTOR), selection.RECEPTOR_SITE)


_DECIDED = "CASE " + " ".join(f"WHEN score >= {v} THEN '{n}'" for v, n in selection.DECISIONS) + f" ELSE '{selection.REJECTED}' END"


@query(f"SELECT {_DECIDED} AS decision, count(*) n FROM ({engine_sql(_PARTS, 'l_partkey', selection.GENERAL, _ALL)}) GROUP BY 1")
def sel_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = _scored(spark, sf_dir, selection.GENERAL, _ALL)
    scored = scored.withColumn("decision", scaling.band(r6("SelectionScore"), list(selection.DECISIONS), selection.REJECTED))
    return selection.decision_counts(scored, "decision")


@query(
    f"WITH g AS (SELECT s.k, s.score, p_brand cluster, p_type family FROM ({engine_sql(_PARTS, 'l_partkey', selection.GENERAL, _ALL)}) s JOIN part ON p_partkey = k), c AS (SELECT k, 'overall_top' why FROM (SELECT k, row_number() OVER (ORDER BY score DESC, k) i FROM g) WHERE i <= 10 UNION SELECT k, 'best_per_global_cluster' FROM (SELECT k, row_number() OVER (PARTITION BY cluster ORDER BY score DESC, k) i FROM g) WHERE i = 1 UNION SELECT k, 'best_per_family' FROM (SELECT k, row_number() OVER (PARTITION BY family ORDER BY score DESC, k) i FROM g) WHERE i = 1) SELECT k, string_agg(why, ';' ORDER BY why) AS classes FROM c GROUP BY 1"
)
def sel_cluster_representatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = _shown(_scored(spark, sf_dir, selection.GENERAL, _ALL), selection.GENERAL).join(table(spark, sf_dir, "part"), F.col("k") == F.col("p_partkey"))
    found = selection.representatives(scored, "k", "score", {"p_brand": "best_per_global_cluster", "p_type": "best_per_family"})
    return found.select("k", F.col("RepresentativeClass").alias("classes"))


# --- docking --------------------------------------------------------------------------------------

_POSES = "SELECT l_orderkey, l_linenumber, l_suppkey, l_returnflag, l_quantity q, -l_extendedprice aff, nullif(l_discount, 0.05) rm, l_tax conf, l_tax zero FROM lineitem"
_POSE_RANK = (
    f"WITH p AS ({_POSES}), f AS (SELECT p.* REPLACE (coalesce(rm, (SELECT median(rm) FROM p)) AS rm) FROM p), s AS (SELECT quantile_cont(aff, 0.05) al, quantile_cont(aff, 0.95) ah, quantile_cont(rm, 0.05) rl, quantile_cont(rm, 0.95) rh, quantile_cont(conf, 0.05) cl, quantile_cont(conf, 0.95) ch, corr(conf, aff) > 0 down FROM f), "
    "x AS (SELECT f.*, 1 - least(greatest((aff - al) / (ah - al), 0), 1) a, 1 - least(greatest((rm - rl) / (rh - rl), 0), 1) b, least(greatest((conf - cl) / (ch - cl), 0), 1) c0, down FROM f, s) SELECT *, 0.55 * a + 0.25 * b + 0.20 * (CASE WHEN down THEN 1 - c0 ELSE c0 END) sc FROM x"
)


def unscored(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey", "l_returnflag", F.col("l_quantity").alias("q"), (-F.col("l_extendedprice")).alias("aff"), F.nullif(F.col("l_discount"), F.lit(0.05)).alias("rm"), F.col("l_tax").alias("conf"), F.col("l_tax").alias("zero"))


def poses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return docking.rank_poses(unscored(spark, sf_dir), "aff", "rm", "conf", "sc")


@query(f"SELECT l_orderkey, l_linenumber, round(sc, 6) score FROM ({_POSE_RANK}) WHERE zero <> 0 OR zero IS NULL")
def dock_pose_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    # The scales are those of all poses; zero scores go after.
    return docking.without_zero(poses(spark, sf_dir), "zero").select("l_orderkey", "l_linenumber", r6("sc").alias("score"))


_BINS = (
    f"WITH p AS ({_POSES}), m AS (SELECT l_suppkey, l_returnflag, median(rm) md FROM p GROUP BY 1, 2), f AS (SELECT p.* REPLACE (coalesce(rm, md, 0) AS rm), rm raw FROM p JOIN m USING (l_suppkey, l_returnflag)), s AS (SELECT l_suppkey, l_returnflag, min(aff) ao, greatest(250.0, stddev_pop(aff) / 2) aw, min(rm) ro, greatest(0.02, stddev_pop(rm) / 2) rw FROM f GROUP BY 1, 2) "
    "SELECT f.*, CAST(dense_rank() OVER (PARTITION BY l_suppkey, l_returnflag ORDER BY floor((aff - ao) / aw), floor((rm - ro) / rw)) AS int) AS cl FROM f JOIN s USING (l_suppkey, l_returnflag)"
)


def binned(spark: SparkSession, sf_dir: str) -> DataFrame:
    # Bins do not need the score, nor the scales of all poses that it takes.
    return docking.score_bins(unscored(spark, sf_dir), ["l_suppkey", "l_returnflag"], [("aff", 250.0), ("rm", 0.02)], "cl")


@query(f"SELECT l_suppkey, l_returnflag, cl, count(*) size, min_by(l_orderkey, (aff, l_orderkey, l_linenumber)) best, round(median(aff), 6) mid, round(median(raw), 6) mid_rm FROM ({_BINS}) GROUP BY 1, 2, 3")
def dock_cluster_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = docking.cluster_summary(binned(spark, sf_dir), ["l_suppkey", "l_returnflag"], "cl", [F.col("aff"), F.col("l_orderkey"), F.col("l_linenumber")], ["l_orderkey"], ["aff", "rm"])
    return found.select("l_suppkey", "l_returnflag", "cl", F.col("ClusterSize").alias("size"), F.col("Best_l_orderkey").alias("best"), r6("Median_aff").alias("mid"), r6("Median_rm").alias("mid_rm"))


@query(f"SELECT l_orderkey, l_linenumber, new AS cl FROM ({_BINS}) JOIN (SELECT l_suppkey, l_returnflag, cl, CAST(row_number() OVER (PARTITION BY l_suppkey, l_returnflag ORDER BY min(aff), min(l_orderkey), cl) AS int) AS new FROM ({_BINS}) GROUP BY 1, 2, 3) USING (l_suppkey, l_returnflag, cl)")
def dock_relabelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return docking.relabelled(binned(spark, sf_dir), ["l_suppkey", "l_returnflag"], "cl", "aff", "l_orderkey").select("l_orderkey", "l_linenumber", "cl")


@query("WITH a AS (SELECT l_suppkey, l_orderkey * 10 + l_linenumber mo, -l_extendedprice x, l_tax lb, l_discount ub, row_number() OVER (PARTITION BY l_suppkey ORDER BY -l_extendedprice) i, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_tax) j, count(*) OVER (PARTITION BY l_suppkey) n FROM lineitem) SELECT l_suppkey, min_by(x, (mo, x, lb, ub)) AS first, min_by(lb, (mo, x, lb, ub)) AS first_lb, min(x) best, round(avg(x), 3) mean, round(avg(x) FILTER (WHERE i > floor(n * 0.1) AND i <= n - floor(n * 0.1)), 3) trimmed, round(avg(lb), 6) mean_lb, round(avg(lb) FILTER (WHERE j > floor(n * 0.1) AND j <= n - floor(n * 0.1)), 6) trimmed_lb, count(*) n FROM a GROUP BY 1")
def dock_log_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    modes = table(spark, sf_dir, "lineitem").select("l_suppkey", (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("Mode"), (-F.col("l_extendedprice")).alias("Affinity"), F.col("l_tax").alias("RMSD_lb"), F.col("l_discount").alias("RMSD_ub"))
    s = docking.log_summary(modes, "l_suppkey")
    return s.select("l_suppkey", F.col("Top1_Affinity").alias("first"), F.col("Top1_RMSD_lb").alias("first_lb"), F.col("Best_Affinity").alias("best"), F.round("Mean_Affinity", 3).alias("mean"), F.round("TrimmedMean_Affinity", 3).alias("trimmed"), r6("Mean_RMSD_lb").alias("mean_lb"), r6("TrimmedMean_RMSD_lb").alias("trimmed_lb"), F.col("NumModes").alias("n"))


_CONTACTS = "SELECT l_returnflag pr, l_linestatus li, l_orderkey pose, l_suppkey res, l_quantity d FROM lineitem"


def contacts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("pr"), F.col("l_linestatus").alias("li"), F.col("l_orderkey").alias("pose"), F.col("l_suppkey").alias("res"), F.col("l_quantity").alias("d"))


_FREQ = f"WITH c AS ({_CONTACTS}), n AS (SELECT pr, li, count(DISTINCT pose) np FROM c GROUP BY 1, 2), f AS (SELECT pr, li, res, count(DISTINCT pose) k, min(d) lo, avg(d) av, count(DISTINCT pose) / any_value(np) fr FROM c JOIN n USING (pr, li) GROUP BY 1, 2, 3)"


@query(_FREQ + " SELECT pr, li, res, k, lo, round(av, 6) av, round(fr, 9) fr FROM f WHERE fr > 0.012")
def dock_contact_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    frequency, _ = docking.contact_statistics(contacts(spark, sf_dir), ["pr", "li"], "pose", "res", "d")
    return docking.frequent(frequency, 0.012).select("pr", "li", "res", F.col("ContactCount").alias("k"), F.col("MinDistance").alias("lo"), r6("MeanDistance").alias("av"), F.round("Frequency", 9).alias("fr"))


@query(_FREQ + ", t AS (SELECT *, fr / sum(fr) OVER (PARTITION BY pr, li) p FROM f) SELECT pr, li, round(avg(fr), 9) mean, count(*) FILTER (WHERE fr >= 0.01) AS high, round(-sum(p * ln(p + 1e-9)), 6) entropy FROM t GROUP BY 1, 2")
def dock_contact_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, stats = docking.contact_statistics(contacts(spark, sf_dir), ["pr", "li"], "pose", "res", "d", 0.01)
    return stats.select("pr", "li", F.round("MeanFrequency", 9).alias("mean"), F.col("HighFreqResidues").alias("high"), r6("Entropy").alias("entropy"))


_XYZ = "SELECT vec_id id, label, CAST(embedding[1] AS double) x, CAST(embedding[2] AS double) y, CAST(embedding[3] AS double) z FROM embeddings"


def atoms_xyz(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "label", *[F.col("embedding")[i].cast("double").alias(c) for i, c in enumerate("xyz")])


@query(f"WITH p AS ({_XYZ}) SELECT a.label AS label, a.id left_id, b.id right_id, round(sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2 + (a.z - b.z) ** 2), 6) distance FROM p a JOIN p b ON a.label = b.label AND a.id % 2 = 0 AND b.id % 2 = 1 WHERE sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2 + (a.z - b.z) ** 2) BETWEEN 0.03 AND 0.08")
def dock_bond_band(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = atoms_xyz(spark, sf_dir)
    return rounded(docking.bonds(p.where("id % 2 = 0"), p.where("id % 2 = 1"), "label", 0.03, 0.08), "label", "left_id", "right_id")


_TRI = "greatest(0.0, 1 - abs({0} - {1}) / {2})"


@query(
    "WITH a AS (SELECT l_orderkey, l_linenumber, l_quantity, l_tax, l_discount, l_quantity / 10 s, 60 + l_tax * 1000 g, CAST(l_linenumber AS int) - 2 o, nullif(l_discount, 0) * 50 sh, l_tax * 60 ah FROM lineitem), "
    f"c AS (SELECT *, 0.30 * {_TRI.format('s', 3.0, 2.5)} + 0.20 * CASE WHEN g BETWEEN 90 AND 120 THEN {_TRI.format('g', 105.0, 75.0)} ELSE 0 END + 0.30 * least(greatest(o, 0) / 2, 1) + 0.20 * (0.6 * coalesce({_TRI.format('sh', 3.0, 2.0)}, 0) + 0.4 * {_TRI.format('ah', 2.8, 1.5)}) sc FROM a), "
    "b AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY round(sc, 9) DESC, l_linenumber, l_quantity, l_tax, l_discount) i FROM c) "
    "SELECT l_orderkey, l_linenumber, round(sc, 6) score, CASE WHEN s <= 4 AND g BETWEEN 90 AND 120 AND o >= 2 AND coalesce(sh <= 3.5, false) AND ah <= 3.5 THEN 'catalytically-competent' WHEN s <= 4 AND coalesce(sh <= 3.5, false) THEN 'near-reactive' WHEN s <= 4.5 THEN 'binding' ELSE 'distant' END AS state FROM b WHERE i = 1"
)
def dock_site_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    l = table(spark, sf_dir, "lineitem")
    parts = [F.col("l_quantity") / 10, 60 + F.col("l_tax") * 1000, F.col("l_linenumber") - 2, F.nullif(F.col("l_discount"), F.lit(0.0)) * 50, F.col("l_tax") * 60]
    rows = l.select("l_orderkey", "l_linenumber", F.struct("l_linenumber", "l_quantity", "l_tax", "l_discount").alias("ord"), F.round(docking.competence(*parts), 9).alias("sc"), docking.pose_state(*parts).alias("state"))
    return docking.best_candidate(rows, "l_orderkey", "sc", "ord").select("l_orderkey", "l_linenumber", r6("sc").alias("score"), "state")


_SCREEN = "WITH v AS (SELECT s_nationkey k, avg(s_acctbal) va FROM supplier WHERE s_acctbal > 0 GROUP BY 1), d AS (SELECT c_nationkey k, CASE WHEN avg(c_acctbal) > 4500 THEN avg(c_acctbal) END dp FROM customer GROUP BY 1), j AS (SELECT coalesce(v.k, d.k) k, va, dp FROM v FULL JOIN d ON v.k = d.k), m AS (SELECT median(va) mv, median(dp) md FROM j)"


@query(_SCREEN + " SELECT k, round(0.45 * coalesce(va, mv, 0.5) + 0.30 * coalesce(dp, md, 0.5) + 0.15 * 0.5 + 0.10 * 0.5, 6) score FROM j, m")
def dock_screen(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = table(spark, sf_dir, "supplier").where("s_acctbal > 0").groupBy(F.col("s_nationkey").alias("k")).agg(F.avg("s_acctbal").alias("vina_affinity"))
    mean = F.avg("c_acctbal")
    d = table(spark, sf_dir, "customer").groupBy(F.col("c_nationkey").alias("k")).agg(F.when(mean > 4500, mean).alias("diffdock_pose"))
    return selection.screen(relational.outer_coalesce(v, d, "k"), selection.SCREEN, "s").select("k", r6("s").alias("score"))


@query("WITH a AS (SELECT l_orderkey, l_returnflag ch, l_suppkey r, l_linestatus n, count(*) FILTER (WHERE l_tax > 0.02) heavy, min(l_linenumber) f FROM lineitem WHERE l_quantity > 10 AND l_linestatus <> 'F' GROUP BY 1, 2, 3, 4), b AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY heavy DESC, f, ch, r) i FROM a) SELECT l_orderkey, ch, r, heavy FROM b WHERE i = 1")
def dock_ligand_pick(spark: SparkSession, sf_dir: str) -> DataFrame:
    l = table(spark, sf_dir, "lineitem")
    atoms = l.select(F.col("l_orderkey").alias("pose"), F.when(F.col("l_quantity") > 10, "HETATM").otherwise("ATOM").alias("record"), F.col("l_returnflag").alias("chain"), F.col("l_suppkey").alias("resid"), F.when(F.col("l_linestatus") == "F", "HOH").otherwise(F.col("l_linestatus")).alias("resname"), F.when(F.col("l_tax") > 0.02, "C").otherwise("H").alias("element"), F.col("l_linenumber").alias("serial"))
    picked = docking.ligand_residues(atoms)
    return picked.groupBy(F.col("pose").alias("l_orderkey"), F.col("chain").alias("ch"), F.col("resid").alias("r")).agg(F.count_if(F.col("element") != "H").alias("heavy"))


@query("SELECT n_name, r_name, CASE WHEN n_regionkey = r_regionkey THEN 'done' END AS reason FROM nation CROSS JOIN region")
def dock_work_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    n, r = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    done = n.join(r, F.col("n_regionkey") == F.col("r_regionkey")).select("n_name", "r_name", F.lit("done").alias("reason"))
    return docking.work_grid(n, r, done, "n_name", "r_name")


@query("SELECT p_partkey, CASE WHEN p_name IN (SELECT p_name FROM part WHERE p_size <= 25) THEN 'lib/' || p_name || '.sdf' END AS path FROM part")
def dock_pose_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part").withColumn("Prediction", F.concat(F.col("p_name")))
    files = part.where("p_size <= 25").select(F.concat(F.lit("lib/"), "p_name", F.lit(".sdf")).alias("path"))
    found, dropped = docking.matched_files(part, files)
    return found.select("p_partkey", F.col("PosePath").alias("path")).unionByName(dropped.select("p_partkey", F.lit(None).cast("string").alias("path")))


# --- clustering -----------------------------------------------------------------------------------


def r5(c: Column) -> Column:
    """c, not negative, rounded half up to five places as the SQL does it, without a decimal for each of very many rows."""
    scaled = c * 1e5
    even = F.rint(scaled)
    return F.when(scaled - even == 0.5, even + 1).otherwise(even) / 1e5


@query("WITH e AS (SELECT vec_id, label, embedding[1:63] v FROM embeddings) SELECT a.label AS label, a.vec_id AS \"left\", b.vec_id AS \"right\", round(sqrt(list_sum(list_transform(list_zip(a.v, b.v), lambda p: (CAST(p[1] AS double) - CAST(p[2] AS double)) ** 2)) / 21), 5) AS rmsd FROM e a JOIN e b ON a.label = b.label AND a.vec_id < b.vec_id")
def clu_pairwise(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings").select("label", "vec_id", F.slice("embedding", 1, 63).alias("p"))
    return clusters.near_pairs(e, "label", "vec_id", "p", None).select("label", "left", "right", r5(F.col("distance") / 21**0.5).alias("rmsd"))


@query(None)
def clu_superposed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairwise distances after superposition; the test holds them against rotated copies."""
    e = table(spark, sf_dir, "embeddings").select("label", "vec_id", F.slice("embedding", 1, 63).alias("p"))
    return geometry.pairwise_rmsd(e, "label", "vec_id", "p").withColumn("rmsd", r5(F.col("rmsd")))


@query(None)
def clu_nested(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings").select("label", F.pmod("vec_id", F.lit(3)).cast("int").alias("outer"), "vec_id", "embedding").withColumnRenamed("label", "grp")
    return geometry.nested_labels(e, "grp", "outer", "vec_id", "embedding", "average", 1.2)


# --- trajectories ---------------------------------------------------------------------------------


@query(
    "SELECT metric, user_id, n, round(mean, 6) mean, round(sd, 6) sd, round(median, 6) median FROM (SELECT metric, user_id, count(v) n, avg(v) mean, coalesce(stddev_samp(v), 0) sd, median(v) median FROM (SELECT user_id, 'rmsd' metric, value v, epoch(ts) t FROM events UNION ALL SELECT user_id, 'half', nullif(value, 50) / 2, epoch(ts) FROM events) WHERE t >= epoch(TIMESTAMP '2024-01-05') AND v IS NOT NULL GROUP BY 1, 2)"
)
def md_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    wide = table(spark, sf_dir, "events").select("user_id", F.unix_seconds(F.col("ts").cast("timestamp")).alias("Time_ns"), F.col("value").alias("rmsd"), (F.nullif(F.col("value"), F.lit(50.0)) / 2).alias("half"))
    long = trajectory.long(trajectory.with_time(wide), ["user_id", "Time_ns"], "metric", "v")
    found = trajectory.summary(long, ["metric", "user_id"], "v", "Time_ns", 1704412800.0)
    return found.select("metric", "user_id", "n", *[r6(c).alias(c) for c in ("mean", "sd", "median")])


_FRAMES = "SELECT l_returnflag sys, l_linestatus lig, l_quantity ser_his, l_discount his_glu, l_tax carbonylC, l_extendedprice gly128, nullif(l_linenumber, 1) gly129 FROM lineitem"
_OK = "coalesce(ser_his <= 25, false) a, coalesce(his_glu <= 25, false) b, coalesce(carbonylC <= 0.04, false) c, coalesce(gly128 <= 40000, false) d, coalesce(gly129 <= 40000, false) e"


@query(
    f"WITH f AS (SELECT sys, lig, {_OK} FROM ({_FRAMES})) SELECT sys, lig, count(*) n, round(avg(CAST(a AS int) + CAST(b AS int) + CAST(c AS int) + CAST(d AS int) + CAST(e AS int)), 6) score, "
    "round(100 * avg(CASE WHEN a AND b THEN 1.0 ELSE 0.0 END), 6) triad, round(100 * avg(CASE WHEN d OR e THEN 1.0 ELSE 0.0 END), 6) any_hole, round(100 * avg(CASE WHEN a AND b AND c AND d AND e THEN 1.0 ELSE 0.0 END), 6) productive FROM f GROUP BY 1, 2"
)
def md_criteria(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("sys"), F.col("l_linestatus").alias("lig"), F.col("l_quantity").alias("ser_his"), F.col("l_discount").alias("his_glu"), F.col("l_tax").alias("carbonylC"), F.col("l_extendedprice").alias("gly128"), F.nullif(F.col("l_linenumber"), F.lit(1)).alias("gly129"))
    found = trajectory.criteria_summary(trajectory.frame_criteria(rows, ["ser_his", "his_glu", "carbonylC", "gly128", "gly129"], 25.0, 0.04, 40000.0), ["sys", "lig"])
    return found.select("sys", "lig", F.col("N_frames").alias("n"), *[r6(c).alias(n) for c, n in (("Mean_catalytic_score_0_to_5", "score"), ("Triad_contact_ok_percent", "triad"), ("Oxyanion_any_ok_percent", "any_hole"), ("Fully_productive_ok_percent", "productive"))])


@query("SELECT l_returnflag sys, metric, count(v) n, round(avg(v), 6) mean, round(quantile_cont(v, 0.25), 6) q1, min(v) least FROM (SELECT l_returnflag, 'tax' metric, l_tax v FROM lineitem UNION ALL SELECT l_returnflag, 'few', CASE WHEN l_linenumber > 5 THEN l_quantity END FROM lineitem) WHERE v IS NOT NULL GROUP BY 1, 2")
def md_distances(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("sys"), F.col("l_tax").alias("tax"), F.when(F.col("l_linenumber") > 5, F.col("l_quantity")).alias("few"))
    found = trajectory.distance_summary(rows, ["sys"], ["tax", "few"])
    return found.select("sys", F.col("Distance").alias("metric"), "n", r6("mean").alias("mean"), r6("q1").alias("q1"), "least")


_BLOCK = "SELECT l_returnflag sys, l_linestatus rn, l_partkey num, l_quantity occ, l_tax mn, l_tax + l_discount mx FROM lineitem"


def block(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("System"), F.col("l_linestatus").alias("Residue_Name"), F.col("l_partkey").cast("string").alias("Residue_Number"), F.col("l_quantity").alias("Occupancy_Percent"), F.col("l_tax").alias("Minimum_Distance"), (F.col("l_tax") + F.col("l_discount")).alias("Maximum_Distance"))
    return trajectory.with_contact_columns(rows)


@query(f"SELECT rn || CAST(num AS varchar) AS id, count(DISTINCT sys) systems, round(avg(occ), 6) mean, max(occ) most, min(mn) lo, round(max(mx), 6) hi FROM ({_BLOCK}) GROUP BY rn, num")
def md_contact_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = trajectory.contact_summary(block(spark, sf_dir))
    return found.select(F.col("Residue_ID").alias("id"), F.col("Systems_present").alias("systems"), r6("Mean_occupancy_percent").alias("mean"), F.col("Max_occupancy_percent").alias("most"), F.col("Min_distance").alias("lo"), r6("Max_distance").alias("hi"))


@query(f"SELECT rn || CAST(num AS varchar) AS id, coalesce(max(occ) FILTER (WHERE sys = 'A'), 0) AS a, coalesce(max(occ) FILTER (WHERE sys = 'N'), 0) AS n, coalesce(max(occ) FILTER (WHERE sys = 'R'), 0) AS r FROM ({_BLOCK}) GROUP BY 1")
def md_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = trajectory.matrix(block(spark, sf_dir), "Residue_ID", "System", "ANR", "Occupancy_Percent", "max", 0.0)
    return found.select(F.col("Residue_ID").alias("id"), F.col("A").alias("a"), F.col("N").alias("n"), F.col("R").alias("r"))


@query("WITH s AS (SELECT user_id u, avg(value) FILTER (WHERE event_type = 'click') AS c, avg(value) FILTER (WHERE event_type = 'view') AS v FROM events GROUP BY 1), x AS (SELECT user_id u, count(*) n FROM events WHERE value > 60 GROUP BY 1) SELECT s.u, round(c, 6) c, round(v, 6) v, n FROM s LEFT JOIN x USING (u)")
def md_comparative(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").withColumnRenamed("user_id", "u")
    means = e.groupBy("u", F.col("event_type").alias("Metric")).agg(F.avg("value").alias("mean"))
    extra = e.where("value > 60").groupBy("u").agg(F.count("*").alias("n"))
    found = trajectory.comparative(means, ["u"], ["click", "view"], extra, "u")
    return found.select("u", r6("click").alias("c"), r6("view").alias("v"), "n")


@query(f"WITH p AS ({_XYZ}), d AS (SELECT a.label f, a.id % 5 r, min(sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2 + (a.z - b.z) ** 2)) m FROM p a JOIN p b ON a.label = b.label AND a.id % 2 = 0 AND b.id % 2 = 1 GROUP BY 1, 2) SELECT r AS residue, round(100 * count(*) FILTER (WHERE m <= 0.08) / (SELECT count(DISTINCT label) FROM p WHERE id % 2 = 0), 2) AS occupancy, round(min(m), 3) least FROM d GROUP BY 1 HAVING count(*) FILTER (WHERE m <= 0.08) > 0")
def md_frame_contacts(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = atoms_xyz(spark, sf_dir).withColumnRenamed("label", "frame").withColumn("residue", F.col("id") % 5)
    found = trajectory.frame_contacts(p.where("id % 2 = 0"), p.where("id % 2 = 1"), 0.08, 0.3)
    return found.select("residue", F.col("Occupancy_Percent").alias("occupancy"), F.col("Minimum_Distance_A").alias("least"))


# --- tables, checks and sinks ---------------------------------------------------------------------


@query("SELECT c_custkey AS id, trim(c_name) AS model, c_acctbal AS score, CAST(NULL AS double) AS extra FROM customer")
def util_aliases(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = tables.with_aliases(table(spark, sf_dir, "customer"), {"model": ["Model", "c_name"], "id": ["c_custkey"]})
    named = tables.conformed(rows, {"c_acctbal": "score"}, ["id", "model"], ["score", "extra"])
    return tables.named(named, "model", ["id"]).select("id", F.trim("model").alias("model"), "score", "extra")


@query("SELECT k, v, src FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY src, v) i FROM (SELECT DISTINCT n_regionkey k, n_name v, 'n' src FROM nation UNION ALL SELECT r_regionkey, r_name, 'r' FROM region)) WHERE i = 1")
def util_first_of_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "nation").select(F.col("n_regionkey").alias("k"), F.col("n_name").alias("v"), F.lit("n").alias("src"))
    r = table(spark, sf_dir, "region").select(F.col("r_regionkey").alias("k"), F.col("r_name").alias("v"), F.lit("r").alias("src"))
    both = sinks.union_columns(n.distinct(), r)
    return both.groupBy("k").agg(F.min_by(F.struct("v", "src"), F.struct("src", "v")).alias("x")).select("k", "x.v", "x.src")


@query("SELECT o_orderkey, o_custkey, c_name FROM orders JOIN customer ON c_custkey = o_custkey")
def util_checked_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    o, c = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer").withColumnRenamed("c_custkey", "o_custkey")
    one = checks.one_to_one(c.select("o_custkey"), c.select("o_custkey", "c_name"), "o_custkey")
    return relational.join_all(o, one, "o_custkey").select("o_orderkey", "o_custkey", "c_name")


@query("SELECT l_orderkey, array_length(list(l_linenumber)) = max(l_linenumber) AND min(l_linenumber) = 1 AND count(DISTINCT l_linenumber) = count(*) AS whole, count(DISTINCT l_returnflag) = 1 AS same FROM lineitem GROUP BY 1")
def util_set_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    l = table(spark, sf_dir, "lineitem")
    whole = l.groupBy("l_orderkey").agg(F.collect_list(F.col("l_linenumber").cast("int")).alias("v")).select("l_orderkey", checks.permutes(F.col("v"), F.array_max("v")).alias("whole"))
    same = checks.all_equal(l, ["l_orderkey"], ["l_returnflag"]).withColumnRenamed("l_returnflag", "same")
    return whole.join(same, "l_orderkey")


@query("SELECT user_id, event_id, last_value(CASE WHEN event_type = 'view' THEN event_id END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS head FROM events")
def util_carried(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relational.carried(table(spark, sf_dir, "events").withColumn("h", F.when(F.col("event_type") == "view", F.col("event_id"))), ["user_id"], ["ts", "event_id"], "h", "head").select("user_id", "event_id", "head")


@query("SELECT c_custkey, printf('%.4f', c_acctbal) AS c_acctbal, CASE WHEN c_custkey % 7 = 0 THEN '' ELSE printf('%.4f', c_acctbal / 3) END AS third FROM customer")
def snk_fixed(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "customer").select("c_custkey", "c_acctbal", F.when(F.col("c_custkey") % 7 != 0, F.col("c_acctbal") / 3).alias("third"))
    return sinks.fixed(rows)


@query("SELECT DISTINCT p_type AS family, p_name AS seq_id, '>' || p_name || chr(10) || regexp_replace(p_brand || p_type, '(.{10})', '\\1' || chr(10), 'g') AS value FROM part")
def snk_fasta(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "part").select(F.col("p_type").alias("family"), F.col("p_name").alias("seq_id"), F.concat("p_brand", "p_type").alias("s"))
    return sinks.fasta_records(rows, "family", "seq_id", "s", 10)


@query("SELECT l_orderkey, coalesce(string_agg(CASE WHEN l_linenumber <= 2 THEN 'ATOM  ' || CAST(l_partkey AS varchar) || chr(10) END, '' ORDER BY l_linenumber, CAST(l_partkey AS varchar)), '') || 'TER' || chr(10) || coalesce(string_agg(CASE WHEN l_linenumber > 2 THEN 'HETATM' || CAST(l_partkey AS varchar) || chr(10) END, '' ORDER BY l_linenumber, CAST(l_partkey AS varchar)), '') || 'END' AS value FROM lineitem GROUP BY 1")
def snk_complex(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", F.col("l_linenumber").alias("line_no"), F.concat(F.lit("ATOM  "), F.col("l_partkey").cast("string")).alias("line"))
    return sinks.complex_lines(rows.where("line_no <= 2"), rows.where("line_no > 2"), "l_orderkey")


@query("SELECT l_orderkey AS k, l_suppkey % 10 AS name, CASE WHEN count(*) FILTER (WHERE l_returnflag = 'R') > 0 THEN max(l_quantity) FILTER (WHERE l_returnflag = 'R') ELSE max(l_quantity) END AS q FROM lineitem GROUP BY 1, 2")
def snk_merged_residue(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("k"), (F.col("l_suppkey") % 10).cast("string").alias("name"), "l_quantity", "l_returnflag")
    rows = order.spread(rows, ["k", "name"])
    part = lambda c: rows.where(c).groupBy("k", "name").agg(F.max("l_quantity").alias("q"))
    merged = sinks.merged_residue(part("l_returnflag <> 'R'"), part("l_returnflag = 'R'"), ["k"])
    return merged.select("k", F.col("name").cast("bigint").alias("name"), "q")


@query("SELECT s_suppkey, 'out/' || trim(regexp_replace(s_name, '[^A-Za-z0-9._-]+', '_', 'g'), '_') || '__' || CAST(s_nationkey AS varchar) || '__rank' || lpad(CAST(s_suppkey % 50 AS varchar), 2, '0') || '__' || CAST(s_suppkey AS varchar) || '.sdf' AS destination FROM supplier")
def snk_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "supplier").select("s_suppkey", "s_name", F.col("s_nationkey").cast("string").alias("n"), (F.col("s_suppkey") % 50).cast("int").alias("rank"), F.concat(F.lit("in/"), F.col("s_suppkey").cast("string"), F.lit(".sdf")).alias("path"))
    found = sinks.copies(rows, "out", "s_name", "n", "rank", "path")
    return found.select(F.regexp_extract("source", "([0-9]+)", 1).cast("bigint").alias("s_suppkey"), "destination")


@query("SELECT DISTINCT p_brand AS motif, substr('([{', CAST(p_size % 3 + 1 AS int), 1) || p_type AS pattern FROM part WHERE p_size % 3 < 2")
def util_no_pattern(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Patterns that do not compile, each a row of its own: those of an open bracket, not those of a brace."""
    opening = F.substring(F.lit("([{"), (F.col("p_size") % 3 + 1).cast("int"), F.lit(1))
    library = table(spark, sf_dir, "part").select(F.col("p_brand").alias("motif"), F.concat(opening, "p_type").alias("pattern"), F.lit(False).alias("literal")).distinct()
    return motifs.faults(library).select("motif", "pattern")


@query("SELECT l_suppkey, count(*) n, round(stddev_pop(l_tax) FILTER (WHERE i <= k), 6) AS first_std, round(stddev_pop(l_tax) FILTER (WHERE i > n0 - k), 6) AS last_std FROM (SELECT *, greatest(3, floor(n0 * 0.2)) k FROM (SELECT l_suppkey, l_tax, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, l_partkey, l_extendedprice) i, count(*) OVER (PARTITION BY l_suppkey) n0 FROM lineitem)) GROUP BY 1")
def rec_slice_deviation(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = summaries.slices(table(spark, sf_dir, "lineitem"), ["l_suppkey"], ["l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice"], "l_tax")
    return found.select("l_suppkey", "n", r6("first_std").alias("first_std"), r6("last_std").alias("last_std"))
