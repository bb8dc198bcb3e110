"""Queries of the motif table, tree, projection, block and screening operators over the shared tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import order, sequences, tables
from ..operators import axes, docking, geometry, motifs, selection, summaries, trees
from ..sources import structures, text_tables
from .catalogue import query, r6, table

_MOTIF_ROWS = "SELECT DISTINCT 'L' || item_id motif, substr(text, 1, 4) p, true lit FROM benchmark UNION SELECT DISTINCT 'P' || item_id, regexp_replace(lower(substr(text, 1, 5)), '[^a-z]', '.', 'g') || '?[a-z]', false FROM benchmark"


@query(
    f"WITH m AS ({_MOTIF_ROWS}), t AS (SELECT item_id, text, unnest(range(1, CAST(length(text) AS bigint) + 1)) s FROM benchmark), h AS (SELECT item_id, motif, s, CASE WHEN lit THEN CASE WHEN substr(text, s, 4) = p THEN p ELSE '' END ELSE regexp_extract(substr(text, s, 6), '^(?:' || p || ')', 0, 'i') END hit FROM t, m) "
    'SELECT item_id, motif, CAST(s AS int) AS start, CAST(s + length(hit) - 1 AS int) AS "end", hit FROM h WHERE hit <> \'\''
)
def ann_motif_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Heads of the benchmark items, as written and as patterns, in all items by one scan."""
    items = table(spark, sf_dir, "benchmark")
    head = F.regexp_replace(F.lower(F.substring("text", 1, 5)), "[^a-z]", ".")
    literal = items.select(F.concat(F.lit("L"), F.col("item_id").cast("string")).alias("motif"), F.substring("text", 1, 4).alias("pattern"), F.lit(True).alias("literal"))
    pattern = items.select(F.concat(F.lit("P"), F.col("item_id").cast("string")).alias("motif"), F.concat(head, F.lit("?[a-z]")).alias("pattern"), F.lit(False).alias("literal"))
    return motifs.scan(items, literal.unionByName(pattern), "item_id", "text")


@query("SELECT p_partkey, CASE WHEN starts_with(b, 'BRAND#1') THEN b WHEN b <> '' THEN b ELSE 'Unspecified' END family FROM (SELECT p_partkey, trim(regexp_extract(p_brand, '^[^_ -]*')) b FROM part)")
def ann_motif_family(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", motifs.family(F.col("p_brand"), F.col("p_type")).alias("family"))


@query("SELECT d.lang, count(*) n, count(h.doc_id) AS hit, CAST(sum(coalesce(h.k, 0)) AS bigint) AS hits FROM documents d LEFT JOIN (SELECT doc_id, count(*) k FROM labels WHERE quality = 1 GROUP BY 1) h USING (doc_id) GROUP BY 1")
def ann_family_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sequences of each family, those with a hit (each once), and the hits."""
    hits = table(spark, sf_dir, "labels").where("quality = 1").groupBy("doc_id").agg(F.count("*").alias("k"))
    joined = table(spark, sf_dir, "documents").select("doc_id", "lang").join(hits, "doc_id", "left")
    return joined.groupBy("lang").agg(F.count("*").alias("n"), F.count("k").alias("hit"), F.sum(F.coalesce("k", F.lit(0))).alias("hits"))


# --- trees: region, nation, customer as three levels ----------------------------------------------

_TREE = (
    "SELECT CAST(0 AS bigint) node, CAST(NULL AS bigint) parent, 0.0 length, NULL::double support UNION ALL SELECT 1 + r_regionkey, 0, 1.0 + r_regionkey, 60.0 FROM region "
    "UNION ALL SELECT 100 + n_nationkey, 1 + n_regionkey, 0.5 + n_nationkey / 10, n_nationkey * 4.0 FROM nation UNION ALL SELECT 1000 + c_custkey, 100 + c_nationkey, 0.25, NULL FROM customer"
)


def taxonomy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers below their nations below their regions, as one tree."""
    null, text = F.lit(None), lambda c: F.col(c).cast("string")
    row = lambda df, node, parent, length, label, support: df.select(F.lit("t").alias("tree"), node.cast("long").alias("node"), parent.cast("long").alias("parent"), length.cast("double").alias("length"), label.alias("label"), support.cast("double").alias("support"))
    r, n, c = (table(spark, sf_dir, t) for t in ("region", "nation", "customer"))
    parts = [
        row(r.agg(F.lit(0).alias("z")), F.col("z"), null, F.lit(0.0), F.lit(""), null),
        row(r, 1 + F.col("r_regionkey"), F.lit(0), 1.0 + F.col("r_regionkey"), F.col("r_name"), F.lit(60.0)),
        row(n, 100 + F.col("n_nationkey"), 1 + F.col("n_regionkey"), 0.5 + F.col("n_nationkey") / 10, F.col("n_name"), F.col("n_nationkey") * 4.0),
        row(c, 1000 + F.col("c_custkey"), 100 + F.col("c_nationkey"), F.lit(0.25), text("c_custkey"), null),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


_LEAVES = f"WITH t AS ({_TREE}), l AS (SELECT node FROM t WHERE node NOT IN (SELECT parent FROM t WHERE parent IS NOT NULL)), a AS (SELECT t.node leaf, t.node n0, t.parent n1, u.parent n2, v.parent n3 FROM t LEFT JOIN t u ON u.node = t.parent LEFT JOIN t v ON v.node = u.parent WHERE t.node IN (SELECT node FROM l)), k AS (SELECT node, count(*) leaves FROM (SELECT leaf, unnest([n0, n1, n2, n3]) node FROM a) WHERE node IS NOT NULL GROUP BY 1)"


@query(_LEAVES + " SELECT t.node, leaves, CAST(row_number() OVER (PARTITION BY t.parent ORDER BY leaves, t.node) AS int) AS place FROM t JOIN k ON k.node = t.node")
def tree_ladder(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trees.ladderized(taxonomy(spark, sf_dir)).select("node", "leaves", "place")


@query(f"WITH t AS ({_TREE}), x AS (SELECT node, length, parent FROM t WHERE node >= 100 AND node < 1000 AND support < 50 AND node IN (SELECT parent FROM t)) SELECT t.node, coalesce(x.parent, t.parent) parent, round(t.length + coalesce(x.length, 0), 6) length FROM t LEFT JOIN x ON x.node = t.parent WHERE t.node NOT IN (SELECT node FROM x)")
def tree_collapsed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trees.collapsed(taxonomy(spark, sf_dir), 50.0).select("node", "parent", r6("length").alias("length"))


@query(None)
def tree_midpoint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The taxonomy rooted in the middle of its longest path; tests hold rooting against a recursive version."""
    return trees.midpoint_rooted(taxonomy(spark, sf_dir)).select("node", "parent", r6("length").alias("length"))


# --- clusters and projections ---------------------------------------------------------------------


@query(None)
def clu_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors on their two axes of greatest variance; the test holds them against numpy."""
    return axes.project(table(spark, sf_dir, "embeddings"), "vec_id", "embedding").select("vec_id", r6("pc1").alias("pc1"), r6("pc2").alias("pc2"))


_NESTED = "SELECT l_orderkey, l_linenumber, l_returnflag his, l_suppkey % 10 lig, l_extendedprice sc, nullif(l_discount, 0) lb FROM lineitem"


def nested(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_returnflag").alias("his"), (F.col("l_suppkey") % 10).alias("lig"), F.col("l_extendedprice").alias("sc"), F.nullif(F.col("l_discount"), F.lit(0.0)).alias("lb"))


@query(f"SELECT his, lig, count(*) AS size FROM ({_NESTED}) GROUP BY 1, 2")
def clu_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return docking.cluster_sizes(nested(spark, sf_dir), "his", "lig")


@query(f"SELECT his, lig, l_orderkey, l_linenumber, size FROM (SELECT *, row_number() OVER (PARTITION BY his, lig ORDER BY sc, lb NULLS LAST, l_orderkey, l_linenumber) i, count(*) OVER (PARTITION BY his, lig) AS size FROM ({_NESTED})) WHERE i = 1")
def clu_representatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = docking.combined_representatives(nested(spark, sf_dir), ["his", "lig"], ["sc", "lb", "l_orderkey", "l_linenumber"])
    return found.select("his", "lig", "l_orderkey", "l_linenumber", "size")


# --- screening ------------------------------------------------------------------------------------

_THREE = (
    "WITH v AS (SELECT l_suppkey k, avg(l_quantity) va, avg(l_tax) vr FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1), d AS (SELECT s_suppkey k, s_acctbal dp FROM supplier WHERE s_acctbal > 0), "
    "c AS (SELECT l_suppkey k, max(l_discount) cc FROM lineitem WHERE l_quantity > 49 GROUP BY 1), j AS (SELECT coalesce(v.k, d.k, c.k) k, va, vr, dp, cc FROM v FULL JOIN d ON v.k = d.k FULL JOIN c ON coalesce(v.k, d.k) = c.k), m AS (SELECT median(va) a, median(vr) b, median(dp) e, median(cc) f FROM j), "
    "s AS (SELECT k, 0.45 * coalesce(cc, f, 0.5) + 0.30 * coalesce(va, a, 0.5) + 0.15 * coalesce(dp, e, 0.5) + 0.10 * coalesce(vr, b, 0.5) x FROM j, m)"
)


@query(_THREE + " SELECT k, round(x, 6) score, row_number() OVER (ORDER BY round(x, 9) DESC, k) AS rank FROM s")
def dock_final_screen(spark: SparkSession, sf_dir: str) -> DataFrame:
    l = table(spark, sf_dir, "lineitem").withColumnRenamed("l_suppkey", "k")
    v = l.where("l_returnflag = 'R'").groupBy("k").agg(F.avg("l_quantity").alias("vina_affinity"), F.avg("l_tax").alias("vina_rmsd"))
    d = table(spark, sf_dir, "supplier").where("s_acctbal > 0").select(F.col("s_suppkey").alias("k"), F.col("s_acctbal").alias("diffdock_pose"))
    c = l.where("l_quantity > 49").groupBy("k").agg(F.max("l_discount").alias("ceh_catalytic"))
    return docking.final_screen(v, d, c, "k", selection.SCREEN_SITE, "score").select("k", r6("score").alias("score"), F.col("Rank").alias("rank"))


_ATOMS = "SELECT vec_id id, label, embedding[1]::double x, embedding[2]::double y, embedding[3]::double z FROM embeddings"


@query(f"WITH p AS ({_ATOMS}) SELECT o.label, o.id, count(n.id) n_held FROM p o LEFT JOIN p n ON n.label = o.label AND n.id % 2 = 0 AND sqrt((o.x - n.x) ** 2 + (o.y - n.y) ** 2 + (o.z - n.z) ** 2) BETWEEN 0.1 AND 0.2 WHERE o.id % 2 = 1 GROUP BY 1, 2")
def dock_oxyanions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Atoms of odd ids as oxygens, those of even ids as nitrogens."""
    p = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "label", *[F.col("embedding")[i].cast("double").alias(c) for i, c in enumerate("xyz")])
    return docking.held_oxyanions(p.where("id % 2 = 0"), p.where("id % 2 = 1"), "label", 0.1, 0.2)


@query(f"WITH p AS ({_ATOMS}) SELECT a.label, a.id % 7 AS residue, round(min(sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2 + (a.z - b.z) ** 2)), 6) AS least FROM p a JOIN p b ON a.label = b.label AND a.id % 2 = 0 AND b.id % 2 = 1 AND sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2 + (a.z - b.z) ** 2) <= 0.15 GROUP BY 1, 2")
def dock_residue_contacts(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "label", (F.col("vec_id") % 7).alias("residue"), *[F.col("embedding")[i].cast("double").alias(c) for i, c in enumerate("xyz")])
    found = docking.residue_contacts(p.where("id % 2 = 0"), p.where("id % 2 = 1").drop("residue"), "label", "residue", 0.15)
    return found.select("label", "residue", r6("MinDistance").alias("least"))


@query("SELECT c_custkey, 'runs/' || c_mktsegment || '/' || c_custkey || '.pdbqt' AS path FROM customer")
def dock_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select("c_custkey", docking.from_template("runs/{protein}/{ligand}.pdbqt", {"protein": "c_mktsegment", "ligand": F.col("c_custkey").cast("string")}).alias("path"))


# --- tables ---------------------------------------------------------------------------------------


@query("WITH f AS (SELECT p_brand k, p_name || CASE p_size % 4 WHEN 0 THEN '.CIF' WHEN 1 THEN '.json' WHEN 2 THEN '.npz' ELSE '.log' END p FROM part) SELECT k AS key, " + ", ".join(f"coalesce(string_agg(p, ';' ORDER BY p) FILTER (WHERE lower(p) LIKE '%{e}'), '') AS {n}" for n, e in (("structures", ".cif"), ("jsons", ".json"), ("npzs", ".npz"))) + " FROM f WHERE p NOT LIKE '%.log' GROUP BY 1")
def str_file_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    ending = F.element_at(F.array(*map(F.lit, (".CIF", ".json", ".npz", ".log"))), (F.col("p_size") % 4 + 1).cast("int"))
    found = structures.grouped_files(table(spark, sf_dir, "part").select("p_brand", F.concat("p_name", ending).alias("path")), F.col("p_brand"))
    return found.select("key", *[F.array_join(c, ";").alias(c) for c in structures.KINDS])


@query("SELECT o_orderkey, CAST(row_number() OVER (ORDER BY x DESC NULLS LAST, o_orderkey) AS bigint) AS place FROM (SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN NULL ELSE o_totalprice END x FROM orders)")
def str_ranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scored rows first, by falling score, then the others."""
    score = F.when(F.col("o_orderstatus") != "F", F.col("o_totalprice"))
    rows = table(spark, sf_dir, "orders").select("o_orderkey", score.isNull().alias("_none"), (-score).alias("_down"))
    return order.row_numbers(rows, ["_none", "_down", "o_orderkey"], "place").select("o_orderkey", "place")


@query("SELECT 'model_' || row_number() OVER (ORDER BY s_suppkey) AS model, s_suppkey FROM supplier")
def util_named(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.named(table(spark, sf_dir, "supplier"), "model", ["s_suppkey"]).select("model", "s_suppkey")


@query("WITH r AS (SELECT o_orderpriority sheet, o_orderkey row_no, o_custkey a, o_totalprice b FROM orders) SELECT sheet, 'S1' AS system, row_no, CAST(a AS varchar) AS id, CAST(CAST(round(b) AS bigint) AS varchar) AS value FROM r UNION ALL SELECT sheet, 'S2', row_no, CAST(a + 1 AS varchar), NULL FROM r WHERE a % 2 = 0")
def md_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sheets with two header rows, made of the orders: two whole blocks and one that lacks its columns."""
    o = table(spark, sf_dir, "orders")
    text = lambda c: c.cast("string")
    second = F.when(F.col("o_custkey") % 2 == 0, text(F.col("o_custkey") + 1))
    data = o.select(F.col("o_orderpriority").alias("sheet"), (F.col("o_orderkey") + 2).alias("row_no"), F.array(text(F.col("o_custkey")), text(F.round("o_totalprice").cast("long")), F.lit("x"), second, F.lit(None).cast("string"), F.lit("7")).alias("values"))
    sheets = o.select(F.col("o_orderpriority").alias("sheet")).distinct()
    lit = lambda cells: F.array(*[F.lit(c).cast("string") for c in cells])
    heads = [sheets.select("sheet", F.lit(i).cast("long").alias("row_no"), lit(cells).alias("values")) for i, cells in enumerate((("S1", None, "Unnamed: 2", "S2", " ", "S3"), ("id", "value", "other", "id", "value", "id")))]
    found = text_tables.block_rows(heads[0].unionByName(heads[1]).unionByName(data), ["id", "value"])
    return found.withColumn("row_no", F.col("row_no") - 2)


@query("WITH d AS (SELECT event_id, user_id k, epoch(ts) t FROM events) SELECT event_id, row_number() OVER (PARTITION BY k ORDER BY t, event_id) AS n FROM d")
def util_numbered(spark: SparkSession, sf_dir: str) -> DataFrame:
    return order.numbered(table(spark, sf_dir, "events"), ["user_id"], ["ts", "event_id"], "n").select("event_id", "n")



# --- geometry and sequences -----------------------------------------------------------------------

_V = "SELECT vec_id, [embedding[i]::double for i in range(1, 4)] a, [embedding[i]::double for i in range(4, 7)] b FROM embeddings"


@query(f"SELECT vec_id, round(degrees(acos(greatest(-1, least(1, list_dot_product(a, b) / nullif(sqrt(list_dot_product(a, a)) * sqrt(list_dot_product(b, b)), 0))))), 6) AS angle FROM ({_V})")
def geo_angle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The angle between the first three and the next three components."""
    e = table(spark, sf_dir, "embeddings")
    part = lambda first: [F.col("embedding")[i].cast("double") for i in range(first, first + 3)]
    return e.select("vec_id", r6(geometry.angle(part(0), part(3))).alias("angle"))


_MODELS = "SELECT vec_id, [{'x': embedding[3 * i + 1]::double, 'y': embedding[3 * i + 2]::double, 'z': embedding[3 * i + 3]::double} for i in range(0, 10)] p, [{'x': embedding[3 * i + 31]::double, 'y': embedding[3 * i + 32]::double, 'z': embedding[3 * i + 33]::double} for i in range(0, 10)] q FROM embeddings"
_CENTRED = "(p[i].{0} - list_avg([u.{0} for u in p])) - (q[i].{0} - list_avg([u.{0} for u in q]))"


@query(
    f"WITH r AS (SELECT vec_id, sqrt(list_avg([({_CENTRED.format('x')}) ** 2 + ({_CENTRED.format('y')}) ** 2 + ({_CENTRED.format('z')}) ** 2 for i in range(1, 11)])) r FROM ({_MODELS})) "
    "SELECT vec_id, round(r, 6) rmsd, round((8 / sqrt(10.0 * 12)) / (1 + (r / 3) ** 2), 6) q FROM r"
)
def geo_centred(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distance of two halves of a vector, read as ten points each, about their centres; and the Q-score it gives."""
    point = lambda i: F.struct(*[F.col("embedding")[i + k].cast("double").alias(c) for k, c in enumerate("xyz")])
    halves = [F.array(*[point(first + 3 * i) for i in range(10)]) for first in (0, 30)]
    rows = table(spark, sf_dir, "embeddings").select("vec_id", geometry.centred_rmsd(*halves).alias("r"))
    return rows.select("vec_id", r6("r").alias("rmsd"), r6(geometry.q_score(F.lit(8.0), F.lit(10.0), F.lit(12.0), F.col("r"))).alias("q"))


@query("WITH c AS (SELECT pos, upper(substr(text, pos, 1)) c FROM (SELECT text, unnest(range(1, CAST(length(text) AS bigint) + 1)) pos FROM benchmark)) SELECT CAST(pos AS int) AS pos, count(*) n, count(*) FILTER (WHERE c IN ('-', '.')) gaps, " + ", ".join(f"count(*) FILTER (WHERE c = '{x}') AS \"{x}\"" for x in "ACDE") + " FROM c GROUP BY 1")
def ann_column_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return summaries.column_counts(table(spark, sf_dir, "benchmark"), "text", "ACDE").withColumn("pos", F.col("pos").cast("int"))


@query("WITH e AS (SELECT vec_id, unnest(embedding)::double v, generate_subscripts(embedding, 1) i FROM embeddings), m AS (SELECT vec_id, i, avg(v) OVER w m FROM e WINDOW w AS (PARTITION BY vec_id ORDER BY i ROWS BETWEEN CURRENT ROW AND 8 FOLLOWING)) SELECT vec_id, CAST(i AS int) AS i, round(coalesce(CASE WHEN i <= 56 THEN m END, max(CASE WHEN i = 56 THEN m END) OVER (PARTITION BY vec_id)), 6) AS mean FROM m")
def ann_padded_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Means of nine components from each one on; the last full window stands for those after it."""
    means = sequences.padded_means(F.col("embedding"), 9)
    rows = table(spark, sf_dir, "embeddings").select("vec_id", F.posexplode(means).alias("i", "mean"))
    # Rounding in Spark drops the sign of a negative mean that becomes zero; SQL's keeps it.
    mean = F.when((F.col("mean") < 0) & (r6("mean") == 0), F.lit(-0.0)).otherwise(r6("mean"))
    return rows.select("vec_id", (F.col("i") + 1).alias("i"), mean.alias("mean"))
