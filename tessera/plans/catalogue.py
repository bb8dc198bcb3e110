"""The engine's queries over the shared tables, each with its SQL twin."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scaling, scan
from ..operators import clusters, geometry, motifs, relational, selection, summaries

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def r6(c: Column | str) -> Column:
    return F.round(c, 6)


def rounded(df: DataFrame, *keep: str) -> DataFrame:
    return df.select(*keep, *[r6(c).alias(c) for c in df.columns if c not in keep])


HITS = "SELECT o.o_orderpriority species, p.p_type family, l.l_orderkey protein FROM lineitem l JOIN part p ON p.p_partkey = l.l_partkey JOIN orders o ON o.o_orderkey = l.l_orderkey WHERE l.l_discount <= 0.03"


def hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    l, p, o = (table(spark, sf_dir, t) for t in ("lineitem", "part", "orders"))
    found = l.where(F.col("l_discount") <= 0.03).join(p, F.col("l_partkey") == F.col("p_partkey"))
    return found.join(o, F.col("l_orderkey") == F.col("o_orderkey")).select(F.col("o_orderpriority").alias("species"), F.col("p_type").alias("family"), F.col("l_orderkey").alias("protein"))


@query(f"SELECT DISTINCT species, family, protein FROM ({HITS})")
def cur_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hits(spark, sf_dir).distinct()


@query(f"SELECT species, family, count(DISTINCT protein) candidate_count FROM ({HITS}) GROUP BY 1, 2")
def cur_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hits(spark, sf_dir).groupBy("species", "family").agg(F.countDistinct("protein").alias("candidate_count"))


@query("SELECT count(*) n, coalesce(string_agg(k, ';' ORDER BY c) FILTER (WHERE i <= 5), '') AS first_five FROM (SELECT c_custkey c, CAST(c_custkey AS varchar) k, row_number() OVER (ORDER BY c_custkey) i FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders))")
def cur_missing_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    gone = relational.missing_keys(table(spark, sf_dir, "customer"), table(spark, sf_dir, "orders"), "c_custkey", "o_custkey").select("c_custkey")
    five = gone.orderBy("c_custkey").limit(5).agg(F.array_join(F.transform(F.array_sort(F.collect_list("c_custkey")), lambda x: x.cast("string")), ";").alias("first_five"))
    return gone.agg(F.count("*").alias("n")).crossJoin(F.broadcast(five))


MOTIFS = (("pair", "th[a-z]"), ("glyco", "n[^e][st]"), ("double", "(?:ee|oo|ss)"))
MOTIF_SQL = " UNION ALL ".join(f"SELECT '{k}' motif, '^(?:{p})' p" for k, p in MOTIFS)


@query(f"SELECT item_id, motif, CAST(s AS int) AS start, CAST(s + length(h) - 1 AS int) AS \"end\", h hit FROM (SELECT item_id, motif, s, regexp_extract(substring(t, s), p, 0, 'i') h FROM (SELECT item_id, motif, p, text t, unnest(range(1, CAST(length(text) AS bigint) + 1)) s FROM benchmark, ({MOTIF_SQL}))) WHERE h <> ''")
def ann_motif_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    library = spark.createDataFrame([(k, p, False) for k, p in MOTIFS], "motif string, pattern string, literal boolean")
    return motifs.scan(table(spark, sf_dir, "benchmark"), library, "item_id", "text")


@query("SELECT item_id, CAST(s AS int) AS start FROM (SELECT item_id, text t, unnest(range(1, CAST(length(text) AS bigint) + 1)) s FROM benchmark) WHERE substring(t, s, 2) = 'ee'")
def ann_literal_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = table(spark, sf_dir, "benchmark").select("item_id", F.col("text").alias("t"))
    return scan.literal(text, "t", "ee").select("item_id", F.col("start").cast("int").alias("start"))


@query("SELECT item_id, array_to_string(regexp_extract_all(text, 'th[a-z]'), ';') hits FROM benchmark")
def ann_regex_nonoverlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select("item_id", F.array_join(scan.successive(F.col("text"), "th[a-z]"), ";").alias("hits"))


@query("SELECT d.lang, count(*) n, round(avg(d.n_chars), 2) mean_length, CAST(sum(coalesce(l.toxic, 0)) AS bigint) flagged, count(l.doc_id) labelled FROM documents d LEFT JOIN labels l USING (doc_id) GROUP BY 1")
def ann_family_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id", "lang", "n_chars")
    joined = d.join(table(spark, sf_dir, "labels").withColumn("seen", F.lit(1)), "doc_id", "left")
    return joined.groupBy("lang").agg(F.count("*").alias("n"), F.round(F.avg("n_chars"), 2).alias("mean_length"), F.sum(F.coalesce("toxic", F.lit(0))).cast("bigint").alias("flagged"), F.count("seen").alias("labelled"))


@query("WITH c AS (SELECT pos, c, count(*) k FROM (SELECT i pos, substring(text, i, 1) c FROM (SELECT text, unnest(range(1, CAST(length(text) AS bigint) + 1)) i FROM benchmark)) WHERE c <> '' GROUP BY 1, 2) SELECT CAST(pos AS int) AS pos, CAST(sum(k) AS bigint) n, round(max(k) / sum(k), 6) frequency, round(log2(sum(k)) - sum(k * log2(k)) / sum(k), 6) entropy FROM c GROUP BY 1")
def ann_column_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(summaries.column_profile(table(spark, sf_dir, "benchmark"), "text"), "pos", "n")


@query("WITH a AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) p, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) q FROM events), b AS (SELECT *, sum(CASE WHEN q = event_type THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY p) r FROM a) SELECT user_id, event_type, CAST(min(p) AS int) AS start, CAST(max(p) AS int) AS \"end\", CAST(count(*) AS int) length FROM b GROUP BY user_id, event_type, r")
def ann_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relational.runs(table(spark, sf_dir, "events"), ["user_id"], ["ts", "event_id"], "event_type").select("user_id", "event_type", *[F.col(c).cast("int").alias(c) for c in ("start", "end", "length")])


@query("WITH a AS (SELECT user_id, CAST(floor(epoch(ts)) AS bigint) s FROM events), b AS (SELECT *, s + 600 e, max(s + 600) OVER (PARTITION BY user_id ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) m FROM a), c AS (SELECT *, sum(CASE WHEN s <= m + 120 THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY s ROWS UNBOUNDED PRECEDING) g FROM b) SELECT user_id, min(s) s, max(e) e, count(*) n FROM c GROUP BY user_id, g")
def ann_merge_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").select("user_id", F.unix_seconds(F.col("ts").cast("timestamp")).alias("s"))
    return relational.merge_ranges(events.withColumn("e", F.col("s") + 600), ["user_id"], "s", "e", 120)


@query("WITH a AS (SELECT user_id, row_number() OVER w pos, avg(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN CURRENT ROW AND 18 FOLLOWING) m, count(*) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN CURRENT ROW AND 18 FOLLOWING) n FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)), b AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY m DESC, pos) k FROM a WHERE n = 19) SELECT user_id, round(m, 6) best, CAST(pos AS int) AS start FROM b WHERE k = 1")
def ann_window_max(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = relational.moving_max(table(spark, sf_dir, "events"), ["user_id"], ["ts", "event_id"], "value", 19)
    return rounded(found, "user_id", "start")


@query("WITH o AS (SELECT l_orderkey, avg(l_extendedprice) m FROM lineitem GROUP BY 1), c AS (SELECT o_custkey, avg(m) m FROM o JOIN orders ON l_orderkey = o_orderkey GROUP BY 1) SELECT n_name, round(avg(m), 6) mean_of_means FROM c JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey GROUP BY 1")
def str_means_of_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    l, o, c, n = (table(spark, sf_dir, t) for t in ("lineitem", "orders", "customer", "nation"))
    by_order = l.groupBy("l_orderkey").agg(F.avg("l_extendedprice").alias("m"))
    by_customer = by_order.join(o, F.col("l_orderkey") == F.col("o_orderkey")).groupBy("o_custkey").agg(F.avg("m").alias("m"))
    named = by_customer.join(c, F.col("o_custkey") == F.col("c_custkey")).join(n, F.col("c_nationkey") == F.col("n_nationkey"))
    return named.groupBy("n_name").agg(r6(F.avg("m")).alias("mean_of_means"))


@query("SELECT p_partkey, CASE WHEN x IS NULL THEN 'unknown' WHEN x >= 95 THEN 'very high' WHEN x >= 92 THEN 'confident' WHEN x >= 91 THEN 'low' ELSE 'very low' END band FROM (SELECT p_partkey, CASE WHEN p_size = 1 THEN NULL ELSE p_retailprice / 10 END x FROM part)")
def str_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = F.when(F.col("p_size") != 1, F.col("p_retailprice") / 10)
    return table(spark, sf_dir, "part").select("p_partkey", scaling.band(x, [(95, "very high"), (92, "confident"), (91, "low")], "very low", "unknown").alias("band"))


@query("SELECT l_orderkey, l_linenumber, round((coalesce(a * 0.35, 0) + coalesce(b * 0.25, 0) + coalesce(c * 0.1, 0)) / nullif((CASE WHEN a IS NULL THEN 0 ELSE 0.35 END) + (CASE WHEN b IS NULL THEN 0 ELSE 0.25 END) + (CASE WHEN c IS NULL THEN 0 ELSE 0.1 END), 0), 6) score FROM (SELECT l_orderkey, l_linenumber, nullif(l_tax, 0) a, nullif(l_discount, 0) b, nullif(l_quantity, 1) c FROM lineitem)")
def str_quality_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", *[F.nullif(F.col(c), F.lit(v)).alias(n) for c, v, n in (("l_tax", 0.0, "a"), ("l_discount", 0.0, "b"), ("l_quantity", 1.0, "c"))])
    return rows.select("l_orderkey", "l_linenumber", r6(scaling.weighted_mean({"a": 0.35, "b": 0.25, "c": 0.1})).alias("score"))


@query("SELECT p_brand, p_brand || '_' || substring(md5(string_agg(p_name, '|' ORDER BY p_name)), 1, 6) id FROM part GROUP BY 1")
def str_stable_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    grouped = table(spark, sf_dir, "part").groupBy("p_brand").agg(F.collect_list("p_name").alias("names"))
    return grouped.select("p_brand", scan.stable_id(F.col("p_brand"), F.col("names")).alias("id"))


@query("SELECT vec_id, CAST(i - 1 AS int) dim, embedding[i] AS value FROM (SELECT vec_id, embedding, unnest(range(1, 65)) i FROM embeddings)")
def str_matrix_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select("vec_id", F.posexplode("embedding").alias("dim", "value"))


def scale_sql(source: str, key: str, x: str, policy: str) -> str:
    value = "x" if policy == "keep_null" else "coalesce(x, (SELECT median(x) FROM a))"
    last = "0.5" if policy == "impute_median_or_half" else "NULL"
    return f"WITH a AS (SELECT {key}, {x} x FROM {source}), b AS (SELECT {key}, {value} x FROM a), s AS (SELECT quantile_cont(x, 0.05) lo, quantile_cont(x, 0.95) hi FROM b) SELECT {key}, round(CASE WHEN x IS NULL THEN {last} WHEN hi = lo THEN 0.5 ELSE least(greatest((x - lo) / nullif(hi - lo, 0), 0), 1) END, 6) scaled FROM b, s"


@query(scale_sql("part", "p_partkey", "CASE WHEN p_size = 1 THEN NULL ELSE p_retailprice END", "keep_null"))
def sel_robust_scale_keepnull(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "part").select("p_partkey", F.when(F.col("p_size") != 1, F.col("p_retailprice")).alias("x"))
    return rounded(scaling.robust_scale(rows, "x", "scaled").drop("x"), "p_partkey")


@query(scale_sql("customer", "c_custkey", "CASE WHEN c_nationkey = 1 THEN NULL ELSE c_acctbal END", "impute_median"))
def sel_robust_scale_impute(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "customer").select("c_custkey", F.when(F.col("c_nationkey") != 1, F.col("c_acctbal")).alias("x"))
    return rounded(scaling.robust_scale(rows, "x", "scaled", policy="impute_median").drop("x"), "c_custkey")


@query(scale_sql("supplier", "s_suppkey", "CAST(NULL AS double)", "impute_median_or_half"))
def sel_robust_scale_impute_half(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "supplier").select("s_suppkey", F.lit(None).cast("double").alias("x"))
    return rounded(scaling.robust_scale(rows, "x", "scaled", policy="impute_median_or_half").drop("x"), "s_suppkey")


@query("SELECT c_custkey, round(least(greatest(1 - abs(c_acctbal) / nullif(h, 0), 0), 1), 6) close FROM customer, (SELECT quantile_cont(abs(c_acctbal), 0.95) h FROM customer)")
def sel_closeness(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(scaling.closeness(table(spark, sf_dir, "customer"), "c_acctbal", "close").select("c_custkey", "close"), "c_custkey")


@query("SELECT count(*) n, round(corr(p_size, p_retailprice), 6) r, corr(p_size, p_retailprice) > 0 lower_better FROM part")
def sel_direction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scaling.lower_is_better(table(spark, sf_dir, "part"), "p_size", "p_retailprice").select("n", r6("r").alias("r"), "lower_better")


GENERAL = "WITH m AS (SELECT l_partkey k, avg(l_discount) a, avg(l_tax) b, avg(l_quantity) q FROM lineitem GROUP BY 1), p AS (SELECT quantile_cont(a, 0.05) al, quantile_cont(a, 0.95) ah, quantile_cont(b, 0.05) bl, quantile_cont(b, 0.95) bh FROM m), s AS (SELECT k, q, 1 - least(greatest((a - al) / (ah - al), 0), 1) sa, least(greatest((b - bl) / (bh - bl), 0), 1) sb FROM m, p), t AS (SELECT k, round(100 * (0.6 * sa + 0.4 * sb) * CASE WHEN q <= 30 THEN 1 ELSE 0 END, 6) score FROM s) SELECT k part, score, CASE WHEN score >= 75 THEN 'priority' WHEN score >= 60 THEN 'retain' WHEN score >= 45 THEN 'backup' ELSE 'reject' END decision, CAST(dense_rank() OVER (ORDER BY score DESC) AS int) AS rank FROM t"


def general(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = table(spark, sf_dir, "lineitem").groupBy(F.col("l_partkey").alias("part")).agg(F.avg("l_discount").alias("a"), F.avg("l_tax").alias("b"), F.avg("l_quantity").alias("q"))
    scaled = scaling.scale_all(m, ["a", "b"], ["a"], [], ("", ()), "keep_null", "s")
    score = r6(100 * scaling.weighted_mean({"sa": 0.6, "sb": 0.4}) * scaling.gate({"q": 30.0}))
    scored = scaled.select("part", score.alias("score"))
    return scored.withColumn("decision", scaling.band(F.col("score"), [(75, "priority"), (60, "retain"), (45, "backup")], "reject"))


@query(GENERAL)
def sel_general(spark: SparkSession, sf_dir: str) -> DataFrame:
    return selection.dense_rank(general(spark, sf_dir), "score", "rank").withColumn("rank", F.col("rank").cast("int"))


@query(f"WITH g AS ({GENERAL}), f AS (SELECT g.*, p_type family FROM g JOIN part ON p_partkey = part), c AS (SELECT part, 'top' why FROM (SELECT part, row_number() OVER (ORDER BY score DESC, part) i FROM f) WHERE i <= 10 UNION SELECT part, 'family' FROM (SELECT part, row_number() OVER (PARTITION BY family ORDER BY score DESC, part) i FROM f) WHERE i = 1) SELECT part, string_agg(why, ';' ORDER BY why) classes FROM c GROUP BY 1")
def sel_representatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = general(spark, sf_dir).join(table(spark, sf_dir, "part").select(F.col("p_partkey").alias("part"), F.col("p_type").alias("family")), "part")
    order = [F.col("score").desc(), F.col("part")]
    first = scored.orderBy(*order).limit(10).select("part", F.lit("top").alias("why"))
    best = relational.top(scored, ["family"], order).select("part", F.lit("family").alias("why"))
    return first.unionByName(best).groupBy("part").agg(F.array_join(F.array_sort(F.collect_set("why")), ";").alias("classes"))


@query("WITH c AS (SELECT c_nationkey k, round(avg(c_acctbal), 6) bal, count(*) n_c FROM customer GROUP BY 1), s AS (SELECT s_nationkey k, round(avg(s_acctbal), 6) bal, count(*) n_s FROM supplier GROUP BY 1) SELECT coalesce(c.k, s.k) k, coalesce(c.bal, s.bal) bal, n_c, n_s FROM c FULL JOIN s ON c.k = s.k")
def sel_outer_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer").groupBy(F.col("c_nationkey").alias("k")).agg(r6(F.avg("c_acctbal")).alias("bal"), F.count("*").alias("n_c"))
    s = table(spark, sf_dir, "supplier").groupBy(F.col("s_nationkey").alias("k")).agg(r6(F.avg("s_acctbal")).alias("bal"), F.count("*").alias("n_s"))
    return relational.outer_coalesce(c, s, "k").select("k", "bal", "n_c", "n_s")


@query("SELECT o_custkey, arg_min(p, o_orderkey) FILTER (WHERE p IS NOT NULL) price, arg_min(s, o_orderkey) FILTER (WHERE s IS NOT NULL) status FROM (SELECT o_custkey, o_orderkey, CASE WHEN o_orderstatus = 'O' THEN NULL ELSE o_totalprice END p, nullif(o_orderstatus, 'F') s FROM orders) GROUP BY 1")
def sel_first_non_null(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", F.when(F.col("o_orderstatus") != "O", F.col("o_totalprice")).alias("price"), F.nullif(F.col("o_orderstatus"), F.lit("F")).alias("status"))
    return relational.first_non_null(rows, ["o_custkey"], [F.col("o_orderkey")], ["price", "status"])


@query("WITH a AS (SELECT event_type, value v, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) i, count(*) OVER (PARTITION BY event_type) n FROM events), b AS (SELECT *, greatest(3, floor(n * 0.2)) k FROM a) SELECT event_type, round(avg(v), 6) mean, round(median(v), 6) median, round(stddev_pop(v), 6) std, round(min(v), 6) least, round(max(v), 6) most, round(quantile_cont(v, 0.1), 6) q10, round(quantile_cont(v, 0.9), 6) q90, round(avg(v) FILTER (WHERE i <= k), 6) first_mean, round(avg(v) FILTER (WHERE i > n - k), 6) last_mean, round(avg(v) FILTER (WHERE i > n - k) - avg(v) FILTER (WHERE i <= k), 6) drift FROM b GROUP BY 1")
def rec_series_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(summaries.series(table(spark, sf_dir, "events"), ["event_type"], ["ts", "event_id"], "value"), "event_type")


@query("WITH a AS (SELECT l_suppkey, l_returnflag, l_orderkey, l_linenumber, l_extendedprice x, l_discount <= 0.0 ok, max(CASE WHEN l_discount <= 0.0 THEN 1 ELSE 0 END) OVER (PARTITION BY l_suppkey, l_returnflag) hit FROM lineitem), b AS (SELECT *, row_number() OVER (PARTITION BY l_suppkey, l_returnflag ORDER BY x DESC, l_orderkey, l_linenumber) r FROM a WHERE ok OR hit = 0) SELECT l_suppkey, l_returnflag, l_orderkey, l_linenumber, CAST(r AS int) AS rank FROM b WHERE r <= 3")
def dock_topn_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    keys = ["l_suppkey", "l_returnflag"]
    kept = relational.filter_or_all(table(spark, sf_dir, "lineitem"), keys, F.col("l_discount") <= 0.0)
    return relational.top(kept, keys, [F.col("l_extendedprice").desc(), F.col("l_orderkey"), F.col("l_linenumber")], 3).select(*keys, "l_orderkey", "l_linenumber", "rank")


@query("WITH g AS (SELECT l_suppkey, l_returnflag, floor(l_extendedprice / 5000) a, floor(l_discount / 0.05) b, l_quantity FROM lineitem) SELECT l_suppkey, l_returnflag, CAST(dense_rank() OVER (PARTITION BY l_suppkey, l_returnflag ORDER BY a, b) AS int) AS cluster, count(*) size, median(l_quantity) mid FROM g GROUP BY l_suppkey, l_returnflag, a, b")
def dock_grid_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select("l_suppkey", "l_returnflag", "l_quantity", F.floor(F.col("l_extendedprice") / 5000).alias("a"), F.floor(F.col("l_discount") / 0.05).alias("b"))
    sizes = rows.groupBy("l_suppkey", "l_returnflag", "a", "b").agg(F.count("*").alias("size"), F.median("l_quantity").alias("mid"))
    return sizes.withColumn("cluster", F.expr("cast(dense_rank() over (partition by l_suppkey, l_returnflag order by a, b) as int)")).drop("a", "b")


@query("WITH a AS (SELECT l_suppkey, l_extendedprice x, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_extendedprice) i, count(*) OVER (PARTITION BY l_suppkey) n FROM lineitem) SELECT l_suppkey, round(avg(x) FILTER (WHERE i > floor(n * 0.1) AND i <= n - floor(n * 0.1)), 6) trimmed, max(n) n FROM a GROUP BY 1")
def dock_trimmed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(summaries.trimmed_mean(table(spark, sf_dir, "lineitem"), ["l_suppkey"], "l_extendedprice"), "l_suppkey", "n")


POINTS = "SELECT vec_id id, label, CAST(embedding[1] AS double) x, CAST(embedding[2] AS double) y, CAST(embedding[3] AS double) z FROM embeddings"


@query(f"WITH p AS ({POINTS}) SELECT left_id, right_id, round(distance, 6) distance FROM (SELECT a.id left_id, b.id right_id, sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2 + (a.z - b.z) ** 2) distance FROM p a, p b WHERE a.label < 5 AND b.label >= 5) WHERE distance <= 0.1")
def dock_contacts(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "label", *[F.col("embedding")[i].cast("double").alias(c) for i, c in enumerate("xyz")])
    return rounded(geometry.contacts(points.where("label < 5"), points.where("label >= 5"), 0.1), "left_id", "right_id")


@query("WITH e AS (SELECT vec_id, label, unnest(embedding) v, generate_subscripts(embedding, 1) i FROM embeddings), d AS (SELECT a.label, a.vec_id x, b.vec_id y, sqrt(sum((CAST(a.v AS double) - CAST(b.v AS double)) ** 2)) d FROM e a JOIN e b ON a.label = b.label AND a.i = b.i GROUP BY 1, 2, 3), m AS (SELECT label, x, round(avg(d), 9) d FROM d GROUP BY 1, 2) SELECT label, CAST(count(*) AS bigint) size, min_by(x, (d, x)) medoid, round(min(d), 6) distance FROM m GROUP BY 1")
def clu_medoid(spark: SparkSession, sf_dir: str) -> DataFrame:
    sums = clusters.total_distances(table(spark, sf_dir, "embeddings"), "label", "vec_id", "embedding")
    means = sums.select("label", F.col("vec_id").alias("x"), F.round(F.col("total") / F.col("n"), 9).alias("d"))
    return means.groupBy("label").agg(F.count("*").alias("size"), F.min_by("x", F.struct("d", "x")).alias("medoid"), r6(F.min("d")).alias("distance"))


@query("SELECT event_type, count(*) n, round(avg(value), 6) mean, round(stddev_samp(value), 6) sd, round(stddev_samp(value) / sqrt(count(*)), 6) sem, round(median(value), 6) median, round(quantile_cont(value, 0.25), 6) q1, round(quantile_cont(value, 0.75), 6) q3, round(min(value), 6) least, round(max(value), 6) most FROM events WHERE ts >= timestamp '2024-01-05' GROUP BY 1")
def md_window_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    late = table(spark, sf_dir, "events").where(F.expr("ts >= timestamp_ntz'2024-01-05'"))
    return rounded(late.groupBy("event_type").agg(*summaries.distribution("value")), "event_type", "n")


@query("SELECT user_id, min_by(event_id, (-value, event_id)) event_id, round(max(value), 6) value FROM events GROUP BY 1")
def md_argmax(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").groupBy("user_id").agg(F.min_by("event_id", F.struct(-F.col("value"), F.col("event_id"))).alias("event_id"), r6(F.max("value")).alias("value"))


CRITERIA = {"quantity": "l_quantity <= 30", "price": "l_extendedprice <= 50000", "discount": "l_discount <= 0.05", "tax": "l_tax <= 0.04", "line": "l_linenumber <= 3"}


@query("SELECT l_returnflag, " + ", ".join(f"round(100 * avg(CASE WHEN {c} THEN 1.0 ELSE 0.0 END), 6) {n}" for n, c in CRITERIA.items()) + ", round(avg(" + " + ".join(f"CASE WHEN {c} THEN 1.0 ELSE 0.0 END" for c in CRITERIA.values()) + "), 6) score FROM lineitem GROUP BY 1")
def md_occupancy(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem")
    total = sum((F.expr(c).cast("double") for c in CRITERIA.values()), F.lit(0.0))
    return rows.groupBy("l_returnflag").agg(*[r6(summaries.occupancy(F.expr(c))).alias(n) for n, c in CRITERIA.items()], r6(F.avg(total)).alias("score"))


@query("SELECT p_type, " + ", ".join(f"round(avg(l_extendedprice) FILTER (WHERE l_returnflag = '{f}'), 6) \"{f}\"" for f in "ANR") + " FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY 1")
def md_pivots(spark: SparkSession, sf_dir: str) -> DataFrame:
    joined = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey"))
    return rounded(summaries.pivot(joined, "p_type", "l_returnflag", "ANR", "l_extendedprice"), "p_type")


@query("SELECT l_suppkey, l_partkey, n, CAST(r AS int) AS rank FROM (SELECT l_suppkey, l_partkey, count(*) n, row_number() OVER (PARTITION BY l_suppkey ORDER BY count(*) DESC, l_partkey) r FROM lineitem GROUP BY 1, 2) WHERE r <= 20")
def md_top_contacts(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = table(spark, sf_dir, "lineitem").groupBy("l_suppkey", "l_partkey").agg(F.count("*").alias("n"))
    return relational.top(counts, ["l_suppkey"], [F.col("n").desc(), F.col("l_partkey")], 20)


@query("SELECT p_partkey, CASE WHEN t = '' THEN 'item' ELSE t END label FROM (SELECT p_partkey, trim(regexp_replace(p_name, '[^A-Za-z0-9_.-]+', '_', 'g'), '_') t FROM part)")
def util_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", scan.safe_label(F.col("p_name")).alias("label"))


def grouped(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").withColumnRenamed("label", "grp")


@query(None)
def clu_average(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clusters.linkage(grouped(spark, sf_dir), "grp", "vec_id", "embedding", 1.2, complete=False)


@query(None)
def clu_complete(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clusters.linkage(grouped(spark, sf_dir), "grp", "vec_id", "embedding", 1.2, complete=True)


@query(None)
def clu_dbscan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clusters.density(grouped(spark, sf_dir), "grp", "vec_id", "embedding", 1.0)


from . import extended, further  # noqa: E402, F401  their queries register themselves
