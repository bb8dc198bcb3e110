"""The queries of the training-data operators over the shared tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontamination, hard_negatives, jaccard_join, line_dedup, packing, pii, quality_classifier, quality_rules, source_audit, substring_dedup, toxicity, url_filter, warc
from .common import crc_fold, table


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_email", "n_ip", "n_card", "n_phone", F.sha2(pii.joined("base"), 256).alias("base_sha256"), pii.joined("all").alias("spans"), "n_secret", (F.size("all") + F.col("n_secret")).alias("n_found"))


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), tokenizer_path())


def op3_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.groups(table(spark, sf_dir, "documents"), k=3, percent=90)


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = line_dedup.dedup_lines(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_lines", "n_removed", F.sha2("text", 256).alias("kept_sha256"))


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.dedup_substrings(table(spark, sf_dir, "documents"))


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality_rules.judge(docs, quality_rules.learn_rules(docs, table(spark, sf_dir, "labels")))


def op8_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = quality_classifier.learn(docs, table(spark, sf_dir, "labels"), "quality", lambda c: crc_fold(c, 4) != 2)
    return verdicts(quality_classifier.score(docs, model), 4, 2)


def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge_urls(table(spark, sf_dir, "pages"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = toxicity.learn(docs, table(spark, sf_dir, "labels"), "toxic", lambda c: crc_fold(c, 3) != 1)
    return verdicts(toxicity.score(docs, model), 3, 1)


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.mine(vectors.withColumn("label", moved), F.col("vec_id") % 100 == 0)


def op12_source_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_audit.audit(table(spark, sf_dir, "documents"))


def op13_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive_pages(table(spark, sf_dir, "pages"))


def verdicts(scored: DataFrame, folds: int, held: int, least: float = 0.7) -> DataFrame:
    """doc_id, held_out (crc32 of the id modulo folds), score, predicted."""
    return scored.select("doc_id", (crc_fold("doc_id", folds) == held).alias("held_out"), "score", (F.col("score") >= least).cast("int").alias("predicted"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in QUERIES}


QUERIES = (
    op1_pii, op2_packing, op3_jaccard_join, op4_line_dedup, op5_substring_dedup, op6_decontamination,
    op7_quality_rules, op8_quality_classifier, op9_url_filter, op10_toxicity,
    op11_hard_negatives, op12_source_audit, op13_warc,
)


_WORDS = "list_filter(string_split_regex({0}, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '')"

#: Sets of shingles, pairs with a common one, and the smallest id reached over the linked ones.
JACCARD_SQL = f"""
WITH RECURSIVE w AS (SELECT doc_id, {_WORDS.format("translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} l FROM documents),
s AS (SELECT doc_id, CASE WHEN len(l) = 0 THEN [] WHEN len(l) < 3 THEN [array_to_string(l, ' ')] ELSE list_distinct(list_transform(range(1, len(l) - 1), lambda i: l[i] || ' ' || l[i + 1] || ' ' || l[i + 2])) END s FROM w),
e AS (SELECT doc_id, len(s) n, hash(unnest(s)) t FROM s),
p AS (SELECT a.doc_id u, b.doc_id v FROM e a JOIN e b ON a.t = b.t AND a.doc_id <> b.doc_id AND 100 * least(a.n, b.n) >= 90 * greatest(a.n, b.n) GROUP BY 1, 2, a.n, b.n HAVING 100 * count(*) >= 90 * (a.n + b.n - count(*))),
r AS (SELECT u, u v FROM p UNION SELECT r.u, p.v FROM r JOIN p ON p.u = r.v)
SELECT s.doc_id, CAST(len(s) AS bigint) n_shingles, coalesce(c, s.doc_id) component_id FROM s LEFT JOIN (SELECT u, min(v) c FROM r GROUP BY 1) ON u = doc_id
"""

#: Windows, the smallest document that each starts in, and the words that none of a later document covers.
SUBSTRING_SQL = f"""
WITH w AS (SELECT doc_id, {_WORDS.format("coalesce(text, '')")} l FROM documents),
x AS (SELECT doc_id, i, md5(array_to_string(l[i:i + 49], ' ')) h FROM (SELECT doc_id, l, unnest(range(1, len(l) - 48)) i FROM w WHERE len(l) >= 50)),
f AS (SELECT h, min(doc_id) m FROM x GROUP BY 1),
g AS (SELECT DISTINCT x.doc_id, i + j p FROM x JOIN f USING (h), range(0, 50) t(j) WHERE m < x.doc_id),
k AS (SELECT a.doc_id, string_agg(a.word, ' ' ORDER BY a.p) kept, count(*) n FROM (SELECT doc_id, unnest(l) word, unnest(range(1, len(l) + 1)) p FROM w) a ANTI JOIN g ON g.doc_id = a.doc_id AND g.p = a.p GROUP BY 1)
SELECT w.doc_id, CAST(len(l) AS bigint) n_words, CAST(len(l) - coalesce(n, 0) AS bigint) n_removed, sha256(coalesce(kept, '')) kept_sha256 FROM w LEFT JOIN k ON k.doc_id = w.doc_id
"""


#: All scores of every anchor, its positives, and the ranks within each positive's window.
NEGATIVES_SQL = """
WITH e AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END l, list_transform(embedding, lambda x: floor(256 * CAST(x AS double))) v FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id a, b.vec_id b, a.l = b.l same, CAST(list_dot_product(a.v, b.v) AS bigint) s FROM e a JOIN e b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0),
p AS (SELECT a, b, s FROM (SELECT *, row_number() OVER (PARTITION BY a ORDER BY s DESC, b) r FROM s WHERE same) WHERE r <= 5)
SELECT anchor_id, positive_id, CAST(r AS int) AS rank, negative_id, positive_score, negative_score FROM (
  SELECT p.a anchor_id, p.b positive_id, s.b negative_id, p.s positive_score, s.s negative_score, row_number() OVER (PARTITION BY p.a, p.b ORDER BY s.s DESC, s.b) r
  FROM p JOIN s ON s.a = p.a AND NOT s.same AND 30 * p.s <= 100 * s.s AND 100 * s.s <= 90 * p.s) WHERE r <= 10
"""

_SHARE = "1 + CAST(1000000000 AS hugeint) * ({0} + 1) // ({1})"

#: Counts of every term in every group, their shares, and the sums over all terms.
AUDIT_SQL = f"""
WITH d AS (SELECT coalesce(lang, '') lang, coalesce(source, '') source, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+') w FROM documents),
g AS (SELECT DISTINCT lang, source FROM d),
k AS (SELECT lang, t FROM (SELECT lang, unnest(list_distinct(w)) t FROM d) GROUP BY 1, 2 HAVING count(*) >= 3),
c AS (SELECT lang, source, t, count(*) n FROM (SELECT lang, source, unnest(w) t FROM d) JOIN k USING (lang, t) GROUP BY 1, 2, 3),
v AS (SELECT g.lang, count(t) v FROM (SELECT DISTINCT lang FROM g) g LEFT JOIN k USING (lang) GROUP BY 1),
m AS (SELECT g.lang, g.source, coalesce(sum(n), 0) m FROM g LEFT JOIN c USING (lang, source) GROUP BY 1, 2),
p AS (SELECT m.lang, m.source, k.t, coalesce(c.n, 0) n, {_SHARE.format("coalesce(c.n, 0)", "m.m + v.v")} p FROM m JOIN v USING (lang) JOIN k USING (lang) LEFT JOIN c ON c.lang = m.lang AND c.source = m.source AND c.t = k.t),
q AS (SELECT lang, t, {_SHARE.format("sum(n)", "any_value(a.a) + any_value(v.v)")} q FROM c JOIN v USING (lang) JOIN (SELECT lang, sum(m) a FROM m GROUP BY 1) a USING (lang) GROUP BY 1, 2),
s AS (SELECT a.lang, a.source, b.source o, sum((a.p - b.p) * (a.p - b.p) // b.p) f FROM p a JOIN p b ON a.lang = b.lang AND a.t = b.t AND a.source <> b.source GROUP BY 1, 2, 3),
r AS (SELECT a.lang, a.source, 'pair' part, b.source item, CAST(coalesce(f, 0) AS bigint) AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN s ON s.lang = a.lang AND s.source = a.source AND s.o = b.source
  UNION ALL SELECT lang, source, 'term', t, CAST((p - q) * (p - q) // q AS bigint) FROM p JOIN q USING (lang, t) WHERE n > 0 AND p > q)
SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS int) AS rank FROM r) WHERE part = 'pair' OR rank <= 200
"""

#: Sizes and digests of the payloads, and the largest id of equal ones.
WARC_SQL = """
WITH p AS (SELECT page_id, strlen(coalesce(html, '')) n, sha1(coalesce(html, '')) h FROM pages),
m AS (SELECT *, CASE WHEN n >= 1000 THEN max(page_id) OVER (PARTITION BY h, n) END m FROM p)
SELECT page_id, CAST(n AS bigint) payload_bytes, h payload_digest, CASE WHEN m IS NULL OR page_id IS NOT DISTINCT FROM m THEN 'response' ELSE 'revisit' END record_type, CASE WHEN page_id IS DISTINCT FROM m THEN m END refers_to FROM m
"""


def oracle_sql() -> dict[str, str]:
    """SQL for what no learnt or approximate part decides."""
    return {"op3_jaccard_join": JACCARD_SQL, "op5_substring_dedup": SUBSTRING_SQL, "op11_hard_negatives": NEGATIVES_SQL, "op12_source_audit": AUDIT_SQL, "op13_warc": WARC_SQL}
