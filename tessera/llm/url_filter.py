"""URL filters: explicit host and path rules, then trust and distrust spread over the link graph.

Hosts with pages that rules allow are trusted seeds, hosts with pages that rules block are
distrusted seeds. Trust follows links (personalised PageRank), distrust follows them backwards. A
host whose distrust exceeds its trust by a factor is blocked. DataFrame expressions only.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import durable

#: (verdict, host, path)
RULES = (("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/"))
LINK = "(?i)(?:href|src)\\s{0,9}=\\s{0,9}[\"']?(?:https?:)?//([^/?#\"'\\s>]+)"


def ascii_lower(c: Column) -> Column:
    return F.translate(c, string.ascii_uppercase, string.ascii_lowercase)


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host and path; both empty for null or without ://."""
    pattern = "(?s)^.*?://([^/?#]*)([^?#]*)"
    part = lambda k: F.coalesce(F.regexp_extract(url, pattern, k), F.lit(""))
    return ascii_lower(part(1)), part(2)


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest rule that fits, and its verdict; null where none does."""
    text, verdict = F, F
    for what, h, p in sorted(rules, key=lambda r: (-len(r[1] + r[2]), r)):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        text, verdict = text.when(fits, F.lit(h + p)), verdict.when(fits, F.lit(what))
    none = F.lit(None).cast("string")
    return (text.otherwise(none), verdict.otherwise(none)) if rules else (none, none)


def host_edges(pages: DataFrame) -> DataFrame:
    """(src, dst, n): links between different hosts; null html has none."""
    host, _ = host_and_path(F.col("url"))
    links = pages.select(host.alias("src"), F.explode(F.regexp_extract_all(F.coalesce("html", F.lit("")), F.lit(LINK), F.lit(1))).alias("dst"))
    links = links.select("src", ascii_lower(F.col("dst")).alias("dst")).where("src <> '' and dst <> '' and src <> dst")
    return links.groupBy("src", "dst").agg(F.count("*").alias("n"))


def spread(edges: DataFrame, seeds: DataFrame, source: str, target: str, follow: float = 0.85, rounds: int = 30, tolerance: float = 1e-6) -> DataFrame:
    """(host, score): personalised PageRank from seeds (host, seed) along source -> target.

    Stops when the scores change by less than tolerance in total. Each round is one join and one
    pre-aggregated sum, its result checkpointed. Mass of hosts without links is not redistributed.
    """
    out = edges.groupBy(source).agg(F.sum("n").alias("all")).withColumnRenamed(source, "_from")
    weights = durable(edges.join(out, edges[source] == out["_from"]).select(F.col(source).alias("a"), F.col(target).alias("b"), (F.col("n") / F.col("all")).alias("w")))
    start = durable(seeds.select("host", ((1 - follow) * F.col("seed")).alias("score")))
    now = start
    for _ in range(rounds):
        moved = weights.join(now, weights["a"] == now["host"]).select(F.col("b").alias("host"), (follow * F.col("w") * F.col("score")).alias("score"))
        then = durable(start.unionByName(moved).groupBy("host").agg(F.sum("score").alias("score")))
        change = then.select("host", "score").unionByName(now.select("host", (-F.col("score")).alias("score"))).groupBy("host").agg(F.sum("score").alias("d")).agg(F.sum(F.abs("d")).alias("d")).first()["d"]
        now = then
        if (change or 0.0) < tolerance:
            break
    return now


def host_scores(pages: DataFrame, rules=RULES) -> DataFrame:
    """(host, trust, distrust) of every host that seeds reach; a seed's mass is its share of pages."""
    host, path = host_and_path(F.col("url"))
    _, verdict = rule_of(F.col("host"), F.col("path"), rules)
    counts = pages.select(host.alias("host"), path.alias("path")).where("host <> ''").select("host", verdict.alias("v"))
    counts = durable(counts.groupBy("host").agg(F.count("*").alias("n"), F.count_if(F.col("v") == "allow").alias("good"), F.count_if(F.col("v") == "block").alias("bad")))
    edges = durable(host_edges(pages))
    seeds = lambda c: counts.where(F.col(c) > 0).select("host", (F.col(c) / F.col("n")).alias("seed"))
    trust = spread(edges, seeds("good"), "src", "dst").withColumnRenamed("score", "trust")
    distrust = spread(edges, seeds("bad"), "dst", "src").withColumnRenamed("score", "distrust")
    return trust.join(distrust, "host", "full_outer").select("host", *[F.coalesce(c, F.lit(0.0)).alias(c) for c in ("trust", "distrust")])


def judge_urls(pages: DataFrame, rules=RULES, factor: float = 1.0) -> DataFrame:
    """page_id, host, path, rule, verdict of every page.

    Without a fitting rule the verdict is block where the host's distrust exceeds factor times its
    trust, else allow; so urls without host and hosts that no seed reaches are allowed. Repeated
    rows stay, null ids stay, an empty table gives no rows.
    """
    blocked = host_scores(pages, rules).where(F.col("distrust") > factor * F.col("trust")).select(F.col("host").alias("_blocked"))
    host, path = host_and_path(F.col("url"))
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    judged = pages.select("page_id", host.alias("host"), path.alias("path")).select("page_id", "host", "path", rule.alias("rule"), verdict.alias("_v"))
    joined = judged.join(blocked, judged["host"] == blocked["_blocked"], "left")
    method = F.when(F.col("_blocked").isNotNull(), F.lit("block")).otherwise(F.lit("allow"))
    return joined.select("page_id", "host", "path", "rule", F.coalesce("_v", method).alias("verdict"))
