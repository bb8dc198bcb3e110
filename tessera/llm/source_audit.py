"""How far each source's words depart from those of the other sources of its language."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import durable, forget, small_batches, tidy

#: Turns ASCII letters into lower case and all else in ASCII, which separates terms, into blanks; bytes of other characters stay.
TERMS = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
#: Counts that a task holds before it gives them on.
HELD = 1 << 19
#: Copies of a language's row that its terms are joined with, so that no language is one task's work.
SALTS = 64
#: Counts up to here can be multiplied by 10**9 within a long; others take decimals.
LONG_COUNT = 9_000_000_000


def share(count: str, total: str) -> str:
    """SQL of 1 + floor(10**9 * (count + 1) / total)."""
    exact = f"cast(1000000000 as decimal(10,0)) * cast({count} + 1 as decimal(19,0)) div cast({total} as decimal(19,0))"
    return f"1L + if({count} < {LONG_COUNT}L, 1000000000L * ({count} + 1L) div {total}, {exact})"


def departure(p: str, q: str) -> str:
    """SQL of floor((p - q)**2 / q)."""
    return f"({p} - {q}) * ({p} - {q}) div {q}"


def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, source, term, n, n_docs) of rows (lang, source, text), counted as far as a task can hold the counts."""
    counts: dict[tuple[str, str], tuple[Counter, Counter]] = {}
    held = 0
    forget()

    def taken() -> Iterator[pa.RecordBatch]:
        for (lang, source), (n, n_docs) in counts.items():
            terms = pa.array(list(n), pa.binary()).cast(options=pc.CastOptions(pa.string(), allow_invalid_utf8=True))
            same = (pa.array([x], pa.string()).take(pa.array(np.zeros(len(n), np.int64))) for x in (lang, source))
            yield pa.RecordBatch.from_arrays([*same, terms, pa.array(list(n.values()), pa.int64()), pa.array([n_docs[t] for t in n], pa.int64())], ["lang", "source", "term", "n", "n_docs"])

    for batch in batches:
        texts = batch.column(2).cast(pa.binary())
        for lang, source, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), texts):
            n, n_docs = counts.setdefault((lang, source), (Counter(), Counter()))
            terms = text.as_py().translate(TERMS).split()
            before = len(n)
            n.update(terms)
            n_docs.update(set(terms))
            held += len(n) - before
            if held >= HELD:
                yield from taken()
                counts.clear()
                held = 0
    yield from taken()
    tidy()


def term_counts(docs: DataFrame) -> DataFrame:
    """(lang, source, term, n, n_docs): occurrences, and documents with one, of each term.

    Tasks count what they hold, so that what moves is not a row for each word. It moves by (lang, term), as both this aggregation
    and the next by term need it.
    """
    found = docs.select("lang", "source", "text").mapInArrow(counted, "lang string, source string, term string, n long, n_docs long")
    return found.repartition("lang", "term").groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("n_docs").alias("n_docs"))


def audit(docs: DataFrame, least_documents: int = 3, top: int = 200) -> DataFrame:
    """(lang, source, part, item, value, rank): each source against the others, and its most telling terms.

    Each (lang, source) that occurs is compared by smoothed shares p of the terms that at least so many
    documents of the language hold. Part pair has every other source of the language, value the sum over
    all kept terms of floor((p - q)**2 / q) with q that source's share (0 without terms); part term has
    the terms of the source whose share exceeds the language's q, the first `top` by value. Ties go to the
    smaller item in UTF-8 order. Null text, lang and source are read as ''; texts without terms and repeated rows
    count like any other; an empty table gives no rows; other columns are ignored.

    Each term becomes one row with an array over the sources that have it; higher-order functions make from it
    the contributions of each two of these, which are added up before the shuffle. Where one of two sources lacks
    the term, what it adds depends only on the other's count, so those contributions come from a histogram of
    counts; where both lack it, from the number of terms. What is emitted for a term in both is therefore the rest:
    f(p, q) less what the histograms hold already.
    """
    docs = docs.select(*[F.coalesce(F.col(c), F.lit("")).alias(c) for c in ("lang", "source", "text")])
    groups = docs.select("lang", "source").distinct()
    counts = term_counts(docs)
    wide = counts.groupBy("lang", "term").agg(F.sum("n_docs").alias("n_docs"), F.sum("n").alias("total"), F.map_from_entries(F.collect_list(F.struct("source", "n"))).alias("by_source"))
    with small_batches(docs.sparkSession, 1024):
        kept = durable(wide.where(F.col("n_docs") >= least_documents).select("lang", "term", "total", "by_source"))

    totals = kept.select("lang", F.explode("by_source").alias("source", "n")).groupBy("lang", "source").agg(F.sum("n").alias("n"))
    vocabulary = kept.groupBy("lang").agg(F.count("*").alias("v"))
    per_source = groups.join(totals, ["lang", "source"], "left").groupBy("lang").agg(F.sort_array(F.collect_list(F.struct("source", F.coalesce("n", F.lit(0)).alias("n")))).alias("s"))
    languages = per_source.join(vocabulary, "lang", "left").select("lang", F.col("s.source").alias("sources"), F.col("s.n").alias("sizes"), F.coalesce("v", F.lit(0)).alias("v"))
    lacking = f"if(v = 0, transform(sizes, n -> 0L), transform(sizes, n -> {share('0L', '(n + v)')}))"
    languages = durable(languages.withColumns({"all_n": F.expr("aggregate(sizes, 0L, (a, n) -> a + n)"), "lacking": F.expr(lacking)}))

    salted = languages.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    rows = kept.withColumn("salt", F.pmod(F.xxhash64("term"), F.lit(SALTS)).cast("int")).join(salted, ["lang", "salt"])

    # Where a source has the term (i from 0), its share p, and the share q of a term it lacks.
    at = "transform(map_entries(by_source), e -> struct(cast(array_position(sources, e.key) - 1 as int) as i, e.value as n))"
    rows = rows.withColumn("at", F.expr(at)).withColumn("z", F.expr(f"transform(at, e -> struct(e.i as i, {share('e.n', '(sizes[e.i] + v)')} as p, lacking[e.i] as q))"))
    rest = f"{departure('x.p', 'y.p')} - {departure('x.p', 'y.q')} - {departure('x.q', 'y.p')} + {departure('x.q', 'y.q')}"
    emitted = F.expr(f"flatten(transform(z, x -> transform(filter(z, y -> y.i <> x.i), y -> struct(x.i as i, y.i as j, {rest} as f))))")
    both = rows.select("lang", F.explode(emitted).alias("e")).select("lang", "e.*")

    histogram = kept.select("lang", F.explode("by_source").alias("source", "n")).groupBy("lang", "source", "n").agg(F.count("*").alias("m"))
    histogram = histogram.withColumn("salt", F.pmod(F.xxhash64("source", "n"), F.lit(SALTS)).cast("int")).join(salted, ["lang", "salt"])
    histogram = histogram.withColumn("i", F.expr("cast(array_position(sources, source) - 1 as int)"))
    histogram = histogram.select("lang", "i", "m", F.expr(share("n", "(sizes[i] + v)")).alias("p"), F.expr("lacking[i]").alias("q"), F.posexplode("lacking").alias("j", "r")).where("i <> j")
    ways = F.array(
        F.struct("i", "j", F.expr(f"m * ({departure('p', 'r')} - {departure('q', 'r')})").alias("f")),
        F.struct(F.col("j").alias("i"), F.col("i").alias("j"), F.expr(f"m * ({departure('r', 'p')} - {departure('r', 'q')})").alias("f")),
    )
    single = histogram.select("lang", F.explode(ways).alias("e")).select("lang", "e.*")
    sums = both.groupBy("lang", "i", "j").agg(F.sum("f").alias("f")).unionByName(single.groupBy("lang", "i", "j").agg(F.sum("f").alias("f"))).groupBy("lang", "i", "j").agg(F.sum("f").alias("f"))

    pairs = languages.select("lang", "sources", "lacking", "v", F.posexplode("sources").alias("i", "source"))
    pairs = pairs.select("lang", "source", "v", "i", F.expr("lacking[i]").alias("p"), F.posexplode(F.arrays_zip("sources", "lacking")).alias("j", "other")).where("i <> j")
    pairs = pairs.join(sums, ["lang", "i", "j"], "left").select("lang", "source", F.lit("pair").alias("part"), F.col("other.sources").alias("item"), F.expr(f"if(v = 0, 0L, v * ({departure('p', 'other.lacking')}) + coalesce(f, 0L))").alias("value"))

    own = rows.select("lang", "term", "v", "all_n", "total", "sources", F.explode("z").alias("x"))
    own = own.select("lang", F.expr("sources[x.i]").alias("source"), "term", F.col("x.p").alias("p"), F.expr(share("total", "(all_n + v)")).alias("q")).where("p > q")
    terms = own.select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), F.expr(departure("p", "q")).alias("value"))

    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    ranked = terms.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    return pairs.withColumn("rank", F.row_number().over(order)).unionByName(ranked)
