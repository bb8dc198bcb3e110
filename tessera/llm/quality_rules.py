"""Quality rules: a learned decision list over text statistics, all in DataFrame expressions.

Sequential covering grows conjunctions of thresholds on a bounded sample of labelled statistics,
prunes each on a held-back part and keeps it while it is precise there; the ordered rules become one
conditional expression. Nothing but built-in functions runs on the executors.
"""

from __future__ import annotations

import functools
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE, labelled_sample, text_or_empty

#: Words of a window whose repetition within a text counts.
WINDOW = 5
#: Statistics that rules may test, as shares so that they mean the same at any length.
RATIOS = {
    "words": lambda: F.col("n_words").cast("double"),
    "word_length": lambda: F.col("word_chars") / F.greatest("n_words", F.lit(1)),
    "symbols": lambda: F.col("n_symbols") / F.greatest("word_chars", F.lit(1)),
    "exclaims": lambda: F.col("n_exclaims") / F.greatest("n_words", F.lit(1)),
    "capitals": lambda: F.col("n_capitals") / F.greatest("word_chars", F.lit(1)),
    "repeats": lambda: F.col("n_repeat_words") / F.greatest("n_words", F.lit(1)),
    "dup_lines": lambda: F.col("n_dup_lines") / F.greatest("n_lines", F.lit(1)),
}
BASE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def repeated_words(words: Column, n: Column) -> Column:
    """Words covered by windows of WINDOW words that occur at least twice, first ones included.

    Windows are compared by a 64-bit hash. Equal ones are found by sorting, so the time grows with
    n log n whatever the number of repetitions; texts without any are settled by a hash set.
    """
    grams = F.transform(F.sequence(F.lit(0), n - WINDOW), lambda i: F.xxhash64(*[F.get(words, i + k) for k in range(WINDOW)]))
    tagged = lambda g: F.sort_array(F.transform(g, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

    def positions(s: Column) -> Column:
        same = lambda x, other: F.coalesce(other["h"] == x["h"], F.lit(False))
        kept = F.filter(F.transform(s, lambda x, k: F.when(same(x, F.get(s, k - 1)) | same(x, F.get(s, k + 1)), x["i"])), lambda i: i.isNotNull())
        return F.sort_array(kept)

    def covered(p: Column) -> Column:
        steps = F.transform(p, lambda i, k: F.least(F.lit(WINDOW), F.coalesce(F.get(p, k + 1) - i, F.lit(WINDOW))))
        return F.aggregate(steps, F.lit(0).cast("long"), lambda a, x: a + x)

    def bind(value: Column, body) -> Column:
        return F.get(F.transform(F.array(value), body), F.lit(0))

    found = bind(grams, lambda g: F.when(F.size(F.array_distinct(g)) == F.size(g), F.lit(0).cast("long")).otherwise(bind(tagged(g), lambda s: bind(positions(s), covered))))
    return F.when(n < 2 * 1 + WINDOW - 1, F.lit(0).cast("long")).otherwise(found)


def statistics(docs: DataFrame, id_column: str = "doc_id", extra: tuple[str, ...] = ()) -> DataFrame:
    """One row of counts per document over its whole text (null: empty; repeated rows stay).

    doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_exclaims, n_capitals,
    n_lines, and the columns in `extra`.
    """
    text = F.col("_text")
    without = lambda pattern: (F.length(text) - F.length(F.regexp_replace(text, pattern, ""))).cast("long")
    base = docs.select(F.col(id_column), *extra, text_or_empty().alias("_text"))
    base = base.withColumn("_words", F.array_remove(F.split(text, SPACE + "+"), ""))
    base = base.withColumn("_lines", F.filter(F.split(text, "\n"), lambda x: x.rlike("[^\\x20\\x09-\\x0D]")))
    n = F.size("_words")
    return base.select(
        F.col(id_column), *extra,
        n.cast("long").alias("n_words"),
        (F.length(text) - without(SPACE + "+")).cast("long").alias("word_chars"),
        without("[#*$%&|<>]+").alias("n_symbols"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        repeated_words(F.col("_words"), n).alias("n_repeat_words"),
        (F.length(text) - F.length(F.replace(text, F.lit("!"), F.lit("")))).cast("long").alias("n_exclaims"),
        without("[A-Z]+").alias("n_capitals"),
        F.size("_lines").cast("long").alias("n_lines"),
    )


@dataclass(frozen=True)
class Test:
    """feature >= cut, or feature < cut."""

    feature: str
    above: bool
    cut: float

    def holds(self, rows: dict[str, np.ndarray]) -> np.ndarray:
        return rows[self.feature] >= self.cut if self.above else rows[self.feature] < self.cut

    def column(self) -> Column:
        x = RATIOS[self.feature]()
        return x >= F.lit(self.cut) if self.above else x < F.lit(self.cut)


Rule = tuple[Test, ...]


def _holds(rule: Rule, rows: dict[str, np.ndarray], n: int) -> np.ndarray:
    return functools.reduce(np.logical_and, (t.holds(rows) for t in rule), np.ones(n, dtype=bool))


def learn(rows: dict[str, np.ndarray], bad: np.ndarray, most_rules: int = 12, most_tests: int = 3, precision: float = 0.9, least: int = 3) -> list[Rule]:
    """Ordered rules that mark bad rows: grown on two thirds, pruned and judged on the other third.

    Growth adds the test with the greatest information gain over the rows the rule covers; pruning
    drops final tests while precision on the held-back third does not fall. A rule is kept if it
    covers at least `least` held-back rows with the asked precision; then its rows are removed.
    """
    n = len(bad)
    part = np.arange(n) % 3 == 0
    cuts = {f: np.unique(np.quantile(x, np.linspace(0.01, 0.99, 50))) for f, x in rows.items()} if n else {}
    tests = [Test(f, above, float(c)) for f, cs in cuts.items() for c in cs for above in (True, False)]
    fits = {t: t.holds(rows) for t in tests}
    left, rules = np.ones(n, dtype=bool), []
    while len(rules) < most_rules and (left & bad & ~part).sum() >= least:
        grow = left & ~part
        rule: Rule = ()
        while len(rule) < most_tests and (grow & ~bad).any():
            p0 = max((grow & bad).sum(), 1e-9) / max(grow.sum(), 1)
            gain = lambda t: (p := (grow & fits[t] & bad).sum()) and p * (np.log2(p / (grow & fits[t]).sum()) - np.log2(p0))
            best = max(tests, key=gain, default=None)
            if best is None or gain(best) <= 0:
                break
            rule += (best,)
            grow &= fits[best]
        judge = left & part

        def worth(r: Rule) -> float:
            held = judge & _holds(r, rows, n)
            return ((held & bad).sum() + 1) / (held.sum() + 2)

        while len(rule) > 1 and worth(rule[:-1]) >= worth(rule):
            rule = rule[:-1]
        held = judge & _holds(rule, rows, n) if rule else np.zeros(n, dtype=bool)
        if not rule or held.sum() < least or (held & bad).sum() < precision * held.sum():
            break
        rules.append(rule)
        left &= ~_holds(rule, rows, n)
    return rules


def verdict(rules: list[Rule]) -> Column:
    """The ordered conditional expression: false at the first rule that holds, else true."""
    out = F
    for rule in rules:
        out = out.when(functools.reduce(lambda a, b: a & b, (t.column() for t in rule)), F.lit(False))
    return out.otherwise(F.lit(True)) if rules else F.lit(True)


def learn_rules(docs: DataFrame, labels: DataFrame, label: str = "quality", limit: int = 20_000) -> list[Rule]:
    """Rules from the statistics of at most about `limit` labelled documents (label 0: bad).

    Without labelled documents there are no rules and every document passes.
    """
    sample = labelled_sample(docs, labels, label, lambda c: F.lit(True), limit)
    stats = statistics(sample, extra=("y",))
    found = stats.select("doc_id", "y", *[f().alias(k) for k, f in RATIOS.items()]).collect()
    found.sort(key=lambda r: ((r["doc_id"] * 0x9E3779B97F4A7C15) & 0xFFFFFFFF, tuple(r)))
    rows = {k: np.array([r[k] for r in found], dtype=float) for k in RATIOS}
    return learn(rows, np.array([r["y"] == 0 for r in found], dtype=bool))


def judge(docs: DataFrame, rules: list[Rule], least_words: int = 10, most_repeats: int = 20) -> DataFrame:
    """doc_id, base counts, base_failed and kept for every document.

    base_failed: fewer than least_words words, or over most_repeats per cent of words in repeated
    windows. kept: not base_failed and no learned rule holds.
    """
    stats = statistics(docs)
    failed = (F.col("n_words") < least_words) | (100 * F.col("n_repeat_words") > most_repeats * F.col("n_words"))
    return stats.select("doc_id", *BASE, failed.alias("base_failed"), (~failed & verdict(rules)).alias("kept"))
