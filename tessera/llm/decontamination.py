"""Benchmark decontamination: a BM25 index of test items asked by every passage of every text.

The items' inverted index keeps, per term (a pair of adjacent words, as single words are too common
to bound scores tightly), its postings by item number and the greatest weight in each block of items. A passage retrieves every item whose normalised score reaches the threshold,
by block-max WAND; n-gram overlap with the item's question and answer then decides.
"""

from __future__ import annotations

import bisect
import math
import re
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import durable, text_or_empty

WORD = re.compile(r"[^\W_]+")
K1, B = 1.2, 0.75
#: Items in a block of the index.
BLOCK = 16
#: Words of half a passage at least. Passages overlap by half, so those of an item's width hold it whole.
HALF = 64
NGRAM = 3
NO_ITEM = 1 << 60


def question_and_answer(text: str) -> tuple[list[str], list[str]]:
    """Words up to the last sentence, and of it; a single sentence is cut at two thirds."""
    parts = [w for w in (WORD.findall(s.lower()) for s in re.split(r"(?<=[.!?])\s+|\n", text)) if w]
    if len(parts) > 1:
        return [w for p in parts[:-1] for w in p], parts[-1]
    words = parts[0] if parts else []
    at = -(-2 * len(words) // 3)
    return words[:at], words[at:]


def half_of(words: int) -> int:
    """Half the width of the passages in which an item of so many words is looked for: HALF, doubled until it fits."""
    half = HALF
    while half < words:
        half *= 2
    return half


Pair = tuple[str, str]


def ngrams(words: list[str], n: int) -> set[tuple[str, ...]]:
    return {tuple(words[i : i + n]) for i in range(len(words) - n + 1)}


def usable(items: list[tuple[int, str]]) -> list[tuple[int, list[str], list[str]]]:
    """(id, question, answer) of the items of at least two words, in order."""
    found = [(k, question_and_answer(t or "")) for k, t in sorted(items, key=lambda x: (x[0] is None, x))]
    return [(k, q, a) for k, (q, a) in found if len(q) + len(a) > 1]


class Statistics:
    """Number, lengths and pair frequencies of all items, whatever their shard."""

    def __init__(self) -> None:
        self.n, self.words, self.longest = 0, 0, 0
        self.df: Counter[Pair] = Counter()

    def add(self, items: list[tuple[int, str]]) -> Statistics:
        for _, q, a in usable(items):
            self.n += 1
            self.words += len(q) + len(a)
            self.longest = max(self.longest, len(q) + len(a))
            self.df.update(set(zip(q + a, (q + a)[1:])))
        return self


class Index:
    """Inverted index of the items; weights are shares of an item's score with itself.

    Items of fewer than two words identify no leak and are left out. A shard's index is given the
    statistics of all items.
    """

    def __init__(self, items: list[tuple[int, str]], statistics: Statistics | None = None):
        of_all = statistics or Statistics().add(items)
        found = usable(items)
        self.ids = [k for k, _, _ in found]
        lengths = [len(q) + len(a) for _, q, a in found]
        mean = of_all.words / max(of_all.n, 1)
        terms = [list(zip(q + a, (q + a)[1:])) for _, q, a in found]
        self.parts = []
        postings: dict[Pair, list[tuple[int, float]]] = defaultdict(list)
        for i, (_, q, a) in enumerate(found):
            weight = {w: math.log(1 + (of_all.n - of_all.df[w] + 0.5) / (of_all.df[w] + 0.5)) * n * (K1 + 1) / (n + K1 * (1 - B + B * lengths[i] / mean)) for w, n in Counter(terms[i]).items()}
            total = sum(weight.values())
            for w, x in weight.items():
                postings[w].append((i, x / total))
            self.parts.append([(n, ngrams(p, n)) for p in (q, a) if p for n in [min(NGRAM, len(p))]])
        self.postings = {w: ([i for i, _ in p], [x for _, x in p]) for w, p in postings.items()}
        self.half = half_of(of_all.longest)
        self.most = {w: max(x) for w, (_, x) in self.postings.items()}
        # An item's own length sets the passages it is looked for in; long items do not widen those of others.
        self.width = [half_of(n) for n in lengths]
        self.most_by_width: dict[int, dict[Pair, float]] = {h: {} for h in sorted(set(self.width))}
        for w, (numbers, weights) in self.postings.items():
            for i, x in zip(numbers, weights):
                own = self.most_by_width[self.width[i]]
                own[w] = max(own.get(w, 0.0), x)
        # Only the blocks that hold a term have an entry.
        self.block_most: dict[Pair, dict[int, float]] = {}
        for w, (i, x) in self.postings.items():
            own = self.block_most[w] = {}
            for item, weight in zip(i, x):
                own[item // BLOCK] = max(own.get(item // BLOCK, 0.0), weight)

    def retrieve(self, words: set[Pair], least: float) -> list[tuple[int, float]]:
        """(item, score) of every item that scores at least `least`, by block-max WAND."""
        terms = sorted(w for w in words if w in self.postings)
        bounds: dict[int, float] = {}
        for w in terms:
            for b, x in self.block_most[w].items():
                bounds[b] = bounds.get(b, 0.0) + x
        if max(bounds.values(), default=0.0) < least:
            return []
        lists = [(*self.postings[w], self.most[w], self.block_most[w]) for w in terms]
        at = [0] * len(lists)
        out = []
        while True:
            now = sorted((p[0][at[k]] if at[k] < len(p[0]) else NO_ITEM, k) for k, p in enumerate(lists))
            bound, pivot = 0.0, NO_ITEM
            for item, k in now:
                bound += lists[k][2]
                if bound >= least:
                    pivot = item
                    break
            if pivot == NO_ITEM:
                return out
            block = pivot // BLOCK
            ahead = [k for item, k in now if item <= pivot]
            if sum(lists[k][3].get(block, 0.0) for k in ahead) < least:
                # No item can qualify before the block ends or another term's list begins.
                beyond = min([(block + 1) * BLOCK, *(item for item, _ in now if item > pivot)])
            elif now[0][0] == pivot:
                score = sum(lists[k][1][at[k]] for item, k in now if item == pivot)
                if score >= least:
                    out.append((pivot, score))
                beyond = pivot + 1
            else:
                beyond = pivot
            for k in ahead:
                at[k] = bisect.bisect_left(lists[k][0], beyond, at[k])

    def overlaps(self, item: int, words: list[str]) -> list[float]:
        """Share of the n-grams of the question and of the answer that the words hold."""
        return [len(own & ngrams(words, n)) / len(own) for n, own in self.parts[item]]

    def leaks(self, text: str, least_score: float, least_overlap: float) -> dict[int, tuple[float, float, float]]:
        """Per leaked item: best score, overlap of question and of answer, over all passages."""
        words = WORD.findall(text.lower())
        if not words or not self.ids:
            return {}
        pairs = list(zip(words, words[1:]))
        if not pairs:
            return {}
        out: dict[int, tuple[float, float, float]] = {}
        for half, weights in self.most_by_width.items():
            most = weights.get
            bound = np.add.reduceat(np.array([most(p, 0.0) for p in pairs]), np.arange(0, len(pairs), half))
            passages = bound[:-1] + bound[1:] if len(bound) > 1 else bound
            for k in np.flatnonzero(passages >= least_score):
                # One word more than pairs.
                passage = words[k * half : (k + 2) * half + 1]
                for item, score in self.retrieve(set(zip(passage, passage[1:])), least_score):
                    if self.width[item] != half:
                        continue
                    shares = self.overlaps(item, passage)
                    if min(shares) >= least_overlap:
                        out[item] = max(out.get(item, (0.0, 0.0, 0.0)), (score, shares[0], shares[-1]))
        return out


def indexes(benchmark: DataFrame, shard_items: int = 50_000) -> Iterator[Index]:
    """The index, in shards of about shard_items items if there are more, one after another.

    Null texts have no entry. The statistics are those of all items, so scores do not depend on the
    shards. The driver holds one shard and the frequencies of its own pairs at a time; those of all
    items are counted in Spark where there are several shards.
    """
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text"))
    shards = max(1, -(-items.count() // shard_items))
    if shards == 1:
        yield Index([(r[0], r[1]) for r in items.collect()])
        return

    def parsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for _, q, a in usable(list(zip(*(c.to_pylist() for c in batch.columns)))):
                rows.append((None, None, len(q) + len(a)))
                rows += [(x, y, None) for x, y in sorted(set(zip(q + a, (q + a)[1:])))]
            kinds = (pa.string(), pa.string(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)], ["x", "y", "n"])

    rows = durable(items.mapInArrow(parsed, "x string, y string, n long"))
    totals = rows.where("n is not null").agg(F.count("*"), F.sum("n"), F.max("n")).first()
    counts = durable(rows.where("n is null").groupBy("x", "y").agg(F.count("*").alias("df")))
    part = F.pmod(F.xxhash64("item_id", "text"), F.lit(shards))
    for s in range(shards):
        own = items.where(part == s)
        statistics = Statistics()
        statistics.n, statistics.words, statistics.longest = (int(t or 0) for t in totals)
        pairs = own.mapInArrow(parsed, "x string, y string, n long").where("n is null").select("x", "y").distinct()
        for r in counts.join(pairs, ["x", "y"], "left_semi").toLocalIterator():
            statistics.df[r["x"], r["y"]] = r["df"]
        yield Index([(r[0], r[1]) for r in own.collect()], statistics)


def find_leaks(docs: DataFrame, benchmark: DataFrame, least_score: float = 0.5, least_overlap: float = 0.5, shard_items: int = 50_000) -> DataFrame:
    """(doc_id, item_id, score, question_overlap, answer_overlap) of every leaked item of every row.

    score is the share of the item's BM25 score with itself. Whole texts are read. Null and empty
    texts leak nothing, nor does an empty benchmark; equal items are all reported; repeated rows
    give repeated results. Each shard of the index, of bounded size, is broadcast by itself.
    """
    kinds = [pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.float64()]
    names = ["doc_id", "item_id", "score", "question_overlap", "answer_overlap"]

    def found(index: Index) -> DataFrame:
        shared = docs.sparkSession.sparkContext.broadcast(index)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                rows = []
                for doc_id, text in zip(batch.column(0), batch.column(1)):
                    for item, shares in shared.value.leaks(text.as_py(), least_score, least_overlap).items():
                        rows.append((doc_id.as_py(), shared.value.ids[item], *shares))
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(zip(*rows), kinds)], names)

        source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
        return source.mapInArrow(run, "doc_id long, item_id long, score double, question_overlap double, answer_overlap double")

    out = None
    for index in indexes(benchmark, shard_items):
        out = found(index) if out is None else out.unionByName(found(index))
    return out


def decontaminate(docs: DataFrame, benchmark: DataFrame, least_score: float = 0.5, least_overlap: float = 0.5, shard_items: int = 50_000) -> DataFrame:
    """The rows of docs without a leaked item, all columns unchanged; each shard of the index filters what the last one left."""
    for index in indexes(benchmark, shard_items):
        shared = docs.sparkSession.sparkContext.broadcast(index)

        def leaked(text, shared=shared):
            import pandas as pd

            return pd.Series([bool(shared.value.leaks(t or "", least_score, least_overlap)) for t in text], dtype="bool")

        docs = docs.where(~F.pandas_udf(lambda text, leaked=leaked: leaked(text), "boolean")(text_or_empty()))
    return docs
