"""Hard negatives by radix selection: histograms of integer scores find the k-th best, digit by digit.

A window is a range of scores of one anchor, over the rows of its own label (to find positives) or of
all others (to find negatives). Each pass over the rows counts, per task, how many scores of a window
fall into each of up to 256 buckets; Spark adds the counts and finds the bucket of the k-th best;
the next pass looks only into that bucket. Once few rows are left, or one score and one digit of the
ids that break its ties, the rows from there upwards are gathered and ranked. Anchors come in blocks
of bounded size, so nothing of the size of the table reaches the driver or a task.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import durable, small_batches

#: Buckets of one digit, and how many rows more than k a window may gather before another digit is looked at.
BUCKETS, SPARE = 256, 64
#: Components beyond this size count as this size, so that inner products of 2,048 of them fit into a long.
LARGEST = 1 << 26
#: Least values of the buckets by number of bits: a first digit for values of unknown range.
BITS = np.array([-(1 << 63), *[-(1 << b) for b in range(62, -1, -1)], 0, *[1 << b for b in range(63)]], dtype=np.int64)


def decoded(batch: pa.RecordBatch, scale: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ids, labels and a matrix of floor(scale * component) of the rows whose components are all finite.

    Vectors shorter than the longest of the batch are filled with zeros.
    """
    ids, labels = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
    lists = batch.column(2)
    values = lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    sizes = lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    out = np.zeros((len(ids), int(sizes.max(initial=0))))
    out[np.arange(out.shape[1]) < sizes[:, None]] = values
    fit = np.isfinite(out).all(axis=1)
    return ids[fit], labels[fit], np.clip(np.floor(scale * out[fit]), -LARGEST, LARGEST)


def inner(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact integer inner products of the rows of a with those of b."""
    width = min(a.shape[1], b.shape[1])
    a, b = a[:, :width], b[:, :width]
    bound = np.abs(a).sum(axis=1).max(initial=0) * np.abs(b).max(initial=0)
    for kind, bits in ((np.float32, 24), (np.float64, 53)):
        if bound < 1 << bits:
            return (a.astype(kind) @ b.astype(kind).T).astype(np.int64)
    return a.astype(np.int64) @ b.astype(np.int64).T


@dataclass
class Windows:
    """One row per window: its anchor, its open range, and how many are still to be found there.

    by: what the next digit is of: 0 a score of unknown range, 1 a score, 2 an id of unknown range,
    3 an id, 4 nothing more. Of a closed window the rows from (low, id_high) upwards are gathered.
    """

    anchor: np.ndarray
    low: np.ndarray
    high: np.ndarray
    k: np.ndarray
    positive: np.ndarray
    positive_score: np.ndarray
    by: np.ndarray = field(init=False)

    def __post_init__(self) -> None:
        n = len(self.anchor)
        self.top = self.high.copy()
        self.by = np.where(self.low == BITS[0], 0, 1)
        self.left = self.k.copy()
        self.id_low, self.id_high = np.full(n, BITS[0]), np.full(n, np.iinfo(np.int64).max)

    def shift(self, width: int) -> int:
        return max(0, int(width).bit_length() - 8)

    def bucket(self, w: int, score: np.ndarray, ids: np.ndarray) -> np.ndarray:
        """Numbers of the buckets, best first, of the rows in the open range of window w."""
        low, high, by = self.low[w], self.high[w], self.by[w]
        inside = (score >= low) & (score <= high)
        if by == 0:
            return len(BITS) - np.searchsorted(BITS, score[inside], "right")
        if by == 1:
            return (high - score[inside]) >> self.shift(int(high) - int(low))
        own = ids[inside]
        own = own[(own >= self.id_low[w]) & (own <= self.id_high[w])]
        if by == 2:
            return np.searchsorted(BITS, own, "right") - 1
        return (own - self.id_low[w]) >> self.shift(int(self.id_high[w]) - int(self.id_low[w]))

    def narrow(self, w: int, bucket: int, before: int, n: int) -> None:
        """The k-th best of window w is in this bucket of n rows; so many are before it."""
        if self.by[w] == 0:
            at = len(BITS) - bucket - 1
            self.low[w], self.high[w] = BITS[at], min(int(self.high[w]), int(BITS[at + 1]) - 1 if at + 1 < len(BITS) else (1 << 63) - 1)
        elif self.by[w] == 1:
            step = self.shift(int(self.high[w]) - int(self.low[w]))
            high = int(self.high[w]) - (bucket << step)
            self.low[w], self.high[w] = max(int(self.low[w]), high - (1 << step) + 1), high
        elif self.by[w] == 2:
            self.id_low[w], self.id_high[w] = BITS[bucket], int(BITS[bucket + 1]) - 1 if bucket + 1 < len(BITS) else (1 << 63) - 1
        else:
            step = self.shift(int(self.id_high[w]) - int(self.id_low[w]))
            low = int(self.id_low[w]) + (bucket << step)
            self.id_low[w], self.id_high[w] = low, min(int(self.id_high[w]), low + (1 << step) - 1)
        self.left[w] -= before
        if self.k[w] - self.left[w] + n <= self.k[w] + SPARE:
            self.by[w] = 4
        elif self.by[w] < 2:
            self.by[w] = 1 if self.high[w] > self.low[w] else 2
        else:
            self.by[w] = 3 if self.id_high[w] > self.id_low[w] else 4

    def gathered(self, w: int, score: np.ndarray, ids: np.ndarray) -> np.ndarray:
        """Which rows of window w are the k-th best or better, and at most SPARE or equal rows more."""
        return (score <= self.top[w]) & ((score > self.low[w]) | ((score == self.low[w]) & (ids <= self.id_high[w])))


class Block:
    """A block of anchors, and the windows of each."""

    def __init__(self, ids: np.ndarray, labels: np.ndarray, matrix: np.ndarray):
        self.ids, self.labels, self.matrix = ids, labels, matrix

    def eligible(self, batch: pa.RecordBatch, scale: int, windows: Windows, same: bool) -> Iterator[tuple[range, np.ndarray, np.ndarray]]:
        """Per anchor with windows: these, and the scores and ids of the rows that may count for them."""
        ids, labels, matrix = decoded(batch, scale)
        if not len(ids):
            return
        starts = np.searchsorted(windows.anchor, np.arange(len(self.ids) + 1))
        used = np.flatnonzero(np.diff(starts))
        least = np.minimum.reduceat(windows.low, starts[used]) if len(used) else []
        most = np.maximum.reduceat(windows.top, starts[used]) if len(used) else []
        alike = {y: labels == y for y in np.unique(self.labels[used])}
        step = max(1, (1 << 22) // len(ids))
        for i in range(0, len(used), step):
            scores = inner(self.matrix[used[i : i + step]], matrix)
            for a, low, high, score in zip(used[i : i + step], least[i : i + step], most[i : i + step], scores):
                own = alike[self.labels[a]]
                at = np.flatnonzero((own if same else ~own) & (score >= low) & (score <= high) & (ids != self.ids[a]))
                if len(at):
                    yield range(starts[a], starts[a + 1]), score[at], ids[at]


def select(rows: DataFrame, block: Block, windows: Windows, same: bool, scale: int) -> DataFrame:
    """(anchor_id, positive_id, positive_score, id, score, place): the k best of each window, by score, then smaller id."""
    spark = rows.sparkSession
    place = Window.partitionBy("w").orderBy("bucket")
    while (windows.by < 4).any():
        shared = spark.sparkContext.broadcast((block, windows))

        def counted(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            block, windows = shared.value
            counts = np.zeros((len(windows.by), BUCKETS), dtype=np.int64)
            for batch in batches:
                for own, score, ids in block.eligible(batch, scale, windows, same):
                    for w in own:
                        if windows.by[w] < 4:
                            counts[w] += np.bincount(windows.bucket(w, score, ids), minlength=BUCKETS)
            w, bucket = np.nonzero(counts)
            yield pa.RecordBatch.from_arrays([pa.array(w), pa.array(windows.left[w]), pa.array(bucket), pa.array(counts[w, bucket])], ["w", "k", "bucket", "n"])

        counts = rows.mapInArrow(counted, "w long, k long, bucket long, n long").groupBy("w", "k", "bucket").agg(F.sum("n").alias("n"))
        found = counts.withColumn("upto", F.sum("n").over(place)).where("upto >= k and upto - n < k").toArrow().to_pydict()
        fewer = np.ones(len(windows.by), dtype=bool)
        for w, bucket, n, upto in zip(found["w"], found["bucket"], found["n"], found["upto"]):
            fewer[w] = False
            windows.narrow(w, bucket, upto - n, n)
        windows.by[fewer] = 4  # the whole open range is needed
        shared.destroy()
    shared = spark.sparkContext.broadcast((block, windows))

    def gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, windows = shared.value
        for batch in batches:
            parts = []
            for own, score, ids in block.eligible(batch, scale, windows, same):
                for w in own:
                    at = windows.gathered(w, score, ids)
                    n = int(at.sum())
                    parts.append((np.full(n, block.ids[windows.anchor[w]]), np.full(n, windows.positive[w]), np.full(n, windows.positive_score[w]), ids[at], score[at]))
            if parts:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*parts)], ["anchor_id", "positive_id", "positive_score", "id", "score"])

    best = Window.partitionBy("anchor_id", "positive_id", "positive_score").orderBy(F.desc("score"), "id")
    ranked = rows.mapInArrow(gathered, "anchor_id long, positive_id long, positive_score long, id long, score long").withColumn("place", F.row_number().over(best))
    return ranked.where(F.col("place") <= int(windows.k.max(initial=0)))


def mine(
    vectors: DataFrame, anchor: Column, positives: int = 5, negatives: int = 10, low: int = 30, high: int = 90,
    scale: int = 256, block: int = 2048, id_column: str = "vec_id", vector: str = "embedding", label: str = "label",
    each: Callable[[DataFrame], None] | None = None,
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) of the rows that the condition makes anchors.

    An anchor's positives are its best other rows of its label; a positive's negatives are the best rows
    of other labels with low % to high % of the positive's score. Scores are inner products of
    floor(scale * component); ties go to the smaller id. Rows with a null id, label or vector, or a null or
    non-finite component, take no part; an empty vector scores 0, and components that only one of two
    vectors has count as zero. Repeated rows each count, as positives and as negatives, but never for an
    anchor of their own id; positives of one id and score are reported once; of anchors with one id that
    of the least label and vector counts. Windows without a row give none; no anchors, no rows. Other
    columns are ignored.

    block: anchors at a time, which bounds what is broadcast (anchors and windows) and each task's histograms;
    `each`, if given, is called with the rows of every block.
    """
    spark = vectors.sparkSession
    rows = vectors.select(F.col(id_column).cast("long").alias("id"), F.col(label).cast("long").alias("label"), F.col(vector).alias("vector"), anchor.alias("is_anchor")).dropna(subset=["id", "label", "vector"])
    anchors = rows.where("is_anchor").groupBy("id").agg(F.min(F.struct("label", "vector")).alias("own")).select("id", "own.label", "own.vector")
    rows = rows.select("id", "label", "vector")
    blocks = -(-anchors.count() // block)
    out = None
    with small_batches(spark, 2048):
        for b in range(blocks):
            found = anchors.where(F.pmod(F.xxhash64("id"), F.lit(blocks)) == b).toArrow().combine_chunks()
            if not found.num_rows:
                continue
            own = Block(*decoded(found.to_batches()[0], scale))
            every = np.arange(len(own.ids))
            zeros = np.zeros_like(every)
            first = select(rows, own, Windows(every, zeros + BITS[0], zeros + np.iinfo(np.int64).max, zeros + positives, zeros, zeros), True, scale)
            pairs = first.select("anchor_id", "id", "score").distinct().toArrow().to_pydict()
            at = {int(x): i for i, x in enumerate(own.ids)}
            ranges = sorted((at[a], -(-low * p // 100) if low * p >= 0 else -(low * -p // 100), high * p // 100, i, p) for a, i, p in zip(pairs["anchor_id"], pairs["id"], pairs["score"]))
            ranges = [r for r in ranges if r[1] <= r[2]]
            columns = [np.array(c, dtype=np.int64) for c in zip(*ranges)] or [every[:0]] * 5
            asked = Windows(columns[0], columns[1], columns[2], np.full(len(ranges), negatives), columns[3], columns[4])
            part = durable(select(rows, own, asked, False, scale).select("anchor_id", "positive_id", F.col("place").cast("int").alias("rank"), F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score")))
            if each:
                each(part)
            out = part if out is None else out.unionByName(part)
    empty = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    return spark.createDataFrame([], empty) if out is None else out
