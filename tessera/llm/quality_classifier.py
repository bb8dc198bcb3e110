"""Quality classifier: a linear support vector machine on n-gram indicators scaled by naive Bayes.

Character n-grams are hashed to a fixed number of slots. Each slot's log-count ratio of the two
classes scales its indicator; a hinge-loss model is fitted to the scaled indicators by dual
coordinate descent on a bounded sample of labelled texts, and its margins are calibrated on held
back training rows. Scoring reads every whole text once, in Arrow batches.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import labelled_sample, text_or_empty

SLOT_BITS = 16
#: Lengths of the n-grams, in bytes.
SIZES = (1, 2, 3)
#: Windows of words whose repetition in a text is an indicator of its own.
REPEATED_WORDS = 5
#: Bytes taken at once, so that a very long text needs bounded memory.
BLOCK = 1 << 20
#: Thresholds of the shares of repeated lines and of repeated windows; each has a slot after those of the n-grams.
LINES_AGAIN, WINDOWS_AGAIN = (0.0, 0.1, 0.3, 0.6), (0.0, 0.05, 0.1, 0.2, 0.4)
SLOTS = (1 << SLOT_BITS) + len(LINES_AGAIN) + len(WINDOWS_AGAIN)


def slots(text: str) -> np.ndarray:
    """The slots of a text's n-grams, each once, in order; an empty text has none."""
    data = np.frombuffer(text.encode(), dtype=np.uint8)
    seen = np.zeros(SLOTS, dtype=bool)
    for at in range(0, len(data), BLOCK):
        part = data[at : at + BLOCK + max(SIZES) - 1].astype(np.uint32)
        code = np.zeros(len(part), dtype=np.uint32)
        for n in range(1, max(SIZES) + 1):
            if len(part) < n:
                break
            code = (code[: len(part) - n + 1] << np.uint32(8)) | part[n - 1 :]
            if n in SIZES:
                seen[((code + np.uint32(n)) * np.uint32(2654435761)) >> np.uint32(32 - SLOT_BITS)] = True
    lines = [x for x in text.split("\n") if x.strip()]
    for k, share in enumerate(LINES_AGAIN, 1 << SLOT_BITS):
        if len(lines) > 1 and 1 - len(set(lines)) / len(lines) > share:
            seen[k] = True
    words = text.split()
    windows = len(words) - REPEATED_WORDS + 1
    if windows > 1:
        hashed = np.fromiter(map(hash, words), dtype=np.int64, count=len(words)).astype(np.uint64)
        gram = np.zeros(windows, dtype=np.uint64)
        for i in range(REPEATED_WORDS):
            gram = gram * np.uint64(0x9E3779B97F4A7C15) + hashed[i : i + windows]
        again = 1 - len(np.unique(gram)) / windows
        for k, share in enumerate(WINDOWS_AGAIN, (1 << SLOT_BITS) + len(LINES_AGAIN)):
            seen[k] = again > share
    return np.flatnonzero(seen)


@dataclass(frozen=True)
class Model:
    """Weight of each slot (ratio times support-vector weight), bias, and calibration."""

    weights: np.ndarray
    bias: float
    slope: float
    shift: float

    def margin(self, found: np.ndarray) -> float:
        return float(self.weights[found].sum() / np.sqrt(max(len(found), 1)) + self.bias)

    def score(self, text: str) -> float:
        return float(1 / (1 + np.exp(-(self.slope * self.margin(slots(text)) + self.shift))))


def log_ratios(rows: list[np.ndarray], y: np.ndarray, smooth: float = 1.0) -> np.ndarray:
    """Log ratio of each slot's smoothed share in class 1 and class 0."""
    counts = np.full((2, SLOTS), smooth)
    for found, label in zip(rows, y):
        counts[int(label), found] += 1
    shares = counts / (np.bincount(y.astype(int), minlength=2)[:, None] + 2 * smooth)
    return np.log(shares[1] / shares[0])


def descend(rows: list[np.ndarray], values: np.ndarray, y: np.ndarray, cost: float, passes: int, seed: int = 7) -> tuple[np.ndarray, float]:
    """Hinge-loss weights by dual coordinate descent; row i has values[slots] / sqrt(slots)."""
    w, bias, sign = np.zeros(len(values)), 0.0, np.where(y == 1, 1.0, -1.0)
    alpha = np.zeros(len(rows))
    x = [values[r] / np.sqrt(max(len(r), 1)) for r in rows]
    norm = np.array([v @ v + 1.0 for v in x])
    limit = np.where(y == 1, cost * len(y) / max(2 * (y == 1).sum(), 1), cost * len(y) / max(2 * (y == 0).sum(), 1))
    order = np.random.default_rng(seed)
    for _ in range(passes):
        for i in order.permutation(len(rows)):
            step = 1 - sign[i] * (w[rows[i]] @ x[i] + bias)
            new = min(max(alpha[i] + step / norm[i], 0.0), limit[i])
            if new != alpha[i]:
                change = (new - alpha[i]) * sign[i]
                w[rows[i]] += change * x[i]
                bias += change
                alpha[i] = new
    return w, bias


def calibrate(margins: np.ndarray, y: np.ndarray, steps: int = 200) -> tuple[float, float]:
    """Slope and shift of the logistic curve through (margin, label), by Newton's method."""
    a, b = 1.0, 0.0
    target = np.where(y == 1, (y.sum() + 1) / (y.sum() + 2), 1 / ((1 - y).sum() + 2))
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(a * margins + b, -30, 30)))
        g, h = p - target, p * (1 - p) + 1e-6
        matrix = np.array([[(h * margins**2).sum() + 1e-3, (h * margins).sum()], [(h * margins).sum(), h.sum() + 1e-3]])
        move = np.linalg.solve(matrix, np.array([(g * margins).sum(), g.sum()]))
        a, b = max(a - move[0], 1e-3), b - move[1]
        if np.abs(move).max() < 1e-6:
            break
    return float(a), float(b)


def fit(texts: list[str], labels: list[int], cost: float = 1.0, passes: int = 12) -> Model:
    """The model of labelled texts."""
    return fit_rows([slots(t) for t in texts], labels, cost, passes)


def fit_rows(rows: list[np.ndarray], labels: list[int], cost: float = 1.0, passes: int = 12) -> Model:
    """The model of labelled slots; with one class only, a constant score of that class (0.5 without any row)."""
    y = np.array(labels, dtype=int)
    if len(set(labels)) < 2:
        return Model(np.zeros(SLOTS), 0.0, 1.0, 0.0 if not labels else 4.0 * (2 * labels[0] - 1))

    def machine(use: np.ndarray) -> tuple[np.ndarray, float]:
        part = [rows[i] for i in use]
        ratios = log_ratios(part, y[use])
        w, bias = descend(part, ratios, y[use], cost, passes)
        return w * ratios, bias

    margins = np.zeros(len(y))
    for fold in range(3):
        held = np.arange(len(y)) % 3 == fold
        if len(set(y[~held])) < 2:
            continue
        w, bias = machine(np.flatnonzero(~held))
        for i in np.flatnonzero(held):
            margins[i] = w[rows[i]].sum() / np.sqrt(max(len(rows[i]), 1)) + bias
    slope, shift = calibrate(margins, y)
    w, bias = machine(np.arange(len(y)))
    return Model(w, bias, slope, shift)


def learn(docs: DataFrame, labels: DataFrame, label: str, train: Callable[[str], Column], limit: int = 4000) -> Model:
    """Fit on at most about `limit` labelled documents, the whole text of each.

    Only the slots of a text, of which there are at most SLOTS, reach the driver.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [slots(t.as_py()).astype(np.int32) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(found, pa.list_(pa.int32()))], ["doc_id", "y", "slots"])

    sample = labelled_sample(docs, labels, label, train, limit).select(F.col("doc_id").cast("long").alias("doc_id"), "text", "y")
    got = sample.mapInArrow(run, "doc_id long, y int, slots array<int>").toArrow()
    rows = sorted(zip(got["doc_id"].to_pylist(), got["y"].to_pylist(), (tuple(x.values.to_numpy()) for x in got["slots"])))
    return fit_rows([np.array(r[2], dtype=np.int64) for r in rows], [r[1] for r in rows])


def score(docs: DataFrame, model: Model, id_column: str = "doc_id") -> DataFrame:
    """(doc_id, score) of every row; null text is scored as empty, repeated rows and null ids stay."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = [shared.value.score(t.as_py()) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores, pa.float64())], ["doc_id", "score"])

    return docs.select(F.col(id_column).cast("long").alias("doc_id"), text_or_empty().alias("text")).mapInArrow(run, "doc_id long, score double")
