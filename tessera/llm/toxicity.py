"""Toxicity by compression distance: which of two zstandard dictionaries shortens a text's windows.

One dictionary is learnt from windows typical of toxic training texts, one from windows of ordinary
ones; both are content dictionaries, most frequent windows last, where references are cheapest
(zstandard's own trainer keeps segments too long for windows this short and ranks texts worse).
Every window of a text (one word in a fixed frame) is compressed with both; how many bytes the
toxic dictionary saves over the ordinary one is its distance. A calibrated logistic curve over
the numbers and shares of windows beyond a few distances gives the text's score.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import forget, labelled_sample, text_or_empty, tidy

#: Saved bytes at which windows are counted.
CUTS = (2, 3, 4, 5, 6, 8)
#: Characters of a window; longer words are several windows.
WINDOW = 48
#: Windows whose distance a worker remembers at most.
REMEMBERED = 150_000
#: What stands before and after a window: a word alone is too short for zstandard to compress.
FRAME = ("<<<< ", " ")
PUNCTUATION = ".,;:!?\"'()[]{}|*#$%&<>-_/\\"


def windows(text: str) -> list[str]:
    """Lower-case words without outer punctuation, long ones in parts of WINDOW characters."""
    words = [w.strip(PUNCTUATION) for w in text.lower().split()]
    if max(map(len, words), default=0) <= WINDOW:
        return words
    return [w[i : i + WINDOW] for w in words for i in range(0, max(len(w), 1), WINDOW)]


def starts(word: str) -> list[str]:
    """The word with its blanks and its beginnings of 4 to 8 characters."""
    padded = f" {word} "
    return [padded[:n] for n in range(5, min(10, len(padded)))] + [padded]


@dataclass
class Model:
    """Dictionaries and the logistic curve; compressors are made where they are used."""

    toxic: bytes
    ordinary: bytes
    weights: np.ndarray
    known: dict[str, int] = field(default_factory=dict)

    def __post_init__(self) -> None:
        self.pair = None

    def __getstate__(self) -> dict:
        return {"toxic": self.toxic, "ordinary": self.ordinary, "weights": self.weights}

    def __setstate__(self, state: dict) -> None:
        self.__dict__.update(state, known={}, pair=None)

    def distance(self, word: str) -> int:
        """Bytes that the toxic dictionary saves over the ordinary one; 0 below three characters."""
        if len(word) < 3:
            return 0
        found = self.known.get(word)
        if found is None:
            if self.pair is None:
                import zstandard as z

                plain = {"format": z.FORMAT_ZSTD1_MAGICLESS, "write_content_size": False, "write_checksum": False, "write_dict_id": False}
                made = z.ZstdCompressionParameters.from_level(9, min_match=3, strategy=z.STRATEGY_BTOPT, **plain)
                self.pair = []
                for content in (self.toxic, self.ordinary):
                    known = z.ZstdCompressionDict(content, dict_type=z.DICT_TYPE_RAWCONTENT)
                    known.precompute_compress(compression_params=made)
                    self.pair.append(z.ZstdCompressor(dict_data=known, compression_params=made).compress)
            data = framed(word)
            found = len(self.pair[1](data)) - len(self.pair[0](data))
            if len(self.known) < REMEMBERED:
                self.known[word] = found
        return found

    def features(self, text: str) -> np.ndarray:
        """Per cut: log of the number of windows at or beyond it, and their share; then a constant."""
        found = np.fromiter(map(self.distance, windows(text)), dtype=np.int32)
        counts = np.array([(found >= c).sum() for c in CUTS], dtype=float)
        return np.concatenate([np.log1p(counts), np.minimum(100 * counts / max(len(found), 20), 10), [1.0]])

    def score(self, text: str) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.features(text) @ self.weights, -30, 30))))


def typical(texts: list[str], others: list[str], least: float = 6.0) -> set[str]:
    """Word beginnings whose share of texts exceeds that of others by `least` standard errors."""
    a, b = (Counter(s for t in group for s in {s for w in set(windows(t)) for s in starts(w)}) for group in (texts, others))
    na, nb = max(len(texts), 1), max(len(others), 1)
    out = set()
    for s, n in a.items():
        p, q = n / na, b[s] / nb
        pooled = (n + b[s]) / (na + nb)
        if n >= 3 and p > 2 * q and (p - q) >= least * np.sqrt(pooled * (1 - pooled) * (1 / na + 1 / nb)):
            out.add(s)
    return out


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    """Weights of the regularised logistic curve, by Newton's method."""
    w = np.zeros(x.shape[1])
    penalty = np.full(x.shape[1], ridge)
    penalty[-1] = 1e-3
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(penalty), x.T @ (p - y) + penalty * w)
        w -= np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-6:
            break
    return w


def framed(word: str) -> bytes:
    return f"{FRAME[0]}{word}{FRAME[1]}".encode("utf-8", "replace")


def dictionaries(texts: list[str], y: np.ndarray, size: int) -> tuple[bytes, bytes]:
    """Contents of the windows that are typical of class 1, and of the commonest ones of class 0."""
    bad, good = [t for t, v in zip(texts, y) if v], [t for t, v in zip(texts, y) if not v]
    marks = typical(bad, good)
    toxic = Counter(w for t in bad for w in windows(t) if any(s in marks for s in starts(w)))
    ordinary = Counter(w for t in good for w in set(windows(t)) if len(w) > 2)
    by_number = lambda found: [w for w, _ in sorted(found.items(), key=lambda x: (x[1], x[0]))]
    content = lambda found, most: b"".join(map(framed, by_number(found)))[-most:] or b" "
    return content(toxic, size), content(ordinary, 2 * size)


def fit(texts: list[str], labels: list[int], size: int = 4096) -> Model:
    """The model. The curve is fitted to texts that the dictionaries it uses were not trained on.

    With one class only the score is constant: near that class, 0.5 without any row.
    """
    y = np.array(labels, dtype=float)
    constant = np.zeros(2 * len(CUTS) + 1)
    if len(set(labels)) < 2:
        constant[-1] = 4.0 * (2 * labels[0] - 1) if labels else 0.0
        return Model(b" ", b" ", constant)
    rows = np.zeros((len(texts), len(constant)))
    for fold in range(3):
        held = np.arange(len(texts)) % 3 == fold
        model = Model(*dictionaries([t for t, h in zip(texts, held) if not h], y[~held], size), constant)
        for i in np.flatnonzero(held):
            rows[i] = model.features(texts[i])
    return Model(*dictionaries(texts, y, size), logistic(rows, y))


def learn(docs: DataFrame, labels: DataFrame, label: str, train: Callable[[str], Column], limit: int = 3000, most_chars: int = 10_000) -> Model:
    """Fit on at most about `limit` labelled documents of at most most_chars characters each.

    Both bounds hold for training alone and keep what reaches the driver below 30 MB.
    """
    sample = labelled_sample(docs, labels, label, train, limit).where(F.length("text") <= most_chars)
    rows = sorted((r["doc_id"], r["text"], r["y"]) for r in sample.collect())
    return fit([r[1] for r in rows], [r[2] for r in rows])


def scores(docs: DataFrame, model: Model) -> Column:
    """The score of each row's text; null text is scored as empty, whole texts are read."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def scored(text):
        import pandas as pd

        forget()
        out = pd.Series([shared.value.score(t or "") for t in text], dtype="float64")
        tidy()
        return out

    return scored(text_or_empty())


def score(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, score) of every row; repeated rows and null ids stay, an empty table gives none."""
    return docs.select("doc_id", scores(docs, model).alias("score"))


def reject(docs: DataFrame, model: Model, least: float = 0.7) -> DataFrame:
    """The rows of docs that score below `least`, all columns unchanged."""
    return docs.where(scores(docs, model) < least)
