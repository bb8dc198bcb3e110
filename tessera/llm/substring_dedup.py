"""Substring deduplication: word windows that a document with a smaller id also holds are removed.

A sparse suffix tree in parts. Suffixes are rooted at anchors: the least hash of each window's
word n-grams, so that equal windows hold the same anchor at the same place. An anchor's n-gram is
the prefix that deals suffixes out; prefixes of one document only are dropped. Groups that fit in
memory are built as they are: ranks of word sequences, doubled in length up to the window, name
the internal nodes at the window's depth, and each node's smallest document keeps its words. Where a
group is too large its prefix is lengthened to the whole window; each such prefix is one node, whose
smallest document is a pre-aggregated minimum.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Membership, durable, text_or_empty

WINDOW = 50
#: Words of the shortest prefix.
PREFIX = 8
#: Suffixes of one group that are built in memory at most.
GROUP = 20_000
FACTOR = np.uint64(0x9E3779B97F4A7C15)


def split(text: str) -> list[bytes]:
    """Words between ASCII white space."""
    return text.encode().split()


def signature(words: list[bytes]) -> int:
    """Signed 64-bit hash of a word sequence."""
    return xxhash.xxh3_64_intdigest(b" ".join(words)) - (1 << 63)


def rolled(words: list[bytes], size: int, factor: np.uint64 = FACTOR) -> np.ndarray:
    """Hash of each run of `size` words."""
    hashed = np.fromiter(map(xxhash.xxh3_64_intdigest, words), dtype=np.uint64, count=len(words))
    out = np.zeros(len(words) - size + 1, dtype=np.uint64)
    for i in range(size):
        out = out * factor + hashed[i : len(words) - size + 1 + i]
    out ^= out >> np.uint64(31)
    out *= np.uint64(0xD6E8FEB86659FD93)
    return out ^ (out >> np.uint64(32))


def anchors(words: list[bytes], window: int, prefix: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions of the windows' least n-gram hashes (the first of equal ones), and the hashes."""
    grams = rolled(words, prefix)
    span = window - prefix + 1
    picked = []
    for at in range(0, len(grams) - span + 1, 1 << 16):
        part = np.lib.stride_tricks.sliding_window_view(grams[at : at + (1 << 16) + span - 1], span)
        picked.append(np.unique(part.argmin(axis=1) + np.arange(at, at + len(part))))
    positions = np.unique(np.concatenate(picked))
    return positions, grams[positions].view(np.int64)


def _source(docs: DataFrame, *more: str) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"), *more)


def scan(docs: DataFrame, window: int, prefix: int) -> DataFrame:
    """(doc_id, n, sig, pos, keys): number of words, hash of all, and anchors with their hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text in batch.column(1):
                words = split(text.as_py())
                pos, keys = anchors(words, window, prefix) if len(words) >= window else (np.empty(0, np.int64), np.empty(0, np.int64))
                rows.append((len(words), signature(words), pos, keys))
            n, sig, pos, keys = zip(*rows) if rows else ((), (), (), ())
            columns = [batch.column(0), pa.array(n, pa.int64()), pa.array(sig, pa.int64()), pa.array(pos, pa.list_(pa.int64())), pa.array(keys, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n", "sig", "pos", "keys"])

    return _source(docs).mapInArrow(run, "doc_id long, n long, sig long, pos array<long>, keys array<long>")


def runs(starts: np.ndarray, window: int) -> list[tuple[int, int]]:
    """Word ranges covered by windows at the sorted starts."""
    if not len(starts):
        return []
    breaks = np.flatnonzero(np.diff(starts) > window)
    first = starts[np.concatenate([[0], breaks + 1])]
    last = starts[np.concatenate([breaks, [len(starts) - 1]])]
    return list(zip(first.tolist(), (last + window).tolist()))


def nodes(words: list[bytes], window: int) -> np.ndarray:
    """For each position, the number of the depth-`window` node its suffix passes through.

    Equal numbers mean equal next `window` words. Positions too near the end get numbers of no
    meaning.
    """
    number: dict[bytes, int] = {}
    rank = np.fromiter((number.setdefault(w, len(number)) for w in words), dtype=np.int64, count=len(words))
    length = 1
    while length < window:
        step = min(length, window - length)
        ahead = np.concatenate([rank[step:], np.zeros(min(step, len(rank)), dtype=np.int64)])
        rank = np.unique(rank * (int(rank.max(initial=0)) + 1) + ahead, return_inverse=True)[1]
        length += step
    return rank


def repeats(pieces: list[tuple[int, int, int, bytes]], window: int) -> list[tuple[int, int, int, int]]:
    """(doc, sig, from, to) of words whose window starts in a smaller doc among the pieces.

    pieces: (doc, sig, index of the first word, words joined by blanks).
    """
    words: list[bytes] = []
    ends, begins = [], []
    for _, _, _, text in pieces:
        begins.append(len(words))
        words += text.split(b" ")
        ends.append(len(words))
    node = nodes(words, window)
    starts = [np.arange(b, e - window + 1) for b, e in zip(begins, ends)]
    flat = np.concatenate(starts)
    sizes = [len(s) for s in starts]
    docs = np.repeat(np.array([p[0] for p in pieces], dtype=np.int64), sizes)
    smallest = np.full(int(node.max(initial=0)) + 1, np.iinfo(np.int64).max)
    np.minimum.at(smallest, node[flat], docs)
    again = smallest[node[flat]] < docs
    out = []
    at = 0
    for (doc, sig, first, _), begin, size in zip(pieces, begins, sizes):
        own = flat[at : at + size][again[at : at + size]] - begin + first
        out += [(doc, sig, a, b) for a, b in runs(own, window)]
        at += size
    return out


NAMES = ["doc_id", "sig", "from", "to"]
RANGES = "doc_id long, sig long, from long, to long"


def _ranges(rows: list[tuple[int, int, int, int]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows)], NAMES)


def in_memory(found: DataFrame, window: int, prefix: int) -> DataFrame:
    """Repeated ranges from the groups that fit in memory; found: doc_id, text, sig, anchors."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for doc_id, text, sig, own in zip(*(c.to_pylist() for c in batch.columns)):
                words = split(text)
                if signature(words) != sig:
                    continue
                rows = []
                for a in own:
                    if not a["large"]:
                        first = max(0, a["pos"] - window + prefix)
                        rows.append((a["key"], doc_id, sig, first, b" ".join(words[first : a["pos"] + window])))
                if rows:
                    kinds = [pa.int64()] * 4 + [pa.binary()]
                    yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(zip(*rows), kinds)], ["key", "doc_id", "sig", "first", "words"])

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces: list[tuple[int, int, int, bytes]] = []
        last = None
        for batch in batches:
            for key, *piece in zip(*(c.to_pylist() for c in batch.columns)):
                if key != last and len(pieces) >= GROUP:
                    if rows := repeats(pieces, window):
                        yield _ranges(rows)
                    pieces = []
                last = key
                pieces.append(tuple(piece))
        if pieces and (rows := repeats(pieces, window)):
            yield _ranges(rows)

    parts = found.mapInArrow(cut, "key long, doc_id long, sig long, first long, words binary")
    return parts.repartition("key").sortWithinPartitions("key").mapInArrow(build, RANGES)


def by_whole_window(found: DataFrame, window: int, prefix: int) -> DataFrame:
    """Repeated ranges from the large groups: every window is its own prefix, hashed to 128 bits."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for doc_id, text, sig, own in zip(*(c.to_pylist() for c in batch.columns)):
                words = split(text)
                if signature(words) != sig or len(words) < window or not any(a["large"] for a in own):
                    continue
                starts = np.unique(np.concatenate([np.arange(max(0, a["pos"] - window + prefix), min(a["pos"], len(words) - window) + 1) for a in own if a["large"]]))
                hashes = [rolled(words, window, f)[starts].view(np.int64) for f in (FACTOR, np.uint64(0xC2B2AE3D27D4EB4F))]
                same = [np.full(len(starts), v, dtype=np.int64) for v in (doc_id, sig)]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in (*hashes, *same, starts)], ["x", "y", "doc_id", "sig", "start"])

    windows = found.mapInArrow(cut, "x long, y long, doc_id long, sig long, start long")
    smallest = windows.groupBy("x", "y").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most")).where("least <> most")
    again = windows.join(smallest, ["x", "y"]).where("doc_id > least")
    return again.select("doc_id", "sig", F.col("start").alias("from"), (F.col("start") + window).alias("to"))


def repeated_ranges(docs: DataFrame, window: int = WINDOW, prefix: int = PREFIX, group: int = GROUP) -> DataFrame:
    """(doc_id, sig, ranges): word ranges of each document that windows of a smaller doc_id cover."""
    docs = docs.select("doc_id", "text").where(F.col("doc_id").isNotNull())
    scanned = durable(scan(docs, window, prefix))
    classes = durable(scanned.groupBy("sig").agg(F.min("doc_id").alias("rep")))
    copies = scanned.where(F.col("n") >= window).join(classes, "sig").where("doc_id <> rep").select("doc_id", "sig", F.lit(0).cast("long").alias("from"), F.col("n").alias("to"))
    suffixes = scanned.select("sig", F.explode(F.arrays_zip("pos", "keys")).alias("a")).select("sig", F.col("a.pos").alias("pos"), F.col("a.keys").alias("key"))
    lists = suffixes.groupBy("key").agg(F.min("sig").alias("lo"), F.max("sig").alias("hi"), F.count("*").alias("size")).where("lo <> hi")
    lists = durable(lists.select(F.col("key").alias("_key"), (F.col("size") > group).alias("large")))
    shared = Membership(lists, "_key").sieve(suffixes, "key").join(lists, F.col("key") == F.col("_key"))
    own = shared.groupBy("sig").agg(F.collect_set(F.struct("pos", "key", "large")).alias("own"))
    wanted = durable(own.join(classes, "sig").select(F.col("rep").alias("_doc"), "sig", "own"))
    found = Membership(wanted, "_doc").sieve(_source(docs), "doc_id").join(wanted, F.col("doc_id") == F.col("_doc")).select("doc_id", "text", "sig", "own")
    ranges = in_memory(found, window, prefix)
    if not lists.where("large").isEmpty():
        ranges = ranges.unionByName(by_whole_window(found, window, prefix))
    return ranges.unionByName(copies).groupBy("doc_id", "sig").agg(F.collect_set(F.struct("from", "to")).alias("ranges"))


def covered(ranges: list[dict] | None, n: int) -> list[tuple[int, int]]:
    """The ranges merged, in order, within n words."""
    out: list[tuple[int, int]] = []
    for a, b in sorted((r["from"], min(r["to"], n)) for r in ranges or ()):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], b))
        elif a < n:
            out.append((a, b))
    return out


def dedup_substrings(docs: DataFrame, window: int = WINDOW, prefix: int = PREFIX, group: int = GROUP, with_text: bool = False) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256[, text]) of every row; text: kept words, one blank between.

    A word is removed if a window of `window` consecutive words that covers it also starts in a
    document of smaller doc_id; all windows are judged on the input. Null and empty texts have no
    words; shorter texts than a window lose none; repeated rows of one doc_id do not remove each
    other; rows with a null doc_id are neither changed nor a reason.
    """
    ranges = durable(repeated_ranges(docs, window, prefix, group).groupBy("doc_id").agg(F.collect_list(F.struct("sig", "ranges")).alias("_own")).withColumnRenamed("doc_id", "_doc"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text, own in zip(batch.column(1), batch.column(2)):
                words, own = split(text.as_py()), own.as_py()
                kept, at = words, 0
                if own:
                    sig = signature(words)
                    kept = []
                    for a, b in covered([r for o in own if o["sig"] == sig for r in o["ranges"]], len(words)):
                        kept += words[at:a]
                        at = b
                    kept += words[at:]
                joined = b" ".join(kept)
                rows.append((len(words), len(words) - len(kept), hashlib.sha256(joined).hexdigest(), joined.decode() if with_text else ""))
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.string()]
            columns = [pa.array(c, kind) for c, kind in zip(zip(*rows) if rows else [()] * 4, kinds)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns][: 4 + with_text], ["doc_id", "n_words", "n_removed", "kept_sha256", "text"][: 4 + with_text])

    joined = _source(docs).join(ranges, F.col("doc_id") == F.col("_doc"), "left").select("doc_id", "text", "_own")
    return joined.mapInArrow(run, "doc_id long, n_words long, n_removed long, kept_sha256 string" + (", text string" if with_text else ""))
