"""Best-fit packing of tokenised documents into sequences of a fixed capacity.

The lengths of all pieces form a histogram with one entry per length, which is all the driver
sees. A configuration linear program over it (how many sequences of which make-up) is solved by
multiplicative weights; the most valuable configuration under the current weights comes from a
knapsack dynamic programme. Fractional solutions are rounded down and the rest is placed best fit
decreasing, again on counts. The resulting plan maps (length, rank) to (sequence, offset), so the
placement of pieces is one join and one window over salted groups.
"""

from __future__ import annotations

import bisect
import json
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import durable, kept, small_batches, text_or_empty, tidy

CAPACITY = 1024
END_ID = 2
#: Words whose ids a worker remembers at most.
REMEMBERED = 200_000


class Encoder:
    """Ids of a byte-level BPE file as the tokenizers library gives them, word by word.

    White space separates pre-tokens, so a word's ids depend only on whether a blank precedes it;
    they are computed once by the same merges in tiktoken and remembered. Texts with any other
    white space than single blanks and line feeds, with special tokens, or with letters beyond
    Latin go through tokenizers itself.
    """

    def __init__(self, path: str):
        import tiktoken
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            model = json.load(f)
        specials = {t["content"] for t in model.get("added_tokens", ())}
        printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
        others = [b for b in range(256) if b not in printable]
        byte_of = {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(others)}
        ranks = {bytes(byte_of[c] for c in token): i for token, i in model["model"]["vocab"].items() if token not in specials}
        split = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
        self.merge = tiktoken.Encoding("words", pat_str=split, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        self.specials = tuple(specials)
        self.after_blank: dict[str, bytes] = {}
        self.after_other: dict[str, bytes] = {}
        self.line_feed = self._slow("\n")

    def _slow(self, text: str) -> bytes:
        return np.array(self.whole.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()

    def _word(self, known: dict[str, bytes], prefix: str, word: str) -> bytes:
        found = known.get(word)
        if found is None:
            if max(word, default="") < "ɐ":
                found = np.array(self.merge(prefix + word), dtype="<u4").tobytes()
            else:
                found = self._slow(prefix + word)
            if len(known) < REMEMBERED:
                known[word] = found
        return found

    def encode(self, text: str) -> bytes:
        """The ids as little-endian unsigned 32-bit numbers."""
        words = text.split()
        plain = words and sum(map(len, words)) + len(words) - 1 == len(text) and text.count(" ") + text.count("\n") == len(words) - 1
        if not plain or any(s in text for s in self.specials):
            return self._slow(text)
        out, blank, other = [], self.after_blank, self.after_other
        for i, line in enumerate(text.split("\n")):
            if i:
                out.append(self.line_feed)
            first, *rest = line.split(" ")
            out.append(other.get(first) or self._word(other, "", first))
            out += [blank.get(w) or self._word(blank, " ", w) for w in rest]
        return b"".join(out)


def encoder(path: str) -> Encoder:
    """One encoder per worker process, until a stage without one runs there."""
    return kept(f"encoder {path}", lambda: Encoder(path))


def cut(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of each piece of n ids: full pieces, the first may be shorter."""
    first = n % capacity or capacity
    return [(0, first)] + [(s, capacity) for s in range(first, n, capacity)]


def pieces(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, end_id: int = END_ID, with_ids: bool = False) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32[, ids]) of every document's ids and end id.

    Null text counts as empty and gives the end id alone; a null doc_id is kept; repeated rows give
    repeated pieces; an empty table gives none. Whole texts are encoded, whatever their length.
    """
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + (", ids array<int>" if with_ids else "")
    end = np.array([end_id], dtype="<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer_path).encode
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                rows: list[tuple] = []
                for doc_id, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                    ids = (enc(text) if text else b"") + end
                    for k, (start, length) in enumerate(cut(len(ids) // 4, capacity)):
                        own = ids[4 * start : 4 * (start + length)]
                        row = (doc_id, k, start, length, zlib.crc32(own))
                        rows.append((*row, np.frombuffer(own, "<u4").astype("int32").tolist()) if with_ids else row)
                kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int32())]
                names = ["doc_id", "piece", "start", "length", "ids_crc32", "ids"]
                columns = list(zip(*rows))
                yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(columns, kinds)], names[: len(columns)])
        tidy()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text")).mapInArrow(run, schema)


def price(values: np.ndarray, capacity: int) -> dict[int, int]:
    """The configuration of greatest total value: lengths with their numbers (unbounded knapsack)."""
    best = np.zeros(capacity + 1)
    took = np.zeros(capacity + 1, dtype=np.int64)
    for c in range(1, capacity + 1):
        options = values[1 : c + 1] + best[c - 1 :: -1][:c]
        s = int(options.argmax())
        if options[s] > best[c - 1]:
            best[c], took[c] = options[s], s + 1
        else:
            best[c] = best[c - 1]
    out: dict[int, int] = {}
    c = capacity
    while c > 0:
        if took[c]:
            out[int(took[c])] = out.get(int(took[c]), 0) + 1
            c -= int(took[c])
        else:
            c -= 1
    return out


def solve(demand: np.ndarray, capacity: int, rounds: int = 700, rate: float = 0.1, power: float = 1.1) -> list[tuple[dict[int, int], float]]:
    """Fractional configurations that cover the demand (index: length) by multiplicative weights.

    A length's price is a power of its size, so that large pieces are matched with what fills
    their sequence, times a weight that falls exponentially with the share of its demand already
    covered. Each round buys the best configuration until one of its lengths is covered, or by the
    step width at most.
    """
    sizes = np.arange(capacity + 1) / capacity
    need = demand.astype(float)
    covered = np.zeros(capacity + 1)
    width = float((sizes * need).sum()) / 100 + 1
    bought: list[tuple[dict[int, int], float]] = []
    for _ in range(rounds):
        left = need - covered
        open_ = left > 1e-9
        if not open_.any():
            break
        chosen = price(np.where(open_, sizes**power * np.exp(-rate * covered / np.maximum(need, 1)), 0.0), capacity)
        step = min([width, *(left[s] / k for s, k in chosen.items())])
        for s, k in chosen.items():
            covered[s] += step * k
        bought.append((chosen, step))
    return bought


def plan(histogram: dict[int, int], capacity: int) -> list[tuple[int, dict[int, int]]]:
    """(number of sequences, make-up) that together hold each length exactly as often as it occurs."""
    demand = np.zeros(capacity + 1, dtype=np.int64)
    for s, n in histogram.items():
        demand[s] = n
    out: list[tuple[int, dict[int, int]]] = []
    if demand[capacity]:
        out.append((int(demand[capacity]), {capacity: 1}))
        demand[capacity] = 0
    merged: dict[tuple, float] = {}
    for chosen, x in solve(demand, capacity) if demand.any() else []:
        key = tuple(sorted(chosen.items()))
        merged[key] = merged.get(key, 0.0) + x
    rest = demand.copy()
    for key, x in sorted(merged.items(), key=lambda kv: -kv[1]):
        n = min([int(x), *(int(rest[s]) // k for s, k in key)])
        if n > 0:
            out.append((n, dict(key)))
            for s, k in key:
                rest[s] -= n * k
    # The rest, best fit decreasing: groups of equal sequences by the room they have left.
    room: dict[int, list[tuple[int, dict[int, int]]]] = {}
    free: list[int] = []

    def put(gap: int, n: int, made: dict[int, int]) -> None:
        if gap not in room:
            room[gap] = []
            bisect.insort(free, gap)
        room[gap].append((n, made))

    for s in range(capacity, 0, -1):
        n = int(rest[s])
        while n:
            i = bisect.bisect_left(free, s)
            if i < len(free):
                gap = free[i]
                m, made = room[gap].pop()
                if not room[gap]:
                    del room[gap], free[i]
                took = min(m, n)
                if m > took:
                    put(gap, m - took, made)
                put(gap - s, took, made | {s: made.get(s, 0) + 1})
                n -= took
            else:
                each = min(capacity // s, n)
                put(capacity - each * s, n // each, {s: each})
                n %= each
    for groups in room.values():
        out += groups
    return out


def places(made: list[tuple[int, dict[int, int]]]) -> dict[int, tuple[list[int], ...]]:
    """Per length, ordered by rank: (first rank, first sequence, number in a sequence, offset)."""
    out: dict[int, tuple[list[int], ...]] = {}
    ranks: dict[int, int] = {}
    first = 0
    for n, made_up in made:
        offset = 0
        for s, k in sorted(made_up.items(), reverse=True):
            row = out.setdefault(s, ([], [], [], []))
            for column, value in zip(row, (ranks.get(s, 0), first, k, offset)):
                column.append(value)
            ranks[s] = ranks.get(s, 0) + n * k
            offset += s * k
        first += n
    return out


def pack(found: DataFrame, capacity: int = CAPACITY, group_rows: int = 100_000) -> DataFrame:
    """The rows of `found` (doc_id, piece, length, ...) with sequence_id and offset.

    Only the histogram (at most `capacity` rows) reaches the driver. Pieces of one length are
    ranked in salted groups of about group_rows rows, so no length is sorted in one task. Lengths
    must be within 1..capacity; ties are broken arbitrarily, since equal pieces are exchangeable.
    An empty input gives an empty result.
    """
    spark = found.sparkSession
    counts = {int(r["length"]): int(r["n"]) for r in found.groupBy("length").agg(F.count("*").alias("n")).collect()}
    table = places(plan(counts, capacity))
    salt = max(8, sum(counts.values()) // group_rows + 1)
    salted = found.withColumn("_salt", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(salt)))
    sizes = salted.groupBy("length", "_salt").agg(F.count("*").alias("_n"))
    before = W.partitionBy("length").orderBy("_salt").rowsBetween(W.unboundedPreceding, -1)
    bases = sizes.select("length", "_salt", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"))
    order = W.partitionBy("length", "_salt").orderBy("doc_id", "piece")
    ranked = salted.withColumn("_in", F.row_number().over(order)).join(bases, ["length", "_salt"])
    ranked = ranked.withColumn("_rank", F.col("_base") + F.col("_in") - 1)
    shared = spark.sparkContext.broadcast(table)

    @F.pandas_udf("struct<sequence_id: long, offset: long>")
    def where(length, rank):
        import pandas as pd

        s, r = length.to_numpy(), rank.to_numpy()
        seq, off = np.zeros(len(s), dtype=np.int64), np.zeros(len(s), dtype=np.int64)
        order_ = np.argsort(s, kind="stable")
        for group in np.split(order_, np.flatnonzero(np.diff(s[order_])) + 1) if len(s) else []:
            size = int(s[group[0]])
            low, first, k, offset = (np.asarray(x, dtype=np.int64) for x in shared.value[size])
            i = np.searchsorted(low, r[group], side="right") - 1
            inside = r[group] - low[i]
            seq[group] = first[i] + inside // k[i]
            off[group] = offset[i] + inside % k[i] * size
        return pd.DataFrame({"sequence_id": seq, "offset": off})

    placed = ranked.withColumn("_at", where("length", "_rank"))
    return placed.select(*[c for c in found.columns], F.col("_at.sequence_id").alias("sequence_id"), F.col("_at.offset").alias("offset"))


def pack_documents(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, end_id: int = END_ID, with_ids: bool = False) -> DataFrame:
    """Pieces of all documents with the sequence and offset each is placed at (see pieces, pack)."""
    with small_batches(docs.sparkSession, 1024):
        made = durable(pieces(docs, tokenizer_path, capacity, end_id, with_ids))
    return pack(made, capacity)
