"""N-gram Jaccard join: documents whose sets of word shingles overlap, found exactly.

Equal sets are one class, named by its smallest doc_id. Every class indexes its rarest shingles, as
many as any partner must share one of. Pairs of short lists are kept where their sizes, the positions
of their last common shingle, the number of common ones and the parities of their sets leave room
for a link. Each long list
goes to its leader, the member of most shared lists: a leader's members are compared with it, and
the answers of those that do not link with it are derived from its overlaps by the difference of the
two sets. Members meet in blocks of bounded size, whatever the size of a list or a group.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Membership, durable, fresh, release, small_batches, text_or_empty, tidy
from .components import components
from .linking import led, shared_lists

FACTORS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xFF51AFD7ED558CCD], dtype=np.uint64)
#: Members of a list of which all pairs may be looked at.
SHORT = 20
#: Shingles of the members in a block; keys of the members of a leader that are told apart before.
BLOCK, KEYS = 1 << 20, 1 << 16
#: Frequent shingles that a task reports, that a task remembers, and that all tasks are told of.
REPORTED, REMEMBERED, TOLD = 1 << 16, 1 << 18, 1 << 20


def words(text: str, lower: bool) -> list[bytes]:
    """Words between ASCII white space, A-Z in lower case if asked."""
    data = text.encode()
    return (data.lower() if lower else data).split()


def shingle_set(text: str, k: int, lower: bool = True) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the k-word shingles; of all words if there are fewer than k."""
    found = words(text, lower)
    if not found:
        return np.empty(0, dtype=np.uint64)
    hashed = np.fromiter(map(xxhash.xxh3_64_intdigest, found), dtype=np.uint64, count=len(found))
    width = min(k, len(found))
    out = np.full(len(found) - width + 1, width, dtype=np.uint64)
    for i in range(width):
        out += hashed[i : len(found) - width + 1 + i] * FACTORS[i]
        out ^= out >> np.uint64(29)
        out *= FACTORS[(i + 1) % len(FACTORS)]
    return np.unique(out ^ (out >> np.uint64(32)))


def parities(own: np.ndarray) -> bytes:
    """Whether the set has an odd number of hashes in each of 2**k buckets, at least half as many as hashes (64 at least)."""
    buckets = 1 << max(6, (len(own) - 1).bit_length() - 1)
    odd = np.bincount((own >> np.uint64(20)).astype(np.int64) & (buckets - 1), minlength=buckets) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()


def differ_at_least(a: bytes, b: bytes) -> int:
    """A lower bound of the number of hashes that only one of two sets has: buckets of different parity."""
    if len(a) < len(b):
        a, b = b, a
    x, size = int.from_bytes(a, "little"), 8 * len(a)
    while size > 8 * len(b):
        # Twice the buckets fold into half.
        size //= 2
        x = (x & ((1 << size) - 1)) ^ (x >> size)
    return (x ^ int.from_bytes(b, "little")).bit_count()


def _source(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))


class Frequent:
    """Counts of the most frequent hashes seen, in bounded memory; counts may be too low, never too high."""

    def __init__(self) -> None:
        self.keys, self.counts = np.empty(0, np.uint64), np.empty(0, np.int64)
        self.waiting: list[np.ndarray] = []
        self.size = 0

    def add(self, own: np.ndarray) -> None:
        self.waiting.append(own)
        self.size += len(own)
        if self.size >= 1 << 20:
            self.settle()

    def settle(self) -> None:
        new, times = np.unique(np.concatenate([np.empty(0, np.uint64), *self.waiting]), return_counts=True)
        self.waiting, self.size = [], 0
        keys, at = np.unique(np.concatenate([self.keys, new]), return_inverse=True)
        counts = np.bincount(at, weights=np.concatenate([self.counts, times]), minlength=len(keys)).astype(np.int64)
        kept = np.flatnonzero(counts > 1)
        if len(kept) > REMEMBERED:
            kept = kept[np.argsort(-counts[kept], kind="stable")[:REMEMBERED]]
            kept.sort()
        self.keys, self.counts = keys[kept], counts[kept]

    def most(self, number: int) -> tuple[np.ndarray, np.ndarray]:
        self.settle()
        at = np.argsort(-self.counts, kind="stable")[:number]
        return self.keys[at], self.counts[at]


def sizes(docs: DataFrame, k: int) -> DataFrame:
    """Rows (doc_id, n, h0, h1, bits) per document, h0 and h1 naming its set, bits its parities, and (key, number) of each task's frequent shingles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, frequent = ["doc_id", "n", "h0", "h1", "bits", "key", "number"], Frequent()
        for batch in batches:
            n, h0, h1, bits = [], [], [], []
            for text in batch.column(1):
                own = shingle_set(text.as_py(), k)
                n.append(len(own))
                name = xxhash.xxh3_128_intdigest(own.tobytes())
                h0.append((name >> 64) - (1 << 63))
                h1.append((name & ((1 << 64) - 1)) - (1 << 63))
                bits.append(parities(own) if len(own) else None)
                frequent.add(own)
            none = pa.nulls(len(n), pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, pa.int64()) for c in (n, h0, h1)), pa.array(bits, pa.binary()), none, none], names)
        keys, counts = frequent.most(REPORTED)
        none = pa.nulls(len(keys), pa.int64())
        yield pa.RecordBatch.from_arrays([none, none, none, none, pa.nulls(len(keys), pa.binary()), pa.array(keys.view(np.int64)), pa.array(counts)], names)
        tidy()

    return _source(docs).mapInArrow(run, "doc_id long, n long, h0 long, h1 long, bits binary, key long, number long")


def prefixes(docs: DataFrame, k: int, threshold: Fraction, frequent: tuple[np.ndarray, np.ndarray]) -> DataFrame:
    """(key, id, n, pos): each document's first shingles, rare ones first; any fixed order would be exact."""
    shared = docs.sparkSession.sparkContext.broadcast(frequent)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, counts = shared.value
        for batch in batches:
            out: list[list[np.ndarray]] = [[], [], [], []]
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                own = shingle_set(text.as_py(), k)
                n = len(own)
                if not n:
                    continue
                length = n - -(-n * threshold.numerator // threshold.denominator) + 1
                common = np.zeros(n, dtype=np.int64)
                if len(keys):
                    at = np.minimum(np.searchsorted(keys, own), len(keys) - 1)
                    common = np.where(keys[at] == own, counts[at], 0)
                first = own[np.lexsort((own, common))[:length]]
                for column, value in zip(out, (first.view(np.int64), np.full(length, doc_id), np.full(length, n), np.arange(length))):
                    column.append(value)
            if out[0]:
                kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32())
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)).cast(t) for c, t in zip(out, kinds)], ["key", "id", "n", "pos"])
        tidy()

    return _source(docs).mapInArrow(run, "key long, id long, n int, pos int")


def _gathered(starts: np.ndarray, data: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """data of all the given rows of a compressed table, one after another."""
    lengths = starts[rows + 1] - starts[rows]
    offsets = np.repeat(starts[rows] - np.concatenate([[0], np.cumsum(lengths)[:-1]]), lengths)
    return data[offsets + np.arange(lengths.sum())]


def linked(sets: list[np.ndarray], roles: list[int], threshold: Fraction) -> tuple[list[tuple[int, int]], list[int]]:
    """Pairs that connect what links among the sets, and the places of those not linked with the leader.

    roles: 0 the leader, 1 a member, 2 one to be compared with all members but no other of its role.
    Without a leader only role 2 asks.
    """
    lengths = np.array([len(s) for s in sets])
    _, element = np.unique(np.concatenate(sets), return_inverse=True)
    ends = np.cumsum(lengths)
    own = [element[e - n : e] for e, n in zip(ends, lengths)]
    holder = np.repeat(np.arange(len(sets)), lengths)[np.argsort(element, kind="stable")]
    starts = np.concatenate([[0], np.cumsum(np.bincount(element))])
    count = lambda elements: np.bincount(_gathered(starts, holder, elements), minlength=len(sets))
    role, parent, links = np.array(roles), list(range(len(sets))), []

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    def answers(i: int, common: np.ndarray) -> None:
        union = lengths + lengths[i] - common
        for j in np.flatnonzero((common * threshold.denominator >= union * threshold.numerator) & (role < 2)).tolist():
            if root(i) != root(j):
                parent[root(j)] = root(i)
                links.append((i, j))

    leaders = np.flatnonzero(role == 0)
    if not len(leaders):
        for i in np.flatnonzero(role == 2).tolist():
            answers(i, count(own[i]))
        return links, []
    top = int(leaders[0])
    base = count(own[top])
    answers(top, base)
    far = [i for i in range(len(sets)) if root(i) != root(top)]
    in_top, in_own = np.zeros(len(starts) - 1, dtype=bool), np.zeros(len(starts) - 1, dtype=bool)
    in_top[own[top]] = True
    for i in far:
        in_own[own[i]] = True
        more, less = own[i][~in_top[own[i]]], own[top][~in_own[own[top]]]
        in_own[own[i]] = False
        answers(i, base + count(more) - count(less) if len(more) + len(less) < lengths[i] else count(own[i]))
    return links, far


def blocks(docs: DataFrame, wanted: DataFrame, k: int, threshold: Fraction) -> DataFrame:
    """(u, v, far) of every block; wanted: (id, leader, i, j, role, parts), a block being (leader, i, j).

    Rows with far name, in u, the leader and, in v, a member that does not link with it, where the leader has several blocks.
    """

    def sets_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["leader", "i", "j", "role", "parts", "id", "own"]
        kinds = [pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.list_(pa.int64())]
        for batch in batches:
            out, size = [], 0
            for doc_id, text, places in zip(*(c.to_pylist() for c in batch.columns)):
                own = shingle_set(text, k).view(np.int64)
                for p in places:
                    out.append((p["leader"], p["i"], p["j"], p["role"], p["parts"], doc_id, own))
                    size += len(own)
                    if size > BLOCK:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), kinds)], names)
                        out, size = [], 0
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), kinds)], names)
        tidy()

    def decide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def result(rows: list[tuple]) -> pa.RecordBatch:
            # A repeated row of a document is there twice.
            rows = list({(r[5], r[6].tobytes()): r for r in rows}.values())
            links, far = linked([r[6] for r in rows], [r[3] for r in rows], threshold)
            out = [(rows[a][5], rows[b][5], False) for a, b in links]
            if rows[0][4] > 1:
                out += [(rows[0][0], rows[i][5], True) for i in far]
            u, v, is_far = zip(*out) if out else ((), (), ())
            return pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64()), pa.array(is_far, pa.bool_())], ["u", "v", "far"])

        key, rows = None, []
        for batch in batches:
            plain = [c.to_pylist() for c in batch.columns[:6]]
            sets = batch.column(6)
            starts, values = sets.offsets.to_numpy(), sets.values.to_numpy().view(np.uint64)
            for r, x in enumerate(zip(*plain)):
                if x[:3] != key:
                    if rows:
                        yield result(rows)
                    key, rows = x[:3], []
                rows.append((*x, values[starts[r] : starts[r + 1]].copy()))
        if rows:
            yield result(rows)
        tidy()

    wanted = durable(wanted.groupBy("id").agg(F.collect_list(F.struct("leader", "i", "j", "role", "parts")).alias("places")))
    near = Membership(wanted, "id").sieve(_source(docs), "doc_id").join(wanted, F.col("doc_id") == F.col("id"))
    rows = near.select("doc_id", "text", "places").mapInArrow(sets_of, "leader long, i int, j int, role int, parts int, id long, own array<long>")
    dealt = rows.repartition("leader", "i", "j").sortWithinPartitions("leader", "i", "j")
    with small_batches(docs.sparkSession, 512):
        return durable(dealt.mapInArrow(decide, "u long, v long, far boolean"))


def promising(members: DataFrame, marks: DataFrame, percent: int) -> DataFrame:
    """(leader, id, n) of the members of long lists that may link with another member of their leader.

    members: key, id, n, pos, number. Members are told apart by the number of keys that each two of a
    leader have in common, the places of the last one and the parities of their sets (marks: id, n,
    bits), in cells of about 2 * KEYS keys.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def result(leader: int, rows: list[tuple]) -> pa.RecordBatch:
            n = np.array([r[0] for r in rows])
            rest = -(-n * percent // 100) - 1
            lengths = np.array([len(r[2]) for r in rows])
            _, element = np.unique(np.concatenate([r[2] for r in rows]), return_inverse=True)
            order, all_places = np.argsort(element, kind="stable"), np.concatenate([r[3] for r in rows])
            holder, place = np.repeat(np.arange(len(rows)), lengths)[order], all_places[order]
            starts = np.concatenate([[0], np.cumsum(np.bincount(element))])
            kept, end = [], np.cumsum(lengths)
            for i in range(len(rows)):
                own = slice(end[i] - lengths[i], end[i])
                with_ = _gathered(starts, holder, element[own])
                common = np.bincount(with_, minlength=len(rows))
                # Places of the last shared key in the others and in this one.
                there, here = np.zeros(len(rows), dtype=np.int64), np.zeros(len(rows), dtype=np.int64)
                np.maximum.at(there, with_, _gathered(starts, place, element[own]))
                np.maximum.at(here, with_, np.repeat(all_places[own], starts[element[own] + 1] - starts[element[own]]))
                most = common + np.minimum(np.maximum(rest, rest[i]), np.minimum(n - there, n[i] - here) - 1)
                room = (common > 0) & (100 * np.minimum(n, n[i]) >= percent * np.maximum(n, n[i]))
                room &= (100 + percent) * most >= percent * (n + n[i])
                room[i] = False
                if any((100 + percent) * differ_at_least(rows[i][4], rows[j][4]) <= (100 - percent) * (n[i] + n[j]) for j in np.flatnonzero(room).tolist()):
                    kept.append(i)
            return pa.RecordBatch.from_arrays([pa.array([leader] * len(kept), pa.int64()), pa.array([rows[i][1] for i in kept], pa.int64()), pa.array(n[kept], pa.int32())], ["leader", "id", "n"])

        key, rows = None, []
        for batch in batches:
            *cell, ids, n = (c.to_pylist() for c in batch.columns[:5])
            bits = batch.column(7).to_pylist()
            starts = batch.column(5).offsets.to_numpy()
            values, places = (batch.column(c).values.to_numpy().astype(np.int64) for c in (5, 6))
            for r, at in enumerate(zip(*cell)):
                if at != key:
                    if rows:
                        yield result(key[0], rows)
                    key, rows = at, []
                rows.append((n[r], ids[r], *(x[starts[r] : starts[r + 1]].copy() for x in (values, places)), bits[r]))
        if rows:
            yield result(key[0], rows)

    long = members.where(F.col("number") > SHORT)
    long = long.join(led(members, long, "n"), F.col("key") == F.col("_key")).select("leader", "id", "n").distinct()
    # All shared keys of a member count, whoever leads their lists.
    held = members.groupBy("id", "n").agg(F.collect_list(F.struct("key", "pos")).alias("keys")).withColumnsRenamed({"id": "_id", "n": "_n"})
    held = held.join(marks.withColumnsRenamed({"id": "_i", "n": "_m"}), (F.col("_id") == F.col("_i")) & (F.col("_n") == F.col("_m"))).drop("_i", "_m")
    full = long.join(held, (F.col("id") == F.col("_id")) & (F.col("n") == F.col("_n")))
    full = durable(full.select("leader", "id", "n", F.transform("keys", lambda x: x["key"]).alias("keys"), F.transform("keys", lambda x: x["pos"]).alias("places"), "bits"))
    size = full.groupBy("leader").agg(F.ceil(F.sum(F.size("keys")) / F.lit(KEYS)).cast("int").alias("_parts"))
    # Of those there is at most one for each KEYS keys of the index, so they are broadcast.
    large = size.where("_parts > 1").withColumnRenamed("leader", "_leader")
    sized = full.join(F.broadcast(large), F.col("leader") == F.col("_leader"), "left").withColumn("_parts", F.coalesce("_parts", F.lit(1)))
    # Members of a large leader meet in cells of two parts each.
    part = F.pmod(F.xxhash64("id"), F.col("_parts").cast("long")).cast("int")
    cells = F.transform(F.sequence(F.lit(0), F.col("_parts") - 1), lambda j: F.struct(F.least(part, j).alias("i"), F.greatest(part, j).alias("j")))
    sized = sized.select("leader", "id", "n", "keys", "places", "bits", F.explode(cells).alias("c")).select("leader", "c.i", "c.j", "id", "n", "keys", "places", "bits")
    found = sized.repartition("leader", "i", "j").sortWithinPartitions("leader", "i", "j").mapInArrow(run, "leader long, id long, n int").distinct()
    # The leader stays where any member does.
    found = durable(found)
    first = found.select("leader").distinct().join(held, F.col("leader") == F.col("_id")).select("leader", F.col("_id").alias("id"), F.col("_n").alias("n"))
    return found.unionByName(first)


def classes_of(rows: DataFrame) -> DataFrame:
    """(h0, h1, rep, times, n, bits) of each set; rep is the smallest doc_id with it."""
    return rows.where("n > 0 and doc_id is not null").groupBy("h0", "h1").agg(F.min("doc_id").alias("rep"), F.count("*").alias("times"), F.first("n").alias("n"), F.first("bits").alias("bits"))


def links(known: DataFrame, classes: DataFrame, k: int, percent: int, frequent: tuple[np.ndarray, np.ndarray]) -> DataFrame:
    """(u, v): linked classes, by their rep, that connect all that links connect."""
    threshold = Fraction(percent, 100)
    near = Membership(classes, "rep").sieve(known, "doc_id")
    with small_batches(known.sparkSession, 1024):
        postings = durable(prefixes(near, k, threshold, frequent))
    members = durable(shared_lists(postings).dropDuplicates(["key", "id", "n", "pos"]))
    release(known.sparkSession)
    a, b = (members.where(F.col("number") <= SHORT).select(*[F.col(c).alias(m + c) for c in ("key", "id", "n", "pos")]) for m in ("a_", "b_"))
    fits = 100 * F.least("a_n", "b_n") >= percent * F.greatest("a_n", "b_n")
    met = a.join(b, (F.col("a_key") == F.col("b_key")) & (F.col("a_id") < F.col("b_id")) & fits)
    met = met.groupBy("a_id", "b_id", "a_n", "b_n").agg(F.count("*").alias("common"), *[F.max(c).alias(c) for c in ("a_pos", "b_pos")])
    # What prefixes do not share lies behind one of them, and behind the last shared one in both.
    rest = lambda c: F.floor((percent * F.col(c) + 99) / 100) - 1
    most = F.least(F.col("common") + F.greatest(rest("a_n"), rest("b_n")), F.col("common") + F.least(F.col("a_n") - F.col("a_pos"), F.col("b_n") - F.col("b_pos")) - 1)
    # Pairs that share a long list too meet there.
    pairs = met.where((100 + percent) * most >= percent * (F.col("a_n") + F.col("b_n")))
    marks = classes.select(F.col("rep").alias("id"), F.col("n").cast("int").alias("n"), "bits")

    def alike(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, m, x, y = (c.to_pylist() for c in batch.columns[2:])
            yield batch.filter(pa.array([(100 + percent) * differ_at_least(x[i], y[i]) <= (100 - percent) * (n[i] + m[i]) for i in range(batch.num_rows)], pa.bool_())).select([0, 1, 2, 3])

    for m in ("a_", "b_"):
        own = marks.select(F.col("id").alias("_i"), F.col("n").alias("_m"), F.col("bits").alias(m + "bits"))
        pairs = pairs.join(own, (F.col(m + "id") == F.col("_i")) & (F.col(m + "n") == F.col("_m"))).drop("_i", "_m")
    pairs = pairs.select("a_id", "b_id", "a_n", "b_n", "a_bits", "b_bits").mapInArrow(alike, "a_id long, b_id long, a_n int, b_n int")
    ends = [F.struct(F.col("a_id").alias("leader"), F.col(m + "id").alias("id"), F.col(m + "n").alias("n")) for m in ("a_", "b_")]
    pairs = pairs.select(F.explode(F.array(*ends)).alias("x")).select("x.*")
    asked = durable(pairs.unionByName(promising(members, marks, percent)).distinct())
    release(known.sparkSession)
    parts = asked.groupBy("leader").agg(F.ceil(F.sum("n") / F.lit(BLOCK)).cast("int").alias("parts")).withColumnRenamed("leader", "_leader")
    asked = asked.join(parts, F.col("leader") == F.col("_leader")).withColumn("role", (F.col("id") != F.col("leader")).cast("int"))
    # Every block has the leader.
    own_block = F.pmod(F.xxhash64("id"), F.col("parts").cast("long")).cast("int")
    i = F.explode(F.when(F.col("role") == 0, F.sequence(F.lit(0), F.col("parts") - 1)).otherwise(F.array(own_block))).alias("i")
    asked = durable(asked.select("id", "leader", i, F.lit(0).alias("j"), "role", "parts").distinct())
    found = blocks(known, asked, k, threshold)
    release(known.sparkSession)
    out = found.where("not far").select("u", "v")
    far = found.where("far").select(F.col("u").alias("_leader"), F.col("v").alias("_id")).distinct()
    if not far.isEmpty():
        # Members not linked with their leader, in blocks of their own, meet the members of its other blocks.
        cells = F.expr("explode(sequence(0, parts - 1))")
        here = asked.where("role = 1").join(far.select(F.col("_leader").alias("_l")).distinct(), F.col("leader") == F.col("_l"))
        members_there = here.select("id", "leader", "i", cells.alias("j"), F.lit(1).alias("role"), "parts").where("i <> j")
        others = asked.join(far, (F.col("leader") == F.col("_leader")) & (F.col("id") == F.col("_id")))
        others = others.select("id", "leader", cells.alias("i"), F.col("i").alias("j"), F.lit(2).alias("role"), "parts").where("i <> j")
        out = out.unionByName(blocks(known, members_there.unionByName(others), k, threshold).select("u", "v"))
    return out


def groups(docs: DataFrame, k: int = 3, percent: int = 90) -> DataFrame:
    """(doc_id, n_shingles, component_id) of every row; whole texts are read.

    Two documents link when their sets' intersection is at least `percent` of their union.
    component_id is the smallest doc_id reachable by links, itself included. Null and empty texts
    have no shingles and link with nothing, equal sets always link; repeated rows stay, and texts of
    one doc_id are one document; a null doc_id is not compared with others (its component is null).
    """
    docs = docs.select("doc_id", "text")
    known = docs.where(F.col("doc_id").isNotNull())
    with small_batches(docs.sparkSession, 1024):
        measured = durable(sizes(docs, k))
    told = measured.where("key is not null").groupBy("key").agg(F.sum("number").alias("number")).orderBy(F.desc("number"), "key").limit(TOLD).toArrow().sort_by("key")
    keys, counts = told["key"].to_numpy().view(np.uint64), told["number"].to_numpy()
    at = np.argsort(keys)
    rows = measured.where("h0 is not null").select("doc_id", "n", "h0", "h1", "bits")
    classes = durable(classes_of(rows))
    rows = rows.drop("bits")
    found = components(links(known, classes, k, percent, (keys[at], counts[at])))
    named = classes.join(found, F.col("rep") == F.col("node"), "left").where("times > 1 or component is not null")
    named = durable(named.select(F.col("h0").alias("_h0"), F.col("h1").alias("_h1"), F.coalesce("component", "rep").alias("component_id")))
    flagged = Membership(named, "_h0").flag(rows.withColumn("_known", (F.col("n") > 0) & F.col("doc_id").isNotNull()), "h0", "_near")
    both = flagged.where("_near and _known").join(named, (F.col("h0") == F.col("_h0")) & (F.col("h1") == F.col("_h1")), "left")
    out = both.select("doc_id", "n", F.coalesce("component_id", "doc_id").alias("component_id"))
    alone = flagged.where("not (_near and _known)").select("doc_id", "n", F.col("doc_id").alias("component_id"))
    return out.unionByName(alone).select("doc_id", F.col("n").alias("n_shingles"), "component_id")


def keep_one(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """The rows of docs (unique ids) without those linked to one of a smaller doc_id's component."""
    drop, near = fresh(docs, "_drop", "_near")
    dropped = durable(groups(docs, k, percent).where("component_id <> doc_id").select(F.col("doc_id").alias(drop)))
    flagged = Membership(dropped, drop).flag(docs, "doc_id", near)
    kept = flagged.where(F.col(near)).join(dropped, F.col("doc_id") == F.col(drop), "left_anti")
    return kept.unionByName(flagged.where(~F.col(near))).drop(near)
