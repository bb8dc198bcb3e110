"""Links between items that share an index list, without all pairs of a list.

Of a short list all pairs are compared. A long list is led by its member of most shared lists,
usually the one its near copies were made from: its members are compared with the leader first.
Then, as only the groups are asked for, all pairs of a long list whose items are not of one group by
that are compared too, by pairs of blocks within tasks. So no link of a list is left out, whatever its
length, and no row is made for a pair that is not linked.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Membership, durable, release, width
from .components import components

Pairs = Callable[[DataFrame, DataFrame], DataFrame]


def shared_lists(postings: DataFrame) -> DataFrame:
    """postings (key, id, ...) of the keys of at least two rows, with `number`, the members of the list."""
    lists = postings.groupBy("key").agg(F.count("*").alias("number")).where("number > 1")
    lists = durable(lists.select(F.col("key").alias("_key"), "number"))
    return Membership(lists, "_key").sieve(postings, "key").join(lists, F.col("key") == F.col("_key")).drop("_key")


def led(members: DataFrame, lists: DataFrame, size: str | None = None) -> DataFrame:
    """(key, leader) of each of the lists, which are rows of members.

    A list's first leader is its member with the most shared lists (for its size), the smallest of
    several. Then it goes to its member that leads the most lists, so that one item leads what
    belongs together.
    """
    times = F.count("*") / F.max(size) if size else F.count("*")
    counts = members.groupBy("id").agg(times.alias("_times")).withColumnRenamed("id", "_id")
    ranked = durable(lists.select("key", "id").join(counts, F.col("id") == F.col("_id")).drop("_id"))
    first = ranked.groupBy("key").agg(F.max(F.struct("_times", -F.col("id"))).alias("x"))
    leads = first.groupBy((-F.col("x.col2")).alias("_id")).agg(F.count("*").alias("_leads"))
    again = ranked.join(leads, F.col("id") == F.col("_id"))
    return again.groupBy("key").agg(F.max(F.struct("_leads", "_times", -F.col("id"))).alias("x")).select(F.col("key").alias("_key"), (-F.col("x.col3")).alias("leader"))


#: Members of a list of which all pairs are compared at once.
SHORT = 12
#: Members and characters of a block of what is left of a long list; pairs of blocks are compared each by itself.
BLOCK = 4096
CHARS = 1 << 21


def rest(long: DataFrame, nodes: DataFrame, groups: DataFrame, lines: DataFrame, block: int, chars: int) -> DataFrame:
    """(key, i, j, at, g, keys, *columns of lines), dealt and sorted by (key, i, j): the blocks of long lists (key, leader, id), each two together.

    at is a row's own block, i or j, g its group (node, component), and keys are those of all its lists here, so that who reads
    this can leave a pair to the least list that holds both. Pairs are left to who reads this, within a block where i is j
    and between the two otherwise, so that neither a task's memory nor what is written grows with the pairs. Leaders, with which
    all are compared already, and lists of one group are left out. lines: id and what the comparison reads; nodes: id and n, its size.
    """
    grouped = long.where("id <> leader").join(groups, F.col("id") == F.col("node"), "left").select("key", "id", F.coalesce("component", "id").alias("g"))
    grouped = durable(grouped.join(nodes.select(F.col("id").alias("_id"), F.col("n").cast("long").alias("_size")), F.col("id") == F.col("_id")).drop("_id"))
    parts = F.greatest(F.ceil(F.count("*") / block), F.ceil(F.sum("_size") / chars)).cast("int")
    lists = grouped.groupBy("key").agg(F.min("g").alias("lo"), F.max("g").alias("hi"), parts.alias("_n")).where("lo <> hi").select(F.col("key").alias("_key"), "_n")
    rows = grouped.join(lists, F.col("key") == F.col("_key")).groupBy("id").agg(F.min("g").alias("g"), F.collect_list(F.struct("key", "_n")).alias("_lists"))
    rows = rows.join(lines.withColumnRenamed("id", "_id"), F.col("id") == F.col("_id")).select("g", F.col("_lists.key").alias("keys"), *lines.columns, F.explode("_lists").alias("_l"))
    rows = rows.select(F.col("_l.key").alias("key"), "g", "keys", F.col("_l._n").alias("_n"), F.pmod(F.xxhash64("id"), F.col("_l._n")).cast("int").alias("at"), *lines.columns)
    cells = F.transform(F.sequence(F.lit(0), F.col("_n") - 1), lambda to: F.struct(F.least("at", to).alias("i"), F.greatest("at", to).alias("j")))
    dealt = rows.select("key", F.explode(cells).alias("c"), "at", "g", "keys", *lines.columns).select("key", "c.i", "c.j", "at", "g", "keys", *lines.columns)
    return dealt.repartition(width(long.sparkSession), "key", "i", "j").sortWithinPartitions("key", "i", "j")


def link(members: DataFrame, nodes: DataFrame, close: Callable[[Callable[[str], Column], Callable[[str], Column]], Column], verify: Pairs, short: int = SHORT, block: int = BLOCK, chars: int = CHARS, lines: Callable[[], DataFrame] | None = None, compare: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """(node, component) of the items that link with another; members: key, id, each once; nodes: id, n and what `close` reads.

    close(a, b) is a condition on two items' columns that all links fulfil. verify(pairs, more) keeps those of pairs (u, v) that are
    linked; more are the members of lists longer than `short`, for which lines() gives after it what compare reads: compare takes
    the blocks of `rest` and gives links (u, v) that join what is linked in them. Without it the pairs of the blocks are rows that
    go to verify as well. Items that are not among nodes link with none.
    """
    near = close(lambda c: F.col("a_" + c), lambda c: F.col("b_" + c))
    columns = [c for c in nodes.columns if c != "id"]

    def ends(pairs: DataFrame) -> DataFrame:
        """pairs (a_id, b_id) whose ends are close."""
        for mark in ("a_", "b_"):
            side = nodes.select(F.col("id").alias("_id"), *[F.col(c).alias(mark + c) for c in columns])
            pairs = pairs.join(side, F.col(mark + "id") == F.col("_id")).drop("_id")
        return pairs.where(near)

    def joined(blocks: DataFrame) -> DataFrame:
        """What compare gives, by verify."""
        a, b = (blocks.select("key", "i", "j", *[F.col(c).alias(mark + c) for c in ("at", "g", "id")]) for mark in ("a_", "b_"))
        order = F.when(F.col("i") == F.col("j"), F.col("a_id") < F.col("b_id")).otherwise((F.col("a_at") == F.col("i")) & (F.col("b_at") == F.col("j")))
        pairs = a.join(b, ["key", "i", "j"]).where((F.col("a_g") != F.col("b_g")) & order)
        pairs = ends(pairs.select(F.least("a_id", "b_id").alias("a_id"), F.greatest("a_id", "b_id").alias("b_id")).distinct())
        return verify(pairs.select(F.col("a_id").alias("u"), F.col("b_id").alias("v")), long)

    sizes = members.groupBy("key").agg(F.count("*").alias("number")).where("number > 1").withColumnRenamed("key", "_key")
    sized = durable(members.join(sizes, F.col("key") == F.col("_key")).drop("_key"))
    few = sized.where(F.col("number") <= short)
    a, b = (few.select(F.col("key").alias(m + "key"), F.col("id").alias(m + "id")) for m in ("a_", "b_"))
    pairs = a.join(b, (F.col("a_key") == F.col("b_key")) & (F.col("a_id") < F.col("b_id"))).select("a_id", "b_id")
    many = sized.where(F.col("number") > short).drop("number")
    long = durable(many.join(led(sized, many), F.col("key") == F.col("_key")).drop("_key"))
    follows = long.where("id <> leader").select(F.least("leader", "id").alias("a_id"), F.greatest("leader", "id").alias("b_id"))
    found = verify(ends(pairs.unionByName(follows).distinct()).select(F.col("a_id").alias("u"), F.col("b_id").alias("v")), long)
    groups = components(found)
    release(nodes.sparkSession)
    more = (compare or joined)(rest(long, nodes, groups, lines() if lines else nodes.select("id"), block, chars))
    if more.isEmpty():
        return groups
    return components(groups.select(F.col("node").alias("u"), F.col("component").alias("v")).unionByName(more.select("u", "v")))
