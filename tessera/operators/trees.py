"""Trees as tables of nodes (tree, node, parent, length, label, support): many trees, or large ones, at once.

Whatever goes along the paths of a tree does so by doubling: each round a node takes over what the node it
points at has gathered, and points where that one points. The rounds grow with the logarithm of the depth.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .graph import durable

NODES = ("tree", "node", "parent", "length", "label", "support")


def parsed(text: str) -> list[tuple[int, int | None, float, str, float | None]]:
    """(node, parent, length, label, support) of one Newick text; the support is the last number of an inner node's label."""
    rows: list[list] = [[0, None, 0.0, "", None]]
    path, current, inner, before = [], 0, set(), ""
    for token in re.findall(r"'(?:[^']|'')*'|\[[^\]]*\]|[(),:;]|[^\s(),:;\[\]']+", text or ""):
        if token[0] == "[":
            continue
        if token == "(":
            inner.add(current)
            path.append(current)
            rows.append([len(rows), current, 0.0, "", None])
            current = len(rows) - 1
        elif token == ",":
            rows.append([len(rows), path[-1], 0.0, "", None])
            current = len(rows) - 1
        elif token == ")":
            current = path.pop()
        elif token == ";":
            break
        elif token != ":":
            name = token[1:-1].replace("''", "'") if token[0] == "'" else token
            if before == ":":
                rows[current][2] = float(name)
            else:
                rows[current][3] = name
        before = token
    for r in rows:
        numbers = re.findall(r"\d+(?:\.\d+)?", r[3]) if r[0] in inner else []
        r[4] = float(numbers[-1]) if numbers else None
    return [tuple(r) for r in rows] if len(rows) > 1 or rows[0][3] else []


def newick(texts: DataFrame, tree: str, text: str) -> DataFrame:
    """The nodes of trees in Newick form; empty and null texts have none."""
    kind = texts.select(tree).schema[0].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, t in enumerate(batch.column(1).to_pylist()):
                rows = parsed(t)
                if rows:
                    columns = [pa.array(c, k) for c, k in zip(zip(*rows), (pa.int64(), pa.int64(), pa.float64(), pa.string(), pa.float64()))]
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array([i] * len(rows))), *columns], list(NODES))

    return texts.select(tree, text).mapInArrow(run, f"tree {kind}, node long, parent long, length double, label string, support double")


def _rounds(state: DataFrame, step) -> DataFrame:
    """state (tree, node, to, ...) with every pointer `to` followed to its end; step gives the columns from own `a.` and next `b.` row."""
    state = durable(state)
    while not state.where("to is not null").isEmpty():
        nxt = state.alias("b")
        state = durable(state.alias("a").join(nxt, F.expr("a.tree = b.tree and a.to = b.node"), "left").select("a.tree", "a.node", F.col("b.to").alias("to"), *step), state)
    return state


def depths(nodes: DataFrame) -> DataFrame:
    """nodes with depth (sum of lengths from the root) and level (number of branches)."""
    start = nodes.select("tree", "node", F.col("parent").alias("to"), F.when(F.col("parent").isNull(), 0.0).otherwise(F.coalesce("length", F.lit(0.0))).alias("depth"), F.when(F.col("parent").isNull(), 0).otherwise(1).cast("long").alias("level"))
    step = [(F.col(f"a.{c}") + F.coalesce(F.col(f"b.{c}"), F.lit(0))).alias(c) for c in ("depth", "level")]
    return nodes.join(_rounds(start, step).drop("to"), ["tree", "node"])


def subtree_sums(nodes: DataFrame, value: Column) -> DataFrame:
    """(tree, node, total): the sum of a value over the nodes below each node, and itself."""
    sums = durable(nodes.select("tree", "node", value.cast("double").alias("total")))
    jump = durable(nodes.where("parent is not null").select("tree", "node", F.col("parent").alias("up")))
    while not jump.isEmpty():
        # Sums reach below 2**k levels; those of the nodes 2**k levels down are added.
        lower = jump.join(sums, ["tree", "node"]).groupBy("tree", F.col("up").alias("node")).agg(F.sum("total").alias("more"))
        sums = durable(sums.join(lower, ["tree", "node"], "left").select("tree", "node", (F.col("total") + F.coalesce("more", F.lit(0.0))).alias("total")), sums)
        jump = durable(jump.alias("a").join(jump.alias("b"), F.expr("a.tree = b.tree and a.up = b.node")).select("a.tree", "a.node", F.col("b.up").alias("up")), jump)
    return sums


def leaves(nodes: DataFrame) -> DataFrame:
    inner = nodes.where("parent is not null").select("tree", F.col("parent").alias("node")).distinct()
    return nodes.join(inner, ["tree", "node"], "left_anti")


def _flagged(nodes: DataFrame) -> DataFrame:
    """nodes with leaf, 1 or 0."""
    inner = nodes.where("parent is not null").select("tree", F.col("parent").alias("node"), F.lit(0).alias("leaf")).distinct()
    return nodes.join(inner, ["tree", "node"], "left").withColumn("leaf", F.coalesce("leaf", F.lit(1)))


def ladderized(nodes: DataFrame) -> DataFrame:
    """nodes with leaves (number below) and place, from 1 among its siblings: fewer leaves first, then the smaller node."""
    flagged = _flagged(nodes)
    counted = nodes.join(subtree_sums(flagged, F.col("leaf")).withColumn("leaves", F.col("total").cast("long")).drop("total"), ["tree", "node"])
    return counted.withColumn("place", F.row_number().over(W.partitionBy("tree", "parent").orderBy("leaves", "node")))


def collapsed(nodes: DataFrame, least: float) -> DataFrame:
    """nodes without the inner ones of less support; what hangs on them goes to the next kept node, lengths added."""
    weak = _flagged(nodes).withColumn("weak", F.coalesce((F.col("leaf") == 0) & F.col("parent").isNotNull() & (F.col("support") < least), F.lit(False))).drop("leaf")
    # A pointer stands for a parent that goes; `kept` is the parent found, at the distance gathered.
    up = weak.select("tree", F.col("node").alias("parent"), F.col("weak").alias("gone"))
    start = weak.join(up, ["tree", "parent"], "left").select("tree", "node", F.when(F.col("gone"), F.col("parent")).alias("to"), F.when(~F.coalesce("gone", F.lit(False)), F.col("parent")).alias("kept"), "length")
    step = [F.coalesce("a.kept", "b.kept").alias("kept"), (F.col("a.length") + F.coalesce("b.length", F.lit(0.0))).alias("length")]
    found = _rounds(start, step).select("tree", "node", F.col("kept").alias("parent"), "length")
    return weak.where("not weak").drop("parent", "length", "weak").join(found, ["tree", "node"]).select(*NODES)


def ancestors(nodes: DataFrame, of: DataFrame) -> DataFrame:
    """(tree, node) of the nodes of `of` and all nodes above them."""
    found = durable(of.select("tree", "node").distinct())
    jump = durable(nodes.where("parent is not null").select("tree", "node", F.col("parent").alias("up")))
    while not jump.isEmpty():
        found = durable(found.unionByName(found.join(jump, ["tree", "node"]).select("tree", F.col("up").alias("node"))).distinct(), found)
        jump = durable(jump.alias("a").join(jump.alias("b"), F.expr("a.tree = b.tree and a.up = b.node")).select("a.tree", "a.node", F.col("b.up").alias("up")), jump)
    return found


def clades(nodes: DataFrame, keywords: dict[str, Sequence[str]]) -> DataFrame:
    """(tree, clade, node): per name, the last common ancestor of the leaves whose label holds one of its keywords, whatever the case."""
    out = None
    tips = _flagged(nodes)
    level = depths(nodes).select("tree", "node", "level")
    for name, words in keywords.items():
        hit = F.lit(False)
        for w in words:
            hit = hit | F.lower(F.coalesce("label", F.lit(""))).contains(w.lower()) if w else hit
        sums = subtree_sums(tips, ((F.col("leaf") == 1) & hit).cast("int"))
        whole = sums.groupBy("tree").agg(F.max("total").alias("whole")).where("whole > 0")
        best = sums.join(whole, "tree").where("total = whole").join(level, ["tree", "node"]).groupBy("tree").agg(F.max_by("node", "level").alias("node"))
        found = best.select("tree", F.lit(name).alias("clade"), "node")
        out = found if out is None else out.unionByName(found)
    return out


def _meeting(nodes: DataFrame, marked: DataFrame) -> DataFrame:
    """(tree, node, meets): the first node at or above each one that is marked; the root is."""
    flagged = nodes.join(marked.select("tree", "node", F.lit(1).alias("m")), ["tree", "node"], "left")
    start = flagged.select("tree", "node", F.when(F.col("m").isNull(), F.col("parent")).alias("to"), F.when(F.col("m") == 1, F.col("node")).alias("meets"))
    return _rounds(start, [F.coalesce("a.meets", "b.meets").alias("meets")]).drop("to")


def midpoint_rooted(nodes: DataFrame) -> DataFrame:
    """nodes of the trees rooted in the middle of their longest path between leaves.

    The leaf that is farthest from the root ends such a path; the leaf farthest from that one is its other end.
    The branches from the middle up to the old root turn round and keep their lengths and supports; an old root
    that only passes on is left out. Trees whose middle is the root, or without length, stay. Ties go to the smaller node.
    """
    deep = durable(depths(nodes))
    tips = leaves(deep)
    pick = lambda rows, by: rows.groupBy("tree").agg(F.max_by(F.struct("node", by), F.struct(by, -F.col("node"))).alias("p")).select("tree", "p.node", F.col(f"p.{by}").alias(by))
    first = durable(pick(tips, "depth"))
    meets = _meeting(nodes, ancestors(nodes, first))
    met = deep.select("tree", F.col("node").alias("meets"), F.col("depth").alias("met_depth"))
    far = tips.join(meets, ["tree", "node"]).join(met, ["tree", "meets"]).join(first.select("tree", F.col("depth").alias("first_depth"), F.col("node").alias("first")), "tree")
    far = far.withColumn("span", F.col("first_depth") + F.col("depth") - 2 * F.col("met_depth"))
    second = far.groupBy("tree").agg(F.max_by(F.struct("node", "depth", "span", "first", "first_depth"), F.struct("span", -F.col("node"))).alias("p")).select("tree", "p.*")
    # The longer arm holds the middle.
    end = second.select("tree", F.when(F.col("first_depth") >= F.col("depth"), F.col("first")).otherwise(F.col("node")).alias("node"), F.greatest("first_depth", "depth").alias("end_depth"), (F.col("span") / 2).alias("half"))
    end = durable(end.where("half > 0"))
    path = ancestors(nodes, end).join(deep, ["tree", "node"]).join(end.drop("node"), "tree")
    up = path.select("tree", F.col("node").alias("parent"), F.col("depth").alias("up_depth"))
    below = path.where((F.col("end_depth") - F.col("depth") < F.col("half") - 1e-12) & F.col("parent").isNotNull())
    cut = below.groupBy("tree").agg(F.max_by(F.struct("node", "parent", "depth", "end_depth", "half"), F.struct(-F.col("level"), F.col("node"))).alias("p")).select("tree", F.col("p.node").alias("low"), F.col("p.parent").alias("parent"), "p.depth", "p.end_depth", "p.half")
    cut = cut.join(up, ["tree", "parent"]).withColumnRenamed("parent", "high")
    top = deep.groupBy("tree").agg(F.max("node").alias("last"), F.max(F.when(F.col("parent").isNull(), F.col("node"))).alias("root"))
    cut = cut.join(top, "tree").withColumns({"rest": F.col("end_depth") - F.col("up_depth") - F.col("half"), "rise": F.col("half") - (F.col("end_depth") - F.col("depth"))})
    cut = durable(cut.withColumn("on_node", F.col("rest") <= 1e-12).where("not (on_node and high = root)"))
    # Above the cut every node hangs on the one of the path below it.
    turned = path.select("tree", "node", "length", "support", "level").join(cut.select("tree", "high", "low", "rest", "on_node", "last"), "tree")
    along = W.partitionBy("tree").orderBy("level")
    turned = turned.withColumns({c: F.lead(s).over(along) for c, s in (("new_parent", "node"), ("new_length", "length"), ("new_support", "support"))})
    high_level = path.select("tree", F.col("node").alias("high"), F.col("level").alias("high_level"))
    turned = turned.join(high_level, ["tree", "high"]).where("level <= high_level")
    at_cut = F.col("node") == F.col("high")
    turned = turned.select(
        "tree", "node", F.when(at_cut & F.col("on_node"), F.lit(None)).when(at_cut, F.col("last") + 1).otherwise(F.col("new_parent")).alias("p"),
        F.when(at_cut & F.col("on_node"), F.lit(0.0)).when(at_cut, F.col("rest")).otherwise(F.col("new_length")).alias("l"),
        F.when(at_cut & F.col("on_node"), F.lit(None)).otherwise(F.col("new_support")).alias("s"), F.lit(True).alias("t"),
    )
    lower = cut.where("not on_node").select("tree", F.col("low").alias("node"), "rise", F.col("last").alias("new_root"))
    rows = nodes.join(turned, ["tree", "node"], "left").join(lower, ["tree", "node"], "left")
    split = F.col("rise").isNotNull()
    rows = rows.select(
        "tree", "node", F.when(F.col("t"), F.col("p")).when(split, F.col("new_root") + 1).otherwise(F.col("parent")).alias("parent"),
        F.when(F.col("t"), F.col("l")).when(split, F.col("rise")).otherwise(F.col("length")).alias("length"), "label", F.when(F.col("t"), F.col("s")).otherwise(F.col("support")).alias("support"),
    )
    added = cut.where("not on_node").select("tree", (F.col("last") + 1).alias("node"), F.lit(None).cast("long").alias("parent"), F.lit(0.0).alias("length"), F.lit("").alias("label"), F.lit(None).cast("double").alias("support"))
    rows = durable(rows.unionByName(added))
    # An old root with one branch left passes its place to what hangs on it.
    children = rows.where("parent is not null").groupBy("tree", F.col("parent").alias("node")).agg(F.count("*").alias("n"))
    idle = rows.join(cut.select("tree", F.col("root").alias("node")), ["tree", "node"]).join(children, ["tree", "node"]).where("n = 1 and parent is not null")
    idle = durable(idle.select("tree", "node", F.col("parent").alias("over"), F.col("length").alias("more"), F.col("support").alias("more_support")))
    kept = rows.join(idle.select("tree", "node"), ["tree", "node"], "left_anti")
    hung = kept.join(idle.withColumnRenamed("node", "parent"), ["tree", "parent"], "left")
    return hung.select("tree", "node", F.coalesce("over", "parent").alias("parent"), (F.col("length") + F.coalesce("more", F.lit(0.0))).alias("length"), "label", F.coalesce("support", "more_support").alias("support"))
