"""Tables of trees against small recursive versions."""

import random

from tessera.operators import trees


def random_newick(rng, depth=0):
    if depth > 6 or (depth > 1 and rng.random() < 0.35):
        return f"{rng.choice(['Hs', 'Mm', 'Sj'])}_{rng.randrange(10_000)}:{rng.choice([0.1, 0.25, 0.5, 1.0]) * rng.randrange(1, 5)}"
    own = "".join([f"{rng.randrange(100)}/{rng.randrange(100)}" if rng.random() < 0.8 else "", f":{rng.choice([0.1, 0.3, 0.7]) * rng.randrange(1, 4)}"]) if depth else ""
    return "(" + ",".join(random_newick(rng, depth + 1) for _ in range(rng.choice([2, 2, 3]))) + ")" + own


RNG = random.Random(11)
TEXTS = [random_newick(RNG) + ";" for _ in range(6)] + ["(a:1,b:1);", "(a:3,b:1);", "((a:1,b:1)90:1,c:3);", "((a:2,b:2)10:1,(c:1,d:1)80:1);", "lone;", "", None, "((('x y':5,b:1)30:1,c:1)99:1,d:1);", "(a:0,b:0);"]


def table(rows):
    """{node: (parent, length, label, support)} by tree."""
    out = {}
    for r in rows:
        out.setdefault(r["tree"], {})[r["node"]] = (r["parent"], r["length"], r["label"], r["support"])
    return out


def kids(tree):
    out = {n: [] for n in tree}
    for n, (p, *_) in tree.items():
        if p is not None:
            out[p].append(n)
    return out


def tips(tree, node=None):
    below = kids(tree)
    stack, out = [node if node is not None else next(n for n in tree if tree[n][0] is None)], []
    while stack:
        n = stack.pop()
        stack += below[n]
        if not below[n]:
            out.append(n)
    return out


def path(tree, n):
    out = [n]
    while tree[out[-1]][0] is not None:
        out.append(tree[out[-1]][0])
    return out


def between(tree, a, b):
    up = {n: i for i, n in enumerate(path(tree, a))}
    total, n = 0.0, b
    while n not in up:
        total += tree[n][1]
        n = tree[n][0]
    return total + sum(tree[x][1] for x in path(tree, a)[: up[n]])


def splits(tree):
    """Supports by the two sets of leaves that a branch divides."""
    every = frozenset(tree[n][2] for n in tips(tree))
    out = {}
    for n, (p, _, _, s) in tree.items():
        below = frozenset(tree[t][2] for t in tips(tree, n))
        if p is not None and s is not None and 1 < len(below) < len(every) - 1:
            out.setdefault(str(min(sorted(below), sorted(every - below))), set()).add(s)
    return out


def test_trees(spark):
    df = spark.createDataFrame(list(enumerate(TEXTS)), "tree int, text string").repartition(3)
    nodes = trees.durable(trees.newick(df, "tree", "text"))
    before = table(nodes.collect())
    assert set(before) == {i for i, t in enumerate(TEXTS) if t} and before[13][3][2] == "x y"

    for r in trees.ladderized(nodes).collect():
        assert r["leaves"] == len(tips(before[r["tree"]], r["node"]))
    for r in trees.depths(nodes).collect():
        own = path(before[r["tree"]], r["node"])
        assert r["level"] == len(own) - 1 and abs(r["depth"] - sum(before[r["tree"]][n][1] for n in own[:-1])) < 1e-9

    after = table(trees.midpoint_rooted(nodes).collect())
    assert set(after) == set(before)
    for k, tree in after.items():
        old = before[k]
        own = {tree[n][2]: n for n in tips(tree)}
        was = {old[n][2]: n for n in tips(old)}
        assert set(own) == set(was) and sum(p is None for p, *_ in tree.values()) == 1
        labels = sorted(own)
        spans = [between(old, was[a], was[b]) for a in labels for b in labels]
        assert all(abs(x - between(tree, own[a], own[b])) < 1e-9 for x, (a, b) in zip(spans, ((a, b) for a in labels for b in labels)))
        root = next(n for n in tree if tree[n][0] is None)
        assert abs(max(between(tree, root, n) for n in own.values()) - max(spans, default=0) / 2) < 1e-9 or len(own) == 1
        # Both branches of an old root of two are one branch now, with one of their supports.
        mine, theirs = splits(tree), splits(old)
        assert all(mine[x] <= theirs[x] for x in mine) and all(len(mine.get(x, ())) == 1 for x in theirs if len(theirs[x]) == 1), k

    weak = table(trees.collapsed(nodes, 50).collect())
    for k, tree in weak.items():
        old = before[k]
        inner = {n for n in old if kids(old)[n] and old[n][0] is not None}
        gone = {n for n in inner if old[n][3] is not None and old[n][3] < 50}
        assert set(tree) == set(old) - gone
        for n, (p, length, *_) in tree.items():
            up = path(old, n)[1:]
            kept = next((i for i, a in enumerate(up) if a not in gone), None)
            assert p == (None if kept is None else up[kept])
            assert abs(length - old[n][1] - sum(old[a][1] for a in up[: kept or 0])) < 1e-9

    found = {(r["tree"], r["clade"]): r["node"] for r in trees.clades(nodes, {"human": ["hs_"], "none": ["zzz", ""], "two": ["MM", "sj"]}).collect()}
    for k, tree in before.items():
        for name, words in (("human", ("hs_",)), ("two", ("mm", "sj"))):
            hits = [n for n in tips(tree) if any(w in tree[n][2].lower() for w in words)]
            common = set.intersection(*[set(path(tree, n)) for n in hits]) if hits else set()
            assert found.get((k, name)) == (max(common, key=lambda n: len(path(tree, n))) if common else None)
    assert not any(c == "none" for _, c in found)
