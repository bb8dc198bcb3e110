"""Operators that spread a global order, a long key or a large group over tasks, against plain versions."""

import random
import re
import time

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.functions import order, scan, sequences
from tessera.sinks import files
from tessera.operators import clusters, docking, geometry, graph, motifs, relational, selection
from tessera.plans import extended


@pytest.fixture
def wide(monkeypatch):
    """Every input counts as large."""
    monkeypatch.setattr(order, "SMALL", -1)
    monkeypatch.setattr(order, "PARTS", 7)


def test_percentiles_are_exact(spark, monkeypatch):
    rng = np.random.default_rng(2)
    x, y = rng.lognormal(0, 40, 5000), np.where(rng.random(5000) < 0.7, 1.5, rng.integers(-3, 3, 5000))
    rows = [(float(a), None if i % 9 == 0 else float(b), None, -1e308 if i else 1e308) for i, (a, b) in enumerate(zip(x, y))]
    df = spark.createDataFrame(rows, "a double, b double, c double, d double").repartition(6)
    probabilities = [0.0, 0.05, 0.5, 0.95, 0.999, 1.0]
    wanted = {c: (F.col(c), probabilities) for c in "abcd"}
    plain = df.agg(*[F.percentile(c, F.array(*map(F.lit, probabilities))).alias(c) for c in "abcd"]).first()
    for gathered in (order.GATHERED, 3):
        monkeypatch.setattr(order, "GATHERED", gathered)
        got = order.percentiles(df, wanted)
        assert got["c"] == [None] * 6 and all(got[c] == plain[c] for c in "abd")
    assert order.percentiles(df.limit(0), wanted)["a"] == [None] * 6


def test_ranks_without_one_task(spark, wide):
    rng = random.Random(3)
    values = [None if i % 50 == 0 else rng.choice([rng.random(), 0.5]) for i in range(3000)]
    df = spark.createDataFrame(list(enumerate(values)), "i int, score double").repartition(5)
    ranked = {r["i"]: r["rank"] for r in selection.dense_rank(df, "score", "rank").collect()}
    distinct = sorted({round(v or 0.0, 9) for v in values}, reverse=True)
    assert ranked == {i: distinct.index(round(v or 0.0, 9)) + 1 for i, v in enumerate(values)}
    assert {r["i"]: r["n"] for r in order.row_numbers(df, ["i"], "n").collect()} == {i: i + 1 for i in range(3000)}
    assert order.row_numbers(df.limit(0), ["i"], "n").count() == 0
    plan = order.row_numbers(df, ["i"], "n")._jdf.queryExecution().executedPlan().toString()
    assert "SinglePartition" not in plan


def test_scans_along_a_hot_key(spark, monkeypatch):
    rng = random.Random(5)
    rows = [("hot" if rng.random() < 0.9 else rng.choice(["a", None]), t, rng.choice(["x", "y", None]) if rng.random() < 0.2 else "x", rng.choice([None, None, t])) for t in range(2000)]
    df = spark.createDataFrame(rows, "k string, t int, v string, h int").repartition(4)
    ranges = df.select("k", F.col("t").alias("s"), (F.col("t") + F.pmod(F.xxhash64("t"), F.lit(9))).alias("e"))
    runs = {
        "runs": lambda: relational.runs(df, ["k"], ["t"], "v"),
        "merged": lambda: relational.merge_ranges(ranges, ["k"], "s", "e", 0),
        "carried": lambda: relational.carried(df, ["k"], ["t"], "h", "last").select("k", "t", "last"),
        "numbered": lambda: order.numbered(df, ["k"], ["t"], "n").select("k", "t", "n"),
    }
    plain = {name: sorted(map(str, run().collect())) for name, run in runs.items()}
    monkeypatch.setattr(order, "SMALL", -1)
    monkeypatch.setattr(order, "PARTS", 7)
    for name, run in runs.items():
        assert sorted(map(str, run().collect())) == plain[name], name


def test_scans_take_time_in_proportion(spark):
    rng = random.Random(1)
    long = "".join(rng.choice("IVLFAGKRDE" if i // 100 % 2 else "IVLF") for i in range(35_000))
    df = spark.createDataFrame([(long,)], "s string")
    began = time.time()
    first = df.select(sequences.segments(F.col("s")).alias("x"), sequences.signal(F.col("s")).alias("y"), sequences.tail_anchor(F.col("s"), 50, 18, 25, 0.7).alias("z"), F.size(sequences.padded_means(sequences.values(F.col("s")), 19)).alias("n")).first()
    hits = scan.overlapping(df, "s", "[IV][LF]").count()
    assert time.time() - began < 30
    assert len(first["x"]) > 50 and first["n"] == 35_000 and hits == len(re.findall("(?=[IV][LF])", long))


def test_scan_has_right_starts(spark):
    df = spark.createDataFrame([("xx\u0001ab ab",), (None,), ("",)], "s string")
    assert [(r["start"], r["end"]) for r in scan.overlapping(df, "s", "ab").collect()] == [(4, 5), (7, 8)]
    assert [r["start"] for r in scan.literal(df, "s", "\u0001").collect()] == [3]
    with pytest.warns(UserWarning):
        assert scan.overlapping(df, "s", r"\p{L}{2}").count() == 0
    assert scan.overlapping(df, "s", "(?P<n>a)b").count() == 2
    (one,) = df.where("s like 'xx%'").select(scan.matches(F.col("s"), "a(?=b)|x*").alias("m")).collect()
    assert [tuple(m) for m in one["m"]] == [(1, "xx"), (4, "a"), (7, "a")]


TEXTS = ["GXSXGHGGGA", "aaaa", "HGGHGGG", "", None, "NKTS nkts", "straße KELVIN K", "thee the"]
MOTIFS = [("box", "G.S.G", False), ("hgg", "HGGG?", False), ("aa", "aa", True), ("none", "q*", False), ("bad", "(", False), ("java", r"\p{L}", False), (None, "ts", False), ("k", "k", False), ("alt", "(?:the|nk)", False), ("null", None, False), ("the", "the", True), ("the2", "the", True), ("opt", "t(he)+", False)]


def test_motif_table(spark):
    texts = spark.createDataFrame(list(enumerate(TEXTS)), "i int, t string")
    table = spark.createDataFrame([*MOTIFS, MOTIFS[0]], "motif string, pattern string, literal boolean")
    want = set()
    for i, t in enumerate(TEXTS):
        for name, pattern, literal in MOTIFS:
            try:
                compiled = re.compile(re.escape(pattern) if literal else pattern, 0 if literal else re.I)
            except (re.error, TypeError):
                continue
            for at in range(len(t or "")):
                m = compiled.match(t, at)
                if m and m.group():
                    want.add((i, name, at + 1, m.end(), m.group()))
    for block in (motifs.BLOCK, 3):
        got = [tuple(r) for r in motifs.scan(texts, table, "i", "t", block).collect()]
        assert len(got) == len(set(got)) and set(got) == want
    assert {r["motif"] for r in motifs.faults(table).collect()} == {"bad", "java", "null"}
    assert motifs.scan(texts, table.limit(0), "i", "t").count() == 0 and motifs.scan(texts.limit(0), table, "i", "t").count() == 0


def test_required_parts():
    for pattern, part in (("G.S.G", "g"), ("HGGG?", "hgg"), ("(?:the|nk)", ""), ("ab(cd)ef", "abcdef"), ("a(?:bc)+d", "bc"), ("x*", ""), (r"\d\dabc[xy]defg", "defg"), ("(?!abc)de", "de")):
        assert motifs.required(pattern) == part


def test_motif_library(spark):
    cells = [
        ("s", 0, ["My library", None, None]), ("s", 1, [None, None, None]), ("s", 2, ["Motif ID", "Regex compatible-pattern", "Region"]), ("s", 3, ["CD36 family:", "", None]),
        ("s", 4, ["CD36_M1", "A B C", "loop"]), ("s", 5, ["x-9", "AA", ""]), ("s", 6, ["NPC1_M1", "", ""]), ("s", 7, ["NPC2like_7", "C", "z"]), ("s", 8, ["NPC2like_7", "C", "z"]),
        ("t", 0, ["motif", "family", "motif_id", "regex"]), ("t", 1, ["", "own", "H_1", "K"]), ("t", 2, ["Hydrolase things", "", "", ""]), ("t", 3, ["", "", "_q", "L"]), ("u", 0, ["no", "header"]),
    ]
    got = sorted(tuple(r)[:4] for r in motifs.library(spark.createDataFrame(cells, "sheet string, row_no int, values array<string>")).collect())
    assert got == [("CD36RP", "CD36_M1", "", "ABC"), ("NPC2", "NPC2like_7", "", "C"), ("Unspecified", "_q", "", "L"), ("own", "H_1", "", "K"), ("x", "x-9", "", "AA")]


def test_components_by_key(spark):
    chain = [(g, i, i + 1) for g in (1, 2) for i in range(40)] + [(1, 7, 7), (1, None, 3), (3, 9, 8)]
    got = {tuple(r) for r in graph.components(spark.createDataFrame(chain, "g int, u long, v long"), ["g"]).collect()}
    assert got == {(g, i, 0) for g in (1, 2) for i in range(41)} | {(3, 8, 8), (3, 9, 8)}


@pytest.fixture(scope="module")
def points(spark):
    rng = np.random.default_rng(7)
    rows = []
    for g, n in ((0, 45), (1, 20), (2, 1)):
        centres = rng.normal(0, 3, (5, 3))
        rows += [(g, 1000 * g + 7 * i, [float(v) for v in centres[i % 5] + rng.normal(0, 0.7, 3)]) for i in range(n)]
    return rows, spark.createDataFrame(rows, "g int, i long, v array<double>").repartition(5)


def by_group(rows):
    for g in sorted({r[0] for r in rows}):
        own = sorted(r[1:] for r in rows if r[0] == g)
        x = np.array([v for _, v in own])
        yield g, [i for i, _ in own], np.stack([np.sqrt(((x - p) ** 2).sum(axis=1)) for p in x])


@pytest.mark.parametrize("complete", [True, False])
@pytest.mark.parametrize("cutoff", [0.9, 2.0])
def test_linkage_beyond_a_worker(spark, points, complete, cutoff):
    rows, df = points
    got = {(r["g"], r["i"]): r["label"] for r in clusters.linkage(df, "g", "i", "v", cutoff, complete, size=16).collect()}
    want = {(g, i): y for g, ids, d in by_group(rows) for i, y in zip(ids, geometry.linkage_labels(d, cutoff, complete))}
    assert got == want and len(set(want.values())) < len(want)


@pytest.mark.parametrize(("radius", "least"), [(0.7, 4), (1.0, 3), (0.4, 2)])
def test_density_beyond_a_worker(spark, points, radius, least):
    rows, df = points
    got = {(r["g"], r["i"]): r["label"] for r in clusters.density(df, "g", "i", "v", radius, least, size=16).collect()}
    assert got == {(g, i): y for g, ids, d in by_group(rows) for i, y in zip(ids, geometry.density_labels(d, radius, least))}


def test_pairs_and_totals_by_blocks(spark, points):
    rows, df = points
    got = {(r["g"], r["left"], r["right"]): r["distance"] for r in clusters.near_pairs(df, "g", "i", "v", 1.0, size=16).collect()}
    want = {(g, ids[a], ids[b]): d[a, b] for g, ids, d in by_group(rows) for a in range(len(ids)) for b in range(a + 1, len(ids)) if d[a, b] <= 1.0}
    assert got == want
    totals = {(r["g"], r["i"]): (round(r["total"], 9), r["n"]) for r in clusters.total_distances(df, "g", "i", "v", size=16).collect()}
    assert totals == {(g, i): (round(float(d[a].sum()), 9), len(ids)) for g, ids, d in by_group(rows) for a, i in enumerate(ids)}


def test_superposed_blocks(spark):
    """All pairs by blocks equal pairs superposed one by one, also copies, mirror images, flat, straight and empty shapes."""
    rng = np.random.default_rng(3)
    x = rng.normal(size=(40, 21))
    x[1], x[2] = x[0], x[0] * np.tile([1, 1, -1], 7)
    x[3], x[4], x[5] = x[3] * np.tile([1, 1, 0], 7), x[4] * np.tile([1, 0, 0], 7), 0
    df = spark.createDataFrame([(i % 2, i // 2, v.tolist()) for i, v in enumerate(np.repeat(x, 2, axis=0))], "g int, i int, v array<double>")
    found = geometry.pairwise_rmsd(df, "g", "i", "v")
    # Each item's points travel once a block: no row of a join holds the points of one pair.
    assert "MapInArrow" in found._jdf.queryExecution().toString()
    got = {(r["g"], r["left"], r["right"]): r["rmsd"] for r in found.collect()}
    assert len(got) == 2 * 40 * 39 // 2
    for (_, a, b), d in got.items():
        assert d == pytest.approx(geometry.rmsd(x[a].reshape(-1, 3), x[b].reshape(-1, 3)), abs=1e-9)


@pytest.mark.parametrize("complete", [False, True])
def test_linkage_looks_at_few_rows(complete):
    """Equal to merging the lowest pair of the whole table, ties too, in time that does not grow with its cube."""
    rng = np.random.default_rng(4)
    for x in (rng.normal(size=(60, 3)), rng.integers(0, 3, size=(60, 2)).astype(float)):
        d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(axis=2))
        e, sets = np.where(np.eye(len(d), dtype=bool), np.inf, d), {i: [i] for i in range(len(d))}
        while len(sets) > 1:
            i, j = divmod(int(np.argmin(e)), len(d))
            if e[i, j] > 0.9:
                break
            a, b = len(sets[i]), len(sets[j])
            row = np.maximum(e[i], e[j]) if complete else (a * e[i] + b * e[j]) / (a + b)
            e[i], e[:, i] = row, row
            e[i, i], e[j], e[:, j] = np.inf, np.inf, np.inf
            sets[i] += sets.pop(j)
        want = {frozenset(v) for v in sets.values()}
        labels = geometry.linkage_labels(d, 0.9, complete)
        assert {frozenset(np.flatnonzero(labels == k)) for k in set(labels)} == want
    x = rng.normal(size=(1500, 3))
    d = np.stack([np.sqrt(((x - row) ** 2).sum(axis=1)) for row in x])
    started = time.process_time()
    geometry.linkage_labels(d, 5.0, complete)
    assert time.process_time() - started < 6


def test_large_nested_clusters_go_by_blocks(spark, monkeypatch):
    monkeypatch.setattr(geometry, "WHOLE", 25)
    rng = np.random.default_rng(5)
    x = rng.normal(size=(50, 2))
    outer = [int(i >= 20) for i in range(50)]
    df = spark.createDataFrame([(0, outer[i], i, v.tolist()) for i, v in enumerate(x)], "g int, o int, i int, v array<double>")
    found = geometry.nested_labels(df, "g", "o", "i", "v", "average", 0.8)
    assert "parquet" in found._jdf.queryExecution().toString()
    got = {r["i"]: r["label"] for r in found.collect()}
    for o in (0, 1):
        own = np.flatnonzero(np.array(outer) == o)
        d = np.sqrt(((x[own][:, None] - x[own][None]) ** 2).sum(axis=2))
        assert [got[i] for i in own] == [f"H{o}_L{k}" for k in geometry.linkage_labels(d, 0.8, False)]


def test_row_numbers_of_some_megabytes_need_more_than_one_task(spark):
    rows = spark.range(2_000_000).select(((F.col("id") * 7919) % 2_000_000).alias("v"))
    assert order.SORTED < int(str(rows._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) <= order.SMALL
    found = order.row_numbers(rows, ["v"], "place")
    assert "SinglePartition" not in found._jdf.queryExecution().executedPlan().toString()
    assert found.where("place = v + 1").count() == 2_000_000


def test_a_file_offered_often_meets_a_pose_once(spark):
    """Names of the files are made distinct before they meet the poses; the least path of a name stays."""
    poses = spark.createDataFrame([(1, "a"), (2, "b.sdf"), (3, "c")], "id int, Prediction string")
    files = spark.createDataFrame([("y/a.sdf",), ("x/a.sdf",)] * 50 + [("z/b.sdf",)] * 50 + [(None,)], "path string")
    found, dropped = docking.matched_files(poses, files)
    assert {(r["id"], r["PosePath"]) for r in found.collect()} == {(1, "x/a.sdf"), (2, "z/b.sdf")} and found.count() == 2
    assert [r["id"] for r in dropped.collect()] == [3]
    assert "Aggregate [_n" in found._jdf.queryExecution().optimizedPlan().toString()


def test_points_travel_as_often_as_a_cell_has_blocks(spark):
    """A group of 600 points in tiles of 4 makes 16 blocks, not 150, and its pairs are whole."""
    rng = np.random.default_rng(3)
    vectors = rng.normal(0, 1, (600, 5)).astype("float32")
    df = spark.createDataFrame([(1, i, v.tolist()) for i, v in enumerate(vectors)], "g int, i long, v array<float>")
    made, pairs = clusters.blocks(df, "g", "i", "v", None, 4)
    assert made.count() == 16 and pairs.count() == 136 and made.schema["values"].dataType.simpleString() == "array<float>"
    got = clusters.near_pairs(df, "g", "i", "v", 0.9, 4)
    d = np.sqrt(((vectors[:, None].astype(float) - vectors[None].astype(float)) ** 2).sum(axis=2))
    want = {(i, j) for i, j in zip(*np.nonzero(d <= 0.9)) if i < j}
    found = [(r["left"], r["right"]) for r in got.collect()]
    assert len(found) == len(want) and set(found) == want


def test_sums_of_clusters_move_points_by_blocks(spark):
    """Sums between clusters over blocks of any number equal plain ones, and no join's rows hold a vector a pair."""
    rng = np.random.default_rng(4)
    x = rng.normal(0, 1, (90, 3))
    names = rng.integers(0, 12, 90)
    points = spark.createDataFrame([(1, i, v.tolist()) for i, v in enumerate(x)], "key int, item long, vector array<double>")
    members = spark.createDataFrame([(1, i, int(c)) for i, c in enumerate(names)], "key int, item long, c long")
    pairs = spark.createDataFrame([(1, a, b) for a in range(12) for b in range(a + 1, 12)], "key int, a long, b long")
    found = clusters._summed(pairs, members, points, 4)
    got = {(r["a"], r["b"]): (r["s"], r["n"]) for r in found.collect()}
    for a, b in ((a, b) for a in range(12) for b in range(a + 1, 12)):
        d = np.sqrt(((x[names == a][:, None] - x[names == b][None]) ** 2).sum(axis=2))
        assert got[a, b][1] == d.size and abs(got[a, b][0] - d.sum()) < 1e-9
    assert "zip_with" not in found._jdf.queryExecution().optimizedPlan().toString()


def test_partitions_follow_the_size(spark, monkeypatch):
    """Merged residues of a table of many shares come in that many partitions, not in the session's number."""
    rows = spark.range(2000).selectExpr("id % 500 AS k", "concat('a', id % 4) AS name", "id AS q").localCheckpoint()
    monkeypatch.setattr(order, "SHARE", 1 << 10)
    merged = files.merged_residue(rows.where("q < 1500"), rows.where("q >= 1500"), ["k"])
    assert "REPARTITION_BY_NUM" in merged._jdf.queryExecution().executedPlan().toString()
    got = {(r["k"], r["name"]): r["q"] for r in merged.collect()}
    assert len(got) == 500 and all(q >= 1500 for q in got.values())


@pytest.mark.parametrize("radius", [None, 1.2])
def test_blocks_that_meet_are_dealt_once(spark, radius):
    """Without a radius all are of one cell; the join of blocks takes them as they were dealt, by a given number and not by bytes."""
    df = spark.createDataFrame([(i % 2, i, [float(i), 1.0]) for i in range(12)], "g int, i long, v array<double>")
    plan = clusters.near_pairs(df, "g", "i", "v", radius, 2)._jdf.queryExecution().executedPlan().toString().split("\n")
    above = [plan[i - 1] for i, line in enumerate(plan) if "REPARTITION_BY_NUM" in line]
    assert len(above) == 2 and not any("Exchange" in line for line in above if "REPARTITION_BY_NUM" not in line)


def test_rounding_of_pairs_is_that_of_the_sql(spark):
    values = [0.0, 0.000005, 0.000015, 0.000025, 0.1 + 0.2, 1.2345649999, 1.234565, 2.675, 1e6 + 0.000005, *np.random.default_rng(2).uniform(0, 9, 500).tolist()]
    got = [r["x"] for r in spark.createDataFrame([(v,) for v in values], "v double").select(extended.r5(F.col("v")).alias("x")).collect()]
    assert got == [duckdb.execute("SELECT round(CAST(? AS double), 5)", [v]).fetchone()[0] for v in values]
