"""Every query with a SQL twin against DuckDB at the smallest scale, and operators on small cases."""

import json
import math
import random

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.functions import scaling, scan, sequences, tables
from tessera.operators import axes, checks, docking, geometry, relational, selection, summaries, trajectory
from tessera.plans import catalogue, pipelines
from tessera.sinks import files as sinks
from tessera.sources import structures, text_tables

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return "null"
    return f"{float(v):.6f}" if isinstance(v, (int, float, np.number)) and not isinstance(v, bool) else str(v)


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(catalogue.SQL))
def test_query_equals_its_sql(spark, duck, name):
    got = catalogue.QUERIES[name](spark, DATA)
    names = sorted(got.columns)
    result = duck.sql(catalogue.SQL[name])
    at = [result.columns.index(c) for c in names]
    expected = sorted(tuple(plain(r[i]) for i in at) for r in result.fetchall())
    assert sorted(tuple(plain(r[c]) for c in names) for r in got.collect()) == expected


def groups_of(pairs, items):
    parent = {i: i for i in items}
    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i
    for a, b in pairs:
        parent[max(root(a), root(b))] = min(root(a), root(b))
    return {i: root(i) for i in items}


def brute_linkage(d, cutoff, complete):
    """Merges the two clusters of least linkage, computed anew from their members each time."""
    clusters = [[i] for i in range(len(d))]
    measure = (lambda a, b: d[np.ix_(a, b)].max()) if complete else (lambda a, b: d[np.ix_(a, b)].mean())
    while len(clusters) > 1:
        best = min((measure(a, b), i, j) for i, a in enumerate(clusters) for j, b in enumerate(clusters) if i < j)
        if best[0] > cutoff:
            break
        clusters[best[1]] += clusters.pop(best[2])
    return {frozenset(c) for c in clusters}


def brute_density(d, radius, least):
    near = d <= radius
    core = near.sum(axis=1) >= least
    found = groups_of([(i, j) for i in range(len(d)) for j in range(len(d)) if core[i] and core[j] and near[i, j]], range(len(d)))
    clusters = {}
    for i in range(len(d)):
        if core[i]:
            clusters.setdefault(found[i], set()).add(i)
    noise = [i for i in range(len(d)) if not core[i] and not any(near[i, j] and core[j] for j in range(len(d)))]
    return clusters, noise


@pytest.mark.parametrize("name,complete", [("clu_average", False), ("clu_complete", True)])
def test_linkage_equals_brute_force(spark, name, complete):
    got = {r["vec_id"]: (r["grp"], r["label"]) for r in catalogue.QUERIES[name](spark, DATA).collect()}
    rows = catalogue.table(spark, DATA, "embeddings").collect()
    assert len(got) == len(rows)
    for group in {r["label"] for r in rows}:
        own = sorted((r for r in rows if r["label"] == group), key=lambda r: r["vec_id"])
        x = np.array([r["embedding"] for r in own], dtype=float)
        d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(axis=2))
        expected = {frozenset(own[i]["vec_id"] for i in c) for c in brute_linkage(d, 1.2, complete)}
        found = {}
        for r in own:
            found.setdefault(got[r["vec_id"]], set()).add(r["vec_id"])
        assert {frozenset(c) for c in found.values()} == expected


def test_density_equals_brute_force(spark):
    got = {r["vec_id"]: r["label"] for r in catalogue.QUERIES["clu_dbscan"](spark, DATA).collect()}
    rows = catalogue.table(spark, DATA, "embeddings").collect()
    for group in {r["label"] for r in rows}:
        own = sorted((r for r in rows if r["label"] == group), key=lambda r: r["vec_id"])
        x = np.array([r["embedding"] for r in own], dtype=float)
        clusters, noise = brute_density(np.sqrt(((x[:, None] - x[None]) ** 2).sum(axis=2)), 1.0, 2)
        labels = [got[r["vec_id"]] for r in own]
        assert len({labels[i] for i in noise}) == len(noise)
        for c in clusters.values():
            assert len({labels[i] for i in c}) == 1


def test_scaling_policies(spark):
    rows = spark.createDataFrame([(1, None, 2.0, None), (2, 1.0, 2.0, None), (3, 3.0, 2.0, None)], "k int, x double, flat double, none double")
    value = lambda c, p: [r["o"] for r in scaling.robust_scale(rows, c, "o", policy=p).orderBy("k").collect()]
    assert value("flat", "keep_null") == [0.5] * 3
    assert value("none", "impute_median") == [None] * 3
    assert value("none", "impute_median_or_half") == [0.5] * 3
    assert value("x", "keep_null")[0] is None and value("x", "impute_median")[0] == pytest.approx(0.5)


def test_scans_and_ranges(spark):
    one = spark.createDataFrame([("HGGGESAGXGASAG",)], "s string")
    got = [(r["start"], r["end"], r["hit"]) for r in scan.overlapping(one, "s", "G[A-Z]S[A-Z]G|HGGG?|HGS|HGA").orderBy("start").collect()]
    assert got == [(1, 4, "HGGG"), (4, 8, "GESAG"), (10, 14, "GASAG")]
    assert [r["start"] for r in scan.literal(spark.createDataFrame([("AAAA",)], "s string"), "s", "AA").collect()] == [1, 2, 3]
    merged = relational.merge_ranges(spark.createDataFrame([(0, 1, 5), (0, 7, 9), (0, 12, 15)], "k int, a int, b int"), ["k"], "a", "b", 2)
    assert sorted((r["a"], r["b"]) for r in merged.collect()) == [(1, 9), (12, 15)]
    with pytest.raises(ValueError, match="1 id values"):
        relational.join_all(spark.createDataFrame([("P2",)], "id string"), spark.createDataFrame([("P1",)], "id string"), "id")


def test_clusters_small():
    line = np.array([[0, 1, 3], [1, 0, 1], [3, 1, 0]], dtype=float)
    assert geometry.greedy_labels(np.array([[0, 1, 3], [1, 0, 1], [3, 1, 0]], dtype=float), 2).tolist() == [1, 1, 2]
    assert geometry.greedy_labels(np.array([[0, 3, 1], [3, 0, 1], [1, 1, 0]], dtype=float), 2).tolist() == [1, 2, 2]
    assert geometry.linkage_labels(line, 1.0, True).tolist() == [1, 1, 2]
    assert geometry.density_labels(np.array([[0.0, 9], [9, 0.0]]), 1.0, 2).tolist() == [1, 2]


def test_trimmed_mean_drops_none_below_ten(spark):
    nine = spark.createDataFrame([(1, float(i)) for i in range(9)], "k int, v double")
    assert summaries.trimmed_mean(nine, ["k"], "v").first()["trimmed"] == 4.0


def test_readers(spark):
    whole = lambda t: spark.createDataFrame([("f", t)], "path string, value string")
    table = "# comment\ndomA PF00061.30 130 P1 - 140 1e-20 70 0.1 1 1 1e-23 1e-20 rest\n"
    assert [tuple(r) for r in text_tables.domain_hits(text_tables.lines(whole(table))).collect()] == [("P1", "PF00061", 1e-20)]
    with pytest.raises(Exception, match="malformed"):
        text_tables.domain_hits(text_tables.lines(whole("a b c"))).collect()
    assert [(r["seq_id"], r["sequence"]) for r in text_tables.fasta(whole(">a one\nac d*\nEF\n>b\n\n")).collect()] == [("a", "ACDEF")]
    assert [tuple(r)[1:] for r in text_tables.modes(text_tables.lines(whole("   1       -7.5      0.000      0.000\nx"))).collect()] == [(1, -7.5, 0.0, 0.0)]
    assert text_tables.signal_peptides(text_tables.lines(whole("# x\nid\tSP\t0.1\t0.9\tCS pos: 25-26. Pr: 0.6"))).first()["cut"] == 26
    assert text_tables.series(text_tables.lines(whole("# a\n@ b\n0 1.5\nbad x\n"))).count() == 2
    atom = "ATOM      1  CA  HIS A 508      11.104   6.134  -6.504  1.00 88.50           C"
    got = text_tables.atoms(text_tables.lines(whole(atom))).first()
    assert (got["resid"], got["x"], got["bfactor"], got["element"]) == (508, 11.104, 88.5, "C")


def test_contacts_equal_brute_force(spark):
    rng = np.random.default_rng(1)
    points = [(i, *map(float, rng.random(3))) for i in range(60)]
    df = spark.createDataFrame(points, "id long, x double, y double, z double")
    got = {(r[0], r[1]) for r in geometry.contacts(df, df, 0.3).collect()}
    x = np.array([p[1:] for p in points])
    assert got == {(int(i), int(j)) for i, j in np.argwhere(np.sqrt(((x[:, None] - x) ** 2).sum(axis=2)) <= 0.3)}


KD = sequences.HYDROPATHY


def loop_segments(seq, width, threshold, gap):
    v = [KD.get(c, 0.0) for c in seq]
    found, i = [], 0
    while i + width <= len(v):
        if sum(v[i : i + width]) / width >= threshold - 1e-9:
            j = i
            while j + 1 + width <= len(v) and sum(v[j + 1 : j + 1 + width]) / width >= threshold - 1e-9:
                j += 1
            found.append([i + 1, j + width])
            i = j + width
        else:
            i += 1
    out = []
    for s, e in found:
        if out and s <= out[-1][1] + gap:
            out[-1][1] = max(e, out[-1][1])
        else:
            out.append([s, e])
    return ";".join(f"{s}-{e}" for s, e in out)


def test_segments_equal_a_loop(spark):
    rng = random.Random(4)
    seqs = ["".join(rng.choice("IVLFAGKRDE" if rng.random() < 0.3 else "IVLFAG") for _ in range(n)) for n in (0, 5, 19, 40, 90, 200, 300)] + [None]
    rows = spark.createDataFrame(list(enumerate(seqs)), "k int, s string")
    for width, threshold in ((19, 1.6), (5, 2.0), (9, 2.5)):
        got = {r[0]: r[1] for r in rows.select("k", sequences.rendered(sequences.segments(F.col("s"), width, threshold))).collect()}
        assert got == {i: loop_segments(s or "", width, threshold, 3) for i, s in enumerate(seqs)}
    padded = [r[0] for r in rows.orderBy("k").select(sequences.padded_means(sequences.values(F.col("s")), 5)).collect()]
    assert [len(p) for p in padded] == [len(s or "") for s in seqs] and padded[3][-1] == padded[3][-5]


def test_signal_and_tail(spark):
    signal = "MKKRS" + "L" * 16 + "SASAAQDEDEDEDE" + "KDE" * 10
    tail = "MKDE" * 12 + "SGSGS" + "KDERK" + "LIVFLIVFLIVFLIVFLIVFLIV"
    rows = spark.createDataFrame([(1, signal), (2, "KDE" * 12), (3, "MKL"), (4, tail), (5, None), (6, "")], "k int, s string")
    got = {r["k"]: r for r in rows.select("k", sequences.signal(F.col("s")).alias("a"), sequences.tail_anchor(F.col("s"), 50, 18, 25, 0.7).alias("t")).collect()}
    assert got[1]["a"]["found"] and got[1]["a"]["cut"] == next(c for c in range(16, 35) if signal[c - 3] in "ASTGVC" and signal[c - 1] in "ASTGVC")
    assert not any(got[k]["a"]["found"] for k in (2, 3, 5, 6))
    t = got[4]["t"]
    start = t["start"]
    assert t["found"] and tail[t["omega"] - 1] in "ADEGNQST" and tail[t["omega"] - 3] in "ADEGNQST" and start - 15 <= t["omega"] < start - 4
    assert t["end"] - start + 1 == next(w for w in range(18, 26) for i in range(50 - w - 8, 50 - w + 1) if sum(c in "CFILMVWY" for c in tail[-50:][i : i + w]) >= 0.7 * w) and not got[2]["t"]["found"] and got[5]["t"]["start"] is None


def test_structure_of_one_model(spark):
    """Residue and chain means, motif means and the score of a small model with its confidences."""
    data = {"ptm": 0.82, "ipTM": 0.9, "deep": [{"pae": [[1.0, 2.0], [1.5, 1.5]]}, {"chain_pair_iptm": [[0.7, 0.7], [0.77, 0.77]]}], "score": True, "iptm": {"x": 3}}
    found = {r["metric"]: r for r in structures.value_statistics(structures.json_values(spark.createDataFrame([("a", json.dumps(data)), ("b", "{"), ("c", None)], "k string, t string"), "k", "t"), ["k", "metric"]).collect()}
    assert len(found) == 12 and (found["pae"]["mean"], found["pae"]["count"]) == (1.5, 4)
    assert (round(found["iptm"]["mean"], 3), found["iptm"]["count"]) == (0.768, 5) and found["ranking_score"]["mean"] == 1.0 and found["pde"]["count"] == 0
    cif = "data_x\nloop_\n_atom_site.id\n_atom_site.label_asym_id\n_atom_site.auth_seq_id\n_atom_site.label_comp_id\n_atom_site.B_iso_or_equiv\n1 A 2 GLY 90\n2 A 10 HIS '80'\n3 A 2 GLY 70\n4 A x1 UNK 50\n5 A 3 GLY ?\n#\n"
    atoms = structures.loop_atoms(spark.createDataFrame([("m", cif), ("n", None)], "k string, t string"), "k", "t")
    (chain,) = structures.chains(structures.residues(atoms, "k"), "k").collect()
    assert (chain["sequence"], round(chain["mean_plddt"], 6), chain["atom_count"]) == ("GHX", 70.0, 4)


def test_arrays_and_files(spark, tmp_path):
    np.savez(tmp_path / "a.npz", pae=np.array([[1.0, np.nan], [2.0, 3.0]]))
    (tmp_path / "b.npz").write_bytes(b"nothing")
    got = sorted((r["path"].rsplit("/", 1)[1], r["name"], r["values"], r["status"]) for r in structures.arrays(spark, str(tmp_path)).collect())
    assert got == [("a.npz", "pae", [1.0, 2.0, 3.0], "ok"), ("b.npz", None, None, "parse_error")]
    assert [r["path"].rsplit("/", 1)[1] for r in structures.files(spark, [str(tmp_path)], [".NPZ"]).collect()] == ["a.npz", "b.npz"]
    (tmp_path / "s").mkdir()
    (tmp_path / "s" / "sheet.tsv").write_text("species\tfasta\na\tx.fa\n")
    assert text_tables.samples(spark, str(tmp_path / "s" / "sheet.tsv")).first()["fasta"].endswith("/s/x.fa")
    (tmp_path / "s" / "map.tsv").write_text("Family\tPfam\nF\tPF1.2\n")
    assert tuple(text_tables.families(spark, str(tmp_path / "s" / "map.tsv")).first()) == ("F", "PF1")
    (tmp_path / "s" / "m.csv").write_text("a;b\n1;x\n")
    assert text_tables.table_file(spark, str(tmp_path / "s" / "m.csv")).columns == ["a", "b"]
    with pytest.raises(ValueError):
        text_tables.sheet(spark, str(tmp_path / "s" / "m.csv"), ("c",))


MODEL = """MODEL 1
REMARK VINA RESULT:    -9.1      0.000      0.000
REMARK SMILES CO
REMARK SMILES IDX 1 1 2 2
ATOM      1  C1  UNL     1       1.000   2.000   3.000  1.00  0.00     0.100 C
ATOM      2  O1  UNL     1       2.000   2.000   3.000  1.00  0.00     0.100 OA
BEGIN_RES HIS A 508
ATOM      3  NE2 HIS A 508       4.000   2.000   3.000  1.00  0.00     0.100 NA
END_RES HIS A 508
ENDMDL
"""


def test_flexible_models(spark):
    rows = spark.createDataFrame([("a", MODEL + MODEL.replace("MODEL 1", "MODEL 2").replace("-9.1", "-8.0")), ("b", MODEL.replace("ENDMDL\n", "")), ("c", MODEL.replace("1 1 2 2", "1 1 2 1"))], "k string, t string")
    got = structures.models(rows, "k", "t")
    a = [r for r in got.orderBy("k", "mode").collect() if r["k"] == "a"]
    assert [(r["mode"], r["score"]) for r in a] == [(1, -9.1), (2, -8.0)] and [x["element"] for x in a[0]["atoms"]] == ["C", "O", "N"] and a[0]["atoms"][2]["part"] == "residue"
    faults = {(r["k"], r["fault"]) for r in structures.model_faults(got, "k", 2, ["NE2"]).collect()}
    assert faults == {("b", "the last model does not end"), ("c", "atom map")}
    assert {r["fault"] for r in structures.model_faults(got.where("k = 'a'"), "k", 3, ["ND1"]).collect()} == {"number of ligand atoms", "missing residue atoms", "atom map"}


def test_superposition_undoes_a_rotation(spark):
    rng = np.random.default_rng(2)
    p = rng.normal(size=(21, 3))
    t = 0.7
    turn = np.array([[math.cos(t), -math.sin(t), 0], [math.sin(t), math.cos(t), 0], [0, 0, 1]])
    mirrored = p * [1, 1, -1]
    rows = spark.createDataFrame([(0, 1, p.ravel().tolist()), (0, 2, (p @ turn + 5).ravel().tolist()), (0, 3, mirrored.ravel().tolist())], "g int, i int, p array<double>")
    got = {(r["left"], r["right"]): r["rmsd"] for r in geometry.pairwise_rmsd(rows, "g", "i", "p").collect()}
    assert got[1, 2] == pytest.approx(0, abs=1e-9) and got[1, 3] > 0.1
    plain = {(r["left"], r["right"]): r["rmsd"] for r in geometry.pairwise_rmsd(rows, "g", "i", "p", align=False).collect()}
    assert plain[1, 2] == pytest.approx(float(np.sqrt(((p - p @ turn - 5) ** 2).sum(axis=1).mean())))


def test_receptor_engines_on_three_models(spark):
    """Flat and null metrics, renormalised weights, gates and ranks of a table small enough to follow by hand."""
    rows = spark.createDataFrame([("a", 1.0, 5.0, None, 0.9), ("b", 2.0, 10.0, None, 0.8), ("c", 4.0, 15.0, None, 0.7)], "model string, molprobity double, clashscore double, rmsf double, tm_score double")
    got = {r["model"]: r for r in selection.scores(rows, selection.RECEPTOR, ["model"]).collect()}
    assert got["a"]["S_validation"] == 1.0 and got["a"]["S_md_stability"] == 0.5 and got["a"]["SelectionScore"] == pytest.approx(100 * (0.45 + 0.30 * 0.5 + 0.25))
    assert got["c"]["validation_gate"] == 0.0 and got["c"]["SelectionScore"] == 0.0 and [got[k]["Rank"] for k in "abc"] == [1, 2, 3]
    assert selection.engine_for(rows) is selection.GENERAL and selection.engine_for(rows.withColumn("pocket_rmsd_A", F.lit(1.0))) is selection.SITE


def test_table_rules(spark):
    rows = spark.createDataFrame([("x/fold_smp_340540_model_0.cif",), ("x/fold_smp_340540_summary_confidences_0.json",), ("confidence_ceh.json",), ("ceh_model_0.cif",), ("_0.pdb",), ("a.b.c",)], "p string")
    assert [r[0] for r in rows.select(tables.group_stem(F.col("p"))).collect()] == ["smp", "smp_340540_summary", "ceh", "ceh", "0", "a_b"]
    assert rows.agg(tables.tool(F.collect_list("p"))).first()[0] == "boltz_or_boltz2"
    names = spark.createDataFrame([("RP4_CE20_5",), ("xCE18:1",), ("other",)], "s string")
    assert [r[0] for r in names.select(tables.system_label(F.col("s"))).collect()] == ["RP4–CE20:5", "CE18:1", "other"]
    assert tables.keywords("L=a, b;M=c;x") == {"L": ["a", "b"], "M": ["c"]} and tables.clean_name(" RMSD (Å).1") == "RMSD (A)"
    assert tables.first_column(rows.toDF("Model"), ["name", "model"]) == "Model"
    assert tables.first_column(rows.toDF("Model"), ["name", "other"]) is None and tables.first_column(rows.toDF("model"), ["Model", "model"]) == "model"
    paths = spark.createDataFrame([("/r/sys/a/x.xvg",), ("/q/sys2/y.xvg",)], "p string")
    assert [r[0] for r in paths.select(tables.system_of(F.col("p"), "/r")).collect()] == ["sys", "sys2"]
    assert [r[0] for r in spark.createDataFrame([("a/95.2/80",), ("x",)], "s string").select(tables.support(F.col("s"))).collect()] == [80.0, None]


def test_readers_of_text(spark):
    def lines(*texts):
        return text_tables.lines(spark.createDataFrame([(f"f{i}", t) for i, t in enumerate(texts)], "path string, value string"))

    log = lines("mode\n   1   -9.5   0.000   1.2\n 2 -8 -1 0\n3 x 1 1\n")
    assert [tuple(r)[1:] for r in text_tables.modes(log).collect()] == [(1, -9.5, 0.0, 1.2)]
    sp = lines("# c\nP1\tSP\t0.1\t0.9\tCS pos: 25-26. Pr: 0.68\nP2 OTHER 1.0 0.0\n")
    assert [tuple(r) for r in text_tables.signal_peptides(sp).collect()] == [("P1", "SP", True, 26), ("P2", "OTHER", False, None)]
    calls = text_tables.membrane_calls(lines("P1, 2, 10-30 and 40..60\nP2 none\n")).collect()
    assert [(r["id"], [tuple(x) for x in r["ranges"]]) for r in calls] == [("P1", [(10, 30), (40, 60)]), ("P2", [])]
    xvg = text_tables.series(lines('@ s0 legend "Rg"\n# c\n0 1.5 2\n1 1.6\nbad row\n')).orderBy("line_no", "column").collect()
    assert [(r["name"], r["value"]) for r in xvg] == [("time", 0.0), ("Rg", 1.5), ("y2", 2.0), ("time", 1.0), ("Rg", 1.6), ("y2", None)]
    cells = spark.createDataFrame([("s", 0, ["A", None, "B", "C", ""]), ("s", 1, ["Frame", "x", "Frame", "x", "Frame"]), ("s", 2, ["1", "2", "3", "4", "9"]), ("s", 3, ["", "5", "6", "7", ""])], "sheet string, row_no int, values array<string>")
    assert sorted(tuple(r)[1:] for r in text_tables.block_rows(cells, ["Frame", "x"]).collect()) == [("A", 2, "1", "2"), ("C", 2, "9", "4")]
    report = "SUMMARY: 12 (3.5%) disfavored conformations\nSUMMARY: 4 (1.25%) outlier conformations\nSUMMARY: 2 severe CA geometry outliers (0.5%)\n9 (40%) helix-like"
    assert tuple(text_tables.backbone_report(spark.createDataFrame([("p", report)], "path string, value string")).first()) == ("p", 3.5, 1.25, 0.5, 40.0)
    assert tuple(text_tables.area_report(spark.createDataFrame([("p", "model.pdb 0.41 -1.5\n7")], "path string, value string")).first()) == ("p", 0.41, -1.5)
    report = text_tables.reported(spark.createDataFrame([("p", "MolProbity score = 1.5\nClashscore: 3\nTM-score= 0.7")], "path string, value string")).first()
    assert (report["molprobity_score"], report["clashscore"], report["tm_score"], report["rmsd"]) == (1.5, 3.0, 0.7, None)


def test_checks_refuse(spark):
    a, b = spark.createDataFrame([(1,), (2,)], "k int"), spark.createDataFrame([(1,), (1,)], "k int")
    for left, right in ((b, a), (a, a.where("k = 1"))):
        with pytest.raises(ValueError):
            checks.one_to_one(left, right, "k")
    assert checks.one_to_one(a, a, "k").count() == 2
    assert spark.range(1).select(checks.pairs(F.array(F.lit(1), F.lit(2), F.lit(3), F.lit(4)))).first()[0][1] == (3, 4)
    with pytest.raises(Exception, match="odd"):
        spark.range(1).select(checks.pairs(F.array(F.lit(1)))).collect()
    atoms = spark.createDataFrame([("p", "CA", 1.0, "C", 1), ("p", "nz", 2.0, "N", 2), ("p", "H", 2.0, "H", 3)], "pose string, name string, x double, element string, serial int").withColumns({"y": F.lit(0.0), "z": F.lit(0.0)})
    assert [c["x"] for c in checks.unique_atoms(atoms, "pose", ["NZ", "CA"]).first()["coordinates"]] == [2.0, 1.0]
    with pytest.raises(Exception, match="missing"):
        checks.unique_atoms(atoms, "pose", ["NZ", "CB"]).collect()
    assert checks.heavy_atoms(atoms, "pose").first()["n"] == 2
    with pytest.raises(ValueError):
        checks.none_empty(a, "k", [1, 9])


def test_sinks(spark, tmp_path):
    rows = spark.createDataFrame([("F", "b", "ACGT" * 3), ("F", "a", "AC")], "family string, id string, s string")
    sinks.write_fasta(rows, str(tmp_path / "f"), "family", "id", "s", 5)
    (part,) = (tmp_path / "f" / "family=F").glob("part-*")
    assert part.read_text() == ">a\nAC\n>b\nACGTA\nCGTAC\nGT\n"
    made = sinks.write_set({"a/b": rows, "none": rows.limit(0)}, str(tmp_path / "set"))
    assert list(made) == ["a/b"] and made["a/b"].endswith("/a_b") and sinks.sheet_name("x" * 40, ["x" * 31]) == "x" * 29 + "_2"
    assert "| a | AC |" in sinks.markdown(rows.select("id", "s"), "T") and sinks.markdown(rows, "T").startswith("## T")
    sinks.manifest(spark, str(tmp_path / "m"), {"s": {"n": 1}})
    assert json.loads(next((tmp_path / "m").glob("part-*")).read_text()) == {"s": {"n": 1}}
    bonds = spark.createDataFrame([("m", 1, 2), ("m", 1, 3)], "k string, first int, second int")
    assert sinks.bond_records(bonds, "k").first()["value"] == "CONECT    1    2    3\nCONECT    2    1\nCONECT    3    1"
    pdb = "ATOM      1  CA AALA A   1      0.0\nATOM      2  HA  ALA A   1\nHETATM    3  C1  LIG A   2\nENDMDL\nATOM      4  CA  ALA A   1"
    kept = structures.cleaned_lines(text_tables.lines(spark.createDataFrame([("p", pdb)], "path string, value string")).withColumnRenamed("value", "line"))
    assert [r["line"][:11] for r in kept.orderBy("line_no").collect()] == ["ATOM      1", "ENDMDL"]


def test_candidates_of_samples(spark, tmp_path):
    (tmp_path / "s.tsv").write_text("species\tfasta\tdomtblout\none\ta.fa\ta.dom\n")
    (tmp_path / "f.tsv").write_text("Family\tPfam\nFABP\tPF00061.1\nCD36\tPF01130\n")
    (tmp_path / "a.fa").write_text(">P1 x\nMKV\n>P2\nMK*\n")
    row = "dom {0} 130 {1} - 140 1e-20 70 0.1 1 1 1e-23 {2} rest\n"
    text = "# c\n" + row.format("PF00061.30", "P1", "1e-20") * 2 + row.format("PF01130.1", "P2", "1e-05") + row.format("PF01130.1", "P3", "1.1e-05") + row.format("PF99999.2", "P1", "1e-30")
    (tmp_path / "a.dom").write_text(text)
    made = pipelines.candidates(spark, str(tmp_path / "s.tsv"), str(tmp_path / "f.tsv"))
    assert sorted(tuple(r) for r in made["candidates"].collect()) == [("one", "CD36", "P2"), ("one", "FABP", "P1")]
    (tmp_path / "a.fa").write_text(">P1 x\nMKV\n")
    with pytest.raises(ValueError, match="1 _key values are missing.*P2"):
        pipelines.candidates(spark, str(tmp_path / "s.tsv"), str(tmp_path / "f.tsv"))


def test_annotation_run(spark):
    records = spark.createDataFrame([("a", "F", "MKKR" + "L" * 25 + "GESAG" + "KDE" * 12), ("b", "F", "KDE" * 20), ("c", "G", "GESAG")], "seq_id string, family string, sequence string")
    signals = spark.createDataFrame([("b", True, 20)], "id string, found boolean, cut int")
    membranes = spark.createDataFrame([("b", [])], "id string, ranges array<struct<start:int,end:int>>")
    made = pipelines.annotation(records, [("gxsxg", "G[A-Z]S[A-Z]G")], signals, membranes)
    got = {r["seq_id"]: r for r in made["features"].collect()}
    assert got["b"]["signal"] and got["b"]["signal_source"] == "given" and got["b"]["passes"] == 0
    assert got["a"]["signal"] and got["a"]["signal_source"] == "heuristic" and got["a"]["passes"] == 1 and got["a"]["hits"] == 1 and got["c"]["motifs"] == "gxsxg"
    assert {r["family"]: r["n"] for r in made["summary"].collect()} == {"F": 2, "G": 1}
    assert {r["family"]: r["status"] for r in made["families"].collect()} == {"F": "skipped_less_than_3_sequences", "G": "skipped_less_than_3_sequences"}


def test_runs_of_models_poses_and_frames(spark, tmp_path):
    (tmp_path / "ceh_model_0.cif").write_text("loop_\n_atom_site.label_asym_id\n_atom_site.label_seq_id\n_atom_site.label_comp_id\n_atom_site.B_iso_or_equiv\nA 1 HIS 90\nA 2 GLY 80\n#\n")
    (tmp_path / "confidence_ceh.json").write_text('{"ptm": 0.8}')
    made = pipelines.evaluation(spark, str(tmp_path))
    assert made["models"].first()["mean_plddt"] == 85.0 and made["chains"].first()["sequence"] == "HG"
    assert {r["model"] for r in made["confidences"].collect()} == {"ceh"}
    (tmp_path / "npc_model_0.cif").write_text("loop_\n_atom_site.label_asym_id\n_atom_site.label_seq_id\n_atom_site.label_comp_id\n_atom_site.B_iso_or_equiv\n" + "".join(f"A {i} {n} {v}\n" for i, n, v in ((1, "HIS", 60), (2, "GLY", 70), (2, "GLY", 90), (3, "HIS", 40), (4, "GLY", 50))) + "#\n")
    (tmp_path / "confidence_npc.json").write_text('{"iptm": 0.5, "pae": [[3, 9]], "deep": {"pair_iptm": [[0.1, "x"], [0.3, 0.4]]}, "ranking_score": 80}')
    np.savez(tmp_path / "npc_model_0.npz", pae_full=np.array([1.0, 3.0]))
    made = pipelines.evaluation(spark, str(tmp_path), ["HG", "GH"])
    hits = sorted((r["model"], r["motif"], r["start"], r["residue_labels"], r["atom_count"], r["mean_plddt"], r["quality_band"]) for r in made["motifs"].collect())
    assert hits == [("ceh", "HG", 1, "H1;G2", 2, 85.0, "confident"), ("npc", "GH", 2, "G2;H3", 3, pytest.approx(200 / 3), "low"), ("npc", "HG", 1, "H1;G2", 3, pytest.approx(220 / 3), "confident"), ("npc", "HG", 3, "H3;G4", 2, 45.0, "very_low")]
    assert sorted(tuple(r)[1:] for r in made["pairs"].collect()) == [("chain_pair_iptm", 1, 1, 0.1), ("chain_pair_iptm", 2, 1, 0.3), ("chain_pair_iptm", 2, 2, 0.4)]
    assert [(r["name"], r["metric_guess"], r["mean"], r["count"]) for r in made["arrays"].collect()] == [("pae_full", "pae", 2.0, 2)]
    models = made["models"].orderBy("place").collect()
    motif = (200 / 3 + 220 / 3 + 45) / 3
    npc = (0.35 * 57.5 + 0.25 * motif + 0.15 * 50 + 0.10 * 80 + 0.10 * 80) / 0.95
    assert [r["model"] for r in models] == ["ceh", "npc"] and models[1]["integrated_quality_score_0_100"] == pytest.approx(npc)
    assert models[0]["integrated_quality_score_0_100"] == pytest.approx((0.35 * 85 + 0.25 * 85 + 0.10 * 80) / 0.70) and len(models[1]["npzs"]) == 1 and models[1]["structure_band"] == "low"
    metrics = spark.createDataFrame([(f"m{i}", float(i), i % 2) for i in range(8)], "model string, clashscore double, global_cluster int")
    chosen = pipelines.choice(metrics, "model", {"global_cluster": "best_per_global_cluster"}, first=1)
    assert {r["model"]: r["RepresentativeClass"] for r in chosen["representatives"].collect()} == {"m0": "best_per_global_cluster;overall_top", "m1": "best_per_global_cluster"}
    poses = spark.createDataFrame([("R", "L", f"p{i}", -5.0 - i, float(i), 0.1 * i) for i in range(6)], ["receptor", "ligand", "prediction", "SMINA Minimized Affinity", "SMINA Minimized RMSD", "DiffDock Confidence"])
    docked = pipelines.docking_run(poses, 2)
    assert docked["top"].count() == 2 and docked["clusters"].agg(F.sum("ClusterSize")).first()[0] == 6
    wide = spark.createDataFrame([(0.0, 1.0, 2.0), (1000.0, 3.0, None)], ["Time (ps)", "A", "B"])
    ran = pipelines.trajectory_run({"RMSD": wide}, 0.5)
    assert {r["System"]: r["RMSD"] for r in ran["comparative"].collect()} == {"A": 3.0}


def test_stream_equals_batch(spark, tmp_path):
    from tessera.streaming import windows

    events = catalogue.table(spark, DATA, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    events.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "in"))
    found = windows.event_statistics(stream)
    run = found.writeStream.format("memory").queryName("found").outputMode("complete").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    run.awaitTermination(120)
    plain = lambda df: sorted((str(r["start"]), r["event_type"], r["n"], round(r["total"], 6)) for r in df.collect())
    assert plain(spark.table("found")) == plain(windows.event_statistics(events))


def test_projection_equals_numpy(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(200, 6)) @ np.diag([5, 3, 1, 0.5, 0.2, 0.1]) + 1e6
    df = spark.createDataFrame([(i, [float(v) for v in row]) for i, row in enumerate(x)] + [(999, None)], "i int, v array<double>").repartition(4)
    got = {r["i"]: (r["pc1"], r["pc2"]) for r in axes.project(df, "i", "v").collect()}
    centred = x - x.mean(axis=0)
    _, _, vt = np.linalg.svd(centred, full_matrices=False)
    want = centred @ vt[:2].T
    assert len(got) == 200
    for k in (0, 1):
        own = np.array([got[i][k] for i in range(200)])
        assert min(np.abs(own - want[:, k]).max(), np.abs(own + want[:, k]).max()) < 1e-6
    assert axes.project(df.limit(0), "i", "v").count() == 0


def test_names_where_there_are_none(spark):
    rows = spark.createDataFrame([(3, "a"), (1, "b")], "i int, s string")
    assert {r["i"]: r["model"] for r in tables.named(rows, "model", ["i"]).collect()} == {1: "model_1", 3: "model_2"}
    assert tables.named(rows, "s", ["i"]).columns == ["i", "s"]


def test_tables_merge_with_and_without_a_key(spark):
    a, b = spark.createDataFrame([(1, "x", None), (2, None, 5)], "m int, s string, n int"), spark.createDataFrame([(2, "y", 7), (3, "z", 8)], "m int, s string, k int")
    assert sorted(tuple(r) for r in relational.merged(a, b, "m").select("m", "s", "n", "k").collect()) == sorted([(1, "x", None, None), (2, "y", 5, 7), (3, "z", None, 8)])
    rows = relational.merged(a, b.drop("m"), "m").select("m", "s", "n", "k").collect()
    assert {tuple(r) for r in rows} == {(1, "x", None, None), (2, None, 5, None), (None, "y", None, 7), (None, "z", None, 8)}


def test_topologies_of_every_form(spark):
    text = "# gff\nP1\tx\tTMhelix\t5\t9\nP1\tx\tTMhelix\t10\t12\nP1 signal 1 4\nP2\tx\tinside\t1\t3\n```\n>P3 extra | SP+TM\nMKKLLAA\n\nSSSMMMO\n```\n>P1 | TM\nMKKLLAAMKKLLAAMKKLLAA\nIIIIIIIIIIIIIIIMMMOOO\n>P4 | SP\nMKKLL\nIIIII\n>P5 | TM\nMKKLL\nMMxMM\n"
    rows = spark.createDataFrame([("p", i, v) for i, v in enumerate(text.split("\n"))], "path string, line_no int, value string")
    got = {r["id"]: (r["label"], [tuple(x) for x in r["ranges"]], r["has_signal"], r["signal_start"], r["signal_end"], r["source"][-5:]) for r in text_tables.topology_calls(rows).collect()}
    assert got == {"P1": ("TM", [(5, 12), (16, 18)], True, 1, 4, "3line"), "P3": ("SP+TM", [(4, 6)], True, 1, 3, "3line"), "P4": ("SP", [], True, None, None, "3line")}


def test_harvest_keeps_each_text_by_itself(spark, tmp_path):
    """Two events of one id are two rows a metric, as the SQL has it."""
    spark.sql("SELECT 5L AS event_id, v AS value, 7L AS user_id FROM VALUES (0.25D), (0.75D) AS t(v)").write.parquet(str(tmp_path / "events.parquet"))
    got = sorted((r["metric"], r["mean"], r["median"], r["count"]) for r in catalogue.QUERIES["str_json_harvest"](spark, str(tmp_path)).where("count > 0").collect())
    one = lambda v: [("iptm", round((v + v / 2 + v / 4) / 3, 6), v / 2, 3), ("ptm", v, v, 1), ("ranking_score", 7.0, 7.0, 1)]
    assert got == sorted(one(0.25) + one(0.75))
    stats = structures.row_statistics(F.col("v"))
    rows = spark.createDataFrame([([4.0, 1.0, 2.0, 9.0],), ([3.0],), ([],), (None,)], "v array<double>").select(*[c.alias(n) for n, c in stats.items()]).collect()
    assert [tuple(r) for r in rows] == [(4.0, 3.0, 1.0, 9.0, 4), (3.0, 3.0, 3.0, 3.0, 1), (None, None, None, None, 0), (None, None, None, None, 0)]


def test_bins_take_no_scales_of_all_poses(spark, monkeypatch):
    """Bins and their clusters do not use the score, so the passes over all poses for its scales do not run."""
    monkeypatch.setattr(docking, "rank_poses", lambda *_: pytest.fail("scored"))
    for name in ("dock_cluster_summary", "dock_relabelled"):
        assert catalogue.QUERIES[name](spark, DATA).columns
