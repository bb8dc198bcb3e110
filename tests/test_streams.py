"""Streams against batches of the same rows, late ones among them; large docking files by several tasks."""

import datetime
import random

from pyspark.sql import functions as F

from tessera.sources import structures
from tessera.streaming import windows

BASE = datetime.datetime(2024, 1, 1)


def run(stream, name, mode):
    query = stream.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    query.awaitTermination(120)
    assert not query.isActive


def test_runs_of_a_stream_equal_those_of_a_batch(spark, tmp_path):
    rng = random.Random(6)
    rows = [(i, i % 4, BASE + datetime.timedelta(seconds=20 * i), rng.choice(["view", "view", "click"])) for i in range(400)]
    end = [(1000 + u, u, BASE + datetime.timedelta(days=1), "end") for u in range(4)]
    last = [(2000, 9, BASE + datetime.timedelta(days=2), "later")]
    shuffled = [r for at in range(0, 400, 20) for r in rng.sample(rows[at : at + 20], 20)]  # late by up to 400 seconds
    schema = "event_id long, user_id long, ts timestamp, event_type string"
    for n, part in enumerate((shuffled[:150], shuffled[150:300], shuffled[300:], end, last)):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    run(windows.event_runs(stream, "10 minutes"), "runs", "append")
    got = sorted((r["user_id"], r["start"], r["end"], r["event_type"], r["n"]) for r in spark.table("runs").collect())
    want = []
    for u in range(4):
        own = [r for r in rows if r[1] == u]
        at = 0
        while at < len(own):
            to = at
            while to + 1 < len(own) and own[to + 1][3] == own[at][3]:
                to += 1
            want.append((u, own[at][2], own[to][2], own[at][3], to - at + 1))
            at = to + 1
    assert got == sorted(want)


def test_candidate_counts_of_a_stream(spark, tmp_path):
    rng = random.Random(2)
    rows = [(BASE + datetime.timedelta(seconds=i), rng.choice("ab"), rng.choice(["PF1", "PF2", "PF9"]), f"p{rng.randrange(30)}", rng.choice([1e-9, 1e-2])) for i in range(300)]
    schema = "ts timestamp, species string, accession string, protein_id string, evalue double"
    for at in (0, 100, 200):
        spark.createDataFrame(rows[at : at + 100], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    families = spark.createDataFrame([("PF1", "X"), ("PF2", "X"), ("PF2", "Y")], "accession string, family string")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    run(windows.candidate_counts(stream, families), "counts", "complete")
    batch = windows.candidate_counts(spark.createDataFrame(rows, schema), families)
    assert {tuple(r) for r in spark.table("counts").collect()} == {tuple(r) for r in batch.collect()} and batch.count() == 4


def model(i):
    atom = f"HETATM{1:5d}  C1  UNL A{1:4d}    {i:8.3f}{1.0:8.3f}{2.0:8.3f}  1.00  0.00     0.000 C \n"
    return f"MODEL {i}\nREMARK VINA RESULT:    {-i / 10:.1f}      {i}.000      0.500\nREMARK SMILES CC\nREMARK SMILES IDX 1 1\n{atom}ENDMDL\n"


def test_models_of_large_files(spark, tmp_path):
    (tmp_path / "a.pdbqt").write_text("".join(model(i) for i in range(1, 401)))
    (tmp_path / "b.pdbqt").write_text("REMARK made by hand\n" + model(1) + model(2).replace("VINA RESULT", "OTHER") + model(3)[:-8])
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "8k")
    try:
        found = structures.model_files(spark, str(tmp_path))
        assert found.rdd.getNumPartitions() > 3
        rows = {(r["path"][-7], r["mode"]): r for r in found.where("fault is null").collect()}
        assert set(rows) == {("a", i) for i in range(1, 401)} | {("b", 1)}
        assert rows["a", 37]["score"] == -3.7 and rows["a", 37]["atoms"][0]["x"] == 37.0
        assert sorted(r["fault"].split(": ")[-1] for r in found.where("fault is not null").collect()) == ["model 2 lacks score, rmsd_lb, rmsd_ub", "the last model does not end"]
        scores = structures.model_scores(spark, str(tmp_path)).where(F.col("path").endswith("a.pdbqt"))
        assert {r["mode"]: r["score"] for r in scores.collect()} == {i: -i / 10 for i in range(1, 401)}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
