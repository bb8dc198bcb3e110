"""Structure files: confidence JSON, arrays, atom loops, fixed-column atoms, flexible docking models.

Files are read whole by Spark, one row each, and taken apart where they are; what cannot be read
gives a row that says so, or none, never a failed job, unless a reader is asked to be strict.
"""

from __future__ import annotations

import functools
import io
import json
import math
import shlex
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import sequences

# Names under which tools write a metric.
METRICS = {
    "pae": ("pae", "pae_matrix", "predicted_aligned_error", "predictedalignederror", "chain_pair_pae_min", "pair_pae_min"),
    "pde": ("pde", "pde_matrix", "predicted_distance_error", "pair_pde", "predicted_distance_errors"),
    "plddt": ("plddt", "atom_plddt", "atom_plddts", "per_atom_plddt", "per_residue_plddt", "local_confidence", "plddts"),
    "contact_prob": ("contact_prob", "contact_probability", "contact_probs", "predicted_contacts", "contact_matrix", "contact_probabilities"),
    "ptm": ("ptm", "ptm_score", "chain_ptm", "aggregate_ptm"),
    "iptm": ("iptm", "iptm_score", "chain_iptm", "interface_ptm", "chain_pair_iptm"),
    "ranking_score": ("ranking_score", "ranking_confidence", "confidence_score", "score"),
    "fraction_disordered": ("fraction_disordered", "disorder", "disordered_fraction"),
    "has_clash": ("has_clash", "clash", "has_clashes"),
    "num_recycles": ("num_recycles", "recycles"),
    "affinity_pred_value": ("affinity_pred_value", "affinity", "predicted_affinity"),
    "affinity_probability_binary": ("affinity_probability_binary", "binder_probability", "binding_probability", "affinity_prob", "probability_binary"),
}


def texts(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """(path, text) of every file below path whose name fits the pattern."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(path)
    return files.select("path", F.col("content").cast("string").alias("text"))


def files(spark: SparkSession, paths: Sequence[str], suffixes: Sequence[str]) -> DataFrame:
    """(path, length) of files of the suffixes below the paths, each once, in order."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(list(paths)).select("path", "length")
    return found.where(F.lower(F.concat(F.lit("."), F.substring_index("path", ".", -1))).isin(*[s.lower() for s in suffixes])).distinct().orderBy("path")


def numbers(value: object) -> list[float]:
    """The finite numbers of nested lists; numeric strings and booleans count, objects inside do not."""
    out: list[float] = []
    waiting = [value]
    while waiting:
        x = waiting.pop()
        if isinstance(x, (list, tuple)):
            waiting.extend(reversed(x))
        elif not isinstance(x, dict) and x is not None:
            try:
                number = float(x)
            except (TypeError, ValueError):
                continue
            if math.isfinite(number):
                out.append(number)
    return out


METRIC_OF = {n: m for m, all_ in METRICS.items() for n in all_}


def harvest(data: object) -> dict[str, list[float]]:
    """For each metric the numbers under any of its names, at any depth, also inside a found value."""
    out: dict[str, list[float]] = {m: [] for m in METRICS}
    waiting = [data]
    while waiting:
        x = waiting.pop()
        if isinstance(x, dict):
            for k, v in x.items():
                m = METRIC_OF.get(str(k).lower())
                if m:
                    out[m].extend(numbers(v))
            waiting.extend(reversed(x.values()))
        elif isinstance(x, list):
            waiting.extend(reversed(x))
    return out


def json_values(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, metric, values) of each text's metrics, those without a number too; texts that are no JSON give none."""
    schema = dict(df.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, lists = [], []
            for i, t in enumerate(batch.column(1).to_pylist()):
                try:
                    lists.extend(harvest(json.loads(t)).values())
                except (TypeError, ValueError):
                    continue
                at.append(i)
            # Every text has all metrics, in one order.
            keys = batch.column(0).take(pa.array([i for i in at for _ in METRICS], pa.int64()))
            yield pa.RecordBatch.from_arrays([keys, pa.array([*METRICS] * len(at), pa.string()), pa.array(lists, pa.list_(pa.float64()))], [key, "metric", "values"])

    return df.select(key, text).mapInArrow(run, f"{key} {schema[key]}, metric string, values array<double>")


# Names of matrices over pairs of chains.
PAIRWISE = {"chain_pair_iptm": ("chain_pair_iptm", "pair_iptm"), "chain_pair_pae_min": ("chain_pair_pae_min", "pair_pae_min"), "chain_pair_pde": ("chain_pair_pde", "pair_pde")}


def matrices(data: object) -> Iterator[tuple[str, int, int, float]]:
    """(metric, row, column, value), counted from 1, of every matrix under one of the names, at any depth."""
    names = {n: m for m, all_ in PAIRWISE.items() for n in all_}
    waiting = [data]
    while waiting:
        x = waiting.pop()
        if isinstance(x, dict):
            for k, v in x.items():
                m = names.get(str(k).lower())
                if m and isinstance(v, list):
                    for i, row in enumerate(v, 1):
                        for j, value in enumerate(row if isinstance(row, list) else (), 1):
                            yield from ((m, i, j, n) for n in numbers([value] if not isinstance(value, list) else []))
            waiting.extend(reversed(x.values()))
        elif isinstance(x, list):
            waiting.extend(reversed(x))


def chain_pairs(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, metric, row_chain_index, col_chain_index, value) of each text's matrices; texts that are no JSON give none."""
    schema = dict(df.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for k, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                try:
                    rows += [(k, *found) for found in matrices(json.loads(t))]
                except (TypeError, ValueError):
                    continue
            kinds = (batch.schema.field(0).type, pa.string(), pa.int32(), pa.int32(), pa.float64())
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)], [key, "metric", "row_chain_index", "col_chain_index", "value"])

    return df.select(key, text).mapInArrow(run, f"{key} {schema[key]}, metric string, row_chain_index int, col_chain_index int, value double")


def value_statistics(values: DataFrame, keys: Sequence[str]) -> DataFrame:
    """mean, median, min, max and number of the gathered values; null but 0 without any."""
    flat = values.select(*keys, F.explode_outer("values").alias("v"))
    return flat.groupBy(*keys).agg(F.avg("v").alias("mean"), F.median("v").alias("median"), F.min("v").alias("min"), F.max("v").alias("max"), F.count("v").alias("count"))


def row_statistics(values: Column) -> dict[str, Column]:
    """The same of one row's own array of numbers, where it is."""
    ordered, n = F.array_sort(values), F.size(values)
    at = lambda i: F.get(ordered, i.cast("int"))
    middle = at(F.floor((n - 1) / 2)) / 2 + at(F.floor(n / 2)) / 2
    total = F.aggregate(values, F.lit(0.0), lambda s, v: s + v)
    return {"mean": F.when(n > 0, total / n), "median": F.when(n > 0, middle), "min": F.array_min(values), "max": F.array_max(values), "count": F.greatest(n, F.lit(0))}


def arrays(spark: SparkSession, path: str) -> DataFrame:
    """(path, name, values, status) of the arrays in .npz files; status is ok or parse_error."""
    source = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.npz").load(path).select("path", "content")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        for batch in batches:
            rows = []
            for p, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                try:
                    with np.load(io.BytesIO(content), allow_pickle=False) as held:
                        for name in held.files:
                            try:
                                rows.append((p, name, numbers(held[name].ravel().tolist()), "ok"))
                            except ValueError:
                                rows.append((p, name, None, "parse_error"))
                except Exception:  # noqa: BLE001  any unreadable archive is one row
                    rows.append((p, None, None, "parse_error"))
            kinds = (pa.string(), pa.string(), pa.list_(pa.float64()), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)], ["path", "name", "values", "status"])

    return source.mapInArrow(run, "path string, name string, values array<double>, status string")


def loop_rows(text: str, prefix: str) -> Iterator[dict[str, str]]:
    """The rows of every loop that has a column of the prefix, as column to value; short rows are left out."""
    columns: list[str] | None = None
    begun = False
    for raw in (text or "").splitlines():
        line = raw.strip()
        if line == "loop_":
            columns, begun = [], False
        elif columns is not None and not begun and line.startswith("_"):
            columns.append(line)
        elif not line or line.startswith(("#", "data_", "_")):
            columns = None
        elif columns and any(c.startswith(prefix) for c in columns):
            begun = True
            try:
                parts = shlex.split(line, posix=True)
            except ValueError:
                parts = line.split()
            if len(parts) >= len(columns):
                yield dict(zip(columns, parts))


def loop_atoms(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, chain, resid, resname, value) of the atoms of mmCIF texts; author columns before labels, values that are no number left out."""
    schema = dict(df.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for k, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                for r in loop_rows(t, "_atom_site."):
                    chain, resid, comp = (r.get(f"_atom_site.auth_{c}", r.get(f"_atom_site.label_{c}")) for c in ("asym_id", "seq_id", "comp_id"))
                    found = numbers(r.get("_atom_site.B_iso_or_equiv"))
                    if None not in (chain, resid, comp) and found:
                        rows.append((k, chain, resid, comp.upper(), found[0]))
            kinds = (batch.schema.field(0).type, pa.string(), pa.string(), pa.string(), pa.float64())
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)], [key, "chain", "resid", "resname", "value"])

    return df.select(key, text).mapInArrow(run, f"{key} {schema[key]}, chain string, resid string, resname string, value double")


def residues(atoms: DataFrame, key: str) -> DataFrame:
    """Per residue: mean, median and number of its atoms' values, its one-letter name and its place in the chain.

    Numbered residues come first, by number; the others by their text.
    """
    letters = F.create_map(*[F.lit(x) for pair in sequences.THREE_TO_ONE.items() for x in pair])
    number = F.expr("try_cast(resid as int)")
    found = atoms.groupBy(key, "chain", "resid", "resname").agg(F.avg("value").alias("mean_plddt"), F.median("value").alias("median_plddt"), F.count("*").alias("atom_count"))
    return found.withColumns({"order": F.struct(number.isNull().alias("text"), number.alias("number"), F.col("resid").alias("raw")), "residue_name_1": F.coalesce(F.try_element_at(letters, F.col("resname")), F.lit("X"))})


def chains(residues_: DataFrame, key: str) -> DataFrame:
    """Per chain: its sequence in residue order, statistics of residue means, atoms."""
    return residues_.groupBy(key, "chain").agg(
        sequences.chain_sequence(F.col("order"), F.col("resname")).alias("sequence"), F.avg("mean_plddt").alias("mean_plddt"), F.median("mean_plddt").alias("median_plddt"),
        F.min("mean_plddt").alias("min_plddt"), F.max("mean_plddt").alias("max_plddt"), F.count("*").alias("residues"), F.sum("atom_count").alias("atom_count"),
    )


def cleaned_lines(lines: DataFrame, key: str = "path", number: str = "line_no", text: str = "line") -> DataFrame:
    """Lines of coordinate files without later models, hydrogens, HETATM and alternate places but the first (blank, A or 1)."""
    from pyspark.sql import Window as W

    before = F.coalesce(F.sum(F.col(text).startswith("ENDMDL").cast("int")).over(W.partitionBy(key).orderBy(number).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    rows = lines.withColumn("_models", before).where("_models = 0").drop("_models")
    atom = F.col(text).startswith("ATOM  ")
    place, element = F.substring(text, 17, 1), F.trim(F.substring(text, 77, 2))
    name = F.regexp_replace(F.trim(F.substring(text, 13, 4)), "^[0-9]+", "")
    hydrogen = F.when(element != "", element == "H").otherwise(name.startswith("H"))
    keep = atom & place.isin(" ", "", "A", "1") & ~hydrogen
    return rows.where(keep | F.col(text).startswith("TER") | F.col(text).startswith("END"))


def element(name: str, kind: str = "") -> str:
    """An atom's element from its docking type, else from its name."""
    letters = "".join(c for c in kind if c.isalpha()).upper()
    for start, found in (("CL", "Cl"), ("BR", "Br"), ("OA", "O"), ("NA", "N"), ("SA", "S"), ("HD", "H")):
        if letters.startswith(start):
            return found
    if letters == "A":
        return "C"
    if letters and letters[0] in "BCFHINOPS":
        return letters[0]
    plain = "".join(c for c in name if c.isalpha()).upper()
    return {"CL": "Cl", "BR": "Br"}.get(plain[:2], plain[:1])


def model_rows(text: str, residue: tuple[str, int] = ("HIS", 508), ligand: str = "UNL") -> list[dict]:
    """The models of a flexible docking result; a fault raises ValueError with its line.

    A model has mode, score, rmsd_lb, rmsd_ub, smiles, pairs (of atom numbers), and atoms, each with
    its part: ligand or residue.
    """
    found: list[dict] = []
    model: dict | None = None
    inside = False

    def number(parts: Sequence[str], at: int, kind):
        try:
            return kind(parts[at])
        except (IndexError, ValueError):
            raise ValueError(f"line {line_no}: malformed {raw.rstrip()!r}") from None

    for line_no, raw in enumerate((text or "").splitlines(), 1):
        parts = raw.split()
        head = parts[0] if parts else ""
        if head == "MODEL":
            if model is not None:
                raise ValueError(f"line {line_no}: a model begins before the last one ends")
            model, inside = {"mode": number(parts, 1, int), "score": None, "rmsd_lb": None, "rmsd_ub": None, "smiles": None, "pairs": [], "atoms": []}, False
        elif model is None:
            continue
        elif parts[:3] == ["REMARK", "VINA", "RESULT:"]:
            model |= {k: number(parts, i, float) for i, k in enumerate(("score", "rmsd_lb", "rmsd_ub"), 3)}
        elif parts[:3] == ["REMARK", "SMILES", "IDX"]:
            values = [number(parts, i, int) for i in range(3, len(parts))]
            if len(values) % 2:
                raise ValueError(f"line {line_no}: an odd number of atom numbers")
            model["pairs"] += list(zip(values[::2], values[1::2]))
        elif parts[:2] == ["REMARK", "SMILES"] and len(parts) > 2:
            model["smiles"] = parts[2]
        elif head == "BEGIN_RES":
            if (parts[1:2] or [""])[0] != residue[0] or number(parts, 3, int) != residue[1]:
                raise ValueError(f"line {line_no}: another flexible residue than {residue[0]} {residue[1]}")
            inside = True
        elif head == "END_RES":
            inside = False
        elif raw.startswith(("ATOM  ", "HETATM")):
            # The columns of the format.
            cut = [raw[6:11], raw[12:16].strip(), raw[17:20].strip(), raw[21:22].strip(), raw[22:26], raw[30:38], raw[38:46], raw[46:54]]
            atom = {"serial": number(cut, 0, int), "name": cut[1], "resname": cut[2], "chain": cut[3], "resid": number(cut, 4, int)}
            atom |= {c: number(cut, i, float) for i, c in enumerate("xyz", 5)} | {"element": element(cut[1], parts[-1]), "part": "residue" if inside else "ligand"}
            if inside or cut[2] == ligand:
                model["atoms"].append(atom)
        elif head == "ENDMDL":
            lacking = [k for k in ("score", "rmsd_lb", "rmsd_ub", "smiles") if model[k] is None]
            if lacking:
                raise ValueError(f"line {line_no}: model {model['mode']} lacks {', '.join(lacking)}")
            found.append(model)
            model, inside = None, False
    if model is not None:
        raise ValueError("the last model does not end")
    return found


MODEL_SCHEMA = "mode int, score double, rmsd_lb double, rmsd_ub double, smiles string, pairs array<struct<first:int,second:int>>, atoms array<struct<serial:int,name:string,resname:string,chain:string,resid:int,x:double,y:double,z:double,element:string,part:string>>"


def models(df: DataFrame, key: str, text: str, **parts) -> DataFrame:
    """One row per model of each text (key, mode, scores, smiles, pairs, atoms, fault); a faulty text is one row with the fault."""
    import pandas as pd

    kind = dict(df.dtypes)[key]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = ["mode", "score", "rmsd_lb", "rmsd_ub", "smiles", "pairs", "atoms"]
        for frame in frames:
            rows = []
            for k, t in zip(frame[key], frame[text]):
                try:
                    rows += [(k, *(m[n] if n != "pairs" else [{"first": a, "second": b} for a, b in m["pairs"]] for n in names), None) for m in model_rows(t, **parts)]
                except ValueError as fault:
                    rows.append((k, *[None] * len(names), str(fault)))
            yield pd.DataFrame(rows, columns=[key, *names, "fault"])

    return df.select(key, text).mapInPandas(run, f"{key} {kind}, {MODEL_SCHEMA}, fault string")


#: What begins a model of a file; the text reader cuts files there, wherever its byte ranges fall.
MODEL_MARK = "\nMODEL "


def model_texts(spark: SparkSession, *paths: str) -> DataFrame:
    """(path, text): one row per model of docking results, large files being read by several tasks.

    What stands before a file's first model is left out.
    """
    rows = spark.read.text(list(paths), lineSep=MODEL_MARK).select(F.col("_metadata.file_path").alias("path"), "value")
    first, number = F.col("value").rlike("^MODEL\\s"), F.col("value").rlike(r"^\s*\d+\s*([\r\n]|$)")
    whole = F.when(first, F.col("value")).when(number, F.concat(F.lit(MODEL_MARK[1:]), "value"))
    return rows.select("path", whole.alias("text")).where("text is not null")


def model_files(spark: SparkSession, *paths: str, **parts) -> DataFrame:
    """One row per model of the files (path, mode, scores, smiles, pairs, atoms, fault), like models(); a fault is that of one model."""
    return models(model_texts(spark, *paths), "path", "text", **parts)


def model_scores(spark: SparkSession, *paths: str) -> DataFrame:
    """(path, mode, score, rmsd_lb, rmsd_ub) of each model, without reading its atoms."""
    told = r"REMARK\s+VINA\s+RESULT:\s+(\S+)\s+(\S+)\s+(\S+)"
    rows = model_texts(spark, *paths)
    return rows.select("path", F.regexp_extract("text", r"^MODEL\s+(\d+)", 1).try_cast("int").alias("mode"), *[F.regexp_extract("text", told, i).try_cast("double").alias(c) for i, c in enumerate(("score", "rmsd_lb", "rmsd_ub"), 1)])


def model_faults(models_: DataFrame, key: str, ligand_atoms: int, needed: Sequence[str]) -> DataFrame:
    """(key, mode, fault) of models that lack atoms, repeat serials or do not map atoms 1..n, or that differ from the file's first."""
    ligand = F.filter("atoms", lambda a: a["part"] == "ligand")
    names = F.transform(F.filter("atoms", lambda a: a["part"] == "residue"), lambda a: F.upper(a["name"]))
    all_ = F.sequence(F.lit(1), F.lit(ligand_atoms))
    permutes = lambda f: F.array_sort(F.transform("pairs", lambda p: p[f])) == all_
    rules = {
        "number of ligand atoms": F.size(ligand) == ligand_atoms,
        "repeated serials": F.size(F.array_distinct(F.transform(ligand, lambda a: a["serial"]))) == F.size(ligand),
        "missing residue atoms": F.size(F.array_except(F.array(*[F.lit(n.upper()) for n in needed]), names)) == 0,
        "atom map": permutes("first") & permutes("second"),
    }
    first = models_.where("fault is null").groupBy(F.col(key).alias("_k")).agg(F.min_by(F.struct("smiles", "pairs"), "mode").alias("_first"), F.count("*").alias("_n"), F.countDistinct("mode").alias("_d"))
    rows = models_.join(first, F.col(key) == F.col("_k"), "left")
    rules |= {"differs from the first model": (F.col("smiles") == F.col("_first.smiles")) & (F.col("pairs") == F.col("_first.pairs")), "repeated mode": F.col("_n") == F.col("_d")}
    broken = F.concat(F.array_compact(F.array(F.col("fault"))), F.when(F.col("fault").isNull(), F.array_compact(F.array(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(n)) for n, ok in rules.items()]))).otherwise(F.array().cast("array<string>")))
    return rows.select(key, "mode", F.explode(broken).alias("fault"))


# Kinds of files by their ending.
KINDS = {"structures": (".cif", ".mmcif", ".pdb"), "jsons": (".json",), "npzs": (".npz",)}


def grouped_files(files: DataFrame, key: Column, path: str = "path") -> DataFrame:
    """(key, structures, jsons, npzs): the sorted paths of each kind per key; other endings are left out."""
    low = F.lower(F.col(path))
    is_kind = {k: functools.reduce(lambda a, b: a | b, (low.endswith(e) for e in ends)) for k, ends in KINDS.items()}
    kept = files.where(functools.reduce(lambda a, b: a | b, is_kind.values()))
    return kept.groupBy(key.alias("key")).agg(*[F.array_sort(F.collect_list(F.when(c, F.col(path)))).alias(k) for k, c in is_kind.items()])
