"""Writers: delimited tables, table sets, FASTA, reports, manifests, coordinate files, lists of copies."""

from __future__ import annotations

import json
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import order


def write_table(df: DataFrame, path: str, separator: str = "\t", one_file: bool = False) -> None:
    """A directory of delimited files with headers; one file only where a reader needs it and the table is small."""
    (df.coalesce(1) if one_file else df).write.mode("overwrite").csv(path, sep=separator, header=True)


def union_columns(*parts: DataFrame) -> DataFrame:
    """All rows by column name, columns in the order in which they first occur, missing ones null."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out


def fixed(df: DataFrame, digits: int = 4) -> DataFrame:
    """Fractional numbers as text of so many decimals; null and what is not finite as empty text."""

    def shown(c: str) -> Column:
        x = F.col(f"`{c}`").cast("double")
        plain = F.format_string(f"%.{digits}f", x)
        return F.when(x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")), F.lit("")).otherwise(plain)

    return df.withColumns({c: shown(c) for c, kind in df.dtypes if kind in ("double", "float") or kind.startswith("decimal")})


def sheet_name(name: str, taken: Sequence[str] = ()) -> str:
    """At most 31 characters without those that sheets may not have; a number makes it unique."""
    plain = "".join("_" if c in "[]:*?/\\" else c for c in name)[:31] or "sheet"
    out, n = plain, 1
    while out.lower() in [t.lower() for t in taken]:
        n += 1
        out = f"{plain[: 31 - len(str(n)) - 1]}_{n}"
    return out


def write_set(tables: Mapping[str, DataFrame], path: str) -> dict[str, str]:
    """Each table that has rows as Parquet below path, under its sheet name; returns the paths by name."""
    out: dict[str, str] = {}
    for name, df in tables.items():
        if df.isEmpty():
            continue
        plain = sheet_name(name, [p.rsplit("/", 1)[1] for p in out.values()])
        out[name] = f"{path.rstrip('/')}/{plain}"
        df.write.mode("overwrite").parquet(out[name])
    return out


def wrapped(sequence: Column, width: int = 70) -> Column:
    """A sequence in lines of `width` characters."""
    return F.rtrim(F.regexp_replace(sequence, f"(.{{{width}}})", "$1\n"))


def fasta_records(df: DataFrame, family: str, seq_id: str, sequence: str, width: int = 0) -> DataFrame:
    """(family, seq_id, value): distinct records as FASTA text."""
    body = wrapped(F.col(sequence), width) if width else F.col(sequence)
    return df.select(family, seq_id, sequence).distinct().select(family, seq_id, F.concat(F.lit(">"), F.col(seq_id), F.lit("\n"), body).alias("value"))


def write_fasta(df: DataFrame, path: str, family: str, seq_id: str, sequence: str, width: int = 70) -> None:
    """One directory per family, its records by id; a family is one task's, as its file is one."""
    rows = fasta_records(df, family, seq_id, sequence, width)
    rows.repartition(family).sortWithinPartitions(family, seq_id).select(family, "value").write.mode("overwrite").partitionBy(family).text(path)


def markdown(df: DataFrame, title: str, rows: int = 20, digits: int = 3) -> str:
    """A report section: title and the first rows as a table."""
    found = fixed(df, digits).limit(rows).collect()
    head = [f"## {title}", "", "| " + " | ".join(df.columns) + " |", "|" + "---|" * len(df.columns)]
    return "\n".join(head + ["| " + " | ".join("" if v is None else str(v).replace("|", "\\|") for v in r) + " |" for r in found]) + "\n"


def manifest(spark: SparkSession, path: str, steps: Mapping[str, Mapping[str, object]]) -> None:
    """One JSON file of what each step made."""
    spark.createDataFrame([(json.dumps(dict(steps), sort_keys=True, default=str),)], "value string").coalesce(1).write.mode("overwrite").text(path)


def complex_lines(receptor: DataFrame, ligand: DataFrame, key: str) -> DataFrame:
    """(key, value): the text of each receptor with its ligand, whose atoms are HETATM, between TER and END.

    Both: key, line_no, line. A structure's lines meet in one row, as its file is one.
    """
    atoms = lambda df, part: df.where(F.col("line").rlike("^(ATOM  |HETATM)")).select(key, F.lit(part).alias("part"), "line_no", "line")
    named = atoms(ligand, 1).withColumn("line", F.regexp_replace("line", "^ATOM  ", "HETATM"))
    lines = atoms(receptor, 0).unionByName(named)
    ordered = F.array_sort(F.collect_list(F.struct("part", "line_no", "line")))
    part = lambda p: F.transform(F.filter("all", lambda x: x["part"] == p), lambda x: x["line"])
    return lines.groupBy(key).agg(ordered.alias("all")).select(key, F.array_join(F.concat(part(0), F.array(F.lit("TER")), part(1), F.array(F.lit("END"))), "\n").alias("value"))


def merged_residue(rigid: DataFrame, flexible: DataFrame, keys: Sequence[str], name: str = "name") -> DataFrame:
    """Atoms of both, by upper-case name within the keys; where both have one the flexible one stays."""
    both = rigid.withColumn("_from", F.lit(1)).unionByName(flexible.withColumn("_from", F.lit(0)), allowMissingColumns=True)
    rest = [c for c in both.columns if c not in keys and c != "_from"]
    # A struct is aggregated by sorting, so a task's memory is that of its share of the rows.
    named = order.spread(both.withColumn("_n", F.upper(F.trim(name))), [*keys, "_n"])
    return named.groupBy(*keys, "_n").agg(F.min_by(F.struct(*rest), "_from").alias("_x")).select(*keys, "_x.*")


def split_receptor(atoms: DataFrame, key: str, chain: str, resid: int, order: str = "line_no") -> tuple[DataFrame, DataFrame, DataFrame]:
    """(atoms of the rest, atoms of the residue, per key the place of the first of them)."""
    own = (F.col("chain") == chain) & (F.col("resid") == resid)
    residue = atoms.where(own)
    return atoms.where(~F.coalesce(own, F.lit(False))), residue, residue.groupBy(key).agg(F.min(order).alias("at"))


def bond_records(pairs: DataFrame, key: str) -> DataFrame:
    """(key, value): CONECT lines of each atom's partners (first, second), both ways, in order."""
    both = pairs.select(key, "first", "second").unionByName(pairs.select(key, F.col("second").alias("first"), F.col("first").alias("second"))).distinct()
    partners = both.groupBy(key, "first").agg(F.array_sort(F.collect_set("second")).alias("p"))
    line = F.concat(F.format_string("CONECT%5d", F.col("first")), F.array_join(F.transform("p", lambda x: F.lpad(x.cast("string"), 5, " ")), ""))
    return partners.select(key, "first", line.alias("line")).groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("first", "line"))), lambda x: x["line"]), "\n").alias("value"))


def copies(poses: DataFrame, target: str, receptor: str, ligand: str, rank: str, path: str) -> DataFrame:
    """(source, destination) of selected poses: target/receptor__ligand__rankNN__file."""
    safe = lambda c: F.regexp_replace(F.regexp_replace(F.col(c), "[^A-Za-z0-9._-]+", "_"), "^_+|_+$", "")
    name = F.concat_ws("__", safe(receptor), safe(ligand), F.format_string("rank%02d", F.col(rank)), F.substring_index(path, "/", -1))
    return poses.select(F.col(path).alias("source"), F.concat(F.lit(target.rstrip("/") + "/"), name).alias("destination"))
