"""Readers of the text formats that upstream tools write, as lazy DataFrames.

Each takes a DataFrame of lines (path, line_no, value) or of whole files (path, value); `lines` and
`files` make them from paths. Malformed lines raise where strict, else are skipped.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import scan, sequences


def files(spark: SparkSession, *paths: str) -> DataFrame:
    """(path, value) of whole text files."""
    return spark.read.text(list(paths), wholetext=True).select(F.input_file_name().alias("path"), "value")


def lines(whole: DataFrame) -> DataFrame:
    """(path, line_no, value) of each line."""
    return whole.select("path", F.posexplode(F.split("value", "\r?\n")).alias("line_no", "value"))


def number(c: Column) -> Column:
    return c.try_cast("double")


def sheet(spark: SparkSession, path: str, required: tuple[str, ...], filled: tuple[str, ...] = ()) -> DataFrame:
    """A tab-separated table with a header; missing columns, and empty cells in `filled`, raise."""
    df = spark.read.csv(path, sep="\t", header=True)
    missing = [c for c in required if c not in df.columns]
    if missing:
        raise ValueError(f"{path} lacks the columns {', '.join(missing)}")
    for c in filled:
        df = df.withColumn(c, F.when(F.trim(c) != "", F.col(c)).otherwise(F.raise_error(F.lit(f"empty {c}"))))
    return df


def samples(spark: SparkSession, path: str) -> DataFrame:
    """(species, fasta, domtblout): the sample sheet, relative paths below its folder."""
    folder = path.rsplit("/", 1)[0] if "/" in path else "."
    df = sheet(spark, path, ("species", "fasta"), ("species", "fasta"))
    if "domtblout" not in df.columns:
        df = df.withColumn("domtblout", F.lit(None).cast("string"))
    whole = lambda c: F.when(F.col(c).rlike("^(/|[a-z0-9]+:)"), F.col(c)).when(F.trim(c) != "", F.concat(F.lit(folder + "/"), F.trim(c)))
    return df.select(F.trim("species").alias("species"), whole("fasta").alias("fasta"), whole("domtblout").alias("domtblout"))


def families(spark: SparkSession, path: str) -> DataFrame:
    """(family, accession) of the domain map, accessions without their version."""
    df = sheet(spark, path, ("Family", "Pfam"), ("Family", "Pfam"))
    return df.select(F.trim("Family").alias("family"), F.substring_index(F.trim("Pfam"), ".", 1).alias("accession")).distinct()


def table_file(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """A table whose separator is told from its first line: tab, else semicolon, else comma; with a schema there is no header."""
    first = spark.read.text(path).first()
    line = first[0] if first else ""
    mark = max("\t;,", key=lambda c: (line.count(c), c == ","))
    return spark.read.csv(path, sep=mark, schema=schema) if schema else spark.read.csv(path, sep=mark, header=True, inferSchema=True)


#: The columns of a structure search result.
SEARCH = "query string, target string, alntmscore double, lddt double, evalue double, bits double, prob double"


def fasta_paths(spark: SparkSession, given: list[str], folders: list[str], suffixes: tuple[str, ...] = (".fasta", ".fa", ".faa")) -> list[str]:
    """The given paths, then the FASTA files of the folders by name, each once; what does not exist is left out."""
    fs = spark._jvm.org.apache.hadoop.fs
    conf, out = spark._jsc.hadoopConfiguration(), []
    for p in given:
        path = fs.Path(p)
        if path.getFileSystem(conf).exists(path):
            out.append(p)
    for folder in folders:
        path = fs.Path(folder)
        system = path.getFileSystem(conf)
        if system.exists(path):
            names = sorted(s.getPath().getName() for s in system.listStatus(path) if s.isFile())
            out += [f"{folder.rstrip('/')}/{n}" for n in names if n.lower().endswith(suffixes)]
    return list(dict.fromkeys(out))


def fasta(whole: DataFrame, strict: bool = False) -> DataFrame:
    """(path, seq_id, description, sequence): upper case, blanks and stars dropped, empty ones left out; strict: a file without any raises."""
    records = whole.select("path", F.explode(F.filter(F.split("value", "(?m)^>"), lambda r: F.trim(r) != "")).alias("r"))
    header = F.split("r", "\r?\n", 2)
    sequence = F.upper(F.regexp_replace(F.coalesce(F.get(header, F.lit(1)), F.lit("")), "[\\s*]", ""))
    rows = records.select("path", F.trim(header[0]).alias("description"), sequence.alias("sequence"))
    rows = rows.select("path", F.split("description", "\\s+")[0].alias("seq_id"), "description", "sequence").where("sequence <> ''")
    if strict:
        empty = whole.select("path").join(rows.select("path").distinct(), "path", "left_anti").first()
        if empty:
            raise ValueError(f"no sequence in {empty[0]}")
    return rows


def domain_hits(rows: DataFrame, keep: str | None = None) -> DataFrame:
    """(protein_id, accession, evalue) of a domain table, with the column `keep` if asked; short or non-numeric lines raise."""
    f = F.split(F.trim("value"), "\\s+")
    kept = rows.where((F.trim("value") != "") & ~F.ltrim("value").startswith("#"))
    bad = (F.size(f) < 13) | number(F.get(f, F.lit(12))).isNull()
    checked = kept.withColumn("_bad", F.assert_true(~bad, F.concat(F.lit("malformed line: "), F.col("value"))))
    return checked.where("_bad is null").select(*([keep] if keep else []), f[3].alias("protein_id"), F.split(f[1], "\\.")[0].alias("accession"), number(f[12]).alias("evalue"))


def signal_peptides(rows: DataFrame) -> DataFrame:
    """(id, prediction, found, cut) of tab-separated lines, else of lines split at white space.

    cut is the residue after the cleavage, which the last field gives as a pair joined by a dash;
    found is whether the prediction names a signal.
    """
    kept = rows.where((F.trim("value") != "") & ~F.col("value").startswith("#"))
    f = F.when(F.col("value").contains("\t"), F.split("value", "\t")).otherwise(F.split(F.trim("value"), "\\s+"))
    kept = kept.withColumn("f", F.transform(f, lambda x: F.trim(x))).where(F.size("f") > 1)
    site = F.filter(F.split(F.lower(F.array_join("f", " ")), "[\\s:.]+"), lambda x: x.contains("-") & F.get(F.split(x, "-"), F.lit(0)).try_cast("int").isNotNull())
    after = F.get(F.split(F.get(site, F.lit(0)), "-"), F.lit(1)).try_cast("int")
    label = F.get("f", F.lit(1))
    return kept.select(F.get("f", F.lit(0)).alias("id"), label.alias("prediction"), (F.upper(label).startswith("SP") | F.upper(label).contains("SIGNAL")).alias("found"), F.when(F.lower("value").contains("cs pos"), after).alias("cut"))


def membrane_calls(rows: DataFrame) -> DataFrame:
    """(id, ranges) of lines whose first field is an id: every a-b or a..b pair of positions; none is an empty list."""
    kept = rows.where((F.trim("value") != "") & ~F.col("value").startswith("#"))
    pair = r"\b(\d+)(?:-|\.\.)(\d+)\b"
    first, last = (F.regexp_extract_all("value", F.lit(pair), F.lit(i)) for i in (1, 2))
    ranges = F.transform(F.arrays_zip(first.alias("a"), last.alias("b")), lambda x: F.struct(x["a"].cast("int").alias("start"), x["b"].cast("int").alias("end")))
    return kept.select(F.split(F.trim("value"), "[\\s,;]+")[0].alias("id"), ranges.alias("ranges"))


def feature_lines(rows: DataFrame, kinds: tuple[str, ...] = ("TMhelix", "signal")) -> DataFrame:
    """(id, kind, start, end) of GFF-like lines: id, kind and two positions between tabs or blanks; other lines are skipped."""
    f = F.split(F.trim("value"), "\\s+")
    kept = rows.where(~F.trim("value").startswith("#") & F.lower(F.get(f, F.lit(1))).isin(*[k.lower() for k in kinds]))
    at = lambda i: F.get(f, F.lit(i)).try_cast("int")
    return kept.select(f[0].alias("id"), f[1].alias("kind"), at(2).alias("start"), at(3).alias("end")).where("start is not null and end is not null")


def topologies(whole: DataFrame) -> DataFrame:
    """(id, label, sequence, topology) of three-line records `>id | LABEL`, sequence, states."""
    found = F.regexp_extract_all("value", F.lit("(?m)^>[^\\n]*\\|[^\\n]*\\n[A-Za-z*]+\\r?\\n[SMIO]+"), F.lit(0))
    part = F.split("r", "\r?\n")
    head = F.split(F.substring(part[0], 2, 100_000), "\\|")
    return whole.select(F.explode(found).alias("r")).select(F.trim(head[0]).alias("id"), F.trim(head[1]).alias("label"), part[1].alias("sequence"), part[2].alias("topology"))


# Names of the features, and the states of a topology line.
MEMBRANE, SIGNAL, STATES = ("tmhelix", "transmembrane", "tm"), ("signal", "signal_peptide", "sp"), "^[SIMOousim]+$"


def topology_calls(rows: DataFrame) -> DataFrame:
    """(id, label, ranges, has_signal, signal_start, signal_end, source) of topology predictions, whatever their form.

    rows: path, line_no, value, of feature tables (id, source, feature, start, end between tabs, or id, feature, start, end between
    blanks) and of three-line records (`>id | label`, sequence, states), bare or in Markdown fences. Membrane ranges of
    both that touch are one; a record's first run of signal states goes before a feature line's, whose last one counts.
    """
    tabs, blanks = F.split("value", "\t"), F.split(F.trim("value"), "\\s+")
    wide = F.size(tabs) >= 5
    at = lambda i, j: F.when(wide, F.trim(F.get(tabs, F.lit(i)))).otherwise(F.get(blanks, F.lit(j)))
    lines = rows.where((F.trim("value") != "") & ~F.trim("value").startswith("#") & ~F.trim("value").startswith("```"))
    marked = lines.select("path", "line_no", at(0, 0).alias("id"), F.lower(at(2, 1)).alias("kind"), at(3, 2).try_cast("int").alias("start"), at(4, 3).try_cast("int").alias("end"))
    marked = marked.where(F.col("kind").isin(*MEMBRANE, *SIGNAL) & F.col("start").isNotNull() & F.col("end").isNotNull())
    span = F.struct("start", "end")
    features = marked.groupBy("id").agg(
        F.collect_list(F.when(F.col("kind").isin(*MEMBRANE), span)).alias("f_ranges"), F.max_by(F.when(F.col("kind").isin(*SIGNAL), span), F.when(F.col("kind").isin(*SIGNAL), F.struct("path", "line_no"))).alias("f_signal"),
    )
    after = W.partitionBy("path").orderBy("line_no")
    follow = rows.where((F.trim("value") != "") & (F.trim("value") != "```")).select("path", "line_no", F.trim("value").alias("head"), *[F.regexp_replace(F.lead("value", i).over(after), "\\s", "").alias(c) for i, c in ((1, "sequence"), (2, "states"))])
    header = F.split(F.substring("head", 2, 1 << 20), "\\|", 2)
    found = follow.where(F.col("head").startswith(">") & (F.length("sequence") > 0) & F.col("states").rlike(STATES) & (F.length("states") >= F.greatest(F.lit(5), F.floor(F.length("sequence") / 2))))
    found = found.select("path", "line_no", F.get(F.split(F.trim(F.get(header, F.lit(0))), "\\s+"), F.lit(0)).alias("id"), F.trim(F.coalesce(F.get(header, F.lit(1)), F.lit(""))).alias("label"), F.upper("states").alias("states"))
    spans = lambda letter: F.transform(scan.matches(F.col("states"), letter + "+"), lambda x: F.struct(x["start"].alias("start"), (x["start"] + F.length(x["hit"]) - 1).alias("end")))
    found = found.withColumns({"m": spans("M"), "s": F.get(spans("S"), F.lit(0))})
    records = found.groupBy("id").agg(F.flatten(F.collect_list("m")).alias("r_ranges"), F.max_by("label", F.struct("path", "line_no")).alias("label"), F.max_by("s", F.when(F.col("s").isNotNull(), F.struct("path", "line_no"))).alias("r_signal"))
    both = features.join(records, "id", "full_outer")
    signal = F.coalesce("r_signal", "f_signal")
    none = F.array().cast("array<struct<start:int,end:int>>")
    return both.select(
        "id", F.coalesce("label", F.lit("")).alias("label"), sequences.merged(F.concat(F.coalesce("f_ranges", none), F.coalesce("r_ranges", none)), 1).alias("ranges"),
        (signal.isNotNull() | F.upper(F.coalesce("label", F.lit(""))).contains("SP")).alias("has_signal"), signal["start"].alias("signal_start"), signal["end"].alias("signal_end"),
        F.when(F.col("label").isNotNull(), F.lit("DeepTMHMM/3line")).otherwise(F.lit("DeepTMHMM/GFF")).alias("source"),
    )


def series(rows: DataFrame) -> DataFrame:
    """(path, line_no, column, name, value) of XVG files; headers and lines without numbers are skipped.

    Short lines are filled with null. The first column is time; a legend names the others, else y1, y2, ...
    """
    legend = F.split("value", '"')
    number_ = F.split(F.trim("value"), "\\s+")
    named = rows.where(F.trim("value").startswith("@") & F.get(number_, F.lit(2)).eqNullSafe("legend") & F.get(number_, F.lit(1)).startswith("s"))
    named = named.select(F.col("path").alias("_path"), (F.substring(F.get(number_, F.lit(1)), 2, 9).try_cast("int") + 1).alias("_column"), F.get(legend, F.lit(1)).alias("_name"))
    kept = rows.where((F.trim("value") != "") & ~F.ltrim("value").startswith("#") & ~F.ltrim("value").startswith("@"))
    kept = kept.select("path", "line_no", F.transform(number_, number).alias("v")).where(~F.exists("v", lambda x: x.isNull()))
    widest = kept.groupBy(F.col("path").alias("_p")).agg(F.max(F.size("v")).alias("_w"))
    filled = kept.join(widest, F.col("path") == F.col("_p")).select("path", "line_no", F.posexplode(F.concat("v", F.array_repeat(F.lit(None).cast("double"), F.col("_w") - F.size("v")))).alias("column", "value"))
    both = filled.join(named, (F.col("path") == F.col("_path")) & (F.col("column") == F.col("_column")), "left")
    plain = F.when(F.col("column") == 0, F.lit("time")).otherwise(F.concat(F.lit("y"), F.col("column").cast("string")))
    return both.select("path", "line_no", "column", F.coalesce("_name", plain).alias("name"), "value")


def modes(rows: DataFrame) -> DataFrame:
    """(path, mode, affinity, rmsd_lb, rmsd_ub) of docking logs: lines of four numbers, a count, an energy and two distances of no sign."""
    f = F.split(F.trim("value"), "\\s+")
    part = lambda i: F.get(f, F.lit(i))
    plain = lambda c: c.rlike("^[0-9.]+$")
    kept = rows.where((F.size(f) == 4) & part(0).rlike("^[0-9]+$") & part(1).rlike("^-?[0-9.]+$") & plain(part(2)) & plain(part(3)))
    found = kept.select("path", part(0).try_cast("int").alias("mode"), *[number(part(i)).alias(c) for i, c in ((1, "affinity"), (2, "rmsd_lb"), (3, "rmsd_ub"))])
    return found.where("mode is not null and affinity is not null and rmsd_lb is not null and rmsd_ub is not null")


#: What validation tools call their figures.
REPORTED = {
    "molprobity_score": r"(?i)MolProbity score\s*[=:]\s*([0-9.]+)", "clashscore": r"(?i)Clashscore\s*[=:]\s*([0-9.]+)",
    "rama_outliers": r"(?i)Ramachandran outliers\s*[=:]\s*([0-9.]+)", "rama_favored": r"(?i)(?:Ramachandran )?favored\s*[=:]\s*([0-9.]+)",
    "rotamer_outliers": r"(?i)Rotamer outliers\s*[=:]\s*([0-9.]+)", "cbeta_deviations": r"(?i)C-beta deviations\s*[=:]\s*([0-9.]+)",
    "rms_bonds": r"(?i)RMS\(bonds\)\s*[=:]\s*([0-9.]+)", "rms_angles": r"(?i)RMS\(angles\)\s*[=:]\s*([0-9.]+)",
    "tm_score": r"(?i)TM-score\s*=\s*([0-9.]+)", "rmsd": r"(?i)RMSD\s*=\s*([0-9.]+)", "aligned_length": r"(?i)Aligned length\s*=\s*([0-9]+)",
}


#: Per cent in brackets on the lines of a backbone report, by what the line says (the first that fits).
BACKBONE = (("disfavored conformations", "cablam_disfavored"), ("outlier conformations", "cablam_outliers"), ("severe ca geometry outliers", "cablam_severe"), ("helix-like", "cablam_helix"))
#: The numbers of a contact-area report in order.
AREAS = ("voro_dark", "voro_light")


def reported(whole: DataFrame) -> DataFrame:
    """(path, one column per figure) of the reports of validation tools; what is not there is null."""
    return whole.select("path", *[number(F.nullif(F.regexp_extract("value", p, 1), F.lit(""))).alias(c) for c, p in REPORTED.items()])


def backbone_report(whole: DataFrame) -> DataFrame:
    """(path, one column per figure): the first bracketed per cent of the last line of each kind; severe outliers are no plain ones."""
    lines = F.filter(F.split("value", "\r?\n"), lambda x: x.rlike(r"\([0-9.]+%\)"))

    def kind(line: Column) -> Column:
        low, out = F.lower(line), F
        for part, name in BACKBONE:
            fits = low.contains(part) & ~low.contains("severe") if name == "cablam_outliers" else low.contains(part)
            out = out.when(fits, F.lit(name))
        return out.otherwise(F.lit(None))

    found = F.transform(lines, lambda x: F.struct(kind(x).alias("k"), F.regexp_extract(x, r"\(([0-9.]+)%\)", 1).alias("v")))
    rows = whole.select("path", found.alias("f"))
    of = lambda name: F.filter("f", lambda x: x["k"] == name)
    return rows.select("path", *[number(F.get(F.reverse(of(name)), F.lit(0))["v"]).alias(name) for _, name in BACKBONE])


def area_report(whole: DataFrame) -> DataFrame:
    """(path, one column per figure): the numbers that stand alone, in order."""
    numbers = F.filter(F.split(F.trim("value"), r"\s+"), lambda x: x.rlike(r"^-?[0-9.]+$"))
    return whole.select("path", *[number(F.get(numbers, F.lit(i))).alias(name) for i, name in enumerate(AREAS)])


def block_rows(cells: DataFrame, required: Sequence[str]) -> DataFrame:
    """(sheet, system, row_no, the required columns) of sheets with two header rows: systems above the columns of their blocks.

    cells: sheet, row_no (from 0) and values (array of strings). The name of a system holds for the blank cells to its
    right. Of equal columns of a block the first counts; blocks of fewer than two of the required columns are
    left out, as are rows without the first of them.
    """
    each = cells.select("sheet", "row_no", F.posexplode("values").alias("col", "value")).withColumn("value", F.nullif(F.trim("value"), F.lit("")))
    own = F.when(~F.col("value").startswith("Unnamed"), F.col("value"))
    carry = W.partitionBy("sheet").orderBy("col").rowsBetween(W.unboundedPreceding, W.currentRow)
    systems = each.where("row_no = 0").select("sheet", "col", F.last(own, ignorenulls=True).over(carry).alias("system"))
    names = each.where("row_no = 1").select("sheet", "col", F.col("value").alias("name")).where(F.col("name").isin(*required))
    at = systems.where("system is not null").join(names, ["sheet", "col"]).groupBy("sheet", "system", "name").agg(F.min("col").alias("col"))
    whole = at.groupBy("sheet", "system").agg(F.count("*").alias("n")).where("n >= 2").select("sheet", "system")
    placed = each.where("row_no > 1").join(F.broadcast(at.join(whole, ["sheet", "system"])), ["sheet", "col"])
    found = placed.groupBy("sheet", "system", "row_no").agg(*[F.max(F.when(F.col("name") == c, F.col("value"))).alias(c) for c in required])
    return found.where(F.col(f"`{required[0]}`").isNotNull())


def atoms(rows: DataFrame) -> DataFrame:
    """Atoms of fixed-column coordinate files; lines without coordinates are skipped.

    path, model (number of the MODEL the line is in, 0 without), line_no, record, serial, name,
    altloc, resname, chain, resid, x, y, z, occupancy, bfactor, element.
    """
    cut = lambda a, n: F.trim(F.substring("value", a, n))
    model = F.sum(F.col("value").startswith("MODEL").cast("int")).over(W.partitionBy("path").orderBy("line_no"))
    rows = rows.withColumn("model", model).where(F.col("value").rlike("^(ATOM  |HETATM)"))
    element = F.when(cut(77, 2) != "", F.upper(cut(77, 2))).otherwise(F.upper(F.regexp_extract(cut(13, 4), "([A-Za-z])", 1)))
    return rows.select(
        "path", "model", "line_no", cut(1, 6).alias("record"), cut(7, 5).try_cast("int").alias("serial"), cut(13, 4).alias("name"), cut(17, 1).alias("altloc"), cut(18, 3).alias("resname"),
        cut(22, 1).alias("chain"), cut(23, 4).try_cast("int").alias("resid"), *[number(cut(a, 8)).alias(c) for a, c in ((31, "x"), (39, "y"), (47, "z"))],
        number(cut(55, 6)).alias("occupancy"), number(cut(61, 6)).alias("bfactor"), element.alias("element"),
    ).where("x is not null and y is not null and z is not null and resid is not null")
