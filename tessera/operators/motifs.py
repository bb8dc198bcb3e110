"""A table of motifs against a table of sequences: one scan of the sequences for all motifs.

Literal motifs, and for each pattern the longest literal part that every match must contain, go into
automata that read a sequence once; only patterns whose part occurs are tried on it. The motif table is
collected in blocks of bounded size.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from re import _constants, _parser

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.scan import fault, found

#: Motifs of a block.
BLOCK = 20_000

# Prefixes of ids, and parts of section names, that name a family.
ID_FAMILIES = ((("CD36",), "CD36RP"), (("NPC1",), "NPC1"), (("NPC2",), "NPC2"), (("HSL", "ABHD", "HYDROLASE"), "ABHD/HSL"))
SECTION_FAMILIES = ((("NPC1",), "NPC1"), (("NPC2",), "NPC2"), (("CD36",), "CD36RP"), (("HYDROLASE", "HSL"), "ABHD/HSL"))
UNSPECIFIED = "Unspecified"
# Names of the columns of a library, by what they hold, the first that is there counts.
LIBRARY = {
    "Motif_ID": ("motif_id", "motifid", "motif"),
    "Consensus_Motif": ("consensus_motif", "consensus", "sequence_motif"),
    "Regex": ("regex_compatible_pattern", "regex", "pattern", "regex_pattern"),
    "Functional_Region": ("likely_functional_region", "functional_region", "region"),
    "Conservation": ("conservation", "conservation_level"),
    "Family": ("family", "motif_family", "protein_family"),
}


def family(motif_id: Column, section: Column) -> Column:
    """The family by the id's part before the first dash, underscore or blank, else by the section."""
    prefix = F.trim(F.get(F.split(F.trim(F.coalesce(motif_id, F.lit(""))), r"[_\-\s]"), F.lit(0)))
    head = F.regexp_replace(F.trim(F.coalesce(section, F.lit(""))), "^:+|:+$", "")
    out = F
    for parts, name in ID_FAMILIES:
        for p in parts:
            out = out.when(F.upper(prefix).startswith(p), F.lit(name))
    out = out.when(prefix != "", prefix)
    for parts, name in SECTION_FAMILIES:
        for p in parts:
            out = out.when(F.upper(head).contains(p), F.lit(name))
    return out.when(head != "", head).otherwise(F.lit(UNSPECIFIED))


def library(cells: DataFrame) -> DataFrame:
    """Family, Motif_ID, Consensus_Motif, Regex, Functional_Region, Conservation of motif sheets given as cells.

    cells: sheet, row_no and values (array of strings), as read without a header. A sheet's header is its first row
    with a cell that names the motif id; what is above it is passed over. A row whose first cell alone is
    filled, and looks like no motif, heads a section; rows without id or pattern are left out, as are repeated ones.
    """
    key = lambda c: F.regexp_replace(F.lower(F.trim(F.coalesce(c, F.lit("")))), "[ -]", "_")
    rows = cells.select("sheet", "row_no", F.transform("values", lambda c: F.trim(F.coalesce(c, F.lit("")))).alias("v")).where(F.exists("v", lambda c: c != ""))
    rows = rows.withColumn("names", F.transform("v", key))
    headers = rows.where(F.array_contains("names", "motif_id") | F.array_contains("names", "motifid")).groupBy("sheet").agg(F.min_by("names", "row_no").alias("header"), F.min("row_no").alias("from"))
    rows = rows.join(F.broadcast(headers), "sheet").where("row_no > `from`")
    first = F.get("v", F.lit(0))
    alone = (first != "") & (F.size(F.filter("v", lambda c: c != "")) == 1) & ~F.upper(first).rlike(r"_M\d+|HYDROLASE|GLYCO")
    carry = W.partitionBy("sheet").orderBy("row_no").rowsBetween(W.unboundedPreceding, W.currentRow)
    rows = rows.withColumns({"_head": alone, "_section": F.last(F.when(alone, first), ignorenulls=True).over(carry)}).where("not _head")

    def cell(names: tuple[str, ...]) -> Column:
        at = F.coalesce(*[F.nullif(F.array_position("header", n), F.lit(0)) for n in names])
        return F.coalesce(F.get("v", (at - 1).cast("int")), F.lit(""))

    out = rows.select("_section", *[cell(names).alias(name) for name, names in LIBRARY.items()])
    out = out.where((F.col("Motif_ID") != "") & (F.col("Regex") != "") & ~F.lower("Motif_ID").isin("motif id", "motif_id"))
    out = out.withColumns({"Family": F.when(F.col("Family") != "", F.col("Family")).otherwise(family(F.col("Motif_ID"), F.col("_section"))), "Regex": F.replace("Regex", F.lit(" "), F.lit(""))})
    return out.select("Family", "Motif_ID", "Consensus_Motif", "Regex", "Functional_Region", "Conservation").distinct()


def required(pattern: str) -> str:
    """The longest run of ASCII letters and digits, in lower case, that every match of the pattern contains."""
    best, run = "", ""

    def end() -> None:
        nonlocal best, run
        best, run = max(best, run, key=len), ""

    def walk(parts) -> None:
        nonlocal run
        for kind, value in parts:
            if kind is _constants.LITERAL and chr(value).isascii() and chr(value).isalnum():
                run += chr(value).lower()
            elif kind is _constants.SUBPATTERN:
                walk(value[-1])
            elif kind in (_constants.MAX_REPEAT, _constants.MIN_REPEAT, _constants.POSSESSIVE_REPEAT) and value[0] > 0:
                end()
                walk(value[2])
                end()
            else:
                end()

    walk(_parser.parse(pattern))
    end()
    return best


class Matcher:
    """The automata of a block of motifs: rows of (motif, pattern, literal)."""

    def __init__(self, motifs: list[tuple[str, str, bool]]):
        import ahocorasick

        self.names = [m for m, _, _ in motifs]
        self.literals, self.parts = ahocorasick.Automaton(), ahocorasick.Automaton()
        self.always: list[int] = []
        self.patterns: dict[int, re.Pattern[str]] = {}
        for i, (_, pattern, literal) in enumerate(motifs):
            if literal:
                if pattern:
                    self._add(self.literals, pattern, i)
                continue
            self.patterns[i] = re.compile(pattern, re.I)
            part = required(pattern)
            if part:
                self._add(self.parts, part, i)
            else:
                self.always.append(i)
        for a in (self.literals, self.parts):
            if len(a):
                a.make_automaton()

    @staticmethod
    def _add(automaton, word: str, i: int) -> None:
        automaton.add_word(word, (*automaton.get(word, (word,)), i))

    def find(self, text: str) -> Iterator[tuple[int, int, str]]:
        """(number of the motif, start from 1, hit) of every start at which a motif matches."""
        if len(self.literals):
            for end, (word, *own) in self.literals.iter(text):
                for i in own:
                    yield i, end - len(word) + 2, word
        if text.isascii():
            tried = set(self.always)
            if len(self.parts):
                for _, (_, *own) in self.parts.iter(text.lower()):
                    tried.update(own)
        else:  # some letters beyond ASCII match ASCII ones whatever the case
            tried = set(self.patterns)
        for i in tried:
            for start, hit in found(self.patterns[i], text):
                yield i, start, hit


def faults(motifs: DataFrame) -> DataFrame:
    """(motif, pattern, fault) of the motifs whose pattern does not compile or is null; literals have none."""
    why = F.pandas_udf(lambda p: p.map(fault), "string")
    patterns = motifs.where(~F.coalesce("literal", F.lit(False)))
    checked = patterns.select("motif", "pattern", F.when(F.col("pattern").isNull(), F.lit("no pattern")).otherwise(why(F.coalesce("pattern", F.lit("")))).alias("fault"))
    return checked.where("fault is not null")


def scan(texts: DataFrame, motifs: DataFrame, key: str, text: str, block: int = BLOCK) -> DataFrame:
    """(key, motif, start, end, hit): every start, from 1, at which a motif matches a text, overlapping ones included.

    motifs: motif, pattern, literal. Literals match as written, patterns whatever the case; matches of no length
    and patterns that do not compile (see faults) give no rows. The texts are read once for each block of motifs.
    """
    usable = motifs.select(F.col("motif").cast("string").alias("motif"), F.col("pattern").cast("string").alias("pattern"), F.coalesce("literal", F.lit(False)).alias("literal")).where(F.col("pattern").isNotNull()).distinct()
    kind = texts.select(key).schema[0].dataType.simpleString()
    parts = max(1, -(-usable.count() // block))
    out = None
    for b in range(parts):
        rows = [tuple(r) for r in usable.where(F.pmod(F.xxhash64("motif", "pattern"), F.lit(parts)) == b).collect()]
        rows = [r for r in rows if r[2] or fault(r[1]) is None]

        def run(batches: Iterator[pa.RecordBatch], rows=rows) -> Iterator[pa.RecordBatch]:
            matcher = Matcher(rows)
            for batch in batches:
                at, names, starts, hits = [], [], [], []
                for n, t in enumerate(batch.column(1).to_pylist()):
                    for i, start, hit in matcher.find(t or ""):
                        at.append(n), names.append(matcher.names[i]), starts.append(start), hits.append(hit)
                ends = [s + len(h) - 1 for s, h in zip(starts, hits)]
                columns = [batch.column(0).take(pa.array(at, pa.int64())), pa.array(names, pa.string()), pa.array(starts, pa.int32()), pa.array(ends, pa.int32()), pa.array(hits, pa.string())]
                yield pa.RecordBatch.from_arrays(columns, [key, "motif", "start", "end", "hit"])

        one = texts.select(key, text).mapInArrow(run, f"`{key}` {kind}, motif string, start int, end int, hit string")
        out = one if out is None else out.unionByName(one)
    return out
