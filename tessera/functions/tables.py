"""Column names, labels and rules that are taken from names: decided on the schema, before any row is read."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .order import row_numbers


def first_column(df: DataFrame, names: Sequence[str]) -> str | None:
    """The first of the names that is a column: as written, else regardless of case."""
    lower = {c.lower(): c for c in reversed(df.columns)}
    return next((n for n in names if n in df.columns), None) or next((lower[n.lower()] for n in names if n.lower() in lower), None)


def with_aliases(df: DataFrame, aliases: Mapping[str, Sequence[str]]) -> DataFrame:
    """Canonical columns copied from the first alias there is; a canonical column that exists stays, as do the originals."""
    found = {name: next((a for a in others if a in df.columns), None) for name, others in aliases.items() if name not in df.columns}
    return df.withColumns({name: F.col(f"`{a}`") for name, a in found.items() if a})


def conformed(df: DataFrame, names: Mapping[str, str], required: Sequence[str], numeric: Sequence[str]) -> DataFrame:
    """Columns renamed regardless of case and outer blanks; missing required ones fail, numeric ones are null or coerced."""
    renamed = df.withColumnsRenamed({c: names[c.strip().lower()] if c.strip().lower() in names else c.strip() for c in df.columns})
    missing = [c for c in required if c not in renamed.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    value = lambda c: F.try_to_number(F.lit(None), F.lit("9")) if c not in renamed.columns else F.expr(f"try_cast(`{c}` as double)")
    return renamed.withColumns({c: value(c).cast("double") for c in numeric})


def named(df: DataFrame, column: str, order: Sequence[str], stem: str = "model_") -> DataFrame:
    """df with names stem1, stem2, ... in the given order where it has no such column."""
    if column in df.columns:
        return df
    return row_numbers(df, order, "_number").withColumn(column, F.concat(F.lit(stem), F.col("_number").cast("string"))).drop("_number")


def value_columns(df: DataFrame, index: Sequence[str]) -> list[str]:
    """Every column that is not an index column nor unnamed."""
    return [c for c in df.columns if c not in index and not c.startswith("Unnamed")]


def clean_name(name: str) -> str:
    """A column name without outer blanks and a trailing .number, and with a plain A for the unit sign."""
    stem, dot, number = name.strip().rpartition(".")
    return (stem if dot and number.isdigit() else name.strip()).replace("Å", "A")


def first_rule(text: Column, rules: Sequence[tuple[Sequence[str], str]], default: str | Column) -> Column:
    """The name of the first rule one of whose parts occurs in the lower-case text."""
    out, low = F, F.lower(F.coalesce(text, F.lit("")))
    for parts, name in rules:
        hit = low.contains(parts[0])
        for p in parts[1:]:
            hit = hit | low.contains(p)
        out = out.when(hit, F.lit(name))
    return out.otherwise(F.lit(default) if isinstance(default, str) else default)


# What file names and paths tell of metrics, tools and folds.
METRIC_RULES = ((("pae",), "pae"), (("pde",), "pde"), (("plddt",), "plddt"), (("contact",), "contact_prob"))
TOOL_RULES = ((("boltz",), "boltz_or_boltz2"), (("alphafold", "af3"), "alphafold3"), (("chai",), "chai_or_chai1"))
NAME_RULES = ((("affinity_", "confidence_"), "boltz_or_boltz2"), (("summary_confidences", "_confidences", "fold_"), "alphafold3"))
FOLD_RULES = ((("6w5v", "npc2"), "NPC2"), (("3gkj", "npc1", "ntd"), "NPC1-NTD"), (("4tw0", "cd36", "sr-bi", "scarb"), "CD36RP"), (("3zwq", "4m0e", "4n5h", "ceh", "lipe", "esterase", "hydrolase"), "alpha/beta hydrolase"))


def base_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def stem(path: Column) -> Column:
    """The file name without its last extension; a leading dot is none."""
    return F.regexp_replace(base_name(path), "(?<=.)\\.[^.]*$", "")


def tool(paths: Column) -> Column:
    """The platform that an array of paths tells of."""
    text = F.array_join(paths, " ")
    names = F.array_join(F.transform(paths, base_name), " ")
    none = F.lit(None).cast("string")
    by_path = [first_rule(text, TOOL_RULES[i : i + 1], none) for i in range(3)]
    by_name = [first_rule(names, NAME_RULES[i : i + 1], none) for i in range(2)]
    return F.coalesce(by_path[0], by_name[0], by_path[1], by_name[1], by_path[2], F.lit("generic"))


# Prefixes and endings that stems of one model differ in.
PREFIXES = ("fold_", "confidence_", "affinity_", "pae_", "pde_", "plddt_")
ENDINGS = r"(?:_model|_model_\d+|_rank_\d+|_seed_\d+|_confidences|_full_data|_full_data_\d+|_data|_data_\d+|_prediction|_scores|_score|_\d+)"


def group_stem(path: Column) -> Column:
    """The stem that files of one model share: prefixes off in order, endings off until none is left.

    An ending that is the whole stem stays.
    """
    low = F.lower(stem(path))
    out = low
    for prefix in PREFIXES:
        out = F.when(out.startswith(prefix), F.substring(out, len(prefix) + 1, 1 << 30)).otherwise(out)
    out = F.regexp_replace(out, f"(?<=.){ENDINGS}+$", "")
    plain = F.regexp_replace(F.regexp_replace(out, "[^a-z0-9]+", "_"), "^_+|_+$", "")
    return F.when(plain == "", low).otherwise(plain)


def system_of(path: Column, root: str) -> Column:
    """The first folder under the root, else the parent folder."""
    inner = F.when(path.startswith(root.rstrip("/") + "/"), F.substring(path, len(root.rstrip("/")) + 2, 1 << 30))
    parts, whole = F.split(inner, "/"), F.split(path, "/")
    return F.coalesce(F.when(F.size(parts) > 1, F.get(parts, F.lit(0))), F.get(whole, F.size(whole) - 2), stem(path))


def system_label(name: Column) -> Column:
    """RP4_CE20_5 as RP4–CE20:5, CE20_5 as CE20:5; other names stay."""
    full, short = r"(?i)(RP\d+|CEH|NPC\d*)[_-]?CE(\d+)[_:](\d+)", r"(?i)CE(\d+)[_:](\d+)"
    part = lambda p, i: F.regexp_extract(name, p, i)
    long = F.concat(F.upper(part(full, 1)), F.lit("–CE"), part(full, 2), F.lit(":"), part(full, 3))
    return F.when(name.rlike(full), long).when(name.rlike(short), F.concat(F.lit("CE"), part(short, 1), F.lit(":"), part(short, 2))).otherwise(name)


def keywords(text: str) -> dict[str, list[str]]:
    """L=a,b;M=c as {L: [a, b], M: [c]}; parts without = are skipped."""
    pairs = (p.split("=", 1) for p in text.split(";") if "=" in p)
    return {k.strip(): [x.strip() for x in v.split(",") if x.strip()] for k, v in pairs if k.strip()}


def support(label: Column) -> Column:
    """The last number in a node label; null without one."""
    found = F.regexp_extract_all(F.coalesce(label, F.lit("")), F.lit(r"[0-9]+(?:\.[0-9]+)?"), F.lit(0))
    return F.try_element_at(found, F.lit(-1)).cast("double")
