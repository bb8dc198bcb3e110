"""Pattern scans over strings and labels made from them; positions count from one."""

from __future__ import annotations

import re
import warnings
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def fault(pattern: str) -> str | None:
    """Why the pattern does not compile; None if it does."""
    try:
        re.compile(pattern, re.I)
    except (re.error, OverflowError, RecursionError) as why:
        return str(why)
    return None


def found(pattern: re.Pattern[str], text: str) -> Iterator[tuple[int, str]]:
    """(start, hit) of every start at which the pattern matches; matches of no length are left out."""
    at = pattern.search(text)
    while at:
        if at.end() > at.start():
            yield at.start() + 1, at.group()
        at = pattern.search(text, at.start() + 1) if at.start() < len(text) else None


def _hits(text: Column, hits: Callable[[str], list[tuple[int, str]]]) -> Column:
    """Struct array (start, hit) made of each text by a function; of a null text an empty one."""

    def run(texts: pd.Series) -> pd.Series:
        return pd.Series([[{"start": s, "hit": h} for s, h in hits(t)] if t else [] for t in texts], dtype=object)

    return F.pandas_udf(run, "array<struct<start:int,hit:string>>")(text)


def starts(text: Column, pattern: str) -> Column:
    """Struct array (start, hit) of every position where the pattern matches, overlapping ones too, whatever the case.

    A text is searched from the start after the last match's, so time grows with its length. Matches of no
    length are left out.
    """
    return _hits(text, lambda t, p=pattern: list(found(re.compile(p, re.I), t)))


def valid_pattern(pattern: str) -> bool:
    """Whether the pattern compiles; bad ones are left out of a scan with a warning."""
    why = fault(pattern)
    if why is not None:
        warnings.warn(f"pattern {pattern!r} is left out: {why}", stacklevel=2)
    return why is None


def overlapping(df: DataFrame, text: str, pattern: str, out: str = "hit") -> DataFrame:
    """One row per start at which the pattern matches, overlapping ones included: start, end, match.

    Case does not matter. A pattern that does not compile gives no rows and a warning.
    """
    if not valid_pattern(pattern):
        return df.select("*", F.lit(1).alias("start"), F.lit("").alias(out), F.lit(0).alias("end")).where(F.lit(False))
    return _rows(df, starts(F.col(text), pattern), out)


def literal(df: DataFrame, text: str, motif: str, out: str = "hit") -> DataFrame:
    """Overlapping occurrences of a literal string."""
    return _rows(df, _hits(F.col(text), lambda t: list(found(re.compile(re.escape(motif)), t))), out)


def _rows(df: DataFrame, hits: Column, out: str) -> DataFrame:
    rows = df.withColumn("_x", F.explode(hits))
    return rows.withColumns({"start": F.col("_x.start"), out: F.col("_x.hit")}).withColumn("end", F.col("start") + F.length(out) - 1).drop("_x")


def matches(text: Column, pattern: str) -> Column:
    """Struct array (start, hit) of the non-overlapping matches from the left; those of no length are left out."""
    return _hits(text, lambda t, p=pattern: [(m.start() + 1, m.group()) for m in re.compile(p).finditer(t) if m.group()])


def successive(text: Column, pattern: str) -> Column:
    """Non-overlapping matches, from the left."""
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(0))


def safe_label(c: Column, default: str = "item") -> Column:
    """Letters, digits, dot, dash and underscore; other runs become one underscore."""
    label = F.regexp_replace(F.regexp_replace(F.coalesce(c, F.lit("")), "[^A-Za-z0-9_.-]+", "_"), "^_+|_+$", "")
    return F.when(label == "", F.lit(default)).otherwise(label)


def stable_id(key: Column, parts: Column) -> Column:
    """The key with six hexadecimal digits of the md5 of its sorted parts."""
    return F.concat(key, F.lit("_"), F.substring(F.md5(F.array_join(F.sort_array(parts), "|")), 1, 6))
