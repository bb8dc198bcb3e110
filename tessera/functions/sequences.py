"""Evidence from sequences: hydropathy, signal and anchor tails, membrane segments, class rules.

Every function takes a string column and works on whole strings; what looks along a sequence goes over
Arrow batches. Positions count from one. Empty and null sequences give empty or null evidence, never an error.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# Hydropathy of the residues, and the residue classes of the rules.
HYDROPATHY = {"A": 1.8, "C": 2.5, "D": -3.5, "E": -3.5, "F": 2.8, "G": -0.4, "H": -3.2, "I": 4.5, "K": -3.9, "L": 3.8, "M": 1.9, "N": -3.5, "P": -1.6, "Q": -3.5, "R": -4.5, "S": -0.8, "T": -0.7, "V": 4.2, "W": -0.9, "Y": -1.3}
HYDROPHOBIC, SMALL, BEFORE_CUT = "CFILMVWY", "ADEGNQST", "ACGSTV"
THREE_TO_ONE = {"ALA": "A", "ARG": "R", "ASN": "N", "ASP": "D", "CYS": "C", "GLN": "Q", "GLU": "E", "GLY": "G", "HIS": "H", "ILE": "I", "LEU": "L", "LYS": "K", "MET": "M", "PHE": "F", "PRO": "P", "SER": "S", "THR": "T", "TRP": "W", "TYR": "Y", "VAL": "V", "MSE": "M", "SEC": "U", "PYL": "O", "ASX": "B", "GLX": "Z"}


def hydropathy(residue: Column) -> Column:
    """A residue's hydropathy; 0 for what is none."""
    table = F.create_map(*[F.lit(x) for pair in HYDROPATHY.items() for x in pair])
    return F.coalesce(F.try_element_at(table, F.upper(residue)), F.lit(0.0))


def values(sequence: Column) -> Column:
    """The hydropathies of a sequence as an array."""
    letters = F.filter(F.split(F.coalesce(sequence, F.lit("")), ""), lambda c: c != "")
    return F.transform(letters, hydropathy)


def _mean(array: Column) -> Column:
    return F.aggregate(array, F.lit(0.0), lambda a, x: a + x) / F.nullif(F.size(array), F.lit(0))


def leading_mean(sequence: Column, residues: int = 30) -> Column:
    """Mean hydropathy of the first residues; 0 for an empty sequence."""
    return F.coalesce(_mean(F.slice(values(sequence), 1, residues)), F.lit(0.0))


def sliding(x: np.ndarray, width: int) -> np.ndarray:
    """Means of all full windows by differences of running sums; empty if there is none."""
    if len(x) < width:
        return np.empty(0)
    sums = np.concatenate([[0.0], np.cumsum(x)])
    return (sums[width:] - sums[:-width]) / width


def window_means(array: Column, width: int) -> Column:
    """Means of all full windows; empty if there is none."""

    def run(arrays: pd.Series) -> pd.Series:
        return pd.Series([sliding(np.asarray(x if x is not None else [], float), width) for x in arrays], dtype=object)

    return F.pandas_udf(run, "array<double>")(array)


def padded_means(array: Column, width: int) -> Column:
    """As many means as values: full windows by their start, the last one repeated; the overall mean where none is full."""

    def run(arrays: pd.Series) -> pd.Series:
        out = []
        for x in arrays:
            x = np.asarray(x if x is not None else [], float)
            means = sliding(x, width) if len(x) >= width else np.full(len(x), x.mean() if len(x) else 0.0)
            out.append(np.concatenate([means, np.full(len(x) - len(means), means[-1] if len(means) else 0.0)]))
        return pd.Series(out, dtype=object)

    return F.pandas_udf(run, "array<double>")(array)


def best_window(sequence: Column, scanned: int, width: int) -> Column:
    """Struct (mean, start, end) of the leftmost greatest window mean among the first residues.

    Shorter regions are one window; an empty one has mean 0 and no range.
    """
    region = F.slice(values(sequence), 1, scanned)
    means = F.transform(window_means(region, width), lambda m: F.round(m, 9))
    best = F.array_max(means)
    at = F.array_position(means, best).cast("int")
    none = F.lit(None).cast("int")
    whole = F.struct(F.coalesce(_mean(region), F.lit(0.0)).alias("mean"), F.when(F.size(region) > 0, F.lit(1)).otherwise(none).alias("start"), F.when(F.size(region) > 0, F.size(region)).otherwise(none).alias("end"))
    return F.when(F.size(region) < width, whole).otherwise(F.struct(best.alias("mean"), at.alias("start"), (at + width - 1).alias("end")))


def merged(ranges: Column, gap: int) -> Column:
    """Sorted (start, end) ranges, those that begin at most `gap` after the end so far in one."""

    def step(done: Column, r: Column) -> Column:
        last = F.element_at(done, -1)
        joined = F.concat(F.slice(done, 1, F.size(done) - 1), F.array(F.struct(last["start"].alias("start"), F.greatest(last["end"], r["end"]).alias("end"))))
        return F.when(F.size(done) == 0, F.array(r)).when(r["start"] <= last["end"] + gap, joined).otherwise(F.concat(done, F.array(r)))

    return F.aggregate(F.array_sort(ranges), F.array().cast("array<struct<start:int,end:int>>"), step)


def windows_over(sequence: str, width: int, threshold: float, gap: int) -> list[tuple[int, int]]:
    """Segments of one sequence: see segments()."""
    x = np.array([HYDROPATHY.get(c, 0.0) for c in sequence.upper()])
    ok = sliding(x, width) >= threshold - 1e-9
    # Runs of windows over the threshold, as first and last start from 1.
    edges = np.flatnonzero(np.diff(np.concatenate([[False], ok, [False]]).astype(int)))
    out: list[tuple[int, int]] = []
    passed = 0
    for first, last in zip(edges[::2] + 1, edges[1::2]):
        first = max(int(first), passed + 1)
        if first > last:
            continue
        passed = int(last) + width - 1
        if out and first <= out[-1][1] + gap:
            out[-1] = (out[-1][0], passed)
        else:
            out.append((first, passed))
    return out


def segments(sequence: Column, width: int = 19, threshold: float = 1.6, gap: int = 3) -> Column:
    """Membrane segments as (start, end), by one pass over the window means of a sequence.

    A segment opens at a window that reaches the threshold where none is open and the last one's
    residues are passed; it grows while the following windows reach it. Windows that begin inside a
    finished segment open none. Segments at most `gap` apart are one. Time grows with the length.
    """

    def run(texts: pd.Series) -> pd.Series:
        return pd.Series([[{"start": s, "end": e} for s, e in windows_over(t or "", width, threshold, gap)] for t in texts], dtype=object)

    return F.pandas_udf(run, "array<struct<start:int,end:int>>")(sequence)


def _in(sequence: Column, at: Column, letters: str) -> Column:
    return F.coalesce(F.substring(sequence, at, F.lit(1)).isin(*letters), F.lit(False))


def signal(sequence: Column, threshold: float = 1.6, scanned: int = 45, width: int = 14) -> Column:
    """Struct (found, cut): a hydrophobic window near the start, cut after small residues.

    Under 25 residues, or without such a window, there is none. The cut is the first position from
    16 below min(35, length - 1) with small residues three before and at it; without one it is the
    window's end, and the signal still counts.
    """
    best = best_window(sequence, scanned, width)
    n = F.length(sequence)
    last = F.least(F.lit(35), n - 1)
    cuts = F.filter(F.sequence(F.lit(16), F.greatest(last - 1, F.lit(16))), lambda c: (c < last) & _in(sequence, c - 2, BEFORE_CUT) & _in(sequence, c, BEFORE_CUT))
    found = (n >= 25) & (best["mean"] >= F.lit(threshold) - F.lit(1e-9))
    return F.struct(F.coalesce(found, F.lit(False)).alias("found"), F.when(found, F.coalesce(F.get(cuts, F.lit(0)), best["end"])).alias("cut"))


def tail_anchor(sequence: Column, scanned: int, shortest: int, longest: int, share: float) -> Column:
    """Struct (found, omega, start, end): a hydrophobic tail and a small-residue site before it.

    Windows of `shortest` to `longest` residues are tried, shorter ones first, within the last eight
    starts of the tail that fit; the first whose share of hydrophobic residues is enough is the tail.
    The site is the first position from 15 to 5 before it that is small, as is the residue two before.
    """
    n = F.length(sequence)
    tail, base = F.right(sequence, F.lit(scanned)), n - scanned
    hits = F.concat(F.array(F.lit(0)), F.transform(F.filter(F.split(tail, ""), lambda c: c != ""), lambda c: c.isin(*HYDROPHOBIC).cast("int")))
    sums = F.aggregate(hits, F.array().cast("array<int>"), lambda a, x: F.concat(a, F.array(x + F.coalesce(F.try_element_at(a, F.lit(-1)), F.lit(0)))))
    tries = [F.struct(F.lit(i).alias("i"), F.lit(w).alias("w")) for w in range(shortest, longest + 1) for i in range(max(0, scanned - w - 8), scanned - w + 1)]
    enough = F.filter(F.array(*tries), lambda t: F.get(sums, t["i"] + t["w"]) - F.get(sums, t["i"]) >= F.lit(share - 1e-9) * t["w"])
    first = F.when(n >= scanned, F.get(enough, F.lit(0)))
    start, end = base + first["i"] + 1, base + first["i"] + first["w"]
    low, high = F.greatest(F.lit(3), start - 15), F.greatest(F.lit(3), start - 4)
    sites = F.filter(F.sequence(low, F.greatest(high, low)), lambda p: (p < high) & _in(sequence, p, SMALL) & _in(sequence, p - 2, SMALL))
    omega = F.when(first.isNotNull(), F.get(sites, F.lit(0)))
    return F.struct(omega.isNotNull().alias("found"), omega.alias("omega"), F.when(first.isNotNull(), start).alias("start"), F.when(first.isNotNull(), end).alias("end"))


def preferred(*evidence: tuple[str, Column, Column]) -> Column:
    """Struct (source, value) of the first evidence (source, present, value) that is present.

    An empty list is evidence of nothing found; only `present` tells whether there is evidence.
    """
    out = F
    for source, present, value in evidence:
        out = out.when(F.coalesce(present, F.lit(False)), F.struct(F.lit(source).alias("source"), value.alias("value")))
    return out.otherwise(F.lit(None))


def rendered(ranges: Column) -> Column:
    """Ranges as s-e;s-e."""
    return F.array_join(F.transform(ranges, lambda r: F.concat_ws("-", r["start"].cast("string"), r["end"].cast("string"))), ";")


# Names of the classes.
CLASSES = ("Ecto CEH (secreted / GPI-like)", "Ecto CEH (type-I single-pass)", "Ecto CEH (secreted)", "Cytosolic HSL-like neutral lipase", "Cytosolic α/β-hydrolase (neutral hydrolase candidate)", "α/β-hydrolase motif-positive, topology unresolved", "Unassigned")


def triage(signal_: Column, anchored: Column, passes: Column, elbow: Column, oxyanion: Column, long_oxyanion: Column) -> Column:
    """The class by topology first, then by motifs; null evidence counts as absent."""
    sp, gpi, gxs, hgg, hggg = (F.coalesce(c, F.lit(False)) for c in (signal_, anchored, elbow, oxyanion, long_oxyanion))
    n = F.coalesce(passes, F.lit(0))
    inside = ~sp & (n == 0)
    rules = (sp & gpi & (n <= 1), sp & (n == 1), sp & (n == 0), inside & hggg & gxs, inside & gxs, gxs | hgg)
    out = F
    for rule, name in zip(rules, CLASSES):
        out = out.when(rule, F.lit(name))
    return out.otherwise(F.lit(CLASSES[-1]))


def chain_sequence(order: Column, residue: Column) -> Column:
    """Aggregate: one-letter residues in order, X for unknown ones."""
    table = F.create_map(*[F.lit(x) for pair in THREE_TO_ONE.items() for x in pair])
    letters = F.transform(F.array_sort(F.collect_list(F.struct(order.alias("o"), residue.alias("r")))), lambda x: F.coalesce(F.try_element_at(table, F.upper(x["r"])), F.lit("X")))
    return F.array_join(letters, "")
