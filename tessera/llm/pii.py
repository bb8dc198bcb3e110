"""Personal data: candidate spans scored by gradient-boosted trees, in DataFrame expressions.

Generators of high recall propose overlapping spans. Spans that pass the exact base checks always
stay. The others, whether they have the base form or not, are scored by boosted trees over format
and context features; the trees are
grown on the driver from counts per cell of the (discrete) feature space, which cover all
documents and whose number is bounded by the features, and compiled to conditional expressions.
Per kind, the threshold is the lowest score with the asked precision on held-back documents.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import durable, text_or_empty

KINDS = ("email", "ip", "card", "phone")

#: (kind, is base, pattern). Possessive forms match what the plain ones do, in linear time: a start
#: inside a run of the first class can only match where one at the run's start does, or after a match.
GENERATORS = (
    ("email", True, r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"),
    ("ip", True, r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"),
    ("card", True, r"[0-9](?:[\x20-]?[0-9])++"),
    ("phone", True, r"\+[0-9][\x20().0-9-]+[0-9]"),
    ("email", False, r"(?i)(?<![a-z0-9._%+-])[a-z0-9._%+-]{1,64}+\x20?(?:@|\(at\)|\[at\])\x20?[a-z0-9-]{1,63}+(?:\x20?(?:\.|\(dot\)|\[dot\])\x20?[a-z0-9-]{1,63}+){1,8}"),
    ("ip", False, r"(?<![0-9.])[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?![0-9.])"),
    ("card", False, r"(?<![0-9])[0-9]{13,19}(?![0-9])"),
    ("card", False, r"(?<![0-9])[0-9]{4}([\x20-])[0-9]{4}\1[0-9]{4}\1[0-9]{2,7}(?![0-9])"),
    ("phone", False, r"(?<![0-9+])(?:\+[0-9]{1,3}[\x20.-]?)?\(?[0-9]{3}\)?[\x20.-][0-9]{3}[\x20.-][0-9]{4}(?![0-9])"),
)
#: A text without this has no match; spares most texts the pattern.
NEEDED = {"email": "@|(?i)[(\\[]at[)\\]]", "ip": "[0-9]\\.[0-9]", "card": "[0-9]", "phone": "[0-9]"}
CONTEXT = 24
TOP_LEVEL = "(?i)(?:\\.|dot[)\\]])\\x20?[a-z]{2,24}$"
#: Words near a span that speak for a kind.
CUES = {
    "email": "(?i)mail|contact|write|@",
    "ip": "(?i)\\bip\\b|server|host|addr",
    "card": "(?i)card|visa|credit|pay|account",
    "phone": "(?i)phone|tel|call|fax|mobil|\\+",
}


#: A quoted key or token that is given to a name: counted, not a span of the four kinds.
SECRET = r"""[=:]\x20?["'][A-Za-z0-9_/+-]{20,}["']"""


def digits(c: Column) -> Column:
    return F.regexp_replace(c, "[^0-9]", "")


def luhn(number: Column) -> Column:
    """Whether the digits' Luhn sum is a multiple of ten."""
    figures = F.split(F.reverse(number), "")
    part = lambda d, i: F.when(i % 2 == 0, d).otherwise(F.when(d > 4, 2 * d - 9).otherwise(2 * d))
    values = F.transform(F.filter(figures, lambda x: x != ""), lambda x, i: part(x.cast("int"), i))
    return F.aggregate(values, F.lit(0), lambda a, x: a + x) % 10 == 0


def valid(kind: Column, match: Column) -> Column:
    """The base check of each kind."""
    octet = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"
    number = digits(match)
    n = F.length(number)
    return (
        F.when(kind == "email", match.rlike("^[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\\.[A-Za-z0-9-]++)++$"))
        .when(kind == "ip", match.rlike(f"^{octet}(?:\\.{octet}){{3}}$"))
        .when(kind == "card", F.when(n.between(14, 19), luhn(number)).otherwise(F.lit(False)))
        .otherwise(n.between(10, 15))
    )


def plausible(kind: Column, match: Column, ok: Column) -> Column:
    """Whether a span that may fail the base check is open: the trees decide it, nothing is known of it."""
    n = F.length(digits(match))
    return F.when(kind == "email", match.rlike(TOP_LEVEL)).when(kind == "card", n.between(13, 19) & luhn(digits(match))).otherwise(ok)


def proposals(text: Column, gen: int, kind: str, pattern: str) -> Column:
    """A generator's matches in order, with the distance from the last one's start and the context."""

    def rows(both: Column) -> Column:
        m, b = both["m"], both["b"]
        return F.transform(
            m,
            lambda x, i: F.struct(
                F.lit(gen).alias("gen"), F.lit(kind).alias("kind"), i.alias("ord"), x.alias("match"),
                (F.length(F.get(b, i)) + F.when(i > 0, F.length(F.get(m, i - 1))).otherwise(0)).cast("long").alias("advance"),
                F.right(F.get(b, i), F.lit(CONTEXT)).alias("before"), F.left(F.get(b, i + 1), F.lit(CONTEXT)).alias("after"),
            ),
        )

    both = F.struct(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("m"), F.split(text, pattern, -1).alias("b"))
    return F.when(text.rlike(NEEDED[kind]), F.get(F.transform(F.array(both), rows), F.lit(0)))


def candidates(docs: DataFrame, id_column: str = "doc_id") -> DataFrame:
    """One row per proposed span, and one with null gen for each document without any.

    rid tells rows of `docs` apart (ids may repeat or be null). start and end are code points.
    Offsets are running sums of piece lengths within a text, so the time is linear in the text and
    its matches; a text's spans, not its characters, are what moves between executors.
    """
    proposed = [proposals(F.col("_text"), g, kind, pattern) for g, (kind, _, pattern) in enumerate(GENERATORS)]
    empty = F.expr("array()").cast("array<struct<gen:int,kind:string,ord:int,match:string,advance:bigint,before:string,after:string>>")
    base = docs.select(F.col(id_column).alias("doc_id"), F.monotonically_increasing_id().alias("rid"), text_or_empty().alias("_text"))
    spans = F.concat(*[F.coalesce(p, empty) for p in proposed])
    secrets = F.when(F.col("_text").rlike("[\"']"), F.regexp_count("_text", F.lit(SECRET))).otherwise(F.lit(0)).cast("long")
    flat = base.select("doc_id", "rid", secrets.alias("n_secret"), spans.alias("s")).select("doc_id", "rid", "n_secret", F.explode_outer("s").alias("s")).select("doc_id", "rid", "n_secret", "s.*")
    flat = flat.repartition("rid")
    up_to = W.partitionBy("rid", "gen").orderBy("ord")
    end = F.sum("advance").over(up_to) + F.length("match")
    is_base = F.array(*[F.lit(b) for _, b, _ in GENERATORS])
    checked = F.coalesce(valid(F.col("kind"), F.col("match")), F.lit(False))
    flat = flat.withColumns({"ok": checked, "end": end}).withColumn("start", F.col("end") - F.length("match"))
    flat = flat.withColumn("base", F.coalesce(F.col("ok") & F.get(is_base, F.col("gen")), F.lit(False)))
    # A proposal that lies within a base span adds nothing.
    reach = W.partitionBy("rid").orderBy("start", F.col("end").desc(), F.col("base").desc(), "gen").rowsBetween(W.unboundedPreceding, W.currentRow)
    covered = F.coalesce(F.max(F.when(F.col("base"), F.col("end"))).over(reach) >= F.col("end"), F.lit(False))
    same = F.coalesce(F.max(F.col("base").cast("int")).over(W.partitionBy("rid", "kind", "start", "end")), F.lit(0)) == 1
    # A proposal that overlaps a base span of its kind has the wrong extent.
    by_kind = W.partitionBy("rid", "kind").orderBy("start")
    left = F.max(F.when(F.col("base"), F.col("end"))).over(by_kind.rangeBetween(W.unboundedPreceding, W.currentRow)) > F.col("start")
    # From the other end, as a frame that reaches to the last row is gone through anew for every row.
    from_end = W.partitionBy("rid", "kind").orderBy(F.desc("start"))
    right = F.min(F.when(F.col("base"), F.col("start"))).over(from_end.rangeBetween(W.unboundedPreceding, W.currentRow)) < F.col("end")
    misplaced = ~same & (F.coalesce(left, F.lit(False)) | F.coalesce(right, F.lit(False)))
    extra = ~F.coalesce(F.get(is_base, F.col("gen")), F.lit(True))
    return flat.select("doc_id", "rid", "n_secret", "gen", "kind", "start", "end", "match", "before", "after", "ok", "base", extra.alias("extra"), covered.alias("covered"), misplaced.alias("misplaced"), same.alias("is_base_span"))


def features() -> dict[str, Column]:
    """Discrete features of a span's shape and surroundings.

    Number ranges, top-level domains and plus signs only make the labels, so for addresses and
    phone numbers the trees learn from another view of a span than the one that labels it. The
    checksum of a card is a feature too, as it is what numbers of other than the base lengths share.
    """
    m, before, after = F.col("match"), F.col("before"), F.col("after")
    n = F.length(digits(m))
    cue = F.lit(False)
    for kind, words in CUES.items():
        cue = cue | ((F.col("kind") == kind) & (before.rlike(words) | after.rlike(words)))
    number = lambda c: c.cast("int")
    return {
        "kind": F.array_position(F.array(*map(F.lit, KINDS)), F.col("kind")).cast("int"),
        "digits": F.when(n < 10, 0).when(n < 13, 1).when(n == 13, 2).when(n <= 16, 3).when(n <= 19, 4).otherwise(5),
        "luhn": number((F.col("kind") == "card") & F.when(n.between(13, 19), luhn(digits(m))).otherwise(F.lit(False))),
        "separators": number(m.rlike("[\\x20().-]")),
        # Spelled out, plain, or with blanks round a plain sign: only the last is known to run too far.
        "signs": F.when(F.col("kind") != "email", 1).when(m.rlike("(?i)[(\\[](?:at|dot)[)\\]]"), 0).when(m.contains(" "), 2).otherwise(1),
        "edges": number(before.rlike("[\\w]$")) + 2 * number(after.rlike("^[\\w]")),
        "crowded": number(before.rlike("[0-9][^A-Za-z]{0,3}$") | after.rlike("^[^A-Za-z]{0,3}[0-9]")),
        "cue": number(cue),
    }


FEATURES = ("kind", "digits", "luhn", "separators", "signs", "edges", "crowded", "cue")


@dataclass(frozen=True)
class Node:
    """A split at feature <= cut, or a leaf."""

    value: float
    feature: str = ""
    cut: int = 0
    low: Node | None = None
    high: Node | None = None

    def column(self) -> Column:
        if self.low is None:
            return F.lit(self.value)
        return F.when(F.col("f_" + self.feature) <= self.cut, self.low.column()).otherwise(self.high.column())

    def apply(self, x: dict[str, np.ndarray]) -> np.ndarray:
        if self.low is None:
            return np.full(len(next(iter(x.values()))), self.value)
        return np.where(x[self.feature] <= self.cut, self.low.apply(x), self.high.apply(x))


def grow(x: dict[str, np.ndarray], gradient: np.ndarray, curvature: np.ndarray, depth: int, rate: float, ridge: float = 1.0) -> Node:
    """The tree of greatest second-order gain."""
    g, h = gradient.sum(), curvature.sum()
    leaf = Node(float(rate * g / (h + ridge)))
    best = (1e-6, None)
    for name, values in x.items() if depth else ():
        for cut in np.unique(values)[:-1]:
            low = values <= cut
            gl, hl = gradient[low].sum(), curvature[low].sum()
            gain = gl**2 / (hl + ridge) + (g - gl) ** 2 / (h - hl + ridge) - g**2 / (h + ridge)
            if gain > best[0]:
                best = (gain, (name, int(cut), low))
    if best[1] is None:
        return leaf
    name, cut, low = best[1]
    parts = [grow({k: v[p] for k, v in x.items()}, gradient[p], curvature[p], depth - 1, rate, ridge) for p in (low, ~low)]
    return Node(leaf.value, name, cut, *parts)


@dataclass(frozen=True)
class Model:
    """Boosted trees and the score a kind's span must reach."""

    trees: tuple[Node, ...]
    bias: float
    thresholds: dict[str, float]

    def score(self) -> Column:
        total = F.lit(self.bias)
        for t in self.trees:
            total = total + t.column()
        return total

    def accepted(self) -> Column:
        out = F.lit(False)
        for kind, least in self.thresholds.items():
            if math.isfinite(least):
                out = out | ((F.col("kind") == kind) & (F.col("score") >= least))
        return out


def fit(cells: list[dict], rounds: int = 40, depth: int = 3, rate: float = 0.3, precision: float = 0.95) -> Model:
    """Trees by second-order boosting of the logistic loss over cells (features, y, held, n)."""
    if not cells:
        return Model((), 0.0, {k: math.inf for k in KINDS})
    cells = sorted(cells, key=lambda c: tuple(c[k] for k in (*FEATURES, "y", "held")))
    x = {f: np.array([c[f] for c in cells]) for f in FEATURES}
    y, held, n = (np.array([c[k] for c in cells], dtype=float) for k in ("y", "held", "n"))
    weight = np.where(held == 1, 0.0, n)
    share = min(max((weight * y).sum() / max(weight.sum(), 1e-9), 1e-3), 1 - 1e-3)
    bias = math.log(share / (1 - share))
    score, trees = np.full(len(y), bias), []
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-score))
        tree = grow(x, weight * (y - p), weight * p * (1 - p), depth, rate)
        if tree.low is None:
            break
        trees.append(tree)
        score = score + tree.apply(x)
    thresholds = {}
    for k, kind in enumerate(KINDS, 1):
        own = (x["kind"] == k) & ((held == 1) | (weight.sum() == 0))
        thresholds[kind] = math.inf
        for least in np.unique(score[own & (y == 1)])[::-1]:
            at = own & (score >= least)
            if (n * y)[at].sum() >= precision * n[at].sum():
                thresholds[kind] = float(least)
    return Model(tuple(trees), bias, thresholds)


def with_features(found: DataFrame) -> DataFrame:
    return found.withColumns({"f_" + k: v for k, v in features().items()})


def learn(found: DataFrame) -> Model:
    """Fit on all proposals, labelled by their checks, by features of shape and surroundings: base spans count as right.

    Wrong are those of an extent that a base span of the kind refutes, and those that fail every
    check, the loose ones (top-level domain, Luhn sum of 13 to 19 digits) too. What passes a loose check, such as a
    spelled-out address, teaches nothing; the model decides it.
    """
    wrong = ~F.col("is_base_span") & (F.col("misplaced") | ~F.coalesce(plausible(F.col("kind"), F.col("match"), F.col("ok")), F.lit(False)))
    known = with_features(found.where(F.col("gen").isNotNull() & (F.col("is_base_span") | (wrong & (F.col("misplaced") | ~F.col("covered"))))))
    held = (F.pmod(F.xxhash64("doc_id"), F.lit(4)) == 0).cast("int")
    cells = known.groupBy(*["f_" + f for f in FEATURES], F.col("is_base_span").cast("int").alias("y"), held.alias("held")).agg(F.count("*").alias("n"))
    return fit([{k.removeprefix("f_"): v for k, v in r.asDict().items()} for r in cells.collect()])


def spans(found: DataFrame, model: Model) -> DataFrame:
    """Per row of the documents: base and accepted spans, each once, by start and then kind."""
    scored = with_features(found).withColumn("score", model.score())
    # A proposal needs both views: its loose checks and the score.
    likely = F.coalesce(plausible(F.col("kind"), F.col("match"), F.col("ok")), F.lit(False))
    kept = F.col("base") | (F.col("extra") & ~F.col("covered") & ~F.col("misplaced") & likely & model.accepted())
    order = F.array_position(F.array(*map(F.lit, KINDS)), F.col("kind")).cast("int")
    span = F.struct("start", order.alias("k"), "end", "kind")
    grouped = scored.groupBy("rid", "doc_id").agg(
        F.max("n_secret").alias("n_secret"),
        F.collect_set(F.when(F.col("base"), span)).alias("base"), F.collect_set(F.when(kept, span)).alias("all"),
        *[F.count_if(F.col("base") & (F.col("kind") == k)).alias("n_" + k) for k in KINDS],
    )
    return grouped.select("doc_id", *["n_" + k for k in KINDS], "n_secret", F.sort_array("base").alias("base"), F.sort_array("all").alias("all"))


def find(docs: DataFrame) -> DataFrame:
    """doc_id, n_<kind> of base spans, n_secret, and the arrays base and all of (start, k, end, kind).

    Whole texts are searched. Null text counts as empty; ids may be null or repeat, and every row
    of `docs` gives one row; an empty table gives none.
    """
    found = durable(candidates(docs))
    return spans(found, learn(found))


def joined(c: str) -> Column:
    return F.array_join(F.transform(F.col(c), lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def redact(docs: DataFrame, id_column: str = "doc_id") -> DataFrame:
    """The documents (unique ids) with every found span replaced by its kind in brackets; other columns as they are."""
    found = find(docs.select(F.col(id_column).alias("doc_id"), "text")).select(F.col("doc_id").alias("_pii_id"), F.col("all").alias("_pii_spans"))
    text = text_or_empty()
    first = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<string>").alias("out"))
    step = lambda a, s: F.when(
        s["end"] <= a["at"], a
    ).otherwise(F.struct(s["end"].alias("at"), F.concat(a["out"], F.array(F.substring(text, a["at"] + 1, F.greatest(s["start"] - a["at"], F.lit(0)).cast("int")), F.concat(F.lit("["), s["kind"], F.lit("]")))).alias("out")))
    done = F.aggregate("_pii_spans", first, step, lambda a: F.concat(F.array_join(a["out"], ""), F.substring(text, a["at"] + 1, F.length(text))))
    joined_ = docs.join(found, F.col(id_column) == F.col("_pii_id"), "left")
    return joined_.select(*[F.when(F.size(F.coalesce("_pii_spans", F.array())) > 0, done).otherwise(F.col("text")).alias("text") if c == "text" else docs[c] for c in docs.columns])
