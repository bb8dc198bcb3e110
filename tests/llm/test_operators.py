"""Each training-data operator against brute force on small tables with awkward rows."""

import hashlib
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from tessera.llm import decontamination, jaccard_join, line_dedup, linking, packing, pii, quality_classifier, quality_rules, substring_dedup, toxicity, url_filter
from tessera.llm.components import components

PATH = public_tokenizers.path("byte_bpe_50k.json")
SCHEMA = "doc_id long, text string, lang string, n_words long, score double"
LONG = " ".join(f"w{i % 97}x{i % 31}" for i in range(400))
ROWS = [
    (1, LONG), (2, LONG), (2, LONG), (3, LONG.replace("w5x5", "changed", 1)), (4, None), (5, ""), (6, "one"), (7, "one two three"), (None, LONG),
    (8, "Line of some words here now.\nLine of some words here now.\nother"), (9, "intro " + LONG[:700] + " outro"), (10, "a.b@c.de 10.0.0.1 300.1.1.1, 4111 1111 1111 1111 +1 (234) 555-6789 x"),
    (11, "tab\tand  two blanks\r\nend <|endoftext|> ünï 漢字 "), (12, LONG + "\n" + LONG[:900] + " tail"),
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, t, "en", 3, 0.5) for i, t in ROWS], SCHEMA)


def test_components(spark):
    edges = spark.createDataFrame([(5, 4), (4, 3), (3, 2), (9, 8), (7, 7), (None, 1)], "u long, v long")
    assert {tuple(r) for r in components(edges).collect()} == {(2, 2), (3, 2), (4, 2), (5, 2), (8, 8), (9, 8)}
    assert components(edges.limit(0)).count() == 0


def test_pii(docs):
    got = {r["doc_id"]: r for r in pii.find(docs).collect()}
    r = got[10]
    assert (r["n_email"], r["n_ip"], r["n_card"], r["n_phone"]) == (1, 1, 1, 1)
    assert [tuple(s)[0::2] for s in r["base"]][:2] == [(0, 8), (9, 17)]
    assert pii.find(docs).count() == len(ROWS) and pii.find(docs.limit(0)).count() == 0
    assert "[email] [ip] 300.1.1.1, [card] [phone]" in pii.redact(docs.where("doc_id = 10")).first()["text"]


def test_pii_beyond_the_base_form(spark):
    rows = [(i, f"mail user{i}@site{i % 7}.org. Then card 4111 1111 1111 1111, id 41111111111{i:02d}3 or x @ {i} now") for i in range(60)]
    rows += [(100, "write jane (at) example (dot) org soon"), (101, "card 4222222222222 here"), (102, "card 4222222222223 here"), (103, "mail a@b.org. Then more")]
    got = {r["doc_id"]: [tuple(s)[::2] + (s["kind"],) for s in r["all"]] for r in pii.find(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[100] == [(6, 33, "email")] and got[101] == [(5, 18, "card")]
    assert got[102] == [] and got[103] == [(5, 12, "email")]


def test_packing(docs):
    tok = Tokenizer.from_file(PATH)
    got = packing.pack_documents(docs, PATH, capacity=64).collect()
    ids = {i: [*(tok.encode(t, add_special_tokens=False).ids if t else []), 2] for i, t in ROWS}
    for r in got:
        own = ids[r["doc_id"]][r["start"] : r["start"] + r["length"]]
        assert len(own) == r["length"] and zlib.crc32(np.array(own, "<u4").tobytes()) == r["ids_crc32"]
    assert sum(r["length"] for r in got) == sum(len(ids[i]) for i, _ in ROWS)
    ends = Counter()
    for r in sorted(got, key=lambda r: (r["sequence_id"], r["offset"])):
        assert r["offset"] == ends[r["sequence_id"]]
        ends[r["sequence_id"]] += r["length"]
    assert max(ends.values()) <= 64 and len(ends) <= -(-sum(ends.values()) // 64) + 1
    assert packing.pack_documents(docs.limit(0), PATH).count() == 0


def test_plan_holds_each_length():
    rng = np.random.default_rng(3)
    demand = Counter(rng.integers(1, 1025, 5000).tolist())
    made, held = packing.plan(demand, 1024), Counter()
    for n, parts in made:
        assert sum(s * k for s, k in parts.items()) <= 1024
        held.update({s: n * k for s, k in parts.items()})
    assert held == demand
    assert sum(n for n, _ in made) <= 1.01 * sum(s * n for s, n in demand.items()) / 1024 + 1


def brute_groups(rows, k, percent):
    sets = {}
    for i, t in rows:
        w = re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode().lower())
        sets[i] = {tuple(w[a : a + k]) for a in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())
    parent = {i: i for i in sets}
    for _ in sets:
        for a in sets:
            for b in sets:
                if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                    parent[a] = parent[b] = min(parent[a], parent[b])
    return {i: (len(sets[i]), parent[i]) for i in sets}


def test_jaccard_join(docs):
    known = [(i, t) for i, t in ROWS if i is not None]
    got = jaccard_join.groups(docs, 3, 90).collect()
    assert len(got) == len(ROWS)
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got if r["doc_id"] is not None} == brute_groups(known, 3, 90)
    assert jaccard_join.groups(docs.limit(0)).count() == 0


@pytest.mark.parametrize("block", [1 << 20, 700])
def test_jaccard_join_of_many_near_copies(spark, monkeypatch, block):
    """Long lists, also dealt into several blocks; many copies do not link with their leader."""
    monkeypatch.setattr(jaccard_join, "BLOCK", block)
    monkeypatch.setattr(jaccard_join, "KEYS", block)
    rng = np.random.default_rng(9)
    rows = []
    for group in range(3):
        base = [f"g{group}w{i}" for i in range(90)]
        for i in range(25):
            own = list(base)
            for at in rng.integers(0, 90, rng.integers(0, 5)):
                own[at] = f"v{rng.integers(3)}"
            rows.append((len(rows), " ".join(own)))
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard_join.groups(spark.createDataFrame(rows, "doc_id long, text string"), 3, 90).collect()}
    expected = brute_groups(rows, 3, 90)
    assert got == expected and 5 < len({c for _, c in expected.values()}) < 60


def test_answers_by_difference_equal_whole_comparisons():
    rng = np.random.default_rng(1)
    base = np.arange(100, dtype=np.uint64)
    sets = [base] + [np.unique(np.concatenate([np.delete(base, rng.integers(0, 100, 7)), rng.integers(200, 206, 4).astype(np.uint64)])) for _ in range(40)]
    t = jaccard_join.Fraction(9, 10)
    found, _ = jaccard_join.linked(sets, [0] + [1] * 40, t)
    def closed(pairs):
        of = list(range(41))
        for _ in of:
            for a, b in pairs:
                of[a] = of[b] = min(of[a], of[b])
        return of
    near = [(a, b) for a in range(41) for b in range(a) if 10 * len(np.intersect1d(sets[a], sets[b])) >= 9 * len(np.union1d(sets[a], sets[b]))]
    assert closed(found) == closed(near) and len(set(closed(near))) > 2


def test_line_dedup(docs):
    got = {r["doc_id"]: r for r in line_dedup.dedup_lines(docs).collect()}
    assert got[8]["text"] == "Line of some words here now.\nother" and got[8]["n_removed"] == 1
    assert got[1]["text"] == LONG and got[4]["text"] is None and got[12]["n_removed"] == 1
    assert line_dedup.dedup_lines(docs.limit(0)).count() == 0


def test_line_dedup_takes_short_lines(spark):
    rows = [(1, "ab cd\n****\n\nend one"), (2, "AB  cd\n****\n\n-----"), (3, "ab ce\n***\n \n-----")]
    got = line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r["doc_id"]: r["text"] for r in got} == {1: rows[0][1], 2: "\n-----", 3: "ab ce\n***\n "}


def test_line_dedup_finds_edited_lines(spark):
    rng = np.random.default_rng(6)
    words = ["".join(rng.choice(list("aeinorst"), rng.integers(2, 9))) for _ in range(300)]
    lines = []
    for size in range(6, 36):
        line = list(rng.choice(words, size))
        at = int(rng.integers(size))
        typo = " ".join(line)
        lines += [" ".join(line), " ".join([*line[:at], "for", *line[at:]]), " ".join([*line[:at], str(rng.choice(words)), *line[at + 1 :]]), typo[: 3 * at] + "x" + typo[3 * at + 1 :]]
    docs = spark.createDataFrame(list(enumerate(lines)), "doc_id long, text string")
    a, b = docs.toDF("a", "x"), docs.toDF("b", "y")
    near = a.join(b, a["a"] < b["b"]).where("levenshtein(x, y) <= 0.2 * greatest(length(x), length(y)) + 1e-9 and least(length(x), length(y)) >= 20").select("a", "b").collect()
    first = {i: i for i in range(len(lines))}
    for _ in lines:
        for i, j in near:
            first[i] = first[j] = min(first[i], first[j])
    expected = {i for i, f in first.items() if f < i}
    got = {r["doc_id"] for r in line_dedup.removals(docs).collect()}
    assert len(expected) > 80 and got <= expected and len(got) >= 0.97 * len(expected)


def brute_substrings(rows, window):
    words = {i: re.findall(r"[^\x20\x09-\x0D]+", t or "") for i, t in rows}
    first = {}
    for i in sorted(words):
        for s in range(len(words[i]) - window + 1):
            first.setdefault(tuple(words[i][s : s + window]), i)
    out = {}
    for i, w in words.items():
        gone = {p for s in range(len(w) - window + 1) if first[tuple(w[s : s + window])] < i for p in range(s, s + window)}
        out[i] = (len(w), len(gone), hashlib.sha256(" ".join(x for p, x in enumerate(w) if p not in gone).encode()).hexdigest())
    return out


@pytest.mark.parametrize("group", [20_000, 1])
def test_substring_dedup(docs, group):
    got = substring_dedup.dedup_substrings(docs, group=group).collect()
    assert len(got) == len(ROWS)
    assert {r["doc_id"]: tuple(r)[1:] for r in got if r["doc_id"] is not None} == brute_substrings([r for r in ROWS if r[0] is not None], 50)


def test_decontamination(spark, docs):
    items = [(0, "alpha beta gamma delta epsilon zeta. Eta theta iota kappa."), (1, None), (2, "one"), (3, "mu nu xi omicron pi rho sigma tau")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    texts = spark.createDataFrame([(1, "x " * 300 + items[0][1] + " y" * 300), (2, items[3][1].upper()), (3, "alpha beta gamma"), (4, None)], "doc_id long, text string")
    assert {(r["doc_id"], r["item_id"]) for r in decontamination.find_leaks(texts, bench).collect()} == {(1, 0), (2, 3)}
    assert {r["doc_id"] for r in decontamination.decontaminate(texts, bench).collect()} == {3, 4}
    assert decontamination.find_leaks(docs, bench.limit(0)).count() == 0


@pytest.mark.parametrize("size", [128, 129, 130, 193, 257])
def test_item_at_the_end_is_found(size):
    item = "Alpha beta gamma delta epsilon zeta eta theta. Iota"
    index = decontamination.Index([(0, item)])
    assert index.half == 64
    assert index.leaks("x " * (size - 9) + item, 0.5, 0.5) == {0: (pytest.approx(1.0), 1.0, 1.0)}


def test_shards_share_statistics(spark):
    rng = np.random.default_rng(8)
    items = [(i, " ".join(rng.choice(["ab", "cd", "ef", "gh"], 3 + 5 * i))) for i in range(20)]
    bench = spark.createDataFrame(items, "item_id long, text string")
    (whole,) = decontamination.indexes(bench)
    shards = list(decontamination.indexes(bench, 5))
    text = " ".join(t for _, t in items[::3])
    one = {whole.ids[i]: found for i, found in whole.leaks(text, 0.5, 0.5).items()}
    many = {s.ids[i]: found for s in shards for i, found in s.leaks(text, 0.5, 0.5).items()}
    assert len(shards) == 4 and {s.half for s in shards} == {whole.half}
    assert many.keys() == one.keys() and all(many[k] == pytest.approx(one[k]) for k in one)


def test_shards_find_what_one_index_finds(spark):
    rng = np.random.default_rng(3)
    items = [(i, " ".join(rng.choice(["ab", "cd", "ef", "gh", "ij", "kl"], 12)) + ". The answer " + str(i)) for i in range(12)]
    bench = spark.createDataFrame(items, "item_id long, text string")
    texts = spark.createDataFrame([(i, "x " * i + t + " y" * i) for i, t in items] + [(99, "clean"), (98, None)], "doc_id long, text string")
    one, many = ({tuple(r) for r in decontamination.find_leaks(texts, bench, shard_items=n).select("doc_id", "item_id").collect()} for n in (100, 3))
    assert one == many and {(i, i) for i, _ in items} <= one
    assert {r["doc_id"] for r in decontamination.decontaminate(texts, bench, shard_items=3).collect()} == {98, 99}


def test_retrieval_is_exact():
    rng = np.random.default_rng(5)
    vocabulary = [f"t{i}" for i in range(30)]
    index = decontamination.Index([(i, " ".join(rng.choice(vocabulary, 12))) for i in range(60)])
    for _ in range(50):
        words = list(rng.choice(vocabulary, 40))
        pairs = set(zip(words, words[1:]))
        scores = Counter()
        for p in pairs:
            for i, x in zip(*index.postings.get(p, ((), ()))):
                scores[i] += x
        assert {i for i, _ in index.retrieve(pairs, 0.2)} == {i for i, x in scores.items() if x >= 0.2}


def test_quality_rules(docs):
    got = {r["doc_id"]: r for r in quality_rules.judge(docs, [(quality_rules.Test("words", False, 50.0),)]).collect()}
    for i, t in ROWS:
        w = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        grams = Counter(tuple(w[s : s + 5]) for s in range(len(w) - 4))
        again = {p for s in range(len(w) - 4) if grams[tuple(w[s : s + 5])] > 1 for p in range(s, s + 5)}
        lines = [x for x in (t or "").split("\n") if x.strip()]
        r = got[i]
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t or "")), len(lines) - len(set(lines)), len(again))
        assert r["base_failed"] == (len(w) < 10 or 100 * len(again) > 20 * len(w)) and (not r["kept"] or len(w) >= 50)


def test_rules_are_learned():
    rng = np.random.default_rng(2)
    symbols, other = rng.random(900), rng.random(900)
    rules = quality_rules.learn({"symbols": symbols, "words": other}, symbols > 0.8)
    assert rules and rules[0][0].feature == "symbols" and rules[0][0].above


@pytest.mark.parametrize("module", [quality_classifier, toxicity])
def test_classifiers(module):
    rng = np.random.default_rng(4)
    plain = [" ".join(rng.choice(["river", "stone", "window", "paper", "garden"], 30)) for _ in range(90)]
    marked = [t + " " + " ".join(rng.choice(["vilest", "wretch"], 4)) for t in plain[:45]]
    model = module.fit(plain + marked, [0] * 90 + [1] * 45)
    fresh = " ".join(rng.choice(["river", "stone", "window"], 30))
    assert model.score(fresh + " vilest wretch vilest wretch") > 0.7 > model.score(fresh)
    assert 0 <= model.score("") <= 1 and module.fit([], []).score("x") == 0.5


def test_url_filter(spark):
    rows = [(1, "http://A.example.org/es/1", None), (2, "https://x.com/fr/2?q", '<a href="https://y.net/z">'), (3, "https://y.net/de/", None), (4, None, None), (5, "nohost", ""), (6, "http://bad.com/de/1", ""), (7, "http://bad.com/p", "")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r["page_id"]: tuple(r)[1:] for r in url_filter.judge_urls(pages).collect()}
    assert got[1] == ("a.example.org", "/es/1", "example.org/es/", "block")
    assert got[2] == ("x.com", "/fr/2", "com/fr/", "allow")
    assert got[3] == ("y.net", "/de/", None, "allow") and got[4] == ("", "", None, "allow") == got[5]
    assert got[7] == ("bad.com", "/p", None, "block")
    scores = {r["host"]: r for r in url_filter.host_scores(pages).collect()}
    assert scores["y.net"]["trust"] == pytest.approx(0.15 * 0.85)


def test_pipeline_stages(spark, docs):
    import corpus_pipeline

    rows = docs.select("doc_id", "text", "lang").where("doc_id is not null").selectExpr("*", "'s' source", "length(text) n_chars")
    kept = corpus_pipeline.keep_one_of_near_copies(spark, corpus_pipeline.dedup_lines(spark, rows, ""), "")
    assert kept.columns == rows.columns and {1, 4, 5, 6, 7, 10} <= {r["doc_id"] for r in kept.collect()}


def test_bound_of_edit_distance_never_exceeds_it():
    rng = np.random.default_rng(3)
    pairs = []
    for size in (20, 63, 64, 65, 130, 300):
        for edits in (0, 3, size // 6, size // 5, size // 3):
            a = list(rng.choice(list("aeinorst äß漢"), size))
            b = list(a)
            for at in rng.integers(0, size - edits, edits):
                b[at : at + int(rng.integers(2))] = [str(x) for x in rng.choice(list("xyz"), int(rng.integers(2)))]
            pairs.append(("".join(a), "".join(b)))
        pairs += [tuple("".join(rng.choice(list("aeinorst "), size)) for _ in "uv") for _ in range(20)]
    pool = line_dedup.Pool([x for x, _ in pairs] + [y for _, y in pairs])
    at, most = np.arange(len(pairs)), line_dedup.limits(pool.lengths[: len(pairs)], pool.lengths[len(pairs) :], 0.8)
    exact = np.array([line_dedup.distance_within(x, y, int(m)) for (x, y), m in zip(pairs, most)])
    maybe = pool.maybe_within(at, at + len(pairs), most)
    assert (maybe >= exact).all() and exact.sum() > 15 and maybe.sum() < 50


@pytest.mark.parametrize("block,together", [(1 << 12, 1 << 14), (7, 5)])
def test_long_lists_are_compared_without_rows_for_their_pairs(spark, monkeypatch, block, together):
    """Lines that share a list and are no leader's copies; only links leave the tasks, whatever the blocks."""
    monkeypatch.setattr(line_dedup, "TOGETHER", together)
    rng = np.random.default_rng(8)
    lines = []
    for _ in range(15):
        base = "".join(rng.choice(list("aeinorst "), 90))
        lines += [base, *(base[: 6 * k] + "xx" + base[6 * k :] for k in range(1, 4))]
    marks, _, _ = line_dedup.sketches(lines, 0)
    # SimHashes of all are made near, so that the edit distance decides.
    marks = np.broadcast_to(marks[:1], marks.shape)
    nodes = spark.createDataFrame([(i, len(x), int(m[0]), int(m[1]), x) for i, (x, m) in enumerate(zip(lines, marks))], "id long, n int, s0 long, s1 long, text string")
    long = spark.createDataFrame([(k, -1, i) for k in (1, 2) for i in range(len(lines))], "key long, leader long, id long")
    groups = spark.createDataFrame([(0, 0), (1, 0)], "node long, component long")
    dealt = linking.rest(long, nodes, groups, nodes.drop("n"), block, 1 << 21)
    got = dealt.mapInArrow(lambda x: line_dedup.links_of_blocks(x, 0.8), "u long, v long").distinct().collect()
    of = list(range(len(lines)))
    for _ in lines:
        for u, v in [(0, 1), *((r["u"], r["v"]) for r in got)]:
            of[u] = of[v] = min(of[u], of[v])
    assert of == [i // 4 * 4 for i in range(len(lines))]
    assert len(got) <= 2 * len(lines) if block > len(lines) else len(got) <= 15 * 6


def test_pairs_of_several_long_lists_are_compared_once(monkeypatch):
    """Pairs of unlinked lines that several lists hold, and pairs of one list only."""
    rng = np.random.default_rng(31)
    lines = ["".join(rng.choice(list("aeinorst "), 300)) for _ in range(12)]
    held = {1: range(6), 2: range(12), 3: range(3, 12)}
    rows = [{"key": key, "i": 0, "j": 0, "at": 0, "g": i, "keys": [k for k in (3, 1, 2) if i in held[k]], "id": i, "s0": 0, "s1": 0, "text": lines[i]} for key in held for i in held[key]]
    asked, add = [], line_dedup._Links.add

    def noted(self, texts, ids, groups, u, v):
        asked.extend(tuple(sorted(p)) for p in zip(ids[u].tolist(), ids[v].tolist()))
        add(self, texts, ids, groups, u, v)

    monkeypatch.setattr(line_dedup._Links, "add", noted)
    assert sum(b.num_rows for b in line_dedup.links_of_blocks(iter(pa.Table.from_pylist(rows).to_batches()), 0.8)) == 0
    assert sorted(asked) == [(i, j) for i in range(12) for j in range(i + 1, 12)]


def test_sieve_of_character_pairs_loses_no_link():
    rng = np.random.default_rng(12)
    lines = []
    for size in (20, 33, 60, 96):
        for edits in (0, size // 8, size // 5, size // 5 + 1, size // 3):
            a = list(rng.choice(list("aeinorst äß漢"), size))
            b = list(a)
            for at in rng.choice(size - edits, edits, replace=False).tolist():
                b[at : at + int(rng.integers(2))] = ["x"]
            lines += ["".join(a), "".join(b), "".join(rng.choice(list("aeinorst "), size))]
    n = np.array([len(x) for x in lines])
    rows = pa.table({"key": [1] * len(lines), "keys": [[1]] * len(lines)})
    u, v = (x.ravel() for x in np.meshgrid(np.arange(len(lines)), np.arange(len(lines))))
    left = line_dedup._Sieve(rows, lines, n, 0.8).left(u, v)
    most = line_dedup.limits(n[u], n[v], 0.8)
    exact = np.array([line_dedup.distance_within(lines[i], lines[j], int(m)) for i, j, m in zip(u.tolist(), v.tolist(), most)])
    assert (left >= exact).all() and exact.sum() > len(lines) and left.sum() < len(u) / 4
