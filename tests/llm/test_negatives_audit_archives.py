"""Hard negatives, the source audit and packaged archives against brute force, with awkward rows."""

import hashlib
import io
import math
import re
import zipfile
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tessera.llm import hard_negatives, source_audit, warc

VECTORS = "vec_id long, embedding array<float>, label int, id string, score double, w int"


def mined(rows, anchor, positives=5, negatives=10):
    """By brute force; rows of (id, vector, label)."""
    usable = []
    for i, v, y in rows:
        if i is not None and y is not None and v is not None and all(x is not None and math.isfinite(x) for x in v):
            usable.append((i, [math.floor(256 * float(np.float32(x))) for x in v], y))
    out, seen = [], set()
    for i, v, y in sorted(usable, key=lambda r: (r[0], r[2], r[1])):
        if not anchor(i) or i in seen:
            continue
        seen.add(i)
        scored = [(-sum(a * b for a, b in zip(v, w)), j, z == y) for j, w, z in usable if j != i]
        for s, p in dict.fromkeys((-s, j) for s, j, _ in sorted(t for t in scored if t[2])[:positives]):
            found = sorted((t, j) for t, j, same in scored if not same and 30 * s <= -100 * t <= 90 * s)
            out += [(i, p, r + 1, j, s, -t) for r, (t, j) in enumerate(found[:negatives])]
    return sorted(out)


def vectors_of(seed=1, n=500):
    rng = np.random.default_rng(seed)
    rows = []
    for i in range(n):
        v = rng.normal(size=6)
        rows.append((i * 3 - 200, [float(x) for x in v / np.linalg.norm(v)], int(rng.integers(4))))
    hot = [0.6, 0.0, 0.5, 0.1, 0.2, 0.3]
    rows += [(10_000 + i, hot, i % 2) for i in range(300)]  # many ties
    rows += [(7, None, 1), (8, [0.1, None, 0.2], 1), (9, [float("nan")] * 6, 2), (10, [float("inf")] * 6, 2), (11, [0.5] * 6, None), (None, [0.5] * 6, 1), (12, [], 3), (400, [0.4, 0.3], 2)]
    return rows + [(10_000, hot, 1), (400, [0.4, 0.3], 2), (1 << 62, hot, 3), (-(1 << 62), hot, 3)]


def frame(spark, rows):
    return spark.createDataFrame([(i, v, y, "x", 0.5, 1) for i, v, y in rows], VECTORS).repartition(5)


@pytest.mark.parametrize("block", [2048, 7])
def test_hard_negatives_equal_brute_force(spark, block):
    rows = vectors_of()
    got = hard_negatives.mine(frame(spark, rows), F.col("vec_id") % 20 == 0, block=block)
    assert sorted(tuple(r) for r in got.collect()) == mined(rows, lambda i: i % 20 == 0)
    assert got.schema.simpleString() == "struct<anchor_id:bigint,positive_id:bigint,rank:int,negative_id:bigint,positive_score:bigint,negative_score:bigint>"


def test_hard_negatives_refine_ids_and_large_scores(spark):
    rows = [(i, [1.0, 0.0], 0) for i in range(0, 4000, 2)] + [(i, [0.5, 0.3], 1) for i in range(-1501, 2500, 2)] + [(-5000, [2.0**15, 2.0**17], 0), (-6000, [2.0**16, 2.0**16], 0), (-7001, [2.0**15, 2.0**15], 1)]
    anchor = lambda i: i % 1000 == 0
    got = hard_negatives.mine(frame(spark, rows), F.col("vec_id") % 1000 == 0)
    assert sorted(tuple(r) for r in got.collect()) == mined(rows, anchor)


def test_hard_negatives_of_nothing(spark):
    empty = frame(spark, vectors_of()).limit(0)
    assert hard_negatives.mine(empty, F.col("vec_id") % 20 == 0).count() == 0
    assert hard_negatives.mine(frame(spark, [(1, [1.0], 1), (2, [0.5], 2)]), F.col("vec_id") == 1).count() == 0


def test_buckets_keep_the_order():
    w = hard_negatives.Windows(np.array([0]), np.array([hard_negatives.BITS[0]]), np.array([(1 << 63) - 1]), np.array([3]), np.array([0]), np.array([0]))
    values = np.array([-(1 << 62), -5, -1, 0, 1, 2, 3, 4, 1 << 40, (1 << 62) + 5], dtype=np.int64)
    assert (np.diff(w.bucket(0, values, values)) <= 0).all()
    w.narrow(0, int(w.bucket(0, values[7:8], values[7:8])[0]), 1, 500)
    assert (w.low[0], w.high[0], w.left[0], w.by[0]) == (4, 7, 2, 1)


TEXTS = "doc_id long, text string, lang string, source string, term string, n int, total int"


def audited(rows, least=3, top=200):
    """By brute force; rows of (text, lang, source)."""
    counts, holding, groups = defaultdict(Counter), defaultdict(Counter), set()
    for text, lang, source in rows:
        lang, source = lang or "", source or ""
        terms = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        groups.add((lang, source))
        counts[lang, source].update(terms)
        holding[lang].update(set(terms))
    out = []
    for lang, source in groups:
        kept = {t for t, n in holding[lang].items() if n >= least}

        def shares(sources, kept=kept, lang=lang):
            n = Counter()
            for s in sources:
                n.update({t: c for t, c in counts[lang, s].items() if t in kept})
            return n, {t: 1 + 10**9 * (n[t] + 1) // (n.total() + len(kept)) for t in kept}

        others = [s for x, s in groups if x == lang]
        n, p = shares([source])
        for part in ("pair", "term"):
            if part == "pair":
                found = [(-sum((p[t] - q[t]) ** 2 // q[t] for t in kept), s.encode()) for s in others if s != source for q in [shares([s])[1]]]
            else:
                q = shares(others)[1]
                found = sorted((-((p[t] - q[t]) ** 2 // q[t]), t.encode()) for t in kept if n[t] and p[t] > q[t])[:top]
            out += [(lang, source, part, item.decode(), -v, r + 1) for r, (v, item) in enumerate(sorted(found))]
    return sorted(out)


def test_source_audit_equals_brute_force(spark):
    rng = np.random.default_rng(4)
    words = ["Alpha", "beta", "Émile", "émile", "漢字", "x", "ÀB", "gamma", "DELTA", "delta", "\U0001f600", *[f"w{chr(97 + i)}" for i in range(20)]]
    rows = [(" ".join(rng.choice(words, 30, p=None)) + f" only{i}", ["en", "de", None][i % 3], f"s{i * i % 5}") for i in range(90)]
    rows += [(None, "en", "silent"), ("", None, None), ("12 34\x01\x7f!", "fr", "a"), ("12", "fr", "b"), ("lone", "it", "z"), ("alpha alpha " * 30_000, "en", "s1"), ("alpha", "en", "s1"), ("alpha", "en", "s1")]
    docs = spark.createDataFrame([(i, *r, "x", 1, 2) for i, r in enumerate(rows)], TEXTS)
    for least, top in ((3, 200), (1, 4), (1000, 200)):
        got = sorted(tuple(r) for r in source_audit.audit(docs, least, top).collect())
        assert got == audited(rows, least, top)
    assert source_audit.audit(docs.limit(0)).count() == 0


@pytest.mark.parametrize("held", [1 << 19, 4])
def test_terms_are_counted_within_tasks(monkeypatch, held):
    """A task gives on counts and not words, and never holds more than so many."""
    monkeypatch.setattr(source_audit, "HELD", held)
    rows = [("en", s, t) for s in ("a", "b") for t in ("One two\x00TWO\x7ftwo", "two;\x0bÉa éa\u00a0x 7", "")] * 3
    batch = pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*rows)], ["lang", "source", "text"])
    out = [r for b in source_audit.counted(iter([batch, batch])) for r in b.to_pylist()]
    n, n_docs = Counter(), Counter()
    for r in out:
        n[r["source"], r["term"]] += r["n"]
        n_docs[r["source"], r["term"]] += r["n_docs"]
    expected = {"one": (6, 6), "two": (24, 12), "Éa": (6, 6), "éa\u00a0x": (6, 6)}
    assert {k: (n[k], n_docs[k]) for k in n} == {(s, t): x for s in "ab" for t, x in expected.items()}
    assert len(out) == 8 if held > 8 else len(out) > 8


def test_shares_beyond_longs(spark):
    for n, total in ((8, 20), (9_000_000_000, 9_000_000_001), (12_000_000_000_000, 40_000_000_000_000)):
        row = spark.range(1).select(F.lit(n).cast("long").alias("n"), F.lit(total).cast("long").alias("t")).selectExpr(f"{source_audit.share('n', 't')} as p").first()
        assert row["p"] == 1 + 10**9 * (n + 1) // total


PAGES = "page_id long, url string, html string, payload binary, record_type string, last int"


@pytest.fixture(scope="module")
def pages(spark):
    long = "<html>" + "ü漢" * 300 + "</html>"
    rows = [(1, "http://a.org/1", long), (5, "http://a.org/2", long), (3, None, long), (None, "http://a.org/n", long), (5, "http://b.org/2", long), (2, "x", "short"), (4, "x", "short"), (6, "evil\r\nWARC-Type: x é", None), (7, "u", ""), (8, "v", "y" * 3_000_000), (9, "v", "z" * 1000), (10, "v", "z" * 1000), (11, "v", "q\r\n\r\nWARC/1.1")]
    rows += [(100 + i, f"http://h/{i}", "copy " * 400) for i in range(700)]
    rows += [(None, "n", "m" * 2000), (None, "n", "m" * 2000)]
    return rows, spark.createDataFrame([(*r, None, "x", 1) for r in rows], PAGES).repartition(3)


def judged(rows):
    payload = lambda h: (h or "").encode()
    last = {}
    for i, _, h in rows:
        if len(payload(h)) >= 1000 and i is not None:
            last[payload(h)] = max(i, last.get(payload(h), i))
    out = []
    for i, _, h in rows:
        m = last.get(payload(h))
        again = m is not None and i != m
        out.append((i, len(payload(h)), hashlib.sha1(payload(h)).hexdigest(), "revisit" if again else "response", m if again else None))
    return sorted(out, key=str)


def test_archived_pages_come_back(pages):
    rows, df = pages
    assert sorted((tuple(r) for r in warc.archive_pages(df).collect()), key=str) == judged(rows)
    assert warc.archive_pages(df.limit(0)).count() == 0


def test_joins_by_salt_give_the_same(pages):
    _, df = pages
    columns = ("page_id", "payload_digest", "refers_to")
    a, b = (sorted((tuple(r) for r in warc.with_revisits(df, most_broadcast=n).select(*columns).collect()), key=str) for n in (200_000, 0))
    assert a == b


@pytest.fixture(scope="module")
def archive(spark, pages, tmp_path_factory):
    folder = tmp_path_factory.mktemp("wacz")
    warc.write_archives(warc.with_revisits(pages[1]), f"file://{folder}")
    return folder


def test_ranges_of_an_archive_give_each_record_once(spark, pages, archive):
    found = warc.archives_in(spark, str(archive))
    whole = sorted((r["archive"], r["offset"], r["payload_digest"]) for r in warc.read_records(found).collect())
    parts = sorted((r["archive"], r["offset"], r["payload_digest"]) for r in warc.read_records(found, share=1500).collect())
    assert whole == parts and len(whole) == len(pages[0])
    kept = warc.read_records(found).where("record_id = '<urn:x-page:6>'").first()
    assert kept["payload"] == b"" and kept["target_uri"] == "evil%0D%0AWARC-Type:%20x%20%C3%A9" and kept["fault"] is None


def members(path):
    data = path.read_bytes()
    return data, warc.directory(lambda o, n: data[o : o + n], len(data))


def test_directory_agrees_with_zipfile(archive, tmp_path):
    for path in archive.glob("*.wacz"):
        data, found = members(path)
        with zipfile.ZipFile(path) as z:
            assert [(m.name, m.size, m.packed, m.header) for m in found] == [(i.filename, i.file_size, i.compress_size, i.header_offset) for i in z.infolist()]
            m = warc.located(lambda o, n, data=data: data[o : o + n], found[0])
            assert data[m.start : m.start + m.packed] == z.read(m.name)
    # ZIP64 records: sizes and offsets that 32 bits cannot hold stand in extra fields, counts in a record of their own.
    name, full = b"archive/data.warc", (1 << 33) + 5
    extra = warc.struct.pack("<HHQQQ", 1, 24, full, full, 0)
    entry = warc.ENTRY + warc.struct.pack("<HHHHHHIIIHHHHHII", 45, 45, 0, 0, 0, 0, 0, warc.FULL32, warc.FULL32, len(name), len(extra), 0, 0, 0, 0, warc.FULL32) + name + extra
    end64 = warc.END64 + warc.struct.pack("<QHHIIQQQQ", 44, 45, 45, 0, 0, 1, 1, len(entry), 10)
    tail = warc.LOCATOR64 + warc.struct.pack("<IQI", 0, 10 + len(entry), 1) + warc.END + warc.struct.pack("<HHHHIIH", 0, 0, warc.FULL16, warc.FULL16, warc.FULL32, warc.FULL32, 0)
    file = b"\0" * 10 + entry + end64 + tail
    (m,) = warc.directory(lambda o, n: file[o : o + n], len(file))
    assert (m.name, m.size, m.packed, m.header) == (name.decode(), full, full, 0)
    with pytest.raises(ValueError):
        warc.directory(lambda o, n: b"no archive at all"[o : o + n], 17)


def test_foreign_archives(spark, archive, tmp_path):
    source = max(archive.glob("*.wacz"), key=lambda p: p.stat().st_size)
    with zipfile.ZipFile(source) as z:
        data = z.read(warc.DATA)
    plain = b"".join(text for _, text in warc.streamed(lambda o, n: data[o : o + n], warc.Member("x.gz", 0, len(data), len(data), 0, 0)))
    variants = {"noindex": (warc.DATA, data, zipfile.ZIP_STORED), "packed": (warc.DATA, data, zipfile.ZIP_DEFLATED), "plain": ("archive/data.warc", plain, zipfile.ZIP_DEFLATED)}
    want = sorted(r["payload_digest"] for r in warc.read_records(warc.archives_in(spark, str(source))).collect())
    for kind, (name, body, method) in variants.items():
        path = tmp_path / f"{kind}.wacz"
        buffer = io.BytesIO()
        with zipfile.ZipFile(buffer, "w", method) as z:
            z.writestr(name, body)
        path.write_bytes(b"#!prefix\n" * (kind == "noindex") + buffer.getvalue())
        got = warc.read_records(warc.archives_in(spark, str(path)), share=5000)
        assert sorted(r["payload_digest"] for r in got.collect()) == want, kind


def test_damage_is_told(spark, archive, tmp_path):
    whole = b"WARC/1.1\r\nWARC-Type: response\r\nWARC-Payload-Digest: sha1:" + b"A" * 32 + b"\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n"
    assert warc.parsed(whole)["fault"] == "digest"
    assert warc.parsed(whole[:-5])["fault"] == "truncated"
    assert warc.parsed(b"nonsense")["fault"] == "form" and warc.parsed(b"")["fault"] == "form"
