"""Ranked search, repeated lines and the source audit against plain Python."""

import hashlib
import math
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from llm_rows import local_rows
from pyspark.sql import functions as F

from tablequill.llm import bloom, bloom_lines, prefix_audit, rmq_search, terms

UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
DOCS = "doc_id long, text string, lang string, source string"


def _terms(text, pattern=r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"):
    return re.findall(pattern, (text or "").translate(UPPER))


# --- search ---------------------------------------------------------------------


def _ranked(docs, items, k):
    words = [(i, Counter(_terms(t))) for i, t in docs]
    n_docs = sum(bool(w) for _, w in words)
    n_terms = sum(sum(w.values()) for _, w in words)
    df = Counter(t for _, w in words for t in w)
    out = []
    for item, text in items:
        scores = []
        asked = Counter(_terms(text))
        for doc, w in words:
            n, score = sum(w.values()), 0
            for t in asked.keys() & w.keys():
                weight = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1)))
                m = 25 + 75 * n * n_docs // n_terms
                score += asked[t] * weight * (1_000_000_000 * w[t] // (1000 * w[t] + 8 * m))
            if score > 0:
                scores.append((-score, doc is None, doc or 0, doc))
        out += [(item, r, d, -s) for r, (s, _, _, d) in enumerate(sorted(scores)[:k], 1)]
    return sorted(out, key=str)


def _found(df):
    return sorted(((r["item_id"], r["rank"], r["doc_id"], r["score"]) for r in df.collect()), key=str)


ITEMS = [
    (0, "word1 tells2 story3 WORD1"), (1, "no id here"), (2, "long end"), (3, ""), (4, None),
    (5, "unheard-of"), (None, "wörter 日本"), (6, "one two three same"), (6, "one two three same"),
]


@pytest.mark.parametrize("small", [False, True])
def test_search_equals_brute_force(spark, odd, monkeypatch, small):
    if small:
        for module, name, value in [
            (terms, "SEGMENT_DOCUMENTS", 2), (rmq_search, "LEAF", 1), (rmq_search, "CHUNK_TERMS", 5),
            (rmq_search, "PROBES", 1),
        ]:
            monkeypatch.setattr(module, name, value)
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    for k in (1, 3, 10):
        found = rmq_search.search(rmq_search.build(odd), items, k=k)
        assert found.columns == ["item_id", "rank", "doc_id", "score"]
        docs = [(r["doc_id"], r["text"]) for r in odd.collect()]
        assert _found(found) == _ranked(docs, ITEMS, k)


def test_search_many_documents_with_ties(spark, monkeypatch):
    """Copies with equal scores over several segments: the smallest ids win."""
    rng = np.random.default_rng(5)
    words = [f"w{i}" for i in range(40)]
    docs = [(i, " ".join(rng.choice(words, rng.integers(1, 30)))) for i in range(700)]
    docs += [(2000 - i, "w1 w2 w3 w4") for i in range(60)]
    items = [(i, " ".join(rng.choice(words, 8))) for i in range(12)] + [(99, "w1 w2 w3 w4")]
    monkeypatch.setattr(terms, "SEGMENT_DOCUMENTS", 90)
    monkeypatch.setattr(rmq_search, "LEAF", 4)
    frame = spark.createDataFrame(docs, "doc_id long, text string").repartition(5)
    found = rmq_search.search(rmq_search.build(frame), spark.createDataFrame(items, "item_id long, text string"))
    assert _found(found) == _ranked(docs, items, 10)


def test_search_leaves_most_documents_unscored(spark):
    """A floor above every bound closes a segment after its first bound."""
    import pyarrow as pa

    n = 4000
    lists = pa.table({"term": ["a", "b"], "docs": [list(range(n)), list(range(0, n, 2))],
                      "counts": [[1] * n, [1] * (n // 2)]})
    held = rmq_search._Lists(lists, np.full(n, 10), n, 10 * n)
    chosen, weights = np.array([0, 1]), np.array([1, 3])
    best = rmq_search._best(held, chosen, weights, 3, -1, 0, n)
    assert sorted(-p for _, p in best) == [-4, -2, 0]
    top = best[0][0]
    assert rmq_search._best(held, chosen, weights, 3, top + 1, 0, n) == []
    # of equal scores only places before the floor's count
    assert sorted(p for _, p in rmq_search._best(held, chosen, weights, 3, top, 0, 3)) == [0, 2]


def test_search_of_nothing(spark, nothing, odd):
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    assert rmq_search.op11_rows(nothing, items).count() == 0
    assert rmq_search.op11_rows(odd, items.limit(0)).count() == 0


# --- lines ----------------------------------------------------------------------


def _lines(texts, min_docs, min_chars=1):
    keys = [[line.strip(" \t\n\x0b\x0c\r").translate(UPPER) for line in (t or "").split("\n")] for t in texts]
    docs = Counter(k for ks in keys for k in set(ks) if len(k) >= min_chars)
    out = []
    for text, ks in zip(texts, keys):
        lines = (text or "").split("\n")
        kept = [x for x, k in zip(lines, ks) if not (len(k) >= min_chars and docs[k] >= min_docs)]
        out.append((len(lines), len(lines) - len(kept), "\n".join(kept)))
    return out


LINES = [
    "Home\n  about \nfirst own line", "HOME\nabout\r\nsecond", "home", "", None, "\n\n", "home\nhome\nabout",
    " \t\n x", "X\nÄbc", "äbc\nÄbc", "no end\n", "ab\nhome \x0b", "日本\n語", "日本",
    "home\n" * 3000 + "long text " * 20_000,
]


def _frame(spark, texts):
    rows = [(i % 7, t, "x", "y") for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, kept string, row string").repartition(4)


@pytest.mark.parametrize("limit", [bloom_lines.BROADCAST_BYTES, -1])
@pytest.mark.parametrize("min_docs,min_chars", [(2, 1), (3, 1), (2, 3), (10, 1)])
def test_lines_equal_brute_force(spark, monkeypatch, limit, min_docs, min_chars):
    monkeypatch.setattr(bloom_lines, "BROADCAST_BYTES", limit)
    monkeypatch.setattr(bloom, "LEAST_BITS", 1 << 12)
    df = bloom_lines.without_repeated_lines(_frame(spark, LINES), min_docs=min_docs, min_chars=min_chars)
    found = [(r["row"]["text"], *r["kept"]) for r in local_rows(df)]
    wanted = [(t, *x) for t, x in zip(LINES, _lines(LINES, min_docs, min_chars))]
    assert sorted(found, key=str) == sorted(wanted, key=str)


def test_first_line_stays(spark):
    rows = [(3, "a\nb\na"), (1, "A\nc"), (2, "a\nb"), (None, "b")]
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    kept = bloom_lines.drop_repeated_lines(frame, min_docs=2, keep_first=True, order="doc_id")
    found = {(r["doc_id"], r["text"]) for r in kept.collect()}
    assert found == {(1, "A\nc"), (2, "b"), (3, ""), (None, "")}


def test_full_filters_change_nothing(spark, monkeypatch):
    """Far more keys than bits: every line is suspected, the rows are the same."""
    monkeypatch.setattr(bloom, "LEAST_BITS", 64)
    monkeypatch.setattr(bloom, "MAX_BITS", 64)
    texts = [f"line {i % 50}\nown {i}" for i in range(300)]
    found = local_rows(bloom_lines.without_repeated_lines(_frame(spark, texts), min_docs=6))
    assert sorted(r["kept"]["kept"] for r in found) == sorted(x[2] for x in _lines(texts, 6))


def test_merged_filters_hold_every_repeated_line(spark):
    texts = [f"line {i}\nshared {i % 400}" for i in range(800)]
    packed = bloom_lines.twice_filter(_frame(spark, texts).select("text"))
    data = np.frombuffer("\n".join(f"shared {i}" for i in range(400)).encode(), np.uint8)
    lines = bloom_lines.Lines(data, np.array([0, len(data)]), 1)
    assert bloom.holds(packed, lines.hashes).all()
    data = np.frombuffer("\n".join(f"line {i}" for i in range(800)).encode(), np.uint8)
    lines = bloom_lines.Lines(data, np.array([0, len(data)]), 1)
    assert bloom.holds(packed, lines.hashes).mean() < 0.05


def test_lines_of_odd_documents(spark, odd, nothing):
    found = bloom_lines.op12_rows(odd)
    texts = [r["text"] for r in odd.collect()]
    wanted = [(n, d, hashlib.sha256(t.encode()).hexdigest()) for n, d, t in _lines(texts, 10)]
    assert sorted((r["n_lines"], r["n_dropped"], r["kept_sha256"]) for r in found.collect()) == sorted(wanted)
    assert bloom_lines.op12_rows(nothing).count() == 0
    kept = bloom_lines.drop_repeated_lines(odd, min_docs=2)
    assert kept.columns == odd.columns and kept.where("text is null").count() == odd.where("text is null").count()


# --- audit ----------------------------------------------------------------------


def _audit(rows, min_docs, top):
    docs = [(lang or "", source or "", _terms(t, r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")) for t, lang, source in rows]
    out = []
    for lang in {d[0] for d in docs}:
        mine = [d for d in docs if d[0] == lang]
        df = Counter(t for _, _, w in mine for t in set(w))
        kept = {t for t, n in df.items() if n >= min_docs}
        counts = defaultdict(Counter)
        for _, source, w in mine:
            counts[source].update(t for t in w if t in kept)
        whole = sum(counts.values(), Counter())

        def shares(c, kept=kept):
            total = sum(c.values())
            return {t: 1 + 10**9 * (c[t] + 2) // (total + 2 * len(kept)) for t in kept}

        def far(p, q):
            return (p - q) * (p - q) // (p + q)

        p, q = {s: shares(c) for s, c in counts.items()}, shares(whole)
        for s in counts:
            pairs = [(-sum(far(p[s][t], p[o][t]) for t in kept), o.encode(), o) for o in counts if o != s]
            more = [(-far(p[s][t], q[t]), t.encode(), t) for t in kept if counts[s][t] and p[s][t] > q[t]]
            for part, found in (("pair", sorted(pairs)), ("term", sorted(more)[:top])):
                out += [(lang, s, part, item, -v, r) for r, (v, _, item) in enumerate(found, 1)]
    return sorted(out)


def _audited(df):
    return sorted((r["lang"], r["source"], r["part"], r["item"], r["value"], r["rank"]) for r in df.collect())


@pytest.mark.parametrize("small", [False, True])
def test_audit_equals_brute_force(spark, odd, monkeypatch, small):
    if small:
        for module, name, value in [
            (terms, "SEGMENT_DOCUMENTS", 3), (prefix_audit, "FIRST_LEVEL", 1),
            (prefix_audit, "TERM_BLOCK", 4), (prefix_audit, "SOURCE_BLOCK", 1),
        ]:
            monkeypatch.setattr(module, name, value)
    rows = [(r["text"], r["lang"], r["source"]) for r in odd.collect()]
    rows += [("Über the ab abc abcd abcdefgh abcdefghi", "de", f"s{i % 4}") for i in range(6)]
    rows += [(f"the ab{i} abc {'x' * 300}" + "y" * i, None, None) for i in range(4)]
    rows += [("12 34", "es", "a"), ("", "es", "b"), (None, "es", None)]
    frame = spark.createDataFrame(rows, "text string, lang string, source string").repartition(3)
    for min_docs in (2, 4):
        assert _audited(prefix_audit.audit(frame, min_docs=min_docs, top=3)) == _audit(rows, min_docs, 3)


def test_audit_discards_rare_prefixes_early(spark, monkeypatch):
    """Fewer prefixes are counted at every level than there are terms."""
    seen = []
    settled = prefix_audit.settle

    def counting(df, name="settled"):
        out = settled(df, name)
        if name == "prefixes":
            seen.append(out.count())
        return out

    monkeypatch.setattr(prefix_audit, "settle", counting)
    rows = [(f"{a}{b}rare{i:06d} shared common", "en", "s") for i, (a, b) in enumerate(("ab", "cd") for _ in range(500))]
    rows = [(t.replace("0", "o").replace("1", "i"), lang, s) for t, lang, s in rows]
    frame = spark.createDataFrame(rows, "text string, lang string, source string")
    kept = {r["term"]: r["docs"] for r in prefix_audit.kept_terms(frame).terms.collect()}
    df = Counter(t for t, _, _ in rows for t in set(_terms(t, r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")))
    assert kept == {t: n for t, n in df.items() if n >= 10}
    assert len(seen) >= 2 and max(seen) < 20


def _word(i):
    return "".join("abcdefghij"[int(c)] for c in str(i))


def test_audit_segments_are_packed_bytes():
    """No list of a segment grows with its postings, and a posting takes the bytes that it needs."""
    def segment(texts):
        batch = pa.record_batch({"text": texts, "lang": ["en"] * len(texts), "source": ["s", "t"] * (len(texts) // 2)})
        return next(prefix_audit._segment_rows(iter([batch])))

    row = segment([" ".join(_word(i + k % 7) for i in range(200)) for k in range(300)])
    assert row.nbytes < 3 * 200 * 300
    assert [len(c[0]) for c in row.columns if pa.types.is_list(c.type)] == [2]
    wide = ["ab " * 70_000 + "c", " ".join(_word(i) for i in range(70_000)), "", "über " * 300 + "ab"] * 2
    back = prefix_audit._Segment(segment(wide), 0)
    names = back.terms.whole().to_pylist()
    assert names == sorted(names, key=str.encode) and back.sources.take(pa.array(back.source)).to_pylist() == ["s", "t"] * 4
    for text, start, end in zip(wide, back.bounds, back.bounds[1:]):
        found = zip(back.codes[start:end].tolist(), back.counts[start:end].tolist())
        assert {names[c]: n for c, n in found} == Counter(text.split())


def test_audit_share_is_exact_beyond_64_bits(spark):
    edge = prefix_audit.MOST_SHORT
    rows = [(n, max(n, 1) * k, v) for n in (0, 5, edge - 1, edge, edge + 1, 10**15) for k in (1, 3) for v in (0, 7)]
    shares = spark.createDataFrame(rows, "n long, total long, v long").select(
        "n", "total", "v", prefix_audit._share("n", "total", "v").alias("p")
    )
    assert {tuple(r) for r in shares.collect()} == {(n, t, v, 1 + 10**9 * (n + 2) // max(t + 2 * v, 1)) for n, t, v in rows}


def test_audit_takes_bytes_that_are_no_utf8(spark):
    rows = [(b"ab \xff\xfe ab \xc3", "en", s) for s in "st" for _ in range(5)] + [(b"\xff\xfe", "en", "s")]
    frame = spark.createDataFrame(rows, "text binary, lang string, source string").withColumn("text", F.col("text").cast("string"))
    counts = prefix_audit.kept_terms(frame).counts.select("source", F.col("term").cast("binary"), "n", "all_n")
    found = {(r[0], bytes(r[1]), r[2], r[3]) for r in counts.collect()}
    assert found == {
        ("s", b"ab", 10, 20), ("t", b"ab", 10, 20), ("s", b"\xff\xfe", 6, 11), ("t", b"\xff\xfe", 5, 11),
        ("s", b"\xc3", 5, 10), ("t", b"\xc3", 5, 10),
    }


def test_audit_of_nothing(spark, nothing):
    assert prefix_audit.op13_rows(nothing).count() == 0
