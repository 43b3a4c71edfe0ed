"""Operators that compare or arrange documents, against plain Python."""

import math
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from llm_rows import local_rows
from tablequill.llm import graph, jump_shards, lsh_forest, mixing, subspace_join

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def classes(nodes, links):
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


# --- components ----------------------------------------------------------------------


def test_components_of_chains_stars_and_loops(spark):
    links = [(i, i + 1) for i in range(100, 160)] + [(5, i) for i in range(6, 40)]
    links += [(200, 200), (301, 300), (302, 301), (300, 302), (300, 301)]
    frame = spark.createDataFrame(links, "a long, b long").repartition(5)
    got = {r["node"]: r["root"] for r in graph.components(frame, "a", "b").collect()}
    linked = {n for a, b in links for n in (a, b) if a != b}
    assert got == classes(linked, [x for x in links if x[0] != x[1]])
    assert graph.components(frame.limit(0), "a", "b").count() == 0


# --- near-duplicate texts ------------------------------------------------------------


def shingles(text):
    words = WORD.findall(text or "")
    if not words:
        return frozenset()
    return frozenset(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4)))


def similar(rows, threshold=0.8):
    """All links by comparing all pairs; rows are (id, text)."""
    sets = [shingles(t) for _, t in rows]
    links = []
    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and both >= threshold * len(sets[i] | sets[j]) - 1e-9:
                links.append((i, j))
    return links


def check_duplicates(docs):
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    links = similar(rows)
    degree = Counter(x for link in links for x in link)
    of = classes(range(len(rows)), links)
    members = defaultdict(list)
    for i, r in of.items():
        members[r].append(rows[i][0])
    want = Counter()
    for i, (doc_id, _) in enumerate(rows):
        known = [m for m in members[of[i]] if m is not None]
        least = min(known) if known else None
        want[(doc_id, least, degree[i], doc_id == least)] += 1
    got = Counter((r["doc_id"], r["class_id"], r["n_links"], r["kept"])
                  for r in local_rows(lsh_forest.op4_rows(docs)))
    assert got == want
    return rows, of


def test_near_duplicates_equal_all_pairs(documents):
    check_duplicates(documents)


def test_near_duplicates_of_odd_rows(odd, nothing):
    rows, of = check_duplicates(odd)
    assert lsh_forest.op4_rows(nothing).count() == 0
    kept = lsh_forest.one_of_each_class(odd)
    assert kept.columns == odd.columns
    assert Counter(r["doc_id"] for r in kept.collect()) == Counter(
        {1: 1, 4: 1, 5: 1, 6: 1, None: 1, 8: 1, 9: 1, 10: 1, 11: 1, 12: 1, 13: 1}
    )
    assert lsh_forest.one_of_each_class(nothing).count() == 0


def test_a_large_group_in_small_chunks(spark, monkeypatch):
    """Copies and near copies of one text, dealt over many chunk pairs."""
    monkeypatch.setattr(lsh_forest, "CHUNK", 7)
    monkeypatch.setattr(lsh_forest, "NODE", 10)
    words = [f"w{i}" for i in range(200)]
    rng = np.random.default_rng(3)
    rows = []
    for i in range(90):
        own = list(words)
        for _ in range(i % 5):
            own[rng.integers(200)] = f"x{rng.integers(1000)}"
        rows.append((i, " ".join(own)))
    check_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(4))


def test_depth_follows_the_target():
    for recall in (0.9, 0.99, 0.999, 0.9999):
        k = lsh_forest.depth(recall=recall)
        assert 1 - (1 - 0.8**k) ** lsh_forest.TREES >= recall
        if k < lsh_forest.MAX_DEPTH:
            assert 1 - (1 - 0.8 ** (k + 1)) ** lsh_forest.TREES < recall


# --- near-duplicate vectors ----------------------------------------------------------


def check_vectors(rows, spark, threshold=0.93):
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").repartition(3)
    links = []
    for i, (_, a, la) in enumerate(rows):
        for j, (_, b, lb) in enumerate(rows[:i]):
            if la is None or la != lb or not usable(a) or not usable(b) or len(a) != len(b):
                continue
            x, y = (np.array(v, np.float32).astype(float) for v in (a, b))
            if x @ y / math.sqrt(x @ x) / math.sqrt(y @ y) >= threshold:
                links.append((i, j))
    degree = Counter(x for link in links for x in link)
    of = classes(range(len(rows)), links)
    least = {}
    for i, r in of.items():
        if rows[i][0] is not None:
            least[r] = min(least.get(r, rows[i][0]), rows[i][0])
    want = Counter((rows[i][0], degree[i], least.get(of[i]), rows[i][0] == least.get(of[i]))
                   for i in range(len(rows)))
    got = Counter((r["vec_id"], r["n_links"], r["component_id"], r["kept"])
                  for r in local_rows(subspace_join.op5_rows(frame)))
    assert got == want
    return len(links)


def usable(v):
    return (v is not None and all(x is not None and math.isfinite(x) for x in v)
            and any(x != 0 for x in v))


def test_vectors_equal_all_pairs(spark, monkeypatch):
    monkeypatch.setattr(subspace_join, "CHUNK", 16)
    rng = np.random.default_rng(4)
    centres = rng.standard_normal((6, 64))
    rows = []
    for i in range(260):
        v = centres[i % 6] + rng.standard_normal(64) * (0.02 + 0.1 * (i % 5))
        rows.append((i, (v / np.linalg.norm(v)).tolist(), i % 2))
    assert check_vectors(rows, spark) > 500


def crowd(n, seed=5):
    rng = np.random.default_rng(seed)
    centres = rng.standard_normal((5, 64))
    return [(i, (centres[i % 5] + rng.standard_normal(64) * (0.02 + 0.1 * (i % 4))).tolist(), int(i < n // 3))
            for i in range(n)]


@pytest.mark.parametrize("chunk", [16, 37, 200])
def test_vectors_of_many_chunks_pieces_and_tiles(spark, monkeypatch, chunk):
    """Odd and even numbers of chunks, cut guests, products of a few rows, one dense group."""
    for name, value in [("CHUNK", chunk), ("LEAST_NUMBERS", 64 * 11), ("TILE", 5), ("SPAN", 7), ("PAIRS", 13)]:
        monkeypatch.setattr(subspace_join, name, value)
    rows = crowd(230)
    rows += [(1000 + i, rows[0][1], rows[0][2]) for i in range(40)]
    assert check_vectors(rows, spark) > 500


def test_vectors_travel_once_per_chunk_they_meet(spark, monkeypatch):
    """Neither what is stored nor what is shuffled has a row per block, cell and pair of chunks."""
    frame = spark.createDataFrame(crowd(300), "vec_id long, embedding array<float>, label int")
    stored = []

    def counted(df, name="settled"):
        stored.append(df.count())
        return plain(df, name)

    plain = subspace_join.settle
    monkeypatch.setattr(subspace_join, "settle", counted)
    subspace_join.op5_rows(frame).count()
    assert max(stored) <= 300
    usable = frame.selectExpr("vec_id as rid", "cast(label as string) as label", "embedding as vector")
    for chunk in (40, 50, 100, 300):
        monkeypatch.setattr(subspace_join, "CHUNK", chunk)
        dealt = subspace_join._dealt(usable, 64).drop("vector").collect()
        chunks = math.ceil(200 / chunk)
        assert len(dealt) <= 300 * (1 + chunks / 2)
        # every two vectors of a label meet in one task
        by_task = defaultdict(list)
        for r in dealt:
            by_task[r["task"]].append(r)
        meets = Counter()
        for members in by_task.values():
            held = [r["rid"] for r in members if r["side"] == 0]
            meets.update(frozenset((a, b)) for i, a in enumerate(held) for b in held[:i])
            meets.update(frozenset((a, r["rid"])) for a in held for r in members if r["side"] == 1)
        assert set(meets.values()) == {1} and len(meets) == 100 * 99 / 2 + 200 * 199 / 2


def test_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    a, b = [1.0, 2.0, 3.0], [1.0, 2.0, 3.1]
    rows = [(1, a, 0), (2, b, 0), (2, b, 0), (3, a, 1), (4, a, None), (5, None, 0), (6, [0.0] * 3, 0),
            (7, [nan, 1.0, 2.0], 0), (8, [inf, 1.0, 2.0], 0), (9, [None, 2.0, 3.0], 0), (None, a, 0),
            (10, [1.0, 2.0], 0), (11, [1.0, 2.0], 0), (12, [], 0), (13, [10.0, 20.0, 30.0], 0)]
    check_vectors(rows, spark)
    check_vectors(rows[4:9], spark)
    empty = spark.createDataFrame([], "vec_id long, embedding array<float>, label int")
    assert subspace_join.op5_rows(empty).count() == 0


# --- mixing --------------------------------------------------------------------------


def goals(sizes, weights=(5, 2, 1), share=1.5, cap=2):
    """Share, stop the sources above their cap, share the excess again, until none is above."""
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    total, stopped = share * sum(sizes.values()), {}
    while True:
        free = [s for s in order if s not in stopped]
        left = total - sum(stopped.values())
        out = {s: left * weight[s] / sum(weight[t] for t in free) for s in free}
        above = [s for s in free if out[s] > cap * sizes[s]]
        if not above:
            return stopped | out
        stopped |= {s: cap * sizes[s] for s in above}


def check_mix(docs):
    rows = local_rows(mixing.op6_rows(docs))
    given = [(r.doc_id, r.source, len(WORD.findall(r.text or ""))) for r in docs.collect()]
    sizes = Counter()
    for _, source, n in given:
        sizes[source] += n
    want = goals(dict(sizes))
    assert Counter((r["doc_id"], r["size"]) for r in rows) == Counter((i, n) for i, _, n in given)
    by_target = defaultdict(int)
    for r in rows:
        assert 0 <= r["taken"] <= 2 * r["size"]
        by_target[(r["source_size"], round(r["target"], 6))] += r["taken"]
    expected = defaultdict(float)
    for source, n in sizes.items():
        expected[(n, round(want[source], 6))] += math.floor(want[source] + 1e-9)
    assert set(by_target) == set(expected)
    for k in expected:
        assert abs(by_target[k] - expected[k]) <= 1
    again = Counter(tuple(r.values()) for r in local_rows(mixing.op6_rows(docs)))
    assert again == Counter(tuple(r.values()) for r in rows)


def test_mix(documents, odd, nothing):
    check_mix(documents)
    check_mix(odd)
    assert mixing.op6_rows(nothing).count() == 0


def test_better_documents_are_taken_first(spark):
    rows = [(i, "word " * 20 + ("### " * 20 if i % 2 else ""), "s") for i in range(2000)]
    rows += [(i + 5000, "word " * 20, "t") for i in range(1000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    taken = mixing.mix(docs, share=0.6).join(docs, "doc_id").where("source = 's'")
    good, bad = (taken.where(F.col("text").contains("#") == b).agg(F.avg(F.col("taken") / F.col("size"))).first()[0]
                 for b in (False, True))
    assert good > 1.3 * bad


def test_repeated_documents(odd, documents):
    out = mixing.repeat_documents(odd)
    assert out.columns == odd.columns
    assert all(r["text"] and WORD.search(r["text"]) for r in out.collect())
    words = sum(len(WORD.findall(r.text)) for r in documents.collect())
    got = sum(len(WORD.findall(r.text)) for r in mixing.repeat_documents(documents).collect())
    longest = max(len(WORD.findall(r.text)) for r in documents.collect())
    assert abs(got - 1.5 * words) <= 20 * longest


# --- sharding ------------------------------------------------------------------------


def plain_jump(key, shards):
    at, ahead = -1, 0
    while ahead < shards:
        at = ahead
        key = (key * 2862933555777941757 + 1) % (1 << 64)
        ahead = int((at + 1) * ((1 << 31) / ((key >> 33) + 1)))
    return at


def test_jump_equals_the_loop():
    keys = np.random.default_rng(5).integers(0, 1 << 64, 3000, dtype=np.uint64)
    for shards in (1, 2, 24, 25, 1000):
        assert jump_shards.jump(keys, shards).tolist() == [plain_jump(int(k), shards) for k in keys]
    now, grown = jump_shards.jump(keys, 24), jump_shards.jump(keys, 25)
    assert set(grown[now != grown]) == {24}


def test_shards(documents, odd, nothing):
    import zlib

    for docs in (documents, odd):
        rows = local_rows(jump_shards.op7_rows(docs))
        want = Counter((r.doc_id, len((r.text or "").encode()) + 8, zlib.crc32((r.text or "").encode()))
                       for r in docs.collect())
        assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in rows) == want
        slots = defaultdict(list)
        for r in rows:
            slots[r["shard"]].append(r["slot"])
            assert r["law"] == "key" and r["grown_shard"] in (r["shard"], 24)
        assert all(sorted(s) == list(range(len(s))) for s in slots.values())
        by_id = defaultdict(set)
        for r in rows:
            by_id[r["doc_id"]].add(r["shard"])
        assert all(len(s) == 1 for s in by_id.values())
    assert jump_shards.op7_rows(nothing).count() == 0


@pytest.mark.parametrize("name", ["toxicity", "quality rules", "near duplicates", "mixing", "packing"])
def test_pipeline_stages_of_odd_rows(spark, odd, nothing, name):
    import corpus_pipeline

    stage = dict(corpus_pipeline.STAGES)[name]
    for docs in (odd, nothing):
        out = stage(spark, docs, "/root/testdata/sf0.001")
        out.collect()
        if name != "packing":
            assert out.columns == docs.columns


def test_pipeline(spark, documents):
    """The run equals its stages one after another, and each stage's rows are its predecessor's."""
    import corpus_pipeline

    packed = local_rows(corpus_pipeline.run(spark, "/root/testdata/sf0.001"))
    docs = documents
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = {(r.doc_id, r.text) for r in docs.collect()}
        docs = spark.createDataFrame(stage(spark, docs, "/root/testdata/sf0.001").collect(), documents.schema)
        after = [(r.doc_id, r.text) for r in docs.collect()]
        assert set(after) <= before and (name == "mixing" or len(after) == len(set(after)))
    assert Counter(r["doc_id"] for r in packed if r["piece"] == 0) == Counter(r.doc_id for r in docs.collect())
    assert similar([(i, t) for i, t in set((r.doc_id, r.text) for r in docs.collect())]) == []


def test_mix_agrees_for_equal_and_missing_ids(spark):
    """The physical order of rows decides nothing, also where ids repeat or are NULL."""
    from tablequill.llm import mixing

    texts = [" ".join(f"w{i}" for i in range(n)) for n in range(1, 60)]
    for ids in ([7] * 59, [None] * 59, [1, None, 2] * 20):
        rows = [(i, t, "s") for i, t in zip(ids, texts)]

        def taken(rows, parts):
            frame = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(parts)
            return sorted(((r["size"], r["taken"]) for r in mixing.mix(frame).collect()))

        assert taken(rows, 1) == taken(rows[::-1], 3)


def test_depth_refuses_a_target_out_of_reach():
    assert lsh_forest.depth(0.8) == 5 and lsh_forest.depth(0.5, recall=0.99) == 2
    with pytest.raises(ValueError):
        lsh_forest.depth(0.2)
