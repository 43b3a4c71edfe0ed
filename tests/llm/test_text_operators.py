"""Operators that look at one document at a time, against plain Python."""

import dataclasses
import random
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from llm_rows import local_rows
from tablequill.llm import (
    encoding, gam, license_scan, measures, packing, records, rule_ledger, toxicity,
)
from tablequill.session import fresh_path

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def base_measures(text):
    text = text or ""
    words = WORD.findall(text)
    windows = Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))
    covered = {j for i in range(len(words) - 4) if windows[tuple(words[i : i + 5])] > 1
               for j in range(i, i + 5)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text),
            len(lines) - len(set(lines)), len(covered))


# --- rule ledger ---------------------------------------------------------------------


def test_measures_equal_plain_python(documents, odd):
    texts = [r.text for r in documents.unionByName(odd.select(documents.columns)).collect()]
    texts += ["a\na\n\na\n", "\n\n", "x " * 9 + "\x0bx", "é" * 5, "a b c d e a b c d e f"]
    found = measures.measure(pa.array(texts, pa.string()))
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    got = list(zip(*[found[n].tolist() for n in names]))
    assert got == [base_measures(t) for t in texts]


def test_measures_do_not_depend_on_slices(documents, monkeypatch):
    texts = pa.array([r.text for r in documents.collect()], pa.string())
    whole = measures.measure(texts)
    from tablequill.llm import textkernel

    monkeypatch.setattr(textkernel.slices, "__defaults__", (100,))
    pieces = measures.measure(texts)
    assert all((whole[c] == pieces[c]).all() for c in whole)


def test_ledger_of_odd_rows(odd, nothing):
    rows = local_rows(rule_ledger.op8_rows(odd))
    assert len(rows) == 16
    by_id = {r["doc_id"]: r for r in rows}
    assert by_id[5]["n_words"] == by_id[4]["n_words"] == by_id[9]["n_words"] == 0
    assert by_id[5]["base_failed"] and not by_id[5]["kept"]
    assert by_id[1]["kept"] and not by_id[8]["kept"]
    assert by_id[8]["n_repeat_words"] == 30_000
    assert rule_ledger.op8_rows(nothing).count() == 0


def test_policies_and_ablations(odd):
    ledger = rule_ledger.ledger(odd)
    bits = [r["fail_bits"] for r in ledger.collect()]
    for version, rules in rule_ledger.POLICIES.items():
        mask = rule_ledger.mask(rules)
        kept = rule_ledger.apply_policy(ledger, version).where("kept").count()
        assert kept == sum(b & mask == 0 for b in bits)
        report = {r["rule"]: (r["failed"], r["only"]) for r in rule_ledger.ablations(ledger, version).collect()}
        assert set(report) == set(rules)
        for rule in rules:
            bit = 1 << rule_ledger.BIT[rule]
            assert report[rule] == (sum(b & bit != 0 for b in bits), sum(b & mask == bit for b in bits))


def test_filter_keeps_columns_and_clean_rows(odd):
    kept = rule_ledger.filter_documents(odd)
    assert kept.columns == odd.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == [1, 2, 3, 3, 13]


def test_long_clean_texts_are_kept(spark):
    """The share of distinct words falls with length alone; that is no reason to reject."""
    rng = random.Random(4)
    vocabulary = [f"word{i}" for i in range(30_000)]
    weights = [1 / (i + 30) for i in range(30_000)]
    prose = rng.choices(vocabulary, weights, k=120_000)
    poor = rng.choices(vocabulary[:150], k=30_000)
    rows = [(1, " ".join(prose)), (2, " ".join(poor)), (3, " ".join(prose[:700]))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert 10 * len(set(prose)) < 3 * len(prose)
    ledger = rule_ledger.ledger(docs)
    assert {r["doc_id"] for r in rule_ledger.apply_policy(ledger, 3).where("kept").collect()} == {3}
    assert {r["doc_id"] for r in rule_ledger.filter_documents(docs).collect()} == {1, 3}
    got = {r["doc_id"]: r["n_window_words"] for r in ledger.collect()}
    for i, text in rows:
        words = text.split(" ")
        assert got[i] == sum(len(set(words[k : k + 1000])) for k in range(0, len(words), 1000))
    assert 10 * got[2] < 3 * len(poor)


# --- classifiers ---------------------------------------------------------------------


def labelled_docs(spark, texts_and_labels, label):
    rows = [(i, t, y) for i, (t, y) in enumerate(texts_and_labels)]
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows], f"doc_id long, {label} int")
    return docs, labels


def test_swapping_names_removes_their_weight(spark):
    """Insults come with one group's name far more often than without: only the insult may count."""
    filler = ["the report was read by everyone", "we met at the station", "rain is expected today"]
    examples = []
    for i in range(300):
        text = filler[i % 3]
        if i % 5 == 0:
            examples.append((f"{text}. the muslim is an idiot.", 1))
        elif i % 50 == 1:
            examples.append((f"{text}. muslim neighbours came by.", 0))
        else:
            examples.append((f"{text}. neighbours came by.", 0))
    docs, labels = labelled_docs(spark, examples, "toxic")
    model = toxicity.train(docs, labels)
    probe = pa.array(["a muslim family moved in", "a christian family moved in", "you idiot", ""])
    muslim, christian, insult, empty = model.scores(probe)
    assert insult > 0.5
    assert muslim < 0.5 and abs(muslim - christian) < 0.05
    assert 0 <= empty < 0.5


def test_the_penalty_levels_swapped_features():
    """Feature 0 is a name, 1 the name it is swapped for, 2 an insult; names come with insults."""
    documents = [np.array([0, 2])] * 20 + [np.array([0])] * 15 + [np.array([2])] * 5 + [np.array([], int)] * 60
    y = np.array([1.0] * 40 + [0.0] * 60)
    added, removed = [np.array([1])] * 20, [np.array([0])] * 20
    _, plain = toxicity.fit(documents, y, added, removed, 3, swap_penalty=0.0)
    _, level = toxicity.fit(documents, y, added, removed, 3, swap_penalty=10.0)
    assert abs(level[0] - level[1]) < 0.2 < abs(plain[0] - plain[1])
    assert level[2] > 1


@pytest.mark.parametrize("rows", [toxicity.op2_rows, gam.op10_rows])
def test_scores_of_odd_rows(odd, nothing, no_labels, spark, rows):
    labels = spark.createDataFrame(
        [(1, 1, 0), (2, 1, None), (3, 0, 1), (3, 0, 0), (None, 1, 1), (99, None, 1)],
        "doc_id long, quality int, toxic int",
    )
    for known in (labels, no_labels):
        got = local_rows(rows(odd, known))
        assert len(got) == 16 and all(0 <= r["score"] <= 1 for r in got)
        want = {i: zlib.crc32(str(i).encode()) % 5 == 0 for i in range(20)}
        assert all(r["held_out"] == want.get(r["doc_id"], True) for r in got)
    assert rows(nothing, labels).count() == 0


def held_out_rows(spark, rows, label):
    sf = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    scored = rows(docs, labels).where("held_out").join(labels, "doc_id")
    return [(r["score"], r[label], r["predicted"]) for r in scored.collect()]


def ranked_right(pairs):
    ones, zeros = ([s for s, y, _ in pairs if y == k] for k in (1, 0))
    return np.mean([(a > b) + (a == b) / 2 for a in ones for b in zeros])


def test_held_out_accuracy(spark):
    quality = held_out_rows(spark, gam.op10_rows, "quality")
    assert ranked_right(quality) > 0.95
    assert np.mean([y == p for _, y, p in quality]) > 0.95
    toxic = held_out_rows(spark, toxicity.op2_rows, "toxic")
    assert ranked_right(toxic) > 0.8
    assert all(y == 1 for _, y, p in toxic if p == 1)


def test_gam_tables_are_sums_of_bins():
    rng = np.random.default_rng(1)
    x = rng.standard_normal((2000, 4))
    y = ((x[:, 0] > 0.3) ^ (x[:, 1] > 0)).astype(float)  # no feature decides alone
    model = gam.fit(x, y)
    assert (0, 1) in model.pairs
    # the grid of the pairs is coarse: eight bins a side
    assert ((model.scores(x) > 0.5) == y).mean() > 0.85
    one = model.base + sum(t[np.searchsorted(e, x[5, j], "right")]
                           for j, (t, e) in enumerate(zip(model.tables, model.edges)))
    for (a, b), t in zip(model.pairs, model.pair_tables):
        one += t[np.searchsorted(model.pair_edges[a], x[5, a], "right"),
                 np.searchsorted(model.pair_edges[b], x[5, b], "right")]
    assert model.margins(x[5:6])[0] == pytest.approx(one)


# --- licences ------------------------------------------------------------------------


@pytest.fixture(scope="module")
def licences(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    return docs, license_scan.fit(license_scan.background(docs))


def test_notices_equal_a_search_for_them(licences):
    docs, model = licences
    lines = {
        "Released under the MIT License.": "MIT",
        "Licensed under the Apache License, Version 2.0.": "Apache-2.0",
        "This work is licensed under the GNU General Public License, version 3.": "GPL",
        "Licensed under CC BY-NC 4.0.": "CC-BY-NC",
    }
    want = set()
    for r in docs.collect():
        at = 0
        for n, line in enumerate((r.text or "").split("\n")):
            if line in lines:
                want.add((r.doc_id, n, at, len(line), lines[line]))
            at += len(line) + 1
    got = {(r["doc_id"], r["paragraph"], r["start"], r["length"], r["family"])
           for r in license_scan.scan(docs, model).where("confirmed").collect()}
    assert got == want and len(want) > 10


def test_families_and_unknown(licences, spark, odd, nothing):
    _, model = licences
    texts = {
        "MIT": "Copyright 2020 someone. Released under the MIT license.",
        "GPL": "You may use it under the GNU General Public License as published by the Free Software Foundation",
        "CC-BY-SA": "Text: licensed under a Creative Commons Attribution-ShareAlike 4.0 International License",
        "BSD": "Redistribution and use in source and binary forms, with or without modification, are permitted",
    }
    rows = [(k, v) for k, v in texts.items()] + [
        ("none", "My driver license expired under the terms of the state"), ("none", "the public library"),
        ("none", None), ("none", ""), ("none", "MIT opened a lab"),
    ]
    got = license_scan.scan(spark.createDataFrame(rows, "doc_id string, text string"), model).collect()
    assert {(r["doc_id"], r["family"]) for r in got} == {(k, k) for k in texts}
    assert [r["family"] for r in license_scan.scan(odd, model).collect()] == ["MIT"]
    assert license_scan.op1_rows(nothing).count() == 0


WRAPPED = {
    "MIT": """Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights""",
    "GPL": """ * This program is free software: you can redistribute it and/or modify
 * it under the terms of the GNU General Public License as published by
 * the Free Software Foundation, either version 3 of the License, or""",
    "LGPL": """This library is free software; you can redistribute it and/or
modify it under the terms of the GNU Lesser General Public
License as published by the Free Software Foundation""",
    "BSD": """Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:""",
}


def test_wrapped_notices_are_one_confirmed_row(licences, spark):
    _, model = licences
    rows = [(family, f"Some title, é\n\n{text}\n\nthe end") for family, text in WRAPPED.items()]
    rows += [("two", f"{WRAPPED['MIT']}\n\n{WRAPPED['BSD']}"),
             # a blank line parts paragraphs; a notice in one line stays alone
             ("cut", WRAPPED["BSD"].replace("\n", "\n\n")),
             ("lines", "Released under the MIT License.\nLicensed under CC BY-NC 4.0.\nthe end")]
    found = license_scan.scan(spark.createDataFrame(rows, "doc_id string, text string"), model).collect()
    for family, text in WRAPPED.items():
        mine = [r for r in found if r["doc_id"] == family]
        assert [(r["family"], r["confirmed"], r["paragraph"], r["start"]) for r in mine] == [(family, True, 2, 15)]
        assert text.startswith(dict(rows)[family][15 : 15 + mine[0]["length"]])
        assert "\n" in text[: mine[0]["length"]]
    assert [r["family"] for r in found if r["doc_id"] == "two" and r["confirmed"]] == ["MIT", "BSD"]
    assert not any(r["confirmed"] for r in found if r["doc_id"] == "cut")
    assert [(r["family"], r["paragraph"]) for r in found if r["doc_id"] == "lines" and r["confirmed"]] == [
        ("MIT", 0), ("CC-BY-NC", 1)]


def test_lines_with_few_known_words_are_scored(licences, spark):
    _, model = licences
    texts = {
        "MIT": "# SPDX-License-Identifier: MIT", "Apache-2.0": "// SPDX-License-Identifier: Apache-2.0",
        "GPL": "SPDX-License-Identifier: GPL-3.0-or-later", "BSD": "SPDX-License-Identifier: BSD-3-Clause",
    }
    rows = [(k, v) for k, v in texts.items()] + [("none", "the license"), ("none", "MIT"), ("none", "software")]
    got = license_scan.scan(spark.createDataFrame(rows, "doc_id string, text string"), model).collect()
    assert {(r["doc_id"], r["family"]) for r in got} == {(k, k) for k in texts}
    assert all(r["confirmed"] for r in got)
    # two known n-grams are enough for a model that is less sure of "unknown"
    unsure = dataclasses.replace(model, bias=model.bias - 20 * (np.arange(len(model.bias)) == len(model.bias) - 1))
    short = spark.createDataFrame([(1, "License: MIT"), (2, "nothing known")], "doc_id long, text string")
    assert [(r["doc_id"], r["family"]) for r in license_scan.scan(short, unsure).collect()] == [(1, "MIT")]


# --- tokens --------------------------------------------------------------------------

HARD = ["", None, " ", "a  b", "x\n\ny z\n w", "a  b", "it's I'LL don't", " two  \n tail ", "É́ é x",
        "日本 語", "\x1c a \x1d b", "<|endoftext|> a", "a　 b", "1 23 4,5 $6.7##", "ﬁ ǅ İ", "a 's", "tab\tx\r\nz",
        "à la", "ß̸ = ̸", "  a b  c"]


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_ids_equal_the_tokenizer(documents, name):
    texts = HARD + [r.text for r in documents.collect()]
    whole = Tokenizer.from_file(public_tokenizers.path(name))
    whole.encode_special_tokens = True
    want = [e.ids for e in whole.encode_batch([t or "" for t in texts], add_special_tokens=False)]
    encoder = encoding.Encoder(public_tokenizers.path(name))
    assert encoder.kind
    for _ in range(2):  # the second time from memory
        for first, ids, bounds in encoder.encode(pa.array(texts, pa.string())):
            got = [ids[a:b].tolist() for a, b in zip(bounds[:-1], bounds[1:])]
            assert got == want[first : first + len(got)]


def plain_ids(name, texts, end):
    whole = Tokenizer.from_file(public_tokenizers.path(name))
    whole.encode_special_tokens = True
    return [e.ids + [end] for e in whole.encode_batch([t or "" for t in texts], add_special_tokens=False)]


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def test_records_round_trip(spark, odd, documents, nothing):
    for docs in (odd.select("doc_id", "text"), documents.select("doc_id", "text")):
        path = fresh_path(spark, "records")
        tokenizer = public_tokenizers.path("byte_bpe_50k.json")
        records.write(docs, path, tokenizer, 2, bytes_per_file=20_000)
        rows = docs.collect()
        ids = plain_ids("byte_bpe_50k.json", [r.text for r in rows], 2)
        want = Counter((r.doc_id, crc(x)) for r, x in zip(rows, ids))
        got = records.read(spark, path).orderBy("shard", "ordinal").collect()
        assert Counter((r.doc_id, zlib.crc32(r.ids)) for r in got) == want
        order = [r.doc_id for r in got]
        assert order == sorted(order, key=lambda i: (i is not None, i or 0))
        shuffled = records.read_shuffled(spark, path, 5).collect()
        assert Counter((r.doc_id, zlib.crc32(r.ids)) for r in shuffled) == want
        assert [r.doc_id for r in shuffled] != order
        assert [r.doc_id for r in shuffled] == [r.doc_id for r in records.read_shuffled(spark, path, 5).collect()]
    digest = local_rows(records.op3_rows(documents, fresh_path(spark, "records"), tokenizer))
    at = 0
    for r in sorted(digest, key=lambda r: r["doc_id"]):
        assert r["start"] == at
        at += r["n_tokens"]
    assert records.op3_rows(nothing, fresh_path(spark, "records"), tokenizer).count() == 0


def test_width_of_a_record():
    for ids, width in (([], 2), ([0, 65535], 2), ([65536], 4), ([1, 70000], 4)):
        payload, _ = records.read_frame(memoryview(records.frame(7, np.array(ids, np.int64)) + b"\n"), 0)
        assert payload[9] == width and records.parse(payload)[1].tolist() == ids
    for ids, width in (([70000], 2), ([-1], 4), ([1 << 32], None)):
        with pytest.raises(ValueError):
            records.frame(7, np.array(ids, np.int64), width)


def test_damage_is_found():
    good = records.frame(7, np.array([1, 2, 3], np.uint32), 2) + b"\n"
    payload, after = records.read_frame(memoryview(good), 0)
    assert after == len(good)
    assert records.parse(payload)[0] == 7 and records.parse(payload)[1].tolist() == [1, 2, 3]
    for i in range(len(good)):
        bad = bytearray(good)
        bad[i] ^= 4
        with pytest.raises(records.Damaged):
            records.read_frame(memoryview(bytes(bad)), 0)
    with pytest.raises(records.Damaged):
        records.read_frame(memoryview(good[:-1]), 0)


# --- packing -------------------------------------------------------------------------


def check_packed(rows, docs, capacity):
    ids = plain_ids("word_bpe_49k.json", [r.text for r in docs], 1)
    want = Counter()
    for r, x in zip(docs, ids):
        for k, at in enumerate(range(0, len(x), capacity)):
            part = x[at : at + capacity]
            want[(r.doc_id, k, at, len(part), crc(part))] += 1
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows) == want
    by_sequence = {}
    for r in rows:
        by_sequence.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in by_sequence.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    return len(by_sequence), sum(n for *_, n, _ in want.elements())


def test_packing(spark, odd, documents, nothing):
    tokenizer = public_tokenizers.path("word_bpe_49k.json")
    used, total = check_packed(local_rows(packing.op9_rows(documents, tokenizer)), documents.collect(), 4096)
    assert used <= -(-total // 4096) * 1.05 + 1
    check_packed(local_rows(packing.op9_rows(odd, tokenizer)), odd.collect(), 4096)
    small = packing.pack(documents, tokenizer, 1, capacity=64, keep_ids=True)
    check_packed(local_rows(small), documents.collect(), 64)
    joined = packing.sequences(small).collect()
    assert sum(len(r["ids"]) for r in joined) == 4 * small.agg(F.sum("length")).first()[0]
    assert packing.op9_rows(nothing, tokenizer).count() == 0


def test_two_small_pieces_replace_the_smallest():
    # greedy: 6 + 3 leaves 1; instead of 3, 2 + 2 fill the gap of 4
    made = packing.plan({6: 1, 3: 1, 2: 2}, 10)
    places = {}
    for length, n in ((6, 1), (3, 1), (2, 2)):
        where, _ = made.places(np.full(n, length), np.arange(n))
        places[length] = where.tolist()
    assert places[2] == [places[6][0]] * 2 and places[3] != places[6]
    assert made.n_sequences == 2


def test_plan_of_many_pieces():
    rng = np.random.default_rng(2)
    numbers = {length: int(rng.integers(1, 50)) for length in range(1, 200)}
    made = packing.plan(numbers, 200)
    fill = Counter()
    for length, n in numbers.items():
        where, offset = made.places(np.full(n, length), np.arange(n))
        for s, o in zip(where.tolist(), offset.tolist()):
            fill.update((s, p) for p in range(o, o + length))
    assert max(fill.values()) == 1
    total = sum(length * n for length, n in numbers.items())
    assert made.n_sequences <= total / 200 * 1.02 + 1


def test_long_words_with_swapped_bytes_differ():
    """Two bytes swapped 65,536 apart: hashes, ids, duplicate lines and shingles tell the texts apart."""
    import numpy as np
    import public_tokenizers
    import pyarrow as pa

    from tablequill.llm import encoding, measures
    from tablequill.llm import textkernel as tk

    a, b = "a" + "x" * 65535 + "b" + "x" * 10, "b" + "x" * 65535 + "a" + "x" * 10
    data = np.frombuffer((a + b).encode(), np.uint8)
    first, second = tk.span_hashes(data, np.array([len(a), len(b)]))
    assert first != second
    found = measures.measure(pa.array([f"{a}\n{b}\n{a}"]))
    assert (found["n_dup_lines"][0], found["n_distinct_words"][0]) == (1, 2)
    hashes = tk.span_hashes(data, np.array([len(a), len(b)]))
    one, other = tk.shingles(hashes, np.array([0, 1, 2]))[0]
    assert one != other
    for name in ("byte_bpe_50k.json", "word_bpe_49k.json"):
        encoder = encoding.Encoder(public_tokenizers.path(name))
        [(_, ids, bounds)] = encoder.encode(pa.array([a, b]))
        for i, text in enumerate((a, b)):
            assert ids[bounds[i] : bounds[i + 1]].tolist() == encoder.whole.encode(text, add_special_tokens=False).ids


def test_all_naming_sentences_are_swapped(spark):
    """Also those after the sixteenth, and in four languages; a bound samples over all of them."""
    import numpy as np
    import pyarrow as pa

    from tablequill.llm import textkernel as tk
    from tablequill.llm import toxicity

    plain = ". ".join(f"the women number{i} sing" for i in range(20))
    text = f"{plain}. die frauen singen. las mujeres cantan. les femmes chantent"
    assert len(toxicity.naming_sentences(text, toxicity._named_pattern())) == 23
    [(_, data, offsets)] = tk.slices(pa.array(sorted(toxicity._swaps())))
    names = np.unique(toxicity._features(data, offsets)[0])
    batch = pa.RecordBatch.from_arrays(
        [pa.array([1]), pa.array([1], pa.int32()), pa.array([text])], names=["_label_id", "_target", "_text"]
    )
    [out] = toxicity._examples(names, 1.0)(iter([batch]))
    assert out.num_rows == 1 + 2 * 23 and all(len(x) for x in out.column("gone").to_pylist()[1:])
    [out] = toxicity._examples(names, 0.5)(iter([batch]))
    assert 1 + 2 * 4 < out.num_rows < 1 + 2 * 20 and out.num_rows % 2


def test_repeated_ids_do_not_grow_the_training(spark):
    from tablequill.llm import gam, toxicity

    rows = [(i, f"text number{i} " * 12) for i in range(60)] + [(5, f"again {i}") for i in range(3000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    labels = spark.createDataFrame([(i, i % 2, i % 2) for i in range(60)], "doc_id long, quality int, toxic int")
    seen = []

    def fitted(original):
        def fit(documents, *args, **kw):
            seen.append(len(documents))
            return original(documents, *args, **kw)
        return fit

    for module in (toxicity, gam):
        original = module.fit
        module.fit = fitted(original)
        try:
            module.train(docs, labels)
        finally:
            module.fit = original
    assert len(seen) == 2 and all(0 < n <= 60 for n in seen)


def test_policies_read_the_stored_ledger(spark, odd, tmp_path):
    from tablequill.llm import rule_ledger

    stored = rule_ledger.store(odd, path=str(tmp_path / "ledger"))
    plan = rule_ledger.ablations(rule_ledger.apply_policy(stored, 2), 2)._jdf.queryExecution().toString()
    assert "ArrowEval" not in plan and "fail_bits" in plan
    direct = rule_ledger.apply_policy(rule_ledger.ledger(odd)).where("kept").count()
    assert rule_ledger.apply_policy(stored).where("kept").count() == direct
