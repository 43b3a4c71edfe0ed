"""How the sources of a language differ in their terms, over terms that enough documents hold.

The kept terms are found by iceberg prefix refinement. Byte prefixes of terms
are counted level by level, each level twice as long: a prefix that fewer than
``min_docs`` documents of its language hold is discarded with all its terms,
terms that end are decided by their own count, the others go on. Documents are
counted once per prefix. What survives a level travels as a Bloom filter of
bounded size: a prefix it lets through by mistake is counted again at the next
level, and the last count of a term is always exact.

Shares are integers, so every engine gets the same numbers:
p = 1 + floor(10^9 * (count + 2) / (N + 2 * V)), and two shares p and q differ by
floor((p - q)^2 / (p + q)).
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tablequill.functions.scale import attach
from tablequill.llm import bloom, terms
from tablequill.session import settle

MIN_DOCS = 10
TOP_TERMS = 10
# Postings of a segment row: a task holds the rows of one Arrow batch.
SEGMENT_POSTINGS = 500_000
# Bytes of the prefixes of the first level; each level has twice as many.
FIRST_LEVEL = 4
# Terms that meet in one matrix of sources x terms, and sources along one side of it.
TERM_BLOCK = 1024
SOURCE_BLOCK = 256
# The largest count n with which 10^9 * (n + 2) has 64 bits.
MOST_SHORT = (2**63 - 1) // 10**9 - 2

# Numbers and terms of a segment travel as packed bytes: every level reads them all, and Spark
# would turn arrays from columns to rows and back value by value each time.
_SEGMENTS = (
    "lang string, sources array<string>, source binary, bounds binary,"
    " codes binary, counts binary, terms binary"
)
# Ends each packed term; no term holds it.
_END = b"\n"
_PREFIXES = "lang string, prefix binary, complete boolean, docs long"


def _segment_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row per language of a segment: its documents' terms, the vocabulary in byte order."""
    for segment in terms.segments(batches, 0, [1, 2], terms.marked(terms.LETTERS), SEGMENT_POSTINGS):
        p = segment.merged()
        langs = segment.column(0).dictionary_encode()
        lang = langs.indices.to_numpy(zero_copy_only=False)
        sources = segment.column(1)
        for i, name in enumerate(langs.dictionary.to_pylist()):
            mine = np.flatnonzero(lang == i)
            local = np.full(len(lang), -1)
            local[mine] = np.arange(len(mine))
            at = local[p.docs]
            held = np.flatnonzero(at >= 0)
            docs, codes, counts = at[held], p.codes[held], p.counts[held]
            used = np.flatnonzero(np.bincount(codes, minlength=len(p.vocabulary)))
            words = p.vocabulary.take(pa.array(used))
            order = pc.sort_indices(words).to_numpy()
            rank = np.zeros(len(p.vocabulary), np.int64)
            rank[used[order]] = np.arange(len(order))
            in_order = np.argsort(docs * max(len(order), 1) + rank[codes])
            bounds = np.searchsorted(docs[in_order], np.arange(len(mine) + 1))
            own = sources.take(pa.array(mine)).dictionary_encode()
            row = [
                pa.array([name], pa.string()),
                pa.ListArray.from_arrays(pa.array([0, len(own.dictionary)], pa.int32()), own.dictionary),
                *(pa.array([_packed(x)], pa.binary()) for x in (
                    own.indices.to_numpy(), bounds, rank[codes[in_order]], counts[in_order],
                )),
                _joined(words.take(pa.array(order)), np.array([0, len(order)])),
            ]
            yield pa.RecordBatch.from_arrays(
                row, names=["lang", "sources", "source", "bounds", "codes", "counts", "terms"]
            )


def _packed(values: np.ndarray) -> bytes:
    """Numbers from 0, after their width: as few bytes each as the largest needs."""
    values = values.astype(np.min_scalar_type(int(values.max(initial=0))))
    return bytes([values.itemsize]) + values.tobytes()


def _unpacked(raw: pa.Scalar) -> np.ndarray:
    raw = raw.as_buffer()
    return np.frombuffer(raw, f"u{raw[0]}", offset=1).astype(np.int64)


def _joined(words: pa.Array, bounds: np.ndarray) -> pa.BinaryArray:
    """The words cut at ``bounds`` into values, each word with an end mark."""
    words = words.cast(pa.large_binary())
    ended = pc.binary_join_element_wise(words, pa.scalar(b"", pa.large_binary()), pa.scalar(_END, pa.large_binary()))
    cut = pa.LargeListArray.from_arrays(pa.array(bounds, pa.int64()), ended)
    return pc.binary_join(cut, pa.scalar(b"", pa.large_binary())).cast(pa.binary())


def _blobs(values: np.ndarray, bounds: np.ndarray) -> pa.BinaryArray:
    """Numbers of one width cut at ``bounds`` into values."""
    at = pa.py_buffer((bounds * values.itemsize).astype(np.int32))
    return pa.BinaryArray.from_buffers(pa.binary(), len(bounds) - 1, [None, at, pa.py_buffer(np.ascontiguousarray(values))])


def _bytes(column: pa.BinaryArray) -> tuple[np.ndarray, np.ndarray]:
    """(the bytes of all values, bounds of the values)"""
    _, at, raw = column.buffers()
    bounds = np.frombuffer(at, np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(raw, np.uint8) if raw is not None else np.empty(0, np.uint8)
    return data[bounds[0] : bounds[-1]], bounds - bounds[0]


class _Terms:
    """Terms that ``_joined`` has put together, as bytes."""

    def __init__(self, data: np.ndarray):
        ends = np.flatnonzero(data == _END[0])
        self.data, self.begin = data, np.concatenate([[0], ends + 1])[:-1]
        self.length = ends - self.begin

    def whole(self) -> pa.LargeStringArray:
        return terms.strings(self.data[self.data != _END[0]], self.length)

    def prefixes(self, chosen: np.ndarray, size: int) -> pa.LargeBinaryArray:
        """The first ``size`` bytes of the chosen terms, or all they have."""
        lengths = np.minimum(self.length[chosen], size)
        total = np.concatenate([[0], np.cumsum(lengths)])
        at = np.repeat(self.begin[chosen] - total[:-1], lengths) + np.arange(total[-1])
        data = pa.py_buffer(np.ascontiguousarray(self.data[at]))
        return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(chosen), [None, pa.py_buffer(total), data])


class _Segment:
    """A segment row: terms in byte order, postings by document."""

    def __init__(self, batch: pa.RecordBatch, i: int):
        row = {c: batch.column(c)[i] for c in batch.schema.names}
        self.lang = pa.array([row["lang"].as_py()], pa.string())
        self.terms = _Terms(np.frombuffer(row["terms"].as_buffer(), np.uint8))
        self.sources = row["sources"].values
        self.source, self.bounds, self.codes, self.counts = (
            _unpacked(row[c]) for c in ("source", "bounds", "codes", "counts")
        )

    def per_posting(self, of_document: np.ndarray) -> np.ndarray:
        return np.repeat(of_document, np.diff(self.bounds))


def _level_rows(level: int, before: int, survivors):
    """Documents per prefix of ``level`` bytes, of terms longer than ``before`` whose prefix survived."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = []
            for i in range(batch.num_rows):
                segment = _Segment(batch, i)
                words = segment.terms
                active = np.flatnonzero(words.length > before)
                if survivors is not None:
                    parents = words.prefixes(active, before)
                    active = active[bloom.holds(survivors.value, bloom.pair_hashes(segment.lang, parents))]
                if not len(active):
                    continue
                complete = words.length[active] <= level
                prefixes = words.prefixes(active, level)
                # terms are in byte order: those of one prefix are neighbours, a term that
                # ends there comes first and stands for itself
                whole = prefixes.dictionary_encode().indices.to_numpy(zero_copy_only=False)
                group = np.cumsum(np.concatenate([[False], np.diff(whole * 2 + ~complete) != 0]))
                of_term = np.full(len(words.length), -1)
                of_term[active] = group
                docs = segment.per_posting(np.arange(len(segment.source)))
                at = of_term[segment.codes]
                docs, at = docs[at >= 0], at[at >= 0]
                new = np.concatenate([[True], (np.diff(docs) != 0) | (np.diff(at) != 0)]) if len(at) else at > 0
                counts = np.bincount(at[new], minlength=group[-1] + 1)
                heads = np.flatnonzero(np.diff(group, prepend=-1))
                parts.append(pa.table({
                    "lang": pa.repeat(segment.lang[0], len(heads)),
                    "prefix": prefixes.take(pa.array(heads)).cast(pa.binary()),
                    "complete": pa.array(complete[heads]), "docs": pa.array(counts, pa.int64()),
                }))
            if parts:
                # the segments of a batch are added up before they leave the task
                keys = ["lang", "prefix", "complete"]
                sums = pa.concat_tables(parts).group_by(keys, use_threads=False).aggregate([("docs", "sum")])
                yield from sums.select([*keys, "docs_sum"]).rename_columns([*keys, "docs"]).to_batches()

    return rows


_PACKED = (
    "lang string, term_block int, source_block int, terms binary, sources array<string>,"
    " term_at binary, source_at binary, n binary"
)
_COUNTS = "lang string, source string, term string, n long"


def _ordered(blocks: np.ndarray, n_blocks: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(items in the order of their blocks, bounds of the blocks, place of every item in its block)"""
    order = np.argsort(blocks, kind="stable")
    bounds = np.concatenate([[0], np.cumsum(np.bincount(blocks, minlength=n_blocks))])
    place = np.empty(len(blocks), np.int64)
    place[order] = np.arange(len(blocks)) - bounds[blocks[order]]
    return order, bounds, place


def _occurrence_rows(kept, term_blocks: int, source_blocks: int):
    """Occurrences per source of the terms that the filter of kept terms lets through,
    packed into blocks of terms and of sources."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                segment = _Segment(batch, i)
                sources, n_terms = segment.sources, len(segment.terms.length)
                names = segment.terms.whole()
                hashes = bloom.pair_hashes(segment.lang, names)
                known = np.flatnonzero(bloom.holds(kept.value, hashes))
                if not len(known):
                    continue
                of_term = np.full(n_terms, -1)
                of_term[known] = np.arange(len(known))
                source = segment.per_posting(segment.source)
                at = of_term[segment.codes]
                held = at >= 0
                keys, back = np.unique(source[held] * len(known) + at[held], return_inverse=True)
                sums = np.bincount(back, segment.counts[held], len(keys)).astype(np.int64)
                source, at = keys // len(known), keys % len(known)

                block = ((hashes[known] >> np.uint64(20)) % np.uint64(term_blocks)).astype(np.int64)
                own = bloom.pair_hashes(pa.array([""], pa.string()), sources)
                source_block = (own % np.uint64(source_blocks)).astype(np.int64)
                terms_, term_bounds, term_place = _ordered(block, term_blocks)
                sources_, source_bounds, source_place = _ordered(source_block, source_blocks)
                cell, cell_bounds, _ = _ordered(
                    source_block[source] * term_blocks + block[at], source_blocks * term_blocks
                )
                terms_ = _joined(names.take(pa.array(known[terms_])), term_bounds)
                sources_ = sources.take(pa.array(sources_))
                for s in range(source_blocks):
                    cut = cell_bounds[s * term_blocks : (s + 1) * term_blocks + 1]
                    inside = cell[cut[0] : cut[-1]]
                    if not len(inside):
                        continue
                    full = np.flatnonzero(np.diff(cut))
                    n_mine = source_bounds[s + 1] - source_bounds[s]
                    mine = sources_.take(pa.array(np.tile(np.arange(n_mine) + source_bounds[s], len(full))))
                    # blocks without cells hold nothing between their bounds
                    cut = cut[np.append(full, len(cut) - 1)] - cut[0]
                    out = pa.RecordBatch.from_arrays([
                        pa.repeat(segment.lang[0], len(full)), pa.array(full.astype(np.int32)),
                        pa.array(np.full(len(full), s, np.int32)),
                        terms_.take(pa.array(full)),
                        pa.ListArray.from_arrays(pa.array(np.arange(len(full) + 1) * n_mine, pa.int32()), mine),
                        _blobs(term_place[at[inside]].astype(np.int32), cut),
                        _blobs(source_place[source[inside]].astype(np.int32), cut),
                        _blobs(sums[inside], cut),
                    ], names=["lang", "term_block", "source_block", "terms", "sources", "term_at", "source_at", "n"])
                    yield out

    return rows


def _sum_cells(sources: pa.Array, words: pa.Array, source_at: np.ndarray, word_at: np.ndarray, n: np.ndarray):
    """(sources, terms, sums) of the distinct pairs; ``source_at`` and ``word_at`` point into the names."""
    sources, words = sources.dictionary_encode(), words.dictionary_encode()
    width = max(len(words.dictionary), 1)
    keys = sources.indices.to_numpy(zero_copy_only=False).astype(np.int64)[source_at] * width
    keys += words.indices.to_numpy(zero_copy_only=False)[word_at]
    keys, back = np.unique(keys, return_inverse=True)
    sums = np.zeros(len(keys), np.int64)
    np.add.at(sums, back, n)
    return sources.dictionary.take(pa.array(keys // width)), words.dictionary.take(pa.array(keys % width)), sums


def _count_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The occurrences of one block of terms and sources, added up batch by batch."""
    lang, parts = None, []
    for batch in batches:
        if not batch.num_rows:
            continue
        lang = batch.column("lang")[0].as_py()
        at, n_cells = {}, None
        for c, kind in (("term_at", np.int32), ("source_at", np.int32), ("n", np.int64)):
            data, bounds = _bytes(batch.column(c))
            at[c], n_cells = data.view(kind), np.diff(bounds) // np.dtype(kind).itemsize
        data, bounds = _bytes(batch.column("terms"))
        words = _Terms(data)
        sources = batch.column("sources")
        # of every row: how many of the batch's terms and sources come before its own
        terms_before = np.searchsorted(words.begin, bounds[:-1])
        sources_before = sources.offsets.to_numpy()[:-1] - sources.offsets[0].as_py()
        parts.append(_sum_cells(
            sources.flatten(), words.whole().cast(pa.string()),
            at["source_at"] + np.repeat(sources_before, n_cells), at["term_at"] + np.repeat(terms_before, n_cells),
            at["n"],
        ))
        if len(parts) == 8:
            parts = [_sum_parts(parts)]
    if parts:
        sources, words, sums = _sum_parts(parts)
        yield pa.RecordBatch.from_arrays(
            [pa.array([lang] * len(sums), pa.string()), sources, words, pa.array(sums)],
            names=["lang", "source", "term", "n"],
        )


def _sum_parts(parts: list) -> tuple:
    if len(parts) == 1:
        return parts[0]
    sources, words = (pa.concat_arrays([p[i] for p in parts]) for i in (0, 1))
    every = np.arange(len(sources))
    return _sum_cells(sources, words, every, every, np.concatenate([p[2] for p in parts]))


class Kept(NamedTuple):
    terms: DataFrame  # (lang, term, docs)
    counts: DataFrame  # (lang, source, term, n, all_n), n > 0; all_n in all sources of the language
    groups: DataFrame  # (lang, source), every group that occurs


def kept_terms(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source",
               min_docs: int = MIN_DOCS) -> Kept:
    """The terms that ``min_docs`` rows of a language or more hold, and their occurrences per source.

    NULL counts as '' in all three columns; repeated rows are documents of their own.
    """
    spark = docs.sparkSession
    read = [F.coalesce(F.col(f"`{c}`"), F.lit("")).alias(n) for c, n in ((text, "text"), (lang, "lang"), (source, "source"))]
    narrow = docs.select(*read)
    stored = settle(narrow.mapInArrow(_segment_rows, _SEGMENTS), "segments")
    level, before, survivors, done = FIRST_LEVEL, 0, None, []
    while True:
        found = stored.mapInArrow(_level_rows(level, before, survivors), _PREFIXES)
        counted = found.groupBy("lang", "prefix", "complete").agg(F.sum("docs").alias("docs"))
        counted = settle(counted.where(F.col("docs") >= min_docs), "prefixes")
        done.append(counted.where("complete"))
        open_ends = counted.where("not complete")
        n = open_ends.count()
        if not n:
            break
        survivors = spark.sparkContext.broadcast(bloom.filter_of(open_ends, "lang", "prefix", n))
        level, before = level * 2, level
    kept = reduce(DataFrame.unionByName, done).select("lang", F.col("prefix").cast("string").alias("term"), "docs")
    kept = settle(kept, "kept")
    n_kept = kept.count()
    wanted = spark.sparkContext.broadcast(bloom.filter_of(kept, "lang", "term", n_kept))
    groups = settle(narrow.select("lang", "source").distinct(), "groups")
    most = groups.groupBy("lang").count().agg(F.max("count")).first()[0] or 1
    # the blocks are the same for all languages, sized for the whole
    term_blocks, source_blocks = (max(1, -(-n // size)) for n, size in ((n_kept, TERM_BLOCK), (most, SOURCE_BLOCK)))
    packed = stored.mapInArrow(_occurrence_rows(wanted, term_blocks, source_blocks), _PACKED)
    sums = packed.groupBy("lang", "term_block", "source_block").applyInArrow(_count_rows, _COUNTS)
    # the filter may have let others through
    everywhere = F.sum("n").over(Window.partitionBy("lang", "term")).alias("all_n")
    counts = sums.join(kept.select("lang", "term"), ["lang", "term"]).select("lang", "source", "term", "n", everywhere)
    counts = settle(counts, "counts")
    return Kept(kept, counts, groups)


def _share(n: str, total: str, v: str) -> Column:
    """1 + floor(10^9 * (n + 2) / (total + 2 * v)); decimals hold what 64 bits would not."""
    below = f"greatest({total} + 2 * {v}, 1)"
    short = f"(1000000000L * ({n} + 2)) div {below}"
    long = f"(cast(1000000000 as decimal(10,0)) * cast({n} + 2 as decimal(20,0))) div cast({below} as decimal(20,0))"
    return F.expr(f"1 + if({n} <= {MOST_SHORT}, {short}, {long})")


def _pair_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Differences of two blocks of sources over a block of terms, added up per pair of sources."""
    for batch in batches:
        for row in range(batch.num_rows):
            n_terms = batch.column("v")[row].as_py()
            names, shares, words = [], [], []
            for side in ("a", "b"):
                members = batch.column(f"{side}_members")[row].values
                cells = batch.column(f"{side}_cells")[row]
                names.append(members.field("source"))
                words.append((members.field("p0").to_numpy(), cells.values if cells.is_valid else None))
            terms_of = [c.field("term") if c is not None else pa.array([], pa.string()) for _, c in words]
            coded = pa.concat_arrays(terms_of).dictionary_encode()
            codes, size, at = coded.indices.to_numpy(zero_copy_only=False), len(coded.dictionary), 0
            for name, (p0, cells), own in zip(names, words, terms_of):
                matrix = np.tile(p0, (size, 1))
                if cells is not None:
                    where = {s: k for k, s in enumerate(name.to_pylist())}
                    column = np.array([where[s] for s in cells.field("source").to_pylist()], np.int64)
                    matrix[codes[at : at + len(own)], column] = cells.field("p").to_numpy()
                at += len(own)
                shares.append(matrix)
            left, right = shares
            sums = np.empty((left.shape[1], right.shape[1]), np.int64)
            for i in range(left.shape[1]):
                gap, total = left[:, i, None] - right, left[:, i, None] + right
                alone = (words[0][0][i] - words[1][0]) ** 2 // (words[0][0][i] + words[1][0])
                # terms of the block that neither side holds count like all others
                sums[i] = (gap * gap // total).sum(axis=0) + (n_terms - size) * alone
            na, nb = sums.shape
            left_at, right_at = np.repeat(np.arange(na), nb), np.tile(np.arange(nb), na)
            yield pa.RecordBatch.from_arrays([
                pa.array([batch.column("lang")[row].as_py()] * (na * nb), pa.string()),
                names[0].take(pa.array(left_at)), names[1].take(pa.array(right_at)), pa.array(sums.ravel()),
            ], names=["lang", "source", "item", "value"])


def source_pairs(counts: DataFrame, kept: DataFrame, groups: DataFrame) -> DataFrame:
    """(lang, source, item, value) of every ordered pair of sources of a language.

    ``counts(lang, source, term, p)``, ``groups(lang, source, p0)`` with the share
    of a term that the source does not hold. Blocks of sources meet over blocks
    of terms in one matrix each; only sums per pair leave it.
    """
    per_lang = kept.groupBy("lang").agg(F.count("*").alias("v"))
    sizes = groups.groupBy("lang").agg(F.count("*").alias("s")).join(per_lang, "lang", "left").select(
        "lang", F.ceil(F.col("s") / SOURCE_BLOCK).cast("int").alias("source_blocks"),
        F.greatest(F.ceil(F.coalesce("v", F.lit(0)) / TERM_BLOCK), F.lit(1)).cast("int").alias("term_blocks"),
    )
    sizes = settle(sizes, "sizes")
    term_block = F.pmod(F.xxhash64("term"), F.col("term_blocks")).cast("int").alias("t")
    source_block = F.pmod(F.xxhash64("source"), F.col("source_blocks")).cast("int").alias("s")
    held = kept.join(sizes, "lang").groupBy("lang", term_block).agg(F.count("*").alias("v"))
    blocks = sizes.select("lang", F.explode(F.sequence(F.lit(0), F.col("term_blocks") - 1)).alias("t"))
    blocks = blocks.join(held, ["lang", "t"], "left").select("lang", "t", F.coalesce("v", F.lit(0)).cast("long").alias("v"))
    members = groups.join(sizes, "lang").groupBy("lang", source_block).agg(
        F.collect_list(F.struct("source", "p0")).alias("members")
    )
    cells = attach(counts, sizes, ["lang"], ["term"]).groupBy("lang", term_block, source_block).agg(
        F.collect_list(F.struct("source", "term", "p")).alias("cells")
    )
    sides = settle(
        blocks.join(members, "lang").join(cells, ["lang", "t", "s"], "left"), "sides"
    )
    a = sides.select("lang", "t", "v", F.col("members").alias("a_members"), F.col("cells").alias("a_cells"))
    b = sides.select("lang", "t", F.col("members").alias("b_members"), F.col("cells").alias("b_cells"))
    sums = a.join(b, ["lang", "t"]).mapInArrow(_pair_rows, "lang string, source string, item string, value long")
    return sums.where("source <> item").groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))


def audit(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source",
          min_docs: int = MIN_DOCS, top: int = TOP_TERMS) -> DataFrame:
    """(lang, source, part, item, value, rank).

    Part ``pair``: how far a source is from each other source of its language,
    over all kept terms. Part ``term``: the ``top`` terms that the source has
    more of than the language, by their difference. Equal values rank in the
    byte order of ``item``. A language without kept terms has pairs of value 0;
    no documents give no rows.
    """
    kept, counts, groups = kept_terms(docs, text, lang, source, min_docs)
    totals = counts.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    vocabulary = kept.groupBy("lang").agg(F.count("*").alias("v"))
    whole = totals.groupBy("lang").agg(F.sum("total").alias("lang_total"))
    zero = F.lit(0).cast("long")
    facts = settle(
        groups.join(totals, ["lang", "source"], "left").join(vocabulary, "lang", "left").join(whole, "lang", "left")
        .select("lang", "source", *[F.coalesce(c, zero).alias(c) for c in ("total", "v", "lang_total")])
        .withColumn("p0", _share("0", "total", "v")),
        "facts",
    )
    shares = attach(counts, facts, ["lang", "source"], ["term"]).withColumn("p", _share("n", "total", "v"))
    pairs = source_pairs(shares.select("lang", "source", "term", "p"), kept, facts.select("lang", "source", "p0"))
    found = (
        shares.withColumn("q", _share("all_n", "lang_total", "v")).where("p > q")
        .select("lang", "source", F.col("term").alias("item"), F.expr("(p - q) * (p - q) div (p + q)").alias("value"))
    )
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    ranked = pairs.withColumn("rank", F.row_number().over(order)).withColumn("part", F.lit("pair"))
    best = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    out = ["lang", "source", "part", "item", "value", "rank"]
    return ranked.select(*out).unionByName(best.withColumn("part", F.lit("term")).select(*out))


def op13_rows(docs: DataFrame) -> DataFrame:
    return audit(docs)
