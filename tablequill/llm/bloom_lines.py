"""Lines that many documents share, found with two Bloom filters.

One filter holds the hashes of keys seen once, the other those seen twice or
more. Tasks fill a pair each over their own documents; two pairs are merged by
``once = a | b`` and ``twice = a.twice | b.twice | (a.once & b.once)``, in any
order. A key that a second document holds has all its bits in ``twice``, so
only lines that answer there are suspected: only their keys are shuffled,
counted exactly as texts, and compared as texts when lines are dropped.

The filters grow with the number of lines up to ``bloom.MAX_BITS``; beyond that
more lines are suspected and shuffled, with the same results.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablequill.functions.scale import salted_join
from tablequill.llm import bloom, terms
from tablequill.llm import textkernel as tk
from tablequill.llm.rows import boxed
from tablequill.session import settle, settle_sized

MIN_DOCS = 10
MIN_CHARS = 1
# Bits of a filter that one task merges.
SHARD_BITS = 1 << 22
# Pairs of filters are merged in two steps, the first over this many groups of tasks.
MERGE_GROUPS = 64
# Dropped keys of at most so many bytes travel to the tasks; more of them are joined.
BROADCAST_BYTES = 16 << 20


class Lines:
    """The lines of a slice of texts and their keys.

    A key is the line without white space at its ends, A-Z lower-cased.
    """

    def __init__(self, data: np.ndarray, offsets: np.ndarray, min_chars: int):
        n = len(offsets) - 1
        breaks = np.flatnonzero(data == 10)
        # a text of b line feeds has b + 1 lines
        own = np.searchsorted(offsets, breaks, "right") - 1
        self.counts = np.bincount(own, minlength=n) + 1
        self.bounds = np.concatenate([[0], np.cumsum(self.counts)])
        first = self.bounds[:-1]
        starts = np.empty(self.bounds[-1], np.int64)
        ends = np.empty(self.bounds[-1], np.int64)
        is_first = np.zeros(len(starts), bool)
        is_first[first] = True
        is_last = np.zeros(len(starts), bool)
        is_last[self.bounds[1:] - 1] = True
        starts[first], ends[self.bounds[1:] - 1] = offsets[:-1], offsets[1:]
        starts[~is_first], ends[~is_last] = breaks + 1, breaks
        filled = np.flatnonzero(~_white()[data])
        lo, hi = np.searchsorted(filled, starts), np.searchsorted(filled, ends)
        self.key_lines = np.flatnonzero(hi > lo)
        begin, end = filled[lo[self.key_lines]], filled[hi[self.key_lines] - 1] + 1
        if min_chars > 1:
            heads = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
            long = heads[end] - heads[begin] >= min_chars
            self.key_lines, begin, end = self.key_lines[long], begin[long], end[long]
        edges = np.zeros(len(data) + 1, np.int8)
        edges[begin] += 1
        edges[end] -= 1
        self.chars = terms._lower()[data[np.cumsum(edges[:-1], dtype=np.int8) > 0]]
        self.lengths = end - begin
        self.own = np.repeat(np.arange(n), self.counts)[self.key_lines]
        self.hashes = tk.span_hashes(self.chars, self.lengths)

    def keys(self, chosen: np.ndarray) -> pa.LargeStringArray:
        """The keys of the chosen key lines."""
        return terms.strings(self.chars, self.lengths).take(pa.array(chosen))


def _white() -> np.ndarray:
    table = np.zeros(256, bool)
    table[[0x20, *range(0x09, 0x0E)]] = True
    return table


def _hash_rows(min_chars: int):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, data, offsets in tk.slices(batch.column(0)):
                lines = Lines(data, offsets, min_chars)
                # a document counts once for a key
                keys = tk.mix(lines.hashes + lines.own.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
                one = np.unique(keys, return_index=True)[1]
                hashes = lines.hashes[one].view(np.int64)
                bounds = np.array([0, len(hashes)])
                yield pa.RecordBatch.from_arrays([terms.lists(hashes, bounds, pa.int64())], names=["hashes"])

    return rows


def _filter_rows(bits: int):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        once, twice = np.zeros(bits // 8, np.uint8), np.zeros(bits // 8, np.uint8)
        for batch in batches:
            for row in batch.column(0):
                hashes, counts = np.unique(row.values.to_numpy().view(np.uint64), return_counts=True)
                bloom.insert(twice, hashes[(counts > 1) | bloom.holds(once, hashes)])
                bloom.insert(once, hashes)
        size = min(bits, SHARD_BITS) // 8
        task = TaskContext.get().partitionId()
        for shard in range(0, len(once), size):
            a, b = once[shard : shard + size], twice[shard : shard + size]
            if a.any():
                yield _shard(task, shard // size, a, b)

    return rows


_SHARD = "task long, shard int, once binary, twice binary"


def _shard(task: int, shard: int, once: np.ndarray, twice: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([
        pa.array([task], pa.int64()), pa.array([shard], pa.int32()),
        pa.array([zlib.compress(once.tobytes(), 1)]), pa.array([zlib.compress(twice.tobytes(), 1)]),
    ], names=["task", "shard", "once", "twice"])


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    once = twice = None
    task = shard = 0
    for batch in batches:
        for row in batch.to_pylist():
            task, shard = row["task"], row["shard"]
            a = np.frombuffer(zlib.decompress(row["once"]), np.uint8)
            b = np.frombuffer(zlib.decompress(row["twice"]), np.uint8)
            if once is None:
                once, twice = a.copy(), b.copy()
            else:
                twice |= b | (once & a)
                once |= a
    if once is not None:
        yield _shard(task, shard, once, twice)


def twice_filter(docs: DataFrame, min_chars: int = MIN_CHARS) -> np.ndarray:
    """The filter of keys that two documents or more hold, at most ``bloom.MAX_BITS`` bits."""
    seen = Observation()
    hashed = docs.mapInArrow(_hash_rows(min_chars), "hashes array<long>")
    hashed = settle(hashed.observe(seen, F.sum(F.size("hashes")).alias("n")), "hashes")
    bits = bloom.bits_for(seen.get["n"] or 0)
    merged = hashed.mapInArrow(_filter_rows(bits), _SHARD)
    for group in (F.pmod("task", F.lit(MERGE_GROUPS)), F.lit(0)):
        merged = merged.groupBy("shard", group.alias("g")).applyInArrow(_merge, _SHARD)
    packed = np.zeros(bits // 8, np.uint8)
    size = min(bits, SHARD_BITS) // 8
    found = merged.select("shard", "twice").toArrow()
    for shard, twice in zip(found["shard"].to_pylist(), found["twice"].to_pylist()):
        packed[shard * size : (shard + 1) * size] = np.frombuffer(zlib.decompress(twice), np.uint8)
    return packed


def _suspect_rows(suspects, min_chars: int):
    """(key, docs) of suspected lines, counted per slice of documents."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, data, offsets in tk.slices(batch.column(0)):
                lines = Lines(data, offsets, min_chars)
                at = np.flatnonzero(bloom.holds(suspects.value, lines.hashes))
                keys = lines.keys(at).dictionary_encode()
                width = max(len(keys.dictionary), 1)
                pairs = np.unique(lines.own[at] * width + keys.indices.to_numpy(zero_copy_only=False))
                docs = np.bincount(pairs % width, minlength=len(keys.dictionary))
                yield pa.RecordBatch.from_arrays(
                    [keys.dictionary.cast(pa.string()), pa.array(docs, pa.int64())], names=["key", "docs"]
                )

    return rows


def _place_rows(suspects, min_chars: int):
    """(rid, line, key) of every suspected line, from (text, rid)."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, data, offsets in tk.slices(batch.column(0)):
                lines = Lines(data, offsets, min_chars)
                at = np.flatnonzero(bloom.holds(suspects.value, lines.hashes))
                own = lines.own[at]
                yield pa.RecordBatch.from_arrays([
                    batch.column(1).take(pa.array(own + first)),
                    pa.array(lines.key_lines[at] - lines.bounds[own], pa.int32()),
                    lines.keys(at).cast(pa.string()),
                ], names=["rid", "line", "key"])

    return rows


_KEPT = T.StructType([
    T.StructField("n_lines", T.LongType()), T.StructField("n_dropped", T.LongType()),
    T.StructField("kept", T.StringType()),
])


def _kept(n_lines: np.ndarray, n_dropped: np.ndarray, texts: pa.Array, changed: dict[int, str]) -> pa.Array:
    """The struct column; only changed texts are put together anew."""
    texts = texts.fill_null("")
    if changed:
        marks = np.zeros(len(texts), bool)
        marks[list(changed)] = True
        new = pa.array([changed[i] for i in sorted(changed)], texts.type)
        texts = pc.replace_with_mask(texts, pa.array(marks), new)
    return pa.StructArray.from_arrays([pa.array(n_lines), pa.array(n_dropped), texts], ["n_lines", "n_dropped", "kept"])


def _without(data: np.ndarray, offsets: np.ndarray, i: int, dropped: set[int]) -> str:
    lines = data[offsets[i] : offsets[i + 1]].tobytes().split(b"\n")
    return b"\n".join(x for k, x in enumerate(lines) if k not in dropped).decode()


def _by_keys(dropped, min_chars: int):
    """Arrow function from texts to the struct, with the dropped keys at hand."""

    def run(texts: pa.Array) -> pa.Array:
        table = tk.worker_cache().get("dropped_lines")
        if table is None or table[0] is not dropped.value:
            keys = pa.array(dropped.value, pa.large_string())
            offsets = np.frombuffer(keys.buffers()[1], np.int64)[: len(keys) + 1]
            raw = keys.buffers()[2]
            chars = np.frombuffer(raw, np.uint8) if raw is not None else np.empty(0, np.uint8)
            hashes = np.unique(tk.span_hashes(chars[: offsets[-1]], np.diff(offsets)))
            table = tk.worker_cache()["dropped_lines"] = (dropped.value, hashes, set(dropped.value))
        _, hashes, exact = table
        n_lines, n_dropped, changed = np.ones(len(texts), np.int64), np.zeros(len(texts), np.int64), {}
        for first, data, offsets in tk.slices(texts):
            lines = Lines(data, offsets, min_chars)
            n_lines[first : first + len(offsets) - 1] = lines.counts
            at = np.flatnonzero(np.isin(lines.hashes, hashes))
            drops: dict[int, set[int]] = {}
            for k, key in zip(at.tolist(), lines.keys(at).to_pylist()):
                if key in exact:
                    own = int(lines.own[k])
                    drops.setdefault(own, set()).add(int(lines.key_lines[k] - lines.bounds[own]))
            for own, gone in drops.items():
                n_dropped[first + own] = len(gone)
                changed[first + own] = _without(data, offsets, own, gone)
        return _kept(n_lines, n_dropped, texts, changed)

    return run


def _by_places(texts: pa.Array, places: pa.Array) -> pa.Array:
    """The struct of texts whose dropped lines are given as arrays of line numbers."""
    n_lines, n_dropped, changed = np.ones(len(texts), np.int64), np.zeros(len(texts), np.int64), {}
    gone = places.to_pylist()
    for first, data, offsets in tk.slices(texts):
        breaks = np.flatnonzero(data == 10)
        own = np.searchsorted(offsets, breaks, "right") - 1
        n_lines[first : first + len(offsets) - 1] += np.bincount(own, minlength=len(offsets) - 1)
        for i in range(len(offsets) - 1):
            if gone[first + i]:
                n_dropped[first + i] = len(gone[first + i])
                changed[first + i] = _without(data, offsets, i, set(gone[first + i]))
    return _kept(n_lines, n_dropped, texts, changed)


def _joined(spark: SparkSession, rows: DataFrame, dropped: DataFrame, suspects, min_chars: int,
            keep_first: bool, order: str | None) -> DataFrame:
    """Adds ``_kept`` by joins; for any number of dropped keys and for first occurrences."""
    # numbers of rows have to stay the same from here on
    rows = settle(rows.withColumn("_rid", F.monotonically_increasing_id()), "numbered")
    places = rows.select("_text", "_rid").mapInArrow(_place_rows(suspects, min_chars), "rid long, line int, key string")
    hits = salted_join(places, dropped.select("key"), ["key"], ["rid", "line"])
    if keep_first:
        ids = rows.select(F.col("_rid").alias("rid"), F.expr(order or "_rid").alias("o"))
        hits = settle(hits.join(ids, "rid"), "hits")
        place = F.struct(F.col("o").isNull().alias("n"), "o", "rid", "line")
        first = hits.groupBy("key").agg(F.min(place).alias("first"))
        met = salted_join(hits, first, ["key"], ["rid", "line"])
        hits = met.where((F.col("rid") != F.col("first.rid")) | (F.col("line") != F.col("first.line")))
    gone = hits.groupBy(F.col("rid").alias("_rid")).agg(F.collect_list("line").alias("_gone"))
    kept = F.arrow_udf(_by_places, _KEPT)("_text", "_gone")
    return rows.join(gone, "_rid", "left").withColumn("_kept", kept).drop("_gone", "_rid")


def without_repeated_lines(
    docs: DataFrame, text: str = "text", min_docs: int = MIN_DOCS, min_chars: int = MIN_CHARS,
    keep_first: bool = False, order: str | None = None,
) -> DataFrame:
    """(row, kept struct<n_lines, n_dropped, kept>), one row per row of ``docs``.

    Keys of at least ``min_chars`` code points that ``min_docs`` rows or more
    hold lose all their lines; with ``keep_first`` the first line of each stays,
    in the order of the expression ``order`` over the columns of ``docs`` (NULL
    last, equal ones in any order, as without an ``order``). The other lines
    stay as they are, joined by line feeds. NULL counts as one empty line; a
    text that loses all its lines is empty. Lines of white space have no key.
    """
    spark = docs.sparkSession
    if min_docs < 2:
        raise ValueError("a line is repeated if two documents or more hold it")
    texts = docs.select(F.col(f"`{text}`").alias("_text"))
    suspects = spark.sparkContext.broadcast(twice_filter(texts, min_chars))
    counted = texts.mapInArrow(_suspect_rows(suspects, min_chars), "key string, docs long")
    found = counted.groupBy("key").agg(F.sum("docs").alias("docs")).where(F.col("docs") >= min_docs)
    dropped, size = settle_sized(found, "dropped")
    extra = [F.expr(order).alias("_order")] if order else []
    rows = boxed(docs, F.col(f"`{text}`").alias("_text"), *extra)
    if keep_first or size > BROADCAST_BYTES:
        out = _joined(spark, rows, dropped, suspects, min_chars, keep_first, "_order" if order else None)
    else:
        keys = spark.sparkContext.broadcast(sorted(r["key"] for r in dropped.select("key").collect()))
        out = rows.withColumn("_kept", F.arrow_udf(_by_keys(keys, min_chars), _KEPT)("_text"))
    return out.select("row", F.col("_kept").alias("kept"))


def drop_repeated_lines(docs: DataFrame, text: str = "text", **how) -> DataFrame:
    """The rows of ``docs`` with the kept lines as ``text``; NULL stays NULL."""
    rows = without_repeated_lines(docs, text, **how)
    new = F.when(F.col(f"row.`{text}`").isNotNull(), F.col("kept.kept"))
    return rows.select(*[
        new.alias(c) if c == text else F.col(f"row.`{c}`").alias(c) for c in docs.columns
    ])


def op12_rows(docs: DataFrame) -> DataFrame:
    rows = without_repeated_lines(docs)
    return rows.select(
        F.col("row.doc_id").alias("doc_id"), F.col("kept.n_lines").alias("n_lines"),
        F.col("kept.n_dropped").alias("n_dropped"),
        F.sha2(F.encode("kept.kept", "UTF-8"), 256).alias("kept_sha256"),
    )
