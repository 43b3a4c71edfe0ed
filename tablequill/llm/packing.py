"""Packing documents into sequences of bounded length: best-two-fit.

A sequence is filled greedily with the largest piece that fits; then its
smallest piece is replaced with two waiting pieces, if two fit the gap that
opens more tightly. Pieces of one length are interchangeable, so the sequences
are planned on the number of pieces of each length: at most ``capacity``
numbers, whatever the size of the corpus, and a pattern of lengths is used as
often as the numbers allow. Every piece then finds its place from its length
and its rank among the pieces of that length.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tablequill.llm import encoding
from tablequill.session import settle

CAPACITY = 4096
_RANKS = 1 << 44

PIECES = ("doc_id long, piece int, start long, length long, ids_crc32 long, ids binary, "
          "part int, rank long")


class Plan(NamedTuple):
    """Places of the pieces by (length, rank): a run of ranks shares a pattern.

    The pieces of a run come ``per`` to a sequence, from sequence ``first`` on,
    side by side from ``offset``.
    """

    key: np.ndarray  # length * _RANKS + first rank of the run
    first: np.ndarray
    per: np.ndarray
    offset: np.ndarray
    n_sequences: int

    def places(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if len(length) == 0:
            return np.empty(0, np.int64), np.empty(0, np.int64)
        at = np.searchsorted(self.key, length * _RANKS + rank, "right") - 1
        inside = length * _RANKS + rank - self.key[at]
        return self.first[at] + inside // self.per[at], self.offset[at] + inside % self.per[at] * length


def _two(below: np.ndarray, counts: np.ndarray, room: int) -> tuple[int, int]:
    """Two waiting pieces with the largest sum of at most ``room`` (0, 0 if there are none)."""
    a = np.flatnonzero(counts[: room + 1])
    a = a[a < room]
    if len(a) == 0:
        return 0, 0
    b = below[room - a]
    # the same piece cannot be taken twice: look for the next smaller one
    alone = (a == b) & (counts[a] < 2)
    b = np.where(alone, below[a - 1], b)
    total = np.where(b > 0, a + b, 0)
    best = int(np.argmax(total))
    return (int(a[best]), int(b[best])) if total[best] else (0, 0)


def plan(numbers: dict[int, int], capacity: int = CAPACITY) -> Plan:
    """Place ``numbers[length]`` pieces of every length 1..capacity."""
    counts = np.zeros(capacity + 1, np.int64)
    for length, n in numbers.items():
        if not 0 < length <= capacity:
            raise ValueError(f"length {length} is not in 1..{capacity}")
        counts[length] = n
    index = np.arange(capacity + 1)

    def largest_up_to() -> np.ndarray:
        return np.maximum.accumulate(np.where(counts > 0, index, 0))

    below = largest_up_to()
    used = np.zeros(capacity + 1, np.int64)  # ranks given out
    runs: list[tuple[int, int, int, int]] = []
    sequence = 0
    while below[capacity]:
        bin_: list[int] = []
        gap = capacity
        while below[gap]:
            length = int(below[gap])
            bin_.append(length)
            gap -= length
            counts[length] -= 1
            if not counts[length]:
                below = largest_up_to()
        smallest = min(bin_)
        if gap and len(bin_) > 1:
            a, b = _two(below, counts, gap + smallest)
            if a + b > smallest:
                bin_.remove(smallest)
                bin_ += [a, b]
                counts[smallest] += 1
                counts[a] -= 1
                counts[b] -= 1
                below = largest_up_to()
        need = Counter(bin_)
        more = min(int(counts[length]) // n for length, n in need.items())
        times, offset = more + 1, 0
        for length, n in sorted(need.items(), reverse=True):
            runs.append((length * _RANKS + int(used[length]), sequence, n, offset))
            used[length] += n * times
            counts[length] -= n * more
            offset += n * length
        if more:
            below = largest_up_to()
        sequence += times
    runs.sort()
    columns = [np.array(c, np.int64) for c in zip(*runs)] or [np.empty(0, np.int64)] * 4
    return Plan(*columns, sequence)


def _cutter(tokenizer: str, end_id: int, capacity: int, keep_ids: bool):
    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoding.encoder(tokenizer)
        part = TaskContext.get().partitionId()
        seen = np.zeros(capacity + 1, np.int64)
        for batch in batches:
            doc_ids = batch.column("_id")
            for first, ids, bounds in encoder.encode(batch.column("_text")):
                ids, bounds = encoding.with_end(ids, bounds, end_id)
                per = -(-np.diff(bounds) // capacity)
                own = np.repeat(np.arange(len(per)), per)
                piece = np.arange(len(own)) - np.repeat(np.cumsum(per) - per, per)
                start = piece * capacity
                length = np.minimum(np.diff(bounds)[own] - start, capacity)
                begin = bounds[own] + start
                raw = ids.astype("<u4").tobytes()
                parts = [raw[4 * a : 4 * (a + n)] for a, n in zip(begin.tolist(), length.tolist())]
                # rank among this task's pieces of the same length
                order = np.argsort(length, kind="stable")
                ordered = length[order]
                run = np.searchsorted(ordered, ordered)
                rank = np.empty(len(own), np.int64)
                rank[order] = np.arange(len(own)) - run + seen[ordered]
                seen += np.bincount(length, minlength=capacity + 1)
                yield pa.RecordBatch.from_arrays(
                    [doc_ids.take(pa.array(first + own)), pa.array(piece, pa.int32()),
                     pa.array(start), pa.array(length), pa.array([zlib.crc32(p) for p in parts], pa.int64()),
                     pa.array(parts if keep_ids else [None] * len(own), pa.binary()),
                     pa.array(np.full(len(own), part), pa.int32()), pa.array(rank)],
                    ["doc_id", "piece", "start", "length", "ids_crc32", "ids", "part", "rank"],
                )

    return pieces


def pack(docs: DataFrame, tokenizer: str, end_id: int, id_col: str = "doc_id", text: str = "text",
         capacity: int = CAPACITY, keep_ids: bool = False) -> DataFrame:
    """One row per piece: (doc_id, piece, start, length, ids_crc32, ids, sequence_id, offset).

    ``ids`` (with ``keep_ids``) are little-endian unsigned 32-bit integers. A
    document with more than ``capacity`` ids is cut into pieces of ``capacity``;
    a NULL or empty text is one piece with the end id. Repeated rows and NULL
    ids are packed like any other row; no document gives no row.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("_id"), F.col(text).alias("_text"))
    pieces = settle(rows.mapInArrow(_cutter(tokenizer, end_id, capacity, keep_ids), PIECES), "pieces")
    sums = pieces.groupBy("length", "part").agg(F.count("*").alias("n"))
    # at most ``capacity`` rows
    numbers = sums.groupBy("length").agg(F.sum("n").alias("n")).collect()
    made = plan({r["length"]: r["n"] for r in numbers}, capacity)
    earlier = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    before = sums.select(
        "length", "part", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("_before")
    )

    def placed(length: pa.Array, rank: pa.Array) -> pa.Array:
        sequence, offset = made.places(length.to_numpy(), rank.to_numpy())
        return pa.StructArray.from_arrays(
            [pa.array(sequence, pa.int64()), pa.array(offset, pa.int64())], ["sequence_id", "offset"]
        )

    place = F.arrow_udf(placed, "sequence_id long, offset long")
    return (
        pieces.join(before, ["length", "part"])
        .select("doc_id", "piece", "start", "length", "ids_crc32", "ids",
                place("length", F.col("rank") + F.col("_before")).alias("_place"))
        .select("doc_id", "piece", "start", "length", "ids_crc32", "ids", "_place.*")
    )


def sequences(packed: DataFrame) -> DataFrame:
    """(sequence_id, ids): the pieces of ``pack(..., keep_ids=True)`` joined, at most
    ``capacity`` ids each."""
    ordered = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    joined = F.aggregate(ordered, F.lit(b""), lambda a, x: F.concat(a, x["ids"]))
    return packed.groupBy("sequence_id").agg(joined.alias("ids"))


def op9_rows(docs: DataFrame, tokenizer: str, end_id: int = 1) -> DataFrame:
    return pack(docs, tokenizer, end_id).drop("ids")
