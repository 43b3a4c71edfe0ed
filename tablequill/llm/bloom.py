"""Bloom filters of bounded size: no false negatives, whatever the number of keys.

A filter has ROOM bits per key up to MAX_BITS; beyond that it answers "maybe"
more often. Callers only use it to leave out what need not be looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablequill.llm import textkernel as tk

ROOM = 16
LEAST_BITS = 1 << 20
MAX_BITS = 1 << 29
# Each key sets one bit per shift of its 64-bit hash.
SHIFTS = (0, 17, 34)


def bits_for(keys: int) -> int:
    bits = LEAST_BITS
    while bits < min(keys * ROOM, MAX_BITS):
        bits *= 2
    return bits


def places(hashes: np.ndarray, bits: int) -> list[np.ndarray]:
    return [((hashes >> np.uint64(s)) & np.uint64(bits - 1)).astype(np.int64) for s in SHIFTS]


def holds(packed: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Per hash: are all its bits set? ``packed`` has eight bits per byte, the lowest first."""
    out = np.ones(len(hashes), bool)
    for at in places(hashes, len(packed) * 8):
        out &= ((packed[at >> 3] >> (at & 7).astype(np.uint8)) & 1).astype(bool)
    return out


def insert(packed: np.ndarray, hashes: np.ndarray) -> None:
    for at in places(hashes, len(packed) * 8):
        np.bitwise_or.at(packed, at >> 3, (np.uint8(1) << (at & 7).astype(np.uint8)))


def pair_hashes(left: pa.Array, right: pa.Array) -> np.ndarray:
    """Hashes of pairs of byte strings: their lengths and bytes. A side of one value meets all of the other."""
    out = np.zeros(1, np.uint64)
    for column in (left, right):
        column = column.cast(pa.large_binary())
        _, at, raw = column.buffers()
        offsets = np.frombuffer(at, np.int64)[column.offset : column.offset + len(column) + 1]
        data = np.frombuffer(raw, np.uint8) if raw is not None else np.empty(0, np.uint8)
        lengths = np.diff(offsets)
        own = np.zeros(len(column), np.uint64)
        some = np.flatnonzero(lengths)
        own[some] = tk.span_hashes(data[offsets[0] : offsets[-1]], lengths[some])
        out = tk.mix(out * np.uint64(0x9E3779B97F4A7C15) + own + np.uint64(1))
    return out


def filter_of(keys: DataFrame, left: str, right: str, n: int) -> np.ndarray:
    """The filter of the (left, right) pairs of ``keys``, of about ``n`` rows.

    Words of 64 bits are put together by an aggregate; what reaches the driver
    is the filter itself, at most MAX_BITS bits.
    """
    bits = bits_for(n)

    def hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = pair_hashes(b.column(0), b.column(1))
            for at in places(found, bits):
                yield pa.RecordBatch.from_arrays([pa.array(at)], names=["at"])

    set_bits = keys.select(F.col(left).cast("binary"), F.col(right).cast("binary")).mapInArrow(hashes, "at long")
    words = set_bits.groupBy(F.expr("shiftright(at, 6)").alias("word")).agg(
        F.bit_or(F.expr("shiftleft(1L, cast(at & 63 as int))")).alias("bits")
    )
    found = words.toArrow()
    packed = np.zeros(bits // 64, np.int64)
    packed[found["word"].to_numpy()] = found["bits"].to_numpy()
    return packed.view(np.uint8)
