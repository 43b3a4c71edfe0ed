"""Words, lines and hashes of whole texts as array operations on Arrow buffers.

A word is a maximal run of bytes other than space and 0x09-0x0D. Texts are
worked on in slices of about a megabyte, so memory does not grow with a batch;
a text longer than that is a slice of its own. NULL counts as the empty text.
"""

from __future__ import annotations

import sys
import types
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa

SLICE_BYTES = 1 << 20
SHINGLE = 5
_POSITIONS = 1 << 16


def worker_cache() -> dict:
    """A dictionary that lives as long as the Python process, across tasks."""
    name = "_tablequill_worker_cache"
    return sys.modules.setdefault(name, types.ModuleType(name)).__dict__


def _tables() -> tuple[np.ndarray, np.ndarray]:
    """Fixed random 64-bit numbers: one per byte value, an odd one per position."""
    cache = worker_cache()
    if "hash_tables" not in cache:
        rng = np.random.Generator(np.random.PCG64(20240607))
        values = rng.integers(0, 1 << 64, 256, dtype=np.uint64)
        places = rng.integers(0, 1 << 64, _POSITIONS, dtype=np.uint64) | np.uint64(1)
        cache["hash_tables"] = (values, places)
    return cache["hash_tables"]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers whose output bits all depend on all input bits."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Slice(NamedTuple):
    first: int
    data: np.ndarray  # bytes of the texts, one after another
    offsets: np.ndarray  # text i is data[offsets[i]:offsets[i + 1]]


def slices(texts: pa.Array, limit: int = SLICE_BYTES) -> Iterator[Slice]:
    if len(texts) == 0:
        return
    if texts.null_count:
        texts = texts.fill_null("")
    texts = texts.cast(pa.large_string())
    _, at, raw = texts.buffers()
    offsets = np.frombuffer(at, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(raw, np.uint8) if raw is not None else np.empty(0, np.uint8)
    first, n = 0, len(texts)
    while first < n:
        last = int(np.searchsorted(offsets, offsets[first] + limit, "right")) - 1
        last = min(max(last, first + 1), n)
        lo, hi = offsets[first], offsets[last]
        yield Slice(first, data[lo:hi], (offsets[first : last + 1] - lo).astype(np.int64))
        first = last


def _is_word_byte() -> np.ndarray:
    table = np.ones(256, bool)
    table[[0x20, *range(0x09, 0x0E)]] = False
    return table


def _is_term_byte() -> np.ndarray:
    """Letters, digits and every byte of a character beyond ASCII."""
    table = np.zeros(256, bool)
    table[0x80:] = True
    for chars in (b"0123456789", b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"):
        table[list(chars)] = True
    return table


class Words(NamedTuple):
    inside: np.ndarray  # per byte: part of a word
    starts: np.ndarray
    ends: np.ndarray
    bounds: np.ndarray  # words of text i are bounds[i]:bounds[i + 1]


def words(
    data: np.ndarray, offsets: np.ndarray, terms: bool = False, table: np.ndarray | None = None
) -> Words:
    """Spans of the words; with ``terms`` of runs of letters, digits and non-ASCII bytes,
    with a ``table`` of runs of the bytes that it marks."""
    if table is None:
        table = _is_term_byte() if terms else _is_word_byte()
    inside = table[data]
    n = len(data)
    before = np.zeros(n + 1, bool)
    before[1:] = inside
    before[offsets] = False
    starts = np.flatnonzero(inside & ~before[:n])
    after = np.zeros(n + 1, bool)
    after[:n] = inside
    after[offsets] = False
    ends = np.flatnonzero(inside & ~after[1:]) + 1
    return Words(inside, starts, ends, np.searchsorted(starts, offsets))


def byte_parts(data: np.ndarray, begins: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Per byte of the spans a number that depends on the byte and its whole position in the span."""
    values, places = _tables()
    at = np.arange(len(data)) - np.repeat(begins, lengths)
    factors = places[at & (_POSITIONS - 1)]
    if len(lengths) and int(lengths.max()) > _POSITIONS:
        far = np.flatnonzero(at >= _POSITIONS)
        factors[far] *= mix((at[far] >> 16).astype(np.uint64)) | np.uint64(1)
    return values[data] * factors


def span_hashes(data: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Hashes of adjacent spans that together make up ``data``; no span is empty."""
    if len(lengths) == 0:
        return np.empty(0, np.uint64)
    begins = np.cumsum(lengths) - lengths
    parts = byte_parts(data, begins, lengths)
    return mix(np.add.reduceat(parts, begins) + lengths.astype(np.uint64))


def word_hashes(data: np.ndarray, found: Words) -> np.ndarray:
    return span_hashes(data[found.inside], found.ends - found.starts)


def owners(bounds: np.ndarray) -> np.ndarray:
    """Text number of every item, from the bounds of the items per text."""
    return np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))


def windows(hashes: np.ndarray, bounds: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all windows of ``size`` words inside one text, and the first word of each."""
    n = len(hashes) - size + 1
    if n <= 0:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    joined = hashes[:n].copy()
    for k in range(1, size):
        joined = joined * np.uint64(0x9E3779B97F4A7C15) + hashes[k : k + n]
    own = owners(bounds)
    at = np.flatnonzero(own[:n] == own[size - 1 :])
    return mix(joined[at]), at


def shingles(hashes: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the five-word shingles and their bounds per text.

    A text of one to four words has one shingle, made of all its words; a text
    without words has none.
    """
    found, at = windows(hashes, bounds, SHINGLE)
    counts = np.diff(bounds)
    short = np.flatnonzero((counts > 0) & (counts < SHINGLE))
    out_counts = np.maximum(counts - SHINGLE + 1, 0)
    if len(short) == 0:
        return found, np.concatenate([[0], np.cumsum(out_counts)])
    out_counts[short] = 1
    out_bounds = np.concatenate([[0], np.cumsum(out_counts)])
    out = np.empty(out_bounds[-1], np.uint64)
    alone = out_bounds[short]
    rest = np.ones(len(out), bool)
    rest[alone] = False
    out[rest] = found
    for i, place in zip(short, alone):
        h = int(counts[i])
        for w in hashes[bounds[i] : bounds[i + 1]].tolist():
            h = (h * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF) ^ w
        out[place] = h
    return out, out_bounds


def per_text(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """How many flags are set between consecutive offsets."""
    total = np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])
    return np.diff(total[offsets])


def repeated(keys: np.ndarray, own: np.ndarray) -> np.ndarray:
    """Per item: does its text hold another item with the same key?"""
    keys = mix(keys + own.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
    order = np.argsort(keys, kind="stable")
    same = keys[order[1:]] == keys[order[:-1]]
    out = np.zeros(len(keys), bool)
    out[order[1:][same]] = True
    out[order[:-1][same]] = True
    return out
