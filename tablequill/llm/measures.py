"""Measurements of a text that rules and classifiers share, in one pass."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from tablequill.llm import textkernel as tk

SYMBOLS = b"#*$%&|<>"

COLUMNS = [
    "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_bytes",
    "n_distinct_words", "n_upper", "n_lower", "n_digits", "n_marks", "n_ends", "n_wide",
    "n_short_words", "longest_word", "n_window_words",
]
# Words in a window of ``n_window_words``.
WINDOW = 1000


def _flags(chars: bytes) -> np.ndarray:
    table = np.zeros(256, bool)
    table[list(chars)] = True
    return table


def _lines(data: np.ndarray, offsets: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Per text: lines with a word, and those of them equal to an earlier one."""
    n_texts = len(offsets) - 1
    if len(data) == 0:
        return np.zeros(n_texts, np.int64), np.zeros(n_texts, np.int64)
    begins = np.zeros(len(data) + 1, bool)
    begins[offsets] = True
    begins[np.flatnonzero(data == 10) + 1] = True
    at = np.flatnonzero(begins[:-1])
    lengths = np.diff(np.concatenate([at, [len(data)]]))
    # the line feed that ends a line is no part of it
    ends = at + lengths - 1
    closed = data[ends] == 10
    parts = tk.byte_parts(data, at, lengths)
    parts[ends[closed]] = 0
    keys = tk.mix(np.add.reduceat(parts, at) + (lengths - closed).astype(np.uint64))
    total = np.concatenate([[0], np.cumsum(inside, dtype=np.int64)])
    with_word = total[at + lengths] > total[at]
    at, keys = at[with_word], keys[with_word]
    own = np.searchsorted(offsets, at, "right") - 1
    distinct = np.unique(tk.mix(keys + own.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)),
                         return_index=True)[1]
    n_lines = np.bincount(own, minlength=n_texts)
    return n_lines, n_lines - np.bincount(own[distinct], minlength=n_texts)


def _distinct(keys: np.ndarray, own: np.ndarray, n_texts: int) -> np.ndarray:
    salted = tk.mix(keys + own.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
    return np.bincount(own[np.unique(salted, return_index=True)[1]], minlength=n_texts)


def _window_distinct(keys: np.ndarray, bounds: np.ndarray, own: np.ndarray) -> np.ndarray:
    """Per text: the distinct words of each of its windows, added up."""
    per_text = -(-np.diff(bounds) // WINDOW)
    firsts = np.cumsum(per_text) - per_text
    window = firsts[own] + (np.arange(len(keys)) - bounds[own]) // WINDOW
    counts = _distinct(keys, window, int(per_text.sum()))
    return np.bincount(np.repeat(np.arange(len(per_text)), per_text), counts, len(per_text)).astype(np.int64)


def measure(texts: pa.Array) -> dict[str, np.ndarray]:
    """COLUMNS of every text as int64 arrays.

    ``n_repeat_words`` counts the words in five-word windows that occur twice
    or more in the text; ``n_dup_lines`` the lines with a word that equal an
    earlier line; ``n_window_words`` adds up the distinct words of each run of
    WINDOW words (the last is shorter), from the first word of the text to the
    last, so that its share of ``n_words`` does not fall as texts get longer.
    Texts that are NULL or empty measure 0 throughout.
    """
    out = {c: np.zeros(len(texts), np.int64) for c in COLUMNS}
    tables = {
        "n_symbols": _flags(SYMBOLS),
        "n_upper": _flags(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"),
        "n_lower": _flags(b"abcdefghijklmnopqrstuvwxyz"),
        "n_digits": _flags(b"0123456789"),
        "n_marks": _flags(b"!?"),
        "n_ends": _flags(b".,;:"),
    }
    for first, data, offsets in tk.slices(texts):
        rows = slice(first, first + len(offsets) - 1)
        n_texts = len(offsets) - 1
        found = tk.words(data, offsets)
        hashes = tk.word_hashes(data, found)
        own = tk.owners(found.bounds)
        head = (data & 0xC0) != 0x80
        out["n_bytes"][rows] = np.diff(offsets)
        out["n_words"][rows] = np.diff(found.bounds)
        out["word_chars"][rows] = tk.per_text(found.inside & head, offsets)
        out["n_wide"][rows] = tk.per_text(data >= 0xC0, offsets)
        for name, table in tables.items():
            out[name][rows] = tk.per_text(table[data], offsets)
        out["n_lines"][rows], out["n_dup_lines"][rows] = _lines(data, offsets, found.inside)
        keys, at = tk.windows(hashes, found.bounds, tk.SHINGLE)
        twice = at[tk.repeated(keys, own[at])]
        edge = np.zeros(len(hashes) + tk.SHINGLE + 1, np.int64)
        np.add.at(edge, twice, 1)
        np.add.at(edge, twice + tk.SHINGLE, -1)
        covered = np.cumsum(edge)[: len(hashes)] > 0
        out["n_repeat_words"][rows] = tk.per_text(covered, found.bounds)
        out["n_distinct_words"][rows] = _distinct(hashes, own, n_texts)
        out["n_window_words"][rows] = _window_distinct(hashes, found.bounds, own)
        lengths = found.ends - found.starts
        out["n_short_words"][rows] = tk.per_text(lengths <= 2, found.bounds)
        longest = np.zeros(n_texts, np.int64)
        np.maximum.at(longest, own, lengths)
        out["longest_word"][rows] = longest
    return out
