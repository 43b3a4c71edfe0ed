"""Terms of whole texts, lower-cased, as postings of bounded segments of documents.

A term is a maximal run of marked bytes of which only A-Z are lower-cased. Every
byte of a character beyond ASCII is marked, so terms are whole characters. The
terms themselves are compared, no hash stands for them.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa

from tablequill.llm import textkernel as tk

LETTERS = b"abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ"
DIGITS = b"0123456789"

# A segment is closed when it holds so many postings or documents.
SEGMENT_POSTINGS = 1_500_000
SEGMENT_DOCUMENTS = 32_768


def marked(chars: bytes) -> np.ndarray:
    """Table of the bytes of a term: ``chars`` and everything beyond ASCII."""
    table = np.zeros(256, bool)
    table[0x80:] = True
    table[list(chars)] = True
    return table


def _lower() -> np.ndarray:
    table = np.arange(256, dtype=np.uint8)
    table[65:91] += 32
    return table


class Postings(NamedTuple):
    first: int  # number of the first text in its batch
    sizes: np.ndarray  # terms of every text, with repeats
    docs: np.ndarray  # text number of a posting, ascending
    codes: np.ndarray  # its term as an index of ``vocabulary``, ascending in a text
    counts: np.ndarray  # how often the text holds the term
    vocabulary: pa.LargeStringArray


def strings(chars: np.ndarray, lengths: np.ndarray) -> pa.LargeStringArray:
    """Adjacent spans of bytes as strings."""
    offsets = np.zeros(len(lengths) + 1, np.int64)
    np.cumsum(lengths, out=offsets[1:])
    data = pa.py_buffer(np.ascontiguousarray(chars))
    return pa.LargeStringArray.from_buffers(len(lengths), pa.py_buffer(offsets), data)


def postings(texts: pa.Array, table: np.ndarray) -> Iterator[Postings]:
    """The postings of the texts, a slice of texts at a time; NULL has no terms."""
    lower = _lower()
    for first, data, offsets in tk.slices(texts):
        found = tk.words(data, offsets, table=table)
        sizes = np.diff(found.bounds)
        encoded = strings(lower[data[found.inside]], found.ends - found.starts).dictionary_encode()
        width = max(len(encoded.dictionary), 1)
        own = np.repeat(np.arange(len(sizes)), sizes)
        keys = own * width + encoded.indices.to_numpy(zero_copy_only=False)
        keys, counts = np.unique(keys, return_counts=True)
        narrow = (x.astype(np.int32) for x in (keys // width, keys % width, counts))
        yield Postings(first, sizes, *narrow, encoded.dictionary)


class Segment:
    """Postings of consecutive documents, collected until there are enough of them."""

    def __init__(self, most: int) -> None:
        self.most = most
        self.parts: list[Postings] = []
        self.columns: list[list[pa.Array]] = []
        self.documents = self.size = 0

    def add(self, part: Postings, columns: list[pa.Array]) -> None:
        """``columns`` has values for each of the part's documents, in their order."""
        self.parts.append(part)
        self.columns.append(columns)
        self.documents += len(part.sizes)
        self.size += len(part.docs)

    def full(self) -> bool:
        return self.size >= self.most or self.documents >= SEGMENT_DOCUMENTS

    def column(self, i: int) -> pa.Array:
        return pa.concat_arrays([c[i] for c in self.columns])

    def merged(self) -> Postings:
        """All postings with one vocabulary; the documents count through the segment."""
        words = pa.concat_arrays([p.vocabulary for p in self.parts]).dictionary_encode()
        recoded = words.indices.to_numpy(zero_copy_only=False)
        docs, codes, at, doc = [], [], 0, 0
        for p in self.parts:
            docs.append(p.docs + np.int32(doc))
            codes.append(recoded[at : at + len(p.vocabulary)][p.codes])
            at += len(p.vocabulary)
            doc += len(p.sizes)
        return Postings(
            0, np.concatenate([p.sizes for p in self.parts]), np.concatenate(docs),
            np.concatenate(codes), np.concatenate([p.counts for p in self.parts]), words.dictionary,
        )


def segments(
    batches: Iterator[pa.RecordBatch], text: int, columns: list[int], table: np.ndarray,
    most: int = SEGMENT_POSTINGS,
) -> Iterator[Segment]:
    """Segments of the documents of a task, of about ``most`` postings; ``text`` and
    ``columns`` are column numbers."""
    now = Segment(most)
    for batch in batches:
        for part in postings(batch.column(text), table):
            n = len(part.sizes)
            now.add(part, [batch.column(c).slice(part.first, n) for c in columns])
            if now.full():
                yield now
                now = Segment(most)
    if now.documents:
        yield now


def lists(values: np.ndarray, bounds: np.ndarray, kind: pa.DataType) -> pa.ListArray:
    """``values`` cut at ``bounds`` into a list column."""
    return pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(values, kind))
