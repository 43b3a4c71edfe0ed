"""Whole texts as ids of a public tokenizer, each distinct chunk encoded once per worker.

A text is cut where the tokenizer's own splitting must start anew: between
words (word BPE, which drops white space) or before a single space or line
feed between two other characters (byte-level BPE). The ids of a text are then
the ids of its chunks one after another; chunks repeat, so a worker keeps their
ids. Tokenizers with other normalizers or splitting encode whole texts.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from tablequill.llm import textkernel as tk

# Chunks a worker remembers; it starts again when it has seen so many.
REMEMBERED = 1_500_000
SLICE_BYTES = 2 << 20

_WORD_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


def _kind(settings: dict) -> str:
    """"byte", "word", or "" for a tokenizer whose texts must not be cut."""
    before, norm = settings.get("pre_tokenizer") or {}, settings.get("normalizer")
    model = settings.get("model") or {}
    if model.get("type") != "BPE" or model.get("dropout") or settings.get("post_processor"):
        return ""
    if before.get("type") == "ByteLevel" and norm is None:
        return "byte" if before.get("use_regex") and not before.get("add_prefix_space") else ""
    steps = [n.get("type") for n in (norm or {}).get("normalizers", [])]
    splits = before.get("pretokenizers", [])
    if steps == ["NFC", "Replace", "Lowercase"] and len(splits) == 2:
        plain = splits[0].get("pattern", {}).get("Regex") == _WORD_SPLIT
        last = splits[1].get("type") == "ByteLevel" and not splits[1].get("use_regex")
        if plain and last and not splits[1].get("add_prefix_space"):
            return "word"
    return ""


def _byte_letters() -> list[str]:
    """The printable character that stands for each byte in byte-level BPE."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out, extra = [""] * 256, 256
    for b in range(256):
        if b in plain:
            out[b] = chr(b)
        else:
            out[b], extra = chr(extra), extra + 1
    return out


class Encoder:
    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        # special tokens written out in a text are ordinary text
        self.whole.encode_special_tokens = True
        with open(path, encoding="utf-8") as f:
            self.kind = _kind(json.load(f))
        self.model = self.whole.model
        letters = _byte_letters()
        self.mapped = {c: "".join(letters[b] for b in chr(c).encode()) for c in range(0xC0, 0x100)}
        # chunks of letters (Latin-1), then marks; they split in one way only
        self.simple = re.compile("( ?)([A-Za-zÀ-ÖØ-öø-ÿ]+)([!-&(-/:-@\\[-`{-~]*)")
        self._forget()

    def _forget(self) -> None:
        self.keys = np.empty(0, np.uint64)
        self.at = np.empty(0, np.int32)
        self.size = np.empty(0, np.int32)
        self.ids = np.empty(0, np.uint32)

    def _chunks(self, texts: list[str]) -> tuple[list[int], list[int]]:
        """(ids of all chunks one after another, ids per chunk)"""
        tokenize, match, mapped = self.model.tokenize, self.simple.fullmatch, self.mapped
        lower = self.kind == "word"
        found = [match(text) for text in texts]
        hard = [text for text, m in zip(texts, found) if m is None]
        whole = iter(self.whole.encode_batch_fast(hard, add_special_tokens=False))
        flat: list[int] = []
        sizes = []
        for m in found:
            if m is None:
                ids = next(whole).ids
            else:
                space, word, marks = m.groups()
                if lower:
                    word = word.lower()
                word = word.translate(mapped)
                ids = [t.id for t in tokenize("Ġ" + word if space else word)]
                if marks:
                    ids += [t.id for t in tokenize(marks)]
            flat += ids
            sizes.append(len(ids))
        return flat, sizes

    def _cuts(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(bytes of the chunks, chunk lengths, chunks per text) of non-empty texts."""
        if self.kind == "word":
            found = tk.words(data, offsets)
            return found.starts, found.ends, found.bounds
        blank = np.zeros(256, bool)
        blank[[*range(0x09, 0x0E), *range(0x1C, 0x21)]] = True
        n = len(data)
        one = np.flatnonzero((data == 0x20) | (data == 0x0A))
        one = one[(one >= 3) & (one + 3 < n)]
        edge = np.zeros(n + 1, bool)
        edge[offsets] = True
        before, after = data[one - 1], data[one + 1]
        fine = ~blank[before] & ~blank[after] & ~edge[one] & ~edge[one + 1]
        # white space beyond ASCII may stand there: C2 85, C2 A0 and some three-byte characters
        fine &= ~((data[one - 2] == 0xC2) & ((before == 0x85) | (before == 0xA0)))
        fine &= ~((data[one - 3] >= 0xE1) & (data[one - 3] <= 0xE3) & (before >= 0x80))
        fine &= ~((after == 0xC2) & ((data[one + 2] == 0x85) | (data[one + 2] == 0xA0)))
        fine &= ~((after >= 0xE1) & (after <= 0xE3))
        one = one[fine]
        begins = np.zeros(n, bool)
        begins[offsets[:-1][np.diff(offsets) > 0]] = True
        begins[one] = True
        begins[one[data[one] == 0x0A] + 1] = True
        starts = np.flatnonzero(begins)
        return starts, np.concatenate([starts[1:], [n]]), np.searchsorted(starts, offsets)

    def _remember(self, data, starts, ends, keys) -> None:
        texts = [data[a:b].tobytes().decode() for a, b in zip(starts.tolist(), ends.tolist())]
        ids, sizes = self._chunks(texts)
        size, flat = np.array(sizes, np.int32), np.array(ids, np.uint32)
        at = (len(self.ids) + np.cumsum(size) - size).astype(np.int32)
        order = np.argsort(np.concatenate([self.keys, keys]), kind="stable")
        self.keys = np.concatenate([self.keys, keys])[order]
        self.at = np.concatenate([self.at, at])[order]
        self.size = np.concatenate([self.size, size])[order]
        self.ids = np.concatenate([self.ids, flat])

    def _find(self, keys: np.ndarray) -> np.ndarray:
        at = np.minimum(np.searchsorted(self.keys, keys), max(len(self.keys) - 1, 0))
        return np.where(self.keys[at] == keys, at, -1) if len(self.keys) else np.full(len(keys), -1)

    def encode(self, texts: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(first text, ids, bounds): the ids of text ``first + i`` are ids[bounds[i]:bounds[i + 1]]."""
        for first, data, offsets in tk.slices(texts, SLICE_BYTES):
            if not self.kind:
                raw = data.tobytes()
                parts = [raw[a:b].decode() for a, b in zip(offsets[:-1], offsets[1:])]
                lists = [e.ids for e in self.whole.encode_batch_fast(parts, add_special_tokens=False)]
                sizes = [len(x) for x in lists]
                flat = np.fromiter((i for x in lists for i in x), np.uint32, sum(sizes))
                yield first, flat, np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
                continue
            starts, ends, bounds = self._cuts(data, offsets)
            inside = data
            if self.kind == "word":
                edges = np.zeros(len(data) + 1, np.int8)
                edges[starts] += 1
                edges[ends] -= 1
                inside = data[np.cumsum(edges[:-1], dtype=np.int8) > 0]
            keys = tk.span_hashes(inside, ends - starts)
            distinct, one, back = np.unique(keys, return_index=True, return_inverse=True)
            known = self._find(distinct)
            new = np.flatnonzero(known < 0)
            if len(new):
                if len(self.keys) + len(new) > REMEMBERED and len(self.keys):
                    self._forget()
                    new = np.arange(len(distinct))
                self._remember(data, starts[one[new]], ends[one[new]], distinct[new])
                known = self._find(distinct)
            known = known[back]
            sizes = self.size[known]
            total = np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)])
            place = np.repeat(self.at[known] - total[:-1], sizes) + np.arange(total[-1])
            yield first, self.ids[place], total[bounds]


def encoder(path: str) -> Encoder:
    """The worker's encoder for a tokenizer file, kept from task to task."""
    kept = tk.worker_cache().setdefault("encoders", {})
    if path not in kept:
        kept[path] = Encoder(path)
    return kept[path]


def with_end(ids: np.ndarray, bounds: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray]:
    """The same ids with ``end`` behind those of every text."""
    n = len(bounds) - 1
    last = bounds[1:] + np.arange(n)
    out = np.empty(len(ids) + n, np.uint32)
    rest = np.ones(len(out), bool)
    rest[last] = False
    out[rest] = ids
    out[last] = end
    return out, bounds + np.arange(n + 1)
