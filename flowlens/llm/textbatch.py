"""Numpy helpers for operators that read texts in Arrow batches."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash

from flowlens.llm.common import WORD_RE

#: Texts are handled together up to this many characters; a longer text alone.
CHARS = 2_000_000
#: Words whose hash a task remembers.
REMEMBERED = 300_000
MIX1, MIX2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)  # SplitMix64's multipliers
POWER = np.uint64(0x9E3779B97F4A7C15)


class WordHashes(dict):
    """64-bit hashes of words, remembered within a bound."""

    def __missing__(self, word: str) -> int:
        if len(self) > REMEMBERED:
            self.clear()
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h

    def of(self, words: list[str]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * MIX1
    x = (x ^ (x >> np.uint64(27))) * MIX2
    return x ^ (x >> np.uint64(31))


def windows(h: np.ndarray, n: int) -> np.ndarray:
    """Hashes of all runs of n word hashes, in order."""
    out = h[:len(h) - n + 1].copy()
    for i in range(1, n):
        out = out * POWER + h[i:len(h) - n + 1 + i]
    return mix(out)


def split(text: str | None) -> list[str]:
    return WORD_RE.findall(text) if text else []


def slices(batch: pa.RecordBatch, text: int = 1) -> Iterator[pa.RecordBatch]:
    """The batch in pieces of about CHARS bytes of text."""
    sizes = np.diff(np.frombuffer(batch.column(text).buffers()[1], np.int32)[batch.column(text).offset:][:len(batch) + 1]) \
        if batch.column(text).type == pa.string() else np.array([len(x or "") for x in batch.column(text).to_pylist()])
    start, total = 0, 0
    for i, n in enumerate(sizes):
        if total and total + n > CHARS:
            yield batch.slice(start, i - start)
            start, total = i, 0
        total += int(n)
    if start < len(batch):
        yield batch.slice(start)


def lists(flat: np.ndarray, counts: np.ndarray, kind: pa.DataType) -> pa.ListArray:
    """An Arrow array of lists from their concatenation and their lengths."""
    offsets = np.zeros(len(counts) + 1, np.int32)
    np.cumsum(counts, out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat, kind))
