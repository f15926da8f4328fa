"""Words of Arrow text columns as numbers, in blocks of bounded size, and hashes of their n-grams."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text that are split at a time (a longer text is a block by itself).
BLOCK_BYTES = 8 << 20


def blocks(text: pa.Array, limit: int = BLOCK_BYTES) -> Iterator[slice]:
    """Row ranges of a text column that hold about ``limit`` bytes each."""
    size = pc.fill_null(pc.binary_length(text), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    number = (np.cumsum(size) - size) // limit
    edges = np.concatenate([[0], np.flatnonzero(np.diff(number)) + 1, [len(size)]])
    for a, b in zip(edges[:-1], edges[1:], strict=True):
        if b > a:
            yield slice(int(a), int(b))


def split(text: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """All words (stretches without space or the characters 9 to 13) and the bounds of every row; null has none."""
    parts = pc.ascii_split_whitespace(pc.fill_null(text, ""))
    flat, bounds = parts.flatten(), parts.offsets.to_numpy().astype(np.int64)
    full = pc.greater(pc.binary_length(flat), 0)  # white space at the ends gives empty words
    upto = np.concatenate([[0], np.cumsum(full.to_numpy(zero_copy_only=False).astype(np.int64))])
    return flat.filter(full), upto[bounds - bounds[0]]


def join(words: pa.Array, bounds: np.ndarray, keep: np.ndarray | None = None) -> pa.Array:
    """One text per row: its words (those to keep) with single spaces."""
    if keep is not None:
        words = words.filter(pa.array(keep))
        bounds = np.concatenate([[0], np.cumsum(keep)])[bounds]
    return pc.binary_join(pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), words), " ")


def mix(a: np.ndarray, b: np.ndarray | int = 0) -> np.ndarray:
    """64-bit hash of pairs."""
    a, b = np.atleast_1d(np.asarray(a, np.uint64)), np.atleast_1d(np.asarray(b, np.uint64))
    x = a * np.uint64(0x9E3779B97F4A7C15) ^ (b + np.uint64(0x632BE59BD9B4E019)) * np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    return x ^ x >> np.uint64(29)


def word_hashes(words: pa.DictionaryArray) -> np.ndarray:
    """Hash of every word; it depends on the word alone."""
    names = np.array(words.dictionary.to_pylist(), object)
    return mix(pd.util.hash_array(names, categorize=False) if len(names) else np.zeros(0, np.uint64))[words.indices.to_numpy()]


class Grams:
    """Hashes of the n-grams at every position, built by doubling (lengths may be asked for in rising order)."""

    def __init__(self, first: np.ndarray):
        self.width, self.level = 1, first

    def of(self, n: int) -> np.ndarray:
        """Hash of the ``n`` values from each position that has so many."""
        while 2 * self.width <= n:
            self.level = mix(self.level[: -self.width], self.level[self.width:])
            self.width *= 2
        rest = n - self.width
        if not rest:
            return self.level
        return mix(self.level[: len(self.level) - rest], self.level[rest:])
