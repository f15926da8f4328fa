"""Periodic runs of words: stretches in which the same few words come again and again.

A run of period q matches itself shifted by q over a guaranteed number of words. For a class of lags the smallest such
number is the length of the k-grams that are indexed, at least twice the largest lag of the class. Then the previous
occurrence of a k-gram inside a run is exactly one period away (a nearer one would give the run a smaller period), so
the pairs of neighbouring occurrences are all seeds that are needed and their number is linear. Seeds lie on the
diagonal of their lag; a table of the furthest word that each lag covers suppresses those inside a stretch that is
already extended.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from blendscope.llm.shared import replace_columns
from blendscope.llm.wordblocks import Grams, blocks, join, mix, split, word_hashes

RESULT = "struct<n_words:bigint,runs:array<struct<start:bigint,length:bigint,period:bigint>>,collapsed:string>"


@lru_cache(maxsize=64)
def lag_classes(longest: int, least: int, exponent: int) -> list[tuple[int, int, int]]:
    """(lowest lag, highest lag, k) for all periods that a text of ``longest`` words can have."""
    def overlap(q: int) -> int:
        return max(least, exponent * q) - q

    out, low = [], 1
    while max(least, exponent * low) <= longest:
        high, k = low, overlap(low)
        while min(k, overlap(high + 1)) >= 2 * (high + 1):
            high += 1
            k = min(k, overlap(high))
        out.append((low, high, k))
        low = high + 1
    return out


def find_runs(hashes: np.ndarray, bounds: np.ndarray, least: int, exponent: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, length and period of all runs of the texts that ``bounds`` cut from ``hashes``, by start, then period."""
    size = np.diff(bounds)
    text = np.repeat(np.arange(len(size)), size)
    end = bounds[1:][text]
    grams = Grams(hashes)
    seeds = np.arange(len(hashes))
    found = []
    for low, high, k in lag_classes(int(size.max(initial=0)), least, exponent):
        seeds = seeds[seeds + k <= end[seeds]]
        if not len(seeds):
            break
        key = mix(grams.of(k)[seeds], text[seeds])
        order = np.argsort(key, kind="stable")
        sorted_key = key[order]
        twin = np.flatnonzero(sorted_key[1:] == sorted_key[:-1])
        first, lag = seeds[order[twin]], seeds[order[twin + 1]] - seeds[order[twin]]
        use = (lag >= low) & (lag <= high)
        found.append(cover(first[use], lag[use], k))
        # a longer k-gram that occurs again has a shorter one that occurs again
        seeds = np.sort(seeds[np.unique(order[np.concatenate([twin, twin + 1])])])
    start, length, period = (np.concatenate([f[i] for f in found]) if found else np.zeros(0, np.int64) for i in range(3))
    keep = length >= np.maximum(least, exponent * period)
    start, length, period = start[keep], length[keep], period[keep]
    by = np.lexsort((period, start))
    return start[by], length[by], period[by]


def cover(first: np.ndarray, lag: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Longest stretches on the diagonals: a seed at or before the furthest word that its lag covers extends the same
    stretch, any other one opens a new one."""
    if not len(first):
        return first, first, lag
    order = np.lexsort((first, lag))
    first, lag = first[order], lag[order]
    opens = np.concatenate([[True], (lag[1:] != lag[:-1]) | (first[1:] > first[:-1] + k)])
    last = np.concatenate([np.flatnonzero(opens)[1:] - 1, [len(first) - 1]])
    return first[opens], first[last] + k - first[opens] + lag[opens], lag[opens]


def scan(text: pa.Array, least: int, exponent: int) -> Iterator[pa.Array]:
    """RESULT of every text, block by block."""
    for rows in blocks(text):
        words, bounds = split(text[rows])
        start, length, period = find_runs(word_hashes(words.dictionary_encode()), bounds, least, exponent)
        owner = np.searchsorted(bounds, start, "right") - 1
        drops = np.zeros(len(words) + 1, np.int64)
        np.add.at(drops, start + period, 1)
        np.add.at(drops, start + length, -1)
        runs = pa.ListArray.from_arrays(
            pa.array(np.searchsorted(owner, np.arange(len(bounds))), pa.int32()),
            pa.StructArray.from_arrays([pa.array(x, pa.int64()) for x in (start - bounds[owner], length, period)], ["start", "length", "period"]))
        yield pa.StructArray.from_arrays(
            [pa.array(np.diff(bounds), pa.int64()), runs, join(words, bounds, np.cumsum(drops[:-1]) == 0)], ["n_words", "runs", "collapsed"])


def run_column(text: Column, least: int = 6, exponent: int = 4) -> Column:
    """Words, runs and collapsed text of ``text`` as one struct."""
    if exponent < 3:
        raise ValueError("a run has at least three periods")

    @F.arrow_udf(RESULT)
    def detect(column: pa.Array) -> pa.Array:
        parts = list(scan(column, least, exponent))
        return pa.concat_arrays(parts) if parts else pa.array([], EMPTY)

    return detect(text)


EMPTY = pa.struct([("n_words", pa.int64()), ("runs", pa.list_(pa.struct([(n, pa.int64()) for n in ("start", "length", "period")]))), ("collapsed", pa.string())])


def collapse_runs(docs: DataFrame, text: str = "text", least: int = 6, exponent: int = 4) -> DataFrame:
    """``docs`` with ``n_words``, ``runs`` and ``collapsed``, one row per input row; nothing is shuffled.

    Words are stretches without white space, numbered from 0. A run is a stretch of at least ``least`` words and
    ``exponent`` (3 or more) times its smallest period that no neighbouring word extends; runs come by start, then
    period. ``collapsed`` joins, with single spaces, the words that no run contains after its first period. A null,
    empty or blank text has no words and no runs and collapses to the empty text. Equal texts give equal results;
    input columns with the names of the new ones are replaced. A text is held whole by the task that has its row.
    """
    found = docs.select(F.struct("*").alias("row"), run_column(F.col(text), least, exponent).alias("found"))
    return replace_columns(found, "row", n_words=F.col("found.n_words"), runs=F.col("found.runs"), collapsed=F.col("found.collapsed"))
