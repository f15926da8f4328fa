"""Benchmark decontamination with a positional inverted index.

The index is a table of segments, each a block of documents with the sorted positions of every term that a test item
uses (a term outside all items can be in no match, so its postings are not kept). A search takes the stated test
phrases in blocks of bounded size against every segment: the positions of the rarest term of a phrase, shifted by its
place in the phrase, are intersected with the shifted lists of its other terms, rarest first. With ``slop`` each term
may lie that many words off its place (proximity match), and every start is tried that the rarest term allows, so the
choice of that term does not show in the result. Matches carry the number of their phrase; items are joined afterwards.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from blendscope.llm.shared import TERM, TERM_BYTES, lookup, stored

#: Words of a segment (a longer document is a segment by itself).
SEGMENT_WORDS = 1 << 19
#: Words of the phrases that are held in memory at a time.
BLOCK_WORDS = 500_000
#: Distinct words of all items up to which one index serves all blocks; beyond it each block has an index of its own.
INDEX_TERMS = 1_000_000
#: Candidates of a segment that are intersected at a time.
CANDIDATES = 1 << 20

INDEX = "keys array<string>, starts array<int>, terms array<string>, bounds array<int>, positions array<int>"
MATCH = "key string, n_words int, spans array<struct<a:int,b:int>>, phrases array<bigint>"


def text_key(text: str = "text") -> Column:
    """Key of the content; equal texts have equal results. Null has the key of the empty text."""
    return F.md5(F.coalesce(F.col(text), F.lit("")).cast("binary"))


def words(text: str) -> Column:
    lowered = F.translate(F.col(text), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.coalesce(F.regexp_extract_all(lowered, F.lit(TERM), F.lit(0)), F.array().cast("array<string>"))


def phrases(items: DataFrame, width: int) -> DataFrame:
    """Distinct phrases of the items with their number and the ids of the items that have them: every run of ``width``
    words, or all words of a shorter item. Items without words (or null) have none; a null id is left out of the ids,
    its phrases are not."""
    n = F.size("words")
    distinct = (
        items.select(F.col("item_id").cast("string").alias("item"), words("text").alias("words"))
        .filter(n > 0)
        .select("item", F.explode(F.transform(F.sequence(F.lit(1), F.greatest(n - width + 1, F.lit(1))), lambda i: F.slice("words", i, width))).alias("phrase"))
        .groupBy("phrase").agg(F.collect_set("item").alias("items"))
    )
    return distinct.withColumn("number", F.monotonically_increasing_id())


def index_documents(docs: DataFrame, vocabulary: list[str], gap: int = 1) -> DataFrame:
    """Stored index of ``docs`` (``key, text``) over the given terms; one pass, nothing is shuffled. ``gap`` places
    without a word lie before, between and behind the documents of a segment, so no match reaches from one to another."""
    shared = docs.sparkSession.sparkContext.broadcast({w.encode(): i for i, w in enumerate(vocabulary)})  # at most INDEX_TERMS, or the terms of a block

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        names = np.array([None] * len(known), object)
        for w, i in known.items():
            names[i] = w.decode("utf-8", "replace")
        none = np.full(gap, -1, np.int32)
        keys, parts, starts, at = [], [none], [gap], gap

        def segment():
            ids = np.concatenate(parts)
            pos = np.flatnonzero(ids >= 0).astype(np.int32)
            ids = ids[pos]
            order = np.argsort(ids, kind="stable")
            terms, first = np.unique(ids[order], return_index=True)
            return pa.RecordBatch.from_arrays(
                [pa.array([keys], pa.list_(pa.string())), pa.array([starts], pa.list_(pa.int32())), pa.array([names[terms].tolist()], pa.list_(pa.string())),
                 pa.array([np.append(first, len(ids)).astype(np.int32)], pa.list_(pa.int32())), pa.array([pos[order]], pa.list_(pa.int32()))],
                ["keys", "starts", "terms", "bounds", "positions"])

        for batch in batches:
            for key, text in zip(batch.column("key"), batch.column("text"), strict=True):
                tokens = (text.as_py() or "").encode("utf-8", "replace").translate(TERM_BYTES).split()
                if keys and at + len(tokens) > SEGMENT_WORDS:
                    yield segment()
                    keys, parts, starts, at = [], [none], [gap], gap
                keys.append(key.as_py())
                parts.append(np.fromiter(map(known.get, tokens, repeat(-1)), np.int32, len(tokens)))
                parts.append(none)
                at += len(tokens) + gap
                starts.append(at)
        if keys:
            yield segment()

    return stored(docs.select("key", "text").mapInArrow(build, INDEX), "postings")


class Phrases:
    """Phrases of a block as a matrix of term numbers."""

    def __init__(self, rows: list[tuple[list[str], int]]):
        self.terms = {t: i for i, t in enumerate(sorted({t for p, _ in rows for t in p}))}
        self.numbers = np.array([n for _, n in rows], np.int64)
        self.length = np.array([len(p) for p, _ in rows], np.int64)
        self.matrix = np.full((len(rows), int(self.length.max(initial=1))), -1, np.int64)
        for i, (p, _) in enumerate(rows):
            self.matrix[i, : len(p)] = [self.terms[t] for t in p]


def intersect(block: Phrases, lists: np.ndarray, count: np.ndarray, first: np.ndarray, slop: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Matches (phrase, start, position of the rarest term) in a segment. ``lists`` holds ``term << 32 | position`` in
    order; ``count`` and ``first`` give the length and place of each term's list."""
    padded = block.matrix < 0
    sizes = np.where(padded, np.iinfo(np.int64).max, count[block.matrix])
    alive = np.flatnonzero(sizes.min(axis=1) > 0)
    if not len(alive):
        return
    order = np.argsort(sizes[alive], axis=1, kind="stable")
    rarest = block.matrix[alive, order[:, 0]]
    upto = np.cumsum(count[rarest] * (2 * slop + 1))
    shifts = np.arange(-slop, slop + 1)
    cut = 0
    while cut < len(alive):
        done = upto[cut - 1] if cut else 0
        end = max(cut + 1, int(np.searchsorted(upto, done + CANDIDATES, "right")))
        lengths = count[rarest[cut:end]]
        row = np.repeat(np.arange(cut, end), lengths)
        inside = np.arange(len(row)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
        row, seen = (np.repeat(x, len(shifts)) for x in (row, lists[first[rarest[row]] + inside] & 0xFFFFFFFF))
        start = seen - order[row, 0] + np.tile(shifts, len(row) // len(shifts))
        for k in range(1, block.matrix.shape[1]):
            place = order[row, k]
            term = block.matrix[alive[row], place]
            low = start + place - slop  # not negative: the gap before the first document is longer than a phrase
            found = lists[np.minimum(np.searchsorted(lists, term << 32 | low), len(lists) - 1)]
            keep = (term < 0) | (found >> 32 == term) & (found >= term << 32 | low) & (found <= term << 32 | low + 2 * slop)
            row, start, seen = row[keep], start[keep], seen[keep]
        yield alive[row], start, seen
        cut = end


def search(index: DataFrame, block: Phrases, slop: int = 0, gap: int = 1) -> DataFrame:
    """Per indexed document: number of words, merged spans of words in matches, numbers of the phrases that match."""
    shared = index.sparkSession.sparkContext.broadcast(vars(block))  # at most BLOCK_WORDS words of test items

    def match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = SimpleNamespace(**shared.value)
        for batch in batches:
            for r in range(batch.num_rows):
                keys, starts, terms, bounds, positions = (batch.column(c)[r].values for c in ("keys", "starts", "terms", "bounds", "positions"))
                starts, bounds, positions = (x.to_numpy().astype(np.int64) for x in (starts, bounds, positions))
                sizes = np.diff(starts) - gap
                spans = [[] for _ in range(len(keys))]
                hits: list[set] = [set() for _ in range(len(keys))]
                number = np.array([block.terms.get(t, -1) for t in terms.to_pylist()], np.int64)
                use = number >= 0
                size, slots = np.diff(bounds), np.zeros(len(block.terms) + 1, np.int64)
                count, first = slots.copy(), slots
                count[number[use]] = size[use]
                by_term = np.argsort(np.repeat(number, size), kind="stable")
                lists = (np.repeat(number, size) << 32 | positions)[by_term]
                first[:-1] = np.searchsorted(lists, np.arange(len(block.terms), dtype=np.int64) << 32)
                for phrase, start, seen in intersect(block, lists, count, first, slop) if len(lists) else ():
                    doc = np.searchsorted(starts, seen, "right") - 1
                    for d, p in np.unique(np.stack([doc, phrase], 1), axis=0).tolist():
                        hits[d].add(int(block.numbers[p]))
                    low = np.maximum(start - starts[doc], 0)  # with slop a match may reach beyond the text
                    high = np.minimum(start - starts[doc] + block.length[phrase], sizes[doc])
                    sort = np.argsort(low, kind="stable")
                    sort = sort[low[sort] < high[sort]]
                    for d, a, b in zip(doc[sort].tolist(), low[sort].tolist(), high[sort].tolist(), strict=True):
                        if spans[d] and a <= spans[d][-1]["b"] and a >= spans[d][-1]["a"]:
                            spans[d][-1]["b"] = max(b, spans[d][-1]["b"])
                        else:
                            spans[d].append({"a": a, "b": b})
                yield pa.RecordBatch.from_arrays(
                    [keys, pa.array(sizes, pa.int32()), pa.array(spans, pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32())]))),
                     pa.array([sorted(x) for x in hits], pa.list_(pa.int64()))], ["key", "n_words", "spans", "phrases"])

    return index.mapInArrow(match, MATCH)


def find_matches(docs: DataFrame, benchmark: DataFrame, width: int = 10, slop: int = 0) -> DataFrame:
    """Matches of each distinct text of ``docs`` (column text): ``key, n_words, n_hit, items, spans``.

    ``benchmark`` has item_id and text. A match is an occurrence of ``width`` consecutive item words, or of all words
    of a shorter item. With ``slop`` it is any start from which each word of the phrase lies within ``slop`` words of
    its place (the start may lie beyond the edge of the text, the words may not). ``n_hit`` counts the words of the
    text from the start of a match on, as many as the phrase has. Null and empty texts have no words. Repeated items
    and texts change nothing; an item without id hits words but is in no list. Without items nothing matches.
    """
    keyed = docs.select(text_key().alias("key"), "text")
    wanted = stored(phrases(benchmark, width), "phrases")
    n_words = wanted.agg(F.sum(F.size("phrase"))).first()[0] or 0
    n_blocks = max(1, -(-n_words // BLOCK_WORDS))
    lane = F.pmod(F.xxhash64("phrase"), F.lit(n_blocks))
    gap, index, found = width + 2 * slop, None, None  # a phrase with its slop spans less than a gap and two words
    if n_blocks > 1:
        terms = wanted.select(F.explode("phrase").alias("t")).distinct()
        if terms.count() <= INDEX_TERMS:
            index = index_documents(keyed, [r["t"] for r in terms.collect()], gap)  # at most INDEX_TERMS words
    for b in range(n_blocks):
        block = Phrases([(r["phrase"], r["number"]) for r in wanted.filter(lane == b).select("phrase", "number").collect()])  # about BLOCK_WORDS words
        here = index_documents(keyed, list(block.terms), gap) if index is None else index
        part = search(here, block, slop, gap).groupBy("key").agg(F.first("n_words").alias("n_words"), F.first("spans").alias("spans"), F.first("phrases").alias("phrases"))
        found = part if found is None else found.unionByName(part)
    if n_blocks > 1:  # the parts of a text, one from each block
        found = found.groupBy("key").agg(F.first("n_words").alias("n_words"), F.flatten(F.collect_list("spans")).alias("spans"),
                                         F.flatten(F.collect_list("phrases")).alias("phrases"))
    found = stored(found, "matches")
    named = (
        found.select("key", F.explode("phrases").alias("number")).join(wanted.select("number", "items"), "number")
        .select("key", F.explode("items").alias("item")).groupBy("key").agg(F.array_sort(F.collect_set("item")).alias("items"))
    )
    hit = F.aggregate(
        F.array_sort("spans"), F.struct(F.lit(0).alias("n"), F.lit(0).alias("end")),
        lambda s, x: F.struct((s["n"] + F.greatest(F.lit(0), x["b"] - F.greatest(x["a"], s["end"]))).alias("n"), F.greatest(s["end"], x["b"]).alias("end")),
    )["n"]
    return found.join(named, "key", "left").select(
        "key", "n_words", hit.alias("n_hit"), F.coalesce("items", F.array().cast("array<string>")).alias("items"), F.array_sort("spans").alias("spans"))


def decontaminate(docs: DataFrame, benchmark: DataFrame, width: int = 10, slop: int = 0) -> DataFrame:
    """``docs`` with ``n_words, n_hit, items, spans`` of ``find_matches``, one row per input row.

    Spans are half-open word ranges. Input columns with the names of the new ones are replaced.
    """
    matches = find_matches(docs, benchmark, width, slop)
    return lookup(docs, text_key(), matches, "key", n_words=lambda c: c("n_words").cast("long"), n_hit=lambda c: c("n_hit").cast("long"),
                  items=lambda c: c("items"), spans=lambda c: c("spans"))
