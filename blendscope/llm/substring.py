"""Removal of repeated passages: of every window of words only the first occurrence in the corpus stays.

Windows are routed by their minimiser, the smallest hash of the short n-grams inside. Consecutive windows that share it
travel as one packed string (a super-k-mer) to the bucket of the minimiser; equal windows have equal minimisers, so a
bucket holds all occurrences of its windows and sorting them finds the first of each. Two things keep buckets small:
within a block of documents only the first occurrence of a window is sent, since the others are later than that one
whatever else the corpus holds; and n-grams that are frequent in the corpus rank last as minimisers, so that the many
different windows around a common passage are routed by their own words and not by the passage. The packed strings
write frequent words as 16-bit codes and spell out the rare ones, which is what keeps the shuffle small; words stay
told apart exactly.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from blendscope.llm.shared import discard, lookup, stored
from blendscope.llm.wordblocks import Grams, blocks, join, mix, split, word_hashes

#: Words of the n-grams whose hashes are the minimisers.
GRAM = 3
#: Bytes of text that a task treats at a time (a longer text is a block by itself).
BLOCK = 3 << 20
#: An n-gram or word that a block holds that often is counted. The most frequent n-grams rank last and the
#: most frequent words get a short code. Both only decide how windows travel; results are the same for every setting.
OFTEN = 4
MOST_FREQUENT = 1 << 18
#: Words with a code, from 1 on; 0 stands for the next word of the row's rare ones.
CODES = (1 << 16) - 1
#: Words of packed strings that are sorted at a time (a larger bucket is sorted alone).
BUCKET_WORDS = 1 << 18

PACKED = "key int, id bigint, content bigint, start int, stop int, packed binary, rare string"
SPAN = "id bigint, content bigint, start int, stop int"
LAST_ID = (1 << 63) - 1


def document_key(doc_id: str, text: str, content: bool) -> Column:
    """Rows with equal id and text have equal results; rows without id come after all others. Where ids are unique,
    the content is left out."""
    digest = F.xxhash64(F.coalesce(F.col(text), F.lit(""))) if content else F.lit(0).cast("long")
    return F.struct(F.coalesce(F.col(doc_id).cast("long"), F.lit(LAST_ID)).alias("id"), digest.alias("content"))


def ids_repeat(docs: DataFrame, doc_id: str) -> bool:
    return not docs.groupBy(F.col(doc_id)).agg(F.count("*").alias("n")).filter("n > 1").isEmpty()


def repeated(words: np.ndarray, at: np.ndarray, hashes: np.ndarray, ids: np.ndarray, starts: np.ndarray, width: int) -> np.ndarray:
    """Which of the windows that begin at ``at`` in ``words`` (numbers) also begin earlier: under a smaller id, or under
    the same id at a smaller start. Windows are sorted by hash; neighbours are compared word by word."""
    order = np.lexsort((starts, ids, hashes)) if np.any((ids[1:] == ids[:-1]) & (starts[1:] <= starts[:-1]) | (ids[1:] < ids[:-1])) else np.argsort(hashes, kind="stable")
    same = hashes[order][1:] == hashes[order][:-1]
    view = np.lib.stride_tricks.sliding_window_view(words, width) if len(words) >= width else np.zeros((0, width), words.dtype)
    pairs = np.flatnonzero(same)
    for c in range(0, len(pairs), 1 << 16):
        p = pairs[c: c + (1 << 16)]
        if not (view[at[order[p]]] == view[at[order[p + 1]]]).all():  # different windows of one hash: sort by the words
            order = np.lexsort((starts, ids, *(words[at + i] for i in range(width))))
            sequence = view[at[order]]
            same = (sequence[1:] == sequence[:-1]).all(axis=1)
            break
    head = np.maximum.accumulate(np.where(np.concatenate([[True], ~same]), np.arange(len(order)), 0))
    out = np.zeros(len(order), bool)
    out[order] = (ids[order] != ids[order[head]]) | (starts[order] != starts[order[head]])
    return out


def ranges(flags: np.ndarray, row: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last index of every maximal stretch of flagged windows that follow each other in one row."""
    hit = np.flatnonzero(flags)
    if not len(hit):
        return hit, hit
    new = np.concatenate([[True], (at[hit[1:]] != at[hit[:-1]] + 1) | (row[hit[1:]] != row[hit[:-1]])])
    return hit[new], hit[np.concatenate([np.flatnonzero(new)[1:] - 1, [len(hit) - 1]])]


def windows(bounds: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """First word and row of every window that lies inside a row."""
    size = np.diff(bounds)
    row = np.repeat(np.arange(len(size)), size)
    at = np.arange(len(row))
    fits = at + width <= bounds[1:][row]
    return at[fits], row[fits]


class Block:
    """Words of some documents with the windows that lie inside one document."""

    def __init__(self, text: pa.Array, width: int):
        self.words, self.bounds = split(text)
        encoded = self.words.dictionary_encode()
        self.number, self.names = encoded.indices.to_numpy(), encoded.dictionary
        self.hash = word_hashes(encoded)
        self.at, self.row = windows(self.bounds, width)


def sliding_min(x: np.ndarray, n: int) -> np.ndarray:
    width = 1
    while 2 * width <= n:
        x = np.minimum(x[:-width], x[width:])
        width *= 2
    return np.minimum(x[: len(x) - (n - width)], x[n - width:])


def frequent(keyed: DataFrame, gram: int) -> tuple[np.ndarray, dict[str, int]]:
    """Hashes of the n-grams that are most frequent in all documents, in order, and codes of the most frequent words: at
    most MOST_FREQUENT and CODES."""

    def often(names, n: np.ndarray, kind: str) -> pa.RecordBatch:
        held = n >= OFTEN
        word, number = (names.filter(pa.array(held)), pa.nulls(held.sum(), pa.int64())) if kind == "word" else (pa.nulls(held.sum(), pa.string()), pa.array(names[held].view(np.int64)))
        return pa.RecordBatch.from_arrays([word, number, pa.array(n[held], pa.int64())], ["word", "gram", "n"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in blocks(batch.column("text"), BLOCK):
                block = Block(batch.column("text")[part], gram)
                yield often(block.names, np.bincount(block.number, minlength=len(block.names)), "word")
                if len(block.at):
                    yield often(*np.unique(Grams(block.hash).of(gram)[block.at], return_counts=True), "gram")

    counted = stored(keyed.select("text").mapInArrow(count, "word string, gram bigint, n bigint").groupBy("word", "gram").agg(F.sum("n").alias("n")), "frequent")
    grams = counted.filter("gram is not null").orderBy(F.desc("n"), "gram").limit(MOST_FREQUENT).select("gram").toArrow()
    words = counted.filter("word is not null").orderBy(F.desc("n"), "word").limit(CODES).select("word").toArrow()
    discard(counted)
    return np.sort(grams.column(0).to_numpy().view(np.uint64)), {w: i + 1 for i, w in enumerate(words.column(0).to_pylist())}


def pack(keyed: DataFrame, width: int, gram: int, late: np.ndarray, codes: dict[str, int]) -> DataFrame:
    """Super-k-mers of all documents, and (without packed string) the spans of windows that repeat inside a block."""
    shared = keyed.sparkSession.sparkContext.broadcast((late, codes))  # at most MOST_FREQUENT numbers and CODES words

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        late, codes = shared.value
        for batch in batches:
            batch = batch.sort_by("id")
            pa.default_memory_pool().release_unused()
            for part in blocks(batch.column("text"), BLOCK):
                b = Block(batch.column("text")[part], width)
                if not len(b.at):
                    continue
                ids, content = (batch.column(c)[part].to_numpy(zero_copy_only=False) for c in ("id", "content"))
                start = b.at - b.bounds[b.row]
                grams = Grams(b.hash)
                rank = grams.of(gram)
                if len(late):
                    known = late[np.minimum(np.searchsorted(late, rank), len(late) - 1)] == rank
                    rank = rank >> np.uint64(1) | known.astype(np.uint64) << np.uint64(63)
                key = sliding_min(rank, width - gram + 1)[b.at]
                again = repeated(b.number, b.at, grams.of(width)[b.at], ids[b.row], start, width)
                a, z = ranges(again, b.row, b.at)
                yield packed(mix(ids[b.row[a]]), ids[b.row[a]], content[b.row[a]], start[a], start[z] + width, pa.nulls(len(a), pa.binary()), pa.nulls(len(a), pa.string()))
                send = np.flatnonzero(~again)
                if not len(send):
                    continue
                at, k = b.at[send], key[send]
                new = np.concatenate([[True], (at[1:] != at[:-1] + 1) | (k[1:] != k[:-1])])
                a = send[new]
                z = send[np.concatenate([np.flatnonzero(new)[1:] - 1, [len(send) - 1]])]
                yield packed(key[a], ids[b.row[a]], content[b.row[a]], start[a], start[z] + width, *coded(b, codes, b.at[a], b.at[z] + width))

    return keyed.mapInArrow(run, PACKED)


def coded(block: Block, codes: dict[str, int], a: np.ndarray, z: np.ndarray) -> tuple[pa.Array, pa.Array]:
    """Words a to z: their codes, and the words without one."""
    code = np.fromiter((codes.get(w, 0) for w in block.names.to_pylist()), np.uint16, len(block.names))
    size = z - a
    bounds = np.concatenate([[0], np.cumsum(size)])
    word = np.repeat(a - bounds[:-1], size) + np.arange(bounds[-1])
    values = code[block.number[word]]
    rare = np.flatnonzero(values == 0)
    spelled = join(block.words.take(pa.array(word[rare])), np.searchsorted(rare, bounds))
    return pa.Array.from_buffers(pa.binary(), len(a), [None, pa.py_buffer((2 * bounds).astype(np.int32)), pa.py_buffer(values)]), spelled


def decoded(packed: pa.Array, rare: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of the words (equal words of this call have equal numbers) and bounds of the rows."""
    offsets = np.frombuffer(packed.buffers()[1], np.int32, len(packed) + 1, packed.offset * 4).astype(np.int64)
    number = np.frombuffer(packed.buffers()[2] or b"", np.uint16)[offsets[0] // 2: offsets[-1] // 2].astype(np.int64)
    spelled = split(rare)[0].dictionary_encode().indices.to_numpy()
    number[number == 0] = (CODES + 1) + spelled.astype(np.int64)
    return number, (offsets - offsets[0]) // 2


def packed(key, ids, content, start, stop, words: pa.Array, rare: pa.Array) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array((np.asarray(key, np.uint64) >> np.uint64(32)).astype(np.uint32).view(np.int32)), pa.array(ids, pa.int64()), pa.array(content, pa.int64()),
         pa.array(start, pa.int32()), pa.array(stop, pa.int32()), words, rare], ["key", "id", "content", "start", "stop", "packed", "rare"])


def sort_buckets(buckets: DataFrame, width: int) -> DataFrame:
    """Spans of repeated windows from super-k-mers that lie together and in order by key."""

    def spans(rows: pa.Table) -> pa.RecordBatch:
        local = rows.filter(pc.is_null(rows["packed"])).drop_columns(["key", "packed", "rare"]).combine_chunks()
        rows = rows.filter(pc.is_valid(rows["packed"])).sort_by([("id", "ascending"), ("start", "ascending")])
        number, bounds = decoded(rows["packed"].combine_chunks(), rows["rare"].combine_chunks())
        at, row = windows(bounds, width)
        ids, content, first = (rows[c].to_numpy() for c in ("id", "content", "start"))
        start = first[row] + at - bounds[row]
        again = repeated(number, at, Grams(mix(number)).of(width)[at], ids[row], start, width) if len(at) else np.zeros(0, bool)
        a, z = ranges(again, row, at)
        found = [ids[row[a]], content[row[a]], start[a], start[z] + width]
        types = [pa.int64(), pa.int64(), pa.int32(), pa.int32()]
        return pa.RecordBatch.from_arrays(
            [pa.concat_arrays([*local[n].chunks, pa.array(f, t)]) for n, f, t in zip(("id", "content", "start", "stop"), found, types, strict=True)],
            ["id", "content", "start", "stop"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, words = [], 0
        for batch in batches:
            held.append(batch)
            words += batch.num_rows * width
            if words < BUCKET_WORDS:
                continue
            pa.default_memory_pool().release_unused()
            rows = pa.Table.from_batches(held)
            key = rows["key"].to_numpy()
            cut = int(np.searchsorted(key, key[-1]))  # the last key may go on in the next batch
            if cut:
                yield spans(rows.slice(0, cut))
                held = rows.slice(cut).to_batches()
                words = (len(key) - cut) * width
        if held:
            yield spans(pa.Table.from_batches(held))

    return buckets.mapInArrow(run, SPAN)


def repeated_spans(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", width: int = 20, gram: int = GRAM, content: bool = True) -> DataFrame:
    """``key`` (see ``document_key``) and ``spans`` (half-open word ranges, may overlap) of all documents that hold a
    window of ``width`` words which begins earlier too."""
    if not 0 < gram <= width:
        raise ValueError("a minimiser is not longer than a window")
    keyed = docs.select(document_key(doc_id, text, content).alias("key"), F.col(text).alias("text")).select("key.*", "text")
    supers = pack(keyed, width, gram, *frequent(keyed, gram))
    found = sort_buckets(supers.repartition("key").sortWithinPartitions("key"), width)
    return found.groupBy(F.struct("id", "content").alias("key")).agg(F.collect_set(F.struct("start", "stop")).alias("spans"))


def cut_column(text: Column, spans: Column) -> Column:
    """Number of words, removed words and remaining text of ``text`` without the word ranges."""

    @F.arrow_udf("struct<n_words:bigint,n_removed:bigint,kept_text:string>")
    def cut(column: pa.Array, ranges: pa.Array) -> pa.Array:
        parts = []
        for rows in blocks(column, BLOCK):
            words, bounds = split(column[rows])
            here = ranges[rows]
            size = pc.fill_null(pc.list_value_length(here), 0).to_numpy(zero_copy_only=False)
            base = np.repeat(bounds[:-1], size)
            flat = here.flatten()
            delta = np.zeros(len(words) + 1, np.int64)
            np.add.at(delta, base + flat.field("start").to_numpy(zero_copy_only=False), 1)
            np.add.at(delta, base + flat.field("stop").to_numpy(zero_copy_only=False), -1)
            keep = np.cumsum(delta[:-1]) == 0
            left = np.concatenate([[0], np.cumsum(keep)])
            n_words, n_kept = np.diff(bounds), np.diff(left[bounds])
            parts.append(pa.StructArray.from_arrays([pa.array(n_words, pa.int64()), pa.array(n_words - n_kept, pa.int64()), join(words, bounds, keep)],
                                                    ["n_words", "n_removed", "kept_text"]))
        return pa.concat_arrays(parts) if parts else pa.array([], pa.struct([("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_text", pa.string())]))

    return cut(text, spans)


def remove_repeats(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", width: int = 20) -> DataFrame:
    """``docs`` with ``n_words``, ``n_removed`` and ``kept_text``, one row per input row.

    A word goes when a window of ``width`` consecutive words that covers it also begins earlier: in a row with a smaller
    id, or with the same id at a smaller word. Windows are judged on the input. Words are stretches without white space;
    what stays is joined by single spaces. Null, empty and shorter texts lose nothing. Rows that repeat an id are one
    document to this rule, so equal rows get equal results; rows without id come last and are one document too. Input
    columns with the names of the new ones are replaced.
    """
    content = ids_repeat(docs, doc_id)
    spans = stored(repeated_spans(docs, text, doc_id, width, content=content), "repeats")
    cut = lookup(docs, document_key(doc_id, text, content), spans, "key", "left", **{CUT: lambda c: cut_column(F.col(f"`{text}`"), c("spans"))})
    kept = [F.col(f"`{c}`") for c in docs.columns if c.lower() not in ("n_words", "n_removed", "kept_text")]
    return cut.select(*kept, f"{CUT}.*")


CUT = "_cut_of_repeats"
