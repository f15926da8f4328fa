"""Near-duplicates by MinHash with tensored banding, links confirmed on full shingle sets.

Two collections of ``BANDS`` short bands are computed; every pair of one band from each forms a table, so
``BANDS ** 2`` tables need only ``2 * BANDS`` bands of minhashes. Two documents are candidates if they agree on a band
of either collection. At a similarity of 0.75 a pair is missed with a chance of about 2e-4, at 0.8 of 6e-6.

Buckets are never expanded into pairs at once. Members are first compared with the smallest member of their buckets,
then with the smallest members of all their buckets. Texts of buckets that still hold several components are joined
by prefixes of their sets, which forms a pair across components only if it can reach the similarity.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType

from blendscope.llm.components import components
from blendscope.llm.shared import LOWER, discard, lookup, stored

#: Words of a shingle.
SHINGLE = 5
#: Bands in each of the two collections, and minhashes of a band.
BANDS, ROWS = 24, 4
#: Shingles that are hashed at a time.
CHUNK = 4096

_rng = np.random.default_rng(20)
#: A random value for every byte; a shingle's hash is a polynomial in these.
BYTES = _rng.integers(0, 1 << 64, 256, np.uint64)
BASE = np.uint64(0x5851F42D4C957F2D)
BASE_INVERSE = np.uint64(pow(int(BASE), -1, 1 << 64))
SLOPES = _rng.integers(0, 1 << 64, 2 * BANDS * ROWS, np.uint64) | np.uint64(1)
OFFSETS = _rng.integers(0, 1 << 64, 2 * BANDS * ROWS, np.uint64)
#: Counters by which shingles are ordered, roughly rarest first; any order is right.
ORDER_SLOTS = 1 << 18
#: Text bytes whose powers of BASE are held at a time.
SPAN = 1 << 16
POWERS = np.cumprod(np.append(np.uint64(1), np.full(SPAN, BASE)), dtype=np.uint64)
INVERSES = np.cumprod(np.append(np.uint64(1), np.full(SPAN, BASE_INVERSE)), dtype=np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values."""
    x = (x ^ x >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ x >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
    return x ^ x >> np.uint64(31)


def shingles(text: str | None) -> np.ndarray:
    """Distinct hashes of the text's word 5-grams; of all words if there are fewer; none without words."""
    words = (text or "").encode("utf-8", "replace").translate(LOWER).split()
    if not words:
        return np.zeros(0, np.uint64)
    width, out, start = min(SHINGLE, len(words)), [], 0
    while start + width <= len(words):
        end, size = start, 0
        while end < len(words) and (size + len(words[end]) + 1 <= SPAN or end < start + width):  # words of one span
            size += len(words[end]) + 1
            end += 1
        raw = np.frombuffer(b" ".join(words[start:end]) + b" ", np.uint8)
        powers, inverses = (POWERS, INVERSES) if len(raw) <= SPAN else (
            np.cumprod(np.append(np.uint64(1), np.full(len(raw), b)), dtype=np.uint64) for b in (BASE, BASE_INVERSE))
        total = np.append(np.uint64(0), np.cumsum(BYTES[raw] * powers[: len(raw)], dtype=np.uint64))
        stops = np.flatnonzero(raw == 32) + 1
        begins = np.append(0, stops[:-1])[: len(stops) - width + 1]
        out.append(mix((total[stops[width - 1:]] - total[begins]) * inverses[begins]))
        start = end - width + 1
    return np.unique(np.concatenate(out))


def bands(sets: np.ndarray) -> np.ndarray:
    """One 64-bit value for each band of both collections."""
    low = np.full(len(SLOPES), np.iinfo(np.uint64).max, np.uint64)
    for i in range(0, len(sets), CHUNK):
        low = np.minimum(low, (sets[i:i + CHUNK, None] * SLOPES + OFFSETS).min(axis=0))
    folded = low.reshape(2 * BANDS, ROWS)
    out = np.zeros(2 * BANDS, np.uint64)
    for k in range(ROWS):
        out = mix(out * BASE + folded[:, k])
    return out.view(np.int64)


def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    with np.errstate(over="ignore"):
        for batch in batches:
            sets = [shingles(t.as_py()) for t in batch.column("text")]
            values = np.concatenate([bands(s) if len(s) else np.zeros(2 * BANDS, np.int64) for s in sets]) if sets else np.zeros(0, np.int64)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, len(values) + 1, 2 * BANDS), pa.int32()), pa.array(values))
            yield pa.RecordBatch.from_arrays([batch.column("key"), pa.array([len(s) for s in sets], pa.int64()), lists], ["key", "n_shingles", "bands"])


@F.pandas_udf(BooleanType())
def similar(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    """Whether two texts' full shingle sets have 100 * intersection >= 75 * union."""
    last: tuple = (None, None)
    with np.errstate(over="ignore"):
        for left, right in batches:
            out = []
            for a, b in zip(left, right, strict=True):
                if last[0] != b:  # rows of one centre follow each other
                    last = b, shingles(b)
                x, y = shingles(a), last[1]
                both = len(x) + len(y) - len(np.union1d(x, y))
                out.append(len(x) > 0 and 100 * both >= 75 * (len(x) + len(y) - both))
            yield pd.Series(out, dtype=bool)


def text_key(text: str = "text") -> Column:
    return F.md5(F.coalesce(F.col(text), F.lit("")).cast("binary"))


def sketches(docs: DataFrame) -> DataFrame:
    """One stored row per distinct text: ``node, key, n_shingles, bands``."""
    each = docs.select(text_key().alias("key"), "text").mapInArrow(sketch, "key string, n_shingles long, bands array<long>")
    one = each.groupBy("key").agg(F.first("n_shingles").alias("n_shingles"), F.first("bands").alias("bands"))
    return stored(one.select(F.monotonically_increasing_id().alias("node"), "*"), "sketches")


def table_rows(texts: DataFrame) -> DataFrame:
    """Stored ``node, n_shingles, table, centre`` of all rows in table buckets with several texts.

    A table key needs a shared band of either collection, so bands that only one text has are left out first and the
    pairs of bands are formed from the rest. ``centre`` is the smallest node of the bucket.
    """
    band = texts.filter("n_shingles > 0").select("node", "n_shingles", F.posexplode("bands").alias("band", "value")).select(
        "node", "n_shingles", "band", F.xxhash64("band", "value").alias("value"))
    shared = band.groupBy("value").agg(F.count("*").alias("n")).filter("n > 1").select("value")
    side = F.when(F.col("band") < BANDS, F.lit(0)).otherwise(1)
    kept = (
        band.join(shared, "value").groupBy("node", "n_shingles")
        .agg(F.collect_list(F.when(side == 0, F.col("value"))).alias("first"), F.collect_list(F.when(side == 1, F.col("value"))).alias("second"))
    )  # at most BANDS values in either list
    tables = stored(
        kept.select("node", "n_shingles", "second", F.explode("first").alias("one"))
        .select("node", "n_shingles", "one", F.explode("second").alias("two"))
        .select("node", "n_shingles", F.xxhash64("one", "two").alias("table")), "tables")
    buckets = tables.groupBy("table").agg(F.min("node").alias("centre"), F.count("*").alias("n")).filter("n > 1").drop("n")
    rows = stored(tables.join(buckets, "table"), "buckets")
    discard(tables)
    return rows


def close_sizes(a: str, b: str) -> Column:
    """No pair beyond this ratio of set sizes can reach the similarity."""
    return 100 * F.least(a, b) >= 75 * F.greatest(a, b)


def links(texts: DataFrame, docs: DataFrame) -> DataFrame:
    """Stored links ``a, b`` between nodes of ``texts`` that connect all candidates above the similarity."""
    rows = table_rows(texts)
    wanted = rows.select("node").distinct().join(texts.select("node", "key"), "node")
    words = stored(
        docs.select(text_key().alias("key"), "text").join(wanted, "key").groupBy("node").agg(F.first("text").alias("text")), "texts")

    def confirmed(pairs: DataFrame) -> DataFrame:
        near = (
            pairs.join(words.withColumnRenamed("text", "left"), "node")
            .join(words.select(F.col("node").alias("centre"), F.col("text").alias("right")), "centre")
        )
        return stored(near.filter(similar("left", "right")).select(F.col("node").alias("a"), F.col("centre").alias("b")), "links")

    sizes = texts.select(F.col("node").alias("centre"), F.col("n_shingles").alias("n_centre"))
    stars = stored(
        rows.filter("node != centre").select("node", "n_shingles", "centre").distinct()
        .join(sizes, "centre").filter(close_sizes("n_shingles", "n_centre")).select("node", "centre"), "stars")
    found = confirmed(stars.groupBy("node").agg(F.min("centre").alias("centre")))
    for source, pairs_of in ((stars, _other_centres), (words, _across)):
        parts = components(found)
        known = rows.select("node", "n_shingles").distinct().join(parts, "node", "left").select("node", "n_shingles", F.coalesce("component", "node").alias("part"))
        found = stored(found.unionByName(confirmed(pairs_of(rows, source, stored(known, "parts")))), "links")
    discard(rows, words, stars)
    return found


def _other_centres(rows: DataFrame, stars: DataFrame, known: DataFrame) -> DataFrame:
    """Members and centres of their buckets that are still in different components."""
    part = known.select("node", "part")
    return (
        stars.join(part, "node").join(part.select(F.col("node").alias("centre"), F.col("part").alias("part_centre")), "centre")
        .filter("part != part_centre").select("node", "centre")
    )


def _across(rows: DataFrame, words: DataFrame, known: DataFrame) -> DataFrame:
    """Pairs that can still join two components of one bucket.

    All texts in buckets with several components are joined exactly: tokens (shingles) are put in one global order,
    roughly rarest first. Of two sets with the similarity, the smaller has a token among the first seventh of its own
    that is among the first quarter of the other's, at places that leave room for the overlap. Pairs inside the
    component that has most of a token's rows are never formed.
    """
    placed = rows.select("table", "node").join(known, "node")
    split = placed.groupBy("table").agg(F.min("part").alias("low"), F.max("part").alias("high")).filter("low != high").select("table")
    open_nodes = placed.join(split, "table").select("node", "part").distinct()
    texts = stored(open_nodes.join(words, "node"), "open")
    counts = texts.select("text").mapInArrow(_token_counts, "slot int, n long").groupBy("slot").agg(F.sum("n").alias("n"))
    packed = counts.groupBy(F.pmod("slot", F.lit(256))).agg(F.array_join(F.flatten(F.collect_list(F.array("slot", "n"))), " ").alias("s")).collect()
    order = np.zeros(ORDER_SLOTS, np.int64)  # ORDER_SLOTS counters, whatever the corpus
    for r in packed:
        slot, n = np.array(r["s"].split(" "), np.int64).reshape(-1, 2).T
        order[slot] = n
    shared = texts.sparkSession.sparkContext.broadcast(order)

    def prefixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with np.errstate(over="ignore"):
            for batch in batches:
                for node, part, text in zip(batch.column("node").to_pylist(), batch.column("part").to_pylist(), batch.column("text"), strict=True):
                    tokens = shingles(text.as_py())
                    n = len(tokens)
                    tokens = tokens[np.lexsort((tokens, shared.value[(tokens % np.uint64(ORDER_SLOTS)).astype(np.int64)]))]
                    long = n - -(-3 * n // 4) + 1
                    yield pa.RecordBatch.from_pydict({
                        "token": tokens[:long].view(np.int64), "node": pa.array([node] * long, pa.int64()), "part": pa.array([part] * long, pa.int64()),
                        "n": pa.array([n] * long, pa.int64()), "place": pa.array(range(long), pa.int64())})

    rows_of = stored(texts.mapInArrow(prefixes, "token long, node long, part long, n long, place long"), "prefixes")
    main = (
        rows_of.groupBy("token", "part").agg(F.count("*").alias("c")).groupBy("token")
        .agg(F.max(F.struct("c", "part"))["part"].alias("main"), F.count("*").alias("parts")).filter("parts > 1").drop("parts")
    )
    mixed = stored(rows_of.join(main, "token"), "mixed")
    a, b = mixed.filter("part != main").alias("a"), mixed.alias("b")
    small, large = F.least("a.n", "b.n"), F.greatest("a.n", "b.n")
    place = F.when(F.col("a.n") <= F.col("b.n"), F.col("a.place")).otherwise(F.col("b.place"))
    room = F.least(F.col("a.n") - F.col("a.place"), F.col("b.n") - F.col("b.place"))
    reach = (F.col("a.part") != F.col("b.part")) & (4 * small >= 3 * large) & (7 * place <= small) & (7 * room >= 3 * (small + large))
    once = (F.col("b.part") == F.col("b.main")) | (F.col("a.node") < F.col("b.node"))
    return a.join(b, (F.col("a.token") == F.col("b.token")) & reach & once).select(F.col("a.node").alias("node"), F.col("b.node").alias("centre")).distinct()


def _token_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(ORDER_SLOTS, np.int64)
    with np.errstate(over="ignore"):
        for batch in batches:
            for text in batch.column("text"):
                total[(shingles(text.as_py()) % np.uint64(ORDER_SLOTS)).astype(np.int64)] += 1
    used = np.flatnonzero(total)
    yield pa.RecordBatch.from_pydict({"slot": pa.array(used, pa.int32()), "n": total[used]})


def near_duplicates(docs: DataFrame) -> DataFrame:
    """``docs`` (doc_id, text) with ``n_shingles, component_id, kept, kept_rows, class_id``.

    Texts with the same bytes are one node, so copies cost a row and no pair. Null, empty and blank texts have no
    shingles and link with nothing, not even with each other. ``component_id`` is the smallest doc_id reachable;
    rows with equal doc_id and linked texts are all kept, and ``kept_rows`` says how many. If a component has only null
    ids, its component_id is null and all its rows are kept. ``class_id`` numbers the components of this run. Input columns with the names of the new ones are replaced.
    """
    texts = sketches(docs)
    parts = components(links(texts, docs))
    placed = texts.join(parts, "node", "left").select("key", "n_shingles", F.coalesce("component", "node").alias("part"))
    keyed = docs.select(text_key().alias("key"), F.col("doc_id").alias("id"))
    ids = keyed.groupBy("key", "id").agg(F.count("*").alias("rows")).join(placed, "key").groupBy("part", "id").agg(F.sum("rows").alias("rows"))
    named = F.when(F.col("id").isNotNull(), F.struct("id", "rows"))
    least = ids.groupBy("part").agg(F.min(named).alias("least"), F.sum("rows").alias("rows")).select(
        "part", F.col("least.id").alias("component_id"), F.coalesce("least.rows", "rows").alias("kept_rows"))
    names = stored(placed.join(least, "part").select("key", "n_shingles", "component_id", "kept_rows", F.col("part").alias("class_id")), "near-duplicates")
    own = F.col("doc_id")

    def component(c):
        return F.when(c("n_shingles") == 0, own).otherwise(c("component_id"))

    return lookup(docs, text_key(), names, "key", n_shingles=lambda c: c("n_shingles"), component_id=component,
                  kept=lambda c: F.coalesce(own == component(c), component(c).isNull()),
                  kept_rows=lambda c: F.when(c("n_shingles") == 0, F.lit(1)).otherwise(c("kept_rows")), class_id=lambda c: c("class_id"))
