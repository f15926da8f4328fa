"""Near-duplicate vectors by an exact metric range join.

On unit vectors a cosine of at least ``c`` is a distance of at most ``r = sqrt(2 - 2c)``. Pivots split the vectors
into cells of the nearest pivot. If ``d(x, y) <= r``, the triangle inequality gives ``d(x, p) <= d(x, q) + 2r`` for the
pivots q of x and p of y; so a vector is copied to exactly the cells whose pivot is at most ``2r`` farther than its
own, and each cell finds all partners of its own vectors by itself. Cells are cut into tiles of bounded size.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from blendscope.llm.components import components
from blendscope.llm.shared import replace_columns, stored

#: Vectors from which pivots are picked, and most pivots.
SAMPLE, MOST_PIVOTS = 2_000, 256
#: Vectors on either side of a tile.
TILE = 4096
#: Average number of cells a vector may be copied to; above it fewer pivots are taken.
COPIES = 4.0
#: Rounding of distances, in favour of copying.
SLACK = 1e-9

CELL = ["label", "dim", "cell"]


def unit(lists: pa.Array) -> np.ndarray:
    """Rows of unit length in double precision."""
    flat = lists.values.to_numpy(zero_copy_only=False).astype(np.float64)
    x = flat[lists.offsets[0].as_py():lists.offsets[-1].as_py()].reshape(len(lists), -1)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def distances(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(0.0, 2 - 2 * (x @ pivots.T)))


def cells_of(d: np.ndarray, radius: float) -> tuple[np.ndarray, np.ndarray]:
    """Nearest pivot of each row, and whether the row is copied to each other cell."""
    home = d.argmin(axis=1)
    near = d <= d[np.arange(len(d)), home][:, None] + 2 * radius + SLACK
    near[np.arange(len(d)), home] = False
    return home, near


def choose_pivots(sample: np.ndarray, radius: float) -> np.ndarray:
    """Far-apart rows of the sample: as many as halve the work without copying a vector to more than COPIES cells.

    Vectors without clusters (all about as far from each other) come out with one pivot: every cell would need every
    vector, so the tiles alone divide the work.
    """
    order, gap = [0], distances(sample, sample[:1])[:, 0]
    while len(order) < min(MOST_PIVOTS, len(sample)) and gap.max() > 2 * radius:
        order.append(int(gap.argmax()))
        gap = np.minimum(gap, distances(sample, sample[order[-1:]])[:, 0])
    best, least, k = sample[:1], float(len(sample)) ** 2, 2
    while k <= len(order):
        home, near = cells_of(distances(sample, sample[order[:k]]), radius)
        own, copies = np.bincount(home, minlength=k), near.sum(axis=0)
        if near.sum(axis=1).mean() <= COPIES and (work := float((own * (own + copies)).sum())) < least / 2:
            best, least = sample[order[:k]], work
        k *= 2
    return best


def tile(table: pa.Table) -> pa.Table:
    """Links between the own vectors (side 0) and the partners (side 1) of a tile: per node the number of linked
    vectors and the smallest node it is connected with inside the tile."""
    limit = table.column("cosine")[0].as_py()
    table = table.combine_chunks()
    node, n, side = (table.column(c).to_numpy() for c in ("node", "n", "side"))
    x = unit(table.column("embedding").combine_chunks()) if table.num_rows else np.zeros((0, 1))
    own, partner = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
    values, number = np.unique(node, return_inverse=True)
    label, total = np.arange(len(values)), np.zeros(len(values), np.int64)
    for start in range(0, len(own), 512):
        rows = own[start:start + 512]
        hits = (x[rows] @ x[partner].T >= limit) & (node[rows][:, None] != node[partner][None, :])
        total[number[rows]] += hits @ n[partner]
        for r in np.flatnonzero(hits.any(axis=1)):
            joined = np.unique(np.append(label[number[partner[hits[r]]]], label[number[rows[r]]]))
            if len(joined) > 1:
                label[np.isin(label, joined)] = joined[0]
    return pa.table({"node": values, "links": total, "low": values[label]})


def linked_vectors(vectors: DataFrame, cosine: float = 0.98) -> DataFrame:
    """``vectors`` (vec_id, embedding, label) with ``n_links, component_id, kept``; only equal, non-null labels link.

    Vectors that are null, empty, zero or hold null or non-finite components link with nothing; so do vectors of
    different length with each other. Equal vectors of one label are one node with a count, so repeated rows and hot
    vectors cost no pairs. Rows with equal vec_id stay rows of their own. A null vec_id is never the smallest of a
    component unless all are null. Input columns with the names of the new ones are replaced.
    """
    radius = float(np.sqrt(2 - 2 * cosine))
    sane = (
        F.col("embedding").isNotNull() & F.col("label").isNotNull() & F.exists("embedding", lambda v: v != 0)
        & F.forall("embedding", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    )
    good = F.coalesce(sane, F.lit(False))
    nodes = stored(
        vectors.filter(good).groupBy("label", "embedding").agg(F.count("*").alias("n"), F.min("vec_id").alias("id"))
        .select(F.monotonically_increasing_id().alias("node"), "*", F.size("embedding").alias("dim")), "vectors")

    count = nodes.count()
    dims = nodes.groupBy("dim").count().orderBy(F.desc("count")).select("dim").head(1)  # the usual length has pivots
    share = min(1.0, SAMPLE / max(1, count))
    picked = [] if not dims else nodes.filter((F.col("dim") == dims[0][0]) & (F.pmod(F.xxhash64("node"), F.lit(1 << 20)) < int(share * (1 << 20)) + 1)).limit(2 * SAMPLE).select("embedding").collect()
    pivots = choose_pivots(unit(pa.array([r[0] for r in picked], pa.list_(pa.float64()))), radius) if picked else np.zeros((0, 0))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            home, near = np.zeros(batch.num_rows, np.int32), [[] for _ in range(batch.num_rows)]
            fit = np.flatnonzero(batch.column("dim").to_numpy() == pivots.shape[1]) if len(pivots) > 1 else []
            if len(fit):
                h, copies = cells_of(distances(unit(batch.column("embedding").take(pa.array(fit))), pivots), radius)
                home[fit] = h
                for i, c in zip(fit, copies, strict=True):
                    near[i] = np.flatnonzero(c).tolist()
            yield pa.RecordBatch.from_arrays([batch.column("node"), pa.array(home), pa.array(near, pa.list_(pa.int32()))], ["node", "home", "near"])

    spots = nodes.select("node", "dim", "embedding").mapInArrow(place, "node long, home int, near array<int>")
    placed = stored(nodes.select("node", "n", "label", "dim", "embedding").join(spots, "node"), "cells")
    partners = placed.select("node", "n", "label", "dim", "embedding", F.explode(F.concat(F.array("home"), "near")).alias("cell"), "home")
    sizes = stored(
        partners.groupBy(*CELL).agg(F.sum((F.col("cell") == F.col("home")).cast("int")).alias("own"), F.count("*").alias("all"))
        .select(*CELL, F.ceil(F.col("own") / TILE).cast("int").alias("own_blocks"), F.ceil(F.col("all") / TILE).cast("int").alias("all_blocks"))
        .filter("own_blocks > 0"), "cell-sizes")

    def sent(rows: DataFrame, side: int, block: str, block_of: str, other: str, others: str) -> DataFrame:
        return rows.join(sizes, CELL).select(
            *CELL, "node", "n", "embedding", F.lit(side).alias("side"), F.lit(cosine).alias("cosine"),
            F.pmod(F.xxhash64(F.lit(side), "node"), F.col(block_of)).alias(block), F.explode(F.sequence(F.lit(0).cast("long"), F.col(others).cast("long") - 1)).alias(other))

    tiles = sent(partners.filter("cell = home"), 0, "i", "own_blocks", "j", "all_blocks").unionByName(sent(partners, 1, "j", "all_blocks", "i", "own_blocks"))
    found = stored(tiles.groupBy(*CELL, "i", "j").applyInArrow(tile, "node long, links long, low long"), "tile-links")
    parts = components(found.filter("node != low").select(F.col("node").alias("a"), F.col("low").alias("b")))
    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    described = (
        nodes.join(links, "node", "left").join(parts, "node", "left")
        .select("label", "embedding", "n", "id", F.coalesce("links", F.lit(0)).alias("links"), F.coalesce("component", "node").alias("part"))
    )
    least = described.groupBy("part").agg(F.min("id").alias("least"))
    named = stored(described.join(least, "part").select("label", "embedding", (F.col("links") + F.col("n") - 1).alias("n_links"), "least"), "vector-classes")

    row = F.struct("*").alias("row")
    inside = vectors.filter(good).select(row, "label", "embedding", F.col("vec_id").alias("id")).join(named, ["label", "embedding"]).select("row", "id", "n_links", "least")
    outside = vectors.filter(~good).select(row, F.col("vec_id").alias("id"), F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("least"))
    both = inside.unionByName(outside)
    return replace_columns(both, "row", n_links=F.col("n_links"), component_id=F.col("least"), kept=F.coalesce(F.col("id") == F.col("least"), F.col("least").isNull()))
