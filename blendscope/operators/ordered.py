"""Order-dependent statistics that never place one key's rows in one task.

Exact quantiles, strict percentile ranks and running state over a container
are computed in two levels: rows are cut into value or time chunks, each chunk
is handled on its own, and one small row per chunk carries the totals across
chunks. A key that holds a third of all rows is spread over its chunks.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from blendscope.session import cut_lineage

# Chunks per factor of two of a value. Chunk numbers grow with the value, and
# a key has at most some tens of thousands of chunks, whatever its row count.
CHUNKS_PER_OCTAVE = 64
_SHIFT = 1100 * CHUNKS_PER_OCTAVE
# Rows of a key that are gathered in one task.
MOST_GATHERED = 10_000
# Names of larger keys, or chunks with a wanted rank, that are broadcast: some 40 bytes each.
MOST_HELD = 500_000


def value_chunk(v: Column) -> Column:
    """Monotone chunk number of a double, relative width about one percent."""
    mag = F.floor(F.log2(F.abs(v)) * CHUNKS_PER_OCTAVE) + F.lit(_SHIFT)
    return F.when(v > 0, mag).when(v < 0, -mag).otherwise(F.lit(0)).cast("long")


def _on(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    return left.join(right, keys, how)


def distribution(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """One row per (keys, distinct value): rows below, rows equal, rows in total.

    Equal values are counted before any shuffle by order, so a value that
    repeats a billion times is one row here.
    """
    keys = list(keys)
    group = keys or ["_all"]
    src = df if keys else df.withColumn("_all", F.lit(0))
    counts = (
        src.where(F.col(value).isNotNull())
        .withColumn(value, F.col(value).cast("double") + F.lit(0.0))
        .groupBy(*group, value)
        .agg(F.count(F.lit(1)).alias("n_equal"))
        .withColumn("_chunk", value_chunk(F.col(value)))
    )
    per_key = Window.partitionBy(*group).orderBy("_chunk")
    offsets = counts.groupBy(*group, "_chunk").agg(F.sum("n_equal").alias("_n")).select(
        *group,
        "_chunk",
        F.coalesce(F.sum("_n").over(per_key.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"),
        F.sum("_n").over(Window.partitionBy(*group)).alias("n_total"),
    )
    in_chunk = Window.partitionBy(*group, "_chunk").orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    out = counts.withColumn("_inside", F.coalesce(F.sum("n_equal").over(in_chunk), F.lit(0)))
    out = _on(out, offsets, group + ["_chunk"])
    return out.select(*keys, value, (F.col("_before") + F.col("_inside")).alias("n_below"), "n_equal", "n_total")


def rank_chunks(df: DataFrame, keys: list[str], probs: dict[str, float]) -> DataFrame:
    """Of each key the value chunks that hold a wanted rank, with the rows before them and in total.

    ``df``: keys and ``_chunk``. Only counts per chunk are shuffled, summed map-side; at most two chunks a probability remain.
    """
    per_key = Window.partitionBy(*keys).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    chunks = df.groupBy(*keys, "_chunk").agg(F.count(F.lit(1)).alias("_n")).select(
        *keys, "_chunk", "_n", F.coalesce(F.sum("_n").over(per_key), F.lit(0)).alias("_before"),
        F.sum("_n").over(Window.partitionBy(*keys)).alias("n_total"))
    ranks = [step((F.col("n_total") - 1) * F.lit(float(p))) for p in probs.values() for step in (F.floor, F.ceil)]
    wanted = reduce(lambda a, r: a | ((F.col("_before") <= r) & (r < F.col("_before") + F.col("_n"))), ranks, F.lit(False))
    return chunks.where(wanted).drop("_n")


def quantiles(df: DataFrame, keys: list[str], value: str, probs: dict[str, float],
              most_gathered: int = MOST_GATHERED, most_held: int = MOST_HELD) -> DataFrame:
    """Exact quantiles with linear interpolation, one row per key; rows with a null key or value take no part.

    Keys of at most ``most_gathered`` rows are gathered and sorted each on its own. Larger keys are counted: a pass counts
    their rows per value chunk, then only the values of the chunks that hold a wanted rank are shuffled. The names of the
    larger keys and those chunks are broadcast up to ``most_held`` rows and joined by a shuffle beyond. The input is read
    once to count and once more for either kind, so give one that is cheap to read.
    """
    group = list(keys) or ["_all"]
    src = (df if keys else df.withColumn("_all", F.lit(0))).select(*group, (F.col(value).cast("double") + F.lit(0.0)).alias(value)).dropna()
    large = cut_lineage(src.groupBy(*group).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > most_gathered).select(*group))
    n_large = large.limit(most_held + 1).count()
    names = F.broadcast(large) if n_large <= most_held else large
    plain = src.join(names, group, "left_anti") if n_large else src
    aggs = [F.count(F.lit(1)).alias("n"), *[F.percentile(value, F.lit(float(p))).alias(n) for n, p in probs.items()]]
    near = plain.groupBy(*keys).agg(*aggs) if keys else plain.agg(*aggs)
    if not n_large:
        return near
    far = _counted(src.join(names, group, "left_semi"), group, value, probs, most_held).select(*near.columns)
    return near.unionByName(far) if keys else far


def _counted(src: DataFrame, group: list[str], value: str, probs: dict[str, float], most_held: int) -> DataFrame:
    """Quantiles of large keys by counting."""
    src = src.withColumn("_chunk", value_chunk(F.col(value)))
    chunks = cut_lineage(rank_chunks(src, group, probs))
    small = chunks.limit(most_held + 1).count() <= most_held
    held = src.join(F.broadcast(chunks) if small else chunks, [*group, "_chunk"])
    dist = held.groupBy(*group, "_chunk", value, "_before", "n_total").agg(F.count(F.lit(1)).alias("n_equal"))
    in_chunk = Window.partitionBy(*group, "_chunk").orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    dist = dist.withColumn("n_below", F.col("_before") + F.coalesce(F.sum("n_equal").over(in_chunk), F.lit(0)))

    def at(position: Column) -> Column:
        hit = (F.col("n_below") <= position) & (position < F.col("n_below") + F.col("n_equal"))
        return F.max(F.when(hit, F.col(value)))

    aggs = [F.max("n_total").alias("n")]
    for name, p in probs.items():
        h = (F.col("n_total") - 1) * F.lit(float(p))
        aggs += [at(F.floor(h)).alias(f"_{name}_lo"), at(F.ceil(h)).alias(f"_{name}_hi")]
    picked = dist.groupBy(*group).agg(*aggs)
    cols = []
    for name, p in probs.items():
        h = (F.col("n") - 1) * F.lit(float(p))
        lo, hi = F.col(f"_{name}_lo"), F.col(f"_{name}_hi")
        cols.append((lo + (hi - lo) * (h - F.floor(h))).alias(name))
    return picked.select(*group, "n", *cols)


def percentile_rank(df: DataFrame, keys: list[str], value: str, out: str) -> DataFrame:
    """Add the share of the key's values that lie strictly below the row's own."""
    dist = distribution(df, keys, value).select(
        *keys, F.col(value).alias("_v"), (F.col("n_below") / F.col("n_total")).alias(out)
    )
    left = df.withColumn("_v", F.col(value).cast("double") + F.lit(0.0))
    return left.join(dist, [*keys, "_v"], "left").drop("_v")


def tercile_label(df: DataFrame, keys: list[str], value: str, out: str, labels: tuple[str, str, str]) -> DataFrame:
    """low / mid / high by the exact one-third and two-third quantiles."""
    cuts = quantiles(df, keys, value, {"_t1": 1 / 3, "_t2": 2 / 3}).drop("n")
    joined = df.join(cuts, keys) if keys else df.crossJoin(F.broadcast(cuts))  # cuts is one row
    label = (
        F.when(F.col(value) <= F.col("_t1"), F.lit(labels[0]))
        .when(F.col(value) >= F.col("_t2"), F.lit(labels[2]))
        .when(F.col(value).isNotNull(), F.lit(labels[1]))
    )
    return joined.withColumn(out, label).drop("_t1", "_t2")


def ordered_scan(
    df: DataFrame,
    keys: list[str],
    order: list[str],
    chunk: str,
    sums: dict[str, str] | None = None,
    lasts: dict[str, str] | None = None,
    lags: dict[str, str] | None = None,
    firsts_after: dict[str, str] | None = None,
) -> DataFrame:
    """Running state over a container, in order, without one window per container.

    ``chunk`` is a column that grows with ``order`` inside ``keys`` (a minute
    of the event time, a period number). Each mapping is output -> input:

    * ``sums``: running sum up to and including the row,
    * ``lasts``: last non-null value up to and including the row,
    * ``lags``: value of the previous row (null at the container start),
    * ``firsts_after``: first non-null value from the row on (backward fill).
    """
    sums, lasts, lags, firsts_after = sums or {}, lasts or {}, lags or {}, firsts_after or {}
    cell = [*keys, chunk]
    inner = Window.partitionBy(*cell).orderBy(*order)
    upto = inner.rowsBetween(Window.unboundedPreceding, 0)
    onward = inner.rowsBetween(0, Window.unboundedFollowing)
    pos = F.struct(*order)

    local = df
    per_chunk: list[Column] = [F.count(F.lit(1)).alias("_rows")]
    carry: list[Column] = []
    before = Window.partitionBy(*keys).orderBy(chunk).rowsBetween(Window.unboundedPreceding, -1)
    after = Window.partitionBy(*keys).orderBy(chunk).rowsBetween(1, Window.unboundedFollowing)
    step = Window.partitionBy(*keys).orderBy(chunk)
    finish: list[tuple[str, Column]] = []

    for out, src in sums.items():
        local = local.withColumn(f"_{out}", F.sum(src).over(upto))
        per_chunk.append(F.sum(src).alias(f"_t_{out}"))
        carry.append(F.sum(f"_t_{out}").over(before).alias(f"_c_{out}"))
        finish.append((out, F.coalesce(F.col(f"_{out}"), F.lit(0)) + F.coalesce(F.col(f"_c_{out}"), F.lit(0))))
    for out, src in lasts.items():
        local = local.withColumn(f"_{out}", F.last(src, ignorenulls=True).over(upto))
        per_chunk.append(F.max_by(F.col(src), F.when(F.col(src).isNotNull(), pos)).alias(f"_t_{out}"))
        carry.append(F.last(f"_t_{out}", ignorenulls=True).over(before).alias(f"_c_{out}"))
        finish.append((out, F.coalesce(F.col(f"_{out}"), F.col(f"_c_{out}"))))
    for out, src in firsts_after.items():
        local = local.withColumn(f"_{out}", F.first(src, ignorenulls=True).over(onward))
        per_chunk.append(F.min_by(F.col(src), F.when(F.col(src).isNotNull(), pos)).alias(f"_t_{out}"))
        carry.append(F.first(f"_t_{out}", ignorenulls=True).over(after).alias(f"_c_{out}"))
        finish.append((out, F.coalesce(F.col(f"_{out}"), F.col(f"_c_{out}"))))
    for out, src in lags.items():
        # wrap, so that a null value of the previous row is kept apart from "no previous row"
        local = local.withColumn(f"_{out}", F.lag(F.struct(F.col(src).alias("v"))).over(inner))
        per_chunk.append(F.max_by(F.struct(F.col(src).alias("v")), pos).alias(f"_t_{out}"))
        carry.append(F.lag(f"_t_{out}").over(step).alias(f"_c_{out}"))
        finish.append((out, F.coalesce(F.col(f"_{out}"), F.col(f"_c_{out}"))["v"]))

    totals = df.groupBy(*cell).agg(*per_chunk).select(*cell, *carry)
    joined = local.join(totals, cell, "left")
    for name, expr in finish:
        joined = joined.withColumn(name, expr)
    scratch = [f"_{o}" for o in (*sums, *lasts, *lags, *firsts_after)]
    scratch += [f"_c_{o}" for o in (*sums, *lasts, *lags, *firsts_after)]
    return joined.drop(*scratch)


def lag_over_bounded(df: DataFrame, keys: list[str], order: str, columns: dict[str, Column]) -> DataFrame:
    """Plain window columns, for partitions whose size the schema bounds (seasons of a member, a sweep over K)."""
    w = Window.partitionBy(*keys).orderBy(order) if keys else Window.orderBy(order)
    return reduce(lambda d, kv: d.withColumn(kv[0], kv[1].over(w)), columns.items(), df)
