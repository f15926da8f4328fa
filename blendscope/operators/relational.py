"""Deduplication, top rows, membership and ingestion helpers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from blendscope.functions import text as tx


def keep_first(df: DataFrame, keys: list[str], order: list) -> DataFrame:
    """One row per key, the first by a full order.

    Written as an aggregate over a struct, so rows are reduced before the
    shuffle and a key with many duplicates costs one row per task.
    """
    pos = [F.col(c) if isinstance(c, str) else c for c in order]
    best = df.groupBy(*keys).agg(F.min_by(F.struct(*[F.col(c) for c in df.columns]), F.struct(*[
        p.alias(f"o{i}") for i, p in enumerate(pos)])).alias("_r"))
    return best.select("_r.*")


def prefer_combined(df: DataFrame, keys: list[str], team: str, tie: list[str]) -> DataFrame:
    """One row per key; a combined-team row (2TM, 3TM, ...) wins over single teams."""
    single = F.when(F.coalesce(F.col(team), F.lit("")).rlike(tx.COMBINED_TEAM), 0).otherwise(1)
    return keep_first(df, keys, [single, *tie])


def top_per_group(df: DataFrame, keys: list[str], order: list[Column], n: int, rank: str = "rank") -> DataFrame:
    """First n rows per key by order. The rank filter is applied before the shuffle as well (group limit)."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(w)).where(F.col(rank) <= n)


def top_then_filter(df: DataFrame, order: list[Column], n: int, keep: Column) -> DataFrame:
    """Limit first, filter afterwards: the filter must not let lower rows move up."""
    return df.orderBy(*order).limit(n).where(keep)


def head_and_tail(df: DataFrame, keys: list[str], order: Column, reverse: Column, n: int) -> DataFrame:
    """First n and last n rows of each key, each row once."""
    head = top_per_group(df, keys, [order], n, "_h").drop("_h").withColumn("side", F.lit("head"))
    tail = top_per_group(df, keys, [reverse], n, "_t").drop("_t").withColumn("side", F.lit("tail"))
    return head.unionByName(tail)


def missing_slices(incoming: DataFrame, target: DataFrame, keys: list[str]) -> DataFrame:
    """Incoming rows whose slice is not in the target yet."""
    return incoming.join(target.select(*keys).distinct(), keys, "left_anti")


def slice_exists(target: DataFrame, **filters) -> bool:
    df = target
    for c, v in filters.items():
        df = df.where(F.col(c) == F.lit(v))
    return not df.limit(1).isEmpty()


def known_members(*tables: DataFrame, key: str | list[str]) -> DataFrame:
    """Ids (or keys of several columns) that occur in every table."""
    keys = [key] if isinstance(key, str) else key
    out = tables[0].select(*keys).distinct()
    for t in tables[1:]:
        out = out.join(t.select(*keys).distinct(), keys, "left_semi")
    return out


def coverage(facts: DataFrame, dims: dict[str, DataFrame], key: str, by: tuple[str, ...] = ()) -> DataFrame:
    """Per dimension (and value of ``by``): distinct fact ids, how many of them the dimension lacks, and the share."""
    ids = facts.select(*by, key).distinct()
    out = None
    for name, dim in dims.items():
        hit = dim.select(*by, key).distinct().withColumn("_hit", F.lit(True))
        row = ids.join(hit, [*by, key], "left").groupBy(*by).agg(
            F.count(F.lit(1)).alias("n_ids"), F.count_if(F.col("_hit").isNull()).alias("n_missing")
        ).select(*by, F.lit(name).alias("dimension"), "n_ids", "n_missing",
                 (F.col("n_missing") / F.col("n_ids")).alias("missing_share"))
        out = row if out is None else out.unionByName(row)
    return out


def refuse_missing(report: DataFrame, max_share: float) -> None:
    bad = report.where(F.col("missing_share") > max_share).limit(1).collect()
    if bad:
        raise ValueError(f"{bad[0]['dimension']}: {bad[0]['n_missing']} of {bad[0]['n_ids']} ids are missing")


def resolve_names(names: DataFrame, table: DataFrame, name: str, table_name: str, member: str) -> DataFrame:
    """Names to ids through the normalized form, with the number of candidates.

    ``status`` is resolved, missing or ambiguous.
    """
    cand = (
        table.select(tx.normalize_name(table_name).alias("_norm"), F.col(member))
        .groupBy("_norm")
        .agg(F.count_distinct(member).alias("n_candidates"), F.min(member).alias(member))
    )
    out = names.withColumn("_norm", tx.normalize_name(name)).join(cand, "_norm", "left")
    n = F.coalesce(F.col("n_candidates"), F.lit(0))
    return out.select(
        *names.columns,
        F.when(n == 1, F.col(member)).alias(member),
        n.alias("n_candidates"),
        F.when(n == 1, "resolved").when(n == 0, "missing").otherwise("ambiguous").alias("status"),
    )


def require_resolved(resolved: DataFrame) -> DataFrame:
    bad = resolved.where(F.col("status") == "ambiguous").limit(1).collect()
    if bad:
        raise ValueError(f"ambiguous name: {bad[0].asDict()}")
    return resolved.where(F.col("status") == "resolved")


def nearest_row(df: DataFrame, keys: list[str], column: str, hint: Column, tie: list[str]) -> DataFrame:
    """Per key, the row whose column lies nearest to the hint."""
    return keep_first(df, keys, [F.abs(F.col(column) - hint), *tie])


def distinct_map(df: DataFrame, *columns: str) -> DataFrame:
    return df.select(*columns).distinct()


def debut_rows(df: DataFrame, member: str, period: str) -> DataFrame:
    """Rows of each member's first period."""
    return keep_first(df, [member], [period])


def union_periods(frames: dict[str, DataFrame], period: str) -> DataFrame:
    out = None
    for label, df in frames.items():
        tagged = df.withColumn(period, F.lit(label))
        out = tagged if out is None else out.unionByName(tagged, allowMissingColumns=True)
    return out
