"""Feature table: six sources joined to one row per member and season (F1)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from blendscope.functions import text as tx
from blendscope.operators import relational, stats


def population(df: DataFrame, min_weight: float = 300.0, first: str | None = None, last: str | None = None) -> DataFrame:
    """Rows with enough weight, optionally inside an inclusive season range."""
    out = df.where(F.col("min") >= min_weight)
    if first is not None:
        out = out.where(F.col("season") >= first)
    if last is not None:
        out = out.where(F.col("season") <= last)
    return out


def by_name(df: DataFrame, name: str, team: str, tie: list[str]) -> DataFrame:
    """Rows keyed by normalized name and season, the combined team row preferred."""
    keyed = df.withColumn("norm_name", tx.normalize_name(name))
    return relational.prefer_combined(keyed, ["norm_name", "season"], team, tie)


def build(
    sources: dict[str, DataFrame], play_types: list[str], required: list[str], structural_zero: list[str],
    min_weight: float = 300.0,
) -> DataFrame:
    """One plan over the six sources.

    Rows missing a required feature are kept and marked ``complete = false``;
    ``complete_cases`` drops them.
    """
    base = sources["base"].withColumn("norm_name", tx.normalize_name("name")).where(F.col("min") >= min_weight)
    df = base.join(sources["advanced"], ["member", "season"], "left").join(sources["bio"], ["member", "season"], "left")
    df = df.withColumn("pts_per_100", F.try_divide(F.col("pts"), F.col("poss")) * 100)
    bref = by_name(sources["bref"], "player", "team", ["team"]).drop("player", "team", "mp")
    shot = by_name(sources["shooting"], "player", "team", ["team"]).drop("player", "team")
    df = df.join(bref, ["norm_name", "season"], "left").join(shot, ["norm_name", "season"], "left")
    wide = stats.pivot_mean(sources["playtype"], ["member", "season"], "play_type", "poss_pct", play_types, "playtype_")
    df = df.join(wide, ["member", "season"], "left")
    zero = [*structural_zero, *[f"playtype_{t}" for t in play_types]]
    df = df.na.fill(0.0, subset=zero)
    complete = F.lit(True)
    for c in required:
        complete = complete & F.col(c).isNotNull() & ~F.isnan(c)
    return df.withColumn("complete", complete)


def complete_cases(df: DataFrame) -> DataFrame:
    """Rows with every required feature."""
    return df.where("complete").drop("complete")


def drop_report(df: DataFrame) -> DataFrame:
    """Rows kept and dropped per season."""
    return df.groupBy("season").agg(
        F.count_if(F.col("complete")).alias("n_kept"), F.count_if(~F.col("complete")).alias("n_dropped"))


def vectorize(df: DataFrame, columns: list[str], keep: list[str], out: str = "x") -> DataFrame:
    """Feature columns as one ``array<double>``."""
    return df.select(*keep, F.array(*[F.col(c).cast("double") for c in columns]).alias(out))


def null_gate(df: DataFrame, columns: list[str]) -> DataFrame:
    """Null count per feature column, one row per column (Q2)."""
    counts = df.agg(*[F.count_if(F.col(c).isNull() | F.isnan(F.col(c).cast("double"))).alias(c) for c in columns])
    cells = F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias("n_null")) for c in columns])
    return counts.select(F.explode(cells).alias("c")).select("c.*")


def require_no_nulls(df: DataFrame, columns: list[str]) -> None:
    bad = {r["column"]: r["n_null"] for r in null_gate(df, columns).where("n_null > 0").collect()}  # one row per column
    if bad:
        raise ValueError(f"null features: {bad}")
