"""Nested JSON records flattened to columns (SRC22)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from blendscope import schemas


def team_records(spark: SparkSession, path: str) -> DataFrame:
    """Team totals with own and opponent statistics; teams without both are left out."""
    t = spark.read.schema(schemas.TEAM_RECORDS).json(path)
    t = t.where(F.col("totalMinutes").isNotNull() & F.col("teamStats").isNotNull() & F.col("opponentStats").isNotNull())
    return t.select(
        F.col("teamId").alias("team"), "season", F.col("totalMinutes").alias("tm_minutes"),
        F.col("teamStats.fieldGoals.made").alias("tm_fgm"), F.col("teamStats.rebounds.total").alias("tm_trb"),
        F.col("teamStats.possessions").alias("tm_poss"), F.col("opponentStats.rebounds.total").alias("opp_trb"),
        F.col("opponentStats.possessions").alias("opp_poss"), F.col("opponentStats.fieldGoals.attempted").alias("opp_fga"),
        F.col("opponentStats.threePointFieldGoals.attempted").alias("opp_fg3a"))


def player_records(spark: SparkSession, path: str) -> DataFrame:
    p = spark.read.schema(schemas.PLAYER_RECORDS).json(path)
    return p.select(
        F.col("athleteId").alias("member"), "name", F.col("teamId").alias("team"), "minutes",
        F.col("fieldGoals.attempted").alias("fga"), F.col("fieldGoals.made").alias("fgm"), F.col("freeThrows.attempted").alias("fta"),
        F.col("turnovers").alias("tov"), F.col("assists").alias("ast"), F.col("steals").alias("stl"), F.col("blocks").alias("blk"),
        F.col("rebounds.total").alias("trb"), F.col("points").alias("pts"))


def json_column(df: DataFrame, column: str, schema: str, prefix: str = "") -> DataFrame:
    """Fields of a JSON text column as columns."""
    parsed = df.withColumn("_j", F.from_json(column, schema))
    fields = parsed.schema["_j"].dataType.fieldNames()
    return parsed.select(*df.columns, *[F.col(f"_j.{f}").alias(f"{prefix}{f}") for f in fields])
