"""Binding of the clickstream to a play-by-play feed.

game = a user's week, two teams of seven, five starters each. Sign-ups are
substitutions, purchases made shots, views missed shots, clicks rebounds,
errors turnovers or free throws. Everything is derived from the event rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from blendscope.operators import ordered
from blendscope.warehouse import table

# Family names of the bound rosters; seven players per team.
FAMILIES = ("Arden", "Brook", "Colt", "Dumas", "Ember", "Frost", "Grove")
HOME, AWAY = 1, 2


def _base(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    week = F.floor(F.datediff("ts", F.lit("2024-01-01").cast("date")) / 7).cast("int")
    cents = F.round(F.col("value") * 100).cast("long")
    return e.select(
        F.concat_ws("-", F.col("user_id").cast("string"), week.cast("string")).alias("game"),
        week.alias("week"), "event_id", "event_type", "ts",
        cents.alias("cents"),
        (F.pmod(F.datediff("ts", F.lit("2024-01-01").cast("date")), F.lit(7))).alias("day"),
        (F.lit(1) + F.pmod(F.floor(cents / 10), F.lit(2))).cast("long").alias("team"),
        F.pmod(cents, F.lit(7)).cast("int").alias("slot"),
    )


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Play-by-play rows; the event id orders a game, a day pair is a period."""
    b = _base(spark, sf_dir)
    names = F.array(*[F.lit(n) for n in FAMILIES])
    other = F.pmod(F.floor(F.col("cents") / 7), F.lit(7)).cast("int")
    kind = F.col("event_type")
    turnover = F.pmod(F.floor(F.col("cents") / 3), F.lit(2)) == 0
    made = (kind == "purchase") | ((kind == "error") & ~turnover & (F.pmod(F.col("cents"), F.lit(3)) != 0))
    value = F.when(F.pmod(F.floor(F.col("cents") / 5), F.lit(3)) == 0, 3).otherwise(2)
    ev = b.select(
        "game", F.col("event_id").alias("action_no"), F.floor(F.col("day") / 2).cast("int").alias("period"), "team",
        (F.col("team") * 10 + F.col("slot")).alias("person"),
        F.when(kind == "signup", "Substitution").when(kind == "purchase", "Made Shot").when(kind == "view", "Missed Shot")
        .when(kind == "click", "Rebound").when(turnover, "Turnover").otherwise("Free Throw").alias("action_type"),
        F.when((kind == "error") & ~turnover, F.concat(
            F.lit("Free Throw "), (F.pmod(F.floor(F.col("cents") / 11), F.lit(2)) + 1).cast("string"), F.lit(" of 2"))).alias("sub_type"),
        F.when(kind == "signup", F.concat(F.lit("SUB: "), names[F.col("slot")], F.lit(" FOR "), names[other]))
        .when((kind == "purchase") & (F.col("slot") != other), F.concat(names[F.col("slot")], F.lit(" Jump Shot (2 PTS) ("), names[other], F.lit(" 1 AST)")))
        .when(made, F.concat(names[F.col("slot")], F.lit(" scores")))
        .otherwise(F.concat(F.lit("MISS "), names[F.col("slot")])).alias("description"),
        F.when(kind.isin("purchase", "view") | ((kind == "error") & ~turnover), F.when(made, "Made").otherwise("Missed")).alias("shot_result"),
        kind.isin("purchase", "view").cast("int").alias("is_field_goal"),
        F.when(kind.isin("purchase", "view"), value).otherwise(0).alias("shot_value"),
        F.when(kind.isin("purchase", "view"), F.pmod(F.col("cents"), F.lit(30)).cast("double")).alias("shot_distance"),
        made.alias("_made"),
    )
    points = F.when(F.col("_made"), F.when(F.col("is_field_goal") == 1, F.col("shot_value")).otherwise(1)).otherwise(0)
    ev = ev.withColumn("_h", F.when(F.col("team") == HOME, points).otherwise(0)).withColumn(
        "_a", F.when(F.col("team") == AWAY, points).otherwise(0)).withColumn("_c", F.floor(F.col("action_no") / 4096))
    run = ordered.ordered_scan(ev, ["game"], ["action_no"], "_c", sums={"_sh": "_h", "_sa": "_a"})
    return run.select(
        *[c for c in ev.columns if not c.startswith("_")],
        F.when(F.col("_made"), F.col("_sh").cast("string")).otherwise("").alias("score_home"),
        F.when(F.col("_made"), F.col("_sa").cast("string")).otherwise("").alias("score_away"),
    )


def games(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = _base(spark, sf_dir).groupBy("game", "week").agg(F.min("ts").alias("ts"))
    return g.select("game", F.concat(F.lit("week-"), F.col("week").cast("string")).alias("season"),
                    F.date_format("ts", "yyyy-MM-dd").alias("date"), F.lit(HOME).cast("long").alias("home_team"), F.lit(AWAY).cast("long").alias("away_team"))


def box(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fourteen roster rows per game."""
    rows = F.array(*[
        F.struct(F.lit(t).cast("long").alias("team"), F.lit(t * 10 + i).cast("long").alias("person"), F.lit(f"{n[0]}{n[1]}").alias("first_name"),
                 F.lit(n).alias("family_name"), F.lit("F" if i < 5 else "").alias("position"))
        for t in (HOME, AWAY) for i, n in enumerate(FAMILIES)])
    return games(spark, sf_dir).select("game", F.explode(rows).alias("r")).select("game", "r.*")
