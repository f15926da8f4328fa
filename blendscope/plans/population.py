"""Features of one population expressed on another one's basis (2.17)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from blendscope.functions import shots
from blendscope.functions import vectors as vec
from blendscope.operators import relational
from blendscope.operators.stats import ratio


def positive_ratio(num: Column, den: Column) -> Column:
    """num / den where the denominator is above 0, else null."""
    return F.when(den > 0, num / den)


def box_rates(players: DataFrame, teams: DataFrame, keys: list[str], min_minutes: float = 300.0) -> DataFrame:
    """Rate features of a player in its team's context (B1).

    ``players``: keys, minutes, fga, fgm, fta, tov, ast, stl, blk, trb, pts;
    ``teams``: keys, tm_minutes, tm_fgm, tm_trb, tm_poss, opp_trb, opp_poss, opp_fga, opp_fg3a.
    """
    j = players.where(F.col("minutes") >= min_minutes).join(teams, keys)
    c = F.col
    mp, tm = c("minutes"), c("tm_minutes")
    near_share = mp / tm * c("tm_fgm") - c("fgm")
    use = c("fga") + 0.44 * c("fta") + c("tov")
    return j.where(tm > 0).select(
        *players.columns,
        positive_ratio(100.0 * c("ast"), near_share).alias("ast_pct"),
        positive_ratio(100.0 * c("trb") * tm, mp * (c("tm_trb") + c("opp_trb"))).alias("trb_pct"),
        positive_ratio(100.0 * c("stl") * tm, mp * c("opp_poss")).alias("stl_pct"),
        positive_ratio(100.0 * c("blk") * tm, mp * (c("opp_fga") - c("opp_fg3a"))).alias("blk_pct"),
        positive_ratio(100.0 * c("tov"), use).alias("tov_pct"),
        positive_ratio(100.0 * c("pts"), mp * (c("tm_poss") / tm)).alias("pts_per_100"))


def shot_type_shares(df: DataFrame, keys: list[str], min_attempts: int = 20) -> DataFrame:
    """Attempt and assisted shares by shot type (B3). ``df``: keys, zone (rim, mid, three), attempted, made, assisted."""
    def s(zone: str, what: str) -> Column:
        return F.sum(F.when(F.col("zone") == zone, F.col(what)).otherwise(0))

    g = df.groupBy(*keys).agg(
        F.sum("attempted").alias("n"), *[s(z, w).alias(f"{z}_{w}") for z in ("rim", "mid", "three") for w in ("attempted", "made", "assisted")])
    return g.where(F.col("n") >= min_attempts).select(
        *keys, "n", *[(100.0 * F.col(f"{z}_attempted") / F.col("n")).alias(f"pct_{z}") for z in ("rim", "mid", "three")],
        ratio(100.0 * (F.col("rim_assisted") + F.col("mid_assisted")), F.col("rim_made") + F.col("mid_made")).alias("ast2"),
        ratio(100.0 * F.col("three_assisted"), "three_made").alias("ast3"))


def hybrid_vector(rows: DataFrame, own: dict[str, str], proxies: dict[str, str], keys: list[str]) -> DataFrame:
    """One z-vector from several sources: own value, else a proxy column; ``complete`` tells whether all exist."""
    cols = [F.coalesce(*[F.col(c) for c in (own.get(f), proxies.get(f)) if c]).alias(f) for f in {**own, **proxies}]
    out = rows.select(*keys, *cols)
    full = F.lit(True)
    for f in {**own, **proxies}:
        full = full & F.col(f).isNotNull()
    return out.withColumn("complete", full)


def shot_profile(df: DataFrame, keys: list[str]) -> DataFrame:
    """Range shares, mean distance and corner share of threes (B7, S15). ``df``: keys, x, y."""
    d = df.withColumn("_d", shots.shot_distance_ft("x", "y"))
    corner = shots.is_corner_three(F.col("_d"), "y")
    return d.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_shots"),
        *[(100.0 * F.avg(shots.in_range(F.col("_d"), lo, hi).cast("double"))).alias(n) for n, lo, hi in shots.RANGES],
        F.avg("_d").alias("dist"),
        F.coalesce(100.0 * ratio(F.count_if(corner), F.count_if(F.col("_d") >= shots.ARC_FT)), F.lit(0.0)).alias("corner_share"))


def comparable_pool(pool: DataFrame, target: Column, k: int, n: int, keys: list[str]) -> DataFrame:
    """The n rows per key with the largest cosine to a given mixture, with the Euclidean distance."""
    s = pool.select("*", F.round(vec.cosine("recipe", target, k), 12).alias("cosine"), vec.euclidean("recipe", target, k).alias("distance"))
    s = s.withColumn("closeness", F.lit(1.0) / (F.lit(1.0) + F.col("distance")))
    return relational.top_per_group(s, keys, [F.col("cosine").desc(), F.col("member"), F.col("season")], n)


def supply_gap(difference: DataFrame, recipes: DataFrame, identity: DataFrame, k: int) -> DataFrame:
    """Success pattern of a component against the members a team has with that top component.

    ``difference``: season, component, difference.
    """
    top = recipes.join(identity.select("member", "team"), "member").select("team", "season", vec.argmax("recipe").alias("component"))
    have = top.groupBy("team", "season", "component").agg(F.count(F.lit(1)).alias("n_members"))
    teams = top.select("team", "season").distinct()
    need = teams.join(difference, "season")
    return need.join(have, ["team", "season", "component"], "left").select(
        "team", "season", "component", "difference", F.coalesce("n_members", F.lit(0)).alias("n_members"),
        ((F.col("difference") > 0) & F.col("n_members").isNull()).alias("is_gap"))
