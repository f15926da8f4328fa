"""Weighted statistics, pivots and profile aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def ratio(num, den) -> Column:
    """num / den, null where the denominator is 0 or missing."""
    n, d = _c(num), _c(den)
    return F.when(d != 0, n / d)


def weighted_mean(x, w) -> Column:
    return F.try_divide(F.sum(_c(x) * _c(w)), F.sum(_c(w)))


def weighted_var(x, w) -> Column:
    """Population weighted variance from the first two weighted moments."""
    x, w = _c(x), _c(w)
    m = F.try_divide(F.sum(x * w), F.sum(w))
    return F.greatest(F.try_divide(F.sum(x * x * w), F.sum(w)) - m * m, F.lit(0.0))


def weighted_std(x, w) -> Column:
    return F.sqrt(weighted_var(x, w))


def guarded_std(x, w, floor: float = 1e-12) -> Column:
    """Weighted sd where a constant column gets scale 1."""
    s = weighted_std(x, w)
    return F.when(s < floor, F.lit(1.0)).otherwise(s)


def weighted_corr(x, y, w) -> Column:
    x, y, w = _c(x), _c(y), _c(w)
    sw = F.sum(w)
    mx, my = F.sum(x * w) / sw, F.sum(y * w) / sw
    cov = F.sum(x * y * w) / sw - mx * my
    vx = F.sum(x * x * w) / sw - mx * mx
    vy = F.sum(y * y * w) / sw - my * my
    return F.try_divide(cov, F.sqrt(F.greatest(vx * vy, F.lit(0.0))))


def weighted_rmse(y, pred, w) -> Column:
    e = _c(y) - _c(pred)
    return F.sqrt(F.try_divide(F.sum(_c(w) * e * e), F.sum(_c(w))))


def weighted_r2(y, pred, w) -> Column:
    y, pred, w = _c(y), _c(pred), _c(w)
    res = F.sum(w * (y - pred) * (y - pred))
    tot = F.sum(w * y * y) - F.sum(w * y) * F.sum(w * y) / F.sum(w)
    return F.lit(1.0) - F.try_divide(res, tot)


def effective_sample(w) -> Column:
    w = _c(w)
    return F.try_divide(F.sum(w) * F.sum(w), F.sum(w * w))


def pivot_mean(df: DataFrame, keys: list[str], kind: str, value: str, kinds: list[str], prefix: str = "") -> DataFrame:
    """Long to wide with the mean per kind; a kind without rows is 0."""
    wide = df.groupBy(*keys).agg(
        *[F.coalesce(F.avg(F.when(F.col(kind) == v, F.col(value))), F.lit(0.0)).alias(f"{prefix}{v}") for v in kinds]
    )
    return wide


def pivot_first(df: DataFrame, keys: list[str], kind: str, value: str, kinds: list[str], order: str) -> DataFrame:
    """Long to wide with the first value by ``order``; a missing kind stays null."""
    return df.groupBy(*keys).agg(
        *[
            F.min_by(F.when(F.col(kind) == v, F.col(value)), F.when(F.col(kind) == v, F.col(order))).alias(v)
            for v in kinds
        ]
    )


def standardize(df: DataFrame, columns: list[str], keys: list[str] | None = None, suffix: str = "_z") -> DataFrame:
    """Add z-scores with the sample standard deviation, per ``keys`` or over the whole table."""
    keys = keys or []
    aggs = []
    for c in columns:
        aggs += [F.avg(c).alias(f"_m_{c}"), F.stddev_samp(c).alias(f"_s_{c}")]
    if keys:
        joined = df.join(df.groupBy(*keys).agg(*aggs), keys)
    else:
        joined = df.crossJoin(F.broadcast(df.agg(*aggs)))  # one row
    z = [F.try_divide(F.col(c) - F.col(f"_m_{c}"), F.col(f"_s_{c}")).alias(f"{c}{suffix}") for c in columns]
    return joined.select(*df.columns, *z)


def winsorize(df: DataFrame, columns: list[str], q: float) -> DataFrame:
    """Clip each column to its [q, 1-q] quantiles (exact, linear)."""
    from blendscope.operators.ordered import quantiles

    out = df
    for c in columns:
        cut = quantiles(df, [], c, {"_lo": q, "_hi": 1 - q}).drop("n")
        out = out.crossJoin(F.broadcast(cut)).withColumn(  # one row of cuts
            c, F.when(F.col(c).isNotNull(), F.least(F.greatest(F.col(c), F.col("_lo")), F.col("_hi")))
        ).drop("_lo", "_hi")
    return out


def block_profile() -> list[Column]:
    """Ratios of sums over a block of segments."""
    s = {c: F.sum(f"off_{c}") for c in ("possessions", "points", "fga", "fgm", "fg3a", "fg3m", "tov")}
    return [
        s["possessions"].cast("double").alias("possessions"),
        ratio(100.0 * s["points"], s["possessions"]).alias("ortg"),
        ratio(s["fgm"] + 0.5 * s["fg3m"], s["fga"]).alias("efg_pct"),
        ratio(s["fgm"], s["fga"]).alias("fg_pct"),
        ratio(s["fg3m"], s["fg3a"]).alias("fg3_pct"),
        ratio(s["fg3a"], s["fga"]).alias("fg3a_rate"),
        ratio(100.0 * s["tov"], s["possessions"]).alias("tov_pct"),
    ]


# Action names that count as a shot, free-throw weight, rim distance in feet.
SHOT_ACTIONS = ("Made Shot", "Missed Shot")
FREE_THROW_WEIGHT = 0.44
RIM_FEET = 3.0


def usage_profile(own: Column, assisted_by_own: Column) -> list[Column]:
    """Own share of the team's events over a block.

    ``own`` marks the member's events, ``assisted_by_own`` the shots that the
    member assisted; the other rows of the block are the team's.
    """
    action = F.col("action_type")
    shot = action.isin(*SHOT_ACTIONS)

    def n(cond: Column) -> Column:
        return F.count_if(cond)

    load = n(shot) + n(action == "Turnover") + FREE_THROW_WEIGHT * n(action == "Free Throw")
    own_load = (
        n(own & shot) + n(own & (action == "Turnover")) + FREE_THROW_WEIGHT * n(own & (action == "Free Throw"))
    )
    rim = F.coalesce(F.col("shot_distance") <= RIM_FEET, F.lit(False))
    three = F.coalesce(F.col("shot_value") == 3, F.lit(False))
    return [
        ratio(own_load, load).alias("usage"),
        ratio(n(assisted_by_own), n(action == "Made Shot")).alias("assist_rate"),
        ratio(n(own & shot & rim), n(own & shot)).alias("rim_share"),
        ratio(n(own & shot & three), n(own & shot)).alias("three_share"),
        n(own & shot).alias("own_fga"),
        n(own & (action == "Turnover")).alias("own_tov"),
        n(own & (action == "Free Throw")).alias("own_fta"),
        n(assisted_by_own).alias("own_ast"),
    ]


def describe_by(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """count, mean, sd, min, quartiles and max per key."""
    from blendscope.operators.ordered import quantiles

    base = df.groupBy(*keys).agg(
        F.count(value).alias("count"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("std"),
        F.min(value).alias("min"), F.max(value).alias("max"),
    )
    q = quantiles(df, keys, value, {"q25": 0.25, "q50": 0.5, "q75": 0.75}).drop("n")
    return base.join(q, keys, "left")
