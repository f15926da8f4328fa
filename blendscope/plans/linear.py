"""Skill priors, design matrices, ridge and outcome models (2.15).

Row-level work (exploding line-ups, joining recipes and skills, products,
cross products) runs on the executors; only matrices whose size is set by the
number of columns are solved on the driver or in one small task.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from blendscope.functions import text as tx
from blendscope.functions import vectors as vec
from blendscope.operators import gram, relational, resample, stats
from blendscope.session import cut_lineage

# Credibility weight in minutes, grid of ridge penalties, number of folds.
CREDIBILITY = 500.0
LAMBDAS = np.logspace(-1, 7, 33)
FOLDS = 5


# --- skill priors -----------------------------------------------------------

def refuse_overlap(skill_season: str, fact_seasons: set[str]) -> None:
    """A skill source must not come from the modelled season."""
    if skill_season in fact_seasons:
        raise ValueError(f"skill season {skill_season} overlaps the modelled seasons {sorted(fact_seasons)}")


def veteran_skill(prior: DataFrame, credibility: float = CREDIBILITY, keys: list[str] | None = None) -> DataFrame:
    """Shrink each member's rate towards the weight-averaged league mean.

    ``prior``: member, mp, obpm, dbpm and any further ``keys`` (a target season).
    """
    keys = keys or []
    p = prior.where(F.col("obpm").isNotNull() & F.col("dbpm").isNotNull() & F.col("mp").isNotNull())
    means = [stats.weighted_mean("obpm", "mp").alias("_mo"), stats.weighted_mean("dbpm", "mp").alias("_md")]
    j = p.join(p.groupBy(*keys).agg(*means), keys) if keys else p.crossJoin(F.broadcast(p.agg(*means)))  # one row
    w = F.col("mp") / (F.col("mp") + F.lit(credibility))
    return j.select(*keys, "member", (w * F.col("obpm") + (1 - w) * F.col("_mo")).alias("skill_off"),
                    (w * F.col("dbpm") + (1 - w) * F.col("_md")).alias("skill_def"))


def prior_season_skill(prior: DataFrame, roster: DataFrame, skill_season: str, fact_seasons: set[str]) -> DataFrame:
    """Unshrunk prior-season values by name join (R6). ``roster``: member, name, season; ``prior``: player, team, season."""
    refuse_overlap(skill_season, fact_seasons)
    src = prior.where(F.col("season") == skill_season).withColumn("norm_name", tx.normalize_name("player"))
    src = relational.prefer_combined(src, ["norm_name"], "team", ["team"]).select("norm_name", "obpm", "dbpm")
    ids = relational.keep_first(roster.where(F.col("season") == skill_season).select("member", "name"), ["member"], ["name"])
    return ids.withColumn("norm_name", tx.normalize_name("name")).join(src, "norm_name").select(
        "member", F.col("obpm").alias("skill_off"), F.col("dbpm").alias("skill_def"))


def rookie_seasons(bio: DataFrame, outcomes: DataFrame, exclude: list[str]) -> DataFrame:
    """Drafted members in the season that starts in their draft year, with outcome and weight."""
    pick = F.col("draft_number").try_cast("int")
    r = bio.where((F.col("draft_year").try_cast("int") == tx.season_start_year("season")) & pick.isNotNull())
    if exclude:
        r = r.where(~F.col("season").isin(*exclude))
    return r.select("member", "season", pick.alias("pick")).join(outcomes, ["member", "season"]).where(
        F.col("obpm").isNotNull() & F.col("dbpm").isNotNull() & F.col("mp").isNotNull())


def draft_curve(rookies: DataFrame) -> DataFrame:
    """Weighted fit of outcome on ln(pick), both outcomes at once, one row."""
    x, w = F.log(F.col("pick").cast("double")), F.col("mp")
    sw, sx, sxx = F.sum(w), F.sum(w * x), F.sum(w * x * x)
    det = sw * sxx - sx * sx

    def curve(y: str) -> list[Column]:
        yc = F.col(y)
        sy, sxy, syy = F.sum(w * yc), F.sum(w * x * yc), F.sum(w * yc * yc)
        b = F.try_divide(sw * sxy - sx * sy, det)
        a = (sy - b * sx) / sw
        res = syy - 2 * a * sy - 2 * b * sxy + a * a * sw + 2 * a * b * sx + b * b * sxx
        r2 = F.lit(1.0) - F.try_divide(res, syy - sy * sy / sw)
        return [a.alias(f"a_{y}"), b.alias(f"b_{y}"), r2.alias(f"r2_{y}")]

    return rookies.agg(F.count(F.lit(1)).alias("n"), *curve("obpm"), *curve("dbpm"))


def predict_from_pick(pick: Column, a: Column, b: Column) -> Column:
    """a + b ln(pick)."""
    return a + b * F.log(pick.cast("double"))


def replacement_level(bio: DataFrame, outcomes: DataFrame, exclude: list[str]) -> DataFrame:
    """Weight-averaged outcome of undrafted members' first seasons, one row."""
    ids = bio.where(F.col("draft_year") == "Undrafted").select("member").distinct()
    debut = relational.debut_rows(outcomes.join(ids, "member", "left_semi"), "member", "season")
    if exclude:
        debut = debut.where(~F.col("season").isin(*exclude))
    return debut.agg(F.count(F.lit(1)).alias("n"), stats.weighted_mean("obpm", "mp").alias("skill_off"),
                     stats.weighted_mean("dbpm", "mp").alias("skill_def"))


def skill_table(ids: DataFrame, veteran: DataFrame, bio: DataFrame, curve: DataFrame, replacement: DataFrame) -> DataFrame:
    """Veteran value, else draft curve, else replacement level, for every id.

    ``bio``: one row per member with draft_number. Curve and replacement are one row each.
    """
    c = curve.select([F.col(x).alias(f"c_{x}") for x in ("a_obpm", "b_obpm", "a_dbpm", "b_dbpm")])
    r = replacement.select(F.col("skill_off").alias("r_off"), F.col("skill_def").alias("r_def"))
    pick = F.col("draft_number").try_cast("int")
    j = ids.join(veteran, "member", "left").join(bio.select("member", "draft_number"), "member", "left").crossJoin(
        F.broadcast(c)).crossJoin(F.broadcast(r))  # one row each
    return j.select(
        "member",
        F.coalesce("skill_off", predict_from_pick(pick, F.col("c_a_obpm"), F.col("c_b_obpm")), "r_off").alias("skill_off"),
        F.coalesce("skill_def", predict_from_pick(pick, F.col("c_a_dbpm"), F.col("c_b_dbpm")), "r_def").alias("skill_def"),
        F.when(F.col("skill_off").isNotNull(), "prior_season").when(pick.isNotNull(), "draft_prior").otherwise(
            "replacement").alias("source"),
    )


def skill_leakage(skill: DataFrame, fact_seasons: list[str] | str) -> DataFrame:
    """Rows whose vintage cites a modelled season (the draft prior is exempt), and duplicate ids (SRC10, Q7).

    ``fact_seasons``: the modelled seasons of the table, or the column that names it; then one row per season.
    """
    by = [fact_seasons] if isinstance(fact_seasons, str) else []
    cites = F.contains(F.col("vintage"), F.col(by[0])) if by else F.lit(False)
    for s in [] if by else fact_seasons:
        cites = cites | F.contains(F.col("vintage"), F.lit(s))
    per_id = skill.groupBy(*by, "member").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(cites & (F.col("source") != "draft_prior")).alias("leaks"))
    return per_id.groupBy(*by).agg(F.sum("n").alias("n_rows"), F.count_if(F.col("n") > 1).alias("n_duplicate_ids"),
                      F.sum("leaks").alias("n_leaking")).withColumn(
        "ok", (F.col("n_duplicate_ids") == 0) & (F.col("n_leaking") == 0))


# --- design -----------------------------------------------------------------

def design_columns(k: int) -> list[str]:
    pairs = vec.triangle(k, diagonal=False)
    return ["s_off", "s_def", "home_off", *[f"e_off_{i}" for i in range(k)], *[f"e_def_{i}" for i in range(k)],
            *[f"x_off_{i}_{j}" for i, j in pairs], *[f"x_def_{i}_{j}" for i, j in pairs]]


def penalties(k: int) -> np.ndarray:
    """Talent and home columns are free, component columns are penalized."""
    return np.array([0.0] * 3 + [1.0] * (len(design_columns(k)) - 3))


def _side(stints: DataFrame, members: DataFrame, sides: dict[str, tuple[str, str]], keys: list[str], k: int) -> DataFrame:
    """Sums over sides of each segment, all from one pass; only segments in which the members of every side are known.

    ``sides``: name of a side, its array of members and the skill that its sums take.
    """
    arrays = list(dict.fromkeys(a for a, _ in sides.values()))

    def members_of(at: int) -> Column:
        return F.transform(arrays[at], lambda m: F.struct(F.lit(at).alias("_at"), m.alias("member")))

    listed = F.concat(*[members_of(at) for at in range(len(arrays))])
    n = F.size(arrays[0]) if len(arrays) == 1 else sum((F.size(a) for a in arrays[1:]), F.size(arrays[0]))
    rows = stints.select(*keys, n.alias("_n"), F.explode(listed).alias("_m")).select(*keys, "_n", "_m.*")
    j = rows.join(members, ["member", "season"] if "season" in members.columns else ["member"])
    sums = []
    for side, (a, skill) in sides.items():
        mine = F.when(F.col("_at") == arrays.index(a), F.col(skill))
        sums += [F.sum(mine).alias(f"s_{side}"), *[F.sum(F.col("recipe")[i] * mine).alias(f"e_{side}_{i}") for i in range(k)]]
    g = j.groupBy(*keys).agg(F.max("_n").alias("_n"), F.count(F.lit(1)).alias("_known"), *sums)
    return g.where(F.col("_known") == F.col("_n")).drop("_n", "_known")


def side_sums(stints: DataFrame, recipes: DataFrame, skill: DataFrame, k: int, keys: tuple[str, ...] = ("game", "stint", "home_off")) -> DataFrame:
    """The design without its products: one row per directed segment whose members are all known."""
    key_list = list(dict.fromkeys([*keys, "season"] if "season" in stints.columns else keys))
    members = recipes.join(skill.where(F.col("skill_off").isNotNull() & F.col("skill_def").isNotNull()),
                           [c for c in ("member", "season") if c in recipes.columns and c in skill.columns])
    some = stints.where((F.size("off") > 0) & (F.size("def") > 0))
    sums = _side(some, members, {"off": ("off", "skill_off"), "def": ("def", "skill_def")}, key_list, k)
    return stints.drop("off", "def").join(sums, key_list)


def design(stints: DataFrame, recipes: DataFrame, skill: DataFrame, k: int, keys: tuple[str, ...] = ("game", "stint", "home_off")) -> DataFrame:
    """One row per directed segment whose members are all known, with 3 + 2k + k(k-1) columns.

    ``stints``: keys, season, off[], def[], y_off, off_possessions.
    """
    return with_products(side_sums(stints, recipes, skill, k, keys), k)


def with_products(rows: DataFrame, k: int) -> DataFrame:
    pairs = vec.triangle(k, diagonal=False)
    return rows.select(
        "*",
        *[(F.col(f"e_off_{i}") * F.col(f"e_off_{j}")).alias(f"x_off_{i}_{j}") for i, j in pairs],
        *[(F.col(f"e_def_{i}") * F.col(f"e_def_{j}")).alias(f"x_def_{i}_{j}") for i, j in pairs],
    )


# --- ridge ------------------------------------------------------------------

@dataclass
class LinearModel:
    """Standardized coefficients with the scaler they belong to."""

    names: list[str]
    beta: np.ndarray
    intercept: float
    mean: np.ndarray
    sd: np.ndarray
    meta: dict = field(default_factory=dict)

    @property
    def raw(self) -> tuple[np.ndarray, float]:
        return gram.raw_scale(self.beta, self.intercept, self.mean, self.sd)

    def frame(self, spark: SparkSession) -> DataFrame:
        """Coefficient table: one row per column (SRC18, R28)."""
        lo, hi = self.meta.get("feature_min"), self.meta.get("feature_max")
        rows = [(n, float(b), float(m), float(s), None if lo is None else float(lo[i]), None if hi is None else float(hi[i]))
                for i, (n, b, m, s) in enumerate(zip(self.names, self.beta, self.mean, self.sd))]
        rows.append(("intercept", float(self.intercept), 0.0, 1.0, None, None))
        return spark.createDataFrame(
            rows, "feature string, beta double, mean double, sd double, z_min double, z_max double")

    @staticmethod
    def from_frame(df: DataFrame) -> "LinearModel":
        rows = df.collect()  # one row per design column
        cols = [r for r in rows if r["feature"] != "intercept"]
        b0 = [r["beta"] for r in rows if r["feature"] == "intercept"][0]
        return LinearModel([r["feature"] for r in cols], np.array([r["beta"] for r in cols]), b0,
                           np.array([r["mean"] for r in cols]), np.array([r["sd"] for r in cols]))

    def predict(self, overrides: dict[str, Column] | None = None) -> Column:
        """Prediction expression over design columns."""
        coef, b0 = self.raw
        overrides = overrides or {}
        return F.lit(b0) + vec.total([overrides.get(n, F.col(n)) * F.lit(float(c)) for n, c in zip(self.names, coef)])


def fold_statistics(rows: DataFrame, names: list[str], y: str, w: str, group: str, n_folds: int = FOLDS) -> dict:
    """Cross products per fold, brought to the driver: n_folds matrices of the design width."""
    x = gram.cross_products(resample.with_folds(rows, group, n_folds), names, y, w, "_fold")
    return gram.matrices(x.toPandas(), "_fold", len(names) + 2)


def fit_ridge(rows: DataFrame, names: list[str], penalty: np.ndarray, *, y: str = "y_off", w: str = "off_possessions",
              group: str = "game", lambdas: np.ndarray = LAMBDAS, n_folds: int = FOLDS, envelope: bool = True) -> LinearModel:
    """Grouped cross-validation over all penalties, then the final fit, from one pass over the rows."""
    folds = fold_statistics(rows, names, y, w, group, n_folds)
    if not folds:
        raise ValueError("no row survives the recipe and skill joins")
    cv = gram.cross_validate(folds, penalty, lambdas)
    best = cv.loc[cv["rmse"].idxmin()]
    total = sum(folds.values())
    beta, b0, mean, sd = gram.ridge(total, penalty, best["lam"])
    coef, c0 = gram.raw_scale(beta, b0, mean, sd)
    meta = {"lambda": float(best["lam"]), "cv_rmse": float(best["rmse"]), "curve": cv, "total_weight": float(total[0, 0]),
            "train_rmse": float(np.sqrt(gram.squared_error(total, coef, c0) / total[0, 0])), "folds": folds,
            "league_average": dict(zip(names, mean.tolist()))}
    if envelope:
        r = rows.agg(*[F.min(n).alias(f"a{i}") for i, n in enumerate(names)], *[F.max(n).alias(f"b{i}") for i, n in enumerate(names)]).first()
        meta["feature_min"] = [(r[f"a{i}"] - mean[i]) / sd[i] for i in range(len(names))]
        meta["feature_max"] = [(r[f"b{i}"] - mean[i]) / sd[i] for i in range(len(names))]
    return LinearModel(names, beta, b0, mean, sd, meta)


def baseline_rmse(folds: dict, columns: list[int]) -> float:
    """Cross-validated RMSE of an unpenalized fit on some columns; no columns is the mean-only model."""
    total = sum(folds.values())
    errs = []
    for g in folds.values():
        t = gram.subset(total - g, columns)
        v = gram.subset(g, columns)
        coef, b0 = gram.raw_scale(*gram.ridge(t, np.zeros(len(columns)), 0.0)) if columns else (np.zeros(0), t[0, -1] / t[0, 0])
        errs.append(np.sqrt(gram.squared_error(v, coef, b0) / v[0, 0]))
    return float(np.mean(errs))


def without_team(stints: DataFrame, team: Column, off_team: str = "offense_team", def_team: str = "defense_team") -> DataFrame:
    """Rows in which the holdout team plays on neither side (P10)."""
    return stints.where((F.col(off_team) != team) & (F.col(def_team) != team))


def leakage_count(rows: DataFrame, team: Column, off_team: str = "offense_team", def_team: str = "defense_team") -> DataFrame:
    """Rows that involve the holdout team; must be 0."""
    return rows.agg(F.count_if((F.col(off_team) == team) | (F.col(def_team) == team)).alias("n_leaking"))


def lineup_features(lineups: DataFrame, recipes: DataFrame, skill: DataFrame, k: int, keys: list[str]) -> DataFrame:
    """Both-sided sums of a line-up, the same columns as the design (R8); line-ups with unknown members are left out."""
    join_on = [c for c in ("member", "season") if c in recipes.columns and c in skill.columns]
    members = recipes.join(skill, join_on)
    sums = _side(lineups, members, {"off": ("ids", "skill_off"), "def": ("ids", "skill_def")}, keys, k)
    return with_products(sums.withColumn("home_off", F.lit(0.5)), k)


def score_lineups(features: DataFrame, model: LinearModel, k: int, keep: list[str]) -> DataFrame:
    """Predicted rating on offense and defense against the average opponent, and the difference."""
    avg = model.meta.get("league_average") or dict(zip(model.names, model.mean.tolist()))
    pairs = vec.triangle(k, diagonal=False)

    def opponent(side: str) -> dict[str, Column]:
        o = {f"s_{side}": F.lit(avg[f"s_{side}"])}
        o |= {f"e_{side}_{i}": F.lit(avg[f"e_{side}_{i}"]) for i in range(k)}
        # products of averages, not averages of products
        return o | {f"x_{side}_{i}_{j}": F.lit(avg[f"e_{side}_{i}"] * avg[f"e_{side}_{j}"]) for i, j in pairs}

    off, dfn = model.predict(opponent("def")), model.predict(opponent("off"))
    return features.select(*keep, off.alias("ortg"), dfn.alias("drtg"), (off - dfn).alias("net"))


def score_matchups(rows: DataFrame, model: LinearModel, keep: list[str]) -> DataFrame:
    """Predicted rating of every design row against its own, given defense."""
    return rows.select(*keep, model.predict().alias("ortg"))


def observed_ratings(stints: DataFrame, keys: list[str], min_possessions: float) -> DataFrame:
    """Line-up totals on offense and, for the same set, on defense."""
    off = stints.groupBy(*keys, F.array_sort("off").alias("ids")).agg(
        F.sum("off_possessions").alias("off_possessions"), F.sum("off_points").alias("off_points")).where(
        F.col("off_possessions") >= min_possessions)
    dfn = stints.groupBy(*keys, F.array_sort("def").alias("ids")).agg(
        F.sum("off_possessions").alias("def_possessions"), F.sum("off_points").alias("points_allowed"))
    j = off.join(dfn, [*keys, "ids"], "left")
    ortg = stats.ratio(100.0 * F.col("off_points"), "off_possessions")
    drtg = stats.ratio(100.0 * F.col("points_allowed"), "def_possessions")
    return j.select(*keys, "ids", "off_possessions", F.coalesce("def_possessions", F.lit(0.0)).alias("def_possessions"),
                    ortg.alias("observed_ortg"), drtg.alias("observed_drtg"), (ortg - drtg).alias("observed_net"))


def holdout_report(observed: DataFrame, predicted: DataFrame, keys: list[str]) -> DataFrame:
    """Correlation and mean absolute error of predictions against observations."""
    j = observed.join(predicted, keys)
    return j.agg(
        F.count(F.lit(1)).alias("n"), F.corr("observed_ortg", "ortg").alias("corr_ortg"),
        F.avg(F.abs(F.col("observed_ortg") - F.col("ortg"))).alias("mae_ortg"),
        F.count("observed_net").alias("n_net"),
        F.corr("observed_net", F.when(F.col("observed_net").isNotNull(), F.col("net"))).alias("corr_net"),
        F.avg(F.abs(F.col("observed_net") - F.col("net"))).alias("mae_net"))


# --- outcome models on groups -------------------------------------------------

def group_table(lineups: DataFrame, recipes: DataFrame, talent: DataFrame, k: int, min_weight: float = 0.0) -> DataFrame:
    """Groups whose members all have a recipe and a talent value, with mean mixture, entropy and talent sum.

    ``lineups``: season, ids, size, min and outcome columns; ``talent``: member, season, bpm.
    """
    keep = lineups.where(F.col("min") >= min_weight)
    rows = keep.select("season", "ids", "size", F.explode("ids").alias("member"))
    j = rows.join(recipes.select("member", "season", "recipe"), ["member", "season"]).join(
        talent.select("member", "season", "bpm").where(F.col("bpm").isNotNull()), ["member", "season"])
    g = j.groupBy("season", "ids").agg(
        F.max("size").alias("_n"), F.count(F.lit(1)).alias("_known"), F.sum("bpm").alias("sum_bpm"),
        *[F.avg(F.col("recipe")[i]).alias(f"a{i}") for i in range(k)]).where(F.col("_n") == F.col("_known"))
    out = keep.join(g.drop("_n", "_known"), ["season", "ids"])
    mixture = F.array(*[F.col(f"a{i}") for i in range(k)])
    return out.withColumn("mixture", mixture).withColumn("entropy", vec.exp_entropy("mixture", k))


def invert_lower_is_better(df: DataFrame, columns: list[str]) -> DataFrame:
    """Negate columns in which lower is better and rename them (P5)."""
    for c in columns:
        df = df.withColumn(f"{c}_inv", -F.col(c)).drop(c)
    return df


def reference_component(groups: DataFrame, k: int) -> DataFrame:
    """Component with the largest weighted exposure, one row."""
    sums = groups.agg(*[F.sum(F.col("min") * F.col(f"a{i}")).alias(f"s{i}") for i in range(k)])
    v = F.array(*[F.col(f"s{i}") for i in range(k)])
    return sums.select(vec.argmax(v).alias("reference"), F.array_max(v).alias("mass"))


def outcome_columns(k: int, reference: int) -> list[str]:
    """Design of the outcome model: talent, k-1 shares, entropy."""
    return ["sum_bpm", *[f"a{i}" for i in range(k) if i != reference], "entropy"]


def cluster_statistics(groups: DataFrame, names: list[str], outcome: str, cluster: str) -> DataFrame:
    return gram.cross_products(groups, names, outcome, "min", cluster)


@dataclass
class OutcomeModel:
    names: list[str]
    coef: np.ndarray
    intercept: float
    reference: int
    r2: float
    ci: np.ndarray | None = None
    n_draws: int = 0

    def predict(self) -> Column:
        return F.lit(self.intercept) + vec.total([F.col(n) * F.lit(float(c)) for n, c in zip(self.names, self.coef)])

    def frame(self, spark: SparkSession) -> DataFrame:
        rows = [(n, float(c), *( [float(x) for x in self.ci[i]] if self.ci is not None else [None, None]))
                for i, (n, c) in enumerate(zip(self.names, self.coef))]
        return spark.createDataFrame(rows, "feature string, coef double, ci_low double, ci_high double")


def draw_counts(n_clusters: int, draws: int, seed: int = 42) -> np.ndarray:
    """How often each cluster of a single block is drawn: (draws, clusters), each row sums to the cluster count."""
    total = resample.block_draws(np.array([n_clusters]), draws, seed)[:, 0]
    return resample.picks_in_block(total, n_clusters, 0, seed)


def fit_outcome(groups: DataFrame, outcome: str, k: int, cluster: str = "team", reference: int | None = None,
                draws: int = 1000, seed: int = 42) -> OutcomeModel:
    """Weighted least squares with cluster-bootstrap intervals.

    The rows are read once, into one matrix per cluster. A draw is a weighted sum of cluster matrices; sums and refits
    run on the executors, and the driver receives the coefficients of the draws.
    """
    if reference is None:
        reference = int(reference_component(groups, k).first()["reference"])
    names = outcome_columns(k, reference)
    p = len(names) + 2
    width = p * (p + 1) // 2
    triangle = F.array_sort(F.collect_list(F.struct("i", "j", "value")))  # one value per cell
    per = cut_lineage(cluster_statistics(groups, names, outcome, cluster).groupBy(cluster).agg(
        F.transform(triangle, lambda c: c["value"]).alias("cells")))
    whole = per.agg(*[F.sum(F.col("cells")[i]).alias(f"c{i}") for i in range(width)]).first()  # one row
    if whole[0] is None:
        raise ValueError("no group survives the joins")
    total = gram.unpacked(np.array(whole, dtype=float), p)
    coef, b0 = gram.least_squares(total)
    ci = None
    if draws:
        sums = resample.cluster_draw_sums(per, cluster, width, draws, seed)
        cols = [f"c{i}" for i in range(width)]

        def refit(batches):
            for pdf in batches:
                yield pd.DataFrame({"coef": [gram.least_squares(gram.unpacked(row, p))[0] for row in pdf[cols].to_numpy()]})

        boot = np.stack(sums.mapInPandas(refit, "coef array<double>").toPandas()["coef"].to_numpy())  # draws x p numbers
        ci = np.percentile(boot, [2.5, 97.5], axis=0).T
    return OutcomeModel(names, coef, b0, reference, gram.r_squared(total, coef, b0), ci, draws)


def cross_validate_outcome(groups: DataFrame, outcome: str, k: int, reference: int, cluster: str = "team", n_folds: int = FOLDS) -> dict:
    """Out-of-sample weighted R2 by team folds, full against talent only."""
    names = outcome_columns(k, reference)
    folds = fold_statistics(groups, names, outcome, "min", cluster, n_folds)
    total = sum(folds.values())

    def score(cols):
        out = []
        for g in folds.values():
            v = gram.subset(g, cols)
            out.append(gram.r_squared(v, *gram.least_squares(gram.subset(total - g, cols))))
        return float(np.mean(out))

    full, base = score(list(range(len(names)))), score([0])
    return {"r2_full": full, "r2_baseline": base, "full_beats_baseline": full > base}


def granularity(tables: dict[int, DataFrame], outcome: str, k: int, reference: int, draws: int = 0) -> pd.DataFrame:
    """Raw and standardized coefficients per group size with one reference."""
    frames = []
    for n, g in tables.items():
        m = fit_outcome(g, outcome, k, reference=reference, draws=draws)
        sd = g.agg(*[stats.weighted_std(c, "min").alias(c) for c in m.names]).first()
        frames.append(pd.DataFrame({"size": n, "feature": m.names, "coef": m.coef, "sd": [sd[c] for c in m.names]}))
    out = pd.concat(frames, ignore_index=True)
    out["std_coef"] = out["coef"] * out["sd"]
    return out


def extrapolate(model: OutcomeModel, baseline: OutcomeModel, groups: DataFrame, outcome: str) -> DataFrame:
    """Weighted correlation of a model fitted on smaller groups with the outcome of larger ones."""
    p = groups.withColumn("_full", model.predict()).withColumn("_base", baseline.predict())
    return p.agg(F.count(F.lit(1)).alias("n"), stats.weighted_corr(outcome, "_full", "min").alias("corr_full"),
                 stats.weighted_corr(outcome, "_base", "min").alias("corr_baseline"))


def outcome_report(tables: dict[int, DataFrame], larger: DataFrame, outcome: str, k: int, size: int = 4, draws: int = 1000) -> DataFrame:
    """Model, cross-validation, granularity and extrapolation of one outcome in one long table (R33): section, item,
    value, low, high. ``tables``: groups by size, ``size`` among them; ``larger``: groups of one more member."""
    groups = tables[size]
    spark = groups.sparkSession
    m = fit_outcome(groups, outcome, k, draws=draws)
    cv = cross_validate_outcome(groups, outcome, k, m.reference)
    g = gram.matrix(gram.cross_products(groups, ["sum_bpm"], outcome, "min").toPandas(), 3)
    coef, b0 = gram.least_squares(g)
    far = extrapolate(m, OutcomeModel(["sum_bpm"], coef, b0, m.reference, float("nan")), larger, outcome).first()  # one row
    rows = [("model", n, float(c), float(lo), float(hi)) for n, c, (lo, hi) in zip(m.names, m.coef, m.ci)]
    rows += [("model", "r2", float(m.r2), None, None), ("model", "reference", float(m.reference), None, None)]
    rows += [("cross_validation", n, float(cv[n]), None, None) for n in ("r2_baseline", "r2_full")]
    rows += [(f"size_{r['size']}", r["feature"], float(r["coef"]), None, None) for r in granularity(tables, outcome, k, m.reference).to_dict("records")]
    rows += [("extrapolation", n, None if far[n] is None else float(far[n]), None, None) for n in ("n", "corr_full", "corr_baseline")]
    return spark.createDataFrame(rows, "section string, item string, value double, low double, high double")


def substitutions(groups: DataFrame, coefficients: dict[str, float], k: int, delta: float = 0.1) -> DataFrame:
    """Predicted change from moving ``delta`` of mixture weight from component i to j, for all i and j.

    Needs at least ``delta`` on the source; the entropy term is recomputed.
    """
    moves = F.array(*[F.struct(F.lit(i).alias("source"), F.lit(j).alias("target")) for i in range(k) for j in range(k) if i != j])
    rows = groups.select("*", F.explode(moves).alias("m")).select("*", "m.*").drop("m")
    rows = rows.where(F.element_at("mixture", F.col("source") + 1) >= F.lit(delta - 1e-9))
    shifted = [F.col("mixture")[i] - F.when(F.col("source") == i, delta).otherwise(0.0)
               + F.when(F.col("target") == i, delta).otherwise(0.0) for i in range(k)]
    rows = rows.withColumn("_new", F.array(*shifted))
    change = vec.total([(F.col("_new")[i] - F.col("mixture")[i]) * F.lit(float(coefficients.get(f"a{i}", 0.0))) for i in range(k)])
    change = change + (vec.exp_entropy("_new", k) - vec.exp_entropy("mixture", k)) * F.lit(float(coefficients["entropy"]))
    return rows.withColumn("change", change).drop("_new")


# --- synergy ------------------------------------------------------------------

def cell_names(k: int) -> list[str]:
    return [f"c{i}_{j}" for i, j in vec.triangle(k)]


def pair_exposure(pairs: DataFrame, recipes: DataFrame, k: int, quality: DataFrame | None = None) -> DataFrame:
    """Exposure cells of each pair, with both members' quality where given."""
    r = recipes.select("member", "season", "recipe")
    q = quality.select("member", "season", F.col("bpm").alias("q")) if quality is not None else None

    def role(name: str) -> DataFrame:
        d = r.join(q, ["member", "season"]) if q is not None else r
        return d.select(F.col("member").alias(name), "season", F.col("recipe").alias(f"r{name}"),
                        *([F.col("q").alias(f"q{name}")] if q is not None else []))

    j = pairs.join(role("a"), ["a", "season"]).join(role("b"), ["b", "season"])
    return j.select("*", *[vec.symmetric_cell("ra", "rb", i, c).alias(f"c{i}_{c}") for i, c in vec.triangle(k)])


def fit_synergy(exposure: DataFrame, k: int, covariates: list[str] | None = None, outcome: str = "net_rating", intercept: bool = True) -> dict:
    """Smallest-norm weighted least squares on the cells; symmetric matrix and R2."""
    names = [*cell_names(k), *(covariates or [])]
    g = gram.matrix(gram.cross_products(exposure, names, outcome, "min").toPandas(), len(names) + 2)
    coef, b0 = gram.least_squares(g, intercept)
    m = np.zeros((k, k))
    for (i, j), c in zip(vec.triangle(k), coef):
        m[i, j] = m[j, i] = c
    return {"matrix": m, "intercept": b0, "r2": gram.r_squared(g, coef, b0), "covariates": coef[len(cell_names(k)):]}


def matrix_frame(spark: SparkSession, m: np.ndarray) -> DataFrame:
    """k x k matrix as rows (SRC26)."""
    k = len(m)
    return spark.createDataFrame([(i, j, float(m[i, j])) for i in range(k) for j in range(k)], "i int, j int, value double")


def compare_fits(spark: SparkSession, fits: dict[str, dict]) -> DataFrame:
    """R2, range and positive share of each matrix."""
    rows = [(n, float(f["r2"]), float(f["matrix"].min()), float(f["matrix"].max()), float((f["matrix"] > 0).mean()))
            for n, f in fits.items()]
    return spark.createDataFrame(rows, "fit string, r2 double, min_value double, max_value double, positive_share double")


# --- reliability ----------------------------------------------------------------

def split_half(stints: DataFrame, half: Column, keys: list[str], min_possessions: float) -> DataFrame:
    """Correlation of line-up ratings between two halves of the segments."""
    g = stints.groupBy(*keys, F.array_sort("off").alias("ids"), half.alias("half")).agg(
        F.sum("off_possessions").alias("p"), F.sum("off_points").alias("pts"))
    w = g.groupBy(*keys, "ids").agg(
        F.max(F.when(F.col("half") == 0, F.struct("p", "pts"))).alias("a"),
        F.max(F.when(F.col("half") == 1, F.struct("p", "pts"))).alias("b"))
    w = w.where((F.col("a.p") >= min_possessions) & (F.col("b.p") >= min_possessions))
    return w.agg(F.count(F.lit(1)).alias("n"),
                 F.corr(100.0 * F.col("a.pts") / F.col("a.p"), 100.0 * F.col("b.pts") / F.col("b.p")).alias("corr"))


def team_season_validation(predicted: DataFrame, official: DataFrame, keys: list[str]) -> DataFrame:
    """Weighted mean prediction per team-season against the official rating."""
    p = predicted.groupBy(*keys).agg(stats.weighted_mean("prediction", "off_possessions").alias("prediction"))
    return p.join(official, keys).agg(F.count(F.lit(1)).alias("n"), F.corr("prediction", "rating").alias("corr"))
