"""Use against production: grounding features, peer centroid, signature (2.14)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from blendscope.functions import vectors as vec
from blendscope.operators import pairwise, relational


def feature_rows(df: DataFrame, features: list[str], vectors: dict[str, str], keep: list[str]) -> DataFrame:
    """Feature vectors to rows: idx, feature and one value per named vector."""
    cells = F.array(*[
        F.struct(F.lit(i).alias("idx"), F.lit(f).alias("feature"), *[F.col(v)[i].alias(n) for n, v in vectors.items()])
        for i, f in enumerate(features)])
    return df.select(*keep, F.explode(cells).alias("c")).select(*keep, "c.*")


def grounding(
    targets: DataFrame, basis: DataFrame, features: list[str], outcome: list[str], opportunity: list[str], cut: float = 0.3,
    evidence: list[str] | None = None,
) -> DataFrame:
    """Per member: best outcome contribution and worst opportunity deficit towards a component (M4).

    ``targets``: member, season, component, z[p]; ``basis``: component, z[p], k rows. Only features in ``evidence`` are
    cited, if it is given; where none reaches ``cut`` the feature is null.
    """
    if evidence is not None:
        outcome, opportunity = [f for f in outcome if f in evidence], [f for f in opportunity if f in evidence]
    b = basis.select("component", F.col("z").alias("bz"))
    rows = feature_rows(targets.join(F.broadcast(b), "component"), features, {"z": "z", "bz": "bz"},
                        ["member", "season", "component"])
    rows = rows.withColumn("contribution", F.when(F.col("feature").isin(*outcome), F.col("z") * F.col("bz")))
    rows = rows.withColumn("deficit", F.when(F.col("feature").isin(*opportunity), F.col("bz") - F.col("z")))

    def best(measure: str):
        return F.max_by(F.struct("feature", "z", F.col(measure).alias("v")),
                        F.when(F.col(measure).isNotNull(), F.struct(F.col(measure), -F.col("idx"))))

    g = rows.groupBy("member", "season", "component").agg(best("contribution").alias("o"), best("deficit").alias("d"))
    o_ok, d_ok = F.col("o.v") >= cut, F.col("d.v") >= cut
    return g.select(
        "member", "season", "component",
        F.when(o_ok, F.col("o.feature")).alias("outcome_feature"), F.when(o_ok, F.col("o.z")).alias("outcome_z"),
        F.when(d_ok, F.col("d.feature")).alias("opportunity_feature"), F.when(d_ok, F.col("d.z")).alias("opportunity_z"),
        F.when(d_ok, F.col("d.v")).alias("deficit"))


def miscast_grounding(scores: DataFrame, basis: DataFrame, features: list[str], outcome: list[str], opportunity: list[str],
                      evidence: list[str], cut: float = 0.3) -> DataFrame:
    """Which features speak for the under-used component of every member (M4).

    ``scores``: rows of the miscast score with member, season, z[p], underused and gap_pp; ``basis``: component, z[p].
    """
    targets = scores.select("member", "season", F.col("underused").alias("component"), "z")
    g = grounding(targets, basis, features, outcome, opportunity, cut, evidence)
    return g.join(scores.select("member", "season", "score", "gap_pp"), ["member", "season"]).withColumnRenamed("component", "underused")


def peer_centroid(mix: DataFrame, z: DataFrame, k: int, p: int, power: float = 4.0, *, blocks: int | None = None) -> DataFrame:
    """Similarity-weighted mean z vector of all other members of the season, with its effective size (M5)."""
    pool = mix.select("member", "season", "recipe").join(z.select("member", "season", "z"), ["member", "season"])
    out = pairwise.weighted_environment(
        mix.select("member", "season", "recipe"), pool, keys=["season"], target_id="member", pool_id="member",
        vector="recipe", values="z", k=k, m=p, power=power, undefined_distance=0.0, blocks=blocks)
    return out.where(F.col("n") > 0).withColumnRenamed("mean", "centroid")


def signature(z: DataFrame, centroid: DataFrame, features: list[str], n_axes: int = 10, forced: float = 1.0, n_top: int = 3) -> DataFrame:
    """Axes with the largest |centroid| plus every deviation beyond ``forced``; top deviations ranked (M6)."""
    j = z.select("member", "season", "z").join(centroid.select("member", "season", "centroid", "ess"), ["member", "season"])
    rows = feature_rows(j, features, {"z": "z", "c": "centroid"}, ["member", "season", "ess"])
    rows = rows.withColumn("deviation", F.col("z") - F.col("c"))
    w = Window.partitionBy("member", "season")  # p rows per member
    rows = rows.withColumn("loading_rank", F.row_number().over(w.orderBy(F.abs("c").desc(), "idx"))).withColumn(
        "deviation_rank", F.row_number().over(w.orderBy(F.abs("deviation").desc(), "idx")))
    return rows.where((F.col("loading_rank") <= n_axes) | (F.abs("deviation") > forced)).withColumn(
        "is_top", F.col("deviation_rank") <= n_top)


def select_gaps(rows: DataFrame, keys: list[str], value: str, threshold: float = 3.0, fallback: int = 3) -> DataFrame:
    """Rows with |value| at or above the threshold; the top few where fewer than two qualify."""
    w = Window.partitionBy(*keys)  # k rows per key
    ranked = rows.withColumn("_hits", F.count_if(F.abs(value) >= threshold).over(w)).withColumn(
        "rank", F.row_number().over(w.orderBy(F.abs(value).desc(), "component")))
    keep = F.when(F.col("_hits") >= 2, F.abs(value) >= threshold).otherwise(F.col("rank") <= fallback)
    return ranked.where(keep).withColumn("all_aligned", F.col("_hits") < 2).drop("_hits")


def dumbbell(rows: DataFrame, keys: list[str], a: str, b: str, n: int = 5) -> DataFrame:
    """The n rows with the largest of two values."""
    return relational.top_per_group(rows, keys, [F.greatest(a, b).desc(), F.col("component")], n)


def top_shares(df: DataFrame, columns: dict[str, str], keep: list[str], n: int = 3) -> DataFrame:
    """The n largest shares of a row and the rest as "Other", never below 0."""
    cells = F.array(*[F.struct((-F.coalesce(F.col(c), F.lit(0.0))).alias("neg"), F.lit(i).alias("o"), F.lit(name).alias("name"))
                      for i, (name, c) in enumerate(columns.items())])
    top = F.slice(F.array_sort(cells), 1, n)
    rest = F.greatest(F.lit(0.0), F.lit(1.0) + F.aggregate(top, F.lit(0.0), lambda s, x: s + x["neg"]))
    rows = F.concat(
        F.transform(top, lambda x, i: F.struct((i + 1).cast("int").alias("rank"), x["name"].alias("name"), (-x["neg"]).alias("share"))),
        F.array(F.struct(F.lit(n + 1).alias("rank"), F.lit("Other").alias("name"), rest.alias("share"))))
    return df.select(*keep, F.explode(rows).alias("c")).select(*keep, "c.*")
