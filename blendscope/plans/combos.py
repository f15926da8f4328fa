"""Member combinations of bounded rosters: pair sums, model scores, structural flags (2.16).

A roster has a fixed number of slots, so its combinations are a fixed index
table that is joined by roster size; no member pairs are formed outside a roster.
"""

from __future__ import annotations

from itertools import combinations
from math import comb

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from blendscope.functions import vectors as vec
from blendscope.operators import relational

MAX_SETS = 200_000


def roster(members: DataFrame, keys: list[str], order: list[Column], payload: list[str]) -> DataFrame:
    """All members of each team as one array of structs in slot order. A roster is short; ``enumerate_sets`` checks it."""
    ranked = members.withColumn("slot", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    return ranked.groupBy(*keys).agg(
        F.array_sort(F.collect_list(F.struct("slot", *payload))).alias("roster")).withColumn("n", F.size("roster"))


def index_table(spark: SparkSession, sizes: range, r: int) -> DataFrame:
    """All r-subsets of 0..n-1 for every roster size n: n, i0..i(r-1). Refuses rosters that are not rosters."""
    total = sum(comb(n, r) for n in sizes)
    if total > MAX_SETS:
        raise ValueError(f"{total} index sets; rosters of up to {sizes[-1]} members with sets of {r} are too large to enumerate")
    rows = [(n, *c) for n in sizes for c in combinations(range(n), r)]
    schema = "n int, " + ", ".join(f"i{j} int" for j in range(r))
    return spark.createDataFrame(rows or [(0, *([0] * r))], schema)


def enumerate_sets(rosters: DataFrame, r: int, slots: int, keys: list[str]) -> DataFrame:
    """Every r-member set of every roster: keys, m0..m(r-1) member structs in slot order (K2, K3).

    A roster of more than ``slots`` members is an error: all its sets are too many, and a part of them would be wrong.
    """
    large = F.raise_error(F.concat(F.lit("a roster has "), F.col("n").cast("string"), F.lit(f" members, more than {slots}"))).cast("int")
    rosters = rosters.withColumn("n", F.when(F.col("n") <= slots, F.col("n")).otherwise(large))
    idx = index_table(rosters.sparkSession, range(r, slots + 1), r)
    j = rosters.join(F.broadcast(idx), "n")  # the index table is fixed by the roster size
    return j.select(*keys, *[F.element_at("roster", F.col(f"i{m}") + 1).alias(f"m{m}") for m in range(r)])


def describe_sets(sets: DataFrame, r: int, k: int, talent: str = "bpm") -> DataFrame:
    """Mean mixture, talent sum and entropy of each set (K3)."""
    ms = [F.col(f"m{m}") for m in range(r)]
    out = sets.select(
        "*", F.array(*[m["member"] for m in ms]).alias("ids"),
        *[(vec.total([m["recipe"][i] for m in ms]) / r).alias(f"a{i}") for i in range(k)],
        vec.total([m[talent] for m in ms]).alias(f"sum_{talent}"))
    out = out.withColumn("mixture", F.array(*[F.col(f"a{i}") for i in range(k)]))
    return out.withColumn("entropy", vec.exp_entropy("mixture", k))


def pair_scores(sets2: DataFrame, matrix: np.ndarray) -> DataFrame:
    """a'Mb for every pair of a roster (K1). ``sets2``: sets of two."""
    return sets2.withColumn("score", bilinear(F.col("m0")["recipe"], F.col("m1")["recipe"], matrix))


def bilinear(a: Column, b: Column, matrix: np.ndarray) -> Column:
    k = len(matrix)
    return vec.total([a[i] * vec.total([b[j] * F.lit(float(matrix[i, j])) for j in range(k)]) for i in range(k)])


def pair_sums(sets: DataFrame, r: int, matrix: np.ndarray, k: int) -> DataFrame:
    """Sum of a'Mb over the pairs of each set (K2).

    For a symmetric M the pair sum is (s'Ms - sum of a'Ma) / 2 with s the sum
    of the recipes, so a set costs one quadratic form instead of r(r-1)/2;
    the members' own forms are computed once per member beforehand.
    """
    ms = [F.col(f"m{m}") for m in range(r)]
    s = F.array(*[vec.total([m["recipe"][i] for m in ms]) for i in range(k)])
    out = sets.withColumn("_s", s)
    own = vec.total([m["self_form"] for m in ms])
    return out.withColumn("score", (bilinear(F.col("_s"), F.col("_s"), matrix) - own) / 2).drop("_s")


def score_sets(sets: DataFrame, prediction: Column) -> DataFrame:
    """Model prediction per set (K4)."""
    return sets.withColumn("predicted", prediction)


def rank_sets(sets: DataFrame, keys: list[str], value: str, n: int = 10, tail: int = 3) -> DataFrame:
    """Best n and worst ``tail`` sets of each roster."""
    v = F.round(value, 9)
    best = relational.top_per_group(sets, keys, [v.desc(), F.col("ids")], n).withColumn("side", F.lit("head"))
    worst = relational.top_per_group(sets, keys, [v, F.col("ids")], tail).withColumn("side", F.lit("tail"))
    return best.unionByName(worst)


def unit_flags(sets: DataFrame, target: Column, k: int, groups: dict[str, list[int]], low: dict[str, float], high: dict[str, float]) -> DataFrame:
    """Match with a target mixture, group shares, and one flag per violated threshold (K5)."""
    out = sets.withColumn("env_match", F.round(F.lit(1.0) - F.coalesce(vec.js_distance("mixture", target, k), F.lit(1.0)), 12))
    for name, idx in groups.items():
        out = out.withColumn(f"{name}_share", vec.total([F.col(f"a{i}") for i in idx]))
    flags = []
    for name, cut in low.items():
        out = out.withColumn(f"flag_{name}", F.col(f"{name}_share") < cut)
        flags.append(f"flag_{name}")
    for name, cut in high.items():
        out = out.withColumn(f"flag_{name}", F.col(f"{name}_share") > cut)
        flags.append(f"flag_{name}")
    return out.withColumn("n_flags", vec.total([F.col(f).cast("int") for f in flags])).withColumn("any_flag", F.col("n_flags") > 0)


def anchored_groups(sets: DataFrame, keys: list[str], epsilon: float) -> DataFrame:
    """Tie groups with a moving anchor: a new group starts when the anchor leads by more than epsilon.

    The anchor walk only visits the distinct scores of one roster, whose
    number the roster size bounds; sets are joined back to their group.
    """
    walk = sets.select(*keys, "env_match").distinct().groupBy(*keys).agg(
        F.sort_array(F.collect_list("env_match"), asc=False).alias("v"))
    step = F.aggregate(
        "v",
        F.struct(F.lit(None).cast("double").alias("anchor"), F.lit(-1).alias("g"),
                 F.array().cast("array<struct<env_match:double,tie_group:int>>").alias("out")),
        lambda s, x: F.when(
            s["anchor"].isNull() | (s["anchor"] - x > epsilon),
            F.struct(x.alias("anchor"), (s["g"] + 1).alias("g"),
                     F.concat(s["out"], F.array(F.struct(x.alias("env_match"), (s["g"] + 1).alias("tie_group")))).alias("out")),
        ).otherwise(F.struct(s["anchor"].alias("anchor"), s["g"].alias("g"),
                             F.concat(s["out"], F.array(F.struct(x.alias("env_match"), s["g"].alias("tie_group")))).alias("out"))),
    )
    groups = walk.select(*keys, F.explode(step["out"]).alias("e")).select(*keys, "e.*")
    return sets.join(groups, [*keys, "env_match"])


def recommend(sets: DataFrame, keys: list[str], n: int) -> DataFrame:
    """Flag-free first, then tie group, then talent."""
    return relational.top_per_group(sets, keys, [F.col("any_flag"), F.col("tie_group"), F.round("sum_bpm", 9).desc(), F.col("ids")], n)


def worst_flagged(sets: DataFrame, keys: list[str]) -> DataFrame:
    """Most flags, then the lowest match (K9)."""
    return relational.top_per_group(sets.where("any_flag"), keys, [F.col("n_flags").desc(), F.col("env_match"), F.col("ids")], 1)


def key_members(sets: DataFrame, r: int, groups: dict[str, list[int]]) -> DataFrame:
    """Member with the largest share of each component group (K6)."""
    out = sets
    for name, idx in groups.items():
        cells = F.array(*[F.struct(F.round(vec.total([F.col(f"m{m}")["recipe"][i] for i in idx]), 12).alias("v"), F.lit(-m).alias("o"),
                                   F.col(f"m{m}")["member"].alias("member")) for m in range(r)])
        out = out.withColumn(f"{name}_lead", F.array_max(cells)["member"])
    return out


def constraint_units(sets: DataFrame, r: int, need: dict[str, list[int]], avoid: list[int]) -> DataFrame:
    """Sets in which every needed role has a dominant member and nobody is dominated by an avoided one (K7)."""
    tops = [vec.argmax(F.col(f"m{m}")["recipe"]) for m in range(r)]

    def anyone(idx: list[int]) -> Column:
        hit = F.lit(False)
        for t in tops:
            hit = hit | t.isin(*idx)
        return hit

    out = sets
    ok = ~anyone(avoid)
    for name, idx in need.items():
        out = out.withColumn(f"has_{name}", anyone(idx))
        ok = ok & anyone(idx)
    return out.withColumn("has_redundancy", anyone(avoid)).withColumn("passes", ok)


def incompatible(recipes: DataFrame, component: int, target: Column, k: int, threshold: float = 0.30) -> DataFrame:
    """Members with a high share of one component, with their cosine to the target (K8)."""
    return recipes.where(F.col("recipe")[component] >= threshold).select(
        "member", "season", F.col("recipe")[component].alias("share"), vec.cosine("recipe", target, k).alias("cosine"))
