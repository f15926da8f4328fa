"""Partner environment: exposure, similar-member benchmark, mismatch, lift, composition gaps.

Tables: ``edges`` (season, focal, mate, min, net_rating) directed pairs;
``recipes`` (member, season, recipe[k]). All members and seasons are computed
in one job; a single member is a filter on the result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from blendscope.functions import text as tx
from blendscope.functions import vectors as vec
from blendscope.operators import pairwise, relational
from blendscope.operators.ordered import quantiles
from blendscope.session import cut_lineage


def directed_edges(pairs: DataFrame) -> DataFrame:
    """Each undirected pair becomes two directed rows (J6), without a self-join."""
    other = [c for c in pairs.columns if c not in ("a", "b")]
    ends = F.array(F.struct(F.col("a").alias("focal"), F.col("b").alias("mate")),
                   F.struct(F.col("b").alias("focal"), F.col("a").alias("mate")))
    return pairs.select(*other, F.explode(ends).alias("e")).select("e.*", *other)


def mate_mixtures(edges: DataFrame, recipes: DataFrame) -> DataFrame:
    """Directed pairs with the partner's recipe; the recipe is null where it is unknown."""
    r = recipes.select(F.col("member").alias("mate"), "season", F.col("recipe").alias("mate_recipe"))
    return edges.join(r, ["mate", "season"], "left")


def exposure(edges: DataFrame, recipes: DataFrame, k: int) -> DataFrame:
    """Weight-averaged partner mixture of every member and season.

    Partners without a recipe are dropped and counted.
    """
    merged = mate_mixtures(edges, recipes)
    known = F.col("mate_recipe").isNotNull()
    sums = merged.groupBy("season", "focal").agg(
        *[F.sum(F.when(known, F.col("min") * F.col("mate_recipe")[i])).alias(f"s{i}") for i in range(k)],
        F.count_if(known).alias("n_mates"),
        F.count_if(~known).alias("n_dropped"),
        F.sum(F.when(known, F.col("min"))).alias("mate_min"),
    )
    total = vec.total([F.col(f"s{i}") for i in range(k)])
    return sums.where(total > 0).select(
        F.col("focal").alias("member"), "season",
        F.array(*[F.col(f"s{i}") / total for i in range(k)]).alias("exposure"),
        "mate_min", "n_mates", "n_dropped",
    )


def own_exposure_from_groups(groups: DataFrame, recipes: DataFrame, k: int) -> DataFrame:
    """Exposure over groups of any size, without forming member pairs.

    For a group with weight m, a member's partners sum to (group sum - own
    recipe), so one pass over member rows is enough: linear in the group size.
    ``groups``: season, ids, min.
    """
    flat = groups.select(tx.pack_group_ids("ids").alias("_g"), "season", "min", F.explode("ids").alias("member"))
    r = recipes.select("member", "season", "recipe")
    rows = flat.join(r, ["member", "season"])
    whole = rows.groupBy("_g", "season").agg(*[F.sum(F.col("recipe")[i]).alias(f"g{i}") for i in range(k)])
    joined = rows.join(whole, ["_g", "season"])
    sums = joined.groupBy("member", "season").agg(
        *[F.sum(F.col("min") * (F.col(f"g{i}") - F.col("recipe")[i])).alias(f"s{i}") for i in range(k)]
    )
    total = vec.total([F.col(f"s{i}") for i in range(k)])
    return sums.where(total > 1e-9).select(
        "member", "season", F.array(*[F.col(f"s{i}") / total for i in range(k)]).alias("exposure"))


def season_average(exposures: DataFrame, k: int, weight: str = "mate_min") -> DataFrame:
    """Weighted mean exposure of a season."""
    w = F.col(weight)
    return exposures.groupBy("season").agg(
        F.sum(w).alias("weight"), F.array(*[F.sum(F.col("exposure")[i] * w) / F.sum(w) for i in range(k)]).alias("exposure"))


def benchmark(
    recipes: DataFrame, exposures: DataFrame, k: int, oncourt: DataFrame | None = None,
    power: float = 4.0, *, blocks: int | None = None, targets: DataFrame | None = None,
) -> DataFrame:
    """Similarity-weighted environment of all other members.

    Per target and season: n_pool, ess, expected[k] and, with ``oncourt``, the
    same over members with a positive net rating. ``targets`` (member, season,
    recipe) may be hypothetical mixtures.
    """
    pool = recipes.select("member", "season", "recipe").join(exposures.select("member", "season", "exposure"),
                                                            ["member", "season"])
    flag = None
    if oncourt is not None:
        good = oncourt.select("member", "season", (F.col("net_rating") > 0).alias("is_positive"))
        pool = pool.join(good, ["member", "season"], "left")
        flag = "is_positive"
    t = targets if targets is not None else recipes
    out = pairwise.weighted_environment(
        t.select("member", "season", "recipe"), pool, keys=["season"], target_id="member", pool_id="member",
        vector="recipe", values="exposure", k=k, m=k, flag=flag, power=power, undefined_distance=0.0, blocks=blocks,
    )
    out = out.withColumnRenamed("n", "n_pool").withColumnRenamed("mean", "expected")
    if flag:
        out = (out.withColumnRenamed("n_pos", "n_pool_positive").withColumnRenamed("ess_pos", "ess_positive")
               .withColumnRenamed("mean_pos", "expected_positive"))
    return out.where(F.col("n_pool") > 0)


def mismatch(exposures: DataFrame, bench: DataFrame, k: int) -> DataFrame:
    """Distance between actual and expected environment, with the difference vector."""
    j = exposures.join(bench, ["member", "season"])
    return j.withColumn("diff", vec.subtract("exposure", "expected", k)).withColumn(
        "score", vec.js_distance("exposure", "expected", k)
    )


def long_components(df: DataFrame, columns: dict[str, str], keep: list[str]) -> DataFrame:
    """Vector columns to rows: one row per component with ``component`` and the named values."""
    zipped = F.arrays_zip(*[F.col(v).alias(n) for n, v in columns.items()])
    return df.select(*keep, F.posexplode(zipped).alias("component", "_v")).select(*keep, "component", "_v.*")


def compare(mis: DataFrame, k: int) -> DataFrame:
    """Actual against one or two baselines, per component in percentage points."""
    cols = {"actual": "exposure", "baseline": "expected"}
    two = "expected_positive" in mis.columns
    if two:
        cols["baseline_positive"] = "expected_positive"
    rows = long_components(mis, cols, ["member", "season"])
    rows = rows.withColumn("diff_pp", (F.col("actual") - F.col("baseline")) * 100)
    if two:
        rows = rows.withColumn("diff_pp_positive", (F.col("actual") - F.col("baseline_positive")) * 100)
    w = Window.partitionBy("member", "season").orderBy(F.abs("diff_pp").desc(), "component")  # k rows
    return rows.withColumn("rank", F.row_number().over(w))


def screening(recipes: DataFrame, mis: DataFrame, oncourt: DataFrame, identity: DataFrame) -> DataFrame:
    """One row per member and season: top component, concentration, mismatch, rating, team."""
    r = recipes.select("member", "season", "min", vec.argmax("recipe").alias("top_component"),
                       vec.purity("recipe").alias("concentration"))
    return (
        r.join(mis.select("member", "season", "score"), ["member", "season"])
        .join(oncourt.select("member", "season", "net_rating"), ["member", "season"], "left")
        .join(identity.select("member", "name", "team"), "member", "left")
    )


def quadrants(screen: DataFrame) -> DataFrame:
    """Median mismatch and rating per season, and the quadrant of each rated member."""
    screen = cut_lineage(screen)  # read by three branches
    mx = quantiles(screen, ["season"], "score", {"med_score": 0.5}).drop("n")
    my = quantiles(screen, ["season"], "net_rating", {"med_rating": 0.5}).drop("n")
    j = screen.where(F.col("net_rating").isNotNull()).join(mx, "season").join(my, "season")
    side = F.when(F.col("score") >= F.col("med_score"), "mismatched").otherwise("matched")
    level = F.when(F.col("net_rating") >= F.col("med_rating"), "high").otherwise("low")
    return j.withColumn("quadrant", F.concat_ws("-", side, level))


def lift(edges: DataFrame, recipes: DataFrame, oncourt: DataFrame, k: int) -> DataFrame:
    """Rating next to each component relative to the member's own rating (X11), one row per component."""
    base = oncourt.select(F.col("member").alias("focal"), "season", F.col("net_rating").alias("own_rating"))
    merged = mate_mixtures(edges, recipes).where(F.col("mate_recipe").isNotNull())
    aggs = []
    for i in range(k):
        w = F.col("min") * F.col("mate_recipe")[i]
        aggs += [
            F.sum(w * F.col("net_rating")).alias(f"r{i}"),
            F.sum(F.when(F.col("net_rating").isNotNull(), w)).alias(f"w{i}"),
            F.sum(w).alias(f"d{i}"),
            F.count_if(F.col("mate_recipe")[i] > 0.01).alias(f"c{i}"),
        ]
    # the own rating meets one row per member and season, not every pair
    sums = merged.groupBy("season", "focal").agg(*aggs).join(base, ["focal", "season"])
    sums = sums.select("season", "focal", "own_rating", *[(F.col(f"r{i}") - F.col("own_rating") * F.col(f"w{i}")).alias(f"n{i}") for i in range(k)],
                       *[c for i in range(k) for c in (f"d{i}", f"c{i}")])
    cells = F.array(*[
        F.struct(
            F.lit(i).alias("component"),
            F.when(F.col(f"d{i}") > 1e-9, F.col(f"n{i}") / F.col(f"d{i}")).alias("lift"),
            F.col(f"d{i}").alias("mass"),
            F.col(f"c{i}").alias("n_mates"),
        )
        for i in range(k)
    ])
    return sums.select(F.col("focal").alias("member"), "season", "own_rating", F.explode(cells).alias("c")).select(
        "member", "season", "own_rating", "c.*")


def ranked_partners(edges: DataFrame, recipes: DataFrame, top_n: int) -> DataFrame:
    """The n partners with most shared weight of those with a recipe, the lower id first, with ``rank``."""
    return relational.top_per_group(
        mate_mixtures(edges, recipes).where(F.col("mate_recipe").isNotNull()),
        ["season", "focal"], [F.col("min").desc(), F.col("mate")], top_n)


def micro_profile(edges: DataFrame, recipes: DataFrame, totals: DataFrame, k: int, top_n: int = 3, top_m: int = 2,
                  ranked: DataFrame | None = None) -> DataFrame:
    """The n partners with most shared weight, their share of the member's weight, their top components.

    ``ranked``: the rows of ``ranked_partners``, if they are at hand.
    """
    ranked = ranked_partners(edges, recipes, top_n) if ranked is None else ranked
    own = totals.select(F.col("member").alias("focal"), "season", F.col("min").alias("own_min"))
    return ranked.join(own, ["focal", "season"], "left").select(
        F.col("focal").alias("member"), "season", "rank", "mate", "min",
        F.try_divide(F.col("min"), F.col("own_min")).alias("share_of_min"), "net_rating",
        vec.top_components("mate_recipe", k, top_m).alias("top"),
    )


def strongest_partner(edges: DataFrame) -> DataFrame:
    """Partner with the largest shared weight (T5); the lower id wins ties."""
    best = F.max_by(F.struct("mate", "min"), F.struct(F.col("min"), -F.col("mate")))
    return edges.groupBy("season", "focal").agg(best.alias("b")).select(
        F.col("focal").alias("member"), "season", F.col("b.mate").alias("partner"), F.col("b.min").alias("partner_min"))


def comparables(recipes: DataFrame, oncourt: DataFrame, component: int, threshold: float = 0.55, top_n: int = 20) -> DataFrame:
    """Members of a season with a high share of one component: best n by share, then only positive ratings."""
    r = recipes.select("member", "season", F.col("recipe")[component].alias("share")).where(F.col("share") >= threshold)
    top = relational.top_per_group(r, ["season"], [F.col("share").desc(), F.col("member")], top_n)
    return top.join(oncourt.select("member", "season", "net_rating"), ["member", "season"], "left").where(
        F.col("net_rating") > 0)


def all_comparables(recipes: DataFrame, oncourt: DataFrame, k: int, threshold: float, top_n: int) -> DataFrame:
    """``comparables`` for every component at once."""
    r = recipes.select("member", "season", F.posexplode("recipe").alias("component", "share")).where(
        F.col("share") >= threshold)
    top = relational.top_per_group(r, ["season", "component"], [F.col("share").desc(), F.col("member")], top_n)
    return top.join(oncourt.select("member", "season", "net_rating"), ["member", "season"], "left").where(
        F.col("net_rating") > 0)


def comparables_exposure(comps: DataFrame, exposures: DataFrame, k: int) -> DataFrame:
    """Plain mean exposure of the comparables."""
    j = comps.join(exposures.select("member", "season", "exposure"), ["member", "season"])
    return j.groupBy("season", "component").agg(
        F.count(F.lit(1)).alias("n"), *[F.avg(F.col("exposure")[i]).alias(f"e{i}") for i in range(k)])


def similar_members(recipes: DataFrame, k: int, top_n: int, blocks: int | None = None) -> DataFrame:
    """The n most similar other members of the season (T2, X16); an undefined distance counts as 1."""
    near = pairwise.nearest(
        recipes.select("member", "season", "recipe"), recipes, keys=["season"], target_id="member", pool_id="member",
        vector="recipe", k=k, top_n=top_n, undefined_distance=1.0, blocks=blocks,
    )
    return near.select("member", "season", "rank", "neighbor", (F.lit(1.0) - F.col("distance")).alias("similarity"))


def similar_to_vector(recipes: DataFrame, target: list[float], k: int, top_n: int) -> DataFrame:
    """The n members of each season nearest to one given mixture."""
    t = F.array(*[F.lit(float(x)) for x in target])
    scored = recipes.select("member", "season", vec.js_similarity("recipe", t, k).alias("similarity"))
    return relational.top_per_group(scored, ["season"], [F.round("similarity", 12).desc(), F.col("member")], top_n)


def team_profile(recipes: DataFrame, identity: DataFrame, k: int) -> DataFrame:
    """Per team and season: soft sum, soft mean and hard count of each component."""
    r = recipes.join(identity.select("member", "team"), "member").withColumn("top", vec.argmax("recipe"))
    sums = r.groupBy("team", "season").agg(
        F.count(F.lit(1)).alias("n_members"),
        *[F.sum(F.col("recipe")[i]).alias(f"s{i}") for i in range(k)],
        *[F.count_if(F.col("top") == i).alias(f"h{i}") for i in range(k)],
    )
    cells = F.array(*[
        F.struct(F.lit(i).alias("component"), F.col(f"s{i}").alias("soft_sum"),
                 (F.col(f"s{i}") / F.col("n_members")).alias("soft_mean"), F.col(f"h{i}").alias("hard_count"))
        for i in range(k)
    ])
    return sums.select("team", "season", "n_members", F.explode(cells).alias("c")).select(
        "team", "season", "n_members", "c.*")


def league_baseline(profile: DataFrame) -> DataFrame:
    """Mean and population sd of the team means, per component (A10)."""
    return profile.groupBy("season", "component").agg(
        F.avg("soft_mean").alias("league_mean"), F.stddev_pop("soft_mean").alias("league_sd"),
        F.count(F.lit(1)).alias("n_teams"))


def team_gaps(profile: DataFrame, baseline: DataFrame, z_cut: float = 1.0) -> DataFrame:
    """Team mean against the league: gap, redundancy or typical."""
    j = profile.join(baseline, ["season", "component"])
    z = F.try_divide(F.col("soft_mean") - F.col("league_mean"), F.col("league_sd"))
    return j.withColumn("z", z).withColumn(
        "status", F.when(z <= -z_cut, "gap").when(z >= z_cut, "redundancy").otherwise("typical"))


def gap_summary(mis: DataFrame, identity: DataFrame, k: int) -> DataFrame:
    """Per team and component: members short of, and over, their benchmark, and the signed sum."""
    rows = long_components(mis.join(identity.select("member", "team"), "member"), {"d": "diff"}, ["team", "season"])
    return rows.groupBy("team", "season", "component").agg(
        F.count_if(F.col("d") < 0).alias("n_short"), F.count_if(F.col("d") > 0).alias("n_over"),
        F.sum("d").alias("total_gap"))


def roster_conflicts(mis: DataFrame, roster: DataFrame, k: int) -> DataFrame:
    """Cosine of the difference vectors for the members of each roster.

    ``roster``: team, season, slot, member, with at most a roster's worth of
    slots, so the pairs per team are bounded by the roster size.
    """
    d = mis.select("member", "season", "diff")
    slots = roster.join(d, ["member", "season"])
    a = slots.select("team", "season", F.col("slot").alias("sa"), F.col("member").alias("a"), F.col("diff").alias("da"))
    b = slots.select("team", "season", F.col("slot").alias("sb"), F.col("member").alias("b"), F.col("diff").alias("db"))
    return a.join(b, ["team", "season"]).where(F.col("sa") < F.col("sb")).select(
        "team", "season", "a", "b", vec.cosine_or_zero("da", "db", k).alias("cosine"))


def agreement(mis: DataFrame, lifts: DataFrame, mass_floor: float = 100.0, flat_range: float = 2.0, top_n: int = 3) -> DataFrame:
    """Do deficit and lift point the same way: insufficient, flat, agree or disagree."""
    d = mis.select("member", "season", vec.argmin("diff").alias("deficit"), F.array_min("diff").alias("deficit_value"))
    l = lifts.withColumn("supported", (F.col("mass") >= mass_floor) & F.col("lift").isNotNull())
    w = Window.partitionBy("member", "season").orderBy(F.col("supported").desc(), F.col("lift").desc(), "component")
    l = l.withColumn("lift_rank", F.row_number().over(w))  # k rows per member
    j = l.join(d, ["member", "season"])
    agg = j.groupBy("member", "season").agg(
        F.max("deficit").alias("deficit"), F.max("deficit_value").alias("deficit_value"),
        F.count_if(F.col("supported")).alias("n_supported"),
        (F.max(F.when(F.col("supported"), F.col("lift"))) - F.min(F.when(F.col("supported"), F.col("lift")))).alias("lift_range"),
        F.coalesce(F.bool_or(F.col("supported") & (F.col("component") == F.col("deficit")) & (F.col("lift_rank") <= top_n)),
                   F.lit(False)).alias("deficit_in_top"),
    )
    return agg.withColumn(
        "verdict",
        F.when(F.col("n_supported") == 0, "insufficient")
        .when(F.col("lift_range") < flat_range, "flat")
        .when(F.col("deficit_in_top"), "agree")
        .otherwise("disagree"),
    )


def environment_difference(bench: DataFrame, k: int) -> DataFrame:
    """Environment of positively rated similar members minus that of all, ranked."""
    rows = long_components(bench.where(F.col("expected_positive").isNotNull()),
                           {"all_mean": "expected", "positive_mean": "expected_positive"}, ["member", "season"])
    rows = rows.withColumn("difference", F.col("positive_mean") - F.col("all_mean"))
    w = Window.partitionBy("member", "season").orderBy(F.col("difference").desc(), "component")
    return rows.withColumn("rank", F.row_number().over(w))


def group_lookup(sets: DataFrame, lineups: DataFrame) -> DataFrame:
    """Exact, order-free match of member sets to group rows (J8). ``sets``: season, ids."""
    return sets.withColumn("ids", F.array_sort("ids")).join(lineups, ["season", "ids"], "left")


def group_performance(edges: DataFrame, recipes: DataFrame, lineups: DataFrame, top_n: int = 3, ranked: DataFrame | None = None) -> DataFrame:
    """Two- and three-member sets of a member with its top partners, looked up exactly."""
    ranked = ranked_partners(edges, recipes, top_n) if ranked is None else ranked
    mates = ranked.groupBy("season", "focal").agg(F.array_sort(F.collect_list(F.struct("rank", "mate"))).alias("m"))
    combos: list[Column] = [F.array(F.col("focal"), F.col("m")[i]["mate"]) for i in range(top_n)]
    combos += [F.array(F.col("focal"), F.col("m")[i]["mate"], F.col("m")[j]["mate"])
               for i in range(top_n) for j in range(i + 1, top_n)]
    sets = mates.withColumn("m", F.concat(F.col("m"), F.array_repeat(F.lit(None).cast(
        mates.schema["m"].dataType.elementType), top_n))).select(
        "season", "focal", F.explode(F.array(*combos)).alias("ids"))
    sets = sets.where(~F.exists("ids", lambda x: x.isNull()))
    return group_lookup(sets, lineups).where(F.col("min").isNotNull())


def hypothesis_gap(bench: DataFrame, profile: DataFrame, k: int) -> DataFrame:
    """Benchmark of hypothetical mixtures against each team's own mean, with the largest gap.

    ``bench``: rows of hypothetical targets (member = variant id).
    """
    b = long_components(bench, {"expected": "expected"}, ["member", "season"])
    j = b.withColumnRenamed("member", "variant").join(profile, ["season", "component"])
    j = j.withColumn("gap", F.col("expected") - F.col("soft_mean"))
    return j.groupBy("variant", "team", "season").agg(
        F.max_by("component", F.struct(F.col("gap"), -F.col("component"))).alias("top_gap"),
        F.max("gap").alias("gap"))


def hypothesis_stability(gaps: DataFrame) -> DataFrame:
    """Distinct leading gaps over the variants of a hypothesis."""
    return gaps.groupBy("team", "season").agg(
        F.count(F.lit(1)).alias("n_variants"), F.count_distinct("top_gap").alias("n_top_gaps"),
        F.min("gap").alias("min_gap"), F.max("gap").alias("max_gap"),
    ).withColumn("stable", F.col("n_top_gaps") == 1)


def case_studies(recipes: DataFrame, exposure: DataFrame, partners: DataFrame, groups: DataFrame, comparables: DataFrame, comparison: DataFrame, k: int) -> DataFrame:
    """The case study of every member and season as one nested record (X19); one member is a filter on it.

    ``partners`` come from ``micro_profile``, ``groups`` from ``group_performance``, ``comparables`` from
    ``comparables_exposure`` and ``comparison`` from ``compare``. Members without partners, groups or comparables have
    nulls there. The tables lie by member and season, so the joins share one partitioning; comparables have one row
    per season and component.
    """
    keys = ["member", "season"]
    first = partners.where(F.col("rank") == 1).select(*keys, F.struct("mate", "min").alias("partner"))
    played = groups.groupBy(F.col("focal").alias("member"), "season").agg(
        F.struct(F.count(F.lit(1)).alias("n"), F.max_by("ids", F.struct("net_rating", "ids")).alias("best"), F.max("net_rating").alias("net_rating")).alias("groups"))
    gap = comparison.where(F.col("rank") == 1).select(*keys, F.struct("component", "actual", "baseline", "diff_pp").alias("gap"))
    peers = comparables.select("season", F.col("component").alias("top"), F.struct("n", F.array(*[F.col(f"e{i}") for i in range(k)]).alias("exposure")).alias("comparables"))
    return (
        recipes.select(*keys, vec.argmax("recipe").alias("top")).join(exposure.select(*keys, F.struct("exposure", "mate_min", "n_mates").alias("environment")), keys)
        .join(first, keys, "left").join(played, keys, "left").join(gap, keys, "left").join(peers, ["season", "top"], "left")
    )
