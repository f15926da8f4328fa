"""Binding of an order warehouse to the member / period / group tables.

member = supplier, period = season of the ship date, weight = quantity,
recipe = revenue shares over the part types, group = distinct suppliers of an
order, team = nation, stint = one side of an order, event = one order line.
Every plan takes tables of this shape with column names as listed here; other
data needs only another module like this one.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from blendscope.functions import text as tx
from blendscope.operators import stats
from blendscope.session import cut_lineage

# Part types in the order of the recipe vector.
TYPES = ("ECONOMY", "LARGE", "MEDIUM", "PROMO", "SMALL", "STANDARD")
K = len(TYPES)
# Members of a squad: consecutive ids, the last squad may be shorter.
SQUAD = 12


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


def season_of(ts):
    return tx.season_label(F.year(ts))


def _revenue():
    return F.col("l_extendedprice") * (F.lit(1.0) - F.col("l_discount"))


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per order line: member, season, order, quantity, revenue, outcome flag."""
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_suppkey").alias("member"),
        season_of("l_shipdate").alias("season"),
        F.col("l_orderkey").alias("game"),
        F.col("l_partkey").alias("part"),
        F.col("l_linenumber").alias("line_no"),
        F.col("l_quantity").alias("qty"),
        F.col("l_extendedprice").alias("price"),
        F.col("l_discount").alias("discount"),
        F.col("l_tax").alias("tax"),
        F.col("l_returnflag").alias("flag"),
        F.col("l_linestatus").alias("status"),
        F.col("l_shipdate").alias("ship"),
        _revenue().alias("rev"),
    )


def typed_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("part"), "p_type", "p_size", "p_retailprice")
    return lines(spark, sf_dir).join(part, "part")


def members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Member identity: name, team, balance."""
    s = table(spark, sf_dir, "supplier")
    n = table(spark, sf_dir, "nation")
    return s.join(n, s.s_nationkey == n.n_nationkey).select(
        F.col("s_suppkey").alias("member"),
        F.translate("s_name", "#0123456789", " abcdefghij").alias("name"),
        F.col("n_name").alias("team"),
        F.col("s_nationkey").alias("team_id"),
        F.col("s_acctbal").alias("balance"),
    )


def squads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """member, team: squads of a size that allows all their combinations, at every scale."""
    squad = F.concat(F.lit("squad "), F.floor(F.col("s_suppkey") / SQUAD).cast("string"))
    return table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("member"), squad.alias("team"))


def member_count(spark: SparkSession, sf_dir: str) -> int:
    """Row count from the file footers, used to size the blocks of all-pairs jobs."""
    return table(spark, sf_dir, "supplier").count()


def recipes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """member, season, min, recipe: revenue shares over the part types."""
    t = typed_lines(spark, sf_dir)
    sums = t.groupBy("member", "season").agg(
        F.sum("qty").alias("min"),
        *[F.sum(F.when(F.col("p_type") == v, F.col("rev")).otherwise(0.0)).alias(f"r{i}") for i, v in enumerate(TYPES)],
    )
    whole = sum((F.col(f"r{i}") for i in range(1, K)), F.col("r0"))
    return sums.select("member", "season", "min", F.array(*[F.col(f"r{i}") / whole for i in range(K)]).alias("recipe"))


def recipes_with_identity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return recipes(spark, sf_dir).join(members(spark, sf_dir), "member")


def _rates(off, dfn, base):
    off_rating = 100.0 * stats.ratio(off, base)
    def_rating = 100.0 * stats.ratio(dfn, base)
    return [off_rating.alias("off_rating"), def_rating.alias("def_rating"), (off_rating - def_rating).alias("net_rating")]


def oncourt(spark: SparkSession, sf_dir: str) -> DataFrame:
    """member, season, off / def / net rating over all own lines."""
    agg = lines(spark, sf_dir).groupBy("member", "season").agg(
        F.sum("rev").alias("rev"),
        F.sum(F.when(F.col("flag") == "A", F.col("rev")).otherwise(0.0)).alias("rev_for"),
        F.sum(F.when(F.col("flag") == "R", F.col("rev")).otherwise(0.0)).alias("rev_against"),
    )
    return agg.select("member", "season", *_rates("rev_for", "rev_against", "rev"))


def _group_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines(spark, sf_dir).groupBy("game", "member").agg(
        F.sum("qty").alias("qty"),
        F.sum("rev").alias("rev"),
        F.sum(F.when(F.col("flag") == "A", F.col("rev")).otherwise(0.0)).alias("rev_for"),
        F.sum(F.when(F.col("flag") == "R", F.col("rev")).otherwise(0.0)).alias("rev_against"),
        F.max("ship").alias("ship"),
        F.count(F.lit(1)).alias("n_lines"),
    )


def lineups(spark: SparkSession, sf_dir: str, least: int = 2) -> DataFrame:
    """season, ids (sorted array), size, min, ratings, pace, shares; one row per set and season, sets of any size.

    A single member is no set. An array is as long as its order has members.
    """
    gm = _group_members(spark, sf_dir)
    sized = gm.groupBy("game").agg(F.count(F.lit(1)).alias("size"), F.max("ship").alias("last_ship")).where(
        F.col("size") >= least
    )
    per_game = (
        gm.join(sized, "game")
        .groupBy("game")
        .agg(
            F.array_sort(F.collect_list("member")).alias("ids"),
            F.max("last_ship").alias("ship"),
            *[F.sum(c).alias(c) for c in ("qty", "rev", "rev_for", "rev_against", "n_lines")],
        )
    )
    return (
        per_game.groupBy(season_of("ship").alias("season"), "ids")
        .agg(*[F.sum(c).alias(c) for c in ("qty", "rev", "rev_for", "rev_against", "n_lines")])
        .select(
            "season", "ids", F.size("ids").alias("size"), F.col("qty").alias("min"),
            *_rates("rev_for", "rev_against", "rev"),
            (F.col("n_lines") * 100.0 / F.col("qty")).alias("pace"),
        )
    )


def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """season, a, b (a<b), min, ratings: all pairs of members of one order, one row per pair and season.

    An order has a handful of members; its pairs are formed inside its own array and summed before the next shuffle.
    """
    measures = ("qty", "rev", "rev_for", "rev_against")
    game = _group_members(spark, sf_dir).groupBy("game").agg(
        F.array_sort(F.collect_list(F.struct("member", *measures))).alias("m"), F.max("ship").alias("ship"))
    two = F.flatten(F.transform("m", lambda x, i: F.transform(
        F.slice("m", i + 2, F.size("m")),
        lambda y: F.struct(x["member"].alias("a"), y["member"].alias("b"), *[(x[c] + y[c]).alias(c) for c in measures]))))
    return (
        game.select(season_of("ship").alias("season"), F.explode(two).alias("p")).select("season", "p.*")
        .groupBy("season", "a", "b").agg(*[F.sum(c).alias(c) for c in measures])
        .select("season", "a", "b", F.col("qty").alias("min"), *_rates("rev_for", "rev_against", "rev"))
    )


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Directed pairs: season, focal, mate, min, net_rating."""
    from blendscope.plans.environment import directed_edges

    return directed_edges(pairs(spark, sf_dir))


def stints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Directed segments: one row per order and offense side (line status O or F).

    A side has all members of its order lines, however many.
    """
    li = lines(spark, sf_dir).withColumn("three", F.col("discount") >= 0.05)
    sm = li.groupBy("game", "status", "member").agg(
        F.sum("qty").alias("poss"),
        F.sum(F.floor(F.col("rev") / 1000.0)).alias("points"),
        F.count_if(F.col("flag") != "R").alias("fga"),
        F.count_if(F.col("flag") == "A").alias("fgm"),
        F.count_if((F.col("flag") != "R") & F.col("three")).alias("fg3a"),
        F.count_if((F.col("flag") == "A") & F.col("three")).alias("fg3m"),
        F.count_if(F.col("flag") == "R").alias("tov"),
        F.max("ship").alias("ship"),
    )
    measures = ("poss", "points", "fga", "fgm", "fg3a", "fg3m", "tov")
    side = (
        sm.groupBy("game", "status")
        .agg(
            F.array_sort(F.collect_list("member")).alias("ids"), F.max("ship").alias("ship"),
            *[F.sum(c).alias(c) for c in measures],
        )
    )
    # both sides of a game in one aggregate; a game without two sides drops out
    whole = F.struct("ids", "ship", *measures)
    both = side.groupBy("game").agg(
        F.max(F.when(F.col("status") == "O", whole)).alias("h"), F.max(F.when(F.col("status") == "F", whole)).alias("a"),
    ).where(F.col("h").isNotNull() & F.col("a").isNotNull())

    def directed(off: str, dfn: str, is_home: int):
        return F.struct(
            F.lit(is_home).alias("home_off"),
            F.col(f"{off}.ids").alias("off"), F.col(f"{dfn}.ids").alias("def"),
            F.col(f"{off}.poss").alias("off_possessions"), F.col(f"{off}.points").alias("off_points"),
            *[F.col(f"{off}.{c}").alias(f"off_{c}") for c in ("fga", "fgm", "fg3a", "fg3m", "tov")],
        )

    rows = both.select(
        "game", season_of(F.greatest("h.ship", "a.ship")).alias("season"),
        F.explode(F.array(directed("h", "a", 1), directed("a", "h", 0))).alias("s"),
    ).select("game", "season", F.lit(1).alias("stint"), "s.*")
    return rows.withColumn("y_off", 100.0 * F.col("off_points") / F.col("off_possessions"))


def stint_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of a segment side: game, side (1 = home), person, action, shot distance and value, assist.

    The assisting member is the other member of the side with the lowest id, on made shots.
    """
    li = lines(spark, sf_dir)
    first = li.groupBy("game", "status").agg(F.min("member").alias("first_member"))
    ev = li.join(first, ["game", "status"])
    made = F.col("flag") == "A"
    free = F.col("line_no") == 7
    return ev.select(
        "game", "season", F.lit(1).alias("stint"),
        F.when(F.col("status") == "O", 1).otherwise(0).alias("side"),
        F.col("member").alias("person"),
        F.when(F.col("flag") == "R", "Turnover").when(free, "Free Throw").when(made, "Made Shot")
        .otherwise("Missed Shot").alias("action_type"),
        F.when((F.col("flag") != "R") & ~free, F.round(F.col("tax") * 100)).alias("shot_distance"),
        F.when((F.col("flag") != "R") & ~free, F.when(F.col("discount") >= 0.05, 3).otherwise(2)).alias("shot_value"),
        F.when(F.col("flag") != "R", made).alias("made"),
        F.when(made & ~free & (F.col("first_member") != F.col("member")), F.col("first_member")).alias("assist"),
    )


def bio(spark: SparkSession, sf_dir: str) -> DataFrame:
    """member, season, age, draft year and number (text, as delivered), height."""
    m = members(spark, sf_dir)
    seasons = recipes(spark, sf_dir).select("member", "season")
    year = tx.season_start_year("season")
    pick = F.greatest(F.lit(1), F.ceil((F.lit(10000.0) - F.col("balance")) / 11000.0 * 60)).cast("int")
    debut_year = F.lit(1995) + F.pmod(F.col("team_id"), F.lit(7))
    return seasons.join(m, "member").select(
        "member", "season", "name", "team",
        (F.lit(19) + F.floor((F.col("balance") + 1000.0) / 1000.0) + year - 1995).cast("int").alias("age"),
        F.when(F.col("balance") < 0, "Undrafted").otherwise(debut_year.cast("string")).alias("draft_year"),
        F.when(F.col("balance") < 0, "Undrafted").otherwise(pick.cast("string")).alias("draft_number"),
    )


# The feature columns of the bound member-period table, in basis order.
FEATURES = (
    "pts_per_100", "height", "ts", "usg", "ast", "tov", "stl", "blk", "trb", "ftr", "bpm", "dist",
    "near", "far", *[f"playtype_{t.lower()}" for t in TYPES],
)


def line_sums(spark: SparkSession, sf_dir: str) -> DataFrame:
    """member, season, status: the sums and counts of lines that every rate of the feature table follows from.

    One pass and one join with the parts; a rate of any coarser group is a ratio of sums of these (``_mean``).
    """
    li = typed_lines(spark, sf_dir)
    is_a, is_r = F.col("flag") == "A", F.col("flag") == "R"
    measured = {
        "size": F.col("p_size"), "discount": F.col("discount"), "qty": F.col("qty"), "line_no": F.col("line_no"), "tax": F.col("tax"),
        "unit": F.col("price") / F.col("qty"), "retail": F.col("p_retailprice"), "is_a": is_a, "is_r": is_r, "is_f": F.col("status") == "F",
        "near": F.col("discount") <= 0.03, "far": F.when(is_a, F.col("discount") >= 0.08),
    }
    return li.groupBy("member", "season", "status").agg(
        F.count(F.lit(1)).alias("n"), F.sum("rev").alias("rev"),
        F.sum(F.when(is_a, F.col("rev")).otherwise(0.0)).alias("rev_for"), F.sum(F.when(is_r, F.col("rev")).otherwise(0.0)).alias("rev_against"),
        *[F.sum(c.cast("double")).alias(f"{name}_sum") for name, c in measured.items()],
        *[F.count(c).alias(f"{name}_n") for name, c in measured.items()],
        *[F.sum(F.when(F.lower("p_type") == t.lower(), F.col("rev"))).alias(f"rev_{i}") for i, t in enumerate(TYPES)],
    )


def _mean(name: str):
    return stats.ratio(f"{name}_sum", f"{name}_n")


def feature_sources(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """The six source tables of the feature build (F1), all from one pass over the lines."""
    sums = cut_lineage(line_sums(spark, sf_dir))  # a few rows per member and season
    kept = [c for c in sums.columns if c not in ("member", "season", "status")]
    whole = sums.groupBy("member", "season").agg(*[F.sum(c).alias(c) for c in kept])
    m = members(spark, sf_dir)
    tot = whole.select("member", "season", F.col("qty_sum").alias("min"), F.col("rev").alias("pts"))
    base = tot.join(m, "member").select("member", "name", "team", "season", "min", "pts")
    advanced = whole.select("member", "season", F.col("n").alias("poss"))
    sizes = whole.select("member", "season", _mean("size").alias("height"))
    # one row per line status plus a combined row, names written differently
    per_status = sums.select("member", "season", F.col("status").alias("bref_team"), *_style())
    combined = whole.select("member", "season", F.lit("2TM").alias("bref_team"), *_style())
    spelled = F.concat(F.upper(F.translate("name", "ue", "üé")), F.lit(" Jr."))
    bref = per_status.unionByName(combined).join(m.select("member", "name"), "member").select(
        spelled.alias("player"), F.col("bref_team").alias("team"), "season",
        "ts", "usg", "ast", "tov", "stl", "blk", "trb", "ftr", "bpm", "mp",
    )
    shooting = whole.select(
        "member", "season", _mean("tax").alias("dist"), _mean("near").alias("near"), _mean("far").alias("far"),
    ).join(m.select("member", "name"), "member").select(
        F.upper("name").alias("player"), F.lit("TOT").alias("team"), "season", "dist", "near", "far")
    shares = F.array(*[F.struct(F.lit(t.lower()).alias("play_type"), stats.ratio(f"rev_{i}", "rev").alias("poss_pct")) for i, t in enumerate(TYPES)])
    share = whole.select("member", "season", F.explode(shares).alias("s")).select("member", "season", "s.*").where(F.col("poss_pct").isNotNull())
    return {"base": base, "advanced": advanced, "bio": sizes, "bref": bref, "shooting": shooting, "playtype": share}


def _style():
    return [
        _mean("discount").alias("ts"), _mean("qty").alias("usg"), _mean("is_a").alias("ast"), _mean("is_r").alias("tov"),
        _mean("line_no").alias("stl"), _mean("is_f").alias("blk"), _mean("unit").alias("trb"), _mean("retail").alias("ftr"),
        (100.0 * stats.ratio(F.col("rev_for") - F.col("rev_against"), "rev")).alias("bpm"),
        F.col("qty_sum").alias("mp"),
    ]


def lead_season(df: DataFrame, *columns: str) -> DataFrame:
    """Next present season of a member; a member has a bounded number of seasons."""
    w = Window.partitionBy("member").orderBy("season")
    return df.select("*", *[F.lead(c).over(w).alias(f"next_{c}") for c in columns])


def outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """member, season, mp, obpm, dbpm: weight and two outcome rates per member and season."""
    r = oncourt(spark, sf_dir)
    mp = recipes(spark, sf_dir).select("member", "season", F.col("min").alias("mp"))
    return r.join(mp, ["member", "season"]).select(
        "member", "season", "mp", (F.col("off_rating") / 10.0 - 3.3).alias("obpm"), (3.3 - F.col("def_rating") / 10.0).alias("dbpm"))


def talent(spark: SparkSession, sf_dir: str) -> DataFrame:
    """member, season, bpm."""
    return outcomes(spark, sf_dir).select("member", "season", (F.col("obpm") + F.col("dbpm")).alias("bpm"))


def skill_by_season(spark: SparkSession, sf_dir: str) -> DataFrame:
    """member, season, skill_off, skill_def: shrunk rates of the season before."""
    from blendscope.plans.linear import veteran_skill

    shifted = outcomes(spark, sf_dir).withColumn("season", tx.season_label(tx.season_start_year("season") + 1))
    return veteran_skill(shifted, keys=["season"])


def stints_with_teams(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Segments with the team of the first member of each side."""
    m = members(spark, sf_dir)
    off = m.select(F.col("member").alias("_o"), F.col("team").alias("offense_team"))
    dfn = m.select(F.col("member").alias("_d"), F.col("team").alias("defense_team"))
    s = stints(spark, sf_dir).withColumn("_o", F.col("off")[0]).withColumn("_d", F.col("def")[0])
    return s.join(off, "_o").join(dfn, "_d").drop("_o", "_d")
