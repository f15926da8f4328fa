"""Queries on skill priors, designs and weighted models (2.15)."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from blendscope import warehouse as wh
from blendscope.operators import gram, relational, stats
from blendscope.plans import linear as ln
from blendscope.session import cut_lineage, kept
from blendscope.suite import query, r6, s6
from blendscope.suite import sqlbase as sb
from blendscope.suite.identity import _BIO

K = wh.K

OUT_SQL = sb.ONCOURT + """,
outcomes AS (SELECT o.member, o.season, x.min AS mp, o.off_rating / 10.0 - 3.3 AS obpm, 3.3 - o.def_rating / 10.0 AS dbpm
  FROM oncourt o JOIN mix x USING (member, season))"""
_NEXT = "(split_part({0}, '-', 1)::INT + 1)::VARCHAR || '-' || lpad(((split_part({0}, '-', 1)::INT + 2) % 100)::VARCHAR, 2, '0')"
SKILL_SQL = f"""shifted AS (SELECT member, {_NEXT.format('season')} AS season, mp, obpm, dbpm FROM outcomes),
lg AS (SELECT season, sum(mp * obpm) / sum(mp) AS mo, sum(mp * dbpm) / sum(mp) AS md FROM shifted GROUP BY season),
skill AS (SELECT s.member, s.season, mp / (mp + 500) * obpm + (1 - mp / (mp + 500)) * mo AS skill_off,
  mp / (mp + 500) * dbpm + (1 - mp / (mp + 500)) * md AS skill_def FROM shifted s JOIN lg ON lg.season = s.season)"""
_BASE = [sb.LINES, sb.MIX, OUT_SQL]


@query("veteran_skill", sb.with_(*_BASE, SKILL_SQL) + f"SELECT member, season, {s6('skill_off')} AS skill_off, {s6('skill_def')} AS skill_def FROM skill")
def veteran_skill(spark, sf):
    """R1 A5."""
    return wh.skill_by_season(spark, sf).select("member", "season", r6("skill_off"), r6("skill_def"))


_ROOK = """rook AS (SELECT b.member, b.season, try_cast(draft_number AS INT) AS pick, mp, obpm, dbpm FROM bio b JOIN outcomes USING (member, season)
 WHERE try_cast(draft_year AS INT) = split_part(season, '-', 1)::INT AND try_cast(draft_number AS INT) IS NOT NULL AND season <> '2001-02')"""


def _fit_sql(y: str) -> str:
    b = f"((sw * sxy_{y} - sx * sy_{y}) / (sw * sxx - sx * sx))"
    a = f"((sy_{y} - {b} * sx) / sw)"
    res = f"(syy_{y} - 2 * {a} * sy_{y} - 2 * {b} * sxy_{y} + {a} * {a} * sw + 2 * {a} * {b} * sx + {b} * {b} * sxx)"
    return (f"{s6(a)} AS a_{y}, {s6(b)} AS b_{y}, {s6(f'1 - {res} / (syy_{y} - sy_{y} * sy_{y} / sw)')} AS r2_{y}")


_CURVE_SUMS = """cs AS (SELECT count(*) AS n, sum(mp) AS sw, sum(mp * ln(pick)) AS sx, sum(mp * ln(pick) * ln(pick)) AS sxx,
 sum(mp * obpm) AS sy_obpm, sum(mp * ln(pick) * obpm) AS sxy_obpm, sum(mp * obpm * obpm) AS syy_obpm,
 sum(mp * dbpm) AS sy_dbpm, sum(mp * ln(pick) * dbpm) AS sxy_dbpm, sum(mp * dbpm * dbpm) AS syy_dbpm FROM rook)"""
_CURVESQL = [*_BASE, sb.MEMBERS, _BIO, _ROOK, _CURVE_SUMS]


def _rookies(spark, sf):
    return ln.rookie_seasons(wh.bio(spark, sf).select("member", "season", "draft_year", "draft_number"), wh.outcomes(spark, sf), ["2001-02"])


@query("draft_curve", sb.with_(*_CURVESQL) + f"SELECT n, {_fit_sql('obpm')}, {_fit_sql('dbpm')} FROM cs")
def draft_curve(spark, sf):
    """R2 R3 S19."""
    return ln.draft_curve(_rookies(spark, sf)).select(
        "n", *[r6(f"{s}_{y}") for y in ("obpm", "dbpm") for s in ("a", "b", "r2")])


_REPL = """deb AS (SELECT member, min(season) AS season FROM outcomes WHERE member IN (SELECT member FROM bio WHERE draft_year = 'Undrafted') GROUP BY member),
repl AS (SELECT count(*) AS n, sum(mp * obpm) / sum(mp) AS skill_off, sum(mp * dbpm) / sum(mp) AS skill_def FROM outcomes JOIN deb USING (member, season) WHERE season <> '2001-02')"""


@query("replacement_level", sb.with_(*_BASE, sb.MEMBERS, _BIO, _REPL) + f"SELECT n, {s6('skill_off')} AS skill_off, {s6('skill_def')} AS skill_def FROM repl")
def replacement_level(spark, sf):
    """R4 J16."""
    return ln.replacement_level(wh.bio(spark, sf), wh.outcomes(spark, sf), ["2001-02"]).select("n", r6("skill_off"), r6("skill_def"))


@query("skill_three_tiers", sb.with_(*_CURVESQL, _REPL) + f""",
coef AS (SELECT (sw * sxy_obpm - sx * sy_obpm) / (sw * sxx - sx * sx) AS bo, (sw * sxy_dbpm - sx * sy_dbpm) / (sw * sxx - sx * sx) AS bd, * FROM cs),
vet0 AS (SELECT * FROM outcomes WHERE season = '2000-01' AND mp >= 2200),
vet AS (SELECT member, mp / (mp + 500) * obpm + (1 - mp / (mp + 500)) * (SELECT sum(mp * obpm) / sum(mp) FROM vet0) AS so,
  mp / (mp + 500) * dbpm + (1 - mp / (mp + 500)) * (SELECT sum(mp * dbpm) / sum(mp) FROM vet0) AS sd FROM vet0),
ids AS (SELECT DISTINCT member FROM lines WHERE season = '2001-02'),
d AS (SELECT member, try_cast(max(draft_number) AS INT) AS pick FROM bio GROUP BY member),
j AS (SELECT i.member, v.so, v.sd, d.pick, (c.sy_obpm - bo * sx) / sw + bo * ln(pick) AS po, (c.sy_dbpm - bd * sx) / sw + bd * ln(pick) AS pd,
  r.skill_off AS ro, r.skill_def AS rd FROM ids i LEFT JOIN vet v USING (member) LEFT JOIN d USING (member) CROSS JOIN coef c CROSS JOIN repl r)
SELECT member, {s6('coalesce(so, po, ro)')} AS skill_off, {s6('coalesce(sd, pd, rd)')} AS skill_def,
 CASE WHEN so IS NOT NULL THEN 'prior_season' WHEN pick IS NOT NULL THEN 'draft_prior' ELSE 'replacement' END AS source FROM j""")
def skill_three_tiers(spark, sf):
    """Veteran value where there is enough prior weight, draft curve, replacement level."""
    out = wh.outcomes(spark, sf)
    bio = wh.bio(spark, sf)
    vet = ln.veteran_skill(out.where((F.col("season") == "2000-01") & (F.col("mp") >= 2200)))
    ids = wh.lines(spark, sf).where(F.col("season") == "2001-02").select("member").distinct()
    per = bio.groupBy("member").agg(F.max("draft_number").alias("draft_number"))
    t = ln.skill_table(ids, vet, per, ln.draft_curve(_rookies(spark, sf)), ln.replacement_level(bio, out, ["2001-02"]))
    return t.select("member", r6("skill_off"), r6("skill_def"), "source")


@query("prior_season_by_name", sb.with_(*_BASE) + f"SELECT member, {s6('obpm')} AS skill_off, {s6('dbpm')} AS skill_def FROM outcomes WHERE season = '2000-01'")
def prior_season_by_name(spark, sf):
    """Prior-season values through differently spelled names."""
    m = wh.members(spark, sf).select("member", "name")
    out = wh.outcomes(spark, sf).join(m, "member")
    spelled = F.concat(F.upper(F.translate("name", "ue", "üé")), F.lit(" Jr."))
    prior = out.select(spelled.alias("player"), F.lit("TOT").alias("team"), "season", "obpm", "dbpm")
    return ln.prior_season_skill(prior, out, "2000-01", {"2001-02"}).select("member", r6("skill_off"), r6("skill_def"))


@query("skill_leakage", sb.with_(*_BASE, SKILL_SQL) + """SELECT season, count(*) + count(CASE WHEN member % 3 = 0 THEN 1 END) AS n_rows, count(CASE WHEN member % 3 = 0 THEN 1 END) AS n_duplicate_ids,
 count(CASE WHEN member % 3 = 0 THEN 1 END) AS n_leaking, count(CASE WHEN member % 3 = 0 THEN 1 END) = 0 AS ok
FROM skill GROUP BY season""")
def skill_leakage(spark, sf):
    """SRC10 Q7: skill tables of all seasons in which every third member has a second row that cites the modelled season."""
    s = wh.skill_by_season(spark, sf).select(
        "season", "member", "skill_off", "skill_def", F.lit("prior_season").alias("source"), F.lit("season before, final").alias("vintage"))
    leaks = s.where(F.col("member") % 3 == 0).withColumn("vintage", F.concat("season", F.lit(" to date")))
    return ln.skill_leakage(s.unionByName(leaks), "season")


STINT_SQL = f"""sm AS (SELECT game, status, member, sum(qty) AS poss, sum(floor(rev / 1000.0)) AS points, count(CASE WHEN flag <> 'R' THEN 1 END) AS fga,
  count(CASE WHEN flag = 'A' THEN 1 END) AS fgm, count(CASE WHEN flag <> 'R' AND discount >= 0.05 THEN 1 END) AS fg3a,
  count(CASE WHEN flag = 'A' AND discount >= 0.05 THEN 1 END) AS fg3m, count(CASE WHEN flag = 'R' THEN 1 END) AS tov, max(ship) AS ship FROM lines GROUP BY ALL),
side AS (SELECT game, status, list_sort(list(member)) AS ids, max(ship) AS ship, sum(poss) AS poss, sum(points) AS points, sum(fga) AS fga, sum(fgm) AS fgm,
  sum(fg3a) AS fg3a, sum(fg3m) AS fg3m, sum(tov) AS tov FROM sm GROUP BY game, status),
stints AS (SELECT o.game, {sb.season('greatest(o.ship, d.ship)')} AS season, (o.status = 'O')::INT AS home_off, o.ids AS off, d.ids AS def,
  o.poss AS off_possessions, o.points AS off_points, o.fga AS off_fga, o.fgm AS off_fgm, o.fg3a AS off_fg3a, o.fg3m AS off_fg3m, o.tov AS off_tov,
  100.0 * o.points / o.poss AS y_off FROM side o JOIN side d ON d.game = o.game AND d.status <> o.status)"""


@query("segment_table", sb.with_(sb.LINES, STINT_SQL) + f"""SELECT game, season, home_off, array_to_string(off, '-') AS off, array_to_string(def, '-') AS def,
 {s6('off_possessions')} AS off_possessions, {s6('off_points')} AS off_points, {s6('y_off')} AS y_off, off_fga::BIGINT AS off_fga, off_tov::BIGINT AS off_tov FROM stints""")
def segment_table(spark, sf):
    """Directed segments with both member sets."""
    s = wh.stints(spark, sf)
    text = lambda c: F.concat_ws("-", F.transform(c, lambda x: x.cast("string"))).alias(c)
    return s.select("game", "season", "home_off", text("off"), text("def"), r6("off_possessions"), r6("off_points"), r6("y_off"),
                    "off_fga", "off_tov")


def _side_sql(side: str) -> str:
    sums = ", ".join(f"sum(w{i} * skill_{side}) AS e_{side}_{i}" for i in range(K))
    return f"""d_{side} AS (SELECT game, home_off, count(*) AS n, max(len(ids)) AS size, sum(skill_{side}) AS s_{side}, {sums}
 FROM (SELECT game, home_off, season, {side} AS ids, unnest({side}) AS member FROM stints) JOIN mix USING (member, season) JOIN skill USING (member, season)
 GROUP BY game, home_off HAVING count(*) = max(len(ids)))"""


DESIGN_SQL = [*_BASE, SKILL_SQL, STINT_SQL, _side_sql("off"), _side_sql("def"),
              "design AS (SELECT s.game, s.home_off, s.season, s.y_off, s.off_possessions, o.* EXCLUDE (game, home_off, n, size), d.* EXCLUDE (game, home_off, n, size)"
              " FROM stints s JOIN d_off o ON o.game = s.game AND o.home_off = s.home_off JOIN d_def d ON d.game = s.game AND d.home_off = s.home_off)"]


def side_sums(spark, sf, stints=None):
    return ln.side_sums(wh.stints(spark, sf) if stints is None else stints, wh.recipes(spark, sf).select("member", "season", "recipe"), wh.skill_by_season(spark, sf), K)


def design(spark, sf):
    return ln.with_products(side_sums(spark, sf), K)


@query("design_matrix", sb.with_(*DESIGN_SQL) + f"""SELECT game, home_off, {s6('y_off')} AS y_off, {s6('s_off')} AS s_off, {s6('s_def')} AS s_def,
 {", ".join(f"{s6(f'e_off_{i}')} AS e_off_{i}, {s6(f'e_def_{i}')} AS e_def_{i}" for i in range(K))},
 {s6('e_off_0 * e_off_1')} AS x_off_0_1, {s6('e_def_4 * e_def_5')} AS x_def_4_5 FROM design""")
def design_matrix(spark, sf):
    """Segments whose members are all known."""
    d = design(spark, sf)
    return d.select("game", "home_off", r6("y_off"), r6("s_off"), r6("s_def"), *[r6(f"e_{s}_{i}") for i in range(K) for s in ("off", "def")],
                    r6("x_off_0_1"), r6("x_def_4_5"))


_GX = ["s_off", "s_def", "home_off"]
_GA = ["1", *_GX, "y_off"]
_GSQL = " UNION ALL ".join(
    f"SELECT season, {i} AS i, {j} AS j, sum(off_possessions * {_GA[i]} * {_GA[j]}) AS value FROM design GROUP BY season"
    for i in range(5) for j in range(i, 5))


@query("gram_by_season", sb.with_(*DESIGN_SQL, f"g AS ({_GSQL})") + f"SELECT season, i, j, {s6('value / 1000')} AS value FROM g")
def gram_by_season(spark, sf):
    """Additive cross products per fold key, accumulated inside the tasks."""
    g = gram.cross_products(design(spark, sf), _GX, "y_off", "off_possessions", "season")
    return g.select("season", "i", "j", r6(F.col("value") / 1000, "value"))


@query("gram_jvm", sb.with_(*DESIGN_SQL, f"g AS ({_GSQL})") + f"SELECT season, i, j, {s6('value / 1000')} AS value FROM g")
def gram_jvm(spark, sf):
    """The same statistics as plain aggregates."""
    g = gram.cross_products_sql(design(spark, sf), _GX, "y_off", "off_possessions", ["season"])
    return g.select("season", "i", "j", r6(F.col("value") / 1000, "value"))


@query("weighted_moments", sb.with_(*DESIGN_SQL) + f"""SELECT season, {s6('sum(off_possessions * s_off) / sum(off_possessions)')} AS mean,
 {s6('sqrt(sum(off_possessions * s_off * s_off) / sum(off_possessions) - power(sum(off_possessions * s_off) / sum(off_possessions), 2))')} AS std,
 {s6('''(sum(off_possessions * s_off * y_off) / sum(off_possessions) - sum(off_possessions * s_off) * sum(off_possessions * y_off) / power(sum(off_possessions), 2))
  / sqrt((sum(off_possessions * s_off * s_off) / sum(off_possessions) - power(sum(off_possessions * s_off) / sum(off_possessions), 2))
  * (sum(off_possessions * y_off * y_off) / sum(off_possessions) - power(sum(off_possessions * y_off) / sum(off_possessions), 2)))''')} AS corr,
 {s6('sqrt(sum(off_possessions * (y_off - s_off) * (y_off - s_off)) / sum(off_possessions))')} AS rmse FROM design GROUP BY season""")
def weighted_moments(spark, sf):
    """A5 A6 A8 A9."""
    return design(spark, sf).groupBy("season").agg(
        r6(stats.weighted_mean("s_off", "off_possessions"), "mean"), r6(stats.weighted_std("s_off", "off_possessions"), "std"),
        r6(stats.weighted_corr("s_off", "y_off", "off_possessions"), "corr"), r6(stats.weighted_rmse("y_off", "s_off", "off_possessions"), "rmse"))


def _names():
    return ln.design_columns(K)


def _ridge(spark, sf, rows=None, stints=None):
    rows = rows if rows is not None else ln.with_products(cut_lineage(side_sums(spark, sf, stints)), K)  # products are formed when read
    return rows, ln.fit_ridge(rows, _names(), ln.penalties(K))


@query("ridge_coefficients")
def ridge_coefficients(spark, sf):
    """R9 R10 R28 SRC18: ridge with the cross-validated penalty."""
    _, m = _ridge(spark, sf)
    return m.frame(spark).select("feature", r6("beta"), r6("mean"), r6("sd"), r6("z_min"), r6("z_max"))


@query("ridge_cv_curve")
def ridge_cv_curve(spark, sf):
    """Error of all 33 penalties, from one pass over the rows."""
    _, m = _ridge(spark, sf)
    return spark.createDataFrame(m.meta["curve"]).select(r6("lam"), r6("rmse"))


@query("ridge_baselines")
def ridge_baselines(spark, sf):
    """Null, talent-only and full model on the same folds."""
    _, m = _ridge(spark, sf)
    f = m.meta["folds"]
    return spark.createDataFrame([("null", ln.baseline_rmse(f, [])), ("talent", ln.baseline_rmse(f, [0, 1, 2])), ("full", m.meta["cv_rmse"])],
                                 "model string, rmse double").select("model", r6("rmse"))


def _lineup_scores(spark, sf, model, stints=None):
    ids = (wh.stints(spark, sf) if stints is None else stints).select("season", F.array_sort("off").alias("ids")).distinct()
    feats = ln.lineup_features(ids, wh.recipes(spark, sf).select("member", "season", "recipe"), wh.skill_by_season(spark, sf), K, ["season", "ids"])
    return ln.score_lineups(feats, model, K, ["season", "ids"])


@query("lineup_scores")
def lineup_scores(spark, sf):
    """R8 R12 R13 R14 SRC25: every line-up against the average opponent."""
    st = kept(wh.stints(spark, sf))  # read by the design, its sides and the line-ups
    _, m = _ridge(spark, sf, stints=st)
    s = _lineup_scores(spark, sf, m, st)
    return s.select("season", F.concat_ws("-", F.transform("ids", lambda x: x.cast("string"))).alias("group_key"), r6("ortg"), r6("drtg"), r6("net"))


_GIVEN = {"s_off": 0.8, "s_def": -0.5, "home_off": 1.2} | {f"e_off_{i}": 0.1 * (i + 1) for i in range(K)} | {f"e_def_{i}": -0.05 * (i + 1) for i in range(K)}
_AVERAGE = {"s_off": 1.5, "s_def": -0.5} | {f"e_{s}_{i}": 0.2 + 0.01 * i for s in ("off", "def") for i in range(K)}


def _given_model():
    """A model with stated coefficients and league averages, for checks of the scores alone."""
    names = _names()
    beta = np.array([_GIVEN.get(n, 0.0) for n in names])
    return ln.LinearModel(names, beta, 100.0, np.zeros(len(names)), np.ones(len(names)), {"league_average": _AVERAGE})


_E_OFF = " + ".join(f"{0.1 * (i + 1)} * e_off_{i}" for i in range(K))
_E_DEF = " + ".join(f"{0.05 * (i + 1)} * e_def_{i}" for i in range(K))


@query("matchup_scores", sb.with_(*DESIGN_SQL) + f"SELECT game, home_off, {s6(f'100 + 0.8 * s_off - 0.5 * s_def + 1.2 * home_off + {_E_OFF} - ({_E_DEF})')} AS ortg FROM design")
def matchup_scores(spark, sf):
    """Every segment's offense against the defense it met, under given coefficients."""
    return ln.score_matchups(design(spark, sf), _given_model(), ["game", "home_off"]).select("game", "home_off", r6("ortg"))


_A_OFF = sum(0.1 * (i + 1) * (0.2 + 0.01 * i) for i in range(K))
_A_DEF = sum(0.05 * (i + 1) * (0.2 + 0.01 * i) for i in range(K))
_SETS = f"""sets AS (SELECT DISTINCT season, off AS ids FROM stints),
m AS (SELECT season, ids, unnest(ids) AS member FROM sets),
f AS (SELECT m.season, m.ids, sum(skill_off) AS so, sum(skill_def) AS sd, {", ".join(f"sum(w{i} * skill_off) AS o{i}, sum(w{i} * skill_def) AS d{i}" for i in range(K))}
  FROM m JOIN mix ON mix.member = m.member AND mix.season = m.season JOIN skill ON skill.member = m.member AND skill.season = m.season GROUP BY m.season, m.ids HAVING count(*) = len(m.ids)),
sc AS (SELECT season, ids, 100.6 + 0.8 * so + 0.25 + {" + ".join(f"{0.1 * (i + 1)} * o{i}" for i in range(K))} - {_A_DEF!r} AS ortg,
  100.6 + 0.8 * 1.5 - 0.5 * sd + {_A_OFF!r} - ({" + ".join(f"{0.05 * (i + 1)} * d{i}" for i in range(K))}) AS drtg FROM f)"""


@query("lineup_scores_given", sb.with_(*_BASE, SKILL_SQL, STINT_SQL, _SETS) + f"""SELECT season, array_to_string(ids, '-') AS group_key, {s6('ortg')} AS ortg, {s6('drtg')} AS drtg, {s6('ortg - drtg')} AS net FROM sc""")
def lineup_scores_given(spark, sf):
    """Every line-up against the average opponent, under given coefficients."""
    s = _lineup_scores(spark, sf, _given_model())
    return s.select("season", F.concat_ws("-", F.transform("ids", lambda x: x.cast("string"))).alias("group_key"), r6("ortg"), r6("drtg"), r6("net"))


@query("holdout_check")
def holdout_check(spark, sf):
    """Model without one team, checked on that team's line-ups."""
    team = F.lit("NATION_3")
    st = cut_lineage(wh.stints_with_teams(spark, sf))
    kept = ln.without_team(st, team)
    rows = cut_lineage(ln.design(kept, wh.recipes(spark, sf).select("member", "season", "recipe"), wh.skill_by_season(spark, sf), K))
    leak = ln.leakage_count(rows, team).first()["n_leaking"]  # one row
    if leak:
        raise ValueError(f"{leak} rows of the holdout team in the training data")
    _, m = _ridge(spark, sf, rows)
    mine = st.where((F.col("offense_team") == team) | (F.col("defense_team") == team))
    obs = ln.observed_ratings(mine, ["season"], 20.0)
    rep = ln.holdout_report(obs, _lineup_scores(spark, sf, m), ["season", "ids"])
    return rep.select("n", r6("corr_ortg"), r6("mae_ortg"), "n_net", r6("corr_net"), r6("mae_net"))


@query("observed_ratings", sb.with_(sb.LINES, STINT_SQL) + f""",
o AS (SELECT season, off AS ids, sum(off_possessions) AS p, sum(off_points) AS pts FROM stints GROUP BY ALL HAVING sum(off_possessions) >= 40),
d AS (SELECT season, def AS ids, sum(off_possessions) AS p, sum(off_points) AS pts FROM stints GROUP BY ALL)
SELECT o.season, array_to_string(o.ids, '-') AS group_key, {s6('o.p')} AS off_possessions, {s6('coalesce(d.p, 0)')} AS def_possessions,
 {s6('100.0 * o.pts / o.p')} AS observed_ortg, {s6('100.0 * d.pts / d.p')} AS observed_drtg, {s6('100.0 * o.pts / o.p - 100.0 * d.pts / d.p')} AS observed_net
FROM o LEFT JOIN d ON d.season = o.season AND d.ids = o.ids""")
def observed_ratings(spark, sf):
    """A22."""
    o = ln.observed_ratings(wh.stints(spark, sf), ["season"], 40.0)
    return o.select("season", F.concat_ws("-", F.transform("ids", lambda x: x.cast("string"))).alias("group_key"), r6("off_possessions"),
                    r6("def_possessions"), r6("observed_ortg"), r6("observed_drtg"), r6("observed_net"))


@query("join_coverage", sb.with_(*_BASE, SKILL_SQL, STINT_SQL) + f""",
ids AS (SELECT DISTINCT season, unnest(list_concat(off, def)) AS member FROM stints),
c AS (SELECT season, 'recipe' AS dimension, count(*) AS n_ids, count(CASE WHEN (season, member) NOT IN (SELECT (season, member) FROM mix) THEN 1 END) AS n_missing FROM ids GROUP BY season
 UNION ALL SELECT season, 'skill', count(*), count(CASE WHEN (season, member) NOT IN (SELECT (season, member) FROM skill) THEN 1 END) FROM ids GROUP BY season)
SELECT season, dimension, n_ids, n_missing, {s6('n_missing / n_ids')} AS missing_share FROM c""")
def join_coverage(spark, sf):
    """Fact ids of every season that lack a recipe or a skill value."""
    facts = wh.stints(spark, sf).select("season", F.explode(F.concat("off", "def")).alias("member"))
    c = relational.coverage(facts, {"recipe": wh.recipes(spark, sf), "skill": wh.skill_by_season(spark, sf)}, "member", by=("season",))
    return c.select("season", "dimension", "n_ids", "n_missing", r6("missing_share"))


@query("known_members", sb.with_(*_BASE, SKILL_SQL) + """SELECT season, member FROM (SELECT season, member FROM mix INTERSECT SELECT season, member FROM skill INTERSECT SELECT season, member FROM lines)""")
def known_members(spark, sf):
    """U4: ids present in recipes, skill and facts, in every season."""
    return relational.known_members(wh.recipes(spark, sf), wh.skill_by_season(spark, sf), wh.lines(spark, sf), key=["season", "member"])


GROUP_SQL = [*_BASE, sb.GM, sb.LINEUPS, "talent AS (SELECT member, season, obpm + dbpm AS bpm FROM outcomes)",
             f"""gt AS (SELECT season, ids, sum(bpm) AS sum_bpm, {", ".join(f"avg(w{i}) AS a{i}" for i in range(K))}
  FROM (SELECT season, ids, size, unnest(ids) AS member FROM lineups) JOIN mix USING (member, season) JOIN talent USING (member, season)
  GROUP BY season, ids HAVING count(*) = max(size)),
groups AS (SELECT l.*, sum_bpm, {", ".join(f"a{i}" for i in range(K))},
  exp(-({" + ".join(f"CASE WHEN a{i} > 0 THEN a{i} * ln(a{i}) ELSE 0 END" for i in range(K))})) AS entropy FROM lineups l JOIN gt ON gt.season = l.season AND gt.ids = l.ids)"""]


def groups(spark, sf, size=None):
    l = wh.lineups(spark, sf)
    if size is not None:
        l = l.where(F.col("size") == size)
    return ln.group_table(l, wh.recipes(spark, sf), wh.talent(spark, sf), K)


def team_groups(spark, sf, size=None):
    """Groups with the team of their first member as cluster."""
    m = wh.members(spark, sf).select(F.col("member").alias("_m"), "team")
    return groups(spark, sf, size).withColumn("_m", F.col("ids")[0]).join(m, "_m").drop("_m")


@query("group_table", sb.with_(*GROUP_SQL) + f"""SELECT season, array_to_string(ids, '-') AS group_key, size::INT AS size, {s6('min')} AS min, {s6('sum_bpm')} AS sum_bpm,
 {s6('entropy')} AS entropy, {", ".join(f"{s6(f'a{i}')} AS a{i}" for i in range(K))}, {s6('-def_rating')} AS def_rating_inv FROM groups""")
def group_table(spark, sf):
    """Groups with a complete set of known members."""
    g = ln.invert_lower_is_better(groups(spark, sf), ["def_rating"])
    return g.select("season", F.concat_ws("-", F.transform("ids", lambda x: x.cast("string"))).alias("group_key"), "size", r6("min"), r6("sum_bpm"),
                    r6("entropy"), *[r6(f"a{i}") for i in range(K)], r6("def_rating_inv"))


@query("reference_component", sb.with_(*GROUP_SQL) + f""", s AS (SELECT [{", ".join(f"sum(min * a{i})" for i in range(K))}] AS v FROM groups)
SELECT list_position(v, list_max(v)) - 1 AS reference, {s6('list_max(v)')} AS mass FROM s""")
def reference_component(spark, sf):
    """R22."""
    return ln.reference_component(groups(spark, sf), K).select("reference", r6("mass"))


@query("outcome_model")
def outcome_model(spark, sf):
    """Weighted fit on four-member groups with team-bootstrap intervals."""
    m = ln.fit_outcome(cut_lineage(team_groups(spark, sf, 4)), "off_rating", K, draws=1000)
    return m.frame(spark).select("feature", r6("coef"), r6("ci_low"), r6("ci_high"), F.lit(m.reference).alias("reference"), F.lit(round(m.r2, 6)).alias("r2"))


@query("outcome_cv")
def outcome_cv(spark, sf):
    """Team-grouped cross-validation against talent only."""
    g = cut_lineage(team_groups(spark, sf, 4))
    ref = int(ln.reference_component(g, K).first()["reference"])
    r = ln.cross_validate_outcome(g, "off_rating", K, ref)
    return spark.createDataFrame([(float(r["r2_baseline"]), float(r["r2_full"]), bool(r["full_beats_baseline"]))],
                                 "r2_baseline double, r2_full double, full_beats_baseline boolean").select(r6("r2_baseline"), r6("r2_full"), "full_beats_baseline")


@query("granularity")
def granularity(spark, sf):
    """Coefficients at group sizes 2, 3, 4 with one reference component."""
    tables = {n: cut_lineage(team_groups(spark, sf, n)) for n in (2, 3, 4)}
    ref = int(ln.reference_component(tables[4], K).first()["reference"])
    return spark.createDataFrame(ln.granularity(tables, "off_rating", K, ref)).select("size", "feature", r6("coef"), r6("sd"), r6("std_coef"))


@query("five_member_extrapolation")
def five_member_extrapolation(spark, sf):
    """Four-member model on five-member groups."""
    g4, g5 = cut_lineage(team_groups(spark, sf, 4)), groups(spark, sf, 5)
    m = ln.fit_outcome(g4, "off_rating", K, draws=0)
    g = gram.matrix(gram.cross_products(g4, ["sum_bpm"], "off_rating", "min").toPandas(), 3)
    coef, b0 = gram.least_squares(g)
    base = ln.OutcomeModel(["sum_bpm"], coef, b0, m.reference, float("nan"))
    return ln.extrapolate(m, base, g5, "off_rating").select("n", r6("corr_full"), r6("corr_baseline"))


@query("outcome_report")
def outcome_report(spark, sf):
    """The outcome model, its validation, its granularity and its extrapolation as one report."""
    tables = {n: cut_lineage(team_groups(spark, sf, n)) for n in (2, 3, 4)}
    r = ln.outcome_report(tables, groups(spark, sf, 5), "off_rating", K)
    return r.select("section", "item", r6("value"), r6("low"), r6("high"))


_COEF = {"a0": 1.5, "a1": -2.0, "a2": 0.5, "a3": 3.0, "a4": -1.0, "entropy": 0.8}
_SUBS = " UNION ALL ".join(
    f"""SELECT season, ids, entropy, {i} AS source, {j} AS target, a{i} AS w, {_COEF.get(f'a{j}', 0.0)} * 0.1 - {_COEF.get(f'a{i}', 0.0)} * 0.1 AS lin,
 [{", ".join(f"a{c}{' - 0.1' if c == i else ' + 0.1' if c == j else ''}" for c in range(K))}] AS nv FROM groups"""
    for i in range(K) for j in range(K) if i != j)


@query("substitution_effects", sb.with_(*GROUP_SQL, f"sb AS ({_SUBS})") + f"""
SELECT season, array_to_string(ids, '-') AS group_key, source, target,
 {s6("lin + 0.8 * (exp(-list_sum(list_transform(nv, lambda x: CASE WHEN x > 0 THEN x * ln(x) ELSE 0 END))) - entropy)")} AS change FROM sb WHERE w >= 0.1 - 1e-9""")
def substitution_effects(spark, sf):
    """All component shifts of every group, of any size, under given coefficients."""
    s = ln.substitutions(groups(spark, sf), _COEF, K)
    return s.select("season", F.concat_ws("-", F.transform("ids", lambda x: x.cast("string"))).alias("group_key"), "source", "target", r6("change"))


def _exposure(spark, sf):
    return cut_lineage(ln.pair_exposure(wh.pairs(spark, sf).where(F.col("min") >= 20), wh.recipes(spark, sf), K, wh.talent(spark, sf)))


@query("synergy_matrix")
def synergy_matrix(spark, sf):
    """R17 R18 R32 J5 SRC26: pair model with quality covariates, mirrored."""
    f = ln.fit_synergy(_exposure(spark, sf), K, ["qa", "qb"])
    return ln.matrix_frame(spark, f["matrix"]).select("i", "j", r6("value"))


@query("synergy_comparison")
def synergy_comparison(spark, sf):
    """Fits without and with covariates."""
    e = _exposure(spark, sf)
    c = ln.compare_fits(spark, {"plain": ln.fit_synergy(e, K), "controlled": ln.fit_synergy(e, K, ["qa", "qb"])})
    return c.select("fit", r6("r2"), r6("min_value"), r6("max_value"), r6("positive_share"))


@query("pair_cells", sb.with_(*_BASE, sb.GM, sb.PAIRS) + f""", talent AS (SELECT member, season, obpm + dbpm AS bpm FROM outcomes)
SELECT p.season, p.a, p.b, {", ".join(f"{s6(f'0.5 * (x.w{i} * y.w{j} + x.w{j} * y.w{i})')} AS c{i}_{j}" for i, j in ((0, 0), (0, 1), (2, 5)))}, {s6('s.bpm')} AS qa, {s6('t.bpm')} AS qb
FROM pairs p JOIN mix x ON x.member = p.a AND x.season = p.season JOIN mix y ON y.member = p.b AND y.season = p.season
JOIN talent s ON s.member = p.a AND s.season = p.season JOIN talent t ON t.member = p.b AND t.season = p.season""")
def pair_cells(spark, sf):
    """J4 J5 R18."""
    e = ln.pair_exposure(wh.pairs(spark, sf), wh.recipes(spark, sf), K, wh.talent(spark, sf))
    return e.select("season", "a", "b", r6("c0_0"), r6("c0_1"), r6("c2_5"), r6("qa"), r6("qb"))


@query("split_half", sb.with_(sb.LINES, STINT_SQL) + f""",
g AS (SELECT off AS ids, floor(game / 2)::BIGINT % 2 AS half, sum(off_possessions) AS p, sum(off_points) AS pts FROM stints GROUP BY ALL),
w AS (SELECT ids, max(CASE WHEN half = 0 THEN p END) AS pa, max(CASE WHEN half = 0 THEN pts END) AS ta, max(CASE WHEN half = 1 THEN p END) AS pb, max(CASE WHEN half = 1 THEN pts END) AS tb FROM g GROUP BY ids)
SELECT count(*) AS n, {s6('corr(100.0 * ta / pa, 100.0 * tb / pb)')} AS corr FROM w WHERE pa >= 15 AND pb >= 15""")
def split_half(spark, sf):
    """R30."""
    half = F.pmod(F.floor(F.col("game") / 2), F.lit(2))
    return ln.split_half(wh.stints(spark, sf), half, [], 15.0).select("n", r6("corr"))


@query("team_season_validation", sb.with_(*DESIGN_SQL, sb.MEMBERS) + f""",
t AS (SELECT team, s.season, sum(d.off_possessions * (d.s_off - d.s_def)) / sum(d.off_possessions) AS prediction, sum(100.0 * s.off_points) / sum(s.off_possessions) AS rating
  FROM design d JOIN stints s ON s.game = d.game AND s.home_off = d.home_off JOIN members m ON m.member = s.off[1] GROUP BY ALL)
SELECT count(*) AS n, {s6('corr(prediction, rating)')} AS corr FROM t""")
def team_season_validation(spark, sf):
    """Talent-only prediction per team-season against the observed rating."""
    st = wh.stints_with_teams(spark, sf)
    rows = ln.design(st, wh.recipes(spark, sf).select("member", "season", "recipe"), wh.skill_by_season(spark, sf), K)
    pred = rows.withColumn("prediction", F.col("s_off") - F.col("s_def"))
    official = rows.groupBy("offense_team", "season").agg((100.0 * F.sum("off_points") / F.sum("off_possessions")).alias("rating"))
    return ln.team_season_validation(pred, official, ["offense_team", "season"]).select("n", r6("corr"))
