"""Queries on combinations, cross-population features and column dictionaries (2.16-2.18)."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Window
from pyspark.sql import functions as F

from blendscope import warehouse as wh
from blendscope.functions import vectors as vec
from blendscope.plans import combos as cb
from blendscope.plans import environment as env
from blendscope.plans import linear as ln
from blendscope.plans import population as pp
from blendscope.plans import quality as ql
from blendscope.session import cut_lineage
from blendscope.suite import query, r6, s6
from blendscope.suite import sqlbase as sb
from blendscope.suite.identity import _BIO
from blendscope.suite.linear import OUT_SQL, team_groups

K = wh.K
SLOTS = wh.SQUAD
KEYS = ["team", "season"]
# A symmetric matrix of pair values, for checks that need a given one.
M = np.array([[0.5 * ((i * 7 + j * 7 + 3 * i * j) % 11) - 2.0 for j in range(K)] for i in range(K)])
ROLES = {"rim": [0, 1], "spacing": [2, 3], "ball": [4, 5]}


def rosters(spark, sf):
    """All members of each squad and season, by weight."""
    m = wh.recipes(spark, sf).join(wh.squads(spark, sf), "member").join(wh.talent(spark, sf), ["member", "season"])
    m = m.withColumn("self_form", cb.bilinear(F.col("recipe"), F.col("recipe"), M))
    return cb.roster(m, KEYS, [F.col("min").desc(), F.col("member")], ["member", "recipe", "bpm", "self_form"])


ROSTER_SQL = [sb.LINES, sb.MIX, sb.MEMBERS, sb.SQUADS, OUT_SQL, """slots AS (SELECT mix.*, team, obpm + dbpm AS bpm,
  row_number() OVER (PARTITION BY team, season ORDER BY min DESC, member) AS slot FROM mix JOIN squads USING (member) JOIN outcomes USING (member, season))"""]


def _sets_sql(r: int) -> str:
    al = "abcde"[:r]
    joins = " ".join(f"JOIN slots {al[i]} ON {al[i]}.team = a.team AND {al[i]}.season = a.season AND {al[i]}.slot > {al[i - 1]}.slot" for i in range(1, r))
    mix = ", ".join(f"({' + '.join(f'{x}.w{i}' for x in al)}) / {r}.0 AS a{i}" for i in range(K))
    ids = " || '-' || ".join(f"{x}.member::VARCHAR" for x in al)
    return f"SELECT a.team, a.season, {ids} AS ids, [{', '.join(f'{x}.member' for x in al)}] AS idl, {mix}, {' + '.join(f'{x}.bpm' for x in al)} AS sum_bpm, " + ", ".join(
        f"[{', '.join(f'{x}.w{i}' for i in range(K))}] AS v{n}" for n, x in enumerate(al)) + f" FROM slots a {joins}"


def _sets(spark, sf, r):
    return cb.describe_sets(cb.enumerate_sets(rosters(spark, sf), r, SLOTS, KEYS), r, K)


def _ids(c="ids"):
    return F.concat_ws("-", F.transform(c, lambda x: x.cast("string"))).alias("ids")


def _form(a: str, b: str) -> str:
    return " + ".join(f"{M[i, j]} * {a}[{i + 1}] * {b}[{j + 1}]" for i in range(K) for j in range(K))


@query("roster_pair_scores", sb.with_(*ROSTER_SQL, f"s AS ({_sets_sql(2)})") + f"SELECT team, season, ids, {s6(_form('v0', 'v1'))} AS score FROM s")
def roster_pair_scores(spark, sf):
    """K1."""
    p = cb.pair_scores(_sets(spark, sf, 2), M)
    return p.select(*KEYS, _ids(), r6("score"))


_E4 = "exp(-(" + " + ".join(f"CASE WHEN a{i} > 0 THEN a{i} * ln(a{i}) ELSE 0 END" for i in range(K)) + "))"


@query("roster_sets", sb.with_(*ROSTER_SQL, f"s AS ({_sets_sql(4)})") + f"""SELECT team, season, ids, {s6('sum_bpm')} AS sum_bpm, {s6(_E4)} AS entropy,
 {", ".join(f"{s6(f'a{i}')} AS a{i}" for i in range(K))} FROM s""")
def roster_sets(spark, sf):
    """K3: all four-member sets of every roster."""
    s = _sets(spark, sf, 4)
    return s.select(*KEYS, _ids(), r6("sum_bpm"), r6("entropy"), *[r6(f"a{i}") for i in range(K)])


_PS = " + ".join(f"({_form(f'v{i}', f'v{j}')})" for i in range(5) for j in range(i + 1, 5))


@query("pair_sum_ranking", sb.with_(*ROSTER_SQL, f"s AS (SELECT team, season, ids, idl, {_PS} AS score FROM ({_sets_sql(5)}))") + f"""
SELECT team, season, ids, 'head' AS side, rank, {s6('score')} AS score FROM (SELECT *, row_number() OVER (PARTITION BY team, season ORDER BY round(score, 9) DESC, idl) AS rank FROM s) WHERE rank <= 10
UNION ALL SELECT team, season, ids, 'tail', rank, {s6('score')} FROM (SELECT *, row_number() OVER (PARTITION BY team, season ORDER BY round(score, 9), idl) AS rank FROM s) WHERE rank <= 3""")
def pair_sum_ranking(spark, sf):
    """Five-member sets by the sum of their pair scores, best ten and worst three."""
    s = cb.pair_sums(cb.enumerate_sets(rosters(spark, sf), 5, SLOTS, KEYS), 5, M, K)
    s = s.withColumn("ids", F.array(*[F.col(f"m{m}")["member"] for m in range(5)]))
    return cb.rank_sets(s.select(*KEYS, "ids", "score"), KEYS, "score").select(*KEYS, _ids(), "side", "rank", r6("score"))


_CO = {"sum_bpm": 0.8, "a1": 4.0, "a2": -3.0, "a3": 1.0, "a4": 2.0, "a5": -1.0, "entropy": 1.5}


@query("model_set_ranking", sb.with_(*ROSTER_SQL, f"""s AS (SELECT *, 10 + {' + '.join(f'{v} * {_E4 if n == "entropy" else n}' for n, v in _CO.items())} AS predicted FROM ({_sets_sql(5)}))""") + f"""
SELECT team, season, ids, rank, {s6('predicted')} AS predicted FROM (SELECT *, row_number() OVER (PARTITION BY team, season ORDER BY round(predicted, 9) DESC, idl) AS rank FROM s) WHERE rank <= 10""")
def model_set_ranking(spark, sf):
    """K4: five-member sets under given model coefficients."""
    m = ln.OutcomeModel(list(_CO), np.array(list(_CO.values())), 10.0, 0, float("nan"))
    s = cb.score_sets(_sets(spark, sf, 5), m.predict())
    t = cb.rank_sets(s.select(*KEYS, "ids", "predicted"), KEYS, "predicted", 10, 0)
    return t.select(*KEYS, _ids(), "rank", r6("predicted"))


@query("lineup_ranking_job")
def lineup_ranking_job(spark, sf):
    """Outcome model on four-member groups applied to all five-member sets."""
    m = ln.fit_outcome(cut_lineage(team_groups(spark, sf, 4)), "net_rating", K, draws=0)
    s = cb.score_sets(_sets(spark, sf, 5), m.predict())
    return cb.rank_sets(s.select(*KEYS, "ids", "predicted"), KEYS, "predicted").select(*KEYS, _ids(), "side", "rank", r6("predicted"))


_T = [0.3, 0.1, 0.2, 0.1, 0.2, 0.1]


def _target():
    return F.array(*[F.lit(x) for x in _T])


LOW, HIGH = {"rim": 0.30, "spacing": 0.32}, {"ball": 0.36}
EPS = 0.005
_UNITS = f"""u0 AS ({_sets_sql(4)}),
u1 AS (SELECT *, round(1 - {sb.js([f'a{i}' for i in range(K)], [str(x) for x in _T])}, 12) AS env_match, a0 + a1 AS rim_share, a2 + a3 AS spacing_share, a4 + a5 AS ball_share FROM u0),
u2 AS (SELECT *, (rim_share < 0.30)::INT + (spacing_share < 0.32)::INT + (ball_share > 0.36)::INT AS n_flags FROM u1),
du AS (SELECT team, season, env_match, row_number() OVER (PARTITION BY team, season ORDER BY env_match DESC) AS rn FROM (SELECT DISTINCT team, season, env_match FROM u2)),
walk AS (WITH RECURSIVE w AS (SELECT team, season, env_match, rn, env_match AS anchor, 0 AS tie_group FROM du WHERE rn = 1
  UNION ALL SELECT d.team, d.season, d.env_match, d.rn, CASE WHEN w.anchor - d.env_match > {EPS} THEN d.env_match ELSE w.anchor END,
    CASE WHEN w.anchor - d.env_match > {EPS} THEN w.tie_group + 1 ELSE w.tie_group END FROM w JOIN du d ON d.team = w.team AND d.season = w.season AND d.rn = w.rn + 1) SELECT * FROM w),
units AS (SELECT u2.*, tie_group FROM u2 JOIN walk USING (team, season, env_match))"""


def _units(spark, sf):
    u = cb.unit_flags(_sets(spark, sf, 4), _target(), K, ROLES, LOW, HIGH)
    return cut_lineage(cb.anchored_groups(cut_lineage(u), KEYS, EPS))


@query("recommended_units", "WITH RECURSIVE " + ",\n".join([*ROSTER_SQL, _UNITS]) + f"""
SELECT team, season, ids, rank, n_flags, tie_group, {s6('env_match')} AS env_match, {s6('sum_bpm')} AS sum_bpm FROM (
 SELECT *, row_number() OVER (PARTITION BY team, season ORDER BY n_flags > 0, tie_group, round(sum_bpm, 9) DESC, idl) AS rank FROM units) WHERE rank <= 4""")
def recommended_units(spark, sf):
    """Four-member units by flags, tie group and talent."""
    r = cb.recommend(_units(spark, sf), KEYS, 4)
    return r.select(*KEYS, _ids(), "rank", "n_flags", "tie_group", r6("env_match"), r6("sum_bpm"))


@query("worst_unit", "WITH RECURSIVE " + ",\n".join([*ROSTER_SQL, _UNITS]) + f"""
SELECT team, season, ids, n_flags, {s6('env_match')} AS env_match FROM (
 SELECT *, row_number() OVER (PARTITION BY team, season ORDER BY n_flags DESC, env_match, idl) AS rank FROM units WHERE n_flags > 0) WHERE rank = 1""")
def worst_unit(spark, sf):
    """K9."""
    return cb.worst_flagged(_units(spark, sf), KEYS).select(*KEYS, _ids(), "n_flags", r6("env_match"))


def _lead(idx):
    vals = [f"round({' + '.join(f'v{m}[{i + 1}]' for i in idx)}, 12)" for m in range(4)]
    return f"idl[list_position([{', '.join(vals)}], greatest({', '.join(vals)}))]"


@query("unit_key_members", sb.with_(*ROSTER_SQL, f"s AS ({_sets_sql(4)})") + f"""
SELECT team, season, ids, {", ".join(f"{_lead(i)} AS {n}_lead" for n, i in ROLES.items())} FROM s""")
def unit_key_members(spark, sf):
    """K6."""
    s = cb.key_members(_sets(spark, sf, 4), 4, ROLES)
    return s.select(*KEYS, _ids(), *[f"{n}_lead" for n in ROLES])


def _tops(m):
    return f"list_position(v{m}, list_max(v{m})) - 1"


def _any(idx):
    return "(" + " OR ".join(f"{_tops(m)} IN ({', '.join(map(str, idx))})" for m in range(4)) + ")"


@query("constraint_units", sb.with_(*ROSTER_SQL, f"s AS ({_sets_sql(4)})") + f"""
SELECT team, season, ids, {s6('sum_bpm')} AS sum_bpm, {_any([0, 1])} AS has_rim, {_any([2, 3])} AS has_shooting, {_any([5])} AS has_redundancy,
 {_any([0, 1])} AND {_any([2, 3])} AND NOT {_any([5])} AS passes FROM s""")
def constraint_units(spark, sf):
    """K7: units with the needed roles and without the avoided one."""
    s = cb.constraint_units(_sets(spark, sf, 4), 4, {"rim": [0, 1], "shooting": [2, 3]}, [5])
    return s.select(*KEYS, _ids(), r6("sum_bpm"), "has_rim", "has_shooting", "has_redundancy", "passes")


_W = [f"w{i}" for i in range(K)]
_COS = (f"({' + '.join(f'{x} * w{i}' for i, x in enumerate(_T))}) / (sqrt({' + '.join(f'w{i} * w{i}' for i in range(K))}) * {float(np.sqrt(sum(x * x for x in _T)))!r} + 1e-12)")


@query("incompatible_members", sb.with_(sb.LINES, sb.MIX) + f"SELECT member, season, {s6('w4')} AS share, {s6(_COS)} AS cosine FROM mix WHERE w4 >= 0.2")
def incompatible_members(spark, sf):
    """K8 S13."""
    i = cb.incompatible(wh.recipes(spark, sf), 4, _target(), K, 0.2)
    return i.select("member", "season", r6("share"), r6("cosine"))


@query("roster_conflicts", sb.with_(sb.ENVBENCH, sb.SQUADS) + f""",
rk AS (SELECT mix.member, mix.season, team, row_number() OVER (PARTITION BY team, season ORDER BY min DESC, member) AS slot FROM mix JOIN squads USING (member)),
d AS (SELECT rk.team, rk.slot, mis.* FROM rk JOIN mis USING (member, season))
SELECT a.team, a.season, a.member AS a, b.member AS b, CASE WHEN {'sqrt(' + ' + '.join(f'a.d{i} * a.d{i}' for i in range(K)) + ') * sqrt(' + ' + '.join(f'b.d{i} * b.d{i}' for i in range(K)) + ')'} > 1e-9
 THEN {s6('(' + ' + '.join(f'a.d{i} * b.d{i}' for i in range(K)) + ') / (sqrt(' + ' + '.join(f'a.d{i} * a.d{i}' for i in range(K)) + ') * sqrt(' + ' + '.join(f'b.d{i} * b.d{i}' for i in range(K)) + '))')} ELSE 0 END AS cosine
FROM d a JOIN d b ON a.team = b.team AND a.season = b.season AND a.slot < b.slot""")
def roster_conflicts(spark, sf):
    """Cosine of the difference vectors inside each roster."""
    from blendscope.suite.environment import Tables

    t = Tables(spark, sf)
    m = t.recipes.join(wh.squads(spark, sf), "member")
    slots = m.withColumn("slot", F.row_number().over(Window.partitionBy(*KEYS).orderBy(F.col("min").desc(), "member"))).select(*KEYS, "slot", "member")
    c = env.roster_conflicts(cut_lineage(t.mismatch()), slots, K)
    return c.select("team", "season", "a", "b", r6("cosine"))


# --- cross-population features ---------------------------------------------------

_PL = """pl AS (SELECT member, season, sum(qty) AS minutes, count(*) AS fga, count(CASE WHEN flag = 'A' THEN 1 END) AS fgm, count(CASE WHEN line_no = 7 THEN 1 END) AS fta,
  count(CASE WHEN flag = 'R' THEN 1 END) AS tov, count(CASE WHEN discount >= 0.08 THEN 1 END) AS ast, count(CASE WHEN tax >= 0.07 THEN 1 END) AS stl,
  count(CASE WHEN line_no = 1 THEN 1 END) AS blk, count(CASE WHEN status = 'F' THEN 1 END) AS trb, sum(rev) / 1000.0 AS pts FROM lines GROUP BY ALL)"""


def _players(spark, sf):
    li = wh.lines(spark, sf)
    c = F.count_if
    return li.groupBy("member", "season").agg(
        F.sum("qty").alias("minutes"), F.count(F.lit(1)).alias("fga"), c(F.col("flag") == "A").alias("fgm"), c(F.col("line_no") == 7).alias("fta"),
        c(F.col("flag") == "R").alias("tov"), c(F.col("discount") >= 0.08).alias("ast"), c(F.col("tax") >= 0.07).alias("stl"),
        c(F.col("line_no") == 1).alias("blk"), c(F.col("status") == "F").alias("trb"), (F.sum("rev") / 1000.0).alias("pts"))


_BR = ("ast_pct", "trb_pct", "stl_pct", "blk_pct", "tov_pct", "pts_per_100")


@query("box_rates", sb.with_(sb.LINES, sb.MEMBERS, _PL) + f""",
tm AS (SELECT team, season, sum(minutes) AS tm_minutes, sum(fgm) AS tm_fgm, sum(trb) AS tm_trb, sum(fga) AS tm_poss, sum(fga) AS opp_poss, sum(fta) + sum(ast) AS opp_trb, sum(fga) AS opp_fga, sum(ast) AS opp_fg3a
  FROM pl JOIN members USING (member) GROUP BY ALL),
j AS (SELECT pl.*, tm.* EXCLUDE (season) FROM pl JOIN members USING (member) JOIN tm ON tm.team = members.team AND tm.season = pl.season WHERE minutes >= 300)
SELECT member, season, CASE WHEN minutes / tm_minutes * tm_fgm - fgm > 0 THEN {s6('100.0 * ast / (minutes / tm_minutes * tm_fgm - fgm)')} END AS ast_pct,
 {s6('100.0 * trb * tm_minutes / (minutes * (tm_trb + opp_trb))')} AS trb_pct, {s6('100.0 * stl * tm_minutes / (minutes * opp_poss)')} AS stl_pct,
 {s6('100.0 * blk * tm_minutes / (minutes * (opp_fga - opp_fg3a))')} AS blk_pct, {s6('100.0 * tov / (fga + 0.44 * fta + tov)')} AS tov_pct,
 {s6('100.0 * pts / (minutes * (tm_poss / tm_minutes))')} AS pts_per_100 FROM j""")
def box_rates(spark, sf):
    """B1."""
    p = _players(spark, sf).join(wh.members(spark, sf).select("member", "team"), "member")
    t = p.groupBy("team", "season").agg(
        F.sum("minutes").alias("tm_minutes"), F.sum("fgm").alias("tm_fgm"), F.sum("trb").alias("tm_trb"), F.sum("fga").alias("tm_poss"),
        F.sum("fga").alias("opp_poss"), (F.sum("fta") + F.sum("ast")).alias("opp_trb"), F.sum("fga").alias("opp_fga"), F.sum("ast").alias("opp_fg3a"))
    return pp.box_rates(p, t, ["team", "season"]).select("member", "season", *[r6(c) for c in _BR])


_ZONE = "CASE WHEN tax <= 0.02 THEN 'rim' WHEN tax <= 0.05 THEN 'mid' ELSE 'three' END"


@query("shot_type_shares", sb.with_(sb.LINES) + f""",
z AS (SELECT member, season, {_ZONE} AS zone, count(*) AS a, count(CASE WHEN flag = 'A' THEN 1 END) AS m, count(CASE WHEN flag = 'A' AND discount >= 0.05 THEN 1 END) AS s FROM lines GROUP BY ALL),
g AS (SELECT member, season, sum(a) AS n, {", ".join(f"sum(CASE WHEN zone = '{x}' THEN {c} ELSE 0 END) AS {x}_{c}" for x in ("rim", "mid", "three") for c in "ams")} FROM z GROUP BY ALL)
SELECT member, season, n::BIGINT AS n, {", ".join(f"{s6(f'100.0 * {x}_a / n')} AS pct_{x}" for x in ("rim", "mid", "three"))},
 CASE WHEN rim_m + mid_m <> 0 THEN {s6('100.0 * (rim_s + mid_s) / (rim_m + mid_m)')} END AS ast2, CASE WHEN three_m <> 0 THEN {s6('100.0 * three_s / three_m')} END AS ast3 FROM g WHERE n >= 20""")
def shot_type_shares(spark, sf):
    """B3."""
    li = wh.lines(spark, sf)
    zone = F.when(F.col("tax") <= 0.02, "rim").when(F.col("tax") <= 0.05, "mid").otherwise("three")
    z = li.groupBy("member", "season", zone.alias("zone")).agg(
        F.count(F.lit(1)).alias("attempted"), F.count_if(F.col("flag") == "A").alias("made"),
        F.count_if((F.col("flag") == "A") & (F.col("discount") >= 0.05)).alias("assisted"))
    return pp.shot_type_shares(z, ["member", "season"]).select("member", "season", "n", *[r6(c) for c in ("pct_rim", "pct_mid", "pct_three", "ast2", "ast3")])


_X, _Y = "((part * 37 + game) % 941)", "((game * 13 + part) % 501)"
_DIST = f"least(sqrt(power({_X} - 52.5, 2) + power({_Y} - 250.0, 2)), sqrt(power({_X} - 887.5, 2) + power({_Y} - 250.0, 2))) / 10.0"


@query("shot_profile", sb.with_(sb.LINES) + f""",
d AS (SELECT member, {_DIST} AS d, abs({_Y} - 250.0) / 10.0 AS off FROM lines)
SELECT member, count(*) AS n_shots, {", ".join(f"{s6(f'100.0 * avg((d >= {lo} AND d < {hi})::INT)')} AS {n}" for n, lo, hi in (("d0_3", 0, 3), ("d3_10", 3, 10), ("d10_16", 10, 16), ("d16_arc", 16, 22.15), ("d_three", 22.15, 999)))},
 {s6('avg(d)')} AS dist, coalesce({s6('100.0 * count(CASE WHEN d >= 22.15 AND off >= 17 THEN 1 END) / nullif(count(CASE WHEN d >= 22.15 THEN 1 END), 0)')}, 0) AS corner_share FROM d GROUP BY member""")
def shot_profile(spark, sf):
    """Coordinates derived from the order lines."""
    li = wh.lines(spark, sf).select(
        "member", F.pmod(F.col("part") * 37 + F.col("game"), F.lit(941)).cast("double").alias("x"), F.pmod(F.col("game") * 13 + F.col("part"), F.lit(501)).cast("double").alias("y"))
    s = pp.shot_profile(li, ["member"])
    return s.select("member", "n_shots", *[r6(c) for c in ("d0_3", "d3_10", "d10_16", "d16_arc", "d_three", "dist", "corner_share")])


_EU = "sqrt(" + " + ".join(f"power(w{i} - {x}, 2)" for i, x in enumerate(_T)) + ")"


@query("comparable_pool", sb.with_(sb.LINES, sb.MIX) + f"""
SELECT member, season, rank, {s6('cosine')} AS cosine, {s6('distance')} AS distance, {s6('1 / (1 + distance)')} AS closeness FROM (
 SELECT *, row_number() OVER (PARTITION BY season ORDER BY cosine DESC, member) AS rank FROM (SELECT member, season, round({_COS}, 12) AS cosine, {_EU} AS distance FROM mix)) WHERE rank <= 10""")
def comparable_pool(spark, sf):
    """B5 S13 S14."""
    c = pp.comparable_pool(wh.recipes(spark, sf), _target(), K, 10, ["season"])
    return c.select("member", "season", "rank", r6("cosine"), r6("distance"), r6("closeness"))


@query("rookie_comparables", sb.with_(sb.LINES, sb.MIX, sb.MEMBERS, _BIO) + f"""
SELECT member, season, rank, {s6('cosine')} AS cosine FROM (SELECT *, row_number() OVER (ORDER BY cosine DESC, member, season) AS rank FROM (
 SELECT mix.member, mix.season, round({_COS}, 12) AS cosine FROM mix JOIN bio USING (member, season) WHERE try_cast(draft_year AS INT) = split_part(season, '-', 1)::INT)) WHERE rank <= 10""")
def rookie_comparables(spark, sf):
    """Nearest rookie seasons."""
    from blendscope.functions import text as tx

    rookies = wh.bio(spark, sf).where(F.col("draft_year").try_cast("int") == tx.season_start_year("season")).select("member", "season")
    pool = wh.recipes(spark, sf).join(rookies, ["member", "season"]).withColumn("_all", F.lit(0))
    return pp.comparable_pool(pool, _target(), K, 10, ["_all"]).select("member", "season", "rank", r6("cosine"))


@query("hybrid_vector", sb.with_(sb.LINES) + f""",
p AS (SELECT member, season, avg(tax) AS a, avg(CASE WHEN flag = 'A' AND line_no = 7 AND discount >= 0.09 THEN qty END) AS b, avg(qty) AS c FROM lines GROUP BY ALL)
SELECT member, season, {s6('100 * a')} AS first, {s6('coalesce(b, c)')} AS second, true AS complete FROM p""")
def hybrid_vector(spark, sf):
    """Own value, else proxy, with a completeness gate."""
    p = wh.lines(spark, sf).groupBy("member", "season").agg(
        (100 * F.avg("tax")).alias("a"),
        F.avg(F.when((F.col("flag") == "A") & (F.col("line_no") == 7) & (F.col("discount") >= 0.09), F.col("qty"))).alias("b"), F.avg("qty").alias("c"))
    h = pp.hybrid_vector(p, {"first": "a", "second": "b"}, {"second": "c"}, ["member", "season"])
    return h.select("member", "season", r6("first"), r6("second"), "complete")


@query("supply_gap", sb.with_(sb.ENVBENCH, sb.MIXLONG, sb.MEMBERS) + f""",
bl AS ({sb.long_of('bench', {'a': 'x', 'p': 'p'}, 'member, season')}),
df AS (SELECT season, component, avg(p - a) AS difference FROM bl WHERE p IS NOT NULL GROUP BY ALL),
top AS (SELECT member, season, arg_max(component, w - component * 1e-15) AS component FROM mixlong GROUP BY ALL),
tt AS (SELECT team, season, component, count(*) AS n FROM top JOIN members USING (member) GROUP BY ALL),
ts AS (SELECT DISTINCT team, season FROM tt)
SELECT ts.team, ts.season, df.component, {s6('difference')} AS difference, coalesce(n, 0) AS n_members, difference > 0 AND n IS NULL AS is_gap
FROM ts JOIN df ON df.season = ts.season LEFT JOIN tt ON tt.team = ts.team AND tt.season = ts.season AND tt.component = df.component""")
def supply_gap(spark, sf):
    """B6."""
    from blendscope.suite.environment import Tables

    t = Tables(spark, sf)
    d = env.environment_difference(t.bench(), K).groupBy("season", "component").agg(F.avg("difference").alias("difference"))
    return pp.supply_gap(d, t.recipes, t.members, K).select("team", "season", "component", r6("difference"), "n_members", "is_gap")


# --- dictionaries ------------------------------------------------------------------

_OC = (("o_orderkey", "bigint"), ("o_custkey", "bigint"), ("o_orderstatus", "string"), ("o_totalprice", "double"), ("o_orderdate", "timestamp_ntz"), ("o_orderpriority", "string"))


@query("column_dictionary", " UNION ALL ".join(
    f"""SELECT {i} AS position, '{c}' AS "column", '{t}' AS type, count(*) - count({c}) AS n_missing, {s6(f'100.0 * (count(*) - count({c})) / count(*)')} AS pct_missing, arg_min({c}::VARCHAR, o_orderkey) AS example FROM orders"""
    for i, (c, t) in enumerate(_OC)))
def column_dictionary(spark, sf):
    """Q4."""
    o = wh.table(spark, sf, "orders").select(*[c for c, _ in _OC])
    d = ql.column_dictionary(o, ["o_orderkey"])
    return d.select("position", "column", "type", "n_missing", r6("pct_missing"), "example")
