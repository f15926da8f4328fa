"""Queries on features, populations and identity over time (2.2, 2.4, 2.5, 2.12)."""

from __future__ import annotations

from pyspark.sql import functions as F

from blendscope import warehouse as wh
from blendscope.functions import text as tx
from blendscope.functions import vectors as vec
from blendscope.operators import ordered, relational, stats
from blendscope.plans import features as ft
from blendscope.plans import identity as idn
from blendscope.session import cut_lineage
from blendscope.suite import query, r6, s6
from blendscope.suite import sqlbase as sb

K = wh.K
FEATURES = list(wh.FEATURES)
PLAY_TYPES = [t.lower() for t in wh.TYPES]
REQUIRED = ["ts", "usg", "ast", "tov", "stl", "blk", "trb", "ftr", "bpm", "dist", "near"]
# order shares make weights small at low scale; 50 keeps the threshold active there
MIN_WEIGHT = 50.0


def feature_table(spark, sf):
    return ft.build(wh.feature_sources(spark, sf), PLAY_TYPES, REQUIRED, ["far"], MIN_WEIGHT)


_STYLE = """avg(discount) AS ts, avg(qty) AS usg, avg((flag = 'A')::INT) AS ast, avg((flag = 'R')::INT) AS tov, avg(line_no) AS stl,
  avg((status = 'F')::INT) AS blk, avg(price / qty) AS trb, avg(p_retailprice) AS ftr,
  100.0 * (sum(CASE WHEN flag = 'A' THEN rev ELSE 0 END) - sum(CASE WHEN flag = 'R' THEN rev ELSE 0 END)) / sum(rev) AS bpm"""
_NORM = "trim(regexp_replace(regexp_replace(trim(regexp_replace(lower(strip_accents({0})), '[^a-z ]', '', 'g')), '\\b(jr|sr|ii|iii|iv)$', ''), '\\s+', ' ', 'g'))"
FEAT_SQL = ",\n".join([sb.LINES, sb.MEMBERS, f"""tl AS (SELECT lines.*, p_type, p_size, p_retailprice FROM lines JOIN part ON part = p_partkey),
tot AS (SELECT member, season, sum(qty) AS min, sum(rev) AS pts, count(*) AS poss, avg(p_size) AS height FROM tl GROUP BY ALL),
base AS (SELECT t.*, m.name, m.team, {_NORM.format('m.name')} AS norm_name FROM tot t JOIN members m USING (member) WHERE min >= {MIN_WEIGHT}),
brefrows AS (
  SELECT upper(translate(name, 'ue', 'üé')) || ' Jr.' AS player, bref_team, season, ts, usg, ast, tov, stl, blk, trb, ftr, bpm FROM (
    SELECT member, season, status AS bref_team, {_STYLE} FROM tl GROUP BY member, season, status
    UNION ALL SELECT member, season, '2TM', {_STYLE} FROM tl GROUP BY member, season) JOIN members USING (member)),
bref AS (SELECT * FROM (SELECT *, {_NORM.format('player')} AS norm_name,
    row_number() OVER (PARTITION BY {_NORM.format('player')}, season ORDER BY CASE WHEN regexp_matches(bref_team, '^\\dTM$') THEN 0 ELSE 1 END, bref_team) AS rn FROM brefrows) WHERE rn = 1),
shot AS (SELECT {_NORM.format('name')} AS norm_name, season, avg(tax) AS dist, avg((discount <= 0.03)::INT) AS near,
    avg(CASE WHEN flag = 'A' THEN (discount >= 0.08)::INT END) AS far FROM tl JOIN members USING (member) GROUP BY ALL),
pt AS (SELECT member, season, lower(p_type) AS play_type, sum(rev) AS r FROM tl GROUP BY ALL),
ptw AS (SELECT pt.member, pt.season, {", ".join(f"coalesce(avg(CASE WHEN play_type = '{t}' THEN r / pts END), 0) AS playtype_{t}" for t in PLAY_TYPES)}
    FROM pt JOIN tot ON tot.member = pt.member AND tot.season = pt.season GROUP BY ALL),
feat AS (SELECT b.member, b.name, b.team, b.season, b.min, b.pts / b.poss * 100 AS pts_per_100, b.height,
    r.ts, r.usg, r.ast, r.tov, r.stl, r.blk, r.trb, r.ftr, r.bpm, s.dist, s.near, coalesce(s.far, 0) AS far,
    {", ".join(f"coalesce(playtype_{t}, 0) AS playtype_{t}" for t in PLAY_TYPES)}
  FROM base b LEFT JOIN bref r ON r.norm_name = b.norm_name AND r.season = b.season
  LEFT JOIN shot s ON s.norm_name = b.norm_name AND s.season = b.season
  LEFT JOIN ptw w ON w.member = b.member AND w.season = b.season)"""])


@query("feature_table", sb.with_(FEAT_SQL) + f"""SELECT member, season, name, team, {", ".join(f"{s6(c)} AS {c}" for c in FEATURES)}
FROM feat WHERE {" AND ".join(f"{c} IS NOT NULL" for c in REQUIRED)}""")
def feature_table_query(spark, sf):
    """F1 J1 J2 J3 A1 P1-P4 S1 W11."""
    f = ft.complete_cases(feature_table(spark, sf))
    return f.select("member", "season", "name", "team", *[r6(c) for c in FEATURES])


@query("feature_drop_report", sb.with_(FEAT_SQL) + f"""
SELECT season, count(CASE WHEN ok THEN 1 END) AS n_kept, count(CASE WHEN NOT ok THEN 1 END) AS n_dropped FROM
 (SELECT season, {" AND ".join(f"{c} IS NOT NULL" for c in REQUIRED)} AS ok FROM feat) GROUP BY season""")
def feature_drop_report(spark, sf):
    """P4 drop counts."""
    return ft.drop_report(feature_table(spark, sf))


@query("feature_null_gate", sb.with_(FEAT_SQL) + " UNION ALL ".join(
    f'SELECT \'{c}\' AS "column", count(*) - count({c}) AS n_null FROM feat' for c in FEATURES))
def feature_null_gate(spark, sf):
    """Q2."""
    return ft.null_gate(feature_table(spark, sf), FEATURES)


_Z = ", ".join(f"({c} - avg({c}) OVER ()) / stddev_samp({c}) OVER () AS z_{c}" for c in FEATURES)
ZSQL = FEAT_SQL + f""",
zed AS (SELECT member, season, min, team, {_Z}, {", ".join(FEATURES)} FROM feat WHERE {" AND ".join(f"{c} IS NOT NULL" for c in REQUIRED)})"""


@query("feature_zscores", sb.with_(ZSQL) + f"""SELECT member, season, {", ".join(f"{s6('z_' + c)} AS z_{c}" for c in FEATURES)} FROM zed""")
def feature_zscores(spark, sf):
    """A4 B2: z-scores with the sample standard deviation."""
    z = stats.standardize(ft.complete_cases(feature_table(spark, sf)), FEATURES)
    return z.select("member", "season", *[r6(f"{c}_z", f"z_{c}") for c in FEATURES])


_Q = 0.05
_WC = ["usg", "trb", "bpm"]
_CLIP = ", ".join(s6(f"least(greatest({c}, lo_{c}), hi_{c})") + f" AS {c}" for c in _WC)


@query("winsorized_features", sb.with_(FEAT_SQL) + f""",
ok AS (SELECT * FROM feat WHERE {" AND ".join(f"{c} IS NOT NULL" for c in REQUIRED)}),
q AS (SELECT {", ".join(f"quantile_cont({c}, {_Q}) AS lo_{c}, quantile_cont({c}, {1 - _Q}) AS hi_{c}" for c in _WC)} FROM ok)
SELECT member, season, {_CLIP} FROM ok, q""")
def winsorized_features(spark, sf):
    """P8."""
    from blendscope.session import cut_lineage

    f = cut_lineage(ft.complete_cases(feature_table(spark, sf)).select("member", "season", *_WC))
    return stats.winsorize(f, _WC, _Q).select("member", "season", *[r6(c) for c in _WC])


@query("population_window", sb.with_(sb.LINES, sb.MIX) + f"""
SELECT member, season, {s6('min')} AS min FROM mix WHERE min >= 300 AND season >= '1996-97' AND season <= '1999-00'""")
def population_window(spark, sf):
    """P1 SRC3 SRC6: weight threshold and inclusive season range."""
    return ft.population(wh.recipes(spark, sf), 300.0, "1996-97", "1999-00").select("member", "season", r6("min"))


_BREF_LONG = """SELECT member, season, status AS team, sum(qty) AS mp FROM lines GROUP BY ALL
  UNION ALL SELECT member, season, '2TM', sum(qty) FROM lines GROUP BY ALL"""


@query("combined_row_dedup", sb.with_(sb.LINES) + f"""
SELECT member, season, team, {s6('mp')} AS mp FROM (SELECT *, row_number() OVER (PARTITION BY member, season
 ORDER BY CASE WHEN regexp_matches(team, '^\\dTM$') THEN 0 ELSE 1 END, team) AS rn FROM ({_BREF_LONG})) WHERE rn = 1""")
def combined_row_dedup(spark, sf):
    """W11 U2 U3."""
    li = wh.lines(spark, sf)
    rows = li.groupBy("member", "season", F.col("status").alias("team")).agg(F.sum("qty").alias("mp")).unionByName(
        li.groupBy("member", "season").agg(F.sum("qty").alias("mp")).withColumn("team", F.lit("2TM")))
    return relational.prefer_combined(rows, ["member", "season"], "team", ["team"]).select("member", "season", "team", r6("mp"))


@query("onoff_split", sb.with_(sb.LINES, sb.MEMBERS) + f"""
SELECT team, member, season, {s6('o')} AS "on", {s6('f')} AS "off", {s6('o - f')} AS diff FROM (
 SELECT team, member, season, avg(CASE WHEN status = 'O' THEN rev / qty END) AS o, avg(CASE WHEN status = 'F' THEN rev / qty END) AS f
 FROM lines JOIN members USING (member) GROUP BY ALL)""")
def onoff_split(spark, sf):
    """on/off rows to columns and their difference; a missing side stays null."""
    li = wh.lines(spark, sf).join(wh.members(spark, sf), "member")
    rows = li.groupBy("team", "member", "season", F.when(F.col("status") == "O", "on").otherwise("off").alias("court")).agg(
        F.avg(F.col("rev") / F.col("qty")).alias("rating"))
    wide = stats.pivot_first(rows, ["team", "member", "season"], "court", "rating", ["on", "off"], "court")
    return wide.select("team", "member", "season", r6("on"), r6("off"), r6(F.col("on") - F.col("off"), "diff"))


_PE = f"""pe AS (SELECT member, season, {"greatest(" + ", ".join(f"w{i}" for i in range(K)) + ")"} AS purity,
 -({" + ".join(f"greatest(w{i}, 1e-12) * log2(greatest(w{i}, 1e-12))" for i in range(K))}) / log2({K}) AS entropy FROM mix)"""


@query("purity_entropy", sb.with_(sb.LINES, sb.MIX, _PE) + f"""
SELECT member, season, {s6('purity')} AS purity, {s6('entropy')} AS entropy,
 {s6('(rank() OVER (PARTITION BY season ORDER BY round(purity, 9)) - 1) / count(*) OVER (PARTITION BY season)')} AS purity_pct,
 {s6('(rank() OVER (PARTITION BY season ORDER BY round(entropy, 9)) - 1) / count(*) OVER (PARTITION BY season)')} AS entropy_pct FROM pe""")
def purity_entropy(spark, sf):
    """S11 I1 W6."""
    p = idn.purity_entropy(wh.recipes(spark, sf), K)
    return p.select("member", "season", r6("purity"), r6("entropy"), r6("purity_pct"), r6("entropy_pct"))


@query("mixture_entropies", sb.with_(sb.LINES, sb.MIX) + f"""SELECT member, season,
 {s6('exp(-(' + ' + '.join(f'w{i} * ln(w{i} + 1e-12)' for i in range(K)) + '))')} AS effective,
 {s6('exp(-(' + ' + '.join(f'CASE WHEN w{i} > 0 THEN w{i} * ln(w{i}) ELSE 0 END' for i in range(K)) + '))')} AS exp_entropy FROM mix""")
def mixture_entropies(spark, sf):
    """S12 A17 per row."""
    return wh.recipes(spark, sf).select("member", "season", r6(vec.effective_components("recipe", K), "effective"),
                                        r6(vec.exp_entropy("recipe", K), "exp_entropy"))


_FL = f"""fl AS (SELECT member, count(*) AS n_seasons, min(season) AS first_season, max(season) AS last_season,
 {", ".join(f"arg_max(w{i}, season) - arg_min(w{i}, season) AS d{i}, max(w{i}) AS m{i}" for i in range(K))} FROM mix GROUP BY member)"""
_DL = "[" + ", ".join(f"d{i}" for i in range(K)) + "]"


@query("role_drift", sb.with_(sb.LINES, sb.MIX, _FL) + f"""SELECT member, n_seasons, first_season, last_season, n_seasons < 2 AS insufficient,
 CASE WHEN n_seasons >= 2 THEN ({" + ".join(f"(m{i} >= 0.15)::INT" for i in range(K))}) END AS n_major,
 CASE WHEN n_seasons >= 2 THEN list_position({_DL}, list_max({_DL})) - 1 END AS riser, CASE WHEN n_seasons >= 2 THEN {s6(f'100 * list_max({_DL})')} END AS riser_pp,
 CASE WHEN n_seasons >= 2 THEN list_position({_DL}, list_min({_DL})) - 1 END AS faller, CASE WHEN n_seasons >= 2 THEN {s6(f'100 * list_min({_DL})')} END AS faller_pp FROM fl""")
def role_drift(spark, sf):
    """I2 T3."""
    d = idn.drift(wh.recipes(spark, sf), K)
    return d.select("member", "n_seasons", "first_season", "last_season", "insufficient", "n_major", "riser",
                    r6("riser_pp"), "faller", r6("faller_pp"))


@query("season_matrix", sb.with_(sb.LINES, sb.MIX, sb.MIXLONG) + f"""
SELECT member, season, component, {s6('sum(w)')} AS share FROM (
  SELECT member, season, CASE WHEN max(w) OVER (PARTITION BY member, component) >= 0.2 THEN component ELSE -1 END AS component, w FROM mixlong)
GROUP BY ALL""")
def season_matrix(spark, sf):
    """I2 matrix with pooled minor components."""
    return idn.season_matrix(wh.recipes(spark, sf), K, 0.2).select("member", "season", "component", r6("share"))


_TR = f"""tr AS (SELECT m.member, m.season, n.season AS new_season, m.min, n.min AS new_min, {sb.js(sb.cols('m', 'w'), sb.cols('n', 'w'))} AS magnitude
 FROM (SELECT *, lead(season) OVER (PARTITION BY member ORDER BY season) AS nx FROM mix) m JOIN mix n ON n.member = m.member AND n.season = m.nx)"""


@query("season_transitions", sb.with_(sb.LINES, sb.MIX, _TR) + f"SELECT member, season, new_season, {s6('magnitude')} AS magnitude FROM tr")
def season_transitions(spark, sf):
    """W8 I3."""
    return idn.transitions(wh.recipes(spark, sf), K).select("member", "season", "new_season", r6("magnitude"))


_TMIX = f"""tmix AS (SELECT m.*, c.team FROM mix m JOIN (
 SELECT member, season, arg_min(flag, (-q, flag)) AS team FROM (SELECT member, season, flag, sum(qty) AS q FROM lines GROUP BY ALL) GROUP BY ALL) c USING (member, season))"""


@query("transition_team_change", sb.with_(sb.LINES, sb.MIX, _TMIX) + """
SELECT member, season, lead(season) OVER w AS new_season, team <> lead(team) OVER w AS team_changed FROM tmix
WINDOW w AS (PARTITION BY member ORDER BY season) QUALIFY lead(season) OVER w IS NOT NULL""")
def transition_team_change(spark, sf):
    """The unit a member belongs to (here its largest outcome flag) differs between seasons."""
    li = wh.lines(spark, sf).groupBy("member", "season", "flag").agg(F.sum("qty").alias("q"))
    unit = li.groupBy("member", "season").agg(F.min_by("flag", F.struct(-F.col("q"), "flag")).alias("team"))
    t = idn.transitions(wh.recipes(spark, sf).join(unit, ["member", "season"]), K)
    return t.select("member", "season", "new_season", "team_changed")


@query("transition_league", sb.with_(sb.LINES, sb.MIX, _TR) + f""",
f AS (SELECT * FROM tr WHERE min >= 300 AND new_min >= 300),
q AS (SELECT season, new_season, quantile_cont(magnitude, 1.0/3) AS t1, quantile_cont(magnitude, 2.0/3) AS t2 FROM f GROUP BY ALL)
SELECT member, f.season, f.new_season, {s6('magnitude')} AS magnitude,
 {s6('(rank() OVER (PARTITION BY f.season, f.new_season ORDER BY magnitude) - 1) / count(*) OVER (PARTITION BY f.season, f.new_season)')} AS pct,
 CASE WHEN magnitude <= t1 THEN 'stable' WHEN magnitude >= t2 THEN 'major' ELSE 'moderate' END AS label
FROM f JOIN q ON f.season = q.season AND f.new_season = q.new_season""")
def transition_league(spark, sf):
    """I4 J10 W6 W7."""
    t = idn.transition_league(wh.recipes(spark, sf), K)
    return t.select("member", "season", "new_season", r6("magnitude"), r6("pct"), "label")


_EXM = f"""exemplar AS (SELECT component, member, season FROM (SELECT z.member, z.season, m.component, row_number() OVER (PARTITION BY component ORDER BY round(w, 9) DESC, z.member, z.season) AS rn
 FROM mixlong m JOIN zed z USING (member, season)) WHERE rn = 1)"""
_ZL = "zl AS (" + " UNION ALL ".join(
    f"SELECT member, season, {i} AS idx, '{c}' AS feature, {c} AS raw, z_{c} AS z FROM zed" for i, c in enumerate(FEATURES)) + ")"


def zed(spark, sf):
    """member, season, x[p], z[p] of the bound feature table."""
    z = stats.standardize(ft.complete_cases(feature_table(spark, sf)), FEATURES)
    return z.select("member", "season", F.array(*[F.col(c).cast("double") for c in FEATURES]).alias("x"),
                    F.array(*[F.col(f"{c}_z") for c in FEATURES]).alias("z"))


def exemplars(recipes, z):
    """The member-season with the largest share of each component, with its z-scores: k rows; shares tie at 9 digits."""
    rows = recipes.join(z, ["member", "season"]).select("member", "season", "z", F.posexplode("recipe").alias("component", "w"))
    return relational.keep_first(rows, ["component"], [-F.round("w", idn.TIE_DIGITS), "member", "season"])


@query("component_exemplars", sb.with_(ZSQL, sb.MIX, sb.MIXLONG, _EXM) + "SELECT component, member, season FROM exemplar")
def component_exemplars(spark, sf):
    """the real row that stands for each component."""
    return exemplars(wh.recipes(spark, sf), zed(spark, sf)).select("component", "member", "season")


@query("component_description", sb.with_(ZSQL, sb.MIX, sb.MIXLONG, _EXM, _ZL) + f""",
e AS (SELECT component, idx, feature, z FROM exemplar JOIN zl USING (member, season)),
r AS (SELECT *, row_number() OVER (PARTITION BY component ORDER BY z DESC, idx) AS hi, row_number() OVER (PARTITION BY component ORDER BY z, idx) AS lo FROM e)
SELECT component, 'head' AS side, hi AS rank, feature, {s6('z')} AS z FROM r WHERE hi <= 4
UNION ALL SELECT component, 'tail', lo, feature, {s6('z')} FROM r WHERE lo <= 4""")
def component_description(spark, sf):
    """Highest and lowest features of each component."""
    from blendscope.plans import basis as bs

    d = bs.describe(exemplars(wh.recipes(spark, sf), zed(spark, sf)).select("component", "z"), FEATURES, 4)
    return d.select("component", "side", "rank", "feature", r6("z"))


@query("drift_attribution", sb.with_(ZSQL, sb.MIX, sb.MIXLONG, _EXM, _ZL) + f""",
both_ AS (SELECT m.*, lead(m.season) OVER (PARTITION BY m.member ORDER BY m.season) AS nx FROM mix m SEMI JOIN zed z ON z.member = m.member AND z.season = m.season),
mv AS (SELECT a.member, a.season, a.nx AS new_season, [{", ".join(f"round(b.w{i} - a.w{i}, 9)" for i in range(K))}] AS d FROM both_ a JOIN mix b ON b.member = a.member AND b.season = a.nx),
rf AS (SELECT *, list_position(d, list_max(d)) - 1 AS riser, list_position(d, list_min(d)) - 1 AS faller FROM mv),
rows_ AS (SELECT rf.member, rf.season, rf.new_season, riser, faller, o.idx, o.feature, o.z AS zo, n.z - o.z AS dz, r.z AS rz, f.z AS fz
  FROM rf JOIN zl o ON o.member = rf.member AND o.season = rf.season JOIN zl n ON n.member = rf.member AND n.season = rf.new_season AND n.idx = o.idx
  JOIN exemplar er ON er.component = riser JOIN zl r ON r.member = er.member AND r.season = er.season AND r.idx = o.idx
  JOIN exemplar ef ON ef.component = faller JOIN zl f ON f.member = ef.member AND f.season = ef.season AND f.idx = o.idx WHERE round(abs(n.z - o.z), 9) >= 0.3)
SELECT member, season, new_season, riser, faller, feature, {s6('dz')} AS dz, row_number() OVER (PARTITION BY member, season ORDER BY round(abs(dz), 9) DESC, idx) AS rank,
  CASE WHEN round(rz - zo, 9) = 0 THEN false ELSE sign(dz) = sign(rz - zo) END AS toward_riser, CASE WHEN round(zo - fz, 9) = 0 THEN false ELSE sign(dz) = sign(zo - fz) END AS away_from_faller
FROM rows_ QUALIFY row_number() OVER (PARTITION BY member, season ORDER BY round(abs(dz), 9) DESC, idx) <= 5""")
def drift_attribution(spark, sf):
    """I6."""
    from blendscope.session import cut_lineage

    z = cut_lineage(zed(spark, sf))
    mix = wh.recipes(spark, sf)
    a = idn.attribution(z, mix, exemplars(mix, z), FEATURES, K)
    return a.select("member", "season", "new_season", "riser", "faller", "feature", r6("dz"), "rank", "toward_riser", "away_from_faller")


SEASONS = ["1995-96", "1996-97", "1997-98", "1998-99", "1999-00", "2000-01", "2001-02"]


@query("feature_trajectory", sb.with_(ZSQL, _ZL) + f""",
g AS (SELECT DISTINCT member FROM zed), s AS (SELECT unnest({SEASONS}) AS season), f AS (SELECT DISTINCT idx, feature FROM zl)
SELECT g.member, s.season, f.feature, {s6('raw')} AS raw, {s6('z')} AS z
FROM g CROSS JOIN s CROSS JOIN f LEFT JOIN zl ON zl.member = g.member AND zl.season = s.season AND zl.idx = f.idx""")
def feature_trajectory(spark, sf):
    """I7."""
    z = zed(spark, sf)
    t = idn.trajectory(z.select("member", "season", "x"), z.select("member", "season", "z"), FEATURES, SEASONS)
    return t.select("member", "season", "feature", r6("raw"), r6("z"))


_BIO = """bio AS (SELECT x.member, x.season, (19 + floor((balance + 1000.0) / 1000.0) + split_part(season, '-', 1)::INT - 1995)::INT AS age,
 CASE WHEN balance < 0 THEN 'Undrafted' ELSE (1995 + team_id % 7)::VARCHAR END AS draft_year,
 CASE WHEN balance < 0 THEN 'Undrafted' ELSE greatest(1, ceil((10000.0 - balance) / 11000.0 * 60))::INT::VARCHAR END AS draft_number, name, team
 FROM mix x JOIN members USING (member))"""


@query("development_comps", sb.with_(sb.LINES, sb.MIX, sb.MEMBERS, _BIO) + f""",
am AS (SELECT mix.*, age FROM mix JOIN bio USING (member, season)),
nx AS (SELECT member, season, lead(season) OVER (PARTITION BY member ORDER BY season) AS next_season FROM mix),
d AS (SELECT s.member, s.season, c.member AS comp, c.season AS matched_season, c.age AS matched_age, round({sb.js(sb.cols('s', 'w'), sb.cols('c', 'w'))}, 12) AS distance,
   list_position([{", ".join(f"c.w{i}" for i in range(K))}], {"greatest(" + ", ".join(f"c.w{i}" for i in range(K)) + ")"}) - 1 AS top_then, [{", ".join(f"c.w{i}" for i in range(K))}] AS cw
  FROM am s JOIN am c ON c.member <> s.member AND abs(c.age - s.age) <= 1),
r AS (SELECT *, row_number() OVER (PARTITION BY member, season ORDER BY distance, comp, matched_season) AS rank FROM d),
j AS (SELECT r.*, nx.next_season, [{", ".join(f"m.w{i}" for i in range(K))}] AS nw FROM r JOIN nx ON nx.member = r.comp AND nx.season = r.matched_season
   LEFT JOIN mix m ON m.member = r.comp AND m.season = nx.next_season WHERE rank <= 5),
c AS (SELECT *, list_transform(list_zip(nw, cw), lambda x: abs(x[1] - x[2])) AS mv FROM j)
SELECT member, season, rank, comp, matched_season, matched_age, {s6('distance')} AS distance, top_then, next_season,
  CASE WHEN next_season IS NOT NULL THEN list_position(nw, list_max(nw)) - 1 END AS next_top,
  CASE WHEN next_season IS NOT NULL THEN list_position(mv, list_max(mv)) - 1 END AS changed,
  CASE WHEN next_season IS NOT NULL THEN {s6('100 * (nw[list_position(mv, list_max(mv))] - cw[list_position(mv, list_max(mv))])')} END AS changed_pp FROM c""")
def development_comps(spark, sf):
    """I8 J14."""
    mix = wh.recipes(spark, sf).join(wh.bio(spark, sf).select("member", "season", "age"), ["member", "season"])
    mix = cut_lineage(mix)  # read by three branches
    d = idn.development(mix, mix, K)
    return d.select("member", "season", "rank", "comp", "matched_season", "matched_age", r6("distance"), "top_then", "next_season",
                    "next_top", "changed", r6("changed_pp"))


@query("stability_gate", sb.with_(sb.LINES, sb.MIX, sb.MIXLONG) + f""",
b AS (SELECT member, min(min) AS least FROM mix GROUP BY member HAVING count(*) = 7 AND min(min) >= 100 ORDER BY least DESC, member LIMIT 10),
c AS (SELECT member, season, component, row_number() OVER (PARTITION BY member, season ORDER BY w DESC, component) AS rn FROM mixlong)
SELECT b.member, season, {s6('least')} AS least, max(CASE WHEN rn = 1 THEN component END) AS first, max(CASE WHEN rn = 2 THEN component END) AS second,
 max(CASE WHEN rn = 3 THEN component END) AS third FROM b JOIN c USING (member) GROUP BY b.member, season, least""")
def stability_gate(spark, sf):
    """I9."""
    s = idn.stability(wh.recipes(spark, sf), K, 7, 100.0)
    return s.select("member", "season", r6("least"), *[F.col("top")[i]["idx"].alias(n) for i, n in enumerate(("first", "second", "third"))])


@query("season_codes", """SELECT DISTINCT year(o_orderdate) AS start_year, {0} AS season, year(o_orderdate) + 1 AS end_year,
 '0022' || lpad((year(o_orderdate) % 100)::VARCHAR, 2, '0') || lpad((o_orderkey % 100000)::VARCHAR, 5, '0') AS game_id,
 {1} AS game_season FROM orders""".format(sb.season("o_orderdate"),
    "CASE WHEN year(o_orderdate) % 100 >= 90 THEN (2000 + year(o_orderdate) % 100)::VARCHAR || '-' || lpad(((year(o_orderdate) % 100 + 1) % 100)::VARCHAR, 2, '0') ELSE (2000 + year(o_orderdate) % 100)::VARCHAR || '-' || lpad(((year(o_orderdate) + 1) % 100)::VARCHAR, 2, '0') END"))
def season_codes(spark, sf):
    """Season labels, end years and seasons read from game ids."""
    o = wh.table(spark, sf, "orders")
    y = F.year("o_orderdate")
    gid = F.concat(F.lit("0022"), F.lpad((y % 100).cast("string"), 2, "0"), F.lpad((F.col("o_orderkey") % 100000).cast("string"), 5, "0"))
    base = o.select(y.cast("long").alias("start_year"), tx.season_label(y).alias("season"), gid.alias("game_id")).distinct()
    return base.select("start_year", "season", tx.season_end_year("season").cast("long").alias("end_year"), "game_id",
                       tx.season_from_game_id("game_id").alias("game_season"))


@query("rookie_seasons", sb.with_(sb.LINES, sb.MIX, sb.MEMBERS, _BIO) + """
SELECT member, season, try_cast(draft_number AS INT) AS pick FROM bio WHERE try_cast(draft_year AS INT) = split_part(season, '-', 1)::INT""")
def rookie_seasons(spark, sf):
    """Seasons in which the draft year equals the season start."""
    b = wh.bio(spark, sf).where(F.col("draft_year").try_cast("int") == tx.season_start_year("season"))
    return b.select("member", "season", F.col("draft_number").try_cast("int").alias("pick"))


@query("describe_by_team", sb.with_(sb.LINES, sb.MEMBERS, sb.ONCOURT) + f"""
SELECT team, count(net_rating) AS count, {s6('avg(net_rating)')} AS mean, {s6('stddev_samp(net_rating)')} AS std, {s6('min(net_rating)')} AS min, {s6('max(net_rating)')} AS max,
 {s6('quantile_cont(net_rating, 0.25)')} AS q25, {s6('quantile_cont(net_rating, 0.5)')} AS q50, {s6('quantile_cont(net_rating, 0.75)')} AS q75
FROM oncourt JOIN members USING (member) GROUP BY team""")
def describe_by_team(spark, sf):
    """A18."""
    d = stats.describe_by(wh.oncourt(spark, sf).join(wh.members(spark, sf), "member"), ["team"], "net_rating")
    return d.select("team", "count", *[r6(c) for c in ("mean", "std", "min", "max", "q25", "q50", "q75")])
