"""Queries on partner environments (2.3, 2.6, 2.11)."""

from __future__ import annotations

from pyspark.sql import functions as F

from blendscope import warehouse as wh
from blendscope.functions import vectors as vec
from blendscope.plans import environment as env
from blendscope.session import cut_lineage
from blendscope.suite import SQL, query, r6, s6
from blendscope.suite import sqlbase as sb

K = wh.K


class Tables:
    """The bound inputs of one run, each built once."""

    def __init__(self, spark, sf):
        self.recipes = wh.recipes(spark, sf)
        self.edges = wh.edges(spark, sf)
        self.oncourt = wh.oncourt(spark, sf)
        self.members = wh.members(spark, sf)
        self.exposure = env.exposure(self.edges, self.recipes, K)
        self.blocks = None  # sized by the different mixtures
        self._source, self._kept = (spark, sf), False

    def keep(self, pairs: bool = False):
        """Recipes and exposure are computed once; with ``pairs`` also the pair table, if edges are read besides."""
        if not self._kept:
            self._kept = True
            self.recipes = cut_lineage(self.recipes)
            if pairs:
                self.edges = env.directed_edges(cut_lineage(wh.pairs(*self._source).select("season", "a", "b", "min", "net_rating")))
            self.exposure = cut_lineage(env.exposure(self.edges, self.recipes, K))
        return self

    def bench(self, with_rating=True):
        self.keep()  # read by pool and targets
        return env.benchmark(self.recipes, self.exposure, K, self.oncourt if with_rating else None, blocks=self.blocks)

    def mismatch(self):
        self.keep()  # read by the pool and the comparison
        return env.mismatch(self.exposure, self.bench(), K)


def spread(column: str, prefix: str, k: int = K):
    return [r6(F.col(column)[i], f"{prefix}{i}") for i in range(k)]


def sql_spread(prefix: str, out: str | None = None, k: int = K) -> str:
    return ", ".join(f"{s6(f'{prefix}{i}')} AS {out or prefix}{i}" for i in range(k))


@query("partner_environment_gap", sb.with_(sb.ENVBENCH) + f"""
SELECT member, season, n_pool, {s6('ess')} AS ess, {s6('score')} AS score, {sql_spread('d')} FROM mis""")
def partner_environment_gap(spark, sf):
    """Actual partner environment against that of similar members."""
    m = Tables(spark, sf).mismatch()
    return m.select("member", "season", "n_pool", r6("ess"), r6("score"), *spread("diff", "d"))


@query("recipes_by_member", sb.with_(sb.LINES, sb.MIX) + f"SELECT member, season, {s6('min')} AS min, {sql_spread('w')} FROM mix")
def recipes_by_member(spark, sf):
    return wh.recipes(spark, sf).select("member", "season", r6("min"), *spread("recipe", "w"))


@query("pair_table", sb.with_(sb.LINES, sb.GM, sb.PAIRS) + f"""
SELECT season, a, b, {s6('min')} AS min, {s6('net_rating')} AS net_rating FROM pairs WHERE min >= 20""")
def pair_table(spark, sf):
    """SRC2 S2: pair rows above a weight threshold."""
    p = wh.pairs(spark, sf).where(F.col("min") >= 20)
    return p.select("season", "a", "b", r6("min"), r6("net_rating"))


@query("directed_partners", sb.with_(sb.LINES, sb.GM, sb.PAIRS) + f"""
SELECT season, focal, mate, {s6('min')} AS min FROM edges""")
def directed_partners(spark, sf):
    """Neighbour rows in both directions."""
    return wh.edges(spark, sf).select("season", "focal", "mate", r6("min"))


@query("macro_exposure", sb.with_(sb.ENV) + f"""
SELECT member, season, {s6('mate_min')} AS mate_min, n_mates, n_dropped, {sql_spread('e')} FROM exposure""")
def macro_exposure(spark, sf):
    """X1 X3 J7 SRC20: exposure of every member, dropped partners counted."""
    e = Tables(spark, sf).exposure
    return e.select("member", "season", r6("mate_min"), "n_mates", "n_dropped", *spread("exposure", "e"))


@query("group_exposure", sb.with_(sb.LINES, sb.MIX, sb.GM, sb.LINEUPS) + f""",
flat AS (SELECT season, ids, min, unnest(ids) AS member FROM lineups),
r AS (SELECT f.season, f.ids, f.min, f.member, {", ".join(f"w{i}" for i in range(K))} FROM flat f JOIN mix m ON m.member = f.member AND m.season = f.season),
g AS (SELECT season, ids, {", ".join(f"sum(w{i}) AS g{i}" for i in range(K))} FROM r GROUP BY ALL),
s AS (SELECT r.member, r.season, {", ".join(f"sum(r.min * (g{i} - w{i})) AS s{i}" for i in range(K))}
      FROM r JOIN g ON r.season = g.season AND r.ids = g.ids GROUP BY ALL)
SELECT member, season, {", ".join(s6(f"s{i} / ({' + '.join(f's{j}' for j in range(K))})") + f" AS e{i}" for i in range(K))}
FROM s WHERE {' + '.join(f's{j}' for j in range(K))} > 1e-9""")
def group_exposure(spark, sf):
    """X1 over groups of any size, linear in the member rows."""
    e = env.own_exposure_from_groups(wh.lineups(spark, sf), wh.recipes(spark, sf), K)
    return e.select("member", "season", *spread("exposure", "e"))


@query("similarity_benchmark", sb.with_(sb.ENVBENCH) + f"""
SELECT member, season, n_pool, {s6('ess')} AS ess, {sql_spread('x')}, n_pool_positive, {s6('ess_positive')} AS ess_positive, {sql_spread('p')} FROM bench""")
def similarity_benchmark(spark, sf):
    """X6 with the positive-rated subset."""
    b = Tables(spark, sf).bench()
    return b.select("member", "season", "n_pool", r6("ess"), *spread("expected", "x"), "n_pool_positive",
                    r6("ess_positive"), *spread("expected_positive", "p"))


@query("benchmark_comparison", sb.with_(sb.ENVBENCH) + f""",
l AS ({sb.long_of('mis', {'actual': 'e', 'baseline': 'x', 'baseline_positive': 'p'}, 'member, season')})
SELECT member, season, component, {s6('actual')} AS actual, {s6('baseline')} AS baseline,
       {s6('100 * (actual - baseline)')} AS diff_pp, {s6('100 * (actual - baseline_positive)')} AS diff_pp_positive,
       row_number() OVER (PARTITION BY member, season ORDER BY abs(100 * (actual - baseline)) DESC, component) AS rank
FROM l""")
def benchmark_comparison(spark, sf):
    """Actual against both baselines per component, by absolute difference."""
    c = env.compare(Tables(spark, sf).mismatch(), K)
    return c.select("member", "season", "component", r6("actual"), r6("baseline"), r6("diff_pp"),
                    r6("diff_pp_positive"), "rank")


_TOPMIX = f"""top AS (SELECT member, season, arg_max(component, w - component * 1e-15) AS top_component, max(w) AS concentration
  FROM mixlong GROUP BY ALL)"""


@query("screening_table", sb.with_(sb.ENVBENCH, sb.MIXLONG, sb.MEMBERS, _TOPMIX) + f"""
SELECT m.member, m.season, s.name, s.team, {s6('x.min')} AS min, t.top_component, {s6('t.concentration')} AS concentration,
       {s6('m.score')} AS score, {s6('o.net_rating')} AS net_rating
FROM mis m JOIN mix x USING (member, season) JOIN top t USING (member, season) LEFT JOIN oncourt o USING (member, season)
LEFT JOIN members s ON s.member = m.member""")
def screening_table(spark, sf):
    """One row per member and season."""
    t = Tables(spark, sf)
    s = env.screening(t.recipes, t.mismatch(), t.oncourt, t.members)
    return s.select("member", "season", "name", "team", r6("min"), "top_component", r6("concentration"), r6("score"),
                    r6("net_rating"))


@query("mismatch_quadrants", sb.with_(sb.ENVBENCH) + f""",
s AS (SELECT m.member, m.season, m.score, o.net_rating FROM mis m LEFT JOIN oncourt o USING (member, season)),
q AS (SELECT season, quantile_cont(score, 0.5) AS med_score, quantile_cont(net_rating, 0.5) AS med_rating FROM s GROUP BY season)
SELECT member, s.season, {s6('score')} AS score, {s6('net_rating')} AS net_rating, {s6('med_score')} AS med_score,
       {s6('med_rating')} AS med_rating,
       (CASE WHEN score >= med_score THEN 'mismatched' ELSE 'matched' END) || '-' ||
       (CASE WHEN net_rating >= med_rating THEN 'high' ELSE 'low' END) AS quadrant
FROM s JOIN q ON s.season = q.season WHERE net_rating IS NOT NULL""")
def mismatch_quadrants(spark, sf):
    """X17."""
    t = Tables(spark, sf)
    q = env.quadrants(env.screening(t.recipes, t.mismatch(), t.oncourt, t.members))
    return q.select("member", "season", r6("score"), r6("net_rating"), r6("med_score"), r6("med_rating"), "quadrant")


@query("teammate_lift", sb.with_(sb.ENV, sb.ONCOURT, sb.LIFT) + f"""
SELECT member, season, component, {s6('own_rating')} AS own_rating, {s6('lift')} AS lift, {s6('mass')} AS mass, n_mates FROM lift""")
def teammate_lift(spark, sf):
    """X11."""
    t = Tables(spark, sf)
    l = env.lift(t.edges, t.recipes, t.oncourt, K)
    return l.select("member", "season", "component", r6("own_rating"), r6("lift"), r6("mass"), "n_mates")


@query("evidence_agreement", sb.with_(sb.ENVBENCH, sb.LIFT) + f""",
dl AS ({sb.long_of('mis', {'d': 'd'}, 'member, season')}),
df AS (SELECT member, season, arg_min(component, d + component * 1e-15) AS deficit, min(d) AS deficit_value FROM dl GROUP BY ALL),
lr AS (SELECT *, mass >= 20 AND lift IS NOT NULL AS supported,
       row_number() OVER (PARTITION BY member, season ORDER BY (mass >= 20 AND lift IS NOT NULL) DESC, lift DESC NULLS LAST, component) AS lift_rank FROM lift),
a AS (SELECT member, season, max(deficit) AS deficit, max(deficit_value) AS deficit_value, count(CASE WHEN supported THEN 1 END) AS n_supported,
       max(CASE WHEN supported THEN lift END) - min(CASE WHEN supported THEN lift END) AS lift_range,
       bool_or(supported AND component = deficit AND lift_rank <= 3) AS hit FROM lr JOIN df USING (member, season) GROUP BY ALL)
SELECT member, season, deficit, {s6('deficit_value')} AS deficit_value, n_supported, {s6('lift_range')} AS lift_range,
  CASE WHEN n_supported = 0 THEN 'insufficient' WHEN lift_range < 2 THEN 'flat' WHEN hit THEN 'agree' ELSE 'disagree' END AS verdict FROM a""")
def evidence_agreement(spark, sf):
    """X14."""
    t = Tables(spark, sf).keep(pairs=True)
    a = env.agreement(t.mismatch(), env.lift(t.edges, t.recipes, t.oncourt, K), mass_floor=20.0)
    return a.select("member", "season", "deficit", r6("deficit_value"), "n_supported", r6("lift_range"), "verdict")


@query("top_partners", sb.with_(sb.LINES, sb.MIX, sb.MIXLONG, sb.GM, sb.PAIRS) + f""",
r AS (SELECT e.*, row_number() OVER (PARTITION BY season, focal ORDER BY min DESC, mate) AS rank
      FROM (SELECT e.* FROM edges e SEMI JOIN mix m ON m.member = e.mate AND m.season = e.season) e),
c AS (SELECT member, season, component, w, row_number() OVER (PARTITION BY member, season ORDER BY w DESC, component) AS rn FROM mixlong)
SELECT r.focal AS member, r.season, r.rank, r.mate, {s6('r.min')} AS min, {s6('r.min / o.min')} AS share_of_min,
       c1.component AS first_component, {s6('c1.w')} AS first_share, c2.component AS second_component, {s6('c2.w')} AS second_share
FROM r LEFT JOIN mix o ON o.member = r.focal AND o.season = r.season
JOIN c c1 ON c1.member = r.mate AND c1.season = r.season AND c1.rn = 1
JOIN c c2 ON c2.member = r.mate AND c2.season = r.season AND c2.rn = 2 WHERE rank <= 3""")
def top_partners(spark, sf):
    """X2 W9."""
    t = Tables(spark, sf)
    p = env.micro_profile(t.edges, t.recipes, t.recipes, K)
    return p.select("member", "season", "rank", "mate", r6("min"), r6("share_of_min"),
                    F.col("top")[0]["idx"].alias("first_component"), r6(F.col("top")[0]["share"], "first_share"),
                    F.col("top")[1]["idx"].alias("second_component"), r6(F.col("top")[1]["share"], "second_share"))


@query("strongest_partner", sb.with_(sb.LINES, sb.GM, sb.PAIRS) + f"""
SELECT focal AS member, season, mate AS partner, {s6('min')} AS partner_min FROM (
  SELECT *, row_number() OVER (PARTITION BY season, focal ORDER BY min DESC, mate) AS rn FROM edges) WHERE rn = 1""")
def strongest_partner(spark, sf):
    """T5."""
    return env.strongest_partner(wh.edges(spark, sf)).select("member", "season", "partner", r6("partner_min"))


_COMP = f"""cand AS (SELECT member, season, component, w AS share, row_number() OVER (PARTITION BY season, component ORDER BY w DESC, member) AS rank
  FROM mixlong WHERE w >= 0.22),
comps AS (SELECT c.*, o.net_rating FROM cand c JOIN oncourt o USING (member, season) WHERE rank <= 20 AND net_rating > 0)"""


@query("successful_comparables", sb.with_(sb.LINES, sb.MIX, sb.MIXLONG, sb.ONCOURT, _COMP) + f"""
SELECT member, season, component, rank, {s6('share')} AS share, {s6('net_rating')} AS net_rating FROM comps""")
def successful_comparables(spark, sf):
    """Best 20 by share first, positive rating afterwards."""
    c = env.all_comparables(wh.recipes(spark, sf), wh.oncourt(spark, sf), K, 0.22, 20)
    return c.select("member", "season", "component", "rank", r6("share"), r6("net_rating"))


@query("comparables_benchmark", sb.with_(sb.ENV, sb.MIXLONG, sb.ONCOURT, _COMP) + f"""
SELECT season, component, count(*) AS n, {", ".join(f"{s6(f'avg(e{i})')} AS e{i}" for i in range(K))}
FROM comps JOIN exposure USING (member, season) GROUP BY season, component""")
def comparables_benchmark(spark, sf):
    """X7."""
    t = Tables(spark, sf)
    c = env.comparables_exposure(env.all_comparables(t.recipes, t.oncourt, K, 0.22, 20), t.exposure, K)
    return c.select("season", "component", "n", *[r6(f"e{i}") for i in range(K)])


@query("season_average", sb.with_(sb.ENV) + f"""SELECT season, {s6('sum(mate_min)')} AS weight, {", ".join(f"{s6(f'sum(e{i} * mate_min) / sum(mate_min)')} AS e{i}" for i in range(K))}
FROM exposure GROUP BY season""")
def season_average(spark, sf):
    """Weighted mean exposure of every season."""
    a = env.season_average(Tables(spark, sf).exposure, K)
    return a.select("season", r6("weight"), *[r6(F.col("exposure")[i], f"e{i}") for i in range(K)])


@query("similar_members", sb.with_(sb.LINES, sb.MIX) + f""",
d AS (SELECT t.member, t.season, q.member AS neighbor, round({sb.js(sb.cols('t', 'w'), sb.cols('q', 'w'))}, 12) AS distance
      FROM mix t JOIN mix q ON t.season = q.season AND t.member <> q.member),
r AS (SELECT *, row_number() OVER (PARTITION BY member, season ORDER BY distance, neighbor) AS rank FROM d)
SELECT member, season, rank, neighbor, {s6('1 - distance')} AS similarity FROM r WHERE rank <= 5""")
def similar_members(spark, sf):
    """T2 X16 J15."""
    s = env.similar_members(wh.recipes(spark, sf), K, 5)
    return s.select("member", "season", "rank", "neighbor", r6("similarity"))


_TARGET = [0.7, 0.3, 0.0, 0.0, 0.0, 0.0]


@query("similar_to_hypothesis", sb.with_(sb.LINES, sb.MIX) + f""",
s AS (SELECT member, season, 1 - {sb.js(sb.cols('mix', 'w'), [f'{x}' for x in _TARGET])} AS similarity FROM mix),
r AS (SELECT *, row_number() OVER (PARTITION BY season ORDER BY round(similarity, 12) DESC, member) AS rank FROM s)
SELECT member, season, rank, {s6('similarity')} AS similarity FROM r WHERE rank <= 10""")
def similar_to_hypothesis(spark, sf):
    """T2 J15 for one given mixture."""
    s = env.similar_to_vector(wh.recipes(spark, sf), _TARGET, K, 10)
    return s.select("member", "season", "rank", r6("similarity"))


@query("team_profile", sb.with_(sb.LINES, sb.MIX, sb.MIXLONG, sb.MEMBERS, sb.PROFILE) + f"""
SELECT team, season, component, n_members, {s6('soft_sum')} AS soft_sum, {s6('soft_mean')} AS soft_mean, hard_count FROM profile""")
def team_profile(spark, sf):
    """A11 J12 J19."""
    p = env.team_profile(wh.recipes(spark, sf), wh.members(spark, sf), K)
    return p.select("team", "season", "component", "n_members", r6("soft_sum"), r6("soft_mean"), "hard_count")


@query("league_baseline", sb.with_(sb.LINES, sb.MIX, sb.MIXLONG, sb.MEMBERS, sb.PROFILE, sb.BASELINE) + f"""
SELECT season, component, n_teams, {s6('league_mean')} AS league_mean, {s6('league_sd')} AS league_sd FROM baseline""")
def league_baseline(spark, sf):
    """A10."""
    b = env.league_baseline(env.team_profile(wh.recipes(spark, sf), wh.members(spark, sf), K))
    return b.select("season", "component", "n_teams", r6("league_mean"), r6("league_sd"))


@query("team_gaps", sb.with_(sb.LINES, sb.MIX, sb.MIXLONG, sb.MEMBERS, sb.PROFILE, sb.BASELINE) + f"""
SELECT team, season, component, {s6('soft_mean')} AS soft_mean, hard_count, {s6('(soft_mean - league_mean) / league_sd')} AS z,
  CASE WHEN (soft_mean - league_mean) / league_sd <= -1 THEN 'gap' WHEN (soft_mean - league_mean) / league_sd >= 1 THEN 'redundancy' ELSE 'typical' END AS status
FROM profile JOIN baseline USING (season, component)""")
def team_gaps(spark, sf):
    """X13."""
    p = env.team_profile(wh.recipes(spark, sf), wh.members(spark, sf), K)
    g = env.team_gaps(p, env.league_baseline(p))
    return g.select("team", "season", "component", r6("soft_mean"), "hard_count", r6("z"), "status")


@query("team_gap_summary", sb.with_(sb.ENVBENCH, sb.MEMBERS) + f""",
dl AS ({sb.long_of('mis', {'d': 'd'}, 'member, season')})
SELECT team, season, component, count(CASE WHEN d < 0 THEN 1 END) AS n_short, count(CASE WHEN d > 0 THEN 1 END) AS n_over,
       {s6('sum(d)')} AS total_gap FROM dl JOIN members USING (member) GROUP BY team, season, component""")
def team_gap_summary(spark, sf):
    """Short and over counts."""
    t = Tables(spark, sf)
    g = env.gap_summary(t.mismatch(), t.members, K)
    return g.select("team", "season", "component", "n_short", "n_over", r6("total_gap"))


@query("environment_difference", sb.with_(sb.ENVBENCH) + f""",
l AS ({sb.long_of('bench', {'a': 'x', 'p': 'p'}, 'member, season')})
SELECT member, season, component, {s6('p - a')} AS difference,
       row_number() OVER (PARTITION BY member, season ORDER BY p - a DESC, component) AS rank FROM l WHERE p IS NOT NULL""")
def environment_difference(spark, sf):
    """X18."""
    d = env.environment_difference(Tables(spark, sf).bench(), K)
    return d.select("member", "season", "component", r6("difference"), "rank")


@query("group_performance", sb.with_(sb.LINES, sb.MIX, sb.GM, sb.PAIRS, sb.LINEUPS) + f""",
r AS (SELECT e.season, e.focal, e.mate, row_number() OVER (PARTITION BY season, focal ORDER BY min DESC, mate) AS rank
      FROM (SELECT e.* FROM edges e SEMI JOIN mix m ON m.member = e.mate AND m.season = e.season) e),
t AS (SELECT * FROM r WHERE rank <= 3),
s AS (SELECT season, focal, list_sort([focal, mate]) AS ids FROM t
      UNION ALL SELECT a.season, a.focal, list_sort([a.focal, a.mate, b.mate]) FROM t a JOIN t b ON a.season = b.season AND a.focal = b.focal AND a.rank < b.rank)
SELECT s.season, focal AS member, array_to_string(s.ids, '-') AS group_key, l.size::INT AS size, {s6('l.min')} AS min, {s6('l.net_rating')} AS net_rating
FROM s JOIN lineups l ON l.season = s.season AND l.ids = s.ids""")
def group_performance(spark, sf):
    """X15 J8 S3."""
    g = env.group_performance(wh.edges(spark, sf), wh.recipes(spark, sf), wh.lineups(spark, sf))
    return g.select("season", F.col("focal").alias("member"),
                    F.concat_ws("-", F.transform("ids", lambda x: x.cast("string"))).alias("group_key"),
                    "size", r6("min"), r6("net_rating"))


_TOPC = "list_position([" + ", ".join(f"w{i}" for i in range(K)) + "], greatest(" + ", ".join(f"w{i}" for i in range(K)) + ")) - 1"


@query("case_study", f"""WITH x1 AS ({SQL['macro_exposure']}), x2 AS ({SQL['top_partners']}), x15 AS ({SQL['group_performance']}), x7 AS ({SQL['comparables_benchmark']}),
x8 AS ({SQL['benchmark_comparison']}), r AS ({sb.with_(sb.LINES, sb.MIX)} SELECT member, season, {_TOPC} AS top FROM mix)
SELECT r.member, r.season, r.top, x1.mate_min, x1.n_mates, p.mate AS partner, p.min AS partner_min, coalesce(g.n, 0) AS n_groups, g.best AS best_net,
 coalesce(x7.n, 0) AS n_comparables, CASE r.top {" ".join(f"WHEN {i} THEN x7.e{i}" for i in range(K))} END AS comparables_own, x8.component AS gap_component, x8.diff_pp AS gap_pp
FROM r JOIN x1 USING (member, season) LEFT JOIN (SELECT * FROM x2 WHERE rank = 1) p USING (member, season)
LEFT JOIN (SELECT member, season, count(*) AS n, max(net_rating) AS best FROM x15 GROUP BY ALL) g USING (member, season)
LEFT JOIN x7 ON x7.season = r.season AND x7.component = r.top LEFT JOIN (SELECT * FROM x8 WHERE rank = 1) x8 ON x8.member = r.member AND x8.season = r.season""")
def case_study(spark, sf):
    """Environment, strongest partner, groups, comparables and largest gap of every member and season."""
    t = Tables(spark, sf).keep(pairs=True)
    ranked = cut_lineage(env.ranked_partners(t.edges, t.recipes, 3))  # read by partners and groups
    peers = env.comparables_exposure(env.all_comparables(t.recipes, t.oncourt, K, 0.22, 20), t.exposure, K)
    c = env.case_studies(t.recipes, t.exposure, env.micro_profile(t.edges, t.recipes, t.recipes, K, ranked=ranked),
                         env.group_performance(t.edges, t.recipes, wh.lineups(spark, sf), ranked=ranked), peers, env.compare(t.mismatch(), K), K)
    return c.select(
        "member", "season", "top", r6("environment.mate_min", "mate_min"), "environment.n_mates", F.col("partner.mate").alias("partner"), r6("partner.min", "partner_min"),
        F.coalesce("groups.n", F.lit(0)).alias("n_groups"), r6("groups.net_rating", "best_net"), F.coalesce("comparables.n", F.lit(0)).alias("n_comparables"),
        r6(F.element_at("comparables.exposure", F.col("top") + 1), "comparables_own"), F.col("gap.component").alias("gap_component"), r6("gap.diff_pp", "gap_pp"))


# Variants of one hypothesis: two-component mixtures with shifted weight or another second component.
VARIANTS = ((1, 0, 1, 0.70), (2, 0, 1, 0.85), (3, 0, 1, 0.55), (4, 0, 2, 0.70))


def _variant_vector(p, s, w):
    return [w if i == p else (1 - w if i == s else 0.0) for i in range(K)]


def _variants(spark, seasons):
    rows = F.array(*[
        F.struct(F.lit(-v).cast("long").alias("member"), F.array(*[F.lit(float(x)) for x in _variant_vector(p, s, w)]).alias("recipe"))
        for v, p, s, w in VARIANTS])
    return seasons.select("season", F.explode(rows).alias("t")).select("t.member", "season", "t.recipe")


_VSQL = " UNION ALL ".join(
    f"SELECT {-v} AS variant, " + ", ".join(f"{x}::DOUBLE AS h{i}" for i, x in enumerate(_variant_vector(p, s, w)))
    for v, p, s, w in VARIANTS)
_HYP = f"""hyp AS ({_VSQL}),
hv AS (SELECT h.variant, q.season, power(1 - {sb.js(sb.cols('h', 'h'), sb.cols('q', 'w'))}, 4) AS v, {", ".join(f"x.e{i}" for i in range(K))}
  FROM hyp h CROSS JOIN mix q JOIN exposure x ON x.member = q.member AND x.season = q.season),
hb AS (SELECT variant, season, {", ".join(f"sum(v * e{i}) / sum(v) AS x{i}" for i in range(K))} FROM hv GROUP BY ALL),
hl AS ({sb.long_of('hb', {'expected': 'x'}, 'variant, season')}),
hg AS (SELECT variant, team, season, component, expected - soft_mean AS gap FROM hl JOIN profile USING (season, component)),
tops AS (SELECT variant, team, season, arg_max(component, gap - component * 1e-15) AS top_gap, max(gap) AS gap FROM hg GROUP BY ALL)"""
_HYPSQL = sb.with_(sb.ENV, sb.MIXLONG, sb.MEMBERS, sb.PROFILE, _HYP)


def _hypothesis(spark, sf):
    t = Tables(spark, sf).keep()
    seasons = t.recipes.select("season").distinct()
    b = env.benchmark(t.recipes, t.exposure, K, blocks=t.blocks, targets=_variants(spark, seasons))
    return env.hypothesis_gap(b, env.team_profile(t.recipes, t.members, K), K)


@query("hypothesis_gaps", _HYPSQL + f"SELECT variant, team, season, top_gap, {s6('gap')} AS gap FROM tops")
def hypothesis_gaps(spark, sf):
    """Benchmark of hypothetical mixtures against every team."""
    return _hypothesis(spark, sf).select("variant", "team", "season", "top_gap", r6("gap"))


@query("hypothesis_stability", _HYPSQL + f"""SELECT team, season, count(*) AS n_variants, count(DISTINCT top_gap) AS n_top_gaps,
  {s6('min(gap)')} AS min_gap, {s6('max(gap)')} AS max_gap, count(DISTINCT top_gap) = 1 AS stable FROM tops GROUP BY team, season""")
def hypothesis_stability(spark, sf):
    """K10."""
    s = env.hypothesis_stability(_hypothesis(spark, sf))
    return s.select("team", "season", "n_variants", "n_top_gaps", r6("min_gap"), r6("max_gap"), "stable")
