"""Queries on sources, ingestion, name resolution, resampling and reports (2.1, 2.3, 2.8, 2.14)."""

from __future__ import annotations

from pyspark.sql import functions as F

from blendscope import warehouse as wh
from blendscope.functions import text as tx
from blendscope.operators import relational, resample
from blendscope.plans import basis as bs
from blendscope.plans import context as cx
from blendscope.plans import environment as env
from blendscope.plans import identity as idn
from blendscope.plans import report as rp
from blendscope.plans import segments as sg
from blendscope.sources import nested, tables
from blendscope.suite import basis as sbs
from blendscope.session import cut_lineage, kept
from blendscope.suite import query, r6, s6
from blendscope.suite import sqlbase as sb
from blendscope.suite.context import _CTX, _EL, _IS, EVENTS_SQL, MIN_POSS
from blendscope.suite.identity import _FL, _NORM, _PE
from blendscope.suite.linear import STINT_SQL

K = wh.K


@query("packed_pair_scan", sb.with_(sb.LINES, sb.GM, sb.PAIRS) + f"""
SELECT season, a, b, {s6('min')} AS min, {s6('net_rating')} AS net_rating FROM pairs WHERE min >= 40""")
def packed_pair_scan(spark, sf):
    """SRC2 S2: packed ids of two-member rows above a threshold."""
    p = wh.pairs(spark, sf).withColumn("group_id", tx.pack_group_ids(F.array("a", "b"))).withColumn("group_quantity", F.lit(2))
    return tables.packed_pairs(p, 40.0).select("season", "a", "b", r6("min"), r6("net_rating"))


@query("packed_group_ids", sb.with_(sb.LINES, sb.GM, sb.LINEUPS) + """SELECT season, '-' || array_to_string(list_reverse(ids), '-') || '-' AS group_id,
 ids[1] AS first, ids[len(ids)] AS last, size::INT AS size FROM lineups""")
def packed_group_ids(spark, sf):
    """S3: ids of any size parsed from the packed text and sorted."""
    l = wh.lineups(spark, sf).select("season", tx.pack_group_ids(F.reverse("ids")).alias("group_id"))
    ids = tx.parse_group_ids("group_id")
    return l.select("season", "group_id", ids[0].alias("first"), F.element_at(ids, -1).alias("last"), F.size(ids).alias("size"))


@query("recipe_invariants", sb.with_(sb.LINES, sb.MIX) + f"""SELECT count(*) + count(CASE WHEN season = '1997-98' THEN 1 END) AS n_rows, count(CASE WHEN season = '1997-98' THEN 1 END) AS n_duplicate_keys,
 count(CASE WHEN abs((CASE WHEN season = '1998-99' THEN 1.1 ELSE 1 END) * ({' + '.join(f'w{i}' for i in range(K))}) - CASE WHEN season = '1999-00' THEN w{K - 1} ELSE 0 END - 1) > 1e-3 THEN 1 END) AS n_bad_sum,
 count(CASE WHEN season = '1999-00' THEN 1 END) AS n_wrong_length FROM mix""")
def recipe_invariants(spark, sf):
    """SRC9: a table with repeated keys in one season, sums off by a tenth in the next and a component short in a third."""
    r = wh.recipes(spark, sf)
    spoilt = (
        F.when(F.col("season") == "1998-99", F.transform("recipe", lambda x: x * 1.1))
        .when(F.col("season") == "1999-00", F.slice("recipe", 1, K - 1)).otherwise(F.col("recipe"))
    )
    bad = r.select("member", "season", spoilt.alias("recipe"))
    return tables.recipe_invariants(bad.unionByName(bad.where(F.col("season") == "1997-98")), K)


@query("season_ratings", sb.with_(sb.LINES, sb.ONCOURT) + f"SELECT member, season, {s6('net_rating')} AS rating_on FROM oncourt WHERE season IN ('1996-97', '1999-00')")
def season_ratings(spark, sf):
    """SRC5 SRC6 SRC29."""
    return tables.oncourt(tables.seasons(wh.oncourt(spark, sf), "1996-97", "1999-00")).select("member", "season", r6("rating_on"))


@query("missing_slices", sb.with_(sb.LINES) + """SELECT i.season, i.flag, i.n FROM (SELECT season, flag, count(*) AS n FROM lines GROUP BY ALL) i
WHERE NOT EXISTS (SELECT 1 FROM lines t WHERE t.flag = i.flag AND t.season = i.season AND t.season < '1998-99')""")
def missing_slices(spark, sf):
    """SRC13 SRC14: slices not in the target yet."""
    li = wh.lines(spark, sf)
    incoming = li.groupBy("season", "flag").agg(F.count(F.lit(1)).alias("n"))
    return relational.missing_slices(incoming, li.where(F.col("season") < "1998-99"), ["season", "flag"])


@query("season_sample", sb.with_(sb.LINES) + """SELECT game, line_no, part FROM lines WHERE season = '1997-98'
ORDER BY md5(game::VARCHAR || '|' || line_no::VARCHAR || '|' || part::VARCHAR || '|' || member::VARCHAR), game::VARCHAR, line_no::VARCHAR, part::VARCHAR LIMIT 500""")
def season_sample(spark, sf):
    """SRC15: reproducible 500-row sample of a season."""
    li = wh.lines(spark, sf).where(F.col("season") == "1997-98")
    return tables.sample(li, 500, [F.col(c).cast("string") for c in ("game", "line_no", "part", "member")]).select("game", "line_no", "part")


@query("reference_dimension", sb.with_(sb.MEMBERS) + "SELECT DISTINCT member, name, team FROM members")
def reference_dimension(spark, sf):
    """SRC23 J21."""
    return tables.reference_dimension(wh.members(spark, sf))


@query("nested_records", f"""SELECT user_id, count(*) AS n, {s6("avg((props::JSON->>'k')::INT)")} AS mean_k, max((props::JSON->>'k')::INT) AS max_k FROM events GROUP BY user_id""")
def nested_records(spark, sf):
    """SRC22: fields of JSON records."""
    e = nested.json_column(wh.table(spark, sf, "events"), "props", "k int")
    return e.groupBy("user_id").agg(F.count(F.lit(1)).alias("n"), r6(F.avg("k"), "mean_k"), F.max("k").alias("max_k"))


@query("published_slice", sb.with_(sb.LINES, sb.GM, sb.LINEUPS) + f"""SELECT array_to_string(ids, '-') AS ids, {s6('min')} AS min FROM lineups WHERE size = 2 AND season = '1998-99'""")
def published_slice(spark, sf):
    """SRC19: group rows of one size and season."""
    l = wh.lineups(spark, sf).where((F.col("size") == 2) & (F.col("season") == "1998-99"))
    return l.select(F.concat_ws("-", F.transform("ids", lambda x: x.cast("string"))).alias("ids"), r6("min"))


_ACC = "upper(translate(c_name, 'uo', 'üö')) || ' III'"


@query("normalized_names", f"""WITH n AS (SELECT c_custkey, {_ACC.replace("c_name", "translate(c_name, '#0123456789', ' abcdefghij')")} AS raw FROM customer)
SELECT c_custkey, {_NORM.format('raw')} AS norm FROM n""")
def normalized_names(spark, sf):
    """S1."""
    c = wh.table(spark, sf, "customer")
    plain = F.translate("c_name", "#0123456789", " abcdefghij")
    raw = F.concat(F.upper(F.translate(plain, "uo", "üö")), F.lit(" III"))
    return c.select("c_custkey", tx.normalize_name(raw).alias("norm"))


@query("name_resolution", sb.with_(sb.MEMBERS) + f""",
w AS (SELECT c_custkey AS row_id, upper('Supplier ' || right(translate(c_name, '#0123456789', ' abcdefghij'), 9)) || ' Jr.' AS wanted FROM customer),
t AS (SELECT {_NORM.format('name')} AS norm, count(DISTINCT member) AS n, min(member) AS member FROM members GROUP BY 1)
SELECT row_id, CASE WHEN coalesce(n, 0) = 1 THEN member END AS member, coalesce(n, 0) AS n_candidates, CASE coalesce(n, 0) WHEN 1 THEN 'resolved' WHEN 0 THEN 'missing' ELSE 'ambiguous' END AS status
FROM w LEFT JOIN t ON t.norm = {_NORM.format('wanted')}""")
def name_resolution(spark, sf):
    """Names to ids, missing and ambiguous ones marked."""
    c = wh.table(spark, sf, "customer")
    tail = F.substring(F.translate("c_name", "#0123456789", " abcdefghij"), -9, 9)
    wanted = c.select(F.col("c_custkey").alias("row_id"), F.concat(F.upper(F.concat(F.lit("Supplier "), tail)), F.lit(" Jr.")).alias("wanted"))
    return relational.resolve_names(wanted, wh.members(spark, sf), "wanted", "name", "member").select("row_id", "member", "n_candidates", "status")


@query("nearest_weight_row", sb.with_(sb.LINES, sb.MIX) + f"""SELECT member, season, {s6('min')} AS min FROM (
 SELECT *, row_number() OVER (PARTITION BY member ORDER BY abs(min - 2100), season) AS rn FROM mix) WHERE rn = 1""")
def nearest_weight_row(spark, sf):
    """The member row nearest to a hint."""
    return relational.nearest_row(wh.recipes(spark, sf), ["member"], "min", F.lit(2100.0), ["season"]).select("member", "season", r6("min"))


@query("debut_seasons", sb.with_(sb.LINES, sb.MIX) + f"SELECT member, min(season) AS season, {s6('arg_min(min, season)')} AS min FROM mix GROUP BY member")
def debut_seasons(spark, sf):
    """J16 U3."""
    return relational.debut_rows(wh.recipes(spark, sf), "member", "season").select("member", "season", r6("min"))


@query("member_games", sb.with_(sb.LINES, STINT_SQL) + """
SELECT DISTINCT game, season, unnest(list_concat(off, def)) AS member FROM stints""")
def member_games(spark, sf):
    """I12 P7 U5."""
    return idn.member_games(wh.stints(spark, sf))


@query("member_boxes", sb.with_(sb.LINES, STINT_SQL) + f"""SELECT l.game, l.member AS person, {s6('sum(l.qty) + 0.5')} AS min, count(*) AS fga
FROM lines l WHERE l.member % 5 <> 0 AND (l.game, l.member) IN (SELECT (game, unnest(list_concat(off, def))) FROM stints) GROUP BY ALL""")
def member_boxes(spark, sf):
    """Box rows with playing time, given as mm:ss, of the games in which the member was on a side."""
    box = wh.lines(spark, sf).groupBy("game", F.col("member").alias("person")).agg(F.sum("qty").cast("int").cast("string").alias("q"), F.count("*").alias("fga"))
    clock = F.when(F.col("person") % 5 == 0, F.lit("0:00")).otherwise(F.concat("q", F.lit(":30")))
    b = sg.member_boxes(wh.stints(spark, sf), box.select("game", "person", clock.alias("minutes"), "fga"))
    return b.select("game", "person", r6("min"), "fga")


@query("clock_minutes", f"""SELECT event_id, {s6("floor(value)::INT + (event_id % 60) / 60.0")} AS minutes, 0.0::DOUBLE AS blank FROM events""")
def clock_minutes(spark, sf):
    """Mm:ss texts to decimal minutes."""
    raw = F.concat(F.floor("value").cast("string"), F.lit(":"), F.lpad(F.pmod("event_id", F.lit(60)).cast("string"), 2, "0"))
    e = wh.table(spark, sf, "events").select("event_id", raw.alias("raw"))
    return e.select("event_id", r6(tx.clock_minutes("raw"), "minutes"), tx.clock_minutes(F.lit("")).alias("blank"))


_BX = """bx AS (SELECT member, season, game, sum(qty) AS min, sum(rev) / 1000.0 AS pts, count(*) AS fga, count(CASE WHEN line_no = 7 THEN 1 END) AS fta, count(CASE WHEN flag = 'R' THEN 1 END) AS tov FROM lines GROUP BY ALL)"""
DRAWS = 500
_MASK = resample.MASK


def _boxes(spark, sf):
    return wh.lines(spark, sf).groupBy("member", "season", "game").agg(
        F.sum("qty").alias("min"), (F.sum("rev") / 1000.0).alias("pts"), F.count(F.lit(1)).alias("fga"),
        F.count_if(F.col("line_no") == 7).alias("fta"), F.count_if(F.col("flag") == "R").alias("tov"))


def _seed():
    return F.col("member") * 10_000 + F.substring("season", 1, 4).cast("long")


@query("bootstrap_draw_sums", sb.with_(sb.LINES, _BX) + f""",
nx AS (SELECT *, row_number() OVER (PARTITION BY member, season ORDER BY game) - 1 AS pos, count(*) OVER (PARTITION BY member, season) AS n,
  (member * 10000 + left(season, 4)::BIGINT) & {_MASK} AS x FROM bx),
m1 AS (SELECT member, season, n, (({resample.mix_sql('x')}) + pos) & {_MASK} AS x FROM nx),
m2 AS (SELECT member, season, n, ({resample.mix_sql('x')}) AS x FROM m1),
m3 AS (SELECT member, season, n, b AS draw, (x + b) & {_MASK} AS x FROM m2 CROSS JOIN (SELECT unnest(range(1, {DRAWS + 1})) AS b)),
pk AS (SELECT member, season, draw, (({resample.mix_sql('x')}) * n) >> 32 AS pos, count(*) AS c FROM m3 GROUP BY ALL)
SELECT pk.member, pk.season, draw::INT AS draw, sum(c)::BIGINT AS n_games, {", ".join(f"{s6(f'sum({c} * c)')} AS {c}" for c in rp.BOX)}
FROM pk JOIN nx ON nx.member = pk.member AND nx.season = pk.season AND nx.pos = pk.pos GROUP BY ALL""")
def bootstrap_draw_sums(spark, sf):
    """Box sums of every member and season over games drawn n of n."""
    s = rp.draw_sums(cut_lineage(_boxes(spark, sf)), ["member", "season"], DRAWS, _seed())
    return s.select("member", "season", "draw", "n_games", *[r6(c) for c in rp.BOX])


@query("bootstrap_bands")
def bootstrap_bands(spark, sf):
    """Component bands over the draws on a fitted basis."""
    pop, b = sbs.fitted(spark, sf)
    bands = rp.bootstrap_bands(cut_lineage(_boxes(spark, sf)), pop, b, ["member", "season"], DRAWS, _seed())
    return bands.select("member", "season", "component", "n_draws", r6("low"), r6("high"))


@query("roster_display", sb.with_(sb.LINES, sb.MIX, sb.MIXLONG, sb.MEMBERS) + f""",
c AS (SELECT member, season, component, w, row_number() OVER (PARTITION BY member, season ORDER BY w DESC, component) AS rn FROM mixlong)
SELECT m.member, s.season, m.name, {s6('x.min')} AS min, x.member IS NOT NULL AS has_data, a.component AS first, {s6('a.w')} AS first_share, b.component AS second
FROM members m CROSS JOIN (SELECT DISTINCT season FROM mix) s LEFT JOIN mix x ON x.member = m.member AND x.season = s.season
 LEFT JOIN c a ON a.member = m.member AND a.season = s.season AND a.rn = 1 LEFT JOIN c b ON b.member = m.member AND b.season = s.season AND b.rn = 2""")
def roster_display(spark, sf):
    """The rosters of all seasons."""
    mix = cut_lineage(wh.recipes(spark, sf))
    m = wh.members(spark, sf)
    roster = m.select("member", "name").join(F.broadcast(mix.select("season").distinct()))  # one row per season
    t = rp.roster_table(roster, m.select("member", "team"), mix.select("member", "season", "min"), mix, K, keys=("member", "season"))
    return t.select("member", "season", "name", r6("min"), "has_data", F.try_element_at("top", F.lit(1))["idx"].alias("first"),
                    r6(F.try_element_at("top", F.lit(1))["share"], "first_share"), F.try_element_at("top", F.lit(2))["idx"].alias("second"))


@query("member_report", sb.with_(sb.ENVBENCH, sb.MEMBERS, _PE, _FL.replace("fl AS", "dr AS"), *_CTX[2:], EVENTS_SQL, _IS, _EL) + f"""
SELECT x.member, x.season, s.name, s.team, {s6('pe.purity')} AS purity, {s6('mis.score')} AS mismatch, mis.n_pool,
 CASE WHEN dr.n_seasons >= 2 THEN {s6('100 * list_max([' + ", ".join(f"dr.d{i}" for i in range(K)) + '])')} END AS riser_pp, coalesce({s6('el.spread_pp')}, 0) AS spread_pp
FROM mix x JOIN members s USING (member) JOIN pe USING (member, season) LEFT JOIN dr ON dr.member = x.member LEFT JOIN mis ON mis.member = x.member AND mis.season = x.season
LEFT JOIN el ON el.member = x.member AND el.season = x.season""")
def member_report(spark, sf):
    """M7: the nested report record of every member and season, shown by its main fields."""
    from blendscope.suite.environment import Tables

    t = Tables(spark, sf)
    t.edges = env.directed_edges(kept(wh.pairs(spark, sf).select("season", "a", "b", "min", "net_rating")))  # read by exposure and lift
    t.keep()  # before any branch reads recipes
    el = cx.elasticity(cx.individual_sensitivity(wh.stints(spark, sf), wh.stint_events(spark, sf), t.recipes, K, MIN_POSS))
    r = rp.member_reports(t.recipes, t.members.select("member", "name", "team"), idn.purity_entropy(t.recipes, K), idn.drift(t.recipes, K),
                          t.mismatch(), env.lift(t.edges, t.recipes, t.oncourt, K), el, K)
    return r.select("member", "season", "player.name", "player.team", r6("concentration.purity", "purity"), r6("environment.mismatch", "mismatch"),
                    "environment.n_pool", r6("drift.riser_pp", "riser_pp"), r6(F.coalesce("elasticity.spread_pp", F.lit(0.0)), "spread_pp"))


@query("component_labels", sb.with_(sb.LINES, sb.MIX, sb.MIXLONG, sb.MEMBERS) + """,
e AS (SELECT component, member FROM (SELECT *, row_number() OVER (PARTITION BY component ORDER BY w DESC, member, season) AS rn FROM mixlong) WHERE rn = 1)
SELECT component, e.member, CASE component WHEN 0 THEN 'thrift' WHEN 3 THEN 'promotion' ELSE name END AS label FROM e JOIN members USING (member)""")
def component_labels(spark, sf):
    """Curated label or exemplar name."""
    rows = wh.recipes(spark, sf).select("member", "season", F.posexplode("recipe").alias("component", "w"))
    ex = relational.keep_first(rows, ["component"], [-F.col("w"), "member", "season"]).select("component", "member")
    curated = spark.createDataFrame([(0, "thrift", "good", None), (3, "promotion", "fair", None)], "component int, label string, quality string, note string")
    return bs.labels(ex, curated, wh.members(spark, sf)).select("component", "member", "label")
