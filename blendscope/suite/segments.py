"""Queries on event segmentation and its validation (2.9)."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from blendscope import gamelog as gl
from blendscope import warehouse as wh
from blendscope.plans import segments as sg
from blendscope.session import checkpoint_dir, cut_lineage
from blendscope.sources import ledger
from blendscope.sources.ledger import Ledger
from blendscope.suite import query, r6, s6
from blendscope.suite import sqlbase as sb

_N = "['Arden', 'Brook', 'Colt', 'Dumas', 'Ember', 'Frost', 'Grove']"
PBP = f"""raw AS (SELECT user_id::VARCHAR || '-' || floor(date_diff('day', DATE '2024-01-01', ts::DATE) / 7)::INT::VARCHAR AS game,
  floor(date_diff('day', DATE '2024-01-01', ts::DATE) / 7)::INT AS week,
  event_id AS action_no, event_type, round(value * 100)::BIGINT AS cents, floor((date_diff('day', DATE '2024-01-01', ts::DATE) % 7) / 2)::INT AS period FROM events),
p0 AS (SELECT *, 1 + (cents // 10) % 2 AS team, cents % 7 AS slot, (cents // 3) % 2 = 0 AS turn FROM raw),
p1 AS (SELECT *, event_type = 'purchase' OR (event_type = 'error' AND NOT turn AND cents % 3 <> 0) AS made, event_type IN ('purchase', 'view') AS fg,
  CASE WHEN (cents // 5) % 3 = 0 THEN 3 ELSE 2 END AS val,
  CASE event_type WHEN 'signup' THEN 'Substitution' WHEN 'purchase' THEN 'Made Shot' WHEN 'view' THEN 'Missed Shot' WHEN 'click' THEN 'Rebound'
    ELSE CASE WHEN turn THEN 'Turnover' ELSE 'Free Throw' END END AS action_type, (cents // 11) % 2 + 1 AS ftn FROM p0),
p2 AS (SELECT *, CASE WHEN made THEN CASE WHEN fg THEN val ELSE 1 END ELSE 0 END AS pts,
  lag(action_type) OVER w AS pa, lag(team) OVER w AS pt, lag(period) OVER w AS pp FROM p1 WINDOW w AS (PARTITION BY game ORDER BY action_no)),
pbp AS (SELECT *, sum(CASE WHEN pp IS NOT NULL AND (action_type = 'Substitution' OR period <> pp) THEN 1 ELSE 0 END) OVER (PARTITION BY game ORDER BY action_no) AS segment,
  CASE WHEN action_type IN ('Made Shot', 'Turnover') THEN team WHEN action_type = 'Free Throw' AND ftn = 2 AND made THEN team
       WHEN action_type = 'Rebound' AND pa IN ('Missed Shot', 'Free Throw') AND team <> pt THEN pt END AS pe FROM p2),
cnt AS (SELECT game, segment, t AS team, count(CASE WHEN pe = t THEN 1 END) AS poss, sum(CASE WHEN team = t THEN pts ELSE 0 END) AS points,
  count(CASE WHEN team = t AND fg THEN 1 END) AS fga, count(CASE WHEN team = t AND fg AND made THEN 1 END) AS fgm,
  count(CASE WHEN team = t AND fg AND val = 3 THEN 1 END) AS fg3a, count(CASE WHEN team = t AND fg AND val = 3 AND made THEN 1 END) AS fg3m,
  count(CASE WHEN team = t AND action_type = 'Turnover' THEN 1 END) AS tov FROM pbp CROSS JOIN (SELECT unnest([1, 2]) AS t) GROUP BY game, segment, t)"""


@query("possession_ends", sb.with_(PBP) + """SELECT game, action_no, segment::BIGINT AS segment, action_type, team::BIGINT AS team, pe::BIGINT AS possession_end FROM pbp""")
def possession_ends(spark, sf):
    """Running segment and the team whose possession ends."""
    e = sg.ordered_events(gl.events(spark, sf))
    return e.select("game", "action_no", F.col("segment").cast("long").alias("segment"), "action_type", "team", "possession_end")


@query("event_segments", sb.with_(PBP) + f"""SELECT game, segment::BIGINT AS segment, team::BIGINT AS offense_team, greatest(poss, 1)::BIGINT AS off_possessions, points::BIGINT AS off_points,
 {s6('100.0 * points / greatest(poss, 1)')} AS y_off, fga AS off_fga, fgm AS off_fgm, fg3a AS off_fg3a, fg3m AS off_fg3m, tov AS off_tov,
 CASE WHEN fga > 0 THEN {s6('(fgm + 0.5 * fg3m) / fga')} END AS off_efg_pct FROM cnt WHERE poss > 0 OR points <> 0""")
def event_segments(spark, sf):
    """E1 without line-ups: W3 W4 E5 and the emission rule."""
    ev = sg.ordered_events(gl.events(spark, sf))
    s = sg.emit(sg.segment_counts(ev, gl.games(spark, sf)))
    return s.select("game", F.col("segment").cast("long").alias("segment"), "offense_team", F.col("off_possessions").cast("long").alias("off_possessions"),
                    F.col("off_points").cast("long").alias("off_points"), r6("y_off"), "off_fga", "off_fgm", "off_fg3a", "off_fg3m", "off_tov", r6("off_efg_pct"))


@query("final_scores", sb.with_(PBP) + """SELECT game, sum(CASE WHEN team = 1 THEN pts ELSE 0 END)::INT AS home_final, sum(CASE WHEN team = 2 THEN pts ELSE 0 END)::INT AS away_final
FROM pbp GROUP BY game HAVING count(CASE WHEN made THEN 1 END) > 0""")
def final_scores(spark, sf):
    """A24 W4."""
    return sg.final_scores(gl.events(spark, sf))


def _built(spark, sf):
    return sg.build(gl.events(spark, sf), gl.box(spark, sf), gl.games(spark, sf))


@query("lineup_replay")
def lineup_replay(spark, sf):
    """Directed segments with both line-ups from the replay."""
    s = _built(spark, sf)["stints"]
    text = lambda c: F.concat_ws("-", F.transform(c, lambda x: x.cast("string"))).alias(c)
    return s.select("season", "game", "stint", "offense_team", "home_off", text("off"), text("def"), "off_possessions", "off_points", r6("y_off"))


_OTHER = "((cents // 7) % 7)"


@query("event_links", sb.with_(PBP) + f"""SELECT game, action_no, team::BIGINT AS team, (team * 10 + slot)::BIGINT AS person, action_type,
  CASE WHEN fg THEN (cents % 30)::DOUBLE END AS shot_distance, CASE WHEN fg THEN val WHEN action_type = 'Free Throw' THEN 1 END AS shot_value,
  CASE WHEN fg OR action_type = 'Free Throw' THEN made END AS made,
  CASE WHEN action_type = 'Made Shot' AND slot <> {_OTHER} THEN (team * 10 + {_OTHER})::BIGINT END AS assist, segment::BIGINT AS segment
FROM pbp WHERE fg OR action_type IN ('Turnover', 'Free Throw')""")
def event_links(spark, sf):
    """Attributed events with the assisting member."""
    e = _built(spark, sf)["events"]
    return e.select("game", "action_no", "team", "person", "action_type", "shot_distance", "shot_value", "made", "assist", F.col("segment").cast("long").alias("segment"))


@query("replay_warnings")
def replay_warnings(spark, sf):
    """Skipped substitutions, corrected openings and incomplete line-ups per game."""
    w = _built(spark, sf)["warnings"]
    return w.groupBy("game").agg(F.count(F.lit(1)).alias("n_warnings"), F.count_if(~F.col("valid")).alias("n_invalid"))


@query("game_status", sb.with_(PBP) + """SELECT DISTINCT game, CASE WHEN week % 5 = 0 THEN 'expected two teams in the box score'
 WHEN week % 5 = 1 THEN 'expected five starters per team' ELSE 'ok' END AS status FROM raw""")
def game_status(spark, sf):
    """Box scores of which some weeks lack a team and some a starter."""
    week = F.split("game", "-")[1].cast("int")
    box = gl.box(spark, sf).where((week % 5 != 0) | (F.col("team") != 2))
    missing = (week % 5 == 1) & (F.col("person") % 10 == 0)
    box = box.withColumn("position", F.when(missing, F.lit("")).otherwise(F.col("position")))
    return sg.game_status(box, gl.games(spark, sf))


@query("run_ledger", sb.with_(PBP) + """, n AS (SELECT game, count(CASE WHEN poss > 0 OR points <> 0 THEN 1 END) AS n FROM cnt GROUP BY game)
SELECT DISTINCT game, CASE WHEN week % 5 < 2 THEN 2 ELSE 1 END AS attempt, CASE WHEN week % 5 = 1 THEN 'failed' ELSE 'ok' END AS status,
 CASE WHEN week % 5 = 1 THEN 0 ELSE n END AS n_rows, CASE WHEN week % 5 = 1 THEN 'expected five starters per team' END AS error,
 CASE WHEN week % 5 = 1 THEN 0 ELSE n END AS n_published FROM raw JOIN n USING (game)""")
def run_ledger(spark, sf):
    """E10 SRC13 SRC14: two runs over all games; the second one finds the missing teams, but not the missing starters."""
    week = F.split("game", "-")[1].cast("int")
    games, full = gl.games(spark, sf), gl.box(spark, sf)
    no_starter = full.withColumn("position", F.when((week % 5 == 1) & (F.col("person") % 10 == 0), F.lit("")).otherwise(F.col("position")))
    no_team = no_starter.where((week % 5 != 0) | (F.col("team") != 2))
    ev = cut_lineage(sg.ordered_events(gl.events(spark, sf)))
    book = Ledger(spark, f"{checkpoint_dir(spark)}/ledger-{uuid.uuid4().hex}")
    wanted = ledger.digests(ev.select("game", "action_no"), "game")

    def compute(box):
        def job(due):
            keys = due.select(F.col("key").alias("game"))
            state = sg.game_status(box, games.join(keys, "game", "left_semi")).select(F.col("game").alias("key"), F.col("status").alias("error"))
            rows = sg.emit(sg.segment_counts(ev.join(keys, "game", "left_semi"), games)).withColumn("key", F.col("game"))
            return rows, state.select("key", F.when(F.col("error") == "ok", ledger.OK).otherwise(ledger.FAILED).alias("status"), "error")
        return job

    book.run(wanted, compute(no_team))
    book.run(wanted, compute(no_starter))
    seen = book.rows().groupBy("key").agg(F.count("*").alias("n_published"))
    return book.entries().join(seen, "key", "left").select(
        F.col("key").alias("game"), "attempt", "status", "n_rows", "error", F.coalesce("n_published", F.lit(0)).alias("n_published"))


@query("segment_reconciliation", sb.with_(PBP) + """, s AS (SELECT * FROM cnt WHERE poss > 0 OR points <> 0),
e AS (SELECT game, segment, team, sum(pts) AS ep FROM pbp WHERE made GROUP BY ALL)
SELECT count(*) AS n_rows, count(CASE WHEN coalesce(ep, 0) <> points THEN 1 END) AS n_mismatch, count(CASE WHEN coalesce(ep, 0) <> points AND points < 0 THEN 1 END) AS n_negative
FROM s LEFT JOIN e USING (game, segment, team)""")
def segment_reconciliation(spark, sf):
    """Points of the attributed events against segment points."""
    s = sg.emit(sg.segment_counts(sg.ordered_events(gl.events(spark, sf)), gl.games(spark, sf))).withColumn("stint", F.col("segment"))
    links = _built(spark, sf)["events"].where("made").select("game", F.col("segment").alias("stint"), "team", "shot_value", "made")
    return sg.reconcile(s, links)


@query("score_check", sb.with_(PBP) + """, f AS (SELECT game, sum(CASE WHEN team = 1 THEN pts ELSE 0 END)::INT AS home_final, sum(CASE WHEN team = 2 THEN pts ELSE 0 END)::INT AS away_final
FROM pbp GROUP BY game HAVING count(CASE WHEN made THEN 1 END) > 0),
p AS (SELECT game, sum(CASE WHEN team = 1 THEN points END)::BIGINT AS h, sum(CASE WHEN team = 2 THEN points END)::BIGINT AS a FROM cnt WHERE poss > 0 OR points <> 0 GROUP BY game)
SELECT game, home_final, away_final, coalesce(h, 0) AS home_points, coalesce(a, 0) AS away_points, home_final = coalesce(h, 0) AND away_final = coalesce(a, 0) AS match
FROM f LEFT JOIN p USING (game)""")
def score_check(spark, sf):
    """Q6: every game's segment points equal its final score."""
    ev = cut_lineage(gl.events(spark, sf))
    s = sg.emit(sg.segment_counts(sg.ordered_events(ev), gl.games(spark, sf)))
    return sg.score_check(s, sg.final_scores(ev))


@query("segment_pace", sb.with_(PBP) + f"""SELECT team::BIGINT AS offense_team, sum(greatest(poss, 1))::BIGINT AS possessions, count(DISTINCT game) AS n_games,
 {s6('sum(greatest(poss, 1)) / count(DISTINCT game)')} AS pace FROM cnt WHERE poss > 0 OR points <> 0 GROUP BY team""")
def segment_pace(spark, sf):
    """A14 Q6."""
    s = sg.emit(sg.segment_counts(sg.ordered_events(gl.events(spark, sf)), gl.games(spark, sf)))
    return sg.pace(s).select("offense_team", "possessions", "n_games", r6("pace"))


@query("segment_lengths", sb.with_(PBP) + f"""SELECT count(*) AS n, {", ".join(f"{s6(f'avg((greatest(poss, 1) < {c})::INT)')} AS below_{c}" for c in (2, 5, 10))} FROM cnt WHERE poss > 0 OR points <> 0""")
def segment_lengths(spark, sf):
    """A15 Q6."""
    s = sg.emit(sg.segment_counts(sg.ordered_events(gl.events(spark, sf)), gl.games(spark, sf)))
    return sg.length_distribution(s).select("n", *[r6(f"below_{c}") for c in (2, 5, 10)])


@query("segment_integrity", sb.with_(sb.LINES, """sm AS (SELECT DISTINCT game, status, member FROM lines),
side AS (SELECT game, status, list(member) AS ids FROM sm GROUP BY ALL)""") + """
SELECT count(*) AS n, count(CASE WHEN len(list_distinct(o.ids)) <> len(o.ids) THEN 1 END) AS bad_off, count(CASE WHEN len(list_distinct(d.ids)) <> len(d.ids) THEN 1 END) AS bad_def, count(CASE WHEN list_has_any(o.ids, d.ids) THEN 1 END) AS n_overlap
FROM side o JOIN side d ON o.game = d.game AND o.status <> d.status""")
def segment_integrity(spark, sf):
    """Distinct ids per side and overlap of the sides."""
    return sg.integrity(wh.stints(spark, sf), None)


@query("schedule_home", f"""WITH t AS (SELECT o_orderkey AS game, c_nationkey AS home, (c_nationkey + 1 + o_orderkey % 24) % 25 AS away FROM orders JOIN customer ON c_custkey = o_custkey),
r AS (SELECT game, 'T' || home::VARCHAR AS team_code, 'T' || away::VARCHAR || ' @ T' || home::VARCHAR AS m, home FROM t
  UNION ALL SELECT game, 'T' || away::VARCHAR, 'T' || away::VARCHAR || ' @ T' || home::VARCHAR, home FROM t)
SELECT game, team_code, team_code = 'T' || home::VARCHAR AS is_home FROM r""")
def schedule_home(spark, sf):
    """Home flag of both rows of a game from the away team's text."""
    o = wh.table(spark, sf, "orders").join(wh.table(spark, sf, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_nationkey"), "o_custkey")
    away = F.pmod(F.col("c_nationkey") + 1 + F.pmod("o_orderkey", F.lit(24)), F.lit(25)).cast("int")
    h, a = F.concat(F.lit("T"), F.col("c_nationkey").cast("string")), F.concat(F.lit("T"), away.cast("string"))
    rows = F.array(F.struct(h.alias("team_code"), F.concat(h, F.lit(" vs. "), a).alias("matchup")),
                   F.struct(a.alias("team_code"), F.concat(a, F.lit(" @ "), h).alias("matchup")))
    s = o.select(F.col("o_orderkey").alias("game"), F.explode(rows).alias("r")).select("game", "r.*")
    return sg.with_home(s).select("game", "team_code", "is_home")
