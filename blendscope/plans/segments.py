"""Cutting ordered event logs into directed segments with line-ups (2.9).

Counting, scores, possession ends and text resolution are joins, aggregates
and chunked ordered scans, so a game never has to sit in one task for them.
Only the on-court state, which depends on itself, is replayed in order per
game, over slim rows that stream through the task.

``events``: game, action_no, period, team, person, action_type, sub_type,
description, shot_result, is_field_goal, shot_value, shot_distance,
score_home, score_away. ``box``: game, team, person, first_name, family_name,
position. ``games``: game, season, date, home_team.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from blendscope.functions import text as tx
from blendscope.operators import ordered
from blendscope.session import cut_lineage

# Action names of the event feed.
SUBSTITUTION, MADE, MISSED = "Substitution", "Made Shot", "Missed Shot"
TURNOVER, FREE_THROW, REBOUND, FOUL = "Turnover", "Free Throw", "Rebound", "Foul"
TECHNICAL = "Free Throw Technical"
ATTRIBUTED = (MADE, MISSED, TURNOVER, FREE_THROW, REBOUND, FOUL)
SIDE = 5
# Event numbers per chunk of the ordered scans.
CHUNK = 256


def with_home(schedule: DataFrame) -> DataFrame:
    """Home flag from the ``X @ Y`` text of any row of the game."""
    code = schedule.withColumn("_code", tx.home_code("matchup"))
    per_game = code.groupBy("game").agg(F.min("_code").alias("home_code"))
    return schedule.join(per_game, "game", "left").withColumn("is_home", F.col("team_code") == F.col("home_code"))


def possession_end(prefix: str = "prev") -> Column:
    """Team whose possession ends on the event, or null (E5).

    Needs the columns of the event and a struct ``prev`` (action_type, team).
    """
    last_ft = tx.is_last_free_throw("sub_type") & (F.coalesce(F.col("sub_type"), F.lit("")) != TECHNICAL)
    missed_before = F.col(f"{prefix}.action_type").isin(MISSED, FREE_THROW)
    return (
        F.when(F.col("action_type").isin(MADE, TURNOVER), F.col("team"))
        .when((F.col("action_type") == FREE_THROW) & last_ft & (F.col("shot_result") == "Made"), F.col("team"))
        .when((F.col("action_type") == REBOUND) & missed_before & (F.col("team") != F.col(f"{prefix}.team")),
              F.col(f"{prefix}.team"))
    )


def ordered_events(events: DataFrame) -> DataFrame:
    """Running segment number, carried score, score change, previous event and possession end."""
    ev = events.withColumn("_chunk", F.floor(F.col("action_no") / CHUNK)).withColumn(
        "_is_sub", F.col("action_type") == SUBSTITUTION)
    has = F.col("score_home").isNotNull() & (F.col("score_home") != "")
    ev = ev.withColumn("_score", F.when(has, F.struct(F.col("score_home").cast("int").alias("h"), F.col("score_away").cast("int").alias("a"))))
    ev = ev.withColumn("_now", F.struct("action_type", "team", "period"))
    one = ordered.ordered_scan(ev, ["game"], ["action_no"], "_chunk", lasts={"_carried": "_score"}, lags={"prev": "_now"})
    first = F.col("prev").isNull()
    cut = ~first & (F.col("_is_sub") | (F.col("period") != F.col("prev.period")))
    one = one.withColumn("_cut", cut.cast("int")).withColumn("possession_end", possession_end())
    two = ordered.ordered_scan(one, ["game"], ["action_no"], "_chunk", sums={"segment": "_cut"}, lags={"_before": "_carried"})
    zero = F.lit(0)
    return two.withColumn("home_points", F.coalesce(F.col("_carried.h"), zero) - F.coalesce(F.col("_before.h"), zero)).withColumn(
        "away_points", F.coalesce(F.col("_carried.a"), zero) - F.coalesce(F.col("_before.a"), zero)
    ).drop("_carried", "_before", "_score", "_now", "_cut", "_is_sub", "_chunk")


def segment_counts(events: DataFrame, games: DataFrame) -> DataFrame:
    """One row per game, segment and team with its counts, before the emission rule.

    ``events`` come from ``ordered_events``.
    """
    home = games.select("game", "home_team", "away_team")
    ev = events.join(home, "game")
    field = F.col("is_field_goal") == 1
    three = F.col("shot_value") == 3
    hit = F.col("shot_result") == "Made"

    def side(team: str, points: str) -> list[Column]:
        own = F.col("team") == F.col(team)
        return [
            F.count_if(F.col("possession_end") == F.col(team)).alias(f"{team}_poss"),
            F.sum(points).alias(f"{team}_points"),
            F.count_if(own & field).alias(f"{team}_fga"), F.count_if(own & field & hit).alias(f"{team}_fgm"),
            F.count_if(own & field & three).alias(f"{team}_fg3a"), F.count_if(own & field & three & hit).alias(f"{team}_fg3m"),
            F.count_if(own & ~F.coalesce(field, F.lit(False)) & (F.col("action_type") == TURNOVER)).alias(f"{team}_tov"),
        ]

    g = ev.groupBy("game", "segment", "home_team", "away_team").agg(*side("home_team", "home_points"), *side("away_team", "away_points"))
    names = ("poss", "points", "fga", "fgm", "fg3a", "fg3m", "tov")

    def directed(off: str, dfn: str, flag: int) -> Column:
        return F.struct(F.col(off).alias("offense_team"), F.col(dfn).alias("defense_team"), F.lit(flag).alias("home_off"),
                        *[F.col(f"{off}_{n}").alias(n) for n in names])

    return g.select("game", "segment", F.explode(F.array(directed("home_team", "away_team", 1), directed("away_team", "home_team", 0))).alias("s")).select(
        "game", "segment", "s.*")


def emit(counts: DataFrame) -> DataFrame:
    """Emission rule: nothing happened -> no row; points without a possession -> one possession."""
    rows = counts.where((F.col("poss") > 0) | (F.col("points") != 0))
    poss = F.greatest(F.col("poss"), F.lit(1))
    return rows.select(
        *[c for c in counts.columns if c not in ("poss", "points", "fga", "fgm", "fg3a", "fg3m", "tov")],
        poss.alias("off_possessions"), F.col("points").alias("off_points"),
        (100.0 * F.col("points") / poss).alias("y_off"),
        *[F.col(c).alias(f"off_{c}") for c in ("fga", "fgm", "fg3a", "fg3m")],
        F.when(F.col("fga") > 0, (F.col("fgm") + 0.5 * F.col("fg3m")) / F.col("fga")).alias("off_efg_pct"),
        F.col("tov").alias("off_tov"), (100.0 * F.col("tov") / poss).alias("off_tov_pct"),
    )


# --- text resolution ----------------------------------------------------------

def resolve_in_game(names: DataFrame, box: DataFrame, keys: list[str], columns: dict[str, str]) -> DataFrame:
    """Player ids of in-game names: family name and, if given, initials; exactly one match or null.

    ``columns`` maps a name column to its id column; all of them share one
    roster join. ``names`` must be unique on (game, keys).
    """
    cells = F.array(*[F.struct(F.lit(out).alias("slot"), F.col(src).alias("name")) for src, out in columns.items()])
    n = names.select(*keys, "game", "team", F.explode(F.filter(cells, lambda c: c["name"].isNotNull())).alias("c"))
    initial, family = tx.split_initial(F.col("c.name"))
    n = n.select(*keys, "game", "team", "c.slot", initial.alias("_initial"), tx.normalize_name(family).alias("_family"))
    roster = box.select("game", "team", F.col("person").alias("_pid"), F.lower("first_name").alias("_first"),
                        tx.normalize_name("family_name").alias("_family"))
    hit = n.join(roster, ["game", "team", "_family"]).where(
        F.col("_initial").isNull() | F.col("_first").startswith(F.col("_initial")))
    ids = []
    for out in columns.values():
        here = F.col("slot") == out
        ids.append(F.when(F.count_if(here) == 1, F.min(F.when(here, F.col("_pid")))).alias(out))
    return names.join(hit.groupBy("game", *keys).agg(*ids), ["game", *keys], "left")


def resolve_texts(events: DataFrame, box: DataFrame) -> DataFrame:
    """Ids named in substitution and assist texts."""
    a, b = tx.substitution_names("description")
    is_sub = F.col("action_type") == SUBSTITUTION
    helped = (F.col("is_field_goal") == 1) & (F.col("shot_result") == "Made")
    ev = events.withColumn("_a", F.when(is_sub, a)).withColumn("_b", F.when(is_sub, b)).withColumn(
        "_assist", F.when(helped, tx.assist_name("description")))
    out = resolve_in_game(ev, box, ["action_no"], {"_a": "sub_a", "_b": "sub_b", "_assist": "assist"})
    return out.drop("_a", "_b", "_assist")


def starters(box: DataFrame) -> DataFrame:
    """Starting ids per game and team, with the count for the five-starter gate."""
    s = box.where(F.trim(F.coalesce(F.col("position"), F.lit(""))) != "")
    return s.groupBy("game", "team").agg(F.count_distinct("person").alias("n_starters"), F.array_sort(F.collect_set("person")).alias("five"))


def game_status(box: DataFrame, games: DataFrame) -> DataFrame:
    """ok, or the reason a game cannot be replayed."""
    t = starters(box).groupBy("game").agg(
        F.count(F.lit(1)).alias("n_teams"), F.count_if(F.col("n_starters") != SIDE).alias("n_bad"))
    return games.join(t, "game", "left").select(
        "game",
        F.when(F.col("n_teams").isNull() | (F.col("n_teams") != 2), "expected two teams in the box score")
        .when(F.col("n_bad") > 0, "expected five starters per team").otherwise("ok").alias("status"))


# --- line-up replay -------------------------------------------------------------

def swap_of(court: set, pair: tuple):
    """(leaver, comer) of a substitution: the one on court leaves. None unless exactly one of two known persons is."""
    inside = [p for p in pair if p in court]
    if None in pair or len(inside) != 1:
        return None
    return inside[0], pair[1] if inside[0] == pair[0] else pair[0]


def openers(rows: list[tuple], carried: set) -> tuple[set, str | None]:
    """Line-up at the start of a period and a note if it is not the carried one.

    ``rows``: (kind, person, a, b) of one team in one period, in order, where kind is "sub" or "act". Who acts before
    they first come in was there from the start; of more than five the first ones count. Open places are filled from
    the carried set in id order.
    """
    present, acts, entries = frozenset(carried), {}, {}
    for at, (kind, person, *pair) in enumerate(rows):
        if kind != "sub":
            acts.setdefault(person, at)
        elif swap := swap_of(present, tuple(pair)):
            present = present - {swap[0]} | {swap[1]}
            entries.setdefault(swap[1], at)
    early = [p for p, at in sorted(acts.items(), key=lambda x: x[1]) if p and at < entries.get(p, len(rows))][:SIDE]
    five = {*early, *sorted(carried - set(early))[: SIDE - len(early)]}
    if five == carried:
        return five, None
    return five, "opening line-up replaced by observed players" if len(early) == SIDE else "opening line-up partly corrected"


class GameReplay:
    """On-court sets of one game, advanced period by period."""

    def __init__(self, five: dict):
        self.court = {t: set(p) for t, p in five.items()}
        self.started = False
        self.segment = 0

    def period(self, rows: list[dict]) -> Iterator[dict]:
        """Line-ups of the segments that start in this period, in order."""
        notes = []
        if self.started:
            self.segment = rows[0]["segment"]
            for t in self.court:
                slim = [("sub" if r["is_sub"] else "act", r["person"], r["a"], r["b"]) for r in rows
                        if r["team"] == t and (r["is_sub"] or r["acts"])]
                self.court[t], note = openers(slim, self.court[t])
                if note:
                    notes.append(f"team {t}: {note}")
        self.started = True
        for r in rows:
            if r["segment"] != self.segment:
                yield self._snapshot(notes)
                notes, self.segment = [], r["segment"]
            if r["is_sub"]:
                court = self.court.get(r["team"])
                move = swap_of(court, (r["a"], r["b"])) if court is not None else None
                if move:
                    court.discard(move[0])
                    court.add(move[1])
                else:
                    notes.append(f"team {r['team']}: substitution at {r['action_no']} skipped")
        yield self._snapshot(notes)

    def _snapshot(self, notes: list[str]) -> dict:
        return {"segment": self.segment, "court": {t: sorted(p) for t, p in self.court.items()}, "notes": "; ".join(notes)}


LINEUP_SCHEMA = "game string, segment long, team long, ids array<bigint>, valid boolean, notes string"


def _int(v):
    return None if pd.isna(v) else int(v)


def _replay(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Replays the games of a partition; rows arrive by game and event order, one period is held at a time."""
    game, current, held, replay = None, None, [], None

    def snapshots():
        for snap in replay.period(held):
            ok = all(len(ids) == SIDE for ids in snap["court"].values())
            yield from ((game, snap["segment"], t, ids, ok, snap["notes"]) for t, ids in snap["court"].items())

    for pdf in batches:
        out = []
        columns = [pdf[c].tolist() for c in _REPLAY_COLUMNS]
        for g, no, period, team, person, segment, sub, acts, a, b, home, away, home_five, away_five in zip(*columns):
            if held and (g != game or period != current):
                out += snapshots()
                held = []
            if g != game:
                game, replay = g, GameReplay({int(home): list(home_five), int(away): list(away_five)})
            current = period
            held.append({"action_no": int(no), "team": _int(team), "person": _int(person), "segment": int(segment),
                         "is_sub": bool(sub), "acts": bool(acts), "a": _int(a), "b": _int(b)})
        yield pd.DataFrame(out, columns=_LINEUP_COLUMNS)
    if held:
        yield pd.DataFrame(list(snapshots()), columns=_LINEUP_COLUMNS)


_REPLAY_COLUMNS = ("game", "action_no", "period", "team", "person", "segment", "is_sub", "acts", "sub_a", "sub_b",
                   "home_team", "away_team", "home_five", "away_five")
_LINEUP_COLUMNS = ["game", "segment", "team", "ids", "valid", "notes"]


def lineup_states(events: DataFrame, box: DataFrame, games: DataFrame) -> DataFrame:
    """On-court set of each team in each segment, with warnings.

    ``events``: ordered and text-resolved. Only events that can change or
    reveal the line-up, and the first event of a segment, are replayed.
    """
    five = starters(box).where(F.col("n_starters") == SIDE)
    ok = games.select("game", "home_team", "away_team")
    ok = ok.join(five.select("game", F.col("team").alias("home_team"), F.col("five").alias("home_five")), ["game", "home_team"])
    ok = ok.join(five.select("game", F.col("team").alias("away_team"), F.col("five").alias("away_five")), ["game", "away_team"])
    slim = events.select(
        "game", "action_no", "period", "team", "person", "segment", "sub_a", "sub_b",
        (F.col("action_type") == SUBSTITUTION).alias("is_sub"),
        F.coalesce(F.col("action_type").isin(*ATTRIBUTED) & (F.col("person") != 0), F.lit(False)).alias("acts"),
        F.col("prev").isNull().alias("is_first"), (F.col("period") != F.col("prev.period")).alias("new_period"))
    slim = slim.where(F.col("is_sub") | F.col("acts") | F.col("is_first") | F.col("new_period"))
    rows = slim.join(ok, "game")
    # whole games per partition, in event order: the function streams through them
    arranged = rows.repartition("game").sortWithinPartitions("game", "action_no")
    return arranged.select(*_REPLAY_COLUMNS).mapInPandas(_replay, LINEUP_SCHEMA)


def numbered(lineups: DataFrame) -> DataFrame:
    """Segments with both line-ups and the running number of valid ones.

    A segment without two full line-ups gets the number the next valid one will carry.
    """
    per = lineups.groupBy("game", "segment").agg(
        F.bool_and("valid").alias("valid"), F.collect_list(F.struct("team", "ids")).alias("sides"),
        F.max("notes").alias("notes"))
    per = per.withColumn("_chunk", F.floor(F.col("segment") / CHUNK)).withColumn("_v", F.col("valid").cast("int"))
    run = ordered.ordered_scan(per, ["game"], ["segment"], "_chunk", sums={"_upto": "_v"})
    stint = F.when(F.col("valid"), F.col("_upto")).otherwise(F.col("_upto") + 1)
    return run.withColumn("stint", stint).drop("_chunk", "_v", "_upto")


def side_of(sides: str, team: Column) -> Column:
    return F.filter(F.col(sides), lambda s: s["team"] == team)[0]["ids"]


def build(events: DataFrame, box: DataFrame, games: DataFrame) -> dict[str, DataFrame]:
    """Segments, event links, line-up warnings and game status of a batch of games."""
    status = game_status(box, games)
    good = games.join(status.where(F.col("status") == "ok"), "game", "left_semi")
    # both tables are read by several outputs
    ev = cut_lineage(resolve_texts(ordered_events(events.join(good.select("game"), "game", "left_semi")), box))
    segs = cut_lineage(numbered(lineup_states(ev, box, good)))
    counts = segment_counts(ev, good)
    rows = emit(counts).join(segs.where("valid").select("game", "segment", "stint", "sides"), ["game", "segment"])
    stints = rows.withColumn("off", side_of("sides", F.col("offense_team"))).withColumn(
        "def", side_of("sides", F.col("defense_team"))).drop("sides")
    stints = stints.join(games.select("game", "season", "date"), "game")
    field = F.col("is_field_goal") == 1
    kind = F.when(field, F.col("action_type")).when(F.col("action_type").isin(TURNOVER, FREE_THROW), F.col("action_type"))
    ft = F.col("action_type") == FREE_THROW
    links = (
        ev.withColumn("_kind", kind).where(F.col("_kind").isNotNull())
        .join(good.select("game", "home_team", "away_team"), "game")
        .where(F.col("team").isin(F.col("home_team"), F.col("away_team")))
        .join(segs.select("game", "segment", "stint", "sides"), ["game", "segment"])
        .select(
            "game", "stint", "segment", "action_no", "team", "person", F.col("_kind").alias("action_type"), "sub_type",
            F.when(field, F.col("shot_distance")).alias("shot_distance"),
            F.when(field, F.col("shot_value")).when(ft, F.lit(1)).alias("shot_value"),
            F.when(field, F.col("shot_result") == "Made").when(ft, ~F.trim(F.coalesce("description", F.lit(""))).startswith("MISS")).alias("made"),
            F.when(field, F.col("assist")).alias("assist"),
            F.coalesce(F.array_contains(side_of("sides", F.col("team")), F.col("person")), F.lit(False)).alias("on_court"),
        )
    )
    notes = segs.where((F.col("notes") != "") | ~F.col("valid")).select("game", "segment", "stint", "valid", "notes")
    return {"stints": stints, "events": links, "warnings": notes, "status": status}


# --- validation -------------------------------------------------------------------

def reconcile(stints: DataFrame, links: DataFrame) -> DataFrame:
    """Points of made events against segment points; missing event rows count as 0."""
    pts = links.where(F.col("made")).groupBy("game", "stint", F.col("team").alias("offense_team")).agg(F.sum("shot_value").alias("event_points"))
    j = stints.join(pts, ["game", "stint", "offense_team"], "left").withColumn("event_points", F.coalesce("event_points", F.lit(0)))
    bad = F.col("event_points") != F.col("off_points")
    return j.agg(F.count(F.lit(1)).alias("n_rows"), F.count_if(bad).alias("n_mismatch"),
                 F.count_if(bad & (F.col("off_points") < 0)).alias("n_negative"))


def final_scores(events: DataFrame) -> DataFrame:
    """Last scored event of each game."""
    e = events.where(F.col("score_home").isNotNull() & (F.col("score_home") != ""))
    last = e.groupBy("game").agg(F.max_by(F.struct("score_home", "score_away"), "action_no").alias("s"))
    return last.select("game", F.col("s.score_home").cast("int").alias("home_final"), F.col("s.score_away").cast("int").alias("away_final"))


def score_check(stints: DataFrame, finals: DataFrame) -> DataFrame:
    """Segment points summed per game against the final score (Q6)."""
    p = stints.groupBy("game").agg(F.sum(F.when(F.col("home_off") == 1, F.col("off_points"))).alias("h"),
                                   F.sum(F.when(F.col("home_off") == 0, F.col("off_points"))).alias("a"))
    j = finals.join(p, "game", "left")
    return j.select("game", "home_final", "away_final", F.coalesce("h", F.lit(0)).alias("home_points"), F.coalesce("a", F.lit(0)).alias("away_points")).withColumn(
        "match", (F.col("home_final") == F.col("home_points")) & (F.col("away_final") == F.col("away_points")))


def pace(stints: DataFrame) -> DataFrame:
    """Possessions per team and per game."""
    return stints.groupBy("offense_team").agg(F.sum("off_possessions").alias("possessions"), F.count_distinct("game").alias("n_games")).withColumn(
        "pace", F.col("possessions") / F.col("n_games"))


def length_distribution(stints: DataFrame, cuts: tuple[int, ...] = (2, 5, 10)) -> DataFrame:
    """Share of segments below each possession count."""
    return stints.agg(F.count(F.lit(1)).alias("n"), *[F.avg((F.col("off_possessions") < c).cast("double")).alias(f"below_{c}") for c in cuts])


def integrity(stints: DataFrame, size: int | None = SIDE) -> DataFrame:
    """Side sizes, repeated ids, overlap of the two sides."""
    def bad(side: str) -> Column:
        d = F.size(F.array_distinct(side))
        wrong = d != F.size(side)
        return wrong | (d != size) if size is not None else wrong

    return stints.agg(F.count(F.lit(1)).alias("n"), F.count_if(bad("off")).alias("bad_off"), F.count_if(bad("def")).alias("bad_def"),
                      F.count_if(F.arrays_overlap("off", "def")).alias("n_overlap"))


def member_boxes(stints: DataFrame, box: DataFrame) -> DataFrame:
    """Per member and game: minutes and box counts of games in which the member was on a side."""
    games = stints.select("game", F.explode(F.concat("off", "def")).alias("person")).distinct()
    b = box.withColumn("min", tx.clock_minutes("minutes")).where(F.col("min") > 0)
    return b.join(games, ["game", "person"], "left_semi")
