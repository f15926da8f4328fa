"""Live segmentation of a running feed, one state per game (E1 with state).

State holds the open segment of a game: its number, period, carried score,
counts and the previous event. A finished segment is emitted as soon as the
event that closes it arrives; the final-period marker or a timeout closes the
game and clears its state.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from blendscope.functions import text as tx
from blendscope.plans.segments import FREE_THROW, MADE, MISSED, REBOUND, SUBSTITUTION, TURNOVER

GAME_END = "Game End"
OUTPUT = ("game string, segment long, offense_team long, off_possessions long, off_points long, off_fga long, off_tov long")
_STATE = ("segment long, period int, score_home long, score_away long, start_home long, start_away long, "
          "poss_home long, poss_away long, fga_home long, fga_away long, tov_home long, tov_away long, "
          "prev_action string, prev_team long, last_action_no long")
FIELDS = [f.split()[0] for f in _STATE.split(", ")]


def possession_team(action: str, last_ft: bool, made: bool, team: int, prev_action: str | None, prev_team: int | None):
    """Team whose possession ends; the same rule as the batch column expression."""
    if action in (MADE, TURNOVER) or (action == FREE_THROW and last_ft and made):
        return team
    if action == REBOUND and prev_action in (MISSED, FREE_THROW) and team != prev_team:
        return prev_team
    return None


def fresh(period: int) -> dict:
    s = {f: 0 for f in FIELDS}
    s |= {"period": period, "prev_action": None, "prev_team": None, "last_action_no": -1}
    return s


def close(game: str, s: dict, home: int, away: int) -> list[tuple]:
    """Rows of the open segment under the emission rule."""
    rows = []
    for side, team in (("home", home), ("away", away)):
        points = s[f"score_{side}"] - s[f"start_{side}"]
        poss = s[f"poss_{side}"]
        if poss > 0 or points != 0:
            rows.append((game, s["segment"], team, max(poss, 1), points, s[f"fga_{side}"], s[f"tov_{side}"]))
    return rows


def advance(game: str, s: dict | None, r, home: int, away: int) -> tuple[dict | None, list[tuple]]:
    """Apply one event; returns the new state (None after the game end) and finished rows."""
    if s is None:
        s = fresh(r.period)
    elif r.action_type == GAME_END:
        return None, close(game, s, home, away)
    out: list[tuple] = []
    first = s["last_action_no"] < 0
    if not first and (r.action_type == SUBSTITUTION or r.period != s["period"]):
        out = close(game, s, home, away)
        s |= {"segment": s["segment"] + 1, "start_home": s["score_home"], "start_away": s["score_away"], "period": r.period}
        s |= {f"{c}_{side}": 0 for c in ("poss", "fga", "tov") for side in ("home", "away")}
    if r.score_home is not None and r.score_home != "":
        s |= {"score_home": int(r.score_home), "score_away": int(r.score_away)}
    side = {home: "home", away: "away"}
    ended = possession_team(r.action_type, bool(r.last_ft), r.shot_result == "Made", r.team, s["prev_action"], s["prev_team"])
    if ended in side:
        s[f"poss_{side[ended]}"] += 1
    if r.team in side:
        s[f"fga_{side[r.team]}"] += int(r.is_field_goal == 1)
        s[f"tov_{side[r.team]}"] += int(r.is_field_goal != 1 and r.action_type == TURNOVER)
    s |= {"prev_action": r.action_type, "prev_team": int(r.team), "last_action_no": int(r.action_no)}
    return s, out


class SegmentProcessor(StatefulProcessor):
    """Keeps the open segment of each game in the state store."""

    def __init__(self, idle_ms: int = 6 * 3600 * 1000):
        self.idle_ms = idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open = handle.getValueState("open", _STATE + ", home long, away long")

    def _store(self, s: dict, home: int, away: int) -> None:
        self.open.update(tuple(s[f] for f in FIELDS) + (home, away))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        s, home, away = None, None, None
        if self.open.exists():
            held = self.open.get()
            s = dict(zip(FIELDS, held[: len(FIELDS)]))
            home, away = held[len(FIELDS):]
        # a micro-batch holds the events of one game that arrived since the last trigger
        batch = pd.concat(list(rows), ignore_index=True).sort_values("action_no")
        out: list[tuple] = []
        over = False
        for r in batch.itertuples(index=False):
            home, away = int(r.home_team), int(r.away_team)
            s, done = advance(key[0], s, r, home, away)
            out += done
            over = s is None
        if over:
            self.open.clear()
        else:
            self._store(s, home, away)
            for t in list(self.handle.listTimers()):
                self.handle.deleteTimer(t)
            self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.idle_ms)
        yield _frame(out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        out = []
        if self.open.exists():
            held = self.open.get()
            s = dict(zip(FIELDS, held[: len(FIELDS)]))
            out = close(key[0], s, held[len(FIELDS)], held[len(FIELDS) + 1])
            self.open.clear()
        yield _frame(out)

    def close(self) -> None:
        pass


def _frame(rows: list[tuple]) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=[f.split()[0] for f in OUTPUT.split(", ")])


def live_segments(events: DataFrame, games: DataFrame) -> DataFrame:
    """Stream of finished directed segments. Needs the RocksDB state store provider."""
    feed = events.withColumn("last_ft", tx.is_last_free_throw("sub_type")).join(
        games.select("game", "home_team", "away_team"), "game")
    cols = ["game", "action_no", "period", "team", "action_type", "shot_result", "is_field_goal", "score_home", "score_away", "last_ft",
            "home_team", "away_team"]
    return feed.select(*[F.col(c) for c in cols]).groupBy("game").transformWithStateInPandas(
        statefulProcessor=SegmentProcessor(), outputStructType=OUTPUT, outputMode="Append", timeMode="ProcessingTime")
