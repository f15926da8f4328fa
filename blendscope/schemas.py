"""Explicit contracts of the datasets, checked before use."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import types as T

L, D, S, I, B = T.LongType(), T.DoubleType(), T.StringType(), T.IntegerType(), T.BooleanType()
IDS, VEC = T.ArrayType(L), T.ArrayType(D)


def _schema(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(n, t) for n, t in fields.items()])


RECIPES = _schema(member=L, season=S, min=D, recipe=VEC)
PAIRS = _schema(season=S, a=L, b=L, min=D, net_rating=D)
LINEUPS = _schema(season=S, ids=IDS, size=I, min=D, off_rating=D, def_rating=D, net_rating=D)
STINTS = _schema(game=L, season=S, stint=I, home_off=I, off=IDS, **{"def": IDS}, off_possessions=D, off_points=D, y_off=D,
                 off_fga=L, off_fgm=L, off_fg3a=L, off_fg3m=L, off_tov=L)
SKILL = _schema(member=L, skill_off=D, skill_def=D, source=S, vintage=S)
COEFFICIENTS = _schema(feature=S, beta=D, mean=D, sd=D, z_min=D, z_max=D)
MATRIX = _schema(i=I, j=I, value=D)
BASIS = _schema(component=I, z=VEC, member=L, season=S)
EVENTS = _schema(game=S, action_no=L, period=I, team=L, person=L, action_type=S, sub_type=S, description=S, shot_result=S,
                 is_field_goal=I, shot_value=I, shot_distance=D, score_home=S, score_away=S)
BOX = _schema(game=S, team=L, person=L, first_name=S, family_name=S, position=S)
GAMES = _schema(game=S, season=S, date=S, home_team=L, away_team=L)

_COUNTS = T.StructType([T.StructField("made", L), T.StructField("attempted", L)])
_REBOUNDS = T.StructType([T.StructField("total", L)])
_SIDE = T.StructType([T.StructField("fieldGoals", _COUNTS), T.StructField("threePointFieldGoals", _COUNTS),
                      T.StructField("rebounds", _REBOUNDS), T.StructField("possessions", D)])
TEAM_RECORDS = T.StructType([T.StructField("teamId", L), T.StructField("season", I), T.StructField("totalMinutes", D),
                             T.StructField("teamStats", _SIDE), T.StructField("opponentStats", _SIDE)])
PLAYER_RECORDS = T.StructType([
    T.StructField("athleteId", L), T.StructField("name", S), T.StructField("teamId", L), T.StructField("minutes", D),
    T.StructField("points", D), T.StructField("assists", D), T.StructField("steals", D), T.StructField("blocks", D),
    T.StructField("turnovers", D), T.StructField("fieldGoals", _COUNTS), T.StructField("freeThrows", _COUNTS),
    T.StructField("rebounds", _REBOUNDS)])


def require(df: DataFrame, contract: T.StructType, name: str = "table") -> DataFrame:
    """Fail with the full list of missing columns and changed types."""
    have = {f.name: f.dataType for f in df.schema.fields}
    missing = [f.name for f in contract.fields if f.name not in have]
    changed = [f"{f.name}: {have[f.name].simpleString()} instead of {f.dataType.simpleString()}" for f in contract.fields
               if f.name in have and have[f.name].simpleString() != f.dataType.simpleString()]
    if missing or changed:
        raise ValueError(f"{name}: missing {missing}, changed {changed}")
    return df
