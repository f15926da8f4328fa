"""Line-up replay on a small hand-made game."""

import pandas as pd
import pytest

from blendscope import schemas
from blendscope.plans import segments as sg

NAMES = ["Ash", "Birch", "Cedar", "Doum", "Elm", "Fir", "Gum"]


def box_rows(game="g1", n_start=5):
    return [(game, t, t * 10 + i, NAMES[i][0] + "x", NAMES[i], "F" if i < n_start else "") for t in (1, 2) for i in range(7)]


def ev(no, period, team, slot, action, **kw):
    base = dict(game="g1", action_no=no, period=period, team=team, person=team * 10 + slot, action_type=action, sub_type=None, description="",
                shot_result=None, is_field_goal=0, shot_value=0, shot_distance=None, score_home="", score_away="")
    if action in (sg.MADE, sg.MISSED):
        base |= dict(is_field_goal=1, shot_value=2, shot_result="Made" if action == sg.MADE else "Missed", shot_distance=4.0)
    return base | kw


PLAY = [
    ev(1, 1, 1, 0, sg.MADE, score_home="2", score_away="0", description="Ash Shot (2 PTS) (Birch 1 AST)"),
    ev(2, 1, 2, 0, sg.MISSED),
    ev(3, 1, 1, 1, sg.REBOUND),                                   # defensive: team 2's possession ends
    ev(4, 1, 1, 0, sg.FREE_THROW, sub_type="Free Throw 1 of 2", description="Ash Free Throw 1 of 2", score_home="3", score_away="0"),
    ev(5, 1, 1, 5, sg.SUBSTITUTION, description="SUB: Fir FOR Ash"),   # between free throws: points stay in the first segment
    ev(6, 1, 1, 1, sg.FREE_THROW, sub_type="Free Throw 2 of 2", description="MISS Birch Free Throw 2 of 2", shot_result="Missed"),
    ev(7, 1, 1, 2, sg.REBOUND),                                   # offensive: nothing ends
    ev(8, 1, 1, 2, sg.TURNOVER),
    ev(9, 1, 2, 0, sg.SUBSTITUTION, description="SUB: Gum FOR Fir"),   # neither on court: skipped
    ev(10, 1, 2, 1, sg.FREE_THROW, sub_type=sg.TECHNICAL, description="Birch Technical", score_home="3", score_away="1", shot_result="Made"),
    # second period opens with Gum of team 2 on court, although no substitution was logged
    ev(11, 2, 2, 6, sg.MISSED), ev(12, 2, 2, 1, sg.REBOUND), ev(13, 2, 2, 2, sg.MISSED), ev(14, 2, 2, 3, sg.REBOUND), ev(15, 2, 2, 4, sg.MADE, score_home="3", score_away="3"),
]


@pytest.fixture(scope="module")
def built(spark):
    events = spark.createDataFrame(pd.DataFrame(PLAY), schemas.EVENTS)
    box = spark.createDataFrame(box_rows() + box_rows("g2", 4), schemas.BOX)
    games = spark.createDataFrame([("g1", "s", "d", 1, 2), ("g2", "s", "d", 1, 2)], schemas.GAMES)
    return {k: v.toPandas() for k, v in sg.build(events, box, games).items()}


def test_segments(built):
    s = built["stints"].set_index(["segment", "home_off"]).sort_index()
    assert s.loc[(0, 1), "off_points"] == 3 and s.loc[(0, 1), "off_possessions"] == 1
    assert s.loc[(0, 0), "off_points"] == 0 and s.loc[(0, 0), "off_possessions"] == 1 and s.loc[(0, 0), "off_fga"] == 1
    assert list(s.loc[(0, 1), "off"]) == [10, 11, 12, 13, 14] and list(s.loc[(1, 1), "off"]) == [11, 12, 13, 14, 15]
    assert s.loc[(1, 1), "off_tov"] == 1 and s.loc[(1, 1), "off_possessions"] == 1
    assert (1, 0) not in s.index  # no possession and no points
    assert s.loc[(2, 0), "off_points"] == 1 and s.loc[(2, 0), "off_possessions"] == 1  # points without a possession end
    assert list(s.loc[(3, 0), "off"]) == [21, 22, 23, 24, 26]  # opening corrected to the five observed players
    assert s.groupby("home_off")["off_points"].sum().to_dict() == {0: 3, 1: 3}


def test_links_and_warnings(built):
    e = built["events"].set_index("action_no")
    assert e.loc[1, "assist"] == 11 and e.loc[1, "stint"] == 1 and e.loc[6, "stint"] == 2
    assert e.loc[4, "made"] and not e.loc[6, "made"] and e.loc[4, "shot_value"] == 1
    assert pd.isna(e.loc[8, "made"]) and e.loc[11, "on_court"]
    notes = " ".join(built["warnings"]["notes"])
    assert "substitution at 9 skipped" in notes and "replaced by observed" in notes
    status = built["status"].set_index("game")["status"]
    assert status["g1"] == "ok" and "five starters" in status["g2"]


def test_substitution_direction():
    assert sg.swap_of({1, 2}, (1, 3)) == (1, 3) and sg.swap_of({1, 2}, (3, 1)) == (1, 3)
    assert sg.swap_of({1, 2}, (1, 2)) is None and sg.swap_of({1}, (4, 5)) is None and sg.swap_of({1}, (None, 1)) is None


def test_openers():
    carried = {1, 2, 3, 4, 5}
    act = lambda p: ("act", p, None, None)
    assert sg.openers([], carried) == (carried, None)
    assert sg.openers([act(9)], carried) == ({9, 1, 2, 3, 4}, "opening line-up partly corrected")
    assert sg.openers([("sub", None, 9, 1), act(9)], carried) == (carried, None)  # came in before acting
    assert sg.openers([act(p) for p in (6, 7, 8, 9, 10, 1)], carried) == ({6, 7, 8, 9, 10}, "opening line-up replaced by observed players")
    assert sg.openers([act(1), ("sub", None, 1, 9), ("sub", None, 9, 1), act(1)], carried) == (carried, None)


def test_name_resolution_needs_one_match(spark):
    box = spark.createDataFrame([("g", 1, 1, "Franz", "Wagner", "F"), ("g", 1, 2, "Moritz", "Wagner", ""), ("g", 1, 3, "Al", "Mann", "F")], schemas.BOX)
    names = spark.createDataFrame([("g", 1, 1, "F. Wagner"), ("g", 1, 2, "Wagner"), ("g", 1, 3, "Mann"), ("g", 1, 4, "Zed")], "game string, team long, action_no long, n string")
    got = {r.action_no: r.pid for r in sg.resolve_in_game(names, box, ["action_no"], {"n": "pid"}).collect()}
    assert got == {1: 1, 2: None, 3: 3, 4: None}
