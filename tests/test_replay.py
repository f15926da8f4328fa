"""A feed whose games are cut anywhere gives the rows of the batch plan."""

import pandas as pd
import pytest

from blendscope import schemas
from blendscope.plans import segments as sg
from blendscope.streaming import live, replay
from test_segments import PLAY, box_rows

END = dict(PLAY[-1], action_no=16, action_type=live.GAME_END, is_field_goal=0, shot_result=None, score_home="", score_away="", description="")
FULL = [*PLAY, END]
NAMES = [f"g{i}" for i in range(len(FULL) + 1)]  # game i is cut after i events


def frame(spark, rows):
    return spark.createDataFrame(pd.DataFrame(rows), schemas.EVENTS) if rows else spark.createDataFrame([], schemas.EVENTS)


def table(df):
    order = sorted(df.columns)
    return sorted(repr([row[c] for c in order]) for row in df.collect())


@pytest.fixture(scope="module")
def tables(spark):
    box = spark.createDataFrame([r for g in NAMES for r in box_rows(g)], schemas.BOX)
    games = spark.createDataFrame([(g, "s", "d", 1, 2) for g in NAMES], schemas.GAMES)
    return box, games


def test_a_game_cut_at_every_event_equals_the_batch_plan(spark, tables, tmp_path):
    box, games = tables
    out = str(tmp_path / "out")
    first = [dict(e, game=g) for i, g in enumerate(NAMES) for e in FULL[:i]]
    again = [dict(e, game=g) for i, g in enumerate(NAMES) for e in FULL[max(i - 2, 0):]]  # the last two events come twice
    got = replay.process(frame(spark, first), box, games, out, 0)
    assert [r.key for r in got.collect()] == [NAMES[-1]]  # only the whole game
    n = replay.published(spark, out, "stints").count()
    replay.process(frame(spark, first), box, games, out, 0)  # the batch runs again
    assert replay.published(spark, out, "stints").count() == n > 0
    replay.process(frame(spark, again), box, games, out, 1)
    want = sg.build(frame(spark, [dict(e, game=g) for g in NAMES for e in PLAY]), box, games)
    for kind in replay.KINDS:
        assert table(replay.published(spark, out, kind)) == table(want[kind]), kind
    assert replay.held(spark, out, 1).count() == 0
    late = dict(FULL[3], game="g3", score_home="90")
    assert replay.process(frame(spark, [late, dict(late, action_no=99)]), box, games, out, 2).count() == 0
    assert table(replay.published(spark, out, "stints")) == table(want["stints"])


def test_failed_games_are_tried_again(spark, tables, tmp_path):
    _, games = tables
    out = str(tmp_path / "out")
    events = frame(spark, [dict(e, game=g) for g in ("g0", "g1") for e in FULL])
    short = spark.createDataFrame(box_rows("g0", 4) + box_rows("g1"), schemas.BOX)
    full = spark.createDataFrame(box_rows("g0") + box_rows("g1"), schemas.BOX)
    first = {r.key: (r.attempt, r.status, r.error) for r in replay.process(events, short, games, out, 0).collect()}
    assert first == {"g0": (1, "failed", "expected five starters per team"), "g1": (1, "ok", None)}
    second = {r.key: (r.attempt, r.status, r.error) for r in replay.process(frame(spark, []), full, games, out, 1).collect()}
    assert second == {"g0": (2, "ok", None)}
    assert {r.game for r in replay.published(spark, out, "stints").select("game").distinct().collect()} == {"g0", "g1"}


def test_stream_of_pieces(spark, tables, tmp_path):
    box, games = tables
    src, out, cp = (str(tmp_path / n) for n in ("in", "out", "cp"))
    rows = [dict(e, game="g5") for e in FULL]
    frame(spark, rows[:7]).coalesce(1).write.parquet(src)
    replay.run(spark, src, box, games, out, cp).awaitTermination(180)
    assert replay.held(spark, out, 0).count() == 7
    frame(spark, rows[5:]).coalesce(1).write.mode("append").parquet(src)
    replay.run(spark, src, box, games, out, cp).awaitTermination(180)
    want = sg.build(frame(spark, [dict(e, game="g5") for e in PLAY]), box, games)
    assert table(replay.published(spark, out, "stints")) == table(want["stints"])
