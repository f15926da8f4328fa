"""Published slices, round trips and small table helpers."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from blendscope import schemas
from blendscope.functions import text as tx
from blendscope.functions import vectors as vec
from blendscope.operators import relational as rl
from blendscope.plans import environment as env
from blendscope.plans import features, identity
from blendscope.sources import nested, tables


@pytest.fixture(scope="module")
def recipes(spark):
    rows = [(m, s, 10.0 * m, [0.1 * m, 1 - 0.1 * m]) for m in range(1, 7) for s in ("2000-01", "2001-02")]
    return spark.createDataFrame(rows, schemas.RECIPES)


def test_periods_slices_and_maps(spark):
    a, b = spark.createDataFrame([(1, "x")], "id int, v string"), spark.createDataFrame([(1,), (2,)], "id int")
    both = rl.union_periods({"p1": a, "p2": b}, "period")
    assert sorted((r.id, r.v or "", r.period) for r in both.collect()) == [(1, "", "p2"), (1, "x", "p1"), (2, "", "p2")]
    assert rl.slice_exists(both, period="p2", id=2) and not rl.slice_exists(both, period="p3")
    assert rl.distinct_map(both, "id").count() == 2
    report = spark.createDataFrame([("teams", 3, 10, 0.3)], "dimension string, n_missing int, n_ids int, missing_share double")
    rl.refuse_missing(report, 0.5)
    with pytest.raises(ValueError, match="3 of 10"):
        rl.refuse_missing(report, 0.2)


def test_head_and_tail(spark):
    df = spark.createDataFrame([("k", i) for i in range(6)], "k string, v int")
    got = rl.head_and_tail(df, ["k"], F.col("v"), F.col("v").desc(), 2).collect()
    assert sorted((r.side, r.v) for r in got) == [("head", 0), ("head", 1), ("tail", 4), ("tail", 5)]


def test_column_functions(spark):
    df = spark.createDataFrame([("6-11", [3.0, 4.0], [0.0, 0.0], 0.5), (None, [1.0, 1.0], [1.0, 1.0], 0.0)], "h string, a array<double>, b array<double>, d double")
    rows = df.select(tx.height_inches("h").alias("h"), vec.euclidean_similarity("a", "b").alias("s"), vec.similarity_weight("d").alias("w")).collect()
    assert [r.h for r in rows] == [83, None] and [r.s for r in rows] == [1 / 6, 1.0] and [r.w for r in rows] == [0.0625, 1.0]


def test_null_gate_and_season_slice(spark, recipes):
    features.require_no_nulls(recipes, ["min"])
    with pytest.raises(ValueError, match="null features"):
        features.require_no_nulls(recipes.withColumn("min", F.when(F.col("member") > 1, F.col("min"))), ["min"])
    assert identity.season_slice(recipes, "2000-01").count() == 6


def test_comparables_rank_before_the_rating_filter(spark, recipes):
    ratings = recipes.select("member", "season", F.when(F.col("member") == 1, -1.0).otherwise(1.0).alias("net_rating"))
    got = env.comparables(recipes, ratings, 1, threshold=0.55, top_n=3)
    assert sorted({r.member for r in got.collect()}) == [2, 3]  # member 1 leads, is filtered and not replaced


def test_published_folder_round_trip(spark, recipes, tmp_path):
    root = str(tmp_path / "folder")
    recipes.write.parquet(f"{root}/recipes")
    ratings = recipes.select("member", "season", F.lit(1.5).alias("net_rating"), F.lit("x").alias("extra"))
    tables.publish(ratings, f"{root}/oncourt", F.col("season") == "2000-01", ["member", "net_rating"])
    spark.createDataFrame([(0, "guard")], "component int, label string").write.parquet(f"{root}/labels")
    got = tables.bundle(spark, root, 2)
    assert got["recipes"].count() == 12 and got["oncourt"].columns == ["member", "net_rating"] and got["oncourt"].count() == 6
    spoilt = recipes.withColumn("recipe", F.array(F.lit(1.0)))
    spoilt.write.parquet(f"{root}/spoilt")
    with pytest.raises(ValueError, match="n_wrong_length"):
        tables.recipes(spark, f"{root}/spoilt", 2)


def test_season_of_segments(spark, tmp_path):
    names = schemas.STINTS.fieldNames()
    row = dict.fromkeys(names, 1) | {"season": "2000-01", "off": [1], "def": [2], "off_possessions": 1.0, "off_points": 2.0, "y_off": 200.0}
    parts = spark.createDataFrame([tuple((row | {"game": g, "season": s})[n] for n in names) for g, s in ((1, "2000-01"), (2, "2000-01"), (3, "2001-02"))], schemas.STINTS)
    schedule = spark.createDataFrame([(1, "2000-01"), (3, "2001-02")], "game long, season string")
    path = str(tmp_path / "season")
    tables.combine_season(parts, schedule, "2000-01", path, str(tmp_path / "sample"), 10)
    assert [r.game for r in spark.read.parquet(path).collect()] == [1] and spark.read.parquet(str(tmp_path / "sample")).count() == 1
    parts.write.parquet(str(tmp_path / "all"))
    assert tables.stints(spark, str(tmp_path / "all")).count() == 3


def test_matrix_round_trip_and_player_records(spark, tmp_path):
    m = np.array([[1.0, -2.0], [0.5, 0.0]])
    tables.save_matrix(spark, m, str(tmp_path / "m"))
    assert np.array_equal(tables.load_matrix(spark, str(tmp_path / "m")), m)
    (tmp_path / "p.json").write_text('{"athleteId": 7, "name": "A", "teamId": 1, "minutes": 3.5, "points": 2.0, "fieldGoals": {"made": 1, "attempted": 2}, "rebounds": {"total": 4}}')
    r = nested.player_records(spark, str(tmp_path / "p.json")).first()
    assert (r.member, r.fgm, r.fga, r.fta, r.trb, r.pts) == (7, 1, 2, None, 4, 2.0)
