import time

from pyspark.sql import functions as F

from blendscope import gamelog as gl
from blendscope.plans import segments as sg
from blendscope.streaming import ingest, live


def few(df):
    """A handful of games, enough to cover the state transitions."""
    return df.where(F.col("game").rlike("^[0-3]-[01]$"))


def _batch(spark, sf):
    ev = sg.ordered_events(few(gl.events(spark, sf)))
    rows = sg.emit(sg.segment_counts(ev, gl.games(spark, sf)))
    cols = ("game", "segment", "offense_team", "off_possessions", "off_points", "off_fga", "off_tov")
    return sorted(tuple(r) for r in rows.select(*cols).collect())


def test_live_segments_equal_batch(spark, sf, tmp_path):
    ev = few(gl.events(spark, sf))
    end = ev.groupBy("game").agg(F.max("action_no").alias("n"), F.max("period").alias("period")).select(
        "game", (F.col("n") + 1).alias("action_no"), "period", F.lit(0).cast("long").alias("team"), F.lit(live.GAME_END).alias("action_type"))
    full = ev.unionByName(end, allowMissingColumns=True)
    schema = full.schema
    # two files per feed: the first half of the event numbers, then the rest
    cut = ev.agg(F.percentile("action_no", F.lit(0.5))).first()[0]
    src = str(tmp_path / "in")
    full.where(F.col("action_no") <= cut).coalesce(1).write.mode("append").parquet(src)
    time.sleep(1.1)  # file times order the two batches
    full.where(F.col("action_no") > cut).coalesce(1).write.mode("append").parquet(src)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("latestFirst", "false").parquet(src)
    q = (live.live_segments(stream, gl.games(spark, sf)).writeStream.format("memory").queryName("live_out").outputMode("append")
         .option("checkpointLocation", str(tmp_path / "cp")).start())
    # idle timers keep such a query busy, so wait for the rows instead of for the end
    want, deadline = _batch(spark, sf), time.time() + 90
    while time.time() < deadline and spark.table("live_out").count() < len(want):
        time.sleep(0.5)
    q.stop()
    assert q.exception() is None
    got = sorted(tuple(r) for r in spark.table("live_out").collect())
    assert got == want


def test_incremental_run_is_idempotent(spark, sf, tmp_path):
    ev, box, games = few(gl.events(spark, sf)), few(gl.box(spark, sf)), few(gl.games(spark, sf))
    src, out, cp = (str(tmp_path / n) for n in ("in", "out", "cp"))
    first = ev.where(F.col("game").endswith("-0"))
    first.coalesce(1).write.parquet(src)
    ingest.run(spark, src, box, games, out, cp).awaitTermination(180)
    n1 = spark.read.parquet(f"{out}/stints").count()
    ingest.run(spark, src, box, games, out, cp).awaitTermination(180)
    assert spark.read.parquet(f"{out}/stints").count() == n1 > 0
    rest = ingest.pending(games, spark.read.parquet(f"{out}/status"))
    assert rest.count() == games.count() - first.select("game").distinct().count()
    ev.where(F.col("game").endswith("-1")).coalesce(1).write.mode("append").parquet(src)
    ingest.run(spark, src, box, games, out, cp).awaitTermination(180)
    assert spark.read.parquet(f"{out}/stints").count() > n1
    # a batch that is written again replaces itself
    ingest.process(first, box, games, out, 0)
    again = spark.read.parquet(f"{out}/stints").where("batch = 0").count()
    assert again == n1
