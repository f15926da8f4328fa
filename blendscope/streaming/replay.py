"""Replay of a feed whose games arrive in pieces.

A micro-batch may end anywhere inside a game. Events of games that are not over yet are held in a table of their own,
one version per batch; when the end of a game has arrived, its events are replayed once, by the batch plan, and
published through the run ledger. Repeated events count once, events of a published game are late and change nothing,
and games that fail (a box score without five starters) are tried again with every later batch. A batch that runs
again after a loss reads the version before it and leaves the same rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from blendscope import schemas
from blendscope.operators import relational
from blendscope.plans import segments
from blendscope.session import cut_lineage
from blendscope.sources import ledger
from blendscope.sources.ledger import Ledger
from blendscope.streaming.live import GAME_END

KINDS = ("stints", "events", "warnings")


def held_path(out: str, batch_id: int) -> str:
    return f"{out}/open/{batch_id:08d}"


def held(spark: SparkSession, out: str, batch_id: int) -> DataFrame:
    """Events of unfinished games after a batch; none before the first."""
    if batch_id < 0:
        return spark.createDataFrame([], schemas.EVENTS)
    return spark.read.schema(schemas.EVENTS).parquet(held_path(out, batch_id))


def build_games(events: DataFrame, box: DataFrame, games: DataFrame, due: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows of the games in ``due`` as one keyed table, and the state of those that cannot be replayed."""
    keys = due.select(F.col("key").alias("game"))
    here = games.join(keys, "game", "left_semi")
    built = segments.build(events.join(keys, "game", "left_semi"), box, here)
    frames = {k: built[k].select(F.col("game").alias("key"), F.lit(k).alias("kind"), F.struct("*").alias(k)) for k in KINDS}
    rows = None
    for k, f in frames.items():
        full = f.select("key", "kind", *[F.col(k) if k == c else F.lit(None).cast(frames[c].schema[c].dataType).alias(c) for c in KINDS])
        rows = full if rows is None else rows.unionByName(full)
    known = built["status"].select(F.col("game").alias("key"), "status")
    state = due.join(known, "key", "left").select("key", F.coalesce("status", F.lit("not in the schedule")).alias("error"))
    return rows, state.select("key", F.when(F.col("error") == "ok", ledger.OK).otherwise(ledger.FAILED).alias("status"), "error")


def process(events: DataFrame, box: DataFrame, games: DataFrame, out: str, batch_id: int) -> DataFrame:
    """One micro-batch; the ledger entries of the games that it finished or tried again."""
    spark, book = events.sparkSession, Ledger(events.sparkSession, f"{out}/ledger")
    done = book.entries().where(F.col("status") == ledger.OK).select(F.col("key").alias("game"))
    known = held(spark, out, batch_id - 1).withColumn("_new", F.lit(0)).unionByName(
        events.select(*[f.name for f in schemas.EVENTS]).withColumn("_new", F.lit(1)))
    fresh = known.join(done, "game", "left_anti")
    once = cut_lineage(relational.keep_first(fresh, ["game", "action_no"], ["_new", "action_type"]).drop("_new"))
    over = once.where(F.col("action_type") == GAME_END).select("game").distinct()
    whole = once.join(over, "game", "left_semi").where(F.col("action_type") != GAME_END)
    ran = book.run(ledger.digests(whole, "game"), lambda due: build_games(whole, box, games, due))
    published = book.entries().where(F.col("status") == ledger.OK).select(F.col("key").alias("game"))
    once.join(published, "game", "left_anti").write.mode("overwrite").parquet(held_path(out, batch_id))
    return ran


def run(spark: SparkSession, source: str, box: DataFrame, games: DataFrame, out: str, checkpoint: str, **options) -> StreamingQuery:
    """Process everything that has arrived since the last run, then stop."""
    stream = spark.readStream.schema(schemas.EVENTS)
    for k, v in options.items():
        stream = stream.option(k, v)
    return (
        stream.parquet(source).writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True)
        .foreachBatch(lambda df, batch_id: process(df, box, games, out, batch_id) and None).start()
    )


def published(spark: SparkSession, out: str, kind: str) -> DataFrame:
    """Stints, events or warnings of all published games."""
    return Ledger(spark, f"{out}/ledger").rows().where(F.col("kind") == kind).select(f"{kind}.*")
