"""Resumable processing of newly arrived games.

Event files stream in; every micro-batch with complete games is segmented by
the batch plan and written to three sinks. A sink folder is split by batch and
a batch overwrites only its own folder, so a batch that is run again after a
lost driver leaves the same rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from blendscope import schemas
from blendscope.plans import segments

SINKS = ("stints", "events", "warnings", "status")


def write_batch(df: DataFrame, path: str, batch_id: int) -> None:
    df.withColumn("batch", F.lit(batch_id)).write.mode("overwrite").option(
        "partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(path)


def process(events: DataFrame, box: DataFrame, games: DataFrame, out: str, batch_id: int) -> None:
    """Segment the games contained in ``events``; failures become status rows and do not stop the batch."""
    here = games.join(events.select("game").distinct(), "game", "left_semi")
    built = segments.build(events, box, here)
    for name in SINKS:
        write_batch(built[name], f"{out}/{name}", batch_id)


def run(spark: SparkSession, source: str, box: DataFrame, games: DataFrame, out: str, checkpoint: str, **options) -> StreamingQuery:
    """Process everything that has arrived since the last run, then stop."""
    stream = spark.readStream.schema(schemas.EVENTS)
    for k, v in options.items():
        stream = stream.option(k, v)
    return (
        stream.parquet(source).writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True)
        .foreachBatch(lambda df, batch_id: process(df, box, games, out, batch_id)).start()
    )


def pending(games: DataFrame, status: DataFrame) -> DataFrame:
    """Games without a successful status yet: what a rerun has to do."""
    done = status.where(F.col("status") == "ok").select("game").distinct()
    return games.join(done, "game", "left_anti")
