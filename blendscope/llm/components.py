"""Connected components of an edge table by alternating large and small stars, all in shuffles with map-side combine."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from blendscope.llm.shared import discard, stored


def _stars(edges: DataFrame) -> DataFrame:
    """One large-star and one small-star step over edges ``hi > lo``."""
    both = edges.select(F.col("hi").alias("u"), F.col("lo").alias("v")).unionByName(edges.select(F.col("lo").alias("u"), F.col("hi").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    large = both.filter("v > u").join(least, "u").select(F.col("v").alias("hi"), F.col("m").alias("lo")).distinct()
    down = large.groupBy("hi").agg(F.min("lo").alias("m"))
    small = large.join(down, "hi").select(F.explode(F.array("hi", "lo")).alias("hi"), F.col("m").alias("lo"))
    return small.filter("hi != lo").distinct()


def components(edges: DataFrame, rounds: int = 50) -> DataFrame:
    """``node, component`` for every node of ``edges`` (columns a, b): the component is its smallest node.

    Loops and repeated edges change nothing; edges with a null end are no edges. Every round is a stored table. The
    number of rounds grows with the logarithm of the number of nodes; running out of them is an error, not a result.
    """
    state = stored(
        edges.filter("a != b").select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo")).distinct(), "edges")
    mark = F.count("*"), F.sum(F.xxhash64("hi", "lo").cast("decimal(20,0)"))
    before = state.agg(*mark).first()
    for _ in range(rounds):
        if not before[0]:
            break
        after = stored(_stars(state), "edges")
        now = after.agg(*mark).first()
        discard(state)
        state = after
        if now == before:
            break
        before = now
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    roots = state.select(F.col("lo").alias("node"), F.col("lo").alias("component")).distinct()
    return state.select(F.col("hi").alias("node"), F.col("lo").alias("component")).unionByName(roots)
