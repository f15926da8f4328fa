"""Uniform shuffle into shards of exact size by a hypergeometric communication matrix (DataFrame operations only).

Every input partition draws how many of its rows go to each shard, so that shard sizes are exact and every
assignment is equally likely. Rows are permuted inside their partition, sent by the drawn counts, and permuted again
inside their shard. Only the counts (partitions x shards) are drawn on the driver.
"""

from __future__ import annotations

import json
import math
import random

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from blendscope.llm.shared import replace_columns, stored


def hypergeometric(rng: random.Random, good: int, bad: int, draws: int) -> int:
    """One exact hypergeometric draw by inversion outward from the mode; works for populations of any size."""
    low, high = max(0, draws - bad), min(good, draws)
    if low == high:
        return low
    mode = min(high, max(low, (draws + 1) * (good + 1) // (good + bad + 2)))
    ln = math.lgamma
    at_mode = math.exp(
        ln(good + 1) - ln(mode + 1) - ln(good - mode + 1) + ln(bad + 1) - ln(draws - mode + 1) - ln(bad - draws + mode + 1)
        - ln(good + bad + 1) + ln(draws + 1) + ln(good + bad - draws + 1)
    )
    left = rng.random() - at_mode
    down, up, p_down, p_up = mode, mode, at_mode, at_mode
    while left > 0 and (down > low or up < high):
        if up < high:
            p_up *= (good - up) * (draws - up) / ((up + 1) * (bad - draws + up + 1))
            up += 1
            left -= p_up
            if left <= 0:
                return up
        if down > low:
            p_down *= down * (bad - draws + down) / ((good - down + 1) * (draws - down + 1))
            down -= 1
            left -= p_down
            if left <= 0:
                return down
    return mode


def communication_matrix(counts: list[int], shards: int, seed: int) -> list[list[int]]:
    """Row p: how many rows of partition p go to each shard. Column sums differ by at most one."""
    rng = random.Random(seed)
    total = sum(counts)
    room = [total // shards + (s < total % shards) for s in range(shards)]
    rows = []
    for n in counts:
        pool, row = sum(room), []
        for s in range(shards):
            k = hypergeometric(rng, room[s], pool - room[s], n)
            row.append(k)
            pool -= room[s]
            n -= k
        room = [r - k for r, k in zip(room, row, strict=True)]
        rows.append(row)
    return rows


def shuffle_to_shards(docs: DataFrame, shards: int = 16, seed: int = 17, rows_per_block: int = 250_000) -> DataFrame:
    """``docs`` with ``shard`` (0 to shards - 1) and ``slot`` (gapless from 0 in the shard).

    The input is stored first, so a lost executor rereads the same partitions. A shard is laid out in blocks of about
    ``rows_per_block`` rows, each sorted in its own task; block offsets come from counts. Values are never looked at:
    nulls, empty or long texts, ties and repeated rows are rows like others. An empty table gives an empty result;
    input columns named shard or slot are replaced.
    """
    spark = docs.sparkSession
    tagged = stored(
        docs.select(F.struct("*").alias("row"), F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("ord")),
        "shard-input",
    )
    sizes = {r["part"]: r["n"] for r in tagged.groupBy("part").agg(F.count("*").alias("n")).collect()}  # one count per input partition
    parts = sorted(sizes)
    matrix = communication_matrix([sizes[p] for p in parts], shards, seed)
    upto = [{"part": p, "upto": [sum(row[: s + 1]) for s in range(shards)]} for p, row in zip(parts, matrix, strict=True)]
    blocks = max(1, -(-sum(sizes.values()) // (shards * rows_per_block)))
    plan = spark.range(1).select(F.inline(F.from_json(F.lit(json.dumps(upto)), "array<struct<part:int,upto:array<bigint>>>")))

    first, second = F.xxhash64(F.lit(seed), "ord"), F.xxhash64(F.lit(seed + 1), "ord")
    local = Window.partitionBy("part").orderBy(first, "ord")
    sent = (
        tagged.withColumn("rank", F.row_number().over(local) - 1)
        .join(plan, "part")
        .select("row", "ord", F.size(F.filter("upto", lambda u: u <= F.col("rank"))).alias("shard"),
                F.pmod(F.shiftrightunsigned(second, 20), F.lit(blocks)).alias("block"), second.alias("key"))
    )
    before = Window.partitionBy("shard").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        sent.groupBy("shard", "block").agg(F.count("*").alias("n"))
        .select("shard", "block", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    )
    inside = Window.partitionBy("shard", "block").orderBy("key", "ord")
    placed = sent.join(offsets, ["shard", "block"]).withColumn("slot", F.col("start") + F.row_number().over(inside) - 1)
    return replace_columns(placed, "row", shard=F.col("shard"), slot=F.col("slot").cast("long"))
