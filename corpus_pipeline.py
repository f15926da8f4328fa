"""Corpus pipeline: toxicity, near-duplicates, benchmark decontamination, source mix, shards.

Every stage takes (spark, docs, sf_dir) with docs in the columns of the documents table (further columns are carried
along) and returns the rows that it leaves in the same columns; the last stage adds ``shard`` and ``slot``. An empty
table passes through every stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from blendscope.llm import decontamination, minhash, mixing, sharding, toxicity
from blendscope.llm.shared import held_out, stored


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier does not reject; it is trained on the labels that are not held out."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = toxicity.train_toxicity(docs, labels.filter(~held_out()))
    return toxicity.score_toxicity(docs, model).filter(F.col("score") < toxicity.REJECT).select(docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate class: the one with the smallest id (of equal ids, any one)."""
    kept = minhash.near_duplicates(docs).filter("kept")
    once = kept.filter("kept_rows = 1").select(docs.columns)
    again = kept.filter("kept_rows > 1").dropDuplicates(["class_id"]).select(docs.columns)
    return once.unionByName(again)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any ten-word run of a benchmark item."""
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    hit = decontamination.find_matches(docs, benchmark, 10).filter("n_hit > 0").select("key")
    keyed = docs.select(F.struct("*").alias("row"), decontamination.text_key().alias("key"))
    return keyed.join(hit, "key", "left_anti").select("row.*")


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them (up to twice, or not at all)."""
    mixed = mixing.mix_sources(docs, mixing.word_count())
    return mixed.filter("copies > 0").withColumn("copy", F.explode(F.sequence(F.lit(1), "copies"))).select(docs.columns)


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows in 16 shards of equal counts, in random order."""
    return sharding.shuffle_to_shards(docs, 16)


STAGES = [("toxicity", drop_toxic), ("near_duplicates", drop_near_duplicates), ("decontamination", drop_contaminated), ("mixing", mix), ("sharding", shard)]

#: A learned toxicity model is not expressible in SQL; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on the documents table, each reading what the one before it has written."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
