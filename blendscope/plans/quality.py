"""Table lists and column dictionaries (2.18)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from blendscope.functions import text as tx


def table_list(spark: SparkSession, preferred: list[str]) -> DataFrame:
    """Catalog tables, the preferred ones first and in that order, the rest by name (Q3)."""
    names = [(t.name,) for t in spark.catalog.listTables()]
    df = spark.createDataFrame(names or [("",)], "name string").where("name <> ''")
    order = F.array_position(F.array(*[F.lit(p) for p in preferred]) if preferred else F.array(F.lit("")), F.col("name"))
    return df.withColumn("_o", F.when(order > 0, order).otherwise(F.lit(1 << 30))).orderBy("_o", "name").drop("_o")


def column_dictionary(df: DataFrame, order: list[str]) -> DataFrame:
    """Per column: type, missing count and share, first non-null example by ``order`` (Q4). One aggregate job."""
    pos = F.struct(*order)
    aggs = [F.count(F.lit(1)).alias("_n")]
    for i, c in enumerate(df.columns):
        aggs += [F.count_if(F.col(c).isNull()).alias(f"m{i}"),
                 F.min_by(F.col(c).cast("string"), F.when(F.col(c).isNotNull(), pos)).alias(f"e{i}")]
    cells = F.array(*[
        F.struct(F.lit(i).alias("position"), F.lit(c).alias("column"), F.lit(t).alias("type"), F.col(f"m{i}").alias("n_missing"),
                 (100.0 * F.col(f"m{i}") / F.col("_n")).alias("pct_missing"), F.col(f"e{i}").alias("example"))
        for i, (c, t) in enumerate(df.dtypes)])
    return df.agg(*aggs).select(F.explode(cells).alias("c")).select("c.*")


def column_meanings(columns: DataFrame, specific: DataFrame, common: DataFrame) -> DataFrame:
    """Meaning of (table, column): table-specific, common, rank of a known column, or unknown (Q5).

    ``specific``: table, column, meaning; ``common``: column, meaning. Both are dictionaries of fixed size.
    """
    def look_up(df: DataFrame, on: str, out: str, dictionary: DataFrame, by_table: bool) -> DataFrame:
        names = (["table"] if by_table else []) + ["column"]
        d = dictionary.select(*[F.col(n).alias(f"_{out}_{n}") for n in names], F.col("meaning").alias(out))
        cond = F.col(on) == F.col(f"_{out}_column")
        if by_table:
            cond = cond & (F.col("table") == F.col(f"_{out}_table"))
        return df.join(d, cond, "left").drop(*[f"_{out}_{n}" for n in names])

    j = columns.withColumn("_base", tx.meaning_base("column")).withColumn("_ranked", F.col("_base") != F.col("column"))
    for on, out, dictionary, by_table in (("column", "s1", specific, True), ("column", "c1", common, False),
                                          ("_base", "s2", specific, True), ("_base", "c2", common, False)):
        j = look_up(j, on, out, dictionary, by_table)
    ranked = F.when(F.col("_ranked"), F.concat(F.lit("rank of: "), F.coalesce("s2", "c2")))
    return j.select("table", "column", F.coalesce("s1", "c1", ranked, F.lit("unknown")).alias("meaning"))
