"""Interaction of text filters: what every filter removes in every order in which the filters could run.

Documents are counted once, by the set of filters that they fail (a mask cell). A recursive query then enumerates the
orders: it extends each prefix of letters with every unused one, joins the mask cells and carries the bits applied so
far, so that each level emits what its step does to each cell. Its size depends on the number of filters alone.
"""

from __future__ import annotations

from collections.abc import Mapping
from math import factorial

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from blendscope.llm.shared import WORD, stored

#: Letter of the filter that drops a text which a smaller id has as well; it is decided over the whole table.
REPEATED = "E"
#: More filters make more prefixes than a recursive query may return.
MOST_FILTERS = 6

ORDERS = """
WITH RECURSIVE audit(filter_order, letter, bit, before, applied, step, mask) AS (
  SELECT CAST('' AS STRING), CAST('' AS STRING), 0, 0, 0, 0, mask FROM {masks}
  UNION ALL
  SELECT concat(a.filter_order, l.letter), l.letter, l.bit, a.applied, a.applied | l.bit, a.step + 1, c.mask
  FROM audit a JOIN {letters} l ON (a.applied & l.bit) = 0 JOIN {masks} c ON c.mask = a.mask
)
SELECT filter_order, letter, step, mask,
       (mask & applied) = 0 AS kept,
       (mask & bit) <> 0 AND (mask & before) = 0 AS removed,
       (mask & bit) <> 0 AND (mask & before) <> 0 AS redundant,
       mask = bit AS only
FROM audit WHERE step > 0
"""


def text_filters(text: str = "text") -> dict[str, Column]:
    """Failure conditions of a text: few words, few different words, many capitals, symbols. Null is an empty text."""
    t = F.coalesce(F.col(text), F.lit(""))
    words = F.regexp_extract_all(t, F.lit(WORD), F.lit(0))
    return {
        "A": F.size(words) < 200,
        "B": 100 * F.size(F.array_distinct(words)) < 50 * F.size(words),
        "C": 100 * F.regexp_count(t, F.lit("[A-Z]")) > 2 * F.length(t),
        "D": t.rlike("[#$%&*|]"),
    }


def mask_cells(docs: DataFrame, labels: DataFrame, filters: Mapping[str, Column]) -> DataFrame:
    """Documents, good and toxic ones per ``part`` (source) and mask of failed filters.

    The last bit is set for a text that a smaller id has too. Rows of equal text, part and labels are counted before
    they meet by text, so a text that a third of all rows share is a few rows per task. A null id is never smaller and
    has no smaller one; rows that repeat an id count each. A label counts once however often it is given.
    """
    bits = [F.when(fails, F.lit(1 << i)).otherwise(F.lit(0)) for i, fails in enumerate(filters.values())]
    slim = docs.select(
        F.col("doc_id").alias("id"), F.coalesce("source", F.lit("")).alias("part"),
        F.unhex(F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256)).alias("digest"), sum(bits, F.lit(0)).alias("mask"))
    marks = labels.groupBy(F.col("doc_id").alias("id")).agg(
        F.coalesce(F.max(F.col("quality") == 1), F.lit(False)).alias("good"), F.coalesce(F.max(F.col("toxic") == 1), F.lit(False)).alias("toxic"))
    known = slim.join(marks, "id", "left").na.fill(False, ["good", "toxic"])
    group = ["digest", "part", "mask", "good", "toxic"]
    named = F.col("id").isNotNull()
    by_text = (
        known.groupBy("id", *group).agg(F.count("*").alias("n"))  # lies by id after the join: no shuffle
        .groupBy(*group).agg(F.min(F.when(named, F.struct("id", "n"))).alias("first"), F.sum("n").alias("n"),
                             F.coalesce(F.sum(F.when(~named, F.col("n"))), F.lit(0)).alias("unnamed"))
    )
    least = F.min("first.id").over(Window.partitionBy("digest"))
    again = F.col("n") - F.col("unnamed") - F.when(F.col("first.id") == least, F.col("first.n")).otherwise(F.lit(0))
    last = F.lit(1 << len(filters))
    cells = F.array(F.struct(F.col("mask").alias("mask"), (F.col("n") - F.col("again")).alias("n")),
                    F.struct((F.col("mask") + last).alias("mask"), F.col("again").alias("n")))
    return (
        by_text.withColumn("again", F.coalesce(again, F.lit(0)))
        .select("part", "good", "toxic", F.inline(cells)).filter("n > 0")
        .groupBy("part", "mask").agg(F.sum("n").alias("n"), F.sum(F.when(F.col("good"), F.col("n")).otherwise(0)).alias("good"),
                                     F.sum(F.when(F.col("toxic"), F.col("n")).otherwise(0)).alias("toxic"))
    )


def enumerate_orders(spark: SparkSession, masks: DataFrame, letters: str) -> DataFrame:
    """Every prefix of every order of ``letters`` with its step's effect on each mask: at most 2^n times the number of
    prefixes rows, whatever the number of documents and parts."""
    if len(letters) > MOST_FILTERS:
        raise ValueError(f"at most {MOST_FILTERS} filters")
    table = spark.createDataFrame([(c, 1 << i) for i, c in enumerate(letters)], "letter string, bit int")
    return spark.sql(ORDERS, masks=masks, letters=table)


def audit_filters(docs: DataFrame, labels: DataFrame, filters: Mapping[str, Column] | None = None) -> DataFrame:
    """Metrics of every step of every filter order in every part.

    ``docs`` has doc_id, text and source, ``labels`` doc_id, quality and toxic; further columns are ignored. ``filters``
    maps a letter to a failure condition (null: it does not fail); the filter of repeated texts follows as the last
    letter. One row per part (null source: empty string), order and step: documents kept after the step, removed by
    it, redundant (failing, but removed before), unique_fails (failing this filter alone), removed good and toxic ones,
    and shapley (removed by this filter, summed over all orders). Without documents there are no rows.
    """
    spark = docs.sparkSession
    filters = text_filters() if filters is None else filters
    letters = "".join(filters) + REPEATED
    cells = stored(mask_cells(docs, labels, filters), "audit-cells")
    effect = stored(enumerate_orders(spark, cells.select("mask").distinct(), letters), "audit-orders")

    def counted(flag: str, of: str = "n") -> Column:
        return F.sum(F.when(F.col(flag), F.col(of)).otherwise(0))

    steps = (
        cells.join(F.broadcast(effect), "mask")  # bounded by the number of filters
        .groupBy("part", "filter_order", "letter", "step").agg(
            counted("kept").alias("kept"), counted("removed").alias("removed"), counted("redundant").alias("redundant"),
            counted("only").alias("unique_fails"), counted("removed", "good").alias("good_lost"), counted("removed", "toxic").alias("toxic_lost"))
    )
    # a prefix of s letters begins (n - s)! orders
    begun = F.element_at(F.array(*[F.lit(factorial(len(letters) - s)) for s in range(1, len(letters) + 1)]), F.col("step"))
    steps = steps.withColumn("shapley", F.sum(F.col("removed") * begun).over(Window.partitionBy("part", "letter")))
    orders = (
        effect.filter(F.col("step") == len(letters)).select(F.col("filter_order").alias("whole")).distinct()
        .select("whole", F.explode(F.sequence(F.lit(1), F.lit(len(letters)))).alias("at"))
        .select("whole", F.expr("substring(whole, 1, at)").alias("filter_order"))
    )
    return steps.join(F.broadcast(orders), "filter_order").select(
        "part", F.col("whole").alias("filter_order"), "step", "letter", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")
