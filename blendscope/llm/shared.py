"""Helpers of the corpus operators: stored intermediate tables, global row numbers, byte classes."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from blendscope.session import checkpoint_dir

#: White space that separates words of the near-duplicate, mixing and size operators.
WORD = r"[^\x20\x09-\x0D]+"
#: Words of the decontamination operator, on lower-cased text: digits, a-z and everything beyond ASCII.
TERM = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Bytes with A-Z lower-cased, all others kept.
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
#: Bytes with A-Z lower-cased and everything that is in no TERM turned into a space.
TERM_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path in the folder that driver and executors share."""
    return f"{checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.stored_at = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete the files of ``stored`` tables that nothing reads any more."""
    for df in tables:
        jvm = df.sparkSession._jvm
        path = jvm.org.apache.hadoop.fs.Path(df.stored_at)
        path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def numbered(df: DataFrame, *order: Column, name: str = "position") -> DataFrame:
    """``df`` with a gapless global row number from 0 in the given order.

    Range partitions are sorted on their own; only one count per partition meets in one task.
    """
    held = stored(
        df.repartitionByRange(*order).sortWithinPartitions(*order)
        .select("*", F.spark_partition_id().alias("_p"), F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)).alias("_i")),
        "numbered",
    )
    counts = {r["_p"]: r["n"] for r in held.groupBy("_p").agg(F.count("*").alias("n")).collect()}
    starts, upto = {}, 0
    for p in sorted(counts):
        starts[p], upto = upto, upto + counts[p]
    if not starts:
        return held.withColumn(name, F.lit(0).cast("long")).drop("_p", "_i")
    start = F.element_at(F.array(*[F.lit(starts.get(p, 0)).cast("long") for p in range(max(starts) + 1)]), F.col("_p") + 1)
    return held.withColumn(name, start + F.col("_i")).drop("_p", "_i")


def replace_columns(df: DataFrame, row: str, **new: Column) -> DataFrame:
    """The fields of struct ``row`` plus the new columns; an input column of the same name (in any case) gives way."""
    names = {n.lower() for n in new}
    kept = [F.col(f"{row}.`{f}`") for f in df.schema[row].dataType.names if f.lower() not in names]
    return df.select(*kept, *[c.alias(n) for n, c in new.items()])


def lookup(docs: DataFrame, key: Column, table: DataFrame, on: str, how: str = "inner", **new) -> DataFrame:
    """``docs`` with columns from the row of ``table`` whose ``on`` equals ``key``; rows without one are left out, or
    have nulls there with ``how="left"``.

    ``new`` maps a name to a function of a getter of the table's columns. The columns of ``docs`` pass the join as they
    are, so those that nothing reads afterwards are not shuffled. Existing columns of the same names give way.
    """
    mark = f"_{uuid.uuid4().hex}_"
    names = {n.lower() for n in new}
    other = table.select(*[F.col(f"`{c}`").alias(mark + c) for c in table.columns])
    both = docs.withColumn(mark, key).join(other, F.col(mark) == F.col(mark + on), how)
    kept = [F.col(f"`{c}`") for c in docs.columns if c.lower() not in names]
    return both.select(*kept, *[f(lambda c: F.col(mark + c)).alias(n) for n, f in new.items()])


def held_out(doc_id: str = "doc_id") -> Column:
    """Rows whose label must not be learned from: crc32 of the id as text leaves 1 modulo 3. A null id is held out."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 3 == 1, F.lit(True))


def tables(spark: SparkSession, sf_dir: str):
    """Reader of the named test tables under ``sf_dir``."""
    return lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet")
