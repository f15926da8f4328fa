"""Mixing sources to target weights by entropy balancing (DataFrame operations only).

Each source must contribute a target number of tokens, and no document more than ``ceiling`` copies. Among all rates
with these sums the ones nearest to the base rate in (two-sided) relative entropy are
``ceiling / (1 + exp(-lambda_source * size / mean size))``: an exponential tilt of the odds of a copy. The multipliers
are the solution of the convex dual, found by Newton steps whose gradient and curvature are grouped sums. Rates are
rounded systematically: over the sizes of a source in rising order the running sum of the rates is rounded, which says
how many copies each size gets in all. What the sizes before leave open is carried on, so a source misses its target
by about one document however many it has. Of the rows of a size those with the smallest hashes get the copy more.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from blendscope.llm.shared import WORD, discard, numbered, replace_columns, stored

KEY = ["s", "s_null"]


def word_count(text: str = "text") -> Column:
    """Number of words of the whole text; a null text has none."""
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: Sequence[float], share: float, ceiling: float) -> DataFrame:
    """Target of each source (``s, s_null, docs, total``): weights repeat in code-point order, null last.

    A level raises all sources in step with their weight until they use up the share; a source stops at ``ceiling``
    times its size and the others take the rest. One row per source; only sums reach the driver.
    """
    weigh = F.array(*[F.lit(float(w)) for w in weights])
    ranked = stored(numbered(sizes, F.col("s_null"), F.col("s")).withColumn(
        "weight", F.element_at(weigh, (F.col("position") % len(weights) + 1).cast("int"))), "mix-sources")
    most = F.col("total") * float(ceiling)
    goal = share * (ranked.agg(F.sum("total")).first()[0] or 0)
    level = 0.0
    while True:
        full = most <= F.col("weight") * level
        held, free = ranked.agg(F.sum(F.when(full, most)), F.sum(F.when(~full, F.col("weight")))).first()
        rise = (goal - (held or 0.0)) / free if free else level
        if rise <= level:
            break
        level = rise
    return ranked.withColumn("target", F.least(most, F.col("weight") * level)).drop("position", "weight")


def balance(hist: DataFrame, sources: DataFrame, ceiling: float, rounds: int = 40, tolerance: float = 1e-7) -> DataFrame:
    """Newton iterations on the dual: ``sources`` with the multiplier of each source.

    ``hist`` has the number of documents of each source and size, so a step costs one grouped sum over it. The dual is
    separable by source; steps are limited to 2 so that flat tails are crossed safely. A source at the ceiling takes
    all its documents ``ceiling`` times; its multiplier is infinite and stays out of the iteration.
    """
    odds = F.col("target") / (ceiling * F.col("total") - F.col("target"))
    state = stored(
        sources.withColumn("lam", F.when(F.col("total") <= 0, F.lit(0.0)).when(F.col("target") >= ceiling * F.col("total") * (1 - 1e-12), F.lit(float("inf"))).otherwise(F.log(odds))),
        "mix-state",
    )
    for _ in range(rounds):
        rate = tilted(F.col("lam"), F.col("size"), F.col("total") / F.col("docs"), ceiling)
        tokens = F.col("n") * F.col("size")
        sums = (
            hist.join(state.filter("total > 0 and lam < double('inf')"), KEY).groupBy(*KEY)
            .agg(F.sum(tokens * rate).alias("got"),
                 F.sum(tokens * F.col("size") / (F.col("total") / F.col("docs")) * rate * (1 - rate / ceiling)).alias("slope"))
        )
        step = F.when(F.col("slope") > 0, (F.col("target") - F.col("got")) / F.col("slope")).otherwise(F.lit(0.0))
        moved = stored(
            state.join(sums, KEY, "left").withColumn("off", F.coalesce(F.try_divide(F.abs(F.col("target") - F.col("got")), F.col("target")), F.lit(0.0)))
            .withColumn("lam", F.col("lam") + F.coalesce(F.greatest(F.lit(-2.0), F.least(F.lit(2.0), step)), F.lit(0.0)))
            .drop("got", "slope"),
            "mix-state",
        )
        worst = moved.agg(F.max("off")).first()[0] or 0.0
        discard(state)
        state = moved.drop("off")
        state.stored_at = moved.stored_at
        if worst < tolerance:
            break
    return state


def tilted(lam: Column, size: Column, mean: Column, ceiling: float) -> Column:
    """Rate of a document of ``size`` tokens under multiplier ``lam``."""
    return F.when(lam == float("inf"), F.lit(float(ceiling))).otherwise(
        F.lit(float(ceiling)) / (1 + F.exp(-F.coalesce(F.try_divide(lam * size, mean), F.lit(0.0)))))


#: Rows of one size that are sorted to find a hash threshold, about.
BUCKET_ROWS = 1024


def allotments(hist: DataFrame, state: DataFrame, ceiling: int) -> DataFrame:
    """Copies of each size of a source: ``base`` for every row and one more for ``more`` of its ``n`` rows."""
    rate = tilted(F.col("lam"), F.col("size"), F.col("total") / F.col("docs"), ceiling)
    upto = F.sum(F.col("n") * F.col("rate")).over(Window.partitionBy(*KEY).orderBy("size"))
    rated = hist.join(state, KEY).withColumn("rate", rate).withColumn("upto", upto)
    whole = F.floor(F.col("upto") + 0.5) - F.floor(F.greatest(F.col("upto") - F.col("n") * F.col("rate"), F.lit(0.0)) + 0.5)
    base = F.floor("rate")
    more = F.greatest(F.lit(0), F.least(F.col("n"), whole - F.col("n") * base))
    full = more == F.col("n")  # all of them: one more is the base
    return rated.select(*KEY, "size", "n", "total", "target", "rate", (base + F.when(full, 1).otherwise(0)).cast("int").alias("base"),
                        F.when(full, 0).otherwise(more).cast("long").alias("more"))


def thresholds(slim: DataFrame, allotted: DataFrame) -> DataFrame:
    """The row hash up to which the rows of a size get one copy more: ``last``, and of its ``last_n`` equal rows the
    number ``rest`` that get it.

    Found by counting: hashes fall into buckets of about BUCKET_ROWS rows, and only the bucket that holds the threshold
    is sorted, so no size needs all its rows in one task.
    """
    group = [*KEY, "size"]
    part = F.floor((F.col("key").cast("double") / 2.0 ** 64 + 0.5) * F.ceil(F.col("of") / BUCKET_ROWS)).alias("bucket")
    rows = slim.join(allotted.filter("more > 0").select(*group, F.col("n").alias("of"), "more"), group).select(*group, "key", "n", "more", part)
    before = F.sum("c").over(Window.partitionBy(*group).orderBy("bucket")) - F.col("c")
    held = (
        rows.groupBy(*group, "bucket").agg(F.sum("n").alias("c"), F.first("more").alias("more")).withColumn("before", before)
        .filter((F.col("before") < F.col("more")) & (F.col("more") <= F.col("before") + F.col("c"))).select(*group, "bucket", "before")
    )
    rest = F.col("more") - F.col("before") - F.sum("n").over(Window.partitionBy(*group).orderBy("key")) + F.col("n")
    return (
        rows.join(held, [*group, "bucket"]).withColumn("rest", rest).filter((F.col("rest") > 0) & (F.col("rest") <= F.col("n")))
        .select(*group, F.col("key").alias("last"), F.col("n").alias("last_n"), "rest")
    )


def first_of_equal(rows: DataFrame) -> DataFrame:
    """``rows`` (equal ones share ``key``, ``rest`` and much else) with ``one_more`` for the first ``rest`` of a key.

    Rows are numbered over range partitions that also split a key, so it may hold any number of rows."""
    placed = numbered(rows.withColumn("_order", F.monotonically_increasing_id()), F.col("key"), F.col("_order"))
    begins = placed.groupBy("key").agg(F.min("position").alias("_begin"))
    return placed.join(begins, "key").withColumn("one_more", F.col("position") - F.col("_begin") < F.col("rest")).drop("_order", "position", "_begin")


def mix_sources(docs: DataFrame, size: Column, source: str = "source", weights: Sequence[float] = (3, 1, 2),
                share: float = 1.5, ceiling: int = 2, seed: int = 5) -> DataFrame:
    """``docs`` with ``size, source_size, target, rate, copies, taken`` (tokens the mix takes, repeats counted).

    Null sources form a source of their own. Documents without tokens give none whatever their copies. Rows that are
    equal in all columns are rounded one by one, so that a much repeated row meets the target like others; which of
    them get the copy more does not show in the result. All numbers depend on the rows alone, so reruns agree. An empty
    table gives an empty result; input columns with the names of the new ones are replaced.
    """
    keyed = docs.select(
        F.struct("*").alias("row"), F.coalesce(F.col(source), F.lit("")).alias("s"), F.col(source).isNull().alias("s_null"),
        size.alias("size"), F.xxhash64(F.lit(seed), *[F.col(f"`{c}`") for c in docs.columns]).alias("key"))
    slim = stored(keyed.groupBy(*KEY, "key", "size").agg(F.count("*").alias("n")), "mix-slim")
    hist = stored(slim.groupBy(*KEY, "size").agg(F.sum("n").alias("n")), "mix-sizes")
    totals = hist.groupBy(*KEY).agg(F.sum("n").alias("docs"), F.sum(F.col("n") * F.col("size")).alias("total"))
    state = balance(hist, source_targets(totals, weights, share, ceiling), ceiling)

    group = [*KEY, "size"]
    allotted = stored(allotments(hist, state, ceiling), "mix-allotted")
    cuts = stored(allotted.drop("n").join(thresholds(slim, allotted), group, "left"), "mix-cuts")
    discard(slim, hist, state, allotted)
    rated = keyed.join(cuts, group)
    split = (F.col("key") == F.col("last")) & (F.col("rest") < F.col("last_n"))
    if not cuts.filter("rest < last_n").isEmpty():  # one of several equal rows is the last to get more
        dealt = first_of_equal(rated.filter(split))
        rated = rated.filter(~F.coalesce(split, F.lit(False))).withColumn("one_more", F.col("key") <= F.col("last")).unionByName(dealt)
    else:
        rated = rated.withColumn("one_more", F.col("key") <= F.col("last"))
    copies = F.col("base") + F.when(F.col("one_more"), 1).otherwise(0)
    return replace_columns(rated, "row", size=F.col("size"), source_size=F.col("total"), target=F.col("target"), rate=F.col("rate"),
                           copies=copies, taken=copies * F.col("size"))
