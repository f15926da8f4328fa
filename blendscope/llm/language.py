"""Language of web pages by fusing evidence with Bayes' rule.

The likelihood of the visible text comes from character trigram counts over all documents with a known language. The
language that the markup declares, the suffix of the address and the host add evidence: how often a declaration is
made for each language, and which languages a host has. Host priors are smoothed toward the site, the site toward the
suffix and the suffix toward all pages; a page's own text is taken out of the counts it is judged by.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType

from blendscope.llm.shared import replace_columns, stored

BINS = 1 << 15
#: Number of independent trigrams that a text counts as at most.
WEIGHT = 40.0
#: Pages that a prior of the next wider level counts as.
STRENGTH = 2.0
NO_LETTERS = re.compile(r"[\W\d_]+")
#: Blocks of text in characters.
BLOCK = 1 << 18


def grams(text: str | None) -> Iterator[np.ndarray]:
    """Hashed character trigrams of the whole lower-cased text, letters only, by blocks."""
    t = NO_LETTERS.sub(" ", (text or "").lower()).strip(" ")
    c = np.frombuffer(f" {t} ".encode("utf-32-le", "replace") if t else b"", np.uint32).astype(np.uint64)
    for start in range(0, max(0, len(c) - 2), BLOCK):
        b = c[start:start + BLOCK + 2]
        yield ((b[:-2] | b[1:-1] << np.uint64(21) | b[2:] << np.uint64(42)) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(49)).astype(np.int64)


def train_language(docs: DataFrame) -> tuple[list[str], np.ndarray]:
    """Languages and the log probability of each trigram in each, from all rows with a language (``text, lang``)."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, np.ndarray] = {}
        for batch in batches:
            for text, lang in zip(batch.column("text"), batch.column("lang"), strict=True):
                n = total.setdefault(lang.as_py(), np.zeros(BINS, np.int64))
                for g in grams(text.as_py()):
                    n += np.bincount(g, minlength=BINS)
        for lang, n in total.items():
            used = np.flatnonzero(n)
            yield pa.RecordBatch.from_pydict({"lang": pa.array([lang] * len(used), pa.string()), "bin": pa.array(used, pa.int32()), "n": n[used]})

    rows = docs.filter("lang is not null").select("text", "lang").mapInArrow(count, "lang string, bin int, n long")
    counts = rows.groupBy("lang", "bin").agg(F.sum("n").alias("n")).collect()  # at most BINS rows per language
    languages = sorted({r["lang"] for r in counts})
    table = np.ones((max(1, len(languages)), BINS))
    place = {lang: i for i, lang in enumerate(languages)}
    for r in counts:
        table[place[r["lang"]], r["bin"]] += r["n"]
    return languages, np.log(table / table.sum(axis=1, keepdims=True))


def visible(html: Column) -> Column:
    """Text of a page without scripts, styles, comments and tags."""
    return F.regexp_replace(html, r"(?s)<script\b.*?</script\s*>|<style\b.*?</style\s*>|<!--.*?-->|<[^<>]*>|&\w+;", " ")


def identify(pages: DataFrame, languages: list[str], model: np.ndarray) -> DataFrame:
    """``pages`` (url, html) with ``lang, probability, text_lang, declared, host``.

    A null or empty page gives no text evidence (all languages alike), an absent declaration and a null or malformed
    url none of theirs; ties go to the first language in order. Repeated rows count as pages of their host. Without
    languages ``lang`` is null. Input columns with the names of the new ones are replaced.
    """
    n = len(languages)
    names = ["declared", "host", "lang", "probability", "text_lang"]
    if not n:
        return replace_columns(pages.select(F.struct("*").alias("row")), "row", **{c: F.lit(None).cast("double" if c == "probability" else "string") for c in names})
    shared = pages.sparkSession.sparkContext.broadcast(model)  # BINS numbers per language

    def likelihood(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = np.zeros((batch.num_rows, n))
            for i, text in enumerate(batch.column("visible")):
                size = 0
                for g in grams(text.as_py()):
                    out[i] += shared.value[:, g].sum(axis=1)
                    size += len(g)
                out[i] *= min(size, WEIGHT) / max(size, 1)
            out = np.exp(out - out.max(axis=1, keepdims=True)) if len(out) else out
            out = out / out.sum(axis=1, keepdims=True) if len(out) else out
            flat = pa.ListArray.from_arrays(pa.array(np.arange(0, out.size + 1, n), pa.int32()), pa.array(out.ravel()))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in batch.schema.names if c != "visible"), flat], [*(c for c in batch.schema.names if c != "visible"), "q"])

    row = F.struct(*[F.col(f"`{c}`") for c in pages.columns if c.lower() not in ("html", *names)])
    host = F.lower(F.regexp_extract("url", r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1))
    base = pages.select(
        row.alias("row"), host.alias("host"),
        F.lower(F.regexp_extract("html", r"""(?i)<html\b[^<>]*?\slang\s*=\s*["']?([a-z]{2,3})""", 1)).alias("declared"), visible(F.col("html")).alias("visible"))
    base = base.select("row", *[F.coalesce(c, F.lit("")).alias(c) for c in ("host", "declared")], "visible")
    schema = base.drop("visible").schema.add("q", ArrayType(DoubleType()))
    page = stored(
        base.mapInArrow(likelihood, schema)
        .withColumn("suffix", F.substring_index("host", ".", -1)).withColumn("site", F.substring_index("host", ".", -2)), "pages")

    def sums(key: str | None) -> DataFrame:
        grouped = page.groupBy(*([key] if key else []))
        return grouped.agg(F.count("*").alias("n"), F.array(*[F.sum(F.col("q")[i]) for i in range(n)]).alias("s"))

    total = sums(None).first()
    overall = F.array(*[F.lit(((total["s"][i] or 0.0) + 1.0) / (total["n"] + n)) for i in range(n)])
    prior, joined = overall, page
    for level in ("suffix", "site", "host"):
        joined = joined.join(sums(level).select(level, F.col("n").alias(f"n_{level}"), F.col("s").alias(f"s_{level}")), level)
        own = F.zip_with(f"s_{level}", "q", lambda s, q: F.greatest(s - q, F.lit(0.0)))
        others = F.array_repeat(F.col(f"n_{level}") - 1 + STRENGTH, n)
        prior = F.zip_with(F.zip_with(own, prior, lambda s, p: s + STRENGTH * p), others, lambda v, m: v / m)
    told = sums("declared").select("declared", F.col("s").alias("s_declared"))
    kinds = max(1, page.select("declared").distinct().count())
    said = F.transform(
        F.zip_with("s_declared", "q", lambda s, q: F.greatest(s - q, F.lit(0.0)) + 0.5),
        lambda v, i: v / (F.lit([float(x or 0.0) for x in total["s"]])[i] + 0.5 * kinds))
    said = F.when(F.col("declared") == "", F.array(*[F.lit(1.0)] * n)).otherwise(said)
    fused = joined.join(told, "declared").select(
        "row", "host", "declared", "q", F.zip_with(F.zip_with("q", prior, lambda a, b: a * b), said, lambda a, b: a * b).alias("p"))
    total_p = F.aggregate("p", F.lit(0.0), lambda a, x: a + x)
    label = F.array(*[F.lit(x) for x in languages])
    best = lambda c: F.element_at(label, F.array_position(F.col(c), F.array_max(c)).cast("int"))
    return replace_columns(fused, "row", declared=F.nullif("declared", F.lit("")), host=F.nullif("host", F.lit("")), lang=best("p"),
                           probability=F.array_max("p") / total_p, text_lang=best("q"))
