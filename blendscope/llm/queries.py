"""Registered queries of the corpus operators and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from blendscope.llm import decontamination, language, minhash, mixing, quality, sharding, surrogates, tokencount, toxicity, vectors
from blendscope.llm.shared import held_out, scratch_path, tables

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a query; ``sql`` computes the same rows in DuckDB."""

    def wrap(fn):
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn

    return wrap


WORDS = "regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"

DECONTAMINATION = f"""
WITH d AS (SELECT doc_id, coalesce({WORDS}, []) AS w FROM documents),
i AS (SELECT item_id, {WORDS} AS w FROM benchmark),
phrase AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[k : k + least(len(w), 10) - 1], ' ') AS p
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 10, 0) + 2)) AS k FROM i WHERE len(w) > 0)),
spot AS (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS k FROM d),
run AS (
  SELECT doc_id, n, k, array_to_string(w[k : k + n - 1], ' ') AS p
  FROM spot, (SELECT DISTINCT n FROM phrase) WHERE k + n - 1 <= len(w)),
hit AS (SELECT doc_id, item_id, k, n FROM run JOIN phrase USING (n, p)),
word AS (SELECT doc_id, count(DISTINCT k + o) AS n_hit FROM (SELECT doc_id, k, unnest(range(0, n)) AS o FROM hit) GROUP BY 1),
item AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS ids
  FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM hit) GROUP BY 1)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN word USING (doc_id) LEFT JOIN item USING (doc_id)
"""


@query("op1_decontamination", DECONTAMINATION)
def decontamination_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of every document that lie in ten-word runs of benchmark items."""
    read = tables(spark, sf_dir)
    found = decontamination.decontaminate(read("documents").select("doc_id", "text"), read("benchmark"), 10)
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


@query("op2_token_counts")
def token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every document. The query starts with an empty cache, so that it counts every text itself."""
    import public_tokenizers

    docs = tables(spark, sf_dir)("documents").select("doc_id", "text")
    counted = tokencount.token_counts(docs, public_tokenizers.path("byte_bpe_50k.json"), scratch_path(spark, "token-cache"))
    return counted.select("doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"), "n_tokens",
                          (F.col("n_tokens") > 1024).alias("over_limit"))


@query("op10_toxicity")
def toxicity_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity score of every document; labels of held-out ids are never read."""
    read = tables(spark, sf_dir)
    docs = read("documents").select("doc_id", "text")
    model = toxicity.train_toxicity(docs, read("labels").filter(~held_out()))
    return toxicity.score_toxicity(docs, model).select(
        "doc_id", held_out().alias("held_out"), "score", (F.col("score") >= toxicity.REJECT).cast("int").alias("predicted"))


@query("op7_shard_shuffle")
def shard_shuffle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents in 16 shards whose row counts differ by at most one."""
    text = F.col("text")
    docs = tables(spark, sf_dir)("documents").select(
        "doc_id", (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long").alias("size"),
        F.coalesce(F.crc32(text.cast("binary")), F.lit(0)).cast("long").alias("text_crc32"))
    return sharding.shuffle_to_shards(docs, 16).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


@query("op8_source_mix")
def source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that a mix of 150% of all words takes from every document."""
    docs = tables(spark, sf_dir)("documents")
    return mixing.mix_sources(docs, mixing.word_count()).select(
        "doc_id", "size", "source_size", "target", "taken", "copies", "rate")


NEAR_DUPLICATES = """
WITH RECURSIVE w AS (
  SELECT doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+'), []) AS w
  FROM documents),
s AS (
  SELECT DISTINCT doc_id, array_to_string(w[k : k + 4], ' ') AS g
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS k FROM w WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
both_ AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM s x JOIN s y ON x.g = y.g AND x.doc_id <> y.doc_id GROUP BY 1, 2),
link AS (SELECT a, b FROM both_ JOIN n p ON a = p.doc_id JOIN n q ON b = q.doc_id WHERE 100 * c >= 75 * (p.n + q.n - c)),
reach AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT reach.a, link.b FROM reach JOIN link ON reach.b = link.a)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, min(reach.b) AS component_id, d.doc_id = min(reach.b) AS kept
FROM documents d JOIN reach ON d.doc_id = reach.a LEFT JOIN n ON d.doc_id = n.doc_id GROUP BY d.doc_id, n.n
"""


@query("op6_near_duplicates", NEAR_DUPLICATES)
def near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate class of every document."""
    docs = tables(spark, sf_dir)("documents").select("doc_id", "text")
    return minhash.near_duplicates(docs).select("doc_id", "n_shingles", "component_id", "kept")


VECTORS = """
WITH RECURSIVE v AS (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings),
link AS (
  SELECT x.vec_id AS a, y.vec_id AS b FROM v x JOIN v y ON x.label = y.label AND x.vec_id <> y.vec_id
  WHERE list_cosine_similarity(x.e, y.e) >= 0.98),
reach AS (SELECT vec_id AS a, vec_id AS b FROM v UNION SELECT reach.a, link.b FROM reach JOIN link ON reach.b = link.a)
SELECT a AS vec_id, (SELECT count(*) FROM link WHERE link.a = reach.a) AS n_links, min(b) AS component_id, a = min(b) AS kept
FROM reach GROUP BY a
"""


@query("op3_vector_links", VECTORS)
def vector_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and classes of all embeddings at a cosine of 0.98."""
    found = vectors.linked_vectors(tables(spark, sf_dir)("embeddings"), 0.98)
    return found.select("vec_id", "n_links", "component_id", "kept")


@query("op5_surrogates")
def surrogate_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its personal data replaced."""
    docs = tables(spark, sf_dir)("documents").select("doc_id", "text")
    return surrogates.pseudonymise(docs, "registered query")


@query("op4_quality")
def quality_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality score of every document; labels of held-out ids are never read."""
    read = tables(spark, sf_dir)
    docs = read("documents").select("doc_id", "text", "lang", "source", "n_chars")
    model = quality.train_quality(docs, read("labels").filter(~held_out()))
    return quality.score_quality(docs, model).select(
        "doc_id", held_out().alias("held_out"), "text_score", "meta_score", "score", (F.col("score") >= 0.5).alias("kept"))


@query("op9_language")
def page_languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every page; text likelihoods are counted over all documents."""
    read = tables(spark, sf_dir)
    languages, model = language.train_language(read("documents"))
    return language.identify(read("pages"), languages, model).select("page_id", "host", "declared", "text_lang", "lang", "probability")


from blendscope.llm import text_queries  # noqa: E402,F401  (registers its queries here)
