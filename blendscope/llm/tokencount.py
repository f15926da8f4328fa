"""Token counts through a digest cache.

The cache is a table of (content digest, tokenizer digest, tokens). Documents are reduced to the digest of their
normalised content (a null text is the empty text); only distinct contents that the cache lacks for this tokenizer
version are encoded and appended, then all documents read their counts from the cache.
"""

from __future__ import annotations

import hashlib
import json
import os
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from blendscope.llm.shared import lookup

CACHE_SCHEMA = "content string, tokenizer string, n_tokens long"
#: Fixed value: how byte-level pre-tokenizers cut a text before merging; merges never cross a cut.
CUT = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s+(?!\S)|\s+")
#: Byte-level models spell a byte by a visible character: itself if it has one, else the next free one from 256 on.
VISIBLE = [*range(33, 127), *range(161, 173), *range(174, 256)]
SHOWN = {b: 256 + i for i, b in enumerate(b for b in range(256) if b not in VISIBLE)}
#: Characters whose class is the same for every Unicode version and regular-expression library.
PLAIN = regex.compile(r"[\t\n\r\x20-\x7E\xA1-\xAC\xAE-\u0233\u0391-\u03A1\u03A3-\u03FF\u0410-\u044F\u4E00-\u9FA5]*+")
#: A cut for certain: a letter, then a blank and a letter.
SEAM = regex.compile(r"[a-z](?= [a-z])")
#: Texts are handed to the library in groups of about so many characters.
GROUP_CHARS = 1 << 17
#: Pieces a task remembers before it starts anew.
REMEMBERED = 1 << 19


def tokenizer_digest(path: str) -> str:
    """Version of a tokenizer: digest of its file."""
    with open(path, "rb") as f:
        return hashlib.sha256(f.read()).hexdigest()


def content_digest(text: str = "text") -> Column:
    """Digest of the normalised content. Nothing but null is folded, as any other change can change the count."""
    return F.sha2(F.coalesce(F.col(text), F.lit("")).cast("binary"), 256)


class Counter:
    """Counts tokens with the library; pieces of plain text are counted once and remembered."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # one thread per task slot
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.tok.no_padding()
        self.tok.no_truncation()
        config = json.loads(self.tok.to_str())
        pre = config["pre_tokenizer"] or {}
        self.cuts = (pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space")
                     and not config["normalizer"] and config["model"]["type"] == "BPE" and not config["model"].get("ignore_merges"))
        self.special = [t["content"] for t in config["added_tokens"]]
        self.seen: dict[str, int] = {}

    def whole(self, texts: list[str]) -> list[int]:
        return [len(e) for e in self.tok.encode_batch_fast(texts, add_special_tokens=False)]

    def count(self, text: str) -> int:
        if not self.cuts or not PLAIN.fullmatch(text) or any(s in text for s in self.special):
            return self.whole([text])[0]
        total, seen = 0, self.seen
        for start, end in blocks(text):
            found = CUT.findall(text, start, end)
            for piece in set(found).difference(seen):
                seen[piece] = len(self.tok.model.tokenize(piece.encode().decode("latin-1").translate(SHOWN)))
            total += sum(map(seen.__getitem__, found))
            if len(seen) > REMEMBERED:
                seen.clear()
        return total


def blocks(text: str):
    """Spans of about GROUP_CHARS characters that end where a letter is followed by a blank and a letter: a certain cut."""
    start = 0
    while start < len(text):
        seam = SEAM.search(text, start + GROUP_CHARS)
        end = seam.start() + 1 if seam else len(text)
        yield start, end
        start = end


def counter(path: str):
    """Arrow function: (content, text) to (content, n_tokens)."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        library = Counter(path)
        for batch in batches:
            totals = [library.count(v.as_py() or "") for v in batch.column("text")]
            yield pa.RecordBatch.from_arrays([batch.column("content"), pa.array(totals, pa.int64())], ["content", "n_tokens"])

    return count


def read_cache(spark: SparkSession, cache: str) -> DataFrame:
    """The stored counts; a cache that does not exist yet is empty."""
    try:
        return spark.read.schema(CACHE_SCHEMA).parquet(cache)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], CACHE_SCHEMA)


def token_counts(docs: DataFrame, tokenizer_path: str, cache: str, text: str = "text") -> DataFrame:
    """``docs`` with ``n_tokens`` per whole text, without special tokens of the library's own.

    Strings of special tokens inside a text are treated as the library does by default. Equal texts are encoded once
    however many rows have them (map-side combine before the shuffle); null counts as the empty text, which has no
    tokens. Every row is returned, repeated rows too. Two writers that append the same content leave equal rows in the
    cache; reading takes one of them. An existing column ``n_tokens`` is replaced.
    """
    spark = docs.sparkSession
    version = F.lit(tokenizer_digest(tokenizer_path))
    known = read_cache(spark, cache).filter(F.col("tokenizer") == version).select("content", "n_tokens")
    missing = (
        docs.select(content_digest(text).alias("content"), F.coalesce(F.col(text), F.lit("")).alias("text"))
        .groupBy("content").agg(F.first("text").alias("text"))
        .join(known.select("content"), "content", "left_anti")
    )
    fresh = missing.mapInArrow(counter(tokenizer_path), "content string, n_tokens long")
    fresh.select("content", version.alias("tokenizer"), "n_tokens").write.mode("append").parquet(cache)

    counts = read_cache(spark, cache).filter(F.col("tokenizer") == version).groupBy("content").agg(F.first("n_tokens").alias("tokens"))
    return lookup(docs, content_digest(text), counts, "content", n_tokens=lambda c: c("tokens"))
