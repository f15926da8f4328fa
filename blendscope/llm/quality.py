"""Quality classifier by co-training of two views.

One view sees the text content (distinct byte trigrams), the other the metadata of the page: language, source, declared
length and layout figures (lines, word length, capitals, digits, marks). Both are naive Bayes models, so fitting is
counting. In every round each view labels the documents it is sure of for the other view, over all unlabelled
documents; then the views are calibrated on labelled rows that no count has used, and their evidence is added.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from blendscope.llm.shared import replace_columns, stored
from blendscope.llm.toxicity import calibrate, logistic

VIEWS = ("text", "meta")
#: Hashed values of the features of each view.
BINS = {"text": 1 << 14, "meta": 1 << 10}
#: Share of the labelled sample that only calibrates.
CALIBRATION = 4
CAPITALS, DIGITS, MARKS = (np.array([c in kind for c in range(256)]) for kind in (
    frozenset(range(65, 91)), frozenset(range(48, 58)), frozenset(b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~")))


@dataclass
class Model:
    """Log ratios per view and bin, and slope and shift of each view and of their sum."""

    ratio: dict[str, np.ndarray]
    scale: dict[str, tuple[float, float]] = field(default_factory=lambda: {"text": (1.0, 0.0), "meta": (1.0, 0.0), "both": (1.0, 0.0)})


class Features:
    """Distinct hashed features of a document in either view."""

    def __init__(self):
        self.mark = np.zeros(BINS["text"], bool)

    def text(self, raw: np.ndarray) -> np.ndarray:
        """Distinct trigrams of the whole text; none under three bytes."""
        self.mark[:] = False
        for start in range(0, len(raw), 1 << 20):
            b = raw[start:start + (1 << 20) + 2].astype(np.uint32)
            gram = b[:-2] | b[1:-1] << np.uint32(8) | b[2:] << np.uint32(16)
            self.mark[gram * np.uint32(2654435761) >> np.uint32(18)] = True
        return np.flatnonzero(self.mark)

    @staticmethod
    def meta(raw: np.ndarray, lang, source, n_chars) -> np.ndarray:
        """Declared fields and layout figures in coarse steps; a null field is a value of its own."""
        counts = np.bincount(raw, minlength=256)
        size, blanks, lines = max(1, len(raw)), int(counts[32] + counts[10]), int(counts[10])
        figures = [lang, source, "none" if n_chars is None else int(np.log2(max(1, n_chars)) * 2)]
        figures += [int(np.log2(size) * 2), int(np.log2(lines + 1)), int(6 * np.log2(1 + size / (blanks + 1)))]
        figures += [int(np.sqrt(counts[kind].sum() / size) * 20) for kind in (CAPITALS, DIGITS, MARKS)]
        return np.array(sorted({hash_of(f"{i}={v}") for i, v in enumerate(figures)}))


def hash_of(word: str) -> int:
    return int.from_bytes(word.encode(), "big") % 1_000_003 * 40_503 % (1 << 20) % BINS["meta"]


def evidence(model: Model, view: str, idx: np.ndarray) -> float:
    """Calibrated log odds of good quality in one view; a document without features gets the prior."""
    slope, shift = model.scale[view]
    raw = model.ratio[view][idx].sum() / np.sqrt(len(idx)) if len(idx) else 0.0
    return slope * float(raw) + shift


def fit(counts: dict[tuple[str, int], np.ndarray]) -> Model:
    """Log ratios of the smoothed shares; the last entry of each count is the number of documents."""
    ratio = {}
    for view in VIEWS:
        good, bad = counts[view, 1], counts[view, 0]
        ratio[view] = np.log((good[:-1] + 1) / (good[-1] + 2)) - np.log((bad[:-1] + 1) / (bad[-1] + 2))
    return Model(ratio)


def documents(batch: pa.RecordBatch, features: Features) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    for text, lang, source, n_chars in zip(*(batch.column(c) for c in ("text", "lang", "source", "n_chars")), strict=True):
        raw = np.frombuffer((text.as_py() or "").encode("utf-8", "replace"), np.uint8)
        yield features.text(raw), features.meta(raw, lang.as_py(), source.as_py(), n_chars.as_py())


def counted(rows: DataFrame, model: Model | None, sure: float) -> dict[tuple[str, int], np.ndarray]:
    """Documents per view, class and bin. Without a model the label ``y`` counts in both views; with one, each view's
    sure verdict counts in the other view."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features, m = Features(), model
        total = {(v, c): np.zeros(BINS[v] + 1) for v in VIEWS for c in (0, 1)}
        for batch in batches:
            labels = batch.column("y").to_pylist()
            for y, idx in zip(labels, documents(batch, features), strict=True):
                if m is None:
                    verdicts = (y, y)
                else:
                    odds = [logistic(np.array(evidence(m, v, i))) for v, i in zip(VIEWS, idx, strict=True)]
                    told = [1 if p >= sure else 0 if p <= 1 - sure else None for p in odds]
                    verdicts = told[::-1]
                for view, i, c in zip(VIEWS, idx, verdicts, strict=True):
                    if c is not None:
                        total[view, c][i] += 1
                        total[view, c][-1] += 1
        for (view, c), n in total.items():
            used = np.flatnonzero(n)
            columns = {"view": pa.array([view] * len(used), pa.string()), "c": pa.array([c] * len(used), pa.int32()), "bin": pa.array(used, pa.int32()), "n": n[used]}
            yield pa.RecordBatch.from_pydict(columns)  # typed, since a task may have counted nothing for a view and class

    parts = rows.mapInArrow(count, "view string, c int, bin int, n double")
    out = {(v, c): np.zeros(BINS[v] + 1) for v in VIEWS for c in (0, 1)}
    for r in parts.groupBy("view", "c", "bin").agg(F.sum("n").alias("n")).collect():  # at most one row per class and bin
        out[r["view"], r["c"]][r["bin"]] = r["n"]
    return out


def calibrated(model: Model, rows: DataFrame) -> Model:
    """Scale both views and their sum on labelled rows (a bounded sample) that are in no count."""
    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features = Features()
        for batch in batches:
            odds = np.array([[evidence(model, v, i) for v, i in zip(VIEWS, idx, strict=True)] for idx in documents(batch, features)]).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([batch.column("y"), pa.array(odds[:, 0]), pa.array(odds[:, 1])], ["y", *VIEWS])

    seen = rows.mapInArrow(measure, "y int, text double, meta double").toPandas().sort_values(["y", *VIEWS])
    if len(seen) < 2:
        return model
    y = seen["y"].to_numpy()
    prior = np.log((y.sum() + 1) / (len(y) - y.sum() + 1))
    for view in VIEWS:
        model.scale[view] = calibrate(seen[view].to_numpy(), y)
    both = sum(a * seen[v].to_numpy() + b for v, (a, b) in ((v, model.scale[v]) for v in VIEWS)) - prior
    slope, shift = calibrate(both, y)
    model.scale["both"] = (slope, shift - slope * prior)
    return model


def train_quality(docs: DataFrame, labels: DataFrame, rounds: int = 2, sure: float = 0.98, max_rows: int = 20_000) -> Model:
    """A model from documents (``doc_id, text, lang, source, n_chars``) and labels (``doc_id, quality`` 0 or 1).

    About ``max_rows`` labelled documents at most, chosen by hash of the id, are used with their labels; all others are
    the unlabelled documents from which each view learns what the other is sure of. An id with several labels is good
    only if all say so. Without labels of both classes there is nothing to learn from and every score is 0.5.
    """
    known = labels.filter(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.min("quality").cast("int").alias("y"))
    share = min(1.0, max_rows / max(1, known.count()))
    chosen = known.filter(F.pmod(F.xxhash64(F.lit(12), "doc_id"), F.lit(1 << 30)) < int(share * (1 << 30)))  # bounded by max_rows
    columns = ["text", "lang", "source", "n_chars"]
    every = docs.select("doc_id", *columns)
    sample = stored(every.join(F.broadcast(chosen), "doc_id"), "labelled")
    spare = F.pmod(F.xxhash64(F.lit(13), "doc_id"), F.lit(CALIBRATION)) == 0
    told = counted(sample.filter(~spare).select(*columns, "y"), None, sure)
    model = calibrated(fit(told), sample.filter(spare).select(*columns, "y"))
    if not all(told["text", c][-1] for c in (0, 1)):
        return Model({v: np.zeros(BINS[v]) for v in VIEWS})
    open_rows = every.join(F.broadcast(chosen), "doc_id", "left_anti").select(*columns, F.lit(None).cast("int").alias("y"))
    for _ in range(rounds):
        taught = counted(open_rows, model, sure)
        model = calibrated(fit({k: told[k] + taught[k] for k in told}), sample.filter(spare).select(*columns, "y"))
    return model


def score_quality(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` with ``text_score``, ``meta_score`` (each view's probability of good quality) and ``score`` (both).

    Every row is scored on its whole text. A null or empty text has no text features, so the metadata decide; null
    metadata are values like others. Input columns with the names of the new ones are replaced.
    """
    @F.pandas_udf("text double, meta double, score double")
    def score(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        features, m = Features(), model
        slope, shift = m.scale["both"]
        for text, lang, source, n_chars in batches:
            rows = []
            for t, l, s, n in zip(text, lang, source, n_chars, strict=True):
                raw = np.frombuffer((t or "").encode("utf-8", "replace"), np.uint8)
                a, b = evidence(m, "text", features.text(raw)), evidence(m, "meta", features.meta(raw, l, s, None if pd.isna(n) else int(n)))
                rows.append((a, b, slope * (a + b) + shift))
            yield pd.DataFrame(logistic(np.array(rows, float).reshape(-1, 3)), columns=["text", "meta", "score"])

    scored = docs.select(F.struct("*").alias("row"), score("text", "lang", "source", "n_chars").alias("s"))
    return replace_columns(scored, "row", text_score=F.col("s.text"), meta_score=F.col("s.meta"), score=F.col("s.score"))
