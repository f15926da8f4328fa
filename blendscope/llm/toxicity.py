"""Toxicity: linear classifier on character n-grams scaled by naive Bayes log-count ratios.

Features are the distinct n-grams (3 to 6 characters of the folded text), hashed. Each is scaled by the log ratio of its
smoothed share of toxic and of other documents; a logistic regression is fitted on the scaled features. The fit takes
a bounded sample of labelled rows (``max_rows``, chosen by hash of the id); scoring covers whole texts of all rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from blendscope.llm.shared import replace_columns

#: Score from which a document counts as toxic.
REJECT = 0.7
BITS = 22
SIZES = (3, 4, 5, 6)
MULTIPLIER, STEP = np.uint64(0x9E3779B97F4A7C15), np.uint64(0x100000001B3)
#: ASCII beside letters and digits becomes a space.
FOLD = {c: 32 for c in range(128) if not chr(c).isalnum()}
#: Texts are worked through in blocks of so many characters.
BLOCK = 1 << 18


class Grams:
    """Distinct hashed n-grams of texts; reuses one table of last positions."""

    def __init__(self):
        self.last = np.zeros(1 << BITS, np.int64)
        self.base = 1

    def _new(self, hashed: np.ndarray) -> np.ndarray:
        """Those of ``hashed`` that this text has not had yet, once each."""
        hashed = hashed[self.last[hashed] < self.floor]
        mark = np.arange(self.base, self.base + len(hashed))
        self.last[hashed] = mark
        self.base += len(hashed)
        return hashed[self.last[hashed] == mark]

    def of(self, text: str | None) -> np.ndarray:
        """Hashed n-grams of the text between two spaces; none for a null, empty or punctuation-only text."""
        folded = (text or "").lower().translate(FOLD).strip(" ")
        self.floor, out = self.base, []
        if not folded:
            return np.zeros(0, np.int64)
        chars = np.frombuffer(f" {folded} ".encode("utf-32-le", "replace"), np.uint32)
        chars = chars[np.append(True, (chars[1:] != 32) | (chars[:-1] != 32))]
        shift = np.uint64(64 - BITS)
        for start in range(0, len(chars), BLOCK):
            c = chars[start:start + BLOCK + max(SIZES) - 1].astype(np.uint64) + np.uint64(1)
            key, n = c, 1
            while n < min(max(SIZES), len(c)):
                key, n = key[:-1] * STEP + c[n:], n + 1
                if n in SIZES:
                    out.append(self._new((key * MULTIPLIER >> shift).astype(np.int64)))
        return np.concatenate(out) if out else np.zeros(0, np.int64)


def log_count_ratios(rows: list[np.ndarray], y: np.ndarray) -> np.ndarray:
    """Log ratio of the smoothed share of toxic and of other documents with an n-gram; 0 where fewer than four have it."""
    counts = [np.ones(1 << BITS, np.float32), np.ones(1 << BITS, np.float32)]
    for idx, label in zip(rows, y, strict=True):
        counts[int(label)][idx] += 1
    ratio = np.log(counts[1] / (y.sum() + 2)) - np.log(counts[0] / (len(y) - y.sum() + 2))
    return np.where(counts[0] + counts[1] > 5, ratio, 0).astype(np.float32)


def minimise(loss, x: np.ndarray, rounds: int, memory: int = 6) -> np.ndarray:
    """Limited-memory quasi-Newton descent; ``loss`` gives value and gradient."""
    value, g = loss(x)
    pairs: list[tuple[np.ndarray, np.ndarray]] = []
    for _ in range(rounds):
        d, alphas = -g, []
        for s, t in reversed(pairs):
            alphas.append(s @ d / (s @ t))
            d = d - alphas[-1] * t
        if pairs:
            s, t = pairs[-1]
            d = d * (s @ t / (t @ t))
        for (s, t), alpha in zip(pairs, reversed(alphas), strict=True):
            d = d + (alpha - t @ d / (s @ t)) * s
        step = 1.0 if pairs else 1.0 / max(1.0, float(np.sqrt(g @ g)))
        for _ in range(20):
            after, g_after = loss(x + step * d)
            if after <= value + 1e-4 * step * (g @ d):
                break
            step /= 2
        else:
            break
        s, t = step * d, g_after - g
        if s @ t > 1e-12:
            pairs = [*pairs, (s, t)][-memory:]
        done = value - after < 1e-5 * max(1.0, abs(value))
        x, value, g = x + s, after, g_after
        if done:
            break
    return x


def logistic(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -35, 35)))


def fit(rows: list[np.ndarray], y: np.ndarray, penalty: float = 3e-4, rounds: int = 30, weakest: float = 0.7) -> tuple[np.ndarray, float]:
    """Weight of each hashed n-gram (ratio times coefficient) and intercept of the logistic regression.

    N-grams whose ratio is within ``weakest`` of 0 would enter scaled down and are left out. With labels
    of one class only, or none, all scores are the smoothed share of toxic rows.
    """
    weights = np.zeros(1 << BITS, np.float32)
    share = (y.sum() + 1) / (len(y) + 2)
    if len(np.unique(y)) < 2:
        return weights, float(np.log(share / (1 - share)))
    ratio = log_count_ratios(rows, y)
    rows = [r[np.abs(ratio[r]) > weakest] for r in rows]
    used = np.flatnonzero(np.bincount(np.concatenate(rows), minlength=1 << BITS))
    place = np.zeros(1 << BITS, np.int32)
    place[used] = np.arange(len(used))
    flat = place[np.concatenate(rows)]
    value = ratio[used][flat]
    doc = np.repeat(np.arange(len(rows), dtype=np.int32), [len(r) for r in rows])

    def loss(x):
        z = np.bincount(doc, value * x[:-1].astype(np.float32)[flat], len(y)) + x[-1]
        g = (logistic(z) - y) / len(y)
        grad = np.append(np.bincount(flat, value * g.astype(np.float32)[doc], len(used)) + penalty * x[:-1], g.sum())
        return float(np.mean(np.logaddexp(0, z) - y * z) + penalty / 2 * (x[:-1] @ x[:-1])), grad

    x = minimise(loss, np.append(np.zeros(len(used)), np.log(share / (1 - share))), rounds)
    weights[used] = x[:-1] * ratio[used]
    return weights, float(x[-1])


def calibrate(z: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and intercept of the probability of label 1 given a raw score (Platt's smoothed targets)."""
    if len(np.unique(y)) < 2:
        return 1.0, 0.0
    goal = np.where(y == 1, (y.sum() + 1) / (y.sum() + 2), 1 / (len(y) - y.sum() + 2))

    def loss(x):
        p = x[0] * z + x[1]
        g = (logistic(p) - goal) / len(z)
        return float(np.mean(np.logaddexp(0, p) - goal * p)) + 1e-6 * float(x @ x), np.array([g @ z, g.sum()]) + 2e-6 * x

    slope, intercept = minimise(loss, np.array([1.0, 0.0]), 100)
    return (float(slope), float(intercept)) if slope > 0 else (1.0, 0.0)


def featurise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    grams = Grams()
    for batch in batches:
        rows = pa.array([grams.of(t.as_py()).astype(np.int32) for t in batch.column("text")], pa.list_(pa.int32()))
        yield pa.RecordBatch.from_arrays([batch.column("place"), batch.column("y"), rows], ["place", "y", "grams"])


def train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One task: fit on four fifths of the sample, calibrate on the rest, emit the model (n-grams with a weight)."""
    rows, y, place = [], [], []
    for batch in batches:
        place += batch.column("place").to_pylist()
        lists = batch.column("grams")
        values, offsets = lists.values.to_numpy(), lists.offsets.to_numpy()
        rows += [values[a:b] for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
        y += batch.column("y").to_pylist()
    order = np.lexsort(([len(r) for r in rows], y, place))  # the same model whatever order the rows come in
    rows, y = [rows[i] for i in order], np.array(y, np.int32)[order]
    rest = np.arange(len(y)) % 5 == 4
    weights, intercept = fit([r for r, x in zip(rows, rest, strict=True) if not x], y[~rest])
    raw = np.array([weights[r].sum() + intercept for r, x in zip(rows, rest, strict=True) if x])
    slope, shift = calibrate(raw, y[rest])
    used = np.flatnonzero(weights)
    yield pa.RecordBatch.from_pydict({"used": [used], "weights": [weights[used]], "intercept": [intercept], "slope": [slope], "shift": [shift]})


def train_toxicity(docs: DataFrame, labels: DataFrame, max_rows: int = 6_000):
    """A fitted model from labelled documents: ``labels`` has doc_id and toxic (0 or 1, other values are not used).

    At most about ``max_rows`` labelled documents are used, chosen by hash of the id, so the sample that meets in the
    fitting task is bounded. An id with several labels counts as toxic if one of them says so.
    """
    spark = docs.sparkSession
    known = labels.filter(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("y"))
    share = min(1.0, max_rows / max(1, known.count()))
    chosen = known.filter(F.pmod(F.xxhash64(F.lit(11), "doc_id"), F.lit(1 << 30)) < int(share * (1 << 30)))  # bounded by max_rows
    sample = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select(
        F.xxhash64("doc_id").alias("place"), "text", "y").mapInArrow(featurise, "place long, y int, grams array<int>")
    model = sample.repartition(1).mapInArrow(  # the bounded sample meets in one task
        train, "used array<bigint>, weights array<float>, intercept double, slope double, shift double")
    return model.first()


def score_toxicity(docs: DataFrame, model, text: str = "text") -> DataFrame:
    """``docs`` with ``score``, the calibrated probability that the whole text is toxic.

    A null, empty or punctuation-only text has no n-grams and gets the model's base rate. Every row is returned with
    all columns; an existing column ``score`` is replaced.
    """
    weights = np.zeros(1 << BITS, np.float32)  # bounded by the hash range, whatever the corpus
    weights[np.array(model["used"], np.int64)] = np.array(model["weights"], np.float32)
    shared = docs.sparkSession.sparkContext.broadcast((weights, model["intercept"], model["slope"], model["shift"]))

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        grams = Grams()
        w, intercept, slope, shift = shared.value
        for texts in batches:
            yield pd.Series(logistic(slope * (np.array([w[grams.of(t)].sum() for t in texts], float) + intercept) + shift))

    return replace_columns(docs.select(F.struct("*").alias("row"), score(F.col(text)).alias("s")), "row", score=F.col("s"))
