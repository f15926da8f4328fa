"""Weighted least squares and ridge from additive cross-product statistics.

One pass over the rows yields, per fold or cluster, the matrix
G = sum w * a a'  with  a = [1, x, y]. Every fit, every penalty, every fold
and every bootstrap draw is then arithmetic on these small matrices: training
statistics are total minus fold, a draw is a weighted sum of cluster matrices.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_FLUSH_KEYS = 256


def cross_products(df: DataFrame, x: list[str], y: str, w: str, key: str | None = None) -> DataFrame:
    """Long upper-triangle cross products: key, i, j, value with a = [1, x..., y].

    Each task adds up its rows per key and emits triangle cells; cells are
    then summed with map-side combination. Rows never leave their partition.
    """
    p = len(x) + 2
    iu, ju = np.triu_indices(p)
    sel = df.select(
        (F.col(key) if key else F.lit(0)).alias("_key"),
        F.col(w).cast("double").alias("_w"),
        F.array(F.lit(1.0), *[F.col(c).cast("double") for c in x], F.col(y).cast("double")).alias("_a"),
    )
    key_type = sel.schema["_key"].dataType.simpleString()

    def emit(held):
        for k, g in held.items():
            yield pd.DataFrame({"_key": [k] * len(iu), "i": iu, "j": ju, "value": g[iu, ju]})

    def partial(batches):
        held: dict = {}
        for pdf in batches:
            if not len(pdf):
                continue
            a = np.stack(pdf["_a"].to_numpy())
            wt = pdf["_w"].to_numpy()
            codes, uniques = pd.factorize(pdf["_key"])
            for c, k in enumerate(uniques):
                rows = codes == c
                g = (a[rows] * wt[rows, None]).T @ a[rows]
                held[k] = held[k] + g if k in held else g
            if len(held) > _FLUSH_KEYS:  # many clusters: keep the task's memory bounded
                yield from emit(held)
                held = {}
        yield from emit(held)

    cells = sel.mapInPandas(partial, f"_key {key_type}, i int, j int, value double")
    out = cells.groupBy("_key", "i", "j").agg(F.sum("value").alias("value"))
    return out.withColumnRenamed("_key", key) if key else out.drop("_key")


def cross_products_sql(df: DataFrame, x: list[str], y: str, w: str, keys: list[str]) -> DataFrame:
    """The same statistics as one JVM aggregate per cell, for designs with few columns."""
    a = [F.lit(1.0), *[F.col(c).cast("double") for c in x], F.col(y).cast("double")]
    cells = [(i, j) for i in range(len(a)) for j in range(i, len(a))]
    sums = df.groupBy(*keys).agg(*[F.sum(F.col(w) * a[i] * a[j]).alias(f"g{i}_{j}") for i, j in cells])
    rows = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j"), F.col(f"g{i}_{j}").alias("value")) for i, j in cells])
    return sums.select(*keys, F.explode(rows).alias("c")).select(*keys, "c.*")


def matrix(pdf: pd.DataFrame, p: int) -> np.ndarray:
    g = np.zeros((p, p))
    g[pdf["i"].to_numpy(), pdf["j"].to_numpy()] = pdf["value"].to_numpy()
    return g + np.triu(g, 1).T


def unpacked(cells: np.ndarray, p: int) -> np.ndarray:
    """The matrix whose upper triangle lies in ``cells``, row by row."""
    g = np.zeros((p, p))
    g[np.triu_indices(p)] = cells
    return g + np.triu(g, 1).T


def matrices(pdf: pd.DataFrame, key: str, p: int) -> dict:
    return {k: matrix(part, p) for k, part in pdf.groupby(key)}


def moments(g: np.ndarray):
    """Total weight, mean and population sd of x, mean of y, centred cross products."""
    sw = g[0, 0]
    mean = g[0, 1:] / sw
    centred = g[1:, 1:] - sw * np.outer(mean, mean)
    sd = np.sqrt(np.maximum(np.diag(centred)[:-1] / sw, 0.0))
    sd = np.where(sd < 1e-12, 1.0, sd)
    return sw, mean[:-1], sd, mean[-1], centred


def ridge(g: np.ndarray, penalty: np.ndarray, lam: float) -> tuple[np.ndarray, float, np.ndarray, np.ndarray]:
    """Coefficients on the standardized scale, intercept, mean, sd."""
    _, mean, sd, ybar, c = moments(g)
    a = c[:-1, :-1] / np.outer(sd, sd) + lam * np.diag(penalty)
    b = c[:-1, -1] / sd
    try:
        beta = np.linalg.solve(a, b)
    except np.linalg.LinAlgError:
        beta = np.linalg.lstsq(a, b, rcond=None)[0]
    return beta, float(ybar), mean, sd


def least_squares(g: np.ndarray, intercept: bool = True) -> tuple[np.ndarray, float]:
    """Raw-scale coefficients and intercept; the smallest-norm solution where columns are collinear."""
    if not intercept:
        coef = np.linalg.pinv(g[1:-1, 1:-1], rcond=1e-10, hermitian=True) @ g[1:-1, -1]
        return coef, 0.0
    _, mean, _, ybar, c = moments(g)
    coef = np.linalg.pinv(c[:-1, :-1], rcond=1e-10, hermitian=True) @ c[:-1, -1]
    return coef, float(ybar - mean @ coef)


def squared_error(g: np.ndarray, coef: np.ndarray, intercept: float) -> float:
    """Weighted sum of squared errors of a raw-scale linear model over the rows behind g."""
    v = np.concatenate([[-intercept], -coef, [1.0]])
    return float(max(v @ g @ v, 0.0))


def r_squared(g: np.ndarray, coef: np.ndarray, intercept: float) -> float:
    tot = g[-1, -1] - g[0, -1] ** 2 / g[0, 0]
    return 1.0 - squared_error(g, coef, intercept) / tot if tot > 0 else float("nan")


def raw_scale(beta: np.ndarray, ybar: float, mean: np.ndarray, sd: np.ndarray) -> tuple[np.ndarray, float]:
    coef = beta / sd
    return coef, float(ybar - coef @ mean)


def subset(g: np.ndarray, columns: list[int]) -> np.ndarray:
    """Statistics of the design with only the given x columns."""
    idx = [0, *[c + 1 for c in columns], len(g) - 1]
    return g[np.ix_(idx, idx)]


def cross_validate(folds: dict, penalty: np.ndarray, lambdas: np.ndarray) -> pd.DataFrame:
    """Mean weighted RMSE over the folds for every penalty; scaling is refit inside each fold."""
    total = sum(folds.values())
    rows = []
    for lam in lambdas:
        errs = []
        for g in folds.values():
            coef, b0 = raw_scale(*ridge(total - g, penalty, lam))
            errs.append(np.sqrt(squared_error(g, coef, b0) / g[0, 0]))
        rows.append((float(lam), float(np.mean(errs))))
    return pd.DataFrame(rows, columns=["lam", "rmse"])
