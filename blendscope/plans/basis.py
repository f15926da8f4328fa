"""Archetype basis: distributed fit of k extreme real rows, and projection onto it (2.10).

Feature rows stay distributed. Only the basis and the candidate rows, whose
number is fixed by k and the feature count, travel through the driver.
"""

from __future__ import annotations

import time
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from blendscope.functions import vectors as vec
from blendscope.operators import ordered, simplex, stats
from blendscope.session import cut_lineage, spread


@dataclass
class Basis:
    """k exemplar rows in z-space with the statistics that produced the z-scores."""

    vectors: np.ndarray
    mu: np.ndarray
    sd: np.ndarray
    features: list[str]
    exemplars: list[dict] = field(default_factory=list)
    meta: dict = field(default_factory=dict)

    @property
    def k(self) -> int:
        return len(self.vectors)

    def frame(self, spark: SparkSession) -> DataFrame:
        """component, z[p] and the exemplar's identity: k rows."""
        rows = [
            (i, [float(x) for x in v], *( [self.exemplars[i].get("member"), self.exemplars[i].get("season")]
                                          if self.exemplars else [None, None]))
            for i, v in enumerate(self.vectors)
        ]
        return spark.createDataFrame(rows, "component int, z array<double>, member bigint, season string")

    def zscore(self, columns: list[str] | None = None) -> Column:
        cols = columns or self.features
        return F.array(*[
            (F.col(c).cast("double") - F.lit(float(m))) / F.lit(float(s)) for c, m, s in zip(cols, self.mu, self.sd)
        ])


def population_stats(df: DataFrame, features: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Mean and sample sd of every feature, in one aggregate row."""
    aggs = []
    for c in features:
        aggs += [F.avg(c).alias(f"m_{c}"), F.stddev_samp(c).alias(f"s_{c}")]
    row = df.agg(*aggs).first()
    mu = np.array([row[f"m_{c}"] for c in features], dtype=float)
    sd = np.array([row[f"s_{c}"] for c in features], dtype=float)
    dead = [c for c, s in zip(features, sd) if not s > 1e-12]
    if dead:
        raise ValueError(f"features without variance: {dead}")
    return mu, sd


def _candidate_rows(z: DataFrame, p: int, directions: np.ndarray) -> pd.DataFrame:
    """The extreme row of the population along each direction.

    Each partition emits one row per direction; the largest one is kept.
    """
    columns = list(z.columns)
    keys = [c for c in columns if c != "z"]
    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in z.schema.fields)

    def extremes(batches):
        best_score = np.full(len(directions), -np.inf)
        best_row: list = [None] * len(directions)
        for pdf in batches:
            if not len(pdf):
                continue
            x = np.stack(pdf["z"].to_numpy())
            score = x @ directions.T
            top = score.argmax(axis=0)
            for d, r in enumerate(top):
                if score[r, d] > best_score[d]:
                    best_score[d] = score[r, d]
                    best_row[d] = pdf.iloc[int(r)]
        rows = [(d, s, r) for d, (s, r) in enumerate(zip(best_score, best_row)) if r is not None]
        if rows:
            out = pd.DataFrame([r for _, _, r in rows]).reset_index(drop=True)
            out["direction"] = [d for d, _, _ in rows]
            out["score"] = [s for _, s, _ in rows]
            yield out[[*columns, "direction", "score"]]

    found = z.mapInPandas(extremes, f"{fields}, direction int, score double")
    best = found.groupBy("direction").agg(
        F.max_by(F.struct(*columns), F.struct("score", *keys)).alias("r")).select("r.*").distinct()
    pdf = best.toPandas()  # at most one row per direction
    return pdf.sort_values(keys, kind="stable").reset_index(drop=True)


def _furthest_sum(x: np.ndarray, k: int, seed: int) -> list[int]:
    """Start indices: a seeded first row, then always the row furthest from the chosen ones."""
    rng = np.random.default_rng(seed)
    chosen = [int(rng.integers(len(x)))]
    dist = np.sqrt(((x[:, None, :] - x[None, :, :]) ** 2).sum(axis=2))
    while len(chosen) < k + 1:
        total = dist[chosen].sum(axis=0)
        total[chosen] = -np.inf
        chosen.append(int(total.argmax()))
    return chosen[1:]  # the seeded row only gives the direction


#: Rows on which swaps are priced (those with the smallest hashes; all rows of a smaller population).
PANEL = 512
#: Rows per basis vector that a round tries on the whole population: those with the largest gain on the panel.
TRIED = 8
#: Local searches on the panel that decide where a run starts.
RESTARTS = 6
#: Groups of classes on either side of the tiles in which pairs meet their mixtures.
COVERAGE_GROUPS = 16
#: Populations up to this size end with a round that tries every row.
EVERY_ROW = 1000


def _panel(z: DataFrame, keys: list[str], size: int) -> pd.DataFrame:
    """A fixed sample of at most ``size`` different rows."""
    rows = z.select(*keys, "z", "times", F.xxhash64("z").alias("h"))
    return rows.orderBy("h", *keys).limit(size).toPandas()


def _starts(spark: SparkSession, sample: np.ndarray, times: np.ndarray, rows: np.ndarray, n_sample: int, runs: list[tuple[int, int]], restarts: int, tried: int) -> dict[int, list[int]]:
    """Where each run starts: the best of ``restarts`` local searches on the panel, side by side in tasks.

    One search begins with extreme rows that lie far apart, the others with random rows of panel and extremes."""
    where = spark.createDataFrame([(r, k, s, a) for r, (k, s) in enumerate(runs) for a in range(restarts)], "run int, k int, seed int, attempt int")
    held = spark.sparkContext.broadcast((sample, times, rows))  # a panel and the extreme rows

    def search(batches):
        x, counts, every = held.value
        distinct = np.unique(every, axis=0, return_index=True)[1]
        for pdf in batches:
            out = []
            for r, k, seed, attempt in pdf.itertuples(index=False):
                far = every[n_sample:]
                if attempt == 0 and len(far) > k:
                    chosen = [n_sample + j for j in _furthest_sum(far, k, seed)]
                else:
                    rng = np.random.default_rng([seed, attempt])
                    chosen = rng.choice(distinct, k, replace=len(distinct) < k).tolist()
                loss, chosen = simplex.local_search(x, every, chosen, tried, 1e-3, counts)
                out.append((r, attempt, loss, chosen))
            yield pd.DataFrame(out, columns=["run", "attempt", "loss", "chosen"])

    found = where.repartition(len(runs) * restarts).mapInPandas(search, "run int, attempt int, loss double, chosen array<int>")
    best = found.groupBy("run").agg(F.min_by("chosen", F.struct("loss", "attempt")).alias("chosen"))
    return {r["run"]: r["chosen"] for r in best.collect()}  # k numbers per run


def different_rows(z: DataFrame, keys: list[str], digits: int = 9) -> tuple[DataFrame, int]:
    """The different rows with the smallest key of each and how often it occurs (``times``), and the number of all rows.

    Rows are equal at ``digits`` digits, so sums of another order do not tell copies apart.
    """
    same = F.transform("z", lambda x: F.round(x, digits))
    first = F.struct(*keys, "z")
    rows = z.groupBy(same.alias("_same")).agg(F.min(first).alias("r"), F.count(F.lit(1)).alias("times"))
    held = spread(rows.select("r.*", "times"))
    return held, held.agg(F.sum("times")).first()[0] or 0


def _price_swaps(z: DataFrame, keys: list[str], bases: dict[int, np.ndarray], panel: np.ndarray, times: np.ndarray, top: int) -> pd.DataFrame:
    """The ``top`` rows of the whole population with the largest gain in place of each vector of each basis, net of what
    leaving that vector out costs on the panel.

    Every row is priced in one pass; a task keeps its best rows per vector, so ``top`` rows per vector reach the driver.
    """
    types = {f.name: f.dataType.simpleString() for f in z.schema.fields}
    schema = ", ".join(f"{c} {types[c]}" for c in (*keys, "z")) + ", run int, place int, gain double"

    def best(batches):
        priced = {r: simplex.Panel(panel, b, times) for r, b in bases.items()}
        held = None
        for pdf in batches:
            if not len(pdf):
                continue
            x = np.stack(pdf["z"].to_numpy())
            parts = [] if held is None else [held]
            for r, p in priced.items():
                gains = p.gains(x) - p.cost[:, None]
                gains[:, (np.abs(x[:, None, :] - bases[r][None]).max(axis=2) < 1e-12).any(axis=1)] = -np.inf
                for i, g in enumerate(gains):
                    first = np.argpartition(-g, min(top, len(g)) - 1)[:top]
                    parts.append(pdf.iloc[first].assign(run=r, place=i, gain=g[first]))
            every = pd.concat(parts, ignore_index=True)
            held = every.sort_values(["gain", *keys], ascending=[False, *[True] * len(keys)], kind="stable").groupby(["run", "place"]).head(top)
        if held is not None:
            yield held[np.isfinite(held["gain"])]

    found = z.select(*keys, "z").mapInPandas(best, schema)
    w = Window.partitionBy("run", "place").orderBy(F.desc("gain"), *keys)
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= top).toPandas()


def _score_swaps(z: DataFrame, bases: dict[int, np.ndarray], swaps: dict[int, list[tuple[int, np.ndarray]]]) -> tuple[dict, float]:
    """Loss of several bases and of their given swaps on the whole population, in one pass over the rows."""
    def partial(batches):
        sums = {r: np.zeros(len(s) + 1) for r, s in swaps.items()}
        tss = 0.0
        for pdf in batches:
            if not len(pdf):
                continue
            x = np.stack(pdf["z"].to_numpy())
            times = pdf["times"].to_numpy(dtype=float)
            tss += float(times @ (x * x).sum(axis=1))
            for r, basis in bases.items():
                base, swapped = simplex.swap_losses(x, basis, swaps[r], times)
                sums[r] += np.concatenate([[base], swapped])
        run = np.concatenate([np.full(len(v), r) for r, v in sums.items()] + [[-1]])
        cell = np.concatenate([np.arange(len(v)) for v in sums.values()] + [[0]])
        yield pd.DataFrame({"run": run, "cell": cell, "loss": np.concatenate([*sums.values(), [tss]])})

    added = z.select("z", "times").mapInPandas(partial, "run int, cell int, loss double").groupBy("run", "cell").agg(F.sum("loss").alias("loss"))
    pdf = added.toPandas().sort_values(["run", "cell"])  # one number per swap
    by_run = {int(r): part["loss"].to_numpy() for r, part in pdf.groupby("run")}
    tss = float(by_run.pop(-1)[0])
    return {r: (float(v[0]), v[1:]) for r, v in by_run.items()}, tss


@dataclass
class _Search:
    """State of one run: chosen rows, loss, and what is known about further swaps."""

    k: int
    seed: int
    rows: list[dict]
    rss: float = np.inf
    rounds: int = 0
    tried: int = 0
    best_left: float = 0.0
    open: bool = True
    every_row: bool = False

    @property
    def basis(self) -> np.ndarray:
        return np.stack([r["z"] for r in self.rows])

    def take(self, loss: float, losses: np.ndarray, swaps: list[tuple[int, dict]], tol: float, again: bool = False) -> bool:
        """Apply the best of the scored swaps if it lowers the loss by more than ``tol`` of it. ``again``: further swaps of a round."""
        self.rss, self.rounds, self.tried = loss, self.rounds + (not again), self.tried + len(swaps)
        best = float((loss - losses.min()) / loss) if len(losses) and loss > 0 else 0.0
        self.best_left = max(best, self.best_left) if again else best
        if best <= tol:
            return False
        place, row = swaps[int(losses.argmin())]
        self.rows[place], self.rss = row, float(losses.min())
        return True


def fit_runs(
    df: DataFrame, features: list[str], runs: list[tuple[int, int]], *, keys: tuple[str, ...] = ("member", "season"),
    max_iter: int = 200, tol: float = 1e-4, winsorize: float | None = None, n_directions: int | None = None,
    panel: int = PANEL, tried: int = TRIED, restarts: int = RESTARTS, every_row: int = 0,
) -> list[Basis]:
    """Choose k real rows that minimize the simplex-projection loss, for several (k, seed) at once (F2).

    A run starts from the best of several local searches on a fixed panel of rows. Then column generation over the
    whole population: a round prices every row in place of every chosen one by a lower
    bound of its gain on the panel and brings in the ``tried`` best rows of every place. The ``tried`` swaps of a run that
    price best are scored exactly on all rows, and where none of them helps all the others are; the best scored
    swap of each run is taken. A run ends when none of the rows that price best lowers the loss by more than ``tol`` of it; with
    a population of at most ``every_row`` rows it then tries all of them, and goes on if one does. More seeds or values
    of k add arithmetic but no passes. Equal rows are one row that counts as often. ``meta`` says what was tried (``certificate``).
    """
    started = time.time()
    if winsorize is not None:
        df = stats.winsorize(df, features, winsorize)
    mu, sd = population_stats(df, features)
    model = Basis(np.zeros((0, len(features))), mu, sd, list(features))
    z, n_rows = different_rows(df.select(*keys, model.zscore().alias("z")), list(keys))
    p, k_max = len(features), max(k for k, _ in runs)
    rand = np.random.default_rng(1000).standard_normal((n_directions or 4 * k_max, p))
    directions = np.vstack([np.eye(p), -np.eye(p), rand / np.linalg.norm(rand, axis=1, keepdims=True)])
    pool = _candidate_rows(z.select(*keys, "z"), p, directions)  # where the searches start
    if len(pool) < k_max:
        raise ValueError(f"only {len(pool)} distinct extreme rows for k={k_max}")
    start = np.stack(pool["z"].to_numpy())
    records = pool[[*keys, "z"]].to_dict("records")
    sampled = _panel(z, list(keys), panel)
    sample, times, tss = np.stack(sampled["z"].to_numpy()), sampled["times"].to_numpy(dtype=float), np.inf
    first = _starts(z.sparkSession, sample, times, np.vstack([sample, start]), len(sample), runs, restarts, tried)
    records = [*sampled[[*keys, "z"]].to_dict("records"), *records]
    searches = [_Search(k, s, [records[j] for j in first[r]]) for r, (k, s) in enumerate(runs)]

    def score(swaps: dict[int, list[tuple[int, dict]]], again: bool = False) -> tuple[set, float]:
        scored, total = _score_swaps(z, {r: searches[r].basis for r in swaps}, {r: [(i, row["z"]) for i, row in s] for r, s in swaps.items()})
        return {r for r, (loss, losses) in scored.items() if searches[r].take(loss, losses, swaps[r], tol, again)}, total

    for _ in range(max_iter):
        live = [r for r, s in enumerate(searches) if s.open]
        if not live:
            break
        priced = _price_swaps(z, list(keys), {r: searches[r].basis for r in live}, sample, times, tried)
        priced = priced.sort_values(["run", "gain", "place", *keys], ascending=[True, False, True, *[True] * len(keys)], kind="stable")
        by_run = {r: [(int(t["place"]), t) for t in part.to_dict("records")] for r, part in priced.groupby("run")}
        moved, tss = score({r: by_run.get(r, [])[:tried] for r in live})
        later = {r: s for r in live if r not in moved and (s := by_run.get(r, [])[tried:])}
        if later:  # where the best prices do not help, all priced swaps are scored before a run counts as settled
            moved |= score(later, True)[0]
        still = [r for r in live if r not in moved]
        if still and n_rows <= every_row:
            rows = z.select(*keys, "z").toPandas().to_dict("records")  # at most every_row rows
            moved, tss = score({r: [(i, row) for i in range(searches[r].k) for row in rows] for r in still})
            for r in still:
                searches[r].every_row = r not in moved
            still = [r for r in still if r not in moved]
        for r in still:
            searches[r].open = False
    out = []
    for s in searches:
        ex = [{c: (int(row[c]) if c == "member" else row[c]) for c in keys} for row in s.rows]
        meta = {"k": s.k, "seed": s.seed, "rss": s.rss, "explained_var": 1.0 - s.rss / tss, "n_iter": s.rounds, "max_iter": max_iter,
                "converged": not s.open, "seconds": time.time() - started, "winsorize": winsorize,
                "certificate": {"rows_priced": n_rows, "panel_rows": len(sample), "swaps_tried": s.tried, "largest_gain_left": s.best_left, "every_row_tried": s.every_row}}
        out.append(Basis(s.basis, mu, sd, list(features), ex, meta))
    return out


def fit(df: DataFrame, features: list[str], k: int, *, seed: int = 0, **kw) -> Basis:
    """One fit."""
    return fit_runs(df, features, [(k, seed)], **kw)[0]


def fit_best(df: DataFrame, features: list[str], k: int, seeds: tuple[int, ...] = (0, 1, 2), **kw) -> Basis:
    """Several starts, the one with the largest explained variance."""
    return best_of(fit_runs(df, features, [(k, s) for s in seeds], **{"every_row": EVERY_ROW} | kw))


def best_of(fits: list[Basis]) -> Basis:
    ev = [f.meta["explained_var"] for f in fits]
    best = fits[int(np.argmax(ev))]
    best.meta |= {"ev_spread": max(ev) - min(ev), "all_converged": all(f.meta["converged"] for f in fits)}
    return best


def projector(vectors: np.ndarray):
    """Arrow batch function: z[p] -> weights[k] on a fixed basis."""
    b = np.asarray(vectors, dtype=float)
    k = len(b)

    @F.pandas_udf(T.ArrayType(T.DoubleType()))
    def run(z: pd.Series) -> pd.Series:
        out = pd.Series([None] * len(z), dtype=object)
        good = z.notna().to_numpy()
        if good.any():
            x = np.stack(z[good].to_numpy()).astype(float)
            finite = np.isfinite(x).all(axis=1)
            w = np.full((len(x), k), np.nan)
            w[finite] = simplex.project(x[finite], b)
            pos = np.flatnonzero(good)
            for row, weights, fine in zip(pos, w, finite):
                out.iat[row] = weights.tolist() if fine else None
        return out

    return run


def project(df: DataFrame, basis: Basis, keep: list[str], out: str = "recipe", z: str | None = None, strict: bool = False) -> DataFrame:
    """Mixture weights of every row on a fixed basis with its own mean and sd: no shuffle.

    A row with a null or non-finite feature gets a null mixture, or with ``strict`` ends the job with the name of the
    first such feature (F12); the test is part of the projection, not another pass.
    """
    source = F.col(z) if z else basis.zscore()
    if strict:
        if z:
            raise ValueError("strict needs the feature columns")
        lacking = F.array_compact(F.array(*[F.when(F.col(c).isNull() | F.isnan(F.col(c).cast("double")), F.lit(c)) for c in basis.features]))
        message = F.concat(F.lit("feature without a value in a fixed-basis projection: "), F.element_at(lacking, 1))
        source = F.when(F.size(lacking) > 0, F.raise_error(message)).otherwise(source)
    return df.select(*keep, source.alias("z")).withColumn(out, projector(basis.vectors)("z"))


def novelty(df: DataFrame, basis: Basis, recipe: str = "recipe", z: str = "z") -> Column:
    """Reconstruction residual ||z - aB|| / sqrt(p) (F16)."""
    p, k = basis.vectors.shape[1], basis.k
    terms = []
    for f in range(p):
        approx = vec.total([F.col(recipe)[i] * F.lit(float(basis.vectors[i, f])) for i in range(k)])
        terms.append((F.col(z)[f] - approx) * (F.col(z)[f] - approx))
    return F.sqrt(vec.total(terms)) / F.lit(float(np.sqrt(p)))


def match_exemplars(projected: DataFrame, basis: Basis, keys: list[str]) -> DataFrame:
    """Nearest population row of each basis vector; real rows give distance 0."""
    def distance(v: np.ndarray) -> Column:
        return F.sqrt(vec.total([(F.col("z")[f] - F.lit(float(x))) * (F.col("z")[f] - F.lit(float(x))) for f, x in enumerate(v)]))

    near = []
    for i, v in enumerate(basis.vectors):
        d = distance(v)
        near += [F.min_by(F.struct(*keys), F.struct(d.alias("d"), *keys)).alias(f"r{i}"), F.min(d).alias(f"d{i}")]
    cells = F.array(*[F.struct(F.lit(i).alias("component"), F.col(f"r{i}").alias("r"), F.col(f"d{i}").alias("distance")) for i in range(basis.k)])
    return projected.agg(*near).select(F.explode(cells).alias("c")).select("c.component", "c.r.*", "c.distance")


def describe(basis: DataFrame, features: list[str], n: int) -> DataFrame:
    """Highest and lowest n features of each basis row (T4, F9). ``basis``: component, z[p]; k rows."""
    names = F.array(*[F.lit(f) for f in features])
    rows = basis.select("component", F.posexplode("z").alias("idx", "z")).withColumn(
        "feature", F.element_at(names, F.col("idx") + 1))
    w = Window.partitionBy("component")
    hi = rows.withColumn("rank", F.row_number().over(w.orderBy(F.col("z").desc(), "idx"))).withColumn("side", F.lit("head"))
    lo = rows.withColumn("rank", F.row_number().over(w.orderBy("z", "idx"))).withColumn("side", F.lit("tail"))
    return hi.unionByName(lo).where(F.col("rank") <= n)


def labels(basis: DataFrame, curated: DataFrame, names: DataFrame) -> DataFrame:
    """Curated label of a component, or its exemplar's name."""
    return basis.join(curated, "component", "left").join(names.select("member", "name"), "member", "left").select(
        "component", "member", F.coalesce("label", "name").alias("label"), "quality", "note")


def intra_variance(projected: DataFrame, p: int, keys: list[str] | None = None, times: str | None = None) -> DataFrame:
    """Size-weighted within-group squared distance after assigning each row to its top component.

    A row counts ``times`` times (a column), if that is given.

    Uses sums and sums of squares, so a component that holds a third of all
    rows is still one partial row per task.
    """
    keys, one = keys or [], F.col(times) if times else F.lit(1)
    g = projected.groupBy(*keys, vec.argmax("recipe").alias("component")).agg(
        F.sum(one).alias("n"),
        *[F.sum(one * F.col("z")[i]).alias(f"s{i}") for i in range(p)],
        F.sum(one * vec.dot("z", "z", p)).alias("ss"),
    ).where(F.col("n") >= 2)
    ss = F.col("ss") - vec.total([F.col(f"s{i}") * F.col(f"s{i}") for i in range(p)]) / F.col("n")
    g = g.withColumn("within", ss)
    agg = [(F.sum("within") / F.sum("n")).alias("intra_variance"), F.sum("n").alias("n_rows")]
    return g.groupBy(*keys).agg(*agg) if keys else g.agg(*agg)


def check_optimality(projected: DataFrame, basis: Basis, tolerance: float = 1e-4) -> DataFrame:
    """One row: how many projections are no optimum of the simplex problem.

    Weights must be a mixture, and no component may have a smaller slope of the squared error than those in use.
    """
    v = basis.vectors
    rest = [sum((F.col("recipe")[j] * F.lit(float(v[j, f])) for j in range(basis.k)), F.lit(0.0)) - F.col("z")[f] for f in range(v.shape[1])]
    slopes = F.array(*[sum((r * F.lit(float(v[j, f])) for f, r in enumerate(rest)), F.lit(0.0)) for j in range(basis.k)])
    used = F.zip_with("slopes", "recipe", lambda g, w: F.when(w > 1e-6, g))
    scale = F.lit(1.0) + F.array_max(F.transform("slopes", F.abs))
    gap = (F.array_max(used) - F.array_min("slopes")) / scale
    mixture = (F.abs(F.aggregate("recipe", F.lit(0.0), lambda a, x: a + x) - 1.0) < 1e-6) & (F.array_min("recipe") >= -1e-9)
    return projected.select("recipe", slopes.alias("slopes")).agg(
        F.count("*").alias("n_rows"), F.count_if(~mixture).alias("n_no_mixture"), F.count_if(gap > tolerance).alias("n_not_optimal"))


def sweep(df: DataFrame, features: list[str], ks: list[int], seeds: tuple[int, ...] = (0,), keys=("member", "season"), **kw) -> DataFrame:
    """Grid over k and seeds with loss, explained variance and within variance (F7, SRC21)."""
    return sweep_table(df, fit_runs(df, features, [(k, s) for k in ks for s in seeds], keys=keys, **kw), keys)


def sweep_table(df: DataFrame, fits: list[Basis], keys=("member", "season")) -> DataFrame:
    """One row per fit. All fits project every different row in one pass; their within variances are one aggregate, in
    which a row counts as often as it occurs."""
    spark, p = df.sparkSession, len(fits[0].features)
    rows, _ = different_rows(df.select(*keys, fits[0].zscore().alias("z")), list(keys))
    weights = [F.struct(F.lit(i).alias("fit"), projector(b.vectors)("z").alias("recipe")) for i, b in enumerate(fits)]
    each = rows.select("z", "times", F.explode(F.array(*weights)).alias("f")).select("z", "times", "f.*")
    within = {r["fit"]: r["intra_variance"] for r in intra_variance(each, p, ["fit"], "times").collect()}  # one row per fit
    rows = [(b.meta["k"], b.meta["seed"], b.meta["rss"], b.meta["explained_var"], within.get(i), b.meta["n_iter"], b.meta["converged"], b.meta["seconds"])
            for i, b in enumerate(fits)]
    return spark.createDataFrame(
        rows, "k int, seed int, rss double, explained_var double, intra_variance double, n_iter int, converged boolean, seconds double")


def summarize_sweep(raw: DataFrame) -> DataFrame:
    """Best seed per k with the spread over seeds and the change against the previous k."""
    best = raw.groupBy("k").agg(
        F.max_by(F.struct("rss", "explained_var", "intra_variance"), F.struct("explained_var", -F.col("seed"))).alias("b"),
        (F.max("explained_var") - F.min("explained_var")).alias("ev_spread"), F.bool_and("converged").alias("all_converged"),
        F.max("n_iter").alias("max_n_iter"), F.sum("seconds").alias("total_seconds"),
    ).select("k", "b.*", "ev_spread", "all_converged", "max_n_iter", "total_seconds")
    return ordered.lag_over_bounded(best, [], "k", {
        "_ev": F.lag("explained_var"), "_iv": F.lag("intra_variance"),
    }).withColumn("ev_gain", F.col("explained_var") - F.col("_ev")).withColumn(
        "intra_change", F.col("intra_variance") - F.col("_iv")).drop("_ev", "_iv")


def cell_mass(pairs: DataFrame, recipes: DataFrame, k: int) -> DataFrame:
    """Weight of each unordered component cell over all pairs, with its share."""
    a = recipes.select(F.col("member").alias("a"), "season", F.col("recipe").alias("ra"))
    b = recipes.select(F.col("member").alias("b"), "season", F.col("recipe").alias("rb"))
    j = pairs.join(a, ["a", "season"]).join(b, ["b", "season"])
    cells = vec.triangle(k)
    # The full matrix holds both orders of a cell; the triangle keeps one entry of the symmetric sum.
    sums = j.agg(*[F.sum(F.col("min") * vec.symmetric_cell("ra", "rb", i, c)).alias(f"c{i}_{c}") for i, c in cells],
                 F.count(F.lit(1)).alias("n_pairs"))
    total = vec.total([F.col(f"c{i}_{c}") for i, c in cells])
    rows = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(c).alias("j"), F.col(f"c{i}_{c}").alias("mass"),
                              (F.col(f"c{i}_{c}") / total).alias("share")) for i, c in cells])
    return sums.select("n_pairs", F.explode(rows).alias("c")).select("c.*", "n_pairs")


def coverage_summary(cells: DataFrame, starve_ratio: float = 0.10) -> DataFrame:
    """Cells above the starvation threshold, thinnest and median cell (F8). ``cells``: k(k+1)/2 rows."""
    whole = cells.agg(F.sum("mass").alias("total"), F.count(F.lit(1)).alias("n_cells"))
    j = cells.crossJoin(F.broadcast(whole))  # one row
    cut = F.lit(starve_ratio) * F.col("total") / F.col("n_cells")
    return j.agg(
        F.max("n_cells").alias("n_cells"), F.count_if(F.col("mass") > cut).alias("effective_cells"),
        F.min("mass").alias("min_mass"), F.percentile("mass", F.lit(0.5)).alias("median_mass"), F.max("n_pairs").alias("n_pairs"))


def coverage_by_k(pairs: DataFrame, population: DataFrame, fits: list[Basis], starve_ratio: float = 0.10) -> DataFrame:
    """Coverage of the component pairs for each fit (F8, F17): one row per k; all k in one pass over the pairs.

    Members with the same row (at 9 digits) are one class. Pairs meet the number of the class of either member, are
    summed per pair of classes, and meet in tiles of two groups of classes: a tile has the mixtures of its groups and
    forms the cells of every k by matrix products. So a mixture travels once per tile of its group and never with a pair.
    """
    spark = population.sparkSession
    z = population.select("member", "season", fits[0].zscore().alias("z")).withColumn("same", F.transform("z", lambda x: F.round(x, 9)))
    classes = cut_lineage(spread(z.groupBy("same").agg(F.min("z").alias("z"))).withColumn("class", F.monotonically_increasing_id()))
    known = cut_lineage(z.join(classes.select("same", "class"), "same").select("member", "season", "class"))
    a, b = (known.select(F.col("member").alias(side), "season", F.col("class").alias(f"c{side}")) for side in "ab")
    met = pairs.select("season", "a", "b", "min").join(a, ["a", "season"]).join(b, ["b", "season"])
    groups = max(4, min(COVERAGE_GROUPS, classes.count() // 25_000))

    def group(c: str) -> Column:
        return F.pmod(F.col(c), F.lit(groups)).cast("int")

    summed = met.groupBy(F.least("ca", "cb").alias("ca"), F.greatest("ca", "cb").alias("cb")).agg(
        F.sum(F.col("min").cast("double")).alias("min"), F.count(F.lit(1)).alias("n"))
    left = summed.select(group("ca").alias("ga"), group("cb").alias("gb"), "ca", "cb", "min", "n")
    mixed = cut_lineage(classes.select("class", group("class").alias("g"), F.flatten(F.array(*[projector(b.vectors)("z") for b in fits])).alias("r")))
    dealt = mixed.withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))
    right = dealt.select(F.col("g").alias("ga"), F.col("other").alias("gb"), "class", "r", F.lit(0).alias("side")).unionByName(
        dealt.select(F.col("other").alias("ga"), F.col("g").alias("gb"), "class", "r", F.lit(1).alias("side")))
    ks = [b.k for b in fits]
    ends = np.cumsum([0, *ks])

    def tile(_, pair: pd.DataFrame, mix: pd.DataFrame) -> pd.DataFrame:
        total = [np.zeros((k, k)) for k in ks]
        if len(pair):
            (ra, at_a), (rb, at_b) = (
                (np.stack(part["r"].to_numpy()), pd.Index(part["class"]).get_indexer(pair[c]))
                for c, part in (("ca", mix[mix["side"] == 0]), ("cb", mix[mix["side"] == 1])))
            weight = pair["min"].to_numpy()
            for start in range(0, len(pair), 50_000):
                cut = slice(start, start + 50_000)
                x, y = ra[at_a[cut]] * weight[cut, None], rb[at_b[cut]]
                for n, t in enumerate(total):
                    t += x[:, ends[n]:ends[n + 1]].T @ y[:, ends[n]:ends[n + 1]]
        out = [(n, i, c, 0.5 * (t[i, c] + t[c, i])) for n, t in enumerate(total) for i, c in vec.triangle(ks[n])]
        return pd.DataFrame(out, columns=["fit", "i", "c", "mass"]).assign(n=int(pair["n"].sum()))

    tiles = left.groupBy("ga", "gb").cogroup(right.groupBy("ga", "gb")).applyInPandas(tile, "fit int, i int, c int, mass double, n long")
    cells = tiles.groupBy("fit", "i", "c").agg(F.sum("mass").alias("mass"), F.sum("n").alias("n_pairs"))
    by_cell = cut_lineage(cells).join(F.broadcast(spark.createDataFrame(list(enumerate(ks)), "fit int, k int")), "fit")  # a row per cell of each fit
    total = by_cell.groupBy("k").agg(F.sum("mass").alias("total"), F.count(F.lit(1)).alias("n_cells"))
    held = F.col("mass") > F.lit(starve_ratio) * F.col("total") / F.col("n_cells")
    return by_cell.join(total, "k").groupBy("k").agg(
        F.max("n_cells").alias("n_cells"), F.count_if(held).alias("effective_cells"), F.min("mass").alias("min_mass"),
        F.percentile("mass", F.lit(0.5)).alias("median_mass"), F.max("n_pairs").alias("n_pairs"))


def saturation(recipes: DataFrame, bands: tuple[tuple[float, float], ...]) -> DataFrame:
    """Share of rows with a dominating component per weight band."""
    band = F.lit(None).cast("int")
    for i, (lo, hi) in enumerate(bands):
        band = F.when((F.col("min") >= lo) & (F.col("min") < hi), F.lit(i)).otherwise(band)
    rows = recipes.select(band.alias("band"), vec.purity("recipe").alias("top")).where(F.col("band").isNotNull())
    base = rows.groupBy("band").agg(
        F.count(F.lit(1)).alias("n"), (100 * F.avg((F.col("top") > 0.9).cast("double"))).alias("pct_over_90"),
        (100 * F.avg((F.col("top") > 0.7).cast("double"))).alias("pct_over_70"))
    med = ordered.quantiles(rows, ["band"], "top", {"median_top": 0.5}).drop("n")
    return base.join(med, "band")


def mixture_health(recipes: DataFrame, k: int, keys: list[str]) -> DataFrame:
    """Median, 10th and 90th percentile of the effective number of components."""
    rows = recipes.select(*keys, vec.effective_components("recipe", k).alias("effective"))
    return ordered.quantiles(rows, keys, "effective", {"median": 0.5, "p10": 0.1, "p90": 0.9})


def simplex_check(recipes: DataFrame, k: int, atol: float = 1e-6) -> DataFrame:
    """Row-sum range, negative weights and the verdict (Q1)."""
    s = vec.vsum("recipe", k)
    neg = F.array_min("recipe") < -1e-9
    return recipes.agg(F.count(F.lit(1)).alias("n"), F.min(s).alias("min_sum"), F.max(s).alias("max_sum"),
                       F.count_if(F.abs(s - 1.0) > atol).alias("n_bad_sum"), F.count_if(neg).alias("n_negative")).withColumn(
        "ok", (F.col("n_bad_sum") == 0) & (F.col("n_negative") == 0))


def plane(projected: DataFrame, basis: Basis, keep: list[str]) -> DataFrame:
    """Coordinates of every row on the plane of the first two principal axes of the basis rows."""
    axes, centre, _ = plane_axes(basis.vectors)
    p = basis.vectors.shape[1]
    xy = [
        vec.total([(F.col("z")[f] - F.lit(float(centre[f]))) * F.lit(float(axes[a, f])) for f in range(p)]).alias(n)
        for a, n in enumerate(("px", "py"))
    ]
    return projected.select(*keep, *xy)


def plane_axes(vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Principal axes of the k basis rows, their centre and the explained ratios (k x p, driver side)."""
    centre = vectors.mean(axis=0)
    _, s, vt = np.linalg.svd(vectors - centre, full_matrices=False)
    for a in range(min(2, len(vt))):  # a fixed sign: the largest loading is positive
        if vt[a, np.abs(vt[a]).argmax()] < 0:
            vt[a] *= -1
    ratio = s ** 2 / (s ** 2).sum()
    return vt[:2], centre, ratio[:2]


def _hull_indices(x: np.ndarray, y: np.ndarray) -> list[int]:
    """Vertices of the convex hull, counter-clockwise from the lowest x (collinear points left out)."""
    order = np.lexsort((y, x))

    def chain(seq):
        out: list[int] = []
        for i in seq:
            while len(out) > 1:
                a, b = out[-2], out[-1]
                if (x[b] - x[a]) * (y[i] - y[a]) - (y[b] - y[a]) * (x[i] - x[a]) > 0:
                    break
                out.pop()
            out.append(int(i))
        return out

    lower, upper = chain(order), chain(order[::-1])
    return lower[:-1] + upper[:-1] if len(order) > 1 else [int(order[0])]


def hull(points: DataFrame, keep: list[str], fan_in: int = 64) -> DataFrame:
    """Convex hull of px, py: hull per partition, hull of hulls in a fan-in step, then the last merge.

    Only hull vertices leave a task, so the merges see a few rows per task.
    """
    cols = [*keep, "px", "py"]
    sel = points.select(*cols)

    def local(batches):
        held = None
        for pdf in batches:
            held = pdf if held is None else pd.concat([held, pdf], ignore_index=True)
            held = held.drop_duplicates(["px", "py"]).reset_index(drop=True)
            if len(held) > 2:
                held = held.iloc[_hull_indices(held["px"].to_numpy(), held["py"].to_numpy())].reset_index(drop=True)
        if held is not None and len(held):
            held = held.reset_index(drop=True)
            held["vertex"] = np.arange(len(held))
            yield held

    first = sel.mapInPandas(local, T.StructType([*sel.schema.fields, T.StructField("vertex", T.IntegerType())])).drop("vertex")
    step = first.groupBy(F.pmod(F.xxhash64("px", "py"), F.lit(fan_in)).alias("_g")).applyInPandas(
        lambda pdf: next(local([pdf[cols]]))[cols], sel.schema)
    out = T.StructType([*sel.schema.fields, T.StructField("vertex", T.IntegerType())])
    return step.groupBy(F.lit(0).alias("_g")).applyInPandas(lambda pdf: next(local([pdf[cols]])), out)


def partial_weights(df: DataFrame, basis: Basis, blocks: dict[str, list[str]], keep: list[str], z: str = "z") -> DataFrame:
    """Project with only some features; the others sit at the population mean (M1)."""
    out = df
    run = projector(basis.vectors)
    for name, block in blocks.items():
        masked = F.array(*[
            F.col(z)[i] if f in block else F.lit(0.0) for i, f in enumerate(basis.features)])
        out = out.withColumn(name, run(masked))
    return out.select(*keep, z, *blocks)


def miscast(df: DataFrame, basis: Basis, opportunity: list[str], outcome: list[str], keep: list[str]) -> DataFrame:
    """Distance between the use-only and the outcome-only mixture, and the most under-used component (M2, M3)."""
    k = basis.k
    both = partial_weights(df, basis, {"used": opportunity, "produced": outcome}, keep)
    gap = F.array(*[F.col("produced")[i] - F.col("used")[i] for i in range(k)])
    return both.withColumn("gap", gap).withColumn("score", vec.js_distance("used", "produced", k)).withColumn(
        "underused", vec.argmax("gap")).withColumn("gap_pp", F.array_max("gap") * 100)
