import numpy as np
import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from blendscope.operators import gram, ordered, pairwise, relational, simplex, stats


def test_quantiles_and_ranks(spark):
    rng = np.random.default_rng(1)
    v = np.concatenate([rng.normal(size=300), np.zeros(150), rng.exponential(1e6, 50), -rng.exponential(1e-6, 50)])
    key = np.where(np.arange(len(v)) % 3 == 0, "hot", "b")
    pdf = pd.DataFrame({"k": key, "v": v})
    df = spark.createDataFrame(pdf)
    for gathered in (10_000, 200, 0):
        got = {r.k: r for r in ordered.quantiles(df, ["k"], "v", {"q1": 0.05, "m": 0.5, "q3": 2 / 3}, gathered).collect()}
        for k, part in pdf.groupby("k"):
            for name, p in (("q1", 0.05), ("m", 0.5), ("q3", 2 / 3)):
                assert got[k][name] == pytest.approx(np.percentile(part["v"], 100 * p), abs=1e-9)
    ranks = ordered.percentile_rank(df, ["k"], "v", "pct").toPandas()
    for k, part in ranks.groupby("k"):
        want = [(part["v"] < x).mean() for x in part["v"]]
        assert np.allclose(part["pct"], want)


def test_quantiles_shuffle_only_the_chunks_of_the_ranks(spark):
    rng = np.random.default_rng(8)
    pdf = pd.DataFrame({"k": np.where(np.arange(6000) % 3 == 0, "hot", "b"), "v": rng.lognormal(size=6000)})
    df = spark.createDataFrame(pdf)
    chunked = df.withColumn("_chunk", ordered.value_chunk(F.col("v")))
    chunks = ordered.rank_chunks(chunked, ["k"], {"m": 0.5})
    assert chunks.count() <= 4
    held = chunked.join(chunks, ["k", "_chunk"]).count()
    assert held < 0.05 * len(pdf)
    probs = {"m": 0.5, "q": 0.9}
    near, far = (ordered.quantiles(df, ["k"], "v", probs, most_gathered=10, most_held=h) for h in (100, 0))
    plan = near._jdf.queryExecution().executedPlan().toString()
    # the rows meet the chunks before any exchange
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan
    assert {tuple(r) for r in near.collect()} == {tuple(r) for r in far.collect()}
    mixed = {r["k"]: r for r in ordered.quantiles(df, ["k"], "v", probs, most_gathered=3000).collect()}
    gathered = {r["k"]: r for r in ordered.quantiles(df, ["k"], "v", probs).collect()}
    for r in near.collect():
        for other in (mixed[r["k"]], gathered[r["k"]]):
            assert other["n"] == r["n"] and other["m"] == pytest.approx(r["m"]) and other["q"] == pytest.approx(r["q"])
    whole = ordered.quantiles(df, [], "v", probs, most_gathered=10).collect()
    assert len(whole) == 1 and whole[0]["m"] == pytest.approx(np.percentile(pdf["v"], 50))
    for k, part in pdf.groupby("k"):
        assert near.where(F.col("k") == k).first()["q"] == pytest.approx(np.percentile(part["v"], 90))
    empty = ordered.quantiles(df.where("false"), [], "v", probs).collect()
    assert len(empty) == 1 and empty[0]["m"] is None
    assert ordered.quantiles(df.where("false"), ["k"], "v", probs).count() == 0


def test_ordered_scan_matches_plain_windows(spark):
    rng = np.random.default_rng(2)
    n = 400
    pdf = pd.DataFrame({"k": rng.integers(0, 2, n), "o": rng.permutation(n), "x": rng.integers(0, 5, n)})
    pdf["s"] = [None if x < 3 else int(x) * 10 + i for i, x in enumerate(pdf["x"])]
    df = spark.createDataFrame(pdf.astype({"s": "Int64"})).withColumn("c", F.floor(F.col("o") / 7))
    out = ordered.ordered_scan(df, ["k"], ["o"], "c", sums={"run": "x"}, lasts={"last": "s"}, lags={"prev": "s"}, firsts_after={"nxt": "s"})
    got = out.toPandas().sort_values(["k", "o"]).reset_index(drop=True)
    ref = pdf.sort_values(["k", "o"]).reset_index(drop=True)
    g = ref.groupby("k")
    eq = lambda a, b: np.array_equal(a.astype(float).fillna(-1), b.astype(float).fillna(-1))
    assert eq(got["run"], g["x"].cumsum())
    assert eq(got["last"], g["s"].ffill())
    assert eq(got["prev"], g["s"].shift(1))
    assert eq(got["nxt"], g["s"].bfill())


@settings(max_examples=25, deadline=None)
@given(st.integers(2, 7), st.integers(2, 9), st.integers(0, 10_000))
def test_simplex_projection_is_optimal(k, p, seed):
    rng = np.random.default_rng(seed)
    basis, x = rng.normal(size=(k, p)), rng.normal(size=(40, p)) * 1.5
    a = simplex.project(x, basis)
    assert np.allclose(a.sum(axis=1), 1) and a.min() >= 0
    # optimality: no vertex direction lowers the loss
    grad = a @ (basis @ basis.T) - x @ basis.T
    level = (a * grad).sum(axis=1, keepdims=True)
    assert (grad - level).min() > -1e-6


def test_exemplar_rows_project_to_one_hot():
    basis = np.random.default_rng(3).normal(size=(5, 12))
    assert np.allclose(simplex.project(basis, basis), np.eye(5), atol=1e-8)


def _brute(ids, vecs, vals, flags, power=4.0):
    d = pairwise.js_matrix(vecs, vecs)
    out = {}
    for i in range(len(ids)):
        w = (1 - d[i]) ** power
        w[i] = 0
        out[ids[i]] = (w @ vals / w.sum(), w.sum() ** 2 / (w ** 2).sum(), (w * flags) @ vals / (w * flags).sum())
    return out


def test_tiles_equal_brute_force(spark):
    rng = np.random.default_rng(4)
    n, k = 60, 3
    vecs, vals = rng.dirichlet(np.ones(k), n), rng.normal(size=(n, 2))
    ids, flags = np.arange(n) + 2 ** 60, rng.random(n) > 0.5
    rows = [("s", int(i), v.tolist(), x.tolist(), bool(f)) for i, v, x, f in zip(ids, vecs, vals, flags)]
    df = spark.createDataFrame(rows, "season string, member long, recipe array<double>, val array<double>, f boolean")
    want = _brute(ids, vecs, vals, flags)
    for blocks in (1, 4):
        out = pairwise.weighted_environment(df, df, keys=["season"], target_id="member", pool_id="member", vector="recipe", values="val", k=k, m=2, flag="f", blocks=blocks)
        got = {r.member: r for r in out.collect()}
        assert set(got) == set(want)
        for i, (mean, ess, pos) in want.items():
            assert np.allclose(got[i]["mean"], mean) and got[i].ess == pytest.approx(ess) and np.allclose(got[i].mean_pos, pos)
        near = pairwise.nearest(df, df, keys=["season"], target_id="member", pool_id="member", vector="recipe", k=k, top_n=3, blocks=blocks)
        d = pairwise.js_matrix(vecs, vecs)
        np.fill_diagonal(d, np.inf)
        for r in near.collect():
            i = int(np.flatnonzero(ids == r.member)[0])
            assert r.neighbor == ids[np.argsort(d[i], kind="stable")[r["rank"] - 1]]


def test_statistics_of_folds_equal_row_level_fits(spark):
    rng = np.random.default_rng(5)
    n = 300
    x = rng.normal(size=(n, 3)) * [1, 5, 0.2] + [0, 100, 3]
    y, w, g = x @ [1.0, -0.3, 4.0] + rng.normal(size=n), rng.uniform(0.5, 3, n), rng.integers(0, 5, n)
    df = spark.createDataFrame(pd.DataFrame({"a": x[:, 0], "b": x[:, 1], "c": x[:, 2], "y": y, "w": w, "g": g}))
    folds = gram.matrices(gram.cross_products(df, ["a", "b", "c"], "y", "w", "g").toPandas(), "g", 5)
    jvm = gram.matrices(gram.cross_products_sql(df, ["a", "b", "c"], "y", "w", ["g"]).toPandas(), "g", 5)
    assert all(np.allclose(folds[f], jvm[f]) for f in folds)
    penalty = np.array([0.0, 1.0, 1.0])
    cv = gram.cross_validate(folds, penalty, np.array([0.1, 50.0]))
    for lam, rmse in cv.itertuples(index=False):
        errs = []
        for f in range(5):
            tr, va = g != f, g == f
            mean = np.average(x[tr], axis=0, weights=w[tr])
            sd = np.sqrt(np.average((x[tr] - mean) ** 2, axis=0, weights=w[tr]))
            z, yb = (x[tr] - mean) / sd, np.average(y[tr], weights=w[tr])
            beta = np.linalg.solve(z.T @ (z * w[tr, None]) + lam * np.diag(penalty), z.T @ (w[tr] * (y[tr] - yb)))
            e = y[va] - yb - (x[va] - mean) / sd @ beta
            errs.append(np.sqrt(np.average(e ** 2, weights=w[va])))
        assert rmse == pytest.approx(np.mean(errs), rel=1e-7)


def test_collinear_design_gives_smallest_norm_fit():
    rng = np.random.default_rng(6)
    a = rng.random((50, 2))
    x = np.column_stack([a, 1 - a.sum(axis=1)])
    y, w = x @ [1.0, 2.0, 3.0], np.ones(50)
    m = np.column_stack([np.ones(50), x, y])
    coef, b0 = gram.least_squares((m * w[:, None]).T @ m)
    assert np.allclose(b0 + x @ coef, y) and gram.r_squared(m.T @ m, coef, b0) == pytest.approx(1.0)


def test_weighted_statistics(spark):
    x, y, w = np.array([1.0, 2, 4]), np.array([2.0, 1, 5]), np.array([1.0, 3, 2])
    df = spark.createDataFrame(pd.DataFrame({"x": x, "y": y, "w": w}))
    r = df.agg(stats.weighted_mean("x", "w").alias("m"), stats.weighted_std("x", "w").alias("s"), stats.weighted_corr("x", "y", "w").alias("c"),
               stats.weighted_r2("y", "x", "w").alias("r2"), stats.effective_sample("w").alias("e"), stats.guarded_std(F.lit(2.0), "w").alias("g")).first()
    m, my = np.average(x, weights=w), np.average(y, weights=w)
    s, sy = np.sqrt(np.average((x - m) ** 2, weights=w)), np.sqrt(np.average((y - my) ** 2, weights=w))
    assert r.m == pytest.approx(m) and r.s == pytest.approx(s) and r.g == 1.0
    assert r.c == pytest.approx(np.average((x - m) * (y - my), weights=w) / s / sy)
    assert r.r2 == pytest.approx(1 - np.sum(w * (y - x) ** 2) / np.sum(w * (y - my) ** 2))
    assert r.e == pytest.approx(36 / 14)


def test_combined_row_wins_and_limit_comes_before_filter(spark):
    df = spark.createDataFrame([("a", "BKN", 1), ("a", "2TM", 2), ("b", "NYK", 3)], "n string, team string, v int")
    assert sorted((r.n, r.v) for r in relational.prefer_combined(df, ["n"], "team", ["team"]).collect()) == [("a", 2), ("b", 3)]
    top = relational.top_then_filter(df, [F.col("v").desc()], 2, F.col("v") < 3)
    assert [r.v for r in top.collect()] == [2]
    res = relational.resolve_names(spark.createDataFrame([("A. Brown",), ("C",)], "q string"),
                                   spark.createDataFrame([("A Brown", 1), ("a  brown", 2)], "nm string, id int"), "q", "nm", "id")
    assert {(r.q, r.status) for r in res.collect()} == {("A. Brown", "ambiguous"), ("C", "missing")}
    with pytest.raises(ValueError, match="ambiguous"):
        relational.require_resolved(res)
