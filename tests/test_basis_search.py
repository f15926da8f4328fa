"""The basis search over the whole population, its certificate, stored bases and the run ledger."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from blendscope import warehouse as wh
from blendscope.operators import simplex
from blendscope.plans import basis as bs
from blendscope.sources import ledger, tables
from blendscope.sources.ledger import Ledger

COLS = list("abcde")


def population(spark, n, seed=0):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, len(COLS))) * rng.uniform(0.5, 2, len(COLS)) + rng.exponential(size=(n, len(COLS)))
    pdf = pd.DataFrame(x, columns=COLS).assign(member=np.arange(n), season="s")
    z = ((pdf[COLS] - pdf[COLS].mean()) / pdf[COLS].std()).to_numpy()
    return spark.createDataFrame(pdf).repartition(3), z


def loss(z, chosen):
    b = z[chosen]
    return float(((z - simplex.project(z, b) @ b) ** 2).sum())


def exhaustive(z, k, seed):
    """Local search that tries every row in every place."""
    chosen = list(np.random.default_rng(seed).choice(len(z), k, replace=False))
    while True:
        now = loss(z, chosen)
        tried = [(loss(z, chosen[:i] + [j] + chosen[i + 1:]), i, j) for i in range(k) for j in range(len(z)) if j not in chosen]
        best, i, j = min(tried)
        if now - best <= 1e-4 * now:
            return now
        chosen[i] = j


def test_swap_losses_equal_full_solves():
    rng = np.random.default_rng(3)
    x = rng.normal(size=(150, 6))
    for k in (1, 2, 5, 9):
        b = x[rng.choice(150, k, replace=False)]
        swaps = [(int(rng.integers(k)), x[rng.integers(150)]) for _ in range(25)] + [(0, b[-1]), (k - 1, b[k - 1]), (0, np.zeros(6))]
        base, got = simplex.swap_losses(x, b, swaps)
        want = []
        for i, v in swaps:
            c = b.copy()
            c[i] = v
            want.append(((x - simplex.project(x, c) @ c) ** 2).sum())
        assert base == pytest.approx(((x - simplex.project(x, b) @ b) ** 2).sum()) and got == pytest.approx(want, rel=1e-7)


def test_priced_gains_are_lower_bounds():
    rng = np.random.default_rng(4)
    x = rng.normal(size=(120, 5))
    b = x[:4]
    gains = simplex.Panel(x, b).gains(x)
    for i in range(4):
        rest = np.delete(b, i, 0)
        left = ((x - simplex.project(x, rest) @ rest) ** 2).sum()
        for j in range(0, 120, 7):
            c = np.vstack([rest, x[j]])
            assert gains[i, j] <= left - ((x - simplex.project(x, c) @ c) ** 2).sum() + 1e-8


def test_no_row_of_the_population_improves_the_basis(spark):
    df, z = population(spark, 200)
    fits = bs.fit_runs(df, COLS, [(3, s) for s in (0, 1, 2)], every_row=1_000)
    for m in fits:
        chosen = [e["member"] for e in m.exemplars]
        now = loss(z, chosen)
        assert m.meta["rss"] == pytest.approx(now) and m.meta["certificate"]["every_row_tried"] and m.meta["converged"]
        assert min(loss(z, chosen[:i] + [j] + chosen[i + 1:]) for i in range(3) for j in range(200)) >= now * (1 - 1e-4)
    best, tss = bs.best_of(fits), float((z ** 2).sum())
    single = [1 - exhaustive(z, 3, s) / tss for s in range(4)]  # every row tried in every step, from one random start each
    assert best.meta["explained_var"] >= np.median(single) and best.meta["explained_var"] > max(single) - 0.01
    priced = bs.best_of(bs.fit_runs(df, COLS, [(3, s) for s in (0, 1, 2)], panel=60))
    assert not priced.meta["certificate"]["every_row_tried"] and priced.meta["certificate"]["rows_priced"] == 200
    assert priced.meta["explained_var"] > best.meta["explained_var"] - 0.03


def test_bases_are_stored_by_k_and_read_back(spark, tmp_path):
    df, _ = population(spark, 60, 1)
    fits = bs.fit_runs(df, COLS, [(k, s) for k in (2, 3) for s in (0, 1)])
    tables.basis_rows(spark, fits).write.parquet(str(tmp_path / "b"))
    again = tables.read_bases(spark.read.parquet(str(tmp_path / "b")))
    assert [(b.k, b.meta["seed"]) for b in again] == [(2, 0), (2, 1), (3, 0), (3, 1)]
    for a, b in zip(fits, again):
        assert np.allclose(a.vectors, b.vectors) and a.exemplars == b.exemplars and a.features == b.features and a.meta["rss"] == b.meta["rss"]
    table = bs.sweep_table(df, fits).collect()
    for r, b in zip(table, fits):
        assert r.intra_variance == pytest.approx(bs.intra_variance(bs.project(df, b, ["member"]), len(COLS)).first().intra_variance)


def test_coverage_by_k_equals_one_at_a_time(spark):
    df, _ = population(spark, 40, 2)
    pairs = spark.createDataFrame([(i, (i * 7 + 3) % 40, "s", float(1 + i % 5)) for i in range(40) if i != (i * 7 + 3) % 40], "a long, b long, season string, min double")
    fits = bs.fit_runs(df, COLS, [(2, 0), (4, 0)])
    got = {r.k: r for r in bs.coverage_by_k(pairs, df, fits).collect()}
    for b in fits:
        want = bs.coverage_summary(bs.cell_mass(pairs, bs.project(df, b, ["member", "season"]), b.k)).first()
        assert (got[b.k].n_cells, got[b.k].effective_cells, got[b.k].n_pairs) == (want.n_cells, want.effective_cells, want.n_pairs)
        assert (got[b.k].min_mass, got[b.k].median_mass) == pytest.approx((want.min_mass, want.median_mass))


def test_ledger_computes_what_is_new_failed_or_changed(spark, tmp_path):
    rows = spark.createDataFrame([("a", 1), ("a", 2), ("b", 3), ("c", 4)], "season string, v int")
    book = Ledger(spark, str(tmp_path / "l"))
    seen = []

    def compute(fail):
        def run(due):
            seen.append(sorted((r.key, r.attempt) for r in due.collect()))
            made = rows_now.join(due, F.col("season") == F.col("key")).select("key", "v")
            return made, spark.createDataFrame([(k, "failed", "no box") for k in fail], "key string, status string, error string")
        return run

    rows_now = rows
    assert book.entries().count() == 0
    book.run(ledger.digests(rows_now, "season"), compute(["b"]))
    assert sorted(map(tuple, book.rows().collect())) == [("a", 1), ("a", 2), ("c", 4)]
    assert {r.key: (r.attempt, r.status, r.n_rows, r.error) for r in book.entries().collect()} == {
        "a": (1, "ok", 2, None), "b": (1, "failed", 0, "no box"), "c": (1, "ok", 1, None)}
    book.run(ledger.digests(rows_now.repartition(5), "season"), compute([]))  # row order does not matter
    rows_now = rows.where("v <> 4").union(spark.createDataFrame([("c", 5), ("d", 6)], rows.schema))
    book.run(ledger.digests(rows_now, "season"), compute([]))
    assert book.run(ledger.digests(rows_now, "season"), compute([])).count() == 0
    assert seen == [[("a", 1), ("b", 1), ("c", 1)], [("b", 2)], [("c", 2), ("d", 1)]]
    assert sorted(map(tuple, book.rows().collect())) == [("a", 1), ("a", 2), ("b", 3), ("c", 5), ("d", 6)]
    other = ledger.digests(rows_now, "season", {"k": 3})  # other parameters: everything again
    assert book.todo(other).count() == 4

    def broken(due):
        raise RuntimeError("lost")

    with pytest.raises(RuntimeError, match="lost"):
        book.run(other, broken)
    assert {r.status for r in book.entries().collect()} == {"failed"} and book.rows().count() == 0
    book.run(other, compute([]))
    assert {r.key: r.attempt for r in book.entries().collect()} == {"a": 3, "b": 4, "c": 4, "d": 3} and book.rows().count() == 5


def test_a_part_without_manifest_is_not_read(spark, tmp_path):
    book = Ledger(spark, str(tmp_path / "l"))
    rows = spark.createDataFrame([("a", 1)], "key string, v int")
    book.run(rows.select("key", F.lit("d").alias("digest")), lambda due: (rows, None))
    rows.write.parquet(str(tmp_path / "l" / "data" / "part=half"))
    assert book.rows().count() == 1


def test_null_features_of_a_fixed_projection_are_an_error(spark):
    df, z = population(spark, 30, 5)
    b = bs.Basis(z[:3], np.zeros(5), np.ones(5), COLS)
    holes = df.withColumn("c", F.when(F.col("member") == 7, F.lit(None)).otherwise(F.col("c")))
    assert {r.member for r in bs.project(holes, b, ["member"]).where("recipe is null").collect()} == {7}
    assert bs.project(df, b, ["member"], strict=True).where("recipe is null").count() == 0
    with pytest.raises(Exception, match="projection: c"):
        bs.project(holes, b, ["member"], strict=True).collect()


def test_a_fit_counts_equal_rows_instead_of_visiting_them(spark, monkeypatch):
    rng = np.random.default_rng(12)
    one = rng.normal(size=(40, 4))
    often = np.where(np.arange(40) % 3 == 0, 9, 2)
    x = np.repeat(one, often, axis=0) * (1.0 + rng.integers(-1, 2, (int(often.sum()), 1)) * 1e-15)
    cols = [f"f{i}" for i in range(4)]
    df = spark.createDataFrame(pd.DataFrame(x, columns=cols).assign(member=np.arange(len(x)), season="s"))
    visited, score = [], bs._score_swaps
    monkeypatch.setattr(bs, "_score_swaps", lambda z, *a: visited.append(z.count()) or score(z, *a))
    b = bs.fit(df, cols, 3)
    assert set(visited) == {40} and b.meta["certificate"]["rows_priced"] == len(x)
    z = (x - x.mean(axis=0)) / x.std(axis=0, ddof=1)
    a = simplex.project(z, b.vectors)
    assert b.meta["rss"] == pytest.approx(simplex.residuals(z, b.vectors, a).sum())
    assert b.meta["explained_var"] == pytest.approx(1 - simplex.residuals(z, b.vectors, a).sum() / (z ** 2).sum())


def test_coverage_sums_pairs_of_equal_rows_before_they_meet_their_mixtures(spark, monkeypatch):
    df, _ = population(spark, 20, 6)
    copies = df.unionByName(df.withColumn("member", F.col("member") + 100)).unionByName(df.withColumn("member", F.col("member") + 200))
    pairs = spark.createDataFrame([(i + 100 * c, (i * 7 + 3) % 20 + 100 * d, "s", float(1 + i + c)) for i in range(20) for c in range(3) for d in range(3)],
                                  "a long, b long, season string, min double")
    fits = bs.fit_runs(copies, COLS, [(2, 0), (4, 0)])
    met, spread = [], bs.spread
    monkeypatch.setattr(bs, "spread", lambda d: met.append(d.count()) or spread(d))
    got = {r.k: r for r in bs.coverage_by_k(pairs, copies, fits).collect()}
    assert met == [20]  # mixtures are computed once per different row
    for b in fits:
        want = bs.coverage_summary(bs.cell_mass(pairs, bs.project(copies, b, ["member", "season"]), b.k)).first()
        assert (got[b.k].n_cells, got[b.k].effective_cells, got[b.k].n_pairs) == (want.n_cells, want.effective_cells, want.n_pairs) and want.n_pairs == 180
        assert (got[b.k].min_mass, got[b.k].median_mass) == pytest.approx((want.min_mass, want.median_mass))
    for r, b in zip(bs.sweep_table(copies, fits).collect(), fits):
        assert r.intra_variance == pytest.approx(bs.intra_variance(bs.project(copies, b, ["member"]), len(COLS)).first().intra_variance)
    assert met == [20, 20]


def test_a_round_scores_the_best_prices_first_and_the_others_before_it_ends(spark, monkeypatch):
    df, _ = population(spark, 150, 7)
    asked, score = [], bs._score_swaps
    monkeypatch.setattr(bs, "_score_swaps", lambda z, bases, swaps: asked.append({r: len(s) for r, s in swaps.items()}) or score(z, bases, swaps))
    b = bs.fit(df, COLS, 4, panel=30, restarts=1)
    sizes = [s[0] for s in asked]
    assert set(sizes) == {bs.TRIED, 3 * bs.TRIED} and sizes[-1] == 3 * bs.TRIED  # the last round has scored 8 rows of each of 4 places
    assert b.meta["converged"] and b.meta["n_iter"] == sizes.count(bs.TRIED) and b.meta["certificate"]["swaps_tried"] == sum(sizes)


def test_feature_sources_share_one_pass_over_the_lines(spark, sf):
    sources = wh.feature_sources(spark, sf)
    assert not [f for df in sources.values() for f in df.inputFiles() if "lineitem" in f or "part.parquet" in f]
    li = wh.typed_lines(spark, sf)
    want = {(r.member, r.season): r for r in li.groupBy("member", "season").agg(
        F.avg("tax").alias("dist"), F.avg(F.when(F.col("flag") == "A", (F.col("discount") >= 0.08).cast("double"))).alias("far")).collect()}
    names = {r.name.upper(): r.member for r in wh.members(spark, sf).collect()}
    rows = sources["shooting"].collect()
    assert len(rows) == len(want)
    for r in rows:
        w = want[names[r.player], r.season]
        assert r.dist == pytest.approx(w.dist) and (r.far is None if w.far is None else r.far == pytest.approx(w.far))
