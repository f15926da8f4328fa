import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from blendscope import schemas
from blendscope import warehouse as wh
from blendscope.operators import simplex
from blendscope.plans import basis as bs
from blendscope.plans import combos as cb
from blendscope.plans import environment as env
from blendscope.plans import linear as ln
from blendscope.plans import quality as ql
from blendscope.sources import nested, tables


@pytest.fixture(scope="module")
def cloud(spark):
    rng = np.random.default_rng(0)
    corners = np.array([[6.0, 0, 0, 0], [0, 6, 0, 0], [0, 0, 6, 0]])
    x = np.vstack([rng.dirichlet(np.ones(3) * 2, 150) @ corners + rng.normal(scale=0.05, size=(150, 4)), corners])
    pdf = pd.DataFrame(x, columns=list("abcd")).assign(member=np.arange(len(x)), season="s")
    return pdf, spark.createDataFrame(pdf).repartition(4)


def test_fit_finds_the_extreme_rows(spark, cloud, tmp_path):
    pdf, df = cloud
    m = bs.fit_best(df, list("abc"), 3, seeds=(0, 1))
    assert {e["member"] for e in m.exemplars} == {150, 151, 152} and m.meta["explained_var"] > 0.98 and m.meta["converged"]
    p = bs.project(df, m, ["member", "season"]).toPandas()
    w = np.stack(p["recipe"])
    assert np.allclose(w.sum(axis=1), 1) and w.min() >= 0
    z = (pdf[list("abc")] - pdf[list("abc")].mean()) / pdf[list("abc")].std()
    ref = simplex.project(z.loc[p["member"]].to_numpy(), m.vectors)
    assert np.allclose(w, ref, atol=1e-9)
    tables.save_basis(m, spark, str(tmp_path / "b"))
    again = tables.load_basis(spark, str(tmp_path / "b"))
    assert np.allclose(again.vectors, m.vectors) and again.features == m.features and again.meta["k"] == 3


def test_hull_matches_brute_force(spark):
    rng = np.random.default_rng(1)
    pts = rng.normal(size=(300, 2))
    df = spark.createDataFrame(pd.DataFrame(pts, columns=["px", "py"]).assign(id=np.arange(300))).repartition(6)
    got = {r.id for r in bs.hull(df, ["id"]).collect()}
    want = set()
    for i in range(300):  # a vertex is a point with all others on one side of some line through it
        ang = np.sort(np.arctan2(*(np.delete(pts, i, 0) - pts[i]).T[::-1]))
        if max(np.diff(np.append(ang, ang[0] + 2 * np.pi))) > np.pi:
            want.add(i)
    assert got == want


def test_missing_partners_are_dropped_and_counted(spark):
    edges = spark.createDataFrame([("s", 1, 2, 10.0, 5.0), ("s", 1, 3, 30.0, -1.0), ("s", 1, 9, 50.0, 0.0)],
                                  "season string, focal long, mate long, min double, net_rating double")
    rec = spark.createDataFrame([(1, "s", [0.5, 0.5]), (2, "s", [1.0, 0.0]), (3, "s", [0.0, 1.0])], "member long, season string, recipe array<double>")
    e = env.exposure(edges, rec, 2).first()
    assert e.exposure == pytest.approx([0.25, 0.75]) and (e.n_mates, e.n_dropped) == (2, 1)
    on = spark.createDataFrame([(1, "s", 1.0)], "member long, season string, net_rating double")
    l = {r.component: r for r in env.lift(edges, rec, on, 2).collect()}
    assert l[0].lift == pytest.approx(4.0) and l[1].lift == pytest.approx(-2.0) and l[1].mass == 30.0


def test_verdicts(spark):
    mis = spark.createDataFrame([(m, "s", [-0.2, 0.1, 0.1]) for m in (1, 2, 3, 4)], "member long, season string, diff array<double>")
    rows = []
    for m, lifts, mass in ((1, (5.0, 1.0, 0.0), 200.0), (2, (1.0, 0.5, 0.0), 200.0), (3, (5.0, 1.0, 0.0), 10.0), (4, (-5.0, 4.0, 3.0), 200.0)):
        rows += [(m, "s", i, x, mass) for i, x in enumerate(lifts)]
    lift = spark.createDataFrame(rows, "member long, season string, component int, lift double, mass double")
    got = {r.member: r.verdict for r in env.agreement(mis, lift, top_n=2).collect()}
    assert got == {1: "agree", 2: "flat", 3: "insufficient", 4: "disagree"}


def test_design_drops_unknown_members_and_scores(spark):
    st = spark.createDataFrame([(1, "s", 1, 1, [1, 2], [3], 10.0, 11.0, 110.0), (2, "s", 1, 1, [1, 9], [3], 10.0, 9.0, 90.0)],
                               "game long, season string, stint int, home_off int, off array<long>, def array<long>, off_possessions double, off_points double, y_off double")
    rec = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.25, 0.75]), (3, [0.5, 0.5])], "member long, recipe array<double>")
    skill = spark.createDataFrame([(1, 2.0, 1.0), (2, 4.0, 1.0), (3, 1.0, -2.0)], "member long, skill_off double, skill_def double")
    d = ln.design(st, rec, skill, 2).collect()
    assert len(d) == 1 and d[0].game == 1
    r = d[0]
    assert (r.s_off, r.s_def, r.e_off_0, r.e_off_1, r.e_def_0) == (6.0, -2.0, 3.0, 3.0, -1.0)
    assert r.x_off_0_1 == 9.0 and r.x_def_0_1 == 1.0
    names = ln.design_columns(2)
    m = ln.LinearModel(names, np.arange(1.0, len(names) + 1), 100.0, np.zeros(len(names)), np.ones(len(names)))
    m.meta["league_average"] = {n: 0.5 for n in names}
    feats = ln.lineup_features(spark.createDataFrame([([1, 2],)], "ids array<long>").withColumn("k", F.lit(1)), rec, skill, 2, ["k"])
    s = ln.score_lineups(feats, m, 2, ["k"]).first()
    x = dict(s_off=6, s_def=0.5, home_off=0.5, e_off_0=3, e_off_1=3, e_def_0=0.5, e_def_1=0.5, x_off_0_1=9, x_def_0_1=0.25)
    assert s.ortg == pytest.approx(100 + sum(x[n] * (i + 1) for i, n in enumerate(names)))
    assert s.net == pytest.approx(s.ortg - s.drtg)


def test_leakage_and_overlap_are_refused(spark, tmp_path):
    with pytest.raises(ValueError, match="overlaps"):
        ln.refuse_overlap("2025-26", {"2025-26"})
    bad = spark.createDataFrame([(1, 1.0, 1.0, "prior", "2025-26 final"), (2, 1.0, 1.0, "draft_prior", "class of 2025-26")], schemas.SKILL)
    bad.write.parquet(str(tmp_path / "skill"))
    with pytest.raises(ValueError, match="n_leaking"):
        tables.skill(spark, str(tmp_path / "skill"), ["2025-26"])
    assert tables.skill(spark, str(tmp_path / "skill"), ["2023-24"]).count() == 2


def test_cluster_bootstrap_equals_refits(spark):
    rng = np.random.default_rng(2)
    n, k = 120, 3
    mix = rng.dirichlet(np.ones(k), n)
    pdf = pd.DataFrame({f"a{i}": mix[:, i] for i in range(k)})
    pdf["sum_bpm"], pdf["min"], pdf["team"] = rng.normal(size=n), rng.uniform(1, 5, n), rng.integers(0, 6, n).astype(str)
    pdf["entropy"] = np.exp(-(mix * np.log(mix)).sum(axis=1))
    pdf["y"] = pdf["sum_bpm"] + 2 * pdf["a1"] + rng.normal(scale=0.1, size=n)
    m = ln.fit_outcome(spark.createDataFrame(pdf), "y", k, reference=0, draws=20)
    def wls(d):
        x = np.column_stack([np.ones(len(d)), d[m.names]])
        return np.linalg.lstsq(x * np.sqrt(d["min"].to_numpy())[:, None], d["y"] * np.sqrt(d["min"]), rcond=None)[0]
    full = wls(pdf)
    assert np.allclose(m.coef, full[1:], atol=1e-6) and m.intercept == pytest.approx(full[0], abs=1e-6)
    teams = sorted(pdf["team"].unique())
    boot = [wls(pd.concat([pdf[pdf["team"] == t] for t, c in zip(teams, row) for _ in range(c)]))[1:] for row in ln.draw_counts(6, 20)]
    assert np.allclose(m.ci, np.percentile(boot, [2.5, 97.5], axis=0).T, atol=1e-5)


def test_sets_of_a_roster(spark):
    from itertools import combinations
    rng = np.random.default_rng(3)
    n, k = 7, 3
    rec, mat = rng.dirichlet(np.ones(k), n), rng.normal(size=(k, k))
    mat = mat + mat.T
    df = spark.createDataFrame([("t", i, rec[i].tolist(), float(i), float(n - i), float(rec[i] @ mat @ rec[i])) for i in range(n)],
                               "team string, member long, recipe array<double>, bpm double, min double, self_form double")
    r = cb.roster(df, ["team"], [F.col("min").desc()], ["member", "recipe", "bpm", "self_form"])
    sets = cb.enumerate_sets(r, 5, 9, ["team"])
    got = {tuple(x.ids): x for x in cb.pair_sums(cb.describe_sets(sets, 5, k), 5, mat, k).collect()}
    assert set(got) == set(combinations(range(n), 5))
    for c, x in got.items():
        assert x.score == pytest.approx(sum(rec[i] @ mat @ rec[j] for i, j in combinations(c, 2)))
        assert x.sum_bpm == sum(c) and np.allclose(x.mixture, rec[list(c)].mean(axis=0))
    with pytest.raises(ValueError, match="too large"):
        cb.index_table(spark, range(5, 41), 5)


def test_storage_round_trips(spark, tmp_path):
    p = str(tmp_path / "d")
    a = spark.createDataFrame([("s1", 1), ("s2", 2)], "season string, v int")
    tables.ingest(a, p, ["season"])
    tables.ingest(a.unionByName(spark.createDataFrame([("s3", 3)], "season string, v int")), p, ["season"])
    assert sorted(r.v for r in spark.read.parquet(p).collect()) == [1, 2, 3]
    tables.overwrite_slices(spark.createDataFrame([("s2", 20)], "season string, v int"), p)
    assert sorted(r.v for r in spark.read.parquet(p).collect()) == [1, 3, 20]
    calls = []
    def compute():
        calls.append(1)
        return a
    for _ in range(2):
        assert tables.read_through(spark, str(tmp_path / "c"), compute, k=3).count() == 2
    tables.read_through(spark, str(tmp_path / "c"), compute, k=4)
    assert len(calls) == 2
    m = np.array([[1.0, 2.0], [2.0, -1.0]])
    tables.save_matrix(spark, m, str(tmp_path / "m"))
    assert np.allclose(tables.load_matrix(spark, str(tmp_path / "m")), m)
    lm = ln.LinearModel(["x", "y"], np.array([1.0, 2.0]), 3.0, np.zeros(2), np.ones(2), {"league_average": {"x": 1.5, "y": 2.5}})
    tables.save_model(lm, spark, str(tmp_path / "lm"))
    back = tables.load_model(spark, str(tmp_path / "lm"))
    assert dict(zip(back.names, back.beta)) == {"x": 1.0, "y": 2.0} and back.intercept == 3.0 and back.meta["league_average"]["y"] == 2.5
    with pytest.raises(ValueError, match="missing"):
        schemas.require(a, schemas.STINTS, "stints")


def test_nested_records(spark, tmp_path):
    (tmp_path / "t.json").write_text('{"teamId": 1, "season": 2026, "totalMinutes": 200, "teamStats": {"fieldGoals": {"made": 30, "attempted": 60}, "rebounds": {"total": 40}, "possessions": 70}, '
                                     '"opponentStats": {"fieldGoals": {"made": 25, "attempted": 55}, "threePointFieldGoals": {"made": 5, "attempted": 15}, "rebounds": {"total": 35}, "possessions": 69}}\n{"teamId": 2}\n')
    t = nested.team_records(spark, str(tmp_path / "t.json")).collect()
    assert len(t) == 1 and (t[0].tm_fgm, t[0].opp_fg3a, t[0].opp_trb) == (30, 15, 35)


def test_dictionary_meanings(spark):
    cols = spark.createDataFrame([("t", "MIN"), ("u", "MIN"), ("t", "PTS_RANK"), ("t", "ODD")], "table string, column string")
    spec = spark.createDataFrame([("t", "MIN", "total minutes")], "table string, column string, meaning string")
    common = spark.createDataFrame([("MIN", "minutes"), ("PTS", "points")], "column string, meaning string")
    got = {(r.table, r.column): r.meaning for r in ql.column_meanings(cols, spec, common).collect()}
    assert got == {("t", "MIN"): "total minutes", ("u", "MIN"): "minutes", ("t", "PTS_RANK"): "rank of: points", ("t", "ODD"): "unknown"}
    a = spark.range(1)
    a.createOrReplaceTempView("zeta"), a.createOrReplaceTempView("alpha")
    names = [r.name for r in ql.table_list(spark, ["zeta"]).collect() if r.name in ("zeta", "alpha")]
    assert names == ["zeta", "alpha"]


def test_pair_weights_cover_every_order(spark, sf):
    """A pair carries both members' weight, so an order of n members counts each weight n - 1 times."""
    from blendscope import warehouse as wh

    per_order = wh.lines(spark, sf).groupBy("game").agg(F.countDistinct("member").alias("n"), F.sum("qty").alias("qty"))
    want = per_order.agg(F.sum((F.col("n") - 1) * F.col("qty"))).first()[0]
    got = wh.pairs(spark, sf).agg(F.sum("min")).first()[0]
    assert float(got) == pytest.approx(float(want))


def test_roster_larger_than_its_slots_is_an_error(spark):
    from blendscope.plans import combos as cb

    rows = spark.createDataFrame([("t", i, float(i)) for i in range(6)], "team string, member long, w double")
    rosters = cb.roster(rows, ["team"], [F.col("w").desc()], ["member"])
    assert cb.enumerate_sets(rosters, 3, 6, ["team"]).count() == 20
    with pytest.raises(Exception, match="6 members, more than 5"):
        cb.enumerate_sets(rosters, 3, 5, ["team"]).collect()


def test_outcome_report_joins_its_parts(spark):
    rng = np.random.default_rng(6)
    n, k = 120, 3
    mix = rng.dirichlet(np.ones(k), n)
    pdf = pd.DataFrame({f"a{i}": mix[:, i] for i in range(k)})
    pdf["sum_bpm"], pdf["min"], pdf["team"] = rng.normal(size=n), rng.uniform(1, 5, n), rng.integers(0, 8, n).astype(str)
    pdf["entropy"] = np.exp(-(mix * np.log(mix)).sum(axis=1))
    pdf["y"] = pdf["sum_bpm"] + 2 * pdf["a1"] + rng.normal(scale=0.1, size=n)
    df = spark.createDataFrame(pdf)
    rows = {(r.section, r["item"]): r for r in ln.outcome_report({3: df, 4: df}, df, "y", k, draws=20).collect()}
    m = ln.fit_outcome(df, "y", k, draws=20)
    for name, c, (lo, hi) in zip(m.names, m.coef, m.ci):
        got = rows["model", name]
        assert (got.value, got.low, got.high) == pytest.approx((c, lo, hi))
        assert rows["size_3", name].value == pytest.approx(c) == rows["size_4", name].value
    assert rows["extrapolation", "n"].value == n and rows["extrapolation", "corr_full"].value > 0.9
    assert rows["cross_validation", "r2_full"].value > rows["cross_validation", "r2_baseline"].value


def test_grounding_of_the_underused_component(spark):
    from blendscope.plans import miscast as mc

    rng = np.random.default_rng(4)
    features = ["ts", "ast", "stl", "usg", "dist", "far"]
    outcome, opportunity, evidence = ["ts", "ast", "stl"], ["usg", "dist", "far"], ["ast", "ts", "far", "usg"]
    vectors = rng.normal(size=(3, 6))
    z = rng.normal(size=(40, 6))
    z[0] = vectors[1] * 0.01  # nothing reaches the cut on the outcome side
    z[1] = np.nan_to_num(z[1]) * 0 + 9.0  # no deficit anywhere
    under = rng.integers(0, 3, 40)
    scores = spark.createDataFrame([(i, "2000-01", z[i].tolist(), int(under[i]), 0.5, 12.0) for i in range(40)],
                                   "member long, season string, z array<double>, underused int, score double, gap_pp double")
    basis = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vectors)], "component int, z array<double>")
    got = {r["member"]: r for r in mc.miscast_grounding(scores, basis, features, outcome, opportunity, evidence).collect()}
    assert len(got) == 40
    for i in range(40):
        b = vectors[under[i]]
        o = max(((z[i][j] * b[j], features[j], z[i][j]) for j, f in enumerate(features) if f in outcome and f in evidence))
        d = max(((b[j] - z[i][j], features[j], z[i][j]) for j, f in enumerate(features) if f in opportunity and f in evidence))
        assert got[i]["underused"] == under[i]
        assert got[i]["outcome_feature"] == (o[1] if o[0] >= 0.3 else None)
        assert got[i]["opportunity_feature"] == (d[1] if d[0] >= 0.3 else None)
        assert got[i]["deficit"] == (pytest.approx(d[0]) if d[0] >= 0.3 else None)
    assert got[1]["opportunity_feature"] is None


def test_ranks_of_equal_mixtures_tie_whatever_the_summation_order(spark):
    from blendscope.plans import identity

    rows = [(1, "s", [0.1 + 0.2, 0.7]), (2, "s", [0.3, 0.7]), (3, "s", [0.3, 0.7000000000000001]), (4, "s", [0.1, 0.9])]
    df = spark.createDataFrame(rows, "member long, season string, recipe array<double>")
    got = {r.member: (r.purity_pct, r.entropy_pct) for r in identity.purity_entropy(df, 2).collect()}
    assert got == {1: (0.0, 0.25), 2: (0.0, 0.25), 3: (0.0, 0.25), 4: (0.75, 0.0)}


def test_attribution_is_no_matter_of_the_last_digit(spark):
    from blendscope.plans import identity

    a, b = 0.1 + 0.2, 0.3  # equal but for the last digit
    z = spark.createDataFrame([(1, "a", [a, 0.0, 0.0]), (1, "b", [a + 1.0, -1.0, a + 0.7])], "member long, season string, z array<double>")
    mix = spark.createDataFrame([(1, "a", [0.5, 0.2, 0.3]), (1, "b", [0.2, 0.2 + b, 0.3])], "member long, season string, recipe array<double>")
    basis = spark.createDataFrame([(0, [b, 1.0, 0.0]), (1, [b, -1.0, 1.0]), (2, [0.0, 0.0, 0.0])], "component int, z array<double>")
    got = [(r.feature, r.toward_riser, r.away_from_faller) for r in
           identity.attribution(z, mix, basis, ["x", "y", "v"], 3).orderBy("rank").collect()]
    assert got == [("x", False, False), ("y", True, True), ("v", True, False)]


def test_elasticity_ties_and_its_threshold_do_not_hang_on_the_twelfth_digit(spark):
    from blendscope.plans import context

    # the changes of 0 and 1 are equal but lie on both sides of a twelfth digit; the spread is 6 points but for the last digit
    rows = [(1, 0, 0.0300000000004999), (1, 1, 0.0300000000005001), (1, 2, -0.03)]
    df = spark.createDataFrame([(m, "s", c, True, False, v) for m, c, v in rows],
                               "member long, season string, component int, available boolean, thin boolean, usage_delta double")
    r = context.elasticity(df).first()
    assert (r.best, r.worst, r.biggest, r.spread_pp, r.word) == (0, 2, 0, 6.0, "elastic")


def test_bench_and_comparison_read_recipes_and_exposure_once(spark, sf, monkeypatch):
    from blendscope.suite import environment as se

    kept, cut = [], se.cut_lineage
    monkeypatch.setattr(se, "cut_lineage", lambda df: kept.append(sorted(df.columns)) or cut(df))
    t = se.Tables(spark, sf).keep(pairs=True)
    assert kept == [["member", "min", "recipe", "season"], ["a", "b", "min", "net_rating", "season"], ["exposure", "mate_min", "member", "n_dropped", "n_mates", "season"]]
    plain = se.Tables(spark, sf)
    bench = plain.bench()
    plain.mismatch()
    assert len(kept) == 5  # recipes and exposure, once for both
    assert bench.count() > 0
    ranked = env.ranked_partners(t.edges, t.recipes, 3)
    a, b = (env.group_performance(t.edges, t.recipes, wh.lineups(spark, sf), **kw).select("season", "focal", "ids") for kw in ({}, {"ranked": ranked}))
    assert a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0


def test_lift_joins_the_own_rating_after_the_sums(spark):
    edges = spark.createDataFrame([("s", 1, 2, 4.0, 10.0), ("s", 1, 3, 6.0, None), ("s", 2, 1, 4.0, 10.0)], "season string, focal long, mate long, min double, net_rating double")
    recipes = spark.createDataFrame([(1, "s", [0.5, 0.5]), (2, "s", [1.0, 0.0]), (3, "s", [0.5, 0.5])], "member long, season string, recipe array<double>")
    own = spark.createDataFrame([(1, "s", 2.0)], "member long, season string, net_rating double")
    out = env.lift(edges, recipes, own, 2)
    got = {(r.member, r.component): (r.lift, r.mass, r.n_mates) for r in out.collect()}
    assert got == {(1, 0): (32.0 / 7.0, 7.0, 2), (1, 1): (0.0, 3.0, 1)}  # a pair without a rating has mass and no lift
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Join Inner") < plan.index("Aggregate")  # the join lies above the sums


def test_both_sides_of_a_design_come_from_one_pass(spark):
    stints = spark.createDataFrame(
        [(1, 1, 1, "s", [1, 2], [3], 90.0, 4.0), (1, 1, 0, "s", [3], [1, 2], 80.0, 5.0), (2, 1, 1, "s", [1, 9], [3], 70.0, 6.0), (3, 1, 1, "s", [], [3], 60.0, 7.0)],
        "game long, stint int, home_off int, season string, off array<long>, def array<long>, y_off double, off_possessions double")
    rec = spark.createDataFrame([(1, "s", [0.25, 0.75]), (2, "s", [0.5, 0.5]), (3, "s", [1.0, 0.0])], "member long, season string, recipe array<double>")
    skill = spark.createDataFrame([(1, "s", 2.0, 4.0), (2, "s", 1.0, 8.0), (3, "s", 3.0, 16.0)], "member long, season string, skill_off double, skill_def double")
    d = ln.design(stints, rec, skill, 2)
    assert d._jdf.queryExecution().optimizedPlan().toString().count("Generate ") == 1
    got = {(r.game, r.home_off): (r.s_off, r.s_def, r.e_off_0, r.e_off_1, r.e_def_0, r.x_off_0_1, r.y_off) for r in d.collect()}
    assert got == {(1, 1): (3.0, 16.0, 1.0, 2.0, 16.0, 2.0, 90.0), (1, 0): (3.0, 12.0, 3.0, 0.0, 5.0, 0.0, 80.0)}  # unknown or no members: no row
    f = ln.lineup_features(stints.select("season", F.col("off").alias("ids"), "game"), rec, skill, 2, ["season", "ids", "game"])
    assert f._jdf.queryExecution().optimizedPlan().toString().count("Generate ") == 1
    assert {tuple(r.ids): (r.s_off, r.s_def, r.home_off) for r in f.collect()} == {(1, 2): (3.0, 12.0, 0.5), (3,): (3.0, 16.0, 0.5)}


def test_the_report_joins_lines_with_parts_before_it_branches(spark, sf):
    from blendscope import suite
    from blendscope.suite import sources as so  # noqa: F401

    plan = suite.QUERIES["member_report"](spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    assert "p_partkey" not in plan  # the mixtures were kept once for all its branches
