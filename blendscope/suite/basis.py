"""Queries on the archetype basis, projections and mixtures (2.10, 2.14, 2.18)."""

from __future__ import annotations

import os
import zlib

from pyspark.sql import functions as F

from blendscope import warehouse as wh
from blendscope.functions import vectors as vec
from blendscope.plans import basis as bs
from blendscope.plans import environment as env
from blendscope.plans import features as ft
from blendscope.plans import miscast as mc
from blendscope.session import checkpoint_dir, cut_lineage
from blendscope.sources import ledger, tables
from blendscope.sources.ledger import Ledger
from blendscope.suite import query, r6, s6
from blendscope.suite import sqlbase as sb
from blendscope.suite import identity as si

K = wh.K
P = len(wh.FEATURES)
FEATURES = list(wh.FEATURES)
OUTCOME = ["pts_per_100", "ts", "ast", "tov", "stl", "blk", "trb", "ftr", "bpm"]
#: Features that a reader can check without explanation.
EVIDENCE = ["ts", "ast", "usg", "far", *[f"playtype_{t.lower()}" for t in wh.TYPES[:2]]]
OPPORTUNITY = ["usg", "dist", "near", "far", *[f"playtype_{t.lower()}" for t in wh.TYPES]]
FIT_K = 8
SWEEP = range(2, 13)
SEEDS = (0, 1, 2)
REDUCED = [f for f in FEATURES if not f.startswith("playtype_")]


def population(spark, sf):
    return cut_lineage(ft.complete_cases(si.feature_table(spark, sf)).select("member", "season", "name", "min", *FEATURES))


SWEPT = {"restarts": 2}


def basis_store(spark, sf, features=tuple(FEATURES), **how) -> Ledger:
    """Ledger of fitted bases of one table and setting, one key per number of components (F19, SRC21)."""
    return Ledger(spark, f"{checkpoint_dir(spark)}/bases-{zlib.crc32(repr((os.path.abspath(sf), features, how)).encode()):08x}")


def stored_fits(spark, sf, ks, features=tuple(FEATURES), **how):
    """Population and the stored fits of every k and seed; only those of another population or setting are fitted."""
    pop = population(spark, sf)
    # sums of doubles differ in the last digits from run to run; the digest takes the digits that do not
    seen = pop.select("member", "season", *[F.round(F.col(c).cast("double"), 6).alias(c) for c in features])
    digest = ledger.digests(seen, F.lit("all"), features, SEEDS, how).first()["digest"]
    book = basis_store(spark, sf, features, **how)
    wanted = spark.createDataFrame([(str(k), digest) for k in ks], "key string, digest string")

    def fit(due):
        keys = sorted(int(r["key"]) for r in due.collect())  # one per k
        return tables.basis_rows(spark, bs.fit_runs(pop, list(features), [(k, s) for k in keys for s in SEEDS], **how)), None

    book.run(wanted, fit)
    return pop, tables.read_bases(book.rows().where(F.col("key").isin([str(k) for k in ks])))


def fitted(spark, sf, k=FIT_K, features=None):
    """Population and its best basis, read from the store if it is there."""
    pop, fits = stored_fits(spark, sf, [k], tuple(features or FEATURES), every_row=bs.EVERY_ROW)
    return pop, bs.best_of(fits)


@query("archetypoid_fit")
def archetypoid_fit(spark, sf):
    """Extreme real rows as basis, best of three starts, from the whole population."""
    _, b = fitted(spark, sf)
    m = b.meta
    return b.frame(spark).select("component", "member", "season", F.lit(round(m["explained_var"], 6)).alias("explained_var"),
                                 F.lit(m["converged"]).alias("converged"), F.lit(m["n_iter"]).alias("n_iter"))


@query("archetypoid_reduced_fit")
def archetypoid_reduced_fit(spark, sf):
    """the same fit on a feature subset."""
    _, b = fitted(spark, sf, FIT_K, REDUCED)
    return b.frame(spark).select("component", "member", "season", F.lit(round(b.meta["explained_var"], 6)).alias("explained_var"))


@query("simplex_projection")
def simplex_projection(spark, sf):
    """Mixture weights of every member and season on the stored basis, with the reconstruction residual."""
    pop, b = fitted(spark, sf)
    p = bs.project(pop, b, ["member", "season"], strict=True)
    return p.select("member", "season", *[r6(F.col("recipe")[i], f"w{i}") for i in range(b.k)], r6(bs.novelty(p, b), "novelty"))


@query("exemplar_match")
def exemplar_match(spark, sf):
    """distance of each basis vector to its nearest real row."""
    pop, b = fitted(spark, sf)
    m = bs.match_exemplars(bs.project(pop, b, ["member", "season"]), b, ["member", "season"])
    return m.select("component", "member", "season", r6("distance"))


@query("projection_check")
def projection_check(spark, sf):
    """every projection fulfils the optimality conditions of the simplex problem."""
    pop, b = fitted(spark, sf)
    return bs.check_optimality(bs.project(pop, b, ["member", "season"]), b)


@query("k_sweep")
def k_sweep(spark, sf):
    """F7 F8 F17 A3 W1 SRC21: loss, explained variance, within variance and pair coverage over k."""
    pop, fits = stored_fits(spark, sf, SWEEP, **SWEPT)
    s = bs.summarize_sweep(bs.sweep_table(pop, fits))
    best = [bs.best_of([b for b in fits if b.k == k]) for k in SWEEP]
    c = bs.coverage_by_k(wh.pairs(spark, sf), pop, [b for b in best if b.meta["all_converged"]])
    return s.join(c, "k", "left").select(
        "k", r6("rss"), r6("explained_var"), r6("intra_variance"), r6("ev_spread"), "all_converged", "max_n_iter", r6("ev_gain"), r6("intra_change"),
        "n_cells", "effective_cells", r6("min_mass"), r6("median_mass"))


@query("stored_bases", f"""SELECT k::INT AS k, 3 AS n_seeds, 3 * k::INT AS n_vectors, {P} AS n_features, true AS complete FROM (SELECT unnest(range({SWEEP[0]}, {SWEEP[-1] + 1})) AS k)
WHERE (SELECT count(*) FROM lineitem) > 0""")
def stored_bases(spark, sf):
    """F19 SRC21: the stored bases of every k; each exemplar is a row of the population."""
    pop, _ = stored_fits(spark, sf, SWEEP, **SWEPT)
    rows = basis_store(spark, sf, **SWEPT).rows().where(F.col("k").isin(list(SWEEP)))
    known = rows.join(pop.select("member", "season", F.lit(True).alias("_real")), ["member", "season"], "left")
    return known.groupBy("k").agg(
        F.count_distinct("seed").cast("int").alias("n_seeds"), F.count("*").cast("int").alias("n_vectors"), F.max(F.size("z")).alias("n_features"),
        F.bool_and(F.coalesce("_real", F.lit(False))).alias("complete"))


@query("plane_and_hull")
def plane_and_hull(spark, sf):
    """Two-dimensional plane of the basis rows and the convex hull of the population on it."""
    pop, b = fitted(spark, sf)
    pts = cut_lineage(bs.plane(bs.project(pop, b, ["member", "season"]), b, ["member", "season"]))
    h = bs.hull(pts, ["member", "season"])
    ex = b.frame(spark).select("component", "member", "season")
    return h.join(F.broadcast(ex), ["member", "season"], "left").select("vertex", "member", "season", r6("px"), r6("py"), "component")


@query("miscast_scores")
def miscast_scores(spark, sf):
    """Use-only against outcome-only mixture of every member."""
    from blendscope.operators import ordered

    pop, b = fitted(spark, sf)
    z = pop.select("member", "season", b.zscore().alias("z"))
    m = cut_lineage(bs.miscast(z, b, OPPORTUNITY, OUTCOME, ["member", "season"]))
    m = ordered.percentile_rank(m.withColumn("score", F.round("score", 12)), ["season"], "score", "pct")
    return m.select("member", "season", r6("score"), "underused", r6("gap_pp"), r6("pct"))


@query("miscast_grounding")
def miscast_grounding(spark, sf):
    """M4: outcome and opportunity features that ground the under-used component of every member."""
    pop, b = fitted(spark, sf)
    z = pop.select("member", "season", b.zscore().alias("z"))
    scores = cut_lineage(bs.miscast(z, b, OPPORTUNITY, OUTCOME, ["member", "season"]))
    rows = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(b.vectors)], "component int, z array<double>")  # k rows
    g = mc.miscast_grounding(scores, rows, list(b.features), OUTCOME, OPPORTUNITY, EVIDENCE)
    return g.select("member", "season", "underused", r6("gap_pp"), "outcome_feature", r6("outcome_z"), "opportunity_feature", r6("opportunity_z"), r6("deficit"))


@query("embedding_archetypes")
def embedding_archetypes(spark, sf):
    """F2 F4 on the embedding vectors, all dimensions: extreme vectors and their mixtures' mean weights per label."""
    e = wh.table(spark, sf, "embeddings")
    dims = [f"e{i}" for i in range(e.select(F.max(F.size("embedding"))).first()[0] or 0)]
    x = cut_lineage(e.select("vec_id", "label", *[F.col("embedding")[i].cast("double").alias(d) for i, d in enumerate(dims)]))
    b = bs.fit(x, dims, 3, keys=("vec_id",))
    w = bs.project(x, b, ["vec_id", "label"])
    return w.groupBy("label").agg(F.count(F.lit(1)).alias("n"), *[r6(F.avg(F.col("recipe")[i]), f"w{i}") for i in range(b.k)])


_CELLS = vec.triangle(K)
_CM = "cm AS (SELECT " + ", ".join(
    f"sum(p.min * 0.5 * (x.w{i} * y.w{j} + x.w{j} * y.w{i})) AS c{i}_{j}" for i, j in _CELLS) + """, count(*) AS n_pairs
 FROM pairs p JOIN mix x ON x.member = p.a AND x.season = p.season JOIN mix y ON y.member = p.b AND y.season = p.season),
cells AS (""" + " UNION ALL ".join(
    f"SELECT {i} AS i, {j} AS j, c{i}_{j} AS mass, c{i}_{j} / ({' + '.join(f'c{a}_{b}' for a, b in _CELLS)}) AS share, n_pairs FROM cm"
    for i, j in _CELLS) + ")"
_CMSQL = sb.with_(sb.LINES, sb.MIX, sb.GM, sb.PAIRS, _CM)


@query("cell_mass", _CMSQL + f"SELECT i, j, {s6('mass')} AS mass, {s6('share')} AS share, n_pairs FROM cells")
def cell_mass(spark, sf):
    """A19 J4 R18."""
    c = bs.cell_mass(wh.pairs(spark, sf), wh.recipes(spark, sf), K)
    return c.select("i", "j", r6("mass"), r6("share"), "n_pairs")


@query("cell_coverage", _CMSQL + f"""SELECT count(*) AS n_cells, count(CASE WHEN mass > 0.9 * tot / n THEN 1 END) AS effective_cells,
 {s6('min(mass)')} AS min_mass, {s6('quantile_cont(mass, 0.5)')} AS median_mass, max(n_pairs) AS n_pairs
FROM (SELECT *, sum(mass) OVER () AS tot, count(*) OVER () AS n FROM cells)""")
def cell_coverage(spark, sf):
    """F8."""
    c = bs.coverage_summary(bs.cell_mass(wh.pairs(spark, sf), wh.recipes(spark, sf), K), 0.9)
    return c.select("n_cells", "effective_cells", r6("min_mass"), r6("median_mass"), "n_pairs")


BANDS = ((0, 1500), (1500, 2000), (2000, 2500), (2500, 1e9))
_TOPW = "greatest(" + ", ".join(f"w{i}" for i in range(K)) + ")"


@query("saturation_by_band", sb.with_(sb.LINES, sb.MIX) + f"""
SELECT band, count(*) AS n, {s6('100 * avg((t > 0.4)::INT)')} AS pct_over_40, {s6('quantile_cont(t, 0.5)')} AS median_top FROM (
 SELECT CASE WHEN min < 1500 THEN 0 WHEN min < 2000 THEN 1 WHEN min < 2500 THEN 2 ELSE 3 END AS band, {_TOPW} AS t FROM mix) GROUP BY band""")
def saturation_by_band(spark, sf):
    """A16."""
    r = wh.recipes(spark, sf)
    s = bs.saturation(r, BANDS)
    extra = r.select(F.when(F.col("min") < 1500, 0).when(F.col("min") < 2000, 1).when(F.col("min") < 2500, 2).otherwise(3).alias("band"),
                     vec.purity("recipe").alias("t")).groupBy("band").agg((100 * F.avg((F.col("t") > 0.4).cast("double"))).alias("pct_over_40"))
    return s.join(extra, "band").select("band", "n", r6("pct_over_40"), r6("median_top"))


_EFF = "exp(-(" + " + ".join(f"w{i} * ln(w{i} + 1e-12)" for i in range(K)) + "))"


@query("mixture_health", sb.with_(sb.LINES, sb.MIX) + f"""SELECT season, count(*) AS n, {s6('quantile_cont(e, 0.5)')} AS median,
 {s6('quantile_cont(e, 0.1)')} AS p10, {s6('quantile_cont(e, 0.9)')} AS p90 FROM (SELECT season, {_EFF} AS e FROM mix) GROUP BY season""")
def mixture_health(spark, sf):
    """A17 F18."""
    h = bs.mixture_health(wh.recipes(spark, sf), K, ["season"])
    return h.select("season", "n", r6("median"), r6("p10"), r6("p90"))


_SUM = " + ".join(f"w{i}" for i in range(K))


@query("simplex_check", sb.with_(sb.LINES, sb.MIX) + f"""SELECT count(*) AS n, {s6(f'min({_SUM})')} AS min_sum, {s6(f'max({_SUM})')} AS max_sum,
 count(CASE WHEN abs({_SUM} - 1) > 1e-6 THEN 1 END) AS n_bad_sum, count(CASE WHEN least({", ".join(f"w{i}" for i in range(K))}) < -1e-9 THEN 1 END) AS n_negative,
 count(CASE WHEN abs({_SUM} - 1) > 1e-6 THEN 1 END) = 0 AS ok FROM mix""")
def simplex_check(spark, sf):
    """Q1 F18."""
    c = bs.simplex_check(wh.recipes(spark, sf), K)
    return c.select("n", r6("min_sum"), r6("max_sum"), "n_bad_sum", "n_negative", "ok")


_ARG = "list_position([" + ", ".join(f"w{i}" for i in range(K)) + f"], {_TOPW}) - 1"
_IV = ", ".join(f"sum(z_{c}) AS s{i}" for i, c in enumerate(FEATURES)) + ", " + f"sum({' + '.join(f'z_{c} * z_{c}' for c in FEATURES)}) AS ss"


@query("intra_variance", sb.with_(si.ZSQL, sb.MIX) + f""",
g AS (SELECT {_ARG} AS component, count(*) AS n, {_IV} FROM mix JOIN zed USING (member, season) GROUP BY ALL HAVING count(*) >= 2)
SELECT {s6(f"sum(ss - ({' + '.join(f's{i} * s{i}' for i in range(P))}) / n) / sum(n)")} AS intra_variance, sum(n)::BIGINT AS n_rows FROM g""")
def intra_variance(spark, sf):
    """A20."""
    z = wh.recipes(spark, sf).join(si.zed(spark, sf), ["member", "season"])
    return bs.intra_variance(z, P).select(r6("intra_variance"), "n_rows")


@query("grounding_features", sb.with_(si.ZSQL, sb.MIX, sb.MIXLONG, si._EXM, si._ZL) + f""",
t AS (SELECT member, season, {_ARG} AS component FROM mix SEMI JOIN zed USING (member, season)),
r AS (SELECT t.*, o.idx, o.feature, o.z, b.z AS bz FROM t JOIN zl o ON o.member = t.member AND o.season = t.season
  JOIN exemplar e ON e.component = t.component JOIN zl b ON b.member = e.member AND b.season = e.season AND b.idx = o.idx),
o AS (SELECT *, row_number() OVER (PARTITION BY member, season ORDER BY z * bz DESC, idx) AS rn FROM r WHERE feature IN ({", ".join(repr(f) for f in OUTCOME)})),
d AS (SELECT *, row_number() OVER (PARTITION BY member, season ORDER BY bz - z DESC, idx) AS rn FROM r WHERE feature IN ({", ".join(repr(f) for f in OPPORTUNITY)}))
SELECT o.member, o.season, o.component, CASE WHEN o.z * o.bz >= 0.3 THEN o.feature END AS outcome_feature, CASE WHEN o.z * o.bz >= 0.3 THEN {s6('o.z')} END AS outcome_z,
 CASE WHEN d.bz - d.z >= 0.3 THEN d.feature END AS opportunity_feature, CASE WHEN d.bz - d.z >= 0.3 THEN {s6('d.bz - d.z')} END AS deficit
FROM o JOIN d ON d.member = o.member AND d.season = o.season WHERE o.rn = 1 AND d.rn = 1""")
def grounding_features(spark, sf):
    """M4."""
    z = cut_lineage(si.zed(spark, sf))
    mix = wh.recipes(spark, sf)
    t = mix.join(z, ["member", "season"]).select("member", "season", vec.argmax("recipe").alias("component"), "z")
    g = mc.grounding(t, si.exemplars(mix, z), FEATURES, OUTCOME, OPPORTUNITY)
    return g.select("member", "season", "component", "outcome_feature", r6("outcome_z"), "opportunity_feature", r6("deficit"))


_PC = f"""pcw AS (SELECT t.member, t.season, power(1 - {sb.js(sb.cols('t', 'w'), sb.cols('q', 'w'))}, 4) AS v, q.member AS other
 FROM mix t JOIN mix q ON q.season = t.season AND q.member <> t.member),
pc AS (SELECT p.member, p.season, sum(v) * sum(v) / sum(v * v) AS ess, {", ".join(f"sum(v * z_{c}) / sum(v) AS c{i}" for i, c in enumerate(FEATURES))}
 FROM pcw p JOIN zed z ON z.member = p.other AND z.season = p.season GROUP BY p.member, p.season)"""
_SIGSQL = sb.with_(si.ZSQL, sb.MIX, _PC, si._ZL) + """,
cl AS (""" + " UNION ALL ".join(f"SELECT member, season, ess, {i} AS idx, c{i} AS c FROM pc" for i in range(P)) + """),
dv AS (SELECT zl.*, cl.ess, cl.c, zl.z - cl.c AS deviation, row_number() OVER (PARTITION BY member, season ORDER BY abs(cl.c) DESC, idx) AS loading_rank,
  row_number() OVER (PARTITION BY member, season ORDER BY abs(zl.z - cl.c) DESC, idx) AS deviation_rank FROM zl JOIN cl USING (member, season, idx))
"""


@query("peer_centroid", sb.with_(si.ZSQL, sb.MIX, _PC) + f"""SELECT member, season, {s6('ess')} AS ess,
 {", ".join(f"{s6(f'c{i}')} AS c{i}" for i in range(P))} FROM pc""")
def peer_centroid(spark, sf):
    """M5."""
    c = mc.peer_centroid(wh.recipes(spark, sf), si.zed(spark, sf), K, P)
    return c.select("member", "season", r6("ess"), *[r6(F.col("centroid")[i], f"c{i}") for i in range(P)])


@query("member_signature", _SIGSQL + f"""SELECT member, season, feature, {s6('z')} AS z, {s6('c')} AS c, {s6('deviation')} AS deviation,
 deviation_rank <= 3 AS is_top FROM dv WHERE loading_rank <= 10 OR abs(deviation) > 1""")
def member_signature(spark, sf):
    """M6."""
    z = cut_lineage(si.zed(spark, sf))
    c = mc.peer_centroid(wh.recipes(spark, sf), z, K, P)
    s = mc.signature(z, c, FEATURES)
    return s.select("member", "season", "feature", r6("z"), r6("c"), r6("deviation"), "is_top")


_GP = f"""gp AS ({sb.long_of('mis', {'d': 'd', 'used': 'e', 'prod': 'x'}, 'member, season')}),
gs AS (SELECT *, 100 * d AS pp, count(CASE WHEN abs(100 * d) >= 3 THEN 1 END) OVER (PARTITION BY member, season) AS hits,
 row_number() OVER (PARTITION BY member, season ORDER BY abs(100 * d) DESC, component) AS rank FROM gp)"""


@query("gap_selection", sb.with_(sb.ENVBENCH, _GP) + f"""SELECT member, season, component, rank, {s6('pp')} AS gap_pp, hits < 2 AS all_aligned
FROM gs WHERE CASE WHEN hits >= 2 THEN abs(pp) >= 3 ELSE rank <= 3 END""")
def gap_selection(spark, sf):
    """T8."""
    from blendscope.suite.environment import Tables

    m = Tables(spark, sf).mismatch()
    rows = env.long_components(m, {"d": "diff"}, ["member", "season"]).withColumn("gap_pp", 100 * F.col("d"))
    return mc.select_gaps(rows, ["member", "season"], "gap_pp").select("member", "season", "component", "rank", r6("gap_pp"), "all_aligned")


@query("dumbbell_rows", sb.with_(sb.ENVBENCH, _GP) + f"""SELECT member, season, component, {s6('used')} AS used, {s6('prod')} AS prod,
 row_number() OVER (PARTITION BY member, season ORDER BY greatest(used, prod) DESC, component) AS rank FROM gp
 QUALIFY row_number() OVER (PARTITION BY member, season ORDER BY greatest(used, prod) DESC, component) <= 5""")
def dumbbell_rows(spark, sf):
    """T9."""
    from blendscope.suite.environment import Tables

    m = Tables(spark, sf).mismatch()
    rows = env.long_components(m, {"used": "exposure", "prod": "expected"}, ["member", "season"])
    return mc.dumbbell(rows, ["member", "season"], "used", "prod").select("member", "season", "component", r6("used"), r6("prod"), "rank")


_PT = [f"playtype_{t.lower()}" for t in wh.TYPES]


@query("play_type_shares", sb.with_(si.FEAT_SQL) + f""",
l AS ({" UNION ALL ".join(f"SELECT member, season, {i} AS o, '{c}' AS name, {c} AS share FROM feat" for i, c in enumerate(_PT))}),
r AS (SELECT *, row_number() OVER (PARTITION BY member, season ORDER BY share DESC, o) AS rank FROM l)
SELECT member, season, rank::INT AS rank, name, {s6('share')} AS share FROM r WHERE rank <= 3
UNION ALL SELECT member, season, 4, 'Other', {s6('greatest(0, 1 - sum(share))')} FROM r WHERE rank <= 3 GROUP BY member, season""")
def play_type_shares(spark, sf):
    """M12."""
    f = si.feature_table(spark, sf)
    t = mc.top_shares(f, {c: c for c in _PT}, ["member", "season"])
    return t.select("member", "season", "rank", "name", r6("share"))
