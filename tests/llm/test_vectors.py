"""The vector range join against brute force."""

import math

import numpy as np
import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from blendscope.llm import vectors
from blendscope.llm.components import components

SCHEMA = "vec_id long, embedding array<float>, label int, node string, kept string"


def brute(rows, cosine=0.98):
    """vec_id -> (n_links, component_id) by comparing every pair."""
    good = [(r[0], np.array(r[1], np.float32).astype(float), r[2]) for r in rows
            if r[1] and r[2] is not None and all(v is not None and math.isfinite(v) for v in r[1]) and any(r[1])]
    near = {r[0]: set() for r in rows}
    for a, x, la in good:
        for b, y, lb in good:
            if a != b and la == lb and len(x) == len(y) and x @ y / np.sqrt((x @ x) * (y @ y)) >= cosine:
                near[a].add(b)
    out = {}
    for a in near:
        seen, todo = {a}, [a]
        while todo:
            for b in near[todo.pop()] - seen:
                seen.add(b)
                todo.append(b)
        out[a] = (len(near[a]), min(seen))
    return out


def result(spark, rows):
    df = spark.createDataFrame([(*r, "x", "y") for r in rows], SCHEMA)
    out = vectors.linked_vectors(df)
    assert set(out.columns) == {"vec_id", "embedding", "label", "node", "n_links", "component_id", "kept"}
    got = out.collect()
    assert all(r.kept == (r.vec_id == r.component_id) and r.node == "x" for r in got)
    return {r.vec_id: (r.n_links, r.component_id) for r in got}


def clustered(rng, n, clusters, spread):
    centres = rng.normal(size=(clusters, 16))
    return [(i, (centres[i % clusters] + rng.normal(scale=spread, size=16)).astype(np.float32).tolist(), i % 2) for i in range(n)]


def test_clusters_use_pivots_and_match_brute_force(spark, monkeypatch):
    monkeypatch.setattr(vectors, "TILE", 32)
    rows = clustered(np.random.default_rng(1), 240, 12, 0.12)
    x = np.array([r[1] for r in rows], float)
    assert len(vectors.choose_pivots(x / np.linalg.norm(x, axis=1)[:, None], 0.2)) > 1
    assert result(spark, rows) == brute(rows)


def test_hot_vector_bad_values_and_lengths(spark):
    rng = np.random.default_rng(2)
    rows = clustered(rng, 60, 60, 0.1) + [(100 + i, [1.0] * 16, 0) for i in range(40)]
    rows += [(200, None, 0), (201, [], 0), (202, [0.0] * 16, 0), (203, [float("nan")] + [1.0] * 15, 0), (204, [None] + [1.0] * 15, 0),
             (205, [float("inf")] + [1.0] * 15, 0), (206, [1.0] * 16, None), (207, [1.0] * 3, 0), (208, [2.0] * 16, 0), (209, [2.0] * 16, 1)]
    assert result(spark, rows) == brute(rows)


def test_empty_table_and_null_ids(spark):
    assert vectors.linked_vectors(spark.createDataFrame([], SCHEMA)).count() == 0
    rows = [Row(vec_id=i, embedding=[1.0, 2.0], label=1, node="a", kept="b") for i in (None, 5, 7)]
    got = sorted((r.vec_id or 0, r.n_links, r.component_id) for r in vectors.linked_vectors(spark.createDataFrame(rows, SCHEMA)).collect())
    assert got == [(0, 2, 5), (5, 2, 5), (7, 2, 5)]


@pytest.mark.parametrize("edges", [[], [(i, i + 1) for i in range(40)], [(0, i) for i in range(1, 30)] + [(40, 41), (41, 40), (50, 50)]])
def test_components(spark, edges):
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    parent = {}
    for a, b in edges:
        if a != b:
            parent.setdefault(a, a), parent.setdefault(b, b)
    for _ in parent:
        for a, b in edges:
            if a != b:
                parent[a] = parent[b] = min(parent[a], parent[b])
    assert got == parent


def test_registered_query_keeps_every_row(spark, sf):
    from blendscope.llm.queries import QUERIES

    out = QUERIES["op3_vector_links"](spark, sf)
    assert out.count() == spark.read.parquet(f"{sf}/embeddings.parquet").count()
    assert out.filter(F.col("kept") != (F.col("vec_id") == F.col("component_id"))).count() == 0
