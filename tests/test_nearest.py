"""Nearest vectors: both ways against all pairs."""
from __future__ import annotations

import numpy as np
import pytest

from parleo.operators import mining


def _brute(vecs, asked, k):
    out = []
    for label, q_id, q in asked:
        q = np.array(q)
        sims = [(-(np.floor(v @ q / (np.linalg.norm(v) * np.linalg.norm(q)) * 1e6 + 0.5) / 1e6), i) for i, v in vecs if i != q_id]
        out += [(label, q_id, i, -s, n + 1) for n, (s, i) in enumerate(sorted(sims)[:k])]
    return sorted(out)


def _rows(df):
    return sorted((r.label, r.q_id, r.vec_id, r.sim, r.rn) for r in df.collect())


@pytest.mark.parametrize("clustered", [True, False])
def test_both_ways_match_all_pairs(spark, clustered):
    rng = np.random.default_rng(3)
    mids = rng.normal(size=(6, 8)) * (20 if clustered else 0)
    vecs = [(i, (mids[i % 6] + rng.normal(size=8)).astype(np.float32).astype(float)) for i in range(300)]
    vecs += [(300 + i, vecs[7][1]) for i in range(9)]  # ties of equal vectors
    good = [(i, v.tolist()) for i, v in vecs]
    bad = [(900, None), (901, [0.0] * 8), (902, [float("nan")] * 8), (903, [None] + [1.0] * 7), (None, [1.0] * 8)]
    v = spark.createDataFrame(good + bad, "vec_id long, embedding array<float>").repartition(3)
    asked = [(0, i, vecs[i][1].tolist()) for i in range(0, 60)] + [(1, 10_000, (-vecs[3][1]).tolist())]
    q = spark.createDataFrame([*asked, (2, 10_001, None), (2, 10_002, [0.0] * 8)], "label int, q_id long, q array<double>")
    want = _brute(vecs, asked, 5)
    assert _rows(mining.top_similar(v, q)) == want
    assert _rows(mining.top_indexed(*mining.vector_index(v, 7), q)) == want


def test_more_questions_than_travel(spark, monkeypatch):
    monkeypatch.setattr(mining, "QUESTIONS", 2)
    rows = [(i, [float(i % 5 + 1), float(i % 3), 1.0]) for i in range(40)]
    v = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    q = v.where("vec_id < 6").selectExpr("0 AS label", "vec_id AS q_id", "embedding AS q")
    assert _rows(mining.top_similar(v, q)) == _brute([(i, np.array(x)) for i, x in rows], [(0, i, rows[i][1]) for i in range(6)], 5)


def test_empty_and_fewer_than_k(spark):
    none = spark.createDataFrame([], "vec_id long, embedding array<float>")
    q = spark.createDataFrame([(0, 1, [1.0, 0.0])], "label int, q_id long, q array<double>")
    assert _rows(mining.top_similar(none, q)) == [] == _rows(mining.top_indexed(*mining.vector_index(none), q))
    two = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0])], "vec_id long, embedding array<float>")
    assert _rows(mining.top_similar(two, q)) == [(0, 1, 2, 0.0, 1)] == _rows(mining.top_indexed(*mining.vector_index(two), q))
    assert mining.top_similar(two, q.where("false")).count() == 0
