"""Whitening against exact fractions; odd vectors."""
import math
import random
from fractions import Fraction

import numpy as np
import pytest

from parleo.llm import whitening


def brute(vectors):
    """Covariance of distinct whole vectors in fractions, its eigenvectors, deviations."""
    x = {tuple(math.floor(256 * float(np.float32(c))) for c in v) for v in vectors}
    n, d = len(x), len(next(iter(x)))
    s = [sum(v[i] for v in x) for i in range(d)]
    mean = [Fraction(t, n) for t in s]
    cov = np.array([[float(sum((v[i] - mean[i]) * (v[j] - mean[j]) for v in x) / n) for j in range(d)] for i in range(d)])
    return n, s, cov


@pytest.fixture(scope="module")
def vectors(spark):
    rng = random.Random(3)
    rows = [[rng.gauss(0.1 * i, 0.2 + 0.1 * i) for i in range(6)] for _ in range(300)]
    rows += [rows[0]] * 150
    return rows, spark.createDataFrame(list(enumerate(rows)), "vec_id bigint, embedding array<float>")


def test_whitening_matches_fractions(vectors):
    rows, df = vectors
    got = whitening.whiten(df.repartition(5)).collect()
    n, s, cov = brute(rows)
    values, axes = np.linalg.eigh(cov)
    assert len(got) == 4 * len(rows) and {r["n"] for r in got} == {n}
    by = {(r["vec_id"], r["component"]): r for r in got}
    for k in range(4):
        e, axis = values[-1 - k], axes[:, -1 - k]
        sign = None
        for i, v in enumerate(rows):
            x = [math.floor(256 * float(np.float32(c))) for c in v]
            want = sum((a - b / n) * c for a, b, c in zip(x, s, axis)) / math.sqrt(e)
            r = by[i, k + 1]
            sign = sign or (1 if want * r["whitened"] > 0 else -1)
            assert r["whitened"] * sign == pytest.approx(want, abs=1e-9)
            assert r["deviation"] == sum((n * a - b) ** 2 for a, b in zip(x, s)) == int(r["deviation_exact"])
            assert r["explained"] == pytest.approx(e / cov.trace(), rel=1e-9) and r["identity_error"] < 1e-9


def test_polarisation_is_exact_for_huge_values(spark):
    rows = [[float(a) * 1e12, float(b) * 1e12, 1.0] for a, b in [(1, 5), (2, -3), (7, 7), (-4, 0), (9, 2)]]
    df = spark.createDataFrame(list(enumerate(rows)), "vec_id bigint, embedding array<double>")
    v = whitening.whole_vectors(df)
    x = [[math.floor(256 * c) for c in r] for r in rows]
    got = {r["vec_id"]: r for r in whitening.whiten(df).where("component = 1").collect()}
    s = [sum(r[i] for r in x) for i in range(3)]
    assert [r["x"] for r in sorted(v.collect(), key=lambda r: r["vec_id"])] == x
    for i, r in enumerate(x):
        want = sum((5 * a - b) ** 2 for a, b in zip(r, s))
        assert int(got[i]["deviation_exact"]) == want and got[i]["deviation"] is None


def test_whitening_of_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [1.0, 2.0]), (1, [1.0, 2.0]), (None, [3.0, -0.0]), (2, None), (3, [1.0, None]), (4, [nan, 1.0]), (5, [1.0, -inf]), (6, []), (7, [1.0, 2.0, 3.0]),
            (8, [0.5, 0.5]), (9, [1e300, 0.0, 0.0, 1.0])]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>").selectExpr("*", "'a' AS x", "1 AS n", "2 AS dims", "3 AS component")
    got = whitening.whiten(df).collect()
    assert sorted((r["vec_id"] or 0, r["component"], r["n"]) for r in got) == [(0, 1, 3), (0, 2, 3), (1, 1, 3), (1, 1, 3), (1, 2, 3), (1, 2, 3), (8, 1, 3), (8, 2, 3)]
    assert whitening.whiten(df.limit(0)).collect() == []
    flat = df.where("vec_id = 1")
    assert whitening.whiten(flat).collect() == []
