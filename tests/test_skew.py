"""Chunked operators against plain Python, with one key that owns a third of the rows."""
import random

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from parleo.plans.skew import attach, dim, exact_quantile, islands, lookahead, salted_join, scan, with_halo


@pytest.fixture(scope="module")
def rows(spark):
    rnd = random.Random(7)
    data = []
    for i in range(600):
        key = 0 if i % 3 == 0 else rnd.randint(1, 40)
        data.append((key, i, i // 5, rnd.choice("aabc"), rnd.randint(0, 50), None if i % 4 else rnd.choice("xyz")))
    return spark.createDataFrame(data, "k int, pos bigint, chunk bigint, v string, x bigint, m string").repartition(4).persist(), data


def by_key(data):
    out = {}
    for r in data:
        out.setdefault(r[0], []).append(r)
    return out


def test_scan_matches_python(rows):
    df, data = rows
    got = {(r.k, r.pos): r for r in scan(df, ["k"], "chunk", ["pos"], {
        "s": ("sum", F.col("x"), True), "b": ("sum", F.col("x"), False), "mx": ("max", F.col("x"), False), "la": ("last", F.col("m"), False),
        "t": ("all_sum", F.col("x"), True), "w": ("all_max", F.col("x"), True)}).collect()}
    for k, rs in by_key(data).items():
        s, mx, la = 0, None, None
        for r in rs:
            g = got[(k, r[1])]
            assert g.b == s and g.mx == mx and g.la == la
            s += r[4]
            mx = r[4] if mx is None else max(mx, r[4])
            la = r[5] or la
            assert g.s == s and g.t == sum(z[4] for z in rs) and g.w == max(z[4] for z in rs)


def test_islands_match_python(rows):
    df, data = rows
    got = {(r.k, r.pos): r.island for r in islands(df, ["k"], "chunk", ["pos"], F.col("v")).collect()}
    for k, rs in by_key(data).items():
        n, prev = -1, object()
        for r in rs:
            if r[3] != prev:
                n, prev = n + 1, r[3]
            assert got[(k, r[1])] == n


@pytest.mark.parametrize("p", [0.05, 0.5, 0.95])
def test_exact_quantile(rows, p):
    df, data = rows
    got = {r.k: r.q for r in exact_quantile(df, ["k"], "x", p, "q").collect()}
    for k, rs in by_key(data).items():
        assert got[k] == pytest.approx(float(np.percentile([r[4] for r in rs], p * 100)))


def test_halo_sees_neighbours(rows):
    df, data = rows
    dense = scan(df, ["k"], "chunk", ["pos"], {"i": ("sum", F.lit(1).cast("bigint"), False)})
    w = Window.partitionBy("k", "_b").orderBy("i")
    h = with_halo(dense, ["k"], "i", 2, 3).withColumns({"n2": F.lead("v", 2).over(w), "p2": F.lag("v", 2).over(w)}).where("_own")
    got = {(r.k, r.pos): (r.n2, r.p2) for r in h.collect()}
    assert len(got) == len(data)
    for k, rs in by_key(data).items():
        for j, r in enumerate(rs):
            want = (rs[j + 2][3] if j + 2 < len(rs) else None, rs[j - 2][3] if j >= 2 else None)
            assert got[(k, r[1])] == want


def test_lookahead_finds_phrases_across_rows(spark):
    rnd = random.Random(3)
    words = ["we", "will", "send", "police", "now", "ok"]
    data = [(i % 3, i, i // 4, " ".join(rnd.choice(words) for _ in range(rnd.randint(0, 3)))) for i in range(240)]
    df = spark.createDataFrame(data, "k int, pos bigint, chunk bigint, text string")
    phrases = ["we will", "will send police", "send police now ok", "police now"]
    hay = lookahead(df, ["k"], "chunk", ["pos"], "text", 5, "hay")
    got = {(r.k, p) for r in hay.select("k", "hay").collect() for p in phrases if f" {p} " in f" {r.hay} "}
    want = set()
    for k in range(3):
        full = " ".join(t for kk, _, _, t in data if kk == k and t)
        want |= {(k, p) for p in phrases if f" {p} " in f" {full} "}
    assert got == want and want


def test_attach_and_salted_join_keep_all_rows(rows):
    df, data = rows
    per = df.groupBy("k").agg(F.sum("x").alias("tot"))
    assert attach(df, per, ["k"], "chunk").count() == len(data)
    assert salted_join(df, per, ["k"], ["pos"]).count() == len(data)
    assert dim(per)[1] and not dim(per, 3)[1]


@pytest.mark.parametrize("how", ["inner", "left", "left_anti"])
def test_salted_join_sends_no_repeated_rows_through_the_driver(rows, how):
    df, _ = rows
    j = salted_join(df, df.select("k").distinct(), ["k"], ["pos"], how=how)
    j.collect()
    assert "Broadcast" not in j._jdf.queryExecution().executedPlan().toString()
