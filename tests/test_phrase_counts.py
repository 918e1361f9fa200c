"""Phrase counts against plain Python; one row per place is shuffled, not one per place and size."""
from collections import Counter

from parleo.operators.mining import phrase_counts

TEXTS = [("a b c d e f", 1), ("A b  c d\ne g", 0), ("a b c", 1), ("a b", 1), ("", 0), (None, 1), ("a a a a a a a", 0), ("x a b c d", 1), ("a b c d e f", None), ("ab c d", 0)]


def brute(sizes):
    n, m, seen = Counter(), Counter(), set()
    for text, y in TEXTS:
        ws = (text or "").lower().split()
        for k in sizes:
            for i in range(len(ws) - k + 1):
                p = " ".join(ws[i:i + k])
                seen.add(p)
                n[p] += y == 1
                m[p] += y == 0
    return {(p, n[p], m[p]) for p in seen}


def test_phrase_counts_match_python(spark):
    docs = spark.createDataFrame(TEXTS, "text string, y int").repartition(3)
    for sizes in ((3, 4, 5), (2,), (1, 3)):
        got = phrase_counts(docs, "y", sizes).select("phrase", "n_scam", "n_normal").collect()
        assert len(got) == len(set(got)) and {tuple(r) for r in got} == brute(sizes)


def test_one_row_per_place_is_shuffled(spark):
    plan = phrase_counts(spark.createDataFrame(TEXTS, "text string, y int"), "y")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "hashpartitioning(phrase" not in plan
