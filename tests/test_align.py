"""Word alignment against known substitutions and against the whole edit distance table."""
import random

import numpy as np
import pytest

from parleo.functions import align
from parleo.operators import mining


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def cost(a, b, pairs):
    """Edits of an alignment given by its matches."""
    i = j = total = 0
    for x, y in [*sorted(pairs), (len(a), len(b))]:
        total += max(x - i, y - j)
        i, j = x + 1, y + 1
    return total


@pytest.mark.parametrize("seed", range(30))
def test_matches_rise_and_stretches_without_anchors_are_best(seed):
    rng = random.Random(seed)
    a = [rng.randrange(3) for _ in range(rng.randrange(40))]
    b = [w for w in a if rng.random() > 0.1]
    for _ in range(rng.randrange(6)):
        b.insert(rng.randrange(len(b) + 1), rng.randrange(4))
    got = sorted(align.matches(a, b))
    assert all(a[i] == b[j] for i, j in got)
    assert all(p[0] < q[0] and p[1] < q[1] for p, q in zip(got, got[1:]))
    whole = sorted(align._by_distance(a, b, 0, len(a), 0, len(b))) if len(a) > 1 and len(b) > 1 else got
    assert cost(a, b, whole) == distance(a, b) or len(a) < 2 or len(b) < 2
    assert cost(a, b, got) <= distance(a, b) + 2


def test_large_stretches_are_halved(monkeypatch):
    rng = random.Random(4)
    a = [rng.randrange(5) for _ in range(300)]
    b = [w if rng.random() > 0.1 else 9 for w in a]
    monkeypatch.setattr(align, "CELLS", 500)
    got = sorted(align._by_distance(a, b, 0, len(a), 0, len(b)))
    assert cost(a, b, got) == distance(a, b)
    assert np.mean([i == j for i, j in got]) > 0.9


def test_stray_words_do_not_anchor():
    truth = "a b c d e it f ti g h".split()
    heard = "a b c d e ti f it g h".split()  # both misheard: each word now occurs once, at the other place
    number = {w: k for k, w in enumerate(sorted(set(truth)))}
    assert align.swaps([number[w] for w in heard], [number[w] for w in truth]) == [(5, 5), (7, 7)]


def test_pairs_of_odd_texts(spark):
    rows = [(1, None, "a b"), (2, "a b", None), (3, "", ""), (4, "a x c", "a b c"), (5, "x", "y"), (6, "a a a b", "a a b"), (7, "one two four", "one TWO, three four")]
    got = mining.aligned_pairs(spark.createDataFrame(rows, "id int, heard string, truth string"), ["id"]).collect()
    assert sorted(tuple(r) for r in got) == [(4, 1, "x", "b"), (5, 0, "x", "y")]
