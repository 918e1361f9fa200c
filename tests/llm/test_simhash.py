"""SimHash groups against all pairs; full cells; odd documents."""
import random
import re

import pytest
import xxhash

from parleo.llm import simhash


def slow_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
    grams = [" ".join(words[i:i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    h = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def slow_components(prints):
    """{fingerprint: root} by comparing every pair."""
    root = {p: p for p in prints}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    todo = sorted(prints)
    for i, a in enumerate(todo):
        for b in todo[i + 1:]:
            if (a ^ b).bit_count() <= 3:
                root[find(a)] = find(b)
    return {p: find(p) for p in prints}


def check(docs, got):
    prints = {fp for _, fp in docs}
    roots = slow_components(prints)
    least = {}
    for doc, fp in docs:
        if doc is not None:
            least[roots[fp]] = min(doc, least.get(roots[fp], doc))
    want = sorted(((doc, f"{fp:016x}", least.get(roots[fp])) for doc, fp in docs), key=str)
    assert sorted(((r["doc_id"], r["fingerprint"], r["component_id"]) for r in got), key=str) == want


def test_simhash_matches_all_pairs(spark):
    rng = random.Random(5)
    word = ["".join(rng.choice("abcdefgÄß") for _ in range(rng.randint(1, 5))) for _ in range(500)]
    texts = []
    for i in range(300):
        w = rng.choices(word, k=rng.choice([1, 2, 3, 40, 400, 900]))
        if i % 3 and texts:
            w = rng.choice(texts).split(" ")
            for _ in range(i % 4):
                w[rng.randrange(len(w))] = rng.choice(word)
        texts.append(rng.choice([" ", " ", "\n"]).join(w) if i % 7 else " ".join(w).upper())
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    docs = [(i, slow_fingerprint(t)) for i, t in enumerate(texts)]
    assert len({fp for _, fp in docs}) > 100
    check(docs, simhash.groups(df).collect())


@pytest.mark.parametrize("crowd", [4, 1024])
def test_links_of_crowded_fingerprints_connect_the_same(spark, crowd):
    rng = random.Random(9)
    centres = [rng.getrandbits(64) for _ in range(6)]
    prints = {c for c in centres}
    for c in centres:
        bits = rng.sample(range(64), 14)
        for _ in range(80):
            prints.add(c ^ sum(1 << b for b in rng.sample(bits, rng.choice([1, 2, 3, 4, 6, 8]))))
    signed = [(p - (1 << 64) if p >> 63 else p,) for p in prints]
    fps = spark.createDataFrame(signed, "fp bigint")
    mask = (1 << 64) - 1
    links = [(r["a"] & mask, r["b"] & mask) for r in simhash.links(fps, crowd=crowd).collect()]
    assert links
    root = {p: p for p in prints}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        root[find(a)] = find(b)
    want = slow_components(prints)
    pairs = {(find(p), want[p]) for p in prints}
    assert len(pairs) == len({a for a, _ in pairs}) == len({b for _, b in pairs})


def test_simhash_of_odd_rows(spark, odd, none):
    rows = [(r["doc_id"], r["text"]) for r in odd.select("doc_id", "text").collect()]
    check([(d, slow_fingerprint(t)) for d, t in rows], simhash.groups(odd).collect())
    assert simhash.groups(none).collect() == []


def test_counts_are_a_lower_bound():
    import numpy as np
    rng = random.Random(1)
    a = np.array([rng.getrandbits(64) for _ in range(400)], dtype=np.uint64)
    b = np.array([int(x) ^ sum(1 << k for k in rng.sample(range(64), 5)) for x in a], dtype=np.uint64)
    for x, y in zip(simhash.counts(a).tolist(), simhash.counts(b).tolist()):
        assert sum(abs((x >> 2 * k & 3) - (y >> 2 * k & 3)) for k in range(32)) <= 5
