"""Prefix trie against a dictionary of all prefixes; the spilling queue; odd rows."""
import hashlib
import random
import zlib

import pytest

from parleo.llm import prefix_trie


def brute(rows):
    """{(conv_id, depth): (parent, n_convs, n_children, n_leaves, saved, sha)} of (conv_id, turn, role, text) rows."""
    own = {}
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            tie = hashlib.sha256(f"{len(role)}:{role}{text}".encode()).digest()
            own.setdefault(c, []).append((turn is not None, turn or 0, tie, role, text))
    own = {c: [t[3:] for t in sorted(ts)] for c, ts in own.items()}
    members = {}
    ends = {}
    for c, ts in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        seq = tuple(own.get(c - c % 100, [])[:h] + ts[h:])
        for d in range(len(seq) + 1):
            members.setdefault(seq[:d], []).append(c)
        ends.setdefault(seq, []).append(c)
    kids = {}
    for p in members:
        if p:
            kids.setdefault(p[:-1], []).append(p)
    leaves, saved = {}, {}
    for p in sorted(members, key=len, reverse=True):
        mine = kids.get(p, [])
        leaves[p] = sum(leaves[k] for k in mine) or 1
        saved[p] = sum(saved[k] for k in mine) + (len(members[p]) - 1) * (len(p[-1][1]) if p else 0)
    return sorted((min(m), len(p), -1 if not p else min(members[p[:-1]]), len(m), len(kids.get(p, [])), leaves[p], saved[p],
                   hashlib.sha256(",".join(map(str, sorted(ends.get(p, [])))).encode()).hexdigest()) for p, m in members.items())


def rows_of(df):
    return sorted((r["conv_id"], r["depth"], -1 if r["parent_conv_id"] is None else r["parent_conv_id"], r["n_convs"], r["n_children"], r["n_leaves"], r["saved_tokens"], r["ends_sha256"]) for r in df.collect())


SCHEMA = "conv_id bigint, turn bigint, role string, text string"


@pytest.fixture(scope="module")
def talk():
    rng = random.Random(11)
    lines = [("user", f"line {'ä' * i}") for i in range(5)] + [("assistant", "yes"), (None, "no"), ("user", None)]
    rows = []
    for c in rng.sample(range(700), 160):
        n = rng.choice([1, 2, 4, 7])
        start = [lines[0], lines[1]] if rng.random() < 0.5 else []
        rows += [(c, t, *line) for t, line in enumerate((start + rng.choices(lines[:4] if c % 3 else lines, k=n))[:max(n, 1)])]
    long = [rng.choice(lines) for _ in range(300)]
    rows += [(c, t, *line) for c in (801, 850, 866) for t, line in enumerate(long)]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("shard_convs, queue", [(1000, 100_000), (3, 2), (1, 1), (40, 5)])
def test_trie_matches_dictionary(spark, talk, shard_convs, queue):
    df = spark.createDataFrame(talk, SCHEMA).repartition(7)
    assert rows_of(prefix_trie.trie(df, shard_convs=shard_convs, queue=queue)) == brute(talk)


def test_conversation_over_many_parts(spark, talk):
    rows = [(500, t, "user", f"turn {t}") for t in range(2000)] + [(523, t, "user", f"turn {t}") for t in range(900)] + talk[:200]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        assert rows_of(prefix_trie.trie(spark.createDataFrame(rows, SCHEMA))) == brute(rows)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_trie_of_odd_rows(spark):
    rows = [(None, 0, "user", "x"), (0, None, "user", "first"), (0, 1, None, None), (0, 1, None, None), (0, 1, "user", ""), (5, 0, "user", "only"), (7, None, None, None), (7, 3, "user", "x" * 100_000),
            (-3, 0, "user", "below zero"), (101, 0, "user", "no base"), (102, 0, "user", "no base")]
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "'a' AS part", "1 AS n", "2 AS d", "3 AS f1", "4 AS digest", "5 AS top", "6 AS len")
    # negative ids: the remainder keeps the sign, as in SQL
    got = rows_of(prefix_trie.trie(df.where("conv_id is null or conv_id >= 0")))
    assert got == brute([r for r in rows if r[0] is None or r[0] >= 0])
    assert any(r["conv_id"] == -3 for r in prefix_trie.trie(df).collect())
    assert prefix_trie.trie(df.limit(0)).collect() == []
    assert prefix_trie.trie(df.where("conv_id is null")).collect() == []


@pytest.mark.parametrize("most", [1, 3, 1000])
def test_queue_gives_messages_in_order(most):
    rng = random.Random(2)
    queue = prefix_trie.SpillingQueue(most)
    items = [((rng.randrange(40),), n, None) for n in range(500)]
    for i in items:
        queue.push(i)
    got = [i for key in range(40) for i in queue.pop_at((key,))]
    assert got == sorted(items) and (queue.runs > 0) == (most < 500)
