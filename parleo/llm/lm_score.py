"""Language-model scores by a weighted backoff automaton.

States are the words of the training texts (and the text start), arcs their
followers with smoothed log-probabilities, and every state has a failure arc to
the root with the weight that smoothing leaves for it; the root's arcs are
add-one unigrams, its own failure is the unknown word.  A text is walked once from left to
right: the state is carried, and a missing arc costs the failure weight and the root's arc.

    P(w | h) = (c(h, w) + STRENGTH * P(w)) / (c(h) + STRENGTH)
    P(w)     = (c(w) + 1) / (N + V + 1)

The whole model is never in one place.  Texts are dealt into blocks of bounded
size; a block asks for the totals of the n-grams that occur in it.  Its local
counts go to the owner of each n-gram, packed by range of hash; what comes back
are the totals that differ from the local count, from which the block builds its part of the
automaton.  All n-grams of all training texts are counted: nothing is pruned.

Defined results: null and empty texts consist of the end token alone; without
training texts every count is 0; repeated rows are scored (and counted) one by
one; a null id counts as training text and stays null; other columns are ignored.
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parleo.llm.common import deflated, fold_col, frame, id_text, inflate, text_bytes
from parleo.llm.minhash import mixed

HELD_OUT = (7, 2)
STRENGTH = 200.0
BLOCK_BYTES = 12 << 20
#: Words whose hashes a worker keeps.
CACHE = 150_000
_U = np.uint64
_START = _U(0x5851F42D4C957F2D)
_FACTOR = _U(0x2545F4914F6CDD1D)
END = b""


class _Hashes(dict):
    def __missing__(self, w: bytes) -> int:
        h = self[w] = xxhash.xxh64_intdigest(w)
        return h


def tokens(text: bytes, known: _Hashes) -> np.ndarray:
    """Hashes of the lower-cased words and of the end."""
    w = text.lower().split()
    w.append(END)
    return np.fromiter(map(known.__getitem__, w), dtype="uint64", count=len(w))


def _stream(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words, contexts, bigrams and lengths of some texts end to end."""
    known = _Hashes()
    parts = []
    for t in texts:
        parts.append(tokens(t, known))
        if len(known) > CACHE:
            known.clear()
    size = np.array([len(p) for p in parts], dtype="int64")
    word = np.concatenate(parts) if parts else np.zeros(0, "uint64")
    context = np.empty_like(word)
    context[1:] = word[:-1]
    context[np.cumsum(size) - size] = _START
    return word, context, mixed(context * _FACTOR + word), size


def counts(keys: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys, sorted, and the sums of their weights."""
    order = np.argsort(keys, kind="stable")
    k = keys[order]
    head = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]])) if len(k) else np.zeros(0, "int64")
    return k[head], np.add.reduceat(weight[order], head, dtype="int64") if len(k) else np.zeros(0, "int64")


def narrow(x: np.ndarray) -> bytes:
    """Unsigned integers in as few bytes as the largest needs, one byte position after the other."""
    w = max(1, (int(x.max()).bit_length() + 7) // 8) if len(x) else 1
    return bytes([w]) + np.ascontiguousarray(x.astype("<u8").view("u1").reshape(-1, 8)[:, :w].T).tobytes()


def widen(b: bytes) -> np.ndarray:
    cols = np.frombuffer(b, "u1", offset=1).reshape(b[0], -1)
    out = np.zeros((cols.shape[1], 8), "u1")
    out[:, :b[0]] = cols.T
    return out.reshape(-1).view("<u8")


def pack_keys(keys: np.ndarray) -> bytes:
    """Sorted keys as the distances between them."""
    return narrow(np.diff(keys, prepend=_U(0)))


def unpack_keys(b: bytes) -> np.ndarray:
    return np.cumsum(widen(b), dtype="uint64")


def look_up(keys: np.ndarray, values: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Value of each wanted key, 0 where there is none."""
    if not len(keys):
        return np.zeros(len(wanted), dtype="int64")
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return np.where(keys[at] == wanted, values[at], 0)


class Automaton:
    """Weighted backoff automaton over word hashes."""

    def __init__(self, words: tuple[np.ndarray, np.ndarray], pairs: tuple[np.ndarray, np.ndarray], n: int, v: int, starts: int, strength: float = STRENGTH):
        self.words, self.pairs, self.n, self.v, self.starts, self.strength = words, pairs, n, v, starts, strength

    def walk(self, word: np.ndarray, context: np.ndarray, pair: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Counts of the words, root weights and arc weights (log10) along the path; ``context`` is the carried state."""
        c = look_up(*self.words, word)
        root = (c + 1) / (self.n + self.v + 1)
        state = np.where(context == _START, self.starts, look_up(*self.words, context))
        failure = self.strength / (state + self.strength)
        arc = look_up(*self.pairs, pair) / (state + self.strength)
        return c, np.log10(root), np.log10(arc + failure * root)


def _first(batches: Iterator[pd.DataFrame], ranges: int) -> Iterator[pd.DataFrame]:
    """Per task: training tokens, texts and distinct words, by range of hash."""
    seen, n, texts, known = np.zeros(0, "uint64"), 0, 0, _Hashes()
    for b in batches:
        parts = []
        for t in b["text"]:
            parts.append(np.unique(x := tokens(t, known)))
            n += len(x)
            texts += 1
            if len(known) > CACHE:
                known.clear()
        seen = np.unique(np.concatenate([seen, *parts]))
    yield _by_range(seen, ranges, lambda r, part: (r, pack_keys(part), n if r == 0 else 0, texts if r == 0 else 0), _SEEN)


_SEEN = "part bigint, keys binary, n bigint, texts bigint"


def _by_range(keys: np.ndarray, ranges: int, row, schema: str) -> pd.DataFrame:
    of = (keys >> _U(33)).astype("int64") * ranges >> 31
    edge = np.searchsorted(of, np.arange(ranges + 1))
    return frame([row(r, keys[edge[r]:edge[r + 1]]) for r in range(ranges) if r == 0 or edge[r] < edge[r + 1]], schema)


def _distinct(g: pd.DataFrame) -> pd.DataFrame:
    keys = np.unique(np.concatenate([unpack_keys(k) for k in g["keys"]]))
    return frame([(int(g["n"].sum()), len(keys), int(g["texts"].sum()))], "n bigint, v bigint, texts bigint")


def totals(docs: DataFrame, ranges: int) -> tuple[int, int, int]:
    """Training tokens, distinct training tokens, training texts.  ``docs``: text, train."""
    rows = docs.where("train").select("text").mapInPandas(lambda b: _first(b, ranges), _SEEN)
    got = rows.groupBy("part").applyInPandas(_distinct, "n bigint, v bigint, texts bigint").agg(F.sum("n"), F.sum("v"), F.sum("texts")).first()
    return tuple(int(x or 0) for x in got)


_LOCAL = "part bigint, block bigint, keys binary, counts binary"


def _block(packed: pd.Series, train: pd.Series):
    texts = inflate(packed)
    word, context, pair, size = _stream(texts)
    weight = np.repeat(train.to_numpy(dtype="int32"), size)
    return word, context, pair, size, weight


def _count(g: pd.DataFrame, ranges: int) -> pd.DataFrame:
    """Local counts of all n-grams of a block; those of held-out texts are asked for with 0."""
    word, _, pair, _, weight = _block(g["packed"], g["train"])
    block = int(g["block"].iloc[0])
    keys, n = counts(np.concatenate([word, pair]), np.concatenate([weight, weight]))
    at = [0]

    def row(r: int, part: np.ndarray):
        at[0] += len(part)
        return r, block, pack_keys(part), narrow(n[at[0] - len(part):at[0]])

    return _by_range(keys, ranges, row, _LOCAL)


_TOTAL = "block bigint, keys binary, counts binary"


def _total(g: pd.DataFrame) -> pd.DataFrame:
    """Totals of one range of n-grams, for the blocks whose own count is another."""
    keys = [unpack_keys(k) for k in g["keys"]]
    own = [widen(c).view("int64") for c in g["counts"]]
    every, total = counts(np.concatenate(keys), np.concatenate(own))
    rows = []
    for block, k, c in zip(g["block"], keys, own):
        t = total[np.searchsorted(every, k)]
        on = t != c
        if on.any():
            rows.append((block, pack_keys(k[on]), narrow(t[on])))
    return frame(rows, _TOTAL)


_SCORED = "doc_id string, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double"


def _score(docs: pd.DataFrame, back: pd.DataFrame, n: int, v: int, starts: int) -> pd.DataFrame:
    if not len(docs):
        return frame([], _SCORED)
    word, context, pair, size, weight = _block(docs["packed"], docs["train"])
    k = np.concatenate([unpack_keys(x) for x in back["keys"]]) if len(back) else np.zeros(0, "uint64")
    t = np.concatenate([widen(x).view("int64") for x in back["counts"]]) if len(back) else np.zeros(0, "int64")
    order = np.argsort(k, kind="stable")
    k, t = k[order], t[order]

    def known(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        mine, c = counts(keys, weight)
        at = np.minimum(np.searchsorted(k, mine), max(0, len(k) - 1))
        return mine, np.where(k[at] == mine, t[at], c) if len(k) else c

    automaton = Automaton(known(word), known(pair), n, v, starts)
    c, root, arc = automaton.walk(word, context, pair)
    head = np.cumsum(size) - size
    return pd.DataFrame({
        "doc_id": docs["doc_id"], "held_out": ~docs["train"], "n_tokens": size, "n_known": np.add.reduceat((c > 0).astype("int64"), head), "train_tokens": n,
        "base_score": np.add.reduceat(root, head), "score": np.add.reduceat(arc, head)})


def score(docs: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every text."""
    parts, out = HELD_OUT
    d = id_text(docs).withColumn("train", fold_col(F.col("doc_id"), parts) != out)
    blocks = max(1, -(-text_bytes(docs) // block_bytes))
    n, v, texts = totals(d, blocks)
    t = d.select(F.pmod(F.xxhash64("doc_id", "text"), F.lit(blocks)).alias("block"), F.col("doc_id").cast("string").alias("doc_id"), "train",
                 deflated("text").alias("packed"))
    local = t.groupBy("block").applyInPandas(lambda g: _count(g, blocks), _LOCAL)
    total = local.groupBy("part").applyInPandas(_total, _TOTAL)
    scored = t.groupBy("block").cogroup(total.groupBy("block")).applyInPandas(lambda a, b: _score(a, b, n, v, texts), _SCORED)
    return scored.withColumn("doc_id", F.col("doc_id").cast("bigint"))
