"""Language of each word, and of each text, by a linear-chain conditional random field.

Words are runs of letters, those of more than ``LONGEST`` cut into consecutive
parts.  They carry affix, character n-gram and lexicon features; transitions between
the labels of neighbouring words are learned with them.  Training reads a
bounded sample of labelled texts (``docs_per_lang`` documents of each language,
``WORDS_PER_DOC`` words of each in chains of ``CHAIN`` words, drawn by hash from the
whole text); labels of words are those
of their document.  Prediction runs forward-backward over every chain of the
whole text, so that each word of code-switched text gets its own marginals; the
document's language has the largest sum of them.

Defined results: null texts and texts without a letter are ``und`` with score 0;
without any labelled text everything is ``und``; ties go to the language that
sorts first; repeated rows and null ids are predicted row by row; other columns
are ignored.
"""
from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from parleo.llm.common import fold_col, id_text, map_texts

DOCS_PER_LANG = 300
WORDS_PER_DOC = 192
CHAIN = 64
LEXICON = 200
BITS = 16
EPOCHS = 4
HELD_OUT = (4, 2)
#: A longer run of letters (scripts without blanks) is several words.
LONGEST = 40
_LETTERS = re.compile(rf"[^\W\d_]{{1,{LONGEST}}}")
#: Words whose scores a worker keeps.
CACHE = 200_000


def words(text: str) -> list[str]:
    return _LETTERS.findall(text.lower())


def drawn(w: list[str]) -> list[str]:
    """At most ``WORDS_PER_DOC`` words in whole chains, drawn by hash from all of the text."""
    chains = [w[i:i + CHAIN] for i in range(0, len(w), CHAIN)]
    most = WORDS_PER_DOC // CHAIN
    if len(chains) <= most:
        return w
    kept = sorted(sorted(range(len(chains)), key=lambda i: (zlib.crc32(f"{i} {' '.join(chains[i])}".encode("utf-8", "replace")), i))[:most])
    return [x for i in kept for x in chains[i]]


@F.pandas_udf(T.StringType())
def _drawn_text(text: pd.Series) -> pd.Series:
    return text.map(lambda t: " ".join(drawn(words(t))))


_MIX = np.uint64(0x9E3779B97F4A7C15)
_SHIFT = np.uint64(64 - BITS)


def _hash(x: np.ndarray, salt: int) -> np.ndarray:
    x = (x ^ np.uint64(salt * 0x632BE59BD9B4E019 & (1 << 64) - 1)) * _MIX
    x = (x ^ (x >> np.uint64(29))) * _MIX
    return (x >> _SHIFT).astype("int64")


class Features:
    """Hashed affix, n-gram and lexicon features of a list of words, column by column."""

    def __init__(self, words_: list[str], lexicon: dict[str, int]):
        shown = [f"^{w}$" for w in words_]
        codes = np.frombuffer("".join(shown).encode("utf-32-le"), dtype="<u4").astype("uint64")
        size = np.array([len(w) for w in shown])
        self.starts = np.concatenate([[0], np.cumsum(size)[:-1]])
        self.owner = np.repeat(np.arange(len(shown)), size)
        last = self.starts + size
        left = last[self.owner] - np.arange(len(codes))  # characters from here to the end of the word
        padded = np.concatenate([codes, np.zeros(4, "uint64")])
        grams, x = {}, codes.copy()
        for k in (2, 3, 4):
            x = x * np.uint64(1 << 21 | 1) + padded[k - 1:k - 1 + len(codes)]
            grams[k] = x
        self.each = [(_hash(grams[k], k), left >= k) for k in (2, 3)]
        self.once = [_hash(grams[k][self.starts], 10 + k) for k in (2, 3)]
        self.once += [_hash(grams[k][np.maximum(self.starts, last - k)], 20 + k) for k in (2, 3, 4)]
        # a word outside the lexicon has no such feature
        self.lex = np.array([lexicon.get(w, 0) for w in words_], dtype="int64")
        self.scale = (1 / np.sqrt(2 * size - 3 + len(self.once) + (self.lex > 0)))[:, None].astype("float32")

    def emissions(self, weights: np.ndarray, lex: np.ndarray) -> np.ndarray:
        total = lex[self.lex].copy()
        for h in self.once:
            total += weights[h]
        for h, valid in self.each:
            total += np.add.reduceat(weights[h] * valid[:, None], self.starts)
        return total * self.scale

    def spread(self, g: np.ndarray, weights: np.ndarray, lex: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Gradients of the two tables from those of the emissions."""
        g = g * self.scale
        out, out_lex = np.zeros_like(weights), np.zeros_like(lex)
        for k in range(g.shape[1]):
            for h in self.once:
                out[:, k] += np.bincount(h, g[:, k], len(weights))
            for h, valid in self.each:
                out[:, k] += np.bincount(h[valid], g[self.owner[valid], k], len(weights))
            out_lex[:, k] += np.bincount(self.lex, g[:, k], len(lex))
        out_lex[0] = 0
        return out, out_lex


@dataclass
class Crf:
    langs: list[str]
    weights: np.ndarray  # feature x label
    lex: np.ndarray  # lexicon word x label; row 0 is no word
    moves: np.ndarray  # label x label
    lexicon: dict[str, int]
    tag: str = ""

    def emissions(self, words_: list[str]) -> np.ndarray:
        return Features(words_, self.lexicon).emissions(self.weights, self.lex)


def marginals(emissions: np.ndarray, lengths: np.ndarray, moves: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Forward-backward for chains x steps x labels; also the sum of pair marginals."""
    n, steps, k = emissions.shape
    e = np.exp(emissions - emissions.max(-1, keepdims=True))
    live = np.arange(steps)[None, :] < lengths[:, None]
    e[~live] = 1.0
    t = np.exp(moves - moves.max())
    fwd, bwd = np.empty_like(e), np.empty_like(e)
    fwd[:, 0] = e[:, 0] / e[:, 0].sum(-1, keepdims=True)
    for i in range(1, steps):
        x = (fwd[:, i - 1] @ t) * e[:, i]
        x /= x.sum(-1, keepdims=True)
        fwd[:, i] = np.where(live[:, i, None], x, fwd[:, i - 1])
    bwd[:, steps - 1] = 1.0
    for i in range(steps - 2, -1, -1):
        x = (bwd[:, i + 1] * e[:, i + 1]) @ t.T
        x /= x.sum(-1, keepdims=True)
        bwd[:, i] = np.where(live[:, i + 1, None], x, 1.0)
    post = fwd * bwd
    post /= post.sum(-1, keepdims=True)
    pairs = np.zeros((k, k))
    for i in range(1, steps):
        on = live[:, i]
        if on.any():
            p = fwd[on, i - 1][:, :, None] * t[None] * (e[on, i] * bwd[on, i])[:, None, :]
            pairs += (p / p.sum((1, 2), keepdims=True)).sum(0)
    return post, pairs


def train(rows: list[tuple[str, str]], epochs: int = EPOCHS, seed: int = 0) -> Crf | None:
    """Fit on (text, lang) pairs by AdaGrad on the likelihood of the chains."""
    rows = sorted((lang, text) for text, lang in rows if lang is not None and text)
    langs = sorted({lang for lang, _ in rows})
    if not langs:
        return None
    counts = {x: Counter() for x in langs}
    chains: list[tuple[list[str], int]] = []
    for lang, text in rows:
        w = drawn(words(text))
        counts[lang].update(w)
        chains += [(w[i:i + CHAIN], langs.index(lang)) for i in range(0, len(w), CHAIN)]
    lexicon: dict[str, int] = {}
    for lang in langs:
        for w, _ in sorted(counts[lang].items(), key=lambda x: (-x[1], x[0]))[:LEXICON]:
            lexicon.setdefault(w, len(lexicon) + 1)
    k = len(langs)
    m = Crf(langs, np.zeros((1 << BITS, k), "float32"), np.zeros((len(lexicon) + 1, k), "float32"), np.zeros((k, k)), lexicon)
    rng = np.random.default_rng(seed)
    sums = [np.full_like(x, 1e-2) for x in (m.weights, m.lex, m.moves)]
    for _ in range(epochs):
        order = rng.permutation(len(chains))
        for at in range(0, len(order), 64):
            batch = [chains[i] for i in order[at:at + 64]]
            lengths = np.array([len(c) for c, _ in batch])
            f = Features([w for c, _ in batch for w in c], lexicon)
            live = np.arange(lengths.max())[None, :] < lengths[:, None]
            em = np.zeros((*live.shape, k), "float32")
            em[live] = f.emissions(m.weights, m.lex)
            post, pairs = marginals(em, lengths, m.moves)
            y = np.array([y for _, y in batch])
            g = -post
            g[np.arange(len(batch)), :, y] += 1
            moves = -pairs
            np.add.at(moves, (y, y), lengths - 1)
            steps = [x - c * w for x, c, w in zip((*f.spread(g[live], m.weights, m.lex), moves), (1e-3, 1e-3, 1e-1), (m.weights, m.lex, m.moves))]
            for w, s, x, rate in zip((m.weights, m.lex, m.moves), sums, steps, (0.3, 0.3, 0.05)):
                s += x * x
                w += rate * x / np.sqrt(s)
    m.moves = m.moves.astype("float32")
    m.tag = f"{zlib.crc32(m.weights.tobytes())}:{zlib.crc32(m.moves.tobytes())}"
    return m


class _Known:
    """Scores of words that this worker has met; begins anew for another model or when full."""

    def __init__(self):
        self.tag, self.at, self.scores = None, {}, None

    def ids(self, m: Crf, docs: list[list[str]]) -> list[list[int]]:
        if self.tag != m.tag or len(self.at) > CACHE:
            self.tag, self.at, self.scores = m.tag, {}, np.zeros((0, len(m.langs)), "float32")
        new = [w for w in dict.fromkeys(w for d in docs for w in d) if w not in self.at]
        if new:
            self.at.update(zip(new, range(len(self.at), len(self.at) + len(new))))
            self.scores = np.concatenate([self.scores, m.emissions(new)])
        get = self.at.__getitem__
        return [list(map(get, d)) for d in docs]


_known = _Known()


def label(m: Crf, texts: list[str | None], per_word: bool = False) -> list:
    """(lang, score) of each text, or the (word, lang, marginal) rows of each."""
    docs = [words(t) if t else [] for t in texts]
    result: list = [[] if per_word else ("und", 0.0) for _ in docs]
    at = 0
    while at < len(docs):
        held, size = [], 0
        while at < len(docs) and (not held or size + len(docs[at]) < 100_000):
            held.append(at)
            size += len(docs[at])
            at += 1
        held = [d for d in held if docs[d]]
        if not held:
            continue
        ids = np.array([i for x in _known.ids(m, [docs[d] for d in held]) for i in x])
        of, lengths = [], []
        for d in held:
            n = len(docs[d])
            of += [d] * (-(-n // CHAIN))
            lengths += [CHAIN] * (n // CHAIN) + [n % CHAIN] * (n % CHAIN > 0)
        lengths, of = np.array(lengths), np.array(of)
        live = np.arange(CHAIN)[None, :] < lengths[:, None]
        em = np.zeros((*live.shape, len(m.langs)), dtype="float32")
        em[live] = _known.scores[ids]
        post = _posterior(em, lengths, m.moves)
        if per_word:
            best = post[live]
            rows = iter(zip((w for d in held for w in docs[d]), best.argmax(-1), best.max(-1)))
            for d in held:
                result[d] = [(w, m.langs[k], float(p)) for (w, k, p), _ in zip(rows, docs[d])]
            continue
        post[~live] = 0
        total = np.zeros((len(docs), len(m.langs)))
        np.add.at(total, of, post.sum(1))
        for d in held:
            k = int(total[d].argmax())
            result[d] = (m.langs[k], float(min(1.0, total[d, k] / len(docs[d]))))
    return result


def _posterior(em: np.ndarray, lengths: np.ndarray, moves: np.ndarray) -> np.ndarray:
    """Marginals of the words only; chains run longest first so that each step touches live ones alone."""
    order = np.argsort(-lengths, kind="stable")
    e = np.exp(em[order] - em[order].max(-1, keepdims=True))
    lengths = lengths[order]
    t = np.exp(moves - moves.max()).astype(e.dtype)
    fwd, bwd = np.ones_like(e), np.ones_like(e)
    fwd[:, 0] = e[:, 0] / e[:, 0].sum(-1, keepdims=True)
    live = [int((lengths > i).sum()) for i in range(e.shape[1])]
    for i in range(1, e.shape[1]):
        n = live[i]
        x = (fwd[:n, i - 1] @ t) * e[:n, i]
        fwd[:n, i] = x / x.sum(-1, keepdims=True)
    for i in range(e.shape[1] - 2, -1, -1):
        n = live[i + 1]
        x = (bwd[:n, i + 1] * e[:n, i + 1]) @ t.T
        bwd[:n, i] = x / x.sum(-1, keepdims=True)
    post = np.empty_like(e)
    p = fwd * bwd
    post[order] = p / p.sum(-1, keepdims=True)
    return post


def sample(docs: DataFrame, docs_per_lang: int = DOCS_PER_LANG) -> list[tuple[str, str]]:
    """Bounded training sample: the documents of each language that come first by a hash of their id, and of each at most
    ``WORDS_PER_DOC`` words drawn from its whole text where it lies."""
    parts, out = HELD_OUT
    d = docs.select(docs["doc_id"].cast("bigint").alias("doc_id"), docs["lang"].cast("string").alias("lang"), docs["text"].cast("string").alias("text"))
    d = d.where(d.lang.isNotNull() & d.doc_id.isNotNull() & (fold_col(d.doc_id, parts) != out))
    order = F.row_number().over(Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id"))
    ids = [r[0] for r in d.select("doc_id", "lang").withColumn("r", order).where(F.col("r") <= docs_per_lang).select("doc_id").distinct().collect()]
    rows = d.where(d.doc_id.isin(ids)).where(d.text.isNotNull()).select(_drawn_text(d.text).alias("text"), "lang").collect() if ids else []
    return sorted((r["text"], r["lang"]) for r in rows)


PREDICTED = "doc_id bigint, held_out boolean, lang_pred string, score double"


def predict(docs: DataFrame, model: Crf | None) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every document."""
    parts, out = HELD_OUT
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(model)  # features x languages: bounded by BITS and the labels

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m = shared.value
        for b in batches:
            texts = [t.decode("utf-8", "replace") for t in b["text"]]
            got = label(m, texts) if m else [("und", 0.0)] * len(b)
            yield pd.DataFrame({"doc_id": b["doc_id"], "held_out": b["held_out"], "lang_pred": [x for x, _ in got], "score": [float(s) for _, s in got]})

    rows = id_text(docs).withColumn("held_out", fold_col(F.col("doc_id"), parts) == out)
    return map_texts(rows, run, PREDICTED)


def identify(docs: DataFrame) -> DataFrame:
    """Learn from the labelled documents and predict all."""
    return predict(docs, train(sample(docs)))
