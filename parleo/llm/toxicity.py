"""Toxicity by subsequence string-kernel machines with Nystroem landmarks.

Two strings are similar if they share subsequences of four or three characters, each
weighted by ``DECAY`` to the power of the span it covers (at most ``SPAN``), so
an insult keeps most of its kernel value when characters are inserted or left
out.  Subsequences are hashed, so characters of any script count.  One machine
sees words between marks of their ends (short insults), the other windows
of the running text without anything between the letters (insults that are spelled out,
cut into parts or made of ordinary words).  The kernel matrix of landmarks gives
the Nystroem map, on which a linear support vector machine is trained.  Documents marked
toxic are labelled by their witness, the unit that the machine scores highest;
the rest of them says nothing.  Since the kernel is a dot product of subsequence
weights, landmarks and machine fold into one table of subsequences, and a unit
is scored by adding up its entries.

Training reads a bounded sample (``TRAIN_DOCS`` documents of each label, those
first by a hash of their id, outside the held-out fold) in one task; every text is scored
whole: its score is that of its highest word and window, by a logistic fit on a
quarter of the sample that the machines have not seen.

Defined results: null and empty texts score as a text without any insult;
without both labels in the training rows every score is the share of toxic
labels, limited to 0.49 where there is none; repeated rows and null ids are scored row by row; labels
that name no document are ignored; other columns are ignored.
"""
from __future__ import annotations

import itertools
import pickle
import re
import zlib
from collections import Counter
from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from parleo.llm.common import fold_col, give_back, id_text, lean, map_texts

ORDER = 4
SHORT = 0.5
DECAY = 0.75
SPAN = 7
BITS = 20
LANDMARKS = 160
#: A window: the subsequences that begin within so many characters of running text.
WINDOW = 16
WINDOW_LANDMARKS = 96
#: Half the characters of a passage, by which the first windows of toxic texts are found.
HALF = 3
TRAIN_DOCS = 1500
HELD_OUT = (5, 0)
PENALTY = 4.0
ROUNDS = 4
#: Units that a worker keeps with their scores.
CACHE = 200_000
UNIT = 48

_SPACED = re.compile(r"\b(?:\w[ .*_-]){2,}\w\b")
_INSERTED = re.compile(r"[^\w\s]+")
_BREAK = re.compile(r"[\W_]+")
#: (positions after the first, weight) of every subsequence shape; those of three characters serve short words.
SHAPES = [((a, a + b, a + b + c), DECAY ** (a + b + c + 1)) for a, b, c in itertools.product(range(1, SPAN), repeat=3) if a + b + c < SPAN]
SHAPES += [((a, a + b), SHORT * DECAY ** (a + b + 1)) for a, b in itertools.product(range(1, SPAN), repeat=2) if a + b < SPAN]
_MIX = [np.uint32(x) for x in (0x9E3779B1, 0x85EBCA6B, 0xC2B2AE35, 0x27D4EB2F)]


def units(text: str) -> list[str]:
    """Words of a text, lower-cased, without characters inserted between letters; spelled-out words are joined."""
    t = _SPACED.sub(lambda m: re.sub(r"[ .*_-]", "", m[0]), text.lower())
    return _INSERTED.sub("", t).split()


def pieces(unit: str) -> list[str]:
    """A unit between marks of its ends; very long ones in overlapping pieces, so that nothing inside is missed."""
    unit = f"\2{unit}\3"
    return [unit] if len(unit) <= UNIT else [unit[i:i + UNIT] for i in range(0, len(unit) - SPAN, UNIT - SPAN)]


def running(text: str) -> str:
    """Letters and digits of a text without anything between them."""
    return _BREAK.sub("", text.lower())


def codes(strings: list[str], gap: int = SPAN) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash of every character of all strings with gaps between them, characters left to the end of the string (0 in gaps), and where each begins."""
    flat = np.frombuffer(("\0" * gap).join(strings).encode("utf-32-le", "replace") + b"\0\0\0\0" * (gap + SPAN), dtype="<u4")
    size = np.array([len(s) for s in strings], dtype="int64")
    starts = np.concatenate([[0], np.cumsum(size + gap)[:-1]]) if strings else np.zeros(0, "int64")
    left = np.zeros(len(flat), "int32")
    own = np.repeat(np.arange(len(size)), size)
    k = np.arange(len(own))
    left[k + gap * own] = np.cumsum(size)[own] - k
    c = (flat + np.uint32(1)) * _MIX[0]
    return c ^ (c >> np.uint32(15)), left, starts


def subsequences(c: np.ndarray, left: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, float]]:
    """Per shape and start position: number of the subsequence (hashed), whether it ends inside the string, weight."""
    n = len(c) - SPAN
    mixed = [c * m for m in _MIX]
    for far, weight in SHAPES:
        x = mixed[0][:n] + np.uint32(len(far) * 0x61C88647 & 0xFFFFFFFF)
        for k, i in enumerate(far):
            x += mixed[k + 1][i:n + i]
        yield x >> np.uint32(32 - BITS), left[:n] > far[-1], weight


def totals(c: np.ndarray, left: np.ndarray, table: np.ndarray, block: int = 1 << 15) -> np.ndarray:
    """Weight of the subsequences that begin at each position."""
    out = np.zeros(len(c), "float32")
    for i in range(0, len(c) - SPAN, block):
        j = min(len(c), i + block + SPAN)
        part = out[i:j - SPAN]
        for s, on, w in subsequences(c[i:j], left[i:j]):
            part += np.float32(w) * (table.take(s) * on)
    return out


def profile(strings: list[str], starting: int | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(string, subsequence, weight) entries of the kernel's feature map, of the first ``starting`` positions only where given."""
    c, left, starts = codes(strings)
    row = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(c))))
    near = np.arange(len(c)) - starts[row] < (starting or len(c))
    parts = []
    for s, on, w in subsequences(c, left):
        at = np.flatnonzero(on & near[:len(on)])
        parts.append((row[at] << BITS | s[at], np.full(len(at), w)))
    key, inverse = np.unique(np.concatenate([k for k, _ in parts]), return_inverse=True)
    return key >> BITS, key & (1 << BITS) - 1, np.bincount(inverse, np.concatenate([w for _, w in parts]), len(key))


def kernel(a: str, b: str) -> float:
    """Value of the string kernel, not normalised."""
    x, y = ({s: w for s, w in zip(*profile([t])[1:])} for t in (a, b))
    return float(sum(w * y[s] for s, w in x.items() if s in y))


def _widest(total: np.ndarray, left: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Highest window of each string and its position; gaps are as wide as a window."""
    upto = np.concatenate([[0.0], np.cumsum(total, dtype="float64")])
    n = len(total) - WINDOW
    w = np.where(left[:n] > 0, upto[WINDOW:WINDOW + n] - upto[:n], -np.inf)
    top = np.maximum.reduceat(w, starts)
    ends = np.append(starts[1:], n)
    return np.where(np.isinf(top), 0.0, top), np.array([a + int(w[a:b].argmax()) for a, b in zip(starts, ends)]) - starts


@dataclass
class Machine:
    table: np.ndarray | None  # weight of every subsequence of words
    bias: float
    wide: np.ndarray | None = None  # and of windows
    wide_bias: float = 0.0
    fits: Sequence[tuple[float, float, float]] = ((1.0, 0.0, 0.0),)  # slope of words, slope of windows, shift
    tag: str = ""
    constant: float = 0.0

    def margins(self, strings: list[str]) -> np.ndarray:
        if not strings:
            return np.zeros(0)
        c, left, starts = codes(strings)
        return np.add.reduceat(totals(c, left, self.table), starts).astype("float64") + self.bias

    def windows(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Margin and place of the highest window of each running text."""
        c, left, starts = codes(texts, WINDOW)
        top, at = _widest(totals(c, left, self.wide), left, starts)
        return top + self.wide_bias, at

    def probability(self, word: np.ndarray, window: np.ndarray) -> np.ndarray:
        top = np.max([a * word + b * window + c for a, b, c in self.fits], axis=0)
        return 1 / (1 + np.exp(-np.clip(top, -40, 40)))


def _svm(z: np.ndarray, y: np.ndarray, cost: np.ndarray) -> tuple[np.ndarray, float]:
    """Squared-hinge support vector machine in the primal, by Newton steps."""
    z = np.hstack([z, np.ones((len(z), 1))])
    w = np.zeros(z.shape[1])
    ridge = np.eye(len(w))
    ridge[-1, -1] = 1e-3
    for _ in range(25):
        on = y * (z @ w) < 1
        zs = z[on] * cost[on, None]
        new = np.linalg.solve(ridge + zs.T @ z[on], zs.T @ y[on])
        if np.allclose(new, w, atol=1e-6):
            break
        w = 0.5 * (w + new) if _ > 12 else new
    return w[:-1], float(w[-1])


def _landmarks(marks: list[str], starting: int | None = None):
    """Nystroem map of the landmarks: function from strings to coordinates, and from weights of coordinates to a table."""
    row, sub, val = profile(marks, starting)
    used, column = np.unique(sub, return_inverse=True)
    base = np.zeros((len(marks), len(used)), "float32")
    base[row, column] = val
    base /= np.maximum(1e-9, np.sqrt((base ** 2).sum(1)))[:, None]
    values, vectors = np.linalg.eigh((base @ base.T).astype("float64"))
    keep = values > 1e-5
    whiten = (vectors[:, keep] / np.sqrt(values[keep])).T
    nystroem = np.empty((len(whiten), len(used)), "float32")  # landmark coordinates of a profile
    for i in range(0, len(used), 4096):  # in doubles, a part at a time
        nystroem[:, i:i + 4096] = whiten @ base[:, i:i + 4096]
    place = np.full(1 << BITS, -1, dtype="int32")
    place[used] = np.arange(len(used))

    def mapped(strings: list[str]) -> np.ndarray:
        out = np.zeros((len(strings), nystroem.shape[0]))
        step = max(20, 8_000_000 // max(1, len(used)))
        for i in range(0, len(strings), step):
            part = strings[i:i + step]
            r, s, v = profile(part, starting)
            on = place[s] >= 0
            x = np.zeros((len(part), len(used)), dtype="float32")
            x[r[on], place[s[on]]] = v[on]
            out[i:i + step] = x @ nystroem.T
            del x  # before the next one is made
        return out

    def table(w: np.ndarray) -> np.ndarray:
        out = np.zeros(1 << BITS, dtype="float32")
        out[used] = w @ nystroem
        return out
    return mapped, table


def _worth(count: list[Counter], rows: list[tuple[str, int]]) -> dict:
    """How much a unit speaks for the toxic label."""
    total = [max(1, sum(1 for _, b in rows if b == k)) for k in (0, 1)]
    return {w: n ** 0.5 * np.log((n + 0.2) / (count[0][w] + 0.2) * total[0] / total[1]) for w, n in count[1].items()}


def _split(fit, chosen: Counter, others: list[str], mapped) -> tuple[np.ndarray, float]:
    strings = [*chosen, *others]
    labels = np.array([1.0] * len(chosen) + [-1.0] * len(others))
    even = max(1.0, 0.1 * len(others) / max(1, sum(chosen.values())))  # few insults against many other units
    cost = np.array([PENALTY * even * n for n in chosen.values()] + [PENALTY] * len(others))
    return fit(mapped(strings), labels, cost)


def _train_words(m: Machine, rows: list[tuple[str, int]], rng: np.random.Generator) -> None:
    docs = _pieces_of_all(t for t, _ in rows)
    count = [Counter(), Counter()]
    for d, (_, b) in zip(docs, rows):
        count[b].update(d)
    worth = _worth(count, rows)
    plain = sorted(count[0])
    near = sorted(worth, key=lambda w: (-worth[w], w))[:LANDMARKS // 2]
    common = sorted(plain, key=lambda w: (-count[0][w], w))[:LANDMARKS // 4]
    rest = [plain[i] for i in rng.permutation(len(plain))[:LANDMARKS]]
    marks = list(dict.fromkeys([*near, *common, *rest]))[:LANDMARKS]
    if not marks:
        m.table = np.zeros(1 << BITS, "float32")
        return
    mapped, table = _landmarks(marks)
    positive = [d for d, (_, b) in zip(docs, rows) if b and d]
    witness = [max(d, key=lambda w: (worth[w], w)) for d in positive]
    hard = [plain[i] for i in rng.permutation(len(plain))[:12_000]]
    for turn in range(ROUNDS):
        chosen = Counter(w for w in witness if turn < 2 or worth[w] > 0)
        w, m.bias = _split(_svm, chosen, list(dict.fromkeys([*common, *hard])), mapped)
        m.table = table(w)
        worst = np.argsort(-_margins(m, plain), kind="stable")[:6000]
        hard = [*(plain[i] for i in worst), *(plain[i] for i in rng.permutation(len(plain))[:6000])]
        margin = dict(zip(count[1], _margins(m, list(count[1])).tolist()))
        witness = [max(d, key=margin.__getitem__) for d in positive]


def _halves(text: str) -> np.ndarray:
    """Number of every ``HALF`` characters of a text, which counts as one of at least a passage."""
    c = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4").astype("int64") + 1
    c = np.pad(c, (0, max(0, 2 * HALF - len(c))))
    out = c[:len(c) - HALF + 1].copy()
    for k in range(1, HALF):
        out = out << 21 | c[k:len(c) - HALF + 1 + k]
    return out


def _telling(positive: list[str], negative: list[str], total: list[int]) -> list[int]:
    """Where in each positive text the passage of ``2 * HALF`` characters begins that speaks most for the label.

    Passages are numbers, exact ones: pairs of the halves that occur in positive texts.
    """
    known = np.unique(np.concatenate([np.unique(_halves(t)) for t in positive]))

    def passages(t: str) -> np.ndarray:
        h = _halves(t)
        at = np.minimum(np.searchsorted(known, h), len(known) - 1)
        at[known[at] != h] = -1
        a, b = at[:-HALF], at[HALF:]
        return np.where((a < 0) | (b < 0), -1, a * len(known) + b)

    held, count = np.unique(np.concatenate([np.unique(passages(t)) for t in positive]), return_counts=True)
    plain = np.zeros(len(held), "int64")
    for t in negative:
        x = np.unique(passages(t))
        at = np.minimum(np.searchsorted(held, x), len(held) - 1)
        plain[at[held[at] == x]] += 1
    worth = np.sqrt(count) * np.log((count + 0.2) / (plain + 0.2) * max(1, total[0]) / max(1, total[1]))
    return [int(worth[np.searchsorted(held, passages(t))].argmax()) for t in positive]


def _train_windows(m: Machine, rows: list[tuple[str, int]], rng: np.random.Generator) -> None:
    texts = [running(t) for t, _ in rows]
    size = WINDOW + SPAN - 1

    def cut(t: str, at: int) -> str:
        return t[at:at + size]
    positive = [t for t, (_, b) in zip(texts, rows) if b and t]
    negative = [t for t, (_, b) in zip(texts, rows) if not b and t]
    m.wide = np.zeros(1 << BITS, "float32")
    if not positive or not negative:
        return
    best = _telling(positive, negative, [sum(1 for _, b in rows if b == k) for k in (0, 1)])
    witness = [cut(t, max(0, i - (WINDOW - 2 * HALF) // 2)) for t, i in zip(positive, best)]  # the window around the passage
    places = [(negative[i], int(rng.integers(0, max(1, len(negative[i]) - WINDOW)))) for i in rng.integers(0, len(negative), 6000)]
    plain = list(dict.fromkeys(cut(t, i) for t, i in places))
    near = [w for w, _ in Counter(witness).most_common(WINDOW_LANDMARKS // 2)]
    mapped, table = _landmarks(list(dict.fromkeys([*near, *plain[:WINDOW_LANDMARKS - len(near)]])), WINDOW)
    hard: list[str] = []
    for _ in range(3):
        w, m.wide_bias = _split(_svm, Counter(witness), list(dict.fromkeys([*plain[:4000], *hard])), mapped)
        m.wide = table(w)
        hard += [cut(t, i) for t, i in zip(negative, _batched(m, negative)[1])]
        witness = [cut(t, i) for t, i in zip(positive, _batched(m, positive)[1])]


def _pieces_of_all(texts: Iterable[str]) -> list[list[str]]:
    """Distinct pieces of each text, in order; texts share the strings."""
    one: dict[str, str] = {}
    return [sorted({one.setdefault(p, p) for u in units(t) for p in pieces(u)}) for t in texts]


def _margins(m: Machine, strings: list[str]) -> np.ndarray:
    """``margins`` of many strings, a bounded number at a time."""
    return np.concatenate([np.zeros(0), *(m.margins(strings[i:i + 20_000]) for i in range(0, len(strings), 20_000))])


def _batched(m: Machine, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """``windows`` of many texts, a bounded number of characters at a time."""
    got, at = [], 0
    while at < len(texts):
        held, size = [], 0
        while at < len(texts) and (not held or size < 1 << 20):
            held.append(texts[at])
            size += len(texts[at])
            at += 1
        got.append(m.windows(held))
    return np.concatenate([g[0] for g in got]), np.concatenate([g[1] for g in got])


def _logistic(x: np.ndarray, y: np.ndarray, use: list[int]) -> tuple[float, float, float]:
    """(slope of words, slope of windows, shift) of the label on some of the margins; none speaks against the label."""
    scale = np.maximum(1e-6, x.std(1))
    z = np.vstack([x[use] / scale[use, None], np.ones(len(y))])
    w = np.zeros(len(z))
    ridge = np.array([*[1e-1] * len(use), 1e-6])
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(w @ z, -30, 30)))
        step = np.linalg.solve((z * (p * (1 - p) + 1e-6)) @ z.T + np.diag(ridge), z @ (p - y) + ridge * w)
        w -= np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-7:
            break
    if len(use) > 1 and min(w[:-1]) < 0:
        return _logistic(x, y, [use[int(w[:-1].argmax())]])
    slopes = [0.0, 0.0]
    for k, v in zip(use, w):
        slopes[k] = max(float(v / scale[k]), 0.0)
    return slopes[0], slopes[1], float(w[-1])


def train(rows: list[tuple[str, int]], seed: int = 0) -> Machine:
    """Fit on (text, label) pairs."""
    rows = sorted((t or "", int(y)) for t, y in rows if y is not None)
    y = np.array([b for _, b in rows], dtype=float)
    if not len(y) or y.min() == y.max():
        return Machine(None, 0.0, tag="none", constant=float(min(0.49, y.mean()) if len(y) and y.max() == 0 else y.mean() if len(y) else 0.0))
    apart = [zlib.crc32(t.encode("utf-8", "replace")) % 4 == 0 for t, _ in rows]  # one in four fits the logistic only
    fitted, judged = ([r for r, x in zip(rows, apart) if x == k] for k in (False, True))
    if min(Counter(b for _, b in part).get(k, 0) for part in (fitted, judged) for k in (0, 1)) < 5:
        fitted = judged = rows
    rng = np.random.default_rng(seed)
    m = Machine(None, 0.0)
    _train_words(m, fitted, rng)
    _train_windows(m, fitted, rng)
    y = np.array([b for _, b in judged], dtype=float)
    docs = _pieces_of_all(t for t, _ in judged)
    known = {u: i for i, u in enumerate(sorted({u for d in docs for u in d}))}
    margin = _margins(m, list(known))
    x = np.array([[max((margin[known[u]] for u in d), default=m.bias) for d in docs], _batched(m, [running(t) for t, _ in judged])[0]])
    word, window, both = (_logistic(x, y, use) for use in ([0], [1], [0, 1]))
    # either margin can be reason enough, unless that errs more often than both together
    errors = [((Machine(None, 0.0, fits=f).probability(*x) >= 0.5) != y).sum() for f in ([word, window], [both])]
    m.fits = [word, window] if errors[0] <= errors[1] else [both]
    m.tag = f"{zlib.crc32(m.table.tobytes())}:{m.bias}"
    return m


class _Known:
    """Margins of units that this worker has met."""

    def __init__(self):
        self.tag, self.margin = None, {}

    def top(self, m: Machine, texts: list[str]) -> list[float]:
        if self.tag != m.tag or len(self.margin) > CACHE:
            self.tag, self.margin = m.tag, {}
        docs = [set(units(t)) for t in texts]
        new = list({u for d in docs for u in d}.difference(self.margin))
        if new:
            parts = [pieces(u) for u in new]
            flat = m.margins([p for x in parts for p in x])
            first = np.cumsum([0, *(len(x) for x in parts[:-1])])
            self.margin.update(zip(new, np.maximum.reduceat(flat, first).tolist()))
        get = self.margin.__getitem__
        return [max(map(get, d), default=m.bias) for d in docs]


_known = _Known()


def scores(m: Machine, texts: list[str]) -> np.ndarray:
    if m.table is None:
        return np.full(len(texts), m.constant)
    top: list[float] = []
    at = 0
    wide: list[np.ndarray] = []
    while at < len(texts):
        size, held = 0, []
        while at < len(texts) and (not held or size < 1 << 20):
            held.append(texts[at])
            size += len(texts[at])
            at += 1
        top += _known.top(m, held)
        wide.append(m.windows([running(t) for t in held])[0] if any(b > 0 for _, b, _ in m.fits) else np.zeros(len(held)))
    return m.probability(np.array(top), np.concatenate([*wide, np.zeros(0)]))


def sample(docs: DataFrame, labels: DataFrame, docs_per_label: int = TRAIN_DOCS) -> DataFrame:
    """(text, toxic): bounded training sample outside the held-out fold; a document marked both ways is toxic."""
    parts, out = HELD_OUT
    marked = labels.select(labels["doc_id"].cast("bigint").alias("doc_id"), labels["toxic"].cast("int").alias("toxic"))
    marked = marked.where(marked.doc_id.isNotNull() & (fold_col(marked.doc_id, parts) != out))
    of = [marked.where(F.col("toxic") == k).orderBy(F.xxhash64("doc_id"), "doc_id").limit(docs_per_label) for k in (0, 1)]
    chosen = of[0].unionByName(of[1]).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    d = docs.select(docs["doc_id"].cast("bigint").alias("doc_id"), docs["text"].cast("string").alias("text"))
    return d.where(d.text.isNotNull()).join(F.broadcast(chosen), "doc_id").select("text", "toxic")  # two numbers for each of so many documents


def _fit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    m = train([r for b in batches for r in zip(b["text"], b["toxic"])])
    yield pd.DataFrame({"machine": [zlib.compress(pickle.dumps(m), 1)]})


def trained(docs: DataFrame, labels: DataFrame) -> Machine:
    """Fit on the sample in one task: its texts and the working memory stay off the driver, which gets the machine."""
    got = sample(docs, labels).repartition(1).mapInPandas(lean(_fit), "machine binary").collect()
    return pickle.loads(zlib.decompress(got[0]["machine"])) if got else train([])


SCORED = "doc_id bigint, held_out boolean, score double, predicted int"


def score(docs: DataFrame, machine: Machine) -> DataFrame:
    """doc_id, held_out, score, predicted of every document."""
    parts, out = HELD_OUT
    shared = docs.sparkSession.sparkContext.broadcast(machine)  # 2 << BITS weights, whatever the data

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m = shared.value
        for b in batches:
            p = scores(m, [t.decode("utf-8", "replace") for t in b["text"]])
            yield pd.DataFrame({"doc_id": b["doc_id"], "held_out": b["held_out"], "score": p, "predicted": (p >= 0.5).astype("int32")})

    return map_texts(id_text(docs).withColumn("held_out", fold_col(F.col("doc_id"), parts) == out), run, SCORED)


def clean(docs: DataFrame, machine: Machine) -> DataFrame:
    """Rows, with all their columns, that are not predicted toxic."""
    shared = docs.sparkSession.sparkContext.broadcast(machine)

    @F.pandas_udf(T.DoubleType())
    def probability(text: pd.Series) -> pd.Series:
        out = pd.Series(scores(shared.value, [t or "" for t in text]), dtype="float64")
        give_back()
        return out

    return docs.where(probability(docs["text"].cast("string")) < 0.5)


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Learn from the labelled documents outside the held-out fold and score all."""
    return score(docs, trained(docs, labels))
