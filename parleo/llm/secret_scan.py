"""Secret scanning with learned formats of credentials.

Base patterns (assignment, access key, hexadecimal run) are always reported.
The values they label become prefix trees, one per kind; states whose
continuations do not differ by more than a Hoeffding bound are merged, which
gives one probabilistic automaton per kind.  An automaton of ordinary words is
learned the same way.  Every other candidate of a text (a run of at least ``LEAST_RUN``
credential characters that base spans do not cover wholly; dots at its ends are
punctuation) is scored by its log-likelihood per character
under the best format against that of ordinary text, and added as kind ``format``
where it exceeds ``THRESHOLD``.

Learning reads a bounded sample: of each kind ``SAMPLE`` labelled values, those
first by hash, whole up to ``VALUE`` characters; and ``WORDS`` ordinary tokens outside base
spans, with or without digits, half of any length and half as long as candidates.
Each text offers ``DRAWN`` of both, from places that a hash picks over its whole
length, and those first by a hash are taken.  Scanning covers whole texts.

Defined results: null and empty texts have no spans; without any labelled value
only base spans are reported; repeated rows and null ids are scanned row by row;
other columns are ignored.
"""
from __future__ import annotations

import hashlib
import math
import re
from collections import defaultdict
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parleo.llm.common import give_back, id_text, lean, map_texts, shared_table

KINDS = ("assign", "access", "hex")
ADDED = "format"
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
KEYWORD = ("passw", "secret", "token", "api")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{16,}")  # runs are maximal, so shorter ones can be skipped
LEAST = {"assign": 12, "access": 18}
LEAST_RUN = 12
CANDIDATE = re.compile(rf"[A-Za-z0-9+/_.=-]{{{LEAST_RUN},}}")
SAMPLE = 1500
WORDS = 3000
ALPHA = 0.02
VALUE = 4096
DRAWN = 8
THRESHOLD = 0.6

Span = tuple[int, str, int]


def base_spans(text: str) -> list[Span]:
    """(start, kind, end) of the base patterns, in code points."""
    low = text.lower()
    out: list[Span] = []
    if any(k in low for k in KEYWORD):
        out += [(m.start(), "assign", m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= LEAST["assign"]]
    if "AKIA" in text:
        out += [(m.start(), "access", m.end()) for m in ACCESS.finditer(text) if len(m[0]) >= LEAST["access"]]
    out += [(m.start(), "hex", m.end()) for m in HEX.finditer(text)]
    return ordered(out)


def ordered(spans: list[Span]) -> list[Span]:
    rank = {k: i for i, k in enumerate((*KINDS, ADDED))}
    return sorted(spans, key=lambda s: (s[0], rank[s[1]], s[2]))


def shown(spans: list[Span]) -> str:
    return ",".join(f"{k}:{a}:{b}" for a, k, b in spans)


def symbol(ch: str) -> str:
    """Alphabet of the automata: classes of characters."""
    if "0" <= ch <= "9":
        return "0"
    if "a" <= ch <= "f":
        return "a"
    if "g" <= ch <= "z":
        return "g"
    if "A" <= ch <= "F":
        return "A"
    if "G" <= ch <= "Z":
        return "G"
    return ch if ch in "+/_.=-" else "?"


END = ""


class Automaton:
    """Probabilistic automaton: counts of arcs and ends for every state."""

    def __init__(self):
        self.count: list[dict[str, int]] = [defaultdict(int)]
        self.arc: list[dict[str, int]] = [{}]

    def add(self, word: str) -> None:
        s = 0
        for ch in map(symbol, word):
            self.count[s][ch] += 1
            if ch not in self.arc[s]:
                self.arc[s][ch] = len(self.arc)
                self.arc.append({})
                self.count.append(defaultdict(int))
            s = self.arc[s][ch]
        self.count[s][END] += 1

    def freeze(self) -> list[tuple[dict[str, float], dict[str, int]]]:
        """Smoothed log-probabilities per character and arcs."""
        out = []
        for c, a in zip(self.count, self.arc):
            n = sum(c.values()) + 1.0
            out.append(({**{ch: math.log((v + 0.1) / n) for ch, v in c.items()}, "": math.log((c.get(END, 0) + 0.1) / n)}, dict(a)))
        return out


def _differ(x: dict[str, int], y: dict[str, int]) -> bool:
    n, m = sum(x.values()), sum(y.values())
    if not n or not m:
        return False
    bound = math.sqrt(0.5 * math.log(2 / ALPHA)) * (n ** -0.5 + m ** -0.5)
    return any(abs(x.get(k, 0) / n - y.get(k, 0) / m) > bound for k in {*x, *y})


def _compatible(t: Automaton, p: int, q: int, depth: int = 4) -> bool:
    if _differ(t.count[p], t.count[q]):
        return False
    return depth == 0 or all(_compatible(t, t.arc[p][k], t.arc[q][k], depth - 1) for k in t.arc[p].keys() & t.arc[q].keys() if t.arc[p][k] != t.arc[q][k])


def _fold(t: Automaton, p: int, q: int) -> None:
    """Add the subtree of q to p."""
    stack = [(p, q)]
    while stack:
        p, q = stack.pop()
        if p == q:
            continue
        for k, n in t.count[q].items():
            t.count[p][k] += n
        for k, s in t.arc[q].items():
            if k in t.arc[p]:
                stack.append((t.arc[p][k], s))
            else:
                t.arc[p][k] = s


def infer(values: list[str]) -> list[tuple[dict[str, float], dict[str, int]]]:
    """Merge the statistically compatible states of the prefix tree of the values."""
    t = Automaton()
    for v in sorted(values):
        t.add(v)
    red = [0]
    blue = [(0, k) for k in sorted(t.arc[0])]
    while blue:
        p, k = blue.pop(0)
        q = t.arc[p][k]
        if q in red:
            continue
        for r in red:
            if _compatible(t, r, q):
                t.arc[p][k] = r
                _fold(t, r, q)
                blue += [(r, x) for x in sorted(t.arc[r]) if t.arc[r][x] not in red and (r, x) not in blue]
                break
        else:
            red.append(q)
            blue += [(q, x) for x in sorted(t.arc[q])]
    place = {s: i for i, s in enumerate(red)}
    kept = Automaton()
    kept.count = [t.count[s] for s in red]
    kept.arc = [{k: place[x] for k, x in t.arc[s].items() if x in place} for s in red]
    return kept.freeze()


_RARE = math.log(1e-3)
#: log of the letters that a class holds: the class is drawn by the automaton, the letter evenly.
_WITHIN = {"0": math.log(10), "a": math.log(6), "g": math.log(20), "A": math.log(6), "G": math.log(20), "?": math.log(60)}


def likelihood(states: list[tuple[dict[str, float], dict[str, int]]], word: str) -> float:
    """Mean log-likelihood of a character; an arc that was never seen returns to the first state."""
    s, total = 0, 0.0
    for ch in map(symbol, word):
        logp, arcs = states[s]
        total += logp.get(ch, _RARE) - _WITHIN.get(ch, 0.0)
        s = arcs.get(ch, 0)
    return total / max(1, len(word))


class Formats:
    def __init__(self, values: dict[str, list[str]], words: list[str]):
        self.kinds = {k: infer(v) for k, v in sorted(values.items()) if v}
        self.plain = infer(words) if words else None

    def score(self, candidate: str) -> float:
        """Best format against ordinary text, per character."""
        if not self.kinds:
            return float("-inf")
        best = max(likelihood(a, candidate) for a in self.kinds.values())
        return best - (likelihood(self.plain, candidate) if self.plain else _RARE)


def added_spans(text: str, base: list[Span], formats: Formats) -> list[Span]:
    """Candidates that base spans do not cover wholly and that look like a credential."""
    out = []
    for m in CANDIDATE.finditer(text):
        c = m[0].strip(".")
        if len(c) < LEAST_RUN:
            continue
        start = m.start() + m[0].index(c)
        end = start + len(c)
        at = start  # base spans are ordered: the first character that none of them covers
        for a, _, b in base:
            if a <= at < b:
                at = b
        if at < end and formats.score(c) >= THRESHOLD:
            out.append((start, ADDED, end))
    return out


_FOUND = "kind string, value string, place binary"
_TOKEN = re.compile(r"[A-Za-z0-9+/_.=-]+")
_ORDINARY = {"word": 1, "long": LEAST_RUN}


def _drawn(text: str, base: list[Span]) -> Iterator[tuple[str, str, bytes]]:
    """Ordinary tokens of a text, from places over its whole length; a text that is repeated draws the same."""
    out, end = [], 0
    for a, _, e in base:
        out.append(text[end:max(a, end)])
        end = max(e, end)
    tokens = [w for w in _TOKEN.findall(" ".join([*out, text[end:]])) if w.strip(".")]
    seed = hashlib.md5(text.encode("utf-8", "replace")).digest()
    for kind, least in _ORDINARY.items():
        fit = [w.strip(".") for w in tokens if len(w) >= least]
        for i in range(min(DRAWN, len(fit))):
            place = hashlib.md5(seed + b"%d" % i).digest()
            yield kind, fit[int.from_bytes(place[:8], "big") % len(fit)][:VALUE], place


def _labelled(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        rows = set()
        for raw in b["text"]:
            text = raw.decode("utf-8", "replace")
            base = base_spans(text)
            for a, k, e in base:
                value = (ASSIGN.match(text, a)[2] if k == "assign" else text[a:e])[:VALUE]
                rows.add((k, value, hashlib.md5(value.encode()).digest()))
            rows.update(_drawn(text, base))
        keep = defaultdict(list)
        for r in sorted(rows, key=lambda r: (r[2], r)):
            if len(keep[r[0]]) < (WORDS // 2 if r[0] in _ORDINARY else SAMPLE):
                keep[r[0]].append(r)
        yield pd.DataFrame([x for v in keep.values() for x in v], columns=["kind", "value", "place"], dtype="object")


def learn(docs: DataFrame) -> Formats:
    """Automata from a bounded sample of the values that the base patterns label."""
    found = shared_table(id_text(docs).select("text").mapInPandas(lean(_labelled), _FOUND).distinct())
    got: dict[str, list[str]] = {}
    for k in (*KINDS, *_ORDINARY):
        rows = found.where(F.col("kind") == k).orderBy("place", "value").limit(WORDS // 2 if k in _ORDINARY else SAMPLE)
        got[k] = [r["value"] for r in rows.collect()]
    words = [w for k in _ORDINARY for w in got.pop(k)]
    return Formats(got, words)


SCANNED = "doc_id bigint, n_assign bigint, n_access bigint, n_hex bigint, base_sha256 string, spans string"


def scan(docs: DataFrame, formats: Formats) -> DataFrame:
    """Spans of every document, base ones and added ones."""
    shared = docs.sparkSession.sparkContext.broadcast(formats)  # bounded by SAMPLE and VALUE

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        f = shared.value
        for b in batches:
            rows = []
            for raw in b["text"]:
                text = raw.decode("utf-8", "replace")
                base = base_spans(text)
                n = [sum(1 for s in base if s[1] == k) for k in KINDS]
                rows.append((*n, hashlib.sha256(shown(base).encode()).hexdigest(), shown(ordered(base + added_spans(text, base, f)))))
            got = pd.DataFrame(rows, columns=["n_assign", "n_access", "n_hex", "base_sha256", "spans"])
            got.insert(0, "doc_id", b["doc_id"].array)
            yield got

    return map_texts(id_text(docs), run, SCANNED)


def mask(text: str, formats: Formats, token: str = "[SECRET]") -> str:
    """Text with every span replaced; touching and overlapping spans become one."""
    base = base_spans(text)
    spans = sorted((a, b) for a, _, b in base + added_spans(text, base, formats))
    out, end = [], 0
    for a, b in spans:
        if a >= end:
            out += [text[end:a], token]
        end = max(end, b)
    return "".join(out) + text[end:]


def redact(docs: DataFrame, formats: Formats) -> DataFrame:
    """All columns of the documents, with secrets in ``text`` replaced and ``n_chars`` (if there) recounted."""
    shared = docs.sparkSession.sparkContext.broadcast(formats)

    @F.pandas_udf("string")
    def masked(text: pd.Series) -> pd.Series:
        out = text.map(lambda t: t if t is None else mask(t, shared.value))
        give_back()
        return out

    out = docs.withColumn("text", masked(docs["text"].cast("string")))
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out
