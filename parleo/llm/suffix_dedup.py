"""Repeated passages by a depth-limited radix sort of suffixes.

Suffixes are ordered only through their first ``DEPTH`` bytes; those that are
equal so far are the repeated windows.  The passes go from the most to the least significant
digit, and groups of one leave after each pass:

1. A window's leading digit is its anchor: the ``GRAM``-byte piece inside it with
   the smallest hash.  Neighbouring windows share their anchor, so a whole run of
   suffixes moves as one row, and equal windows always share the digit and the place of it.
2. The next digit is all the bytes that the windows of a run cover.  Equal digits:
   every window of the run is repeated.  No other run with the anchor: none is.
3. Runs whose anchor is repeated in other surroundings are split into blocks of
   16, then 4, then single windows.  The digit of a block is the bytes that all its
   windows share, the next one the bytes that any of them covers: the same three cases
   as before, and only the third goes on.  One run of each kind stands for its copies.

Digits are 64-bit fingerprints by two independent polynomials; a window is
called repeated only if anchor, place and bytes agree.  Every pass is a counted
aggregation and a join by digit; no group is collected.  Texts are shuffled
twice, compressed.

Defined results: null and texts under ``DEPTH`` bytes lose nothing; repeated
rows are documents of their own, so their windows are repeated; null ids stay
null; an empty table gives no rows; other columns are ignored.
"""
from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parleo.llm.common import deflated, frame, id_text, shared_table
from parleo.llm.minhash import mixed

DEPTH = 200
GRAM = 56
BLOCKS = (16, 4, 1)
#: Bytes hashed at a time; a longer text goes alone.
BUFFER = 1 << 20
_rng = np.random.default_rng(20240301)
_BYTE = _rng.integers(0, 1 << 63, (2, 256), dtype="uint64") * np.uint64(2) + _rng.integers(0, 2, (2, 256), dtype="uint64")
_BASE = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)
_U = np.uint64


class _Powers:
    """Powers of both bases and of their inverses modulo 2**64."""

    def __init__(self):
        self.up = self.down = np.ones((2, 1), "uint64")

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if self.up.shape[1] < n:
            n = max(n, 2 * self.up.shape[1])
            both = []
            for bases in (_BASE, tuple(pow(b, -1, 1 << 64) for b in _BASE)):
                rows = []
                for b in bases:
                    x = np.full(n, b, dtype="uint64")
                    x[0] = 1
                    rows.append(np.multiply.accumulate(x))
                both.append(np.array(rows))
            self.up, self.down = both
        return self.up, self.down


_powers = _Powers()


def _sliding(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every ``width`` neighbours."""
    out, k = x, 1
    while 2 * k <= width:
        out = np.minimum(out[:-k], out[k:])
        k *= 2
    rest = width - k
    return np.minimum(out[:len(out) - rest], out[rest:]) if rest else out


class Buffer:
    """Prefix hashes of some texts laid end to end."""

    def __init__(self, texts: list[bytes]):
        self.size = np.array([len(t) for t in texts])
        self.first = np.cumsum(self.size) - self.size
        self.bytes = np.frombuffer(b"".join(texts), dtype="uint8")
        n = len(self.bytes)
        up, self.down = _powers.get(n + 1)
        self.sums = np.zeros((2, n + 1), "uint64")
        for k in (0, 1):
            np.cumsum(_BYTE[k][self.bytes] * up[k, :n], out=self.sums[k, 1:])

    def hashes(self, k: int, at: np.ndarray, length) -> np.ndarray:
        return mixed((self.sums[k, at + length] - self.sums[k, at]) * self.down[k, at])


def runs(buf: Buffer) -> dict[str, np.ndarray]:
    """Runs of windows that share an anchor: text, start, windows, place of the anchor, both digits."""
    n = len(buf.bytes)
    empty = {k: np.zeros(0, "int64") for k in ("text", "start", "windows", "place", "digit", "next")}
    if n < DEPTH:
        return empty
    at = np.arange(n - GRAM + 1)
    digit = buf.hashes(0, at, GRAM)
    bits = max(1, int(n).bit_length())
    key = (digit & ~_U((1 << bits) - 1)) | at.astype("uint64")  # equal grams: the first one
    anchor = (_sliding(key, DEPTH - GRAM + 1) & _U((1 << bits) - 1)).astype("int64")
    of = np.repeat(np.arange(len(buf.size)), buf.size)[:n - DEPTH + 1]
    start = np.flatnonzero(np.arange(n - DEPTH + 1) + DEPTH <= (buf.first + buf.size)[of])
    if not len(start):
        return empty
    a, t = anchor[start], of[start]
    new = np.concatenate([[True], (a[1:] != a[:-1]) | (t[1:] != t[:-1])])
    head = np.flatnonzero(new)
    count = np.diff(np.concatenate([head, [len(start)]]))
    s, a, t = start[head], a[head], t[head]
    place = a - s
    whole = mixed(buf.hashes(1, s, count + DEPTH - 1) + (place * 256 + count).astype("uint64"))
    return {"text": t, "start": s - buf.first[t], "windows": count, "place": place, "digit": digit[a].view("int64"), "next": whole.view("int64")}


def _groups(texts: list[bytes]) -> Iterator[tuple[int, int]]:
    at = 0
    while at < len(texts):
        first, size = at, 0
        while at < len(texts) and (at == first or size + len(texts[at]) <= BUFFER):
            size += len(texts[at])
            at += 1
        yield first, at


_RUN = "doc_key bigint, start int, windows short, place short, digit bigint, next bigint"


def _runs(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        texts, keys = list(b["text"]), b["doc_key"].to_numpy()
        for i, j in _groups(texts):
            r = runs(Buffer(texts[i:j]))
            yield pd.DataFrame({"doc_key": keys[i:j][r["text"]] if len(r["text"]) else np.zeros(0, "int64"), "start": r["start"].astype("int32"),
                                "windows": r["windows"].astype("int16"), "place": r["place"].astype("int16"), "digit": r["digit"], "next": r["next"]})


_KIND = "kind bigint, digit bigint, place short, windows short, bytes binary"


def _kinds(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The bytes that a run covers, cut from its text."""
    for b in batches:
        rows, size = [], 0
        for z, found in zip(b["packed"], b["runs"]):
            text = zlib.decompress(z)
            for r in found:
                rows.append((r["kind"], r["digit"], r["place"], r["windows"], text[r["start"]:r["start"] + r["windows"] - 1 + DEPTH]))
            size += len(found)
            if size > 20_000:
                yield frame(rows, _KIND)
                rows, size = [], 0
        yield frame(rows, _KIND)


_BLOCK = "kind bigint, first short, count short, core bigint, whole bigint"


def blocks(rows: list[tuple], width: int) -> dict[str, np.ndarray]:
    """Blocks of ``width`` windows of runs (kind, digit, place, first, count, bytes): core and whole digit.

    Blocks are aligned by the place of the anchor, so equal windows meet in equal blocks; ``first`` counts from the start of the run.
    """
    buf = Buffer([r[5] for r in rows])
    kind, digit, place, first, count = (np.array([r[i] for r in rows], dtype="int64") for i in range(5))
    run = np.repeat(np.arange(len(rows)), count)
    k = first[run] + np.arange(len(run)) - np.repeat(np.cumsum(count) - count, count)
    off = place[run] - k  # bytes between the window's start and the anchor
    block = off // width
    head = np.flatnonzero(np.concatenate([[True], (run[1:] != run[:-1]) | (block[1:] != block[:-1])]))
    n = np.diff(np.concatenate([head, [len(run)]]))
    r, k, off, block = run[head], k[head], off[head], block[head]
    at = buf.first[r] + k
    near, far = block * width, block * width + width - 1  # offsets of the block's last and first window
    anchor = buf.first[r] + place[r]
    core_at, core_end = anchor - near, anchor - far + DEPTH
    salt = mixed(digit[r].view("uint64") + _U(width)) + (block * 256).astype("uint64")
    core = mixed(buf.hashes(1, core_at, core_end - core_at) + salt)
    whole = mixed(buf.hashes(1, at, n - 1 + DEPTH) + salt + (off * 70_000 + n).astype("uint64"))
    return {"kind": kind[r], "first": k, "count": n, "core": core.view("int64"), "whole": whole.view("int64")}


def _split(width: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = list(zip(b["kind"], b["digit"], b["place"], b["first"], b["count"], b["bytes"]))
            for i in range(0, len(rows), 4000):
                x = blocks(rows[i:i + 4000], width)
                yield pd.DataFrame({"kind": x["kind"], "first": x["first"].astype("int16"), "count": x["count"].astype("int16"), "core": x["core"], "whole": x["whole"]})
    return run


def cut(text: bytes, spans: list[tuple[int, int]]) -> tuple[bytes, int, int]:
    """Remaining bytes, removed bytes and maximal removed runs."""
    kept, at, removed, n = [], 0, 0, 0
    for a, b in merged(spans):
        kept.append(text[at:a])
        removed += b - a
        n += 1
        at = b
    return b"".join(kept) + text[at:], removed, n


def merged(spans) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


_CUT = "doc_id string, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string, kept binary"


def _cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        out = []
        for doc_id, packed, spans in zip(b["doc_id"], b["packed"], b["spans"]):
            text = zlib.decompress(packed)
            rest, removed, n = cut(text, [] if spans is None else [(s["a"], s["b"]) for s in spans])
            out.append((doc_id, len(text), removed, n, hashlib.sha256(rest).hexdigest(), rest))
        yield frame(out, _CUT)


def _repeated(at: DataFrame, digit: str, following: str) -> DataFrame:
    """Rows whose digit is repeated; ``differ`` tells whether the next digit differs among them."""
    n = at.groupBy(digit).agg(F.count("*").alias("n"), F.min(following).alias("low"), F.max(following).alias("high")).where("n > 1")
    return at.join(n.select(digit, (F.col("low") != F.col("high")).alias("differ")), digit)


def _whole(at: DataFrame, digit: str, following: str) -> DataFrame:
    """Of rows that differ, those whose next digit is repeated all the same."""
    n = at.groupBy(digit, following).agg(F.count("*").alias("n")).where("n > 1")
    return at.join(n.drop("n"), [digit, following], "left_semi")


def repeated_spans(docs: DataFrame) -> DataFrame:
    """(doc_key, a, b): byte spans that consist of repeated windows.  ``docs``: doc_key, text (bytes), packed (compressed text)."""
    run = docs.where(F.length("text") >= DEPTH).select("doc_key", "text").mapInPandas(_runs, _RUN)
    # first pass: runs whose anchor occurs once leave (runs are cheaper to find twice than to store)
    digits = run.groupBy("digit").agg(F.count("*").alias("n")).where("n > 1").select("digit")
    left = shared_table(run.join(digits, "digit", "left_semi"))
    # second pass: runs that are equal as a whole are repeated as a whole
    kinds = shared_table(left.groupBy("digit", "next").agg(F.count("*").alias("n"), F.min(F.struct("doc_key", "start", "place", "windows")).alias("one"))
                         .withColumn("kind", F.xxhash64("digit", "next")))
    many = kinds.groupBy("digit").agg(F.count("*").alias("k")).where("k > 1").select("digit")
    open_ = kinds.join(many, "digit", "left_semi")
    packs = open_.groupBy("one.doc_key").agg(F.collect_list(F.struct("kind", "digit", "one.start", "one.place", "one.windows")).alias("runs"))
    texts = docs.select("doc_key", "packed")
    held = texts.join(packs, "doc_key").select("packed", "runs").mapInPandas(_kinds, _KIND)
    held = shared_table(held.dropDuplicates(["kind"]))
    # third pass: blocks of windows of one run of each kind
    at = held.select("kind", "digit", "place", F.lit(0).cast("short").alias("first"), F.col("windows").alias("count"), "bytes")
    found = None
    for width in BLOCKS:
        b = shared_table(_repeated(at.mapInPandas(_split(width), _BLOCK), "core", "whole"))
        same = b.where(~F.col("differ"))
        if width > 1:
            same = same.unionByName(_whole(b.where("differ"), "core", "whole"))
            at = b.where("differ").select("kind", "first", "count").join(held.select("kind", "digit", "place", "bytes"), "kind").select(
                "kind", "digit", "place", "first", "count", "bytes")
        same = same.select("kind", "first", "count")
        found = same if found is None else found.unionByName(same)
    # copies of a kind have its repeated windows; a kind with copies is repeated whole
    parts = found.groupBy("kind").agg(F.collect_list(F.struct("first", "count")).alias("parts"))
    verdict = kinds.select("digit", "next", "kind", "n").join(parts, "kind", "left")
    entire = F.array(F.struct(F.lit(0).cast("short").alias("first"), F.lit(1).cast("short").alias("count")))
    verdict = verdict.where((F.col("n") > 1) | F.col("parts").isNotNull()).select("digit", "next", (F.col("n") > 1).alias("whole"), F.when(F.col("n") > 1, entire).otherwise(F.col("parts")).alias("parts"))
    hit = left.select("doc_key", "start", "windows", "digit", "next").join(verdict, ["digit", "next"]).select(
        "doc_key", "start", "windows", "whole", F.explode("parts").alias("p"))
    first = F.col("start") + F.col("p.first")
    count = F.when(F.col("whole"), F.col("windows")).otherwise(F.col("p.count"))
    return hit.select("doc_key", first.alias("a"), (first + count - 1 + DEPTH).alias("b"))


def deduplicate(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 and the remaining bytes of every document."""
    d = id_text(docs).withColumn("doc_key", F.xxhash64("doc_id", "text")).withColumn("packed", deflated("text"))
    spans = repeated_spans(d).groupBy("doc_key").agg(F.collect_list(F.struct("a", "b")).alias("spans"))
    rows = d.select("doc_id", "doc_key", "packed").join(spans, "doc_key", "left").select(F.col("doc_id").cast("string").alias("doc_id"), "packed", "spans")
    return rows.mapInPandas(_cut, _CUT).withColumn("doc_id", F.col("doc_id").cast("bigint"))
