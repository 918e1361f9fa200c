"""Benchmark decontamination by a prefix-filtered set join.

An item's windows (10 consecutive words, or the whole shorter item) are sets of
shingles.  Containment must be whole, so the necessary prefix of a window is its
rarest shingle in the corpus-wide order: a document that holds the window holds
that shingle.  The join runs on these prefix shingles only; the length bound
(the window has to fit between the first and the last word) and the position of
the shingle inside the window leave one alignment, and its words are compared.

The corpus is never shuffled.  Items are taken in blocks of at most
``block_bytes`` (checked), each shared with all tasks; more items mean more
blocks, each a pass over the documents, and the result does not change.

Defined results: null and empty documents have no words and no hits; items
without words have no windows; equal items all count; items with a null id hit
like any other, count as one item in ``n_items`` however many there are, and
have no name in ``items``; repeated documents and null ids are judged row by row; with no items every document is clean; other
columns are ignored.
"""
from __future__ import annotations

import hashlib
from collections import defaultdict
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from parleo.llm.common import give_back, id_text, lean, map_texts, shared_table

WINDOW = 10
SHINGLE = 3
BLOCK_BYTES = 8 << 20
#: Lower-cases A-Z; every other byte outside 0-9, a-z and non-ASCII becomes a blank.
_TABLE = bytes(c + 32 if 0x41 <= c <= 0x5A else c if 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A or c >= 0x80 else 32 for c in range(256))

HITS = "doc_id bigint, text binary, hit_spans array<struct<first:bigint,last:bigint>>, items array<string>"
#: Blocks probed in one chain of tasks before the hits so far are written down.
CHAIN = 4


def words(text: bytes) -> list[bytes]:
    return text.translate(_TABLE).split()


def windows(item: list[bytes]) -> list[tuple[bytes, ...]]:
    n = min(WINDOW, len(item))
    return [tuple(item[i:i + n]) for i in range(len(item) - n + 1)] if n else []


def shingles(window: tuple[bytes, ...]) -> list[tuple[bytes, ...]]:
    k = min(SHINGLE, len(window))
    return [window[i:i + k] for i in range(len(window) - k + 1)]


def _by_first(keys) -> dict[bytes, dict[int, set]]:
    out: dict[bytes, dict[int, set]] = defaultdict(lambda: defaultdict(set))
    for k in keys:
        out[k[0]][len(k)].add(k)
    return {a: dict(b) for a, b in out.items()}


def _frequencies(docs: DataFrame, keys: set[tuple[bytes, ...]]) -> dict[tuple[bytes, ...], int]:
    """Number of documents that hold each shingle of a block of items."""
    spark = docs.sparkSession
    names = sorted(keys)
    known = spark.sparkContext.broadcast((_by_first(names), {k: i for i, k in enumerate(names)}))

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        by_first, number = known.value
        total: dict[int, int] = defaultdict(int)
        for b in batches:
            for text in b["text"]:
                w = words(text)
                seen = set()
                for i, x in enumerate(w):
                    if x in by_first:
                        for k, those in by_first[x].items():
                            s = tuple(w[i:i + k])
                            if s in those:
                                seen.add(number[s])
                for s in seen:
                    total[s] += 1
        yield pd.DataFrame({"k": pd.Series(list(total.keys()), dtype="int64"), "n": pd.Series(list(total.values()), dtype="int64")})

    rows = docs.select("text").mapInPandas(lean(count), "k bigint, n bigint").groupBy("k").agg(F.sum("n").alias("n")).collect()
    return defaultdict(int, {names[r["k"]]: r["n"] for r in rows})


Index = tuple[dict, dict, list[str | None]]


def index(docs: DataFrame, block: list[tuple[str | None, list[bytes]]]) -> Index:
    """Prefix shingles of a block of items, the windows behind each, and the items' names."""
    found: dict[tuple[bytes, ...], list[int]] = defaultdict(list)
    for at, (_, item) in enumerate(block):
        for w in windows(item):
            if not found[w] or found[w][-1] != at:
                found[w].append(at)
    freq = _frequencies(docs, {s for w in found for s in shingles(w)})
    prefix: dict[tuple[bytes, ...], list[tuple[int, tuple[bytes, ...], list[int]]]] = defaultdict(list)
    for w, at in found.items():
        _, rare, place = min((freq[s], s, i) for i, s in enumerate(shingles(w)))
        prefix[rare].append((place, w, at))
    return _by_first(prefix), dict(prefix), [name for name, _ in block]


def occurrences(w: list[bytes], known: Index) -> Iterator[tuple[int, int, list[int]]]:
    """(first, end, items) of every window of the block that occurs among the words."""
    by_first, windows_of, _ = known
    for i, x in enumerate(w):
        if x in by_first:
            for k, those in by_first[x].items():
                s = tuple(w[i:i + k])
                if s in those:
                    for place, window, at in windows_of[s]:
                        a = i - place
                        if a >= 0 and a + len(window) <= len(w) and tuple(w[a:a + len(window)]) == window:
                            yield a, a + len(window), at


def _probe(docs: DataFrame, block: list[tuple[str | None, list[bytes]]]) -> DataFrame:
    """Add the hits of one block of items: word spans and items of each document."""
    shared = docs.sparkSession.sparkContext.broadcast(index(docs, block))

    def probe(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = shared.value
        for b in batches:
            hits, names = [], []
            for text, had, of in zip(b["text"], b["hit_spans"], b["items"]):
                spans, items = {(s["first"], s["last"]) for s in had}, set(of)
                for first, end, at in occurrences(words(text), known):
                    spans.add((first, end))
                    items.update(known[2][j] for j in at)
                hits.append([{"first": p, "last": q} for p, q in sorted(spans)])
                names.append(sorted(items, key=lambda x: (x is not None, x or "")))
            yield pd.DataFrame({"doc_id": b["doc_id"], "text": b["text"], "hit_spans": hits, "items": names})

    return map_texts(docs, probe, HITS)


def _hits(docs: DataFrame, block: list[tuple[str | None, list[bytes]]]):
    """Column function: does a text hold a window of the block?"""
    shared = docs.sparkSession.sparkContext.broadcast(index(id_text(docs), block))

    @F.pandas_udf(T.BooleanType())
    def hit(text: pd.Series) -> pd.Series:
        out = pd.Series([next(occurrences(words((t or "").encode()), shared.value), None) is not None for t in text], dtype=bool)
        give_back()
        return out

    return hit


def clean(docs: DataFrame, benchmark: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Rows, with all their columns, that hold no window of any item."""
    for block in _blocks(benchmark, block_bytes):
        docs = docs.where(~_hits(docs, block)(docs["text"].cast("string")))
    return docs


def _blocks(benchmark: DataFrame, block_bytes: int) -> Iterator[list[tuple[str | None, list[bytes]]]]:
    """Items with words in blocks of bounded size, read one partition at a time."""
    rows = benchmark.select(F.col("item_id").cast("string").alias("item_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary").alias("text"))
    block, size = [], 0
    for r in rows.toLocalIterator():
        item = words(bytes(r["text"]))
        if not item:
            continue
        block.append((r["item_id"], item))
        size += len(r["text"])
        if size >= block_bytes:
            yield block
            block, size = [], 0
    if block:
        yield block


def _mark(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        n_hit = []
        for spans in b["hit_spans"]:
            hit, end = 0, 0
            for s in sorted(spans, key=lambda s: s["first"]):
                hit += max(0, s["last"] - max(end, s["first"]))
                end = max(end, s["last"])
            n_hit.append(hit)
        items = [sorted(n for n in x if n is not None) for x in b["items"]]
        yield pd.DataFrame({
            "doc_id": b["doc_id"], "n_words": pd.Series([len(words(t)) for t in b["text"]], dtype="int64"), "n_hit": pd.Series(n_hit, dtype="int64"),
            "n_items": pd.Series([len(x) for x in b["items"]], dtype="int64"), "items_sha256": [hashlib.sha256(",".join(x).encode()).hexdigest() for x in items],
            "contaminated": [n > 0 for n in n_hit], "items": items, "hit_spans": b["hit_spans"]})


MARKED = ("doc_id bigint, n_words bigint, n_hit bigint, n_items bigint, items_sha256 string, contaminated boolean, items array<string>, "
          "hit_spans array<struct<first:bigint,last:bigint>>")


def contamination(docs: DataFrame, benchmark: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Per document: words, words inside occurring windows, the items they come from and the spans (in words, end exclusive)."""
    at = id_text(docs).withColumns({"hit_spans": F.expr("cast(array() as array<struct<first:bigint,last:bigint>>)"), "items": F.expr("cast(array() as array<string>)")})
    for i, block in enumerate(_blocks(benchmark, block_bytes)):
        at = _probe(shared_table(at) if i and i % CHAIN == 0 else at, block)
    return map_texts(at, _mark, MARKED)
