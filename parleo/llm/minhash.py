"""Near-duplicate documents by min-max hashing.

A document's set holds its distinct shingles of five words (or as many as asked for).  Under each of
``PERMUTATIONS`` random orders both the smallest and the largest element are kept: both
agree with the probability of the Jaccard similarity, so half as many hash
evaluations give as many signature values.  A band joins the minima and maxima
of three orders; documents that share a band meet.

Equal sets form a class and only its representative goes on.  In a bucket of a
band every member is compared with one pivot, never all pairs.  Since the
Jaccard distance is a metric, members that the pivot leaves unlinked can only be
linked to members whose distance to the pivot differs by at most the allowed distance;
those, as far as they lie in different components, are compared too.  Links are
confirmed on the full sets of words.

With 64 bands of six values a pair of similarity 0.8 is missed with probability
4e-9, and more similar ones less.

Defined results: texts without words have an empty set, link nothing and stay
alone; shorter texts are one shingle; rows that share an id are one document
with several texts; a null id links nothing, its component is null and it is
kept; an empty table gives no rows; other columns are ignored.
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parleo.llm.common import lean, shared_table, utf8
from parleo.llm.components import components

WORDS = 5
NUM, DEN = 80, 100
PERMUTATIONS = 192
BANDS = 64
_PER_BAND = PERMUTATIONS // BANDS
_rng = np.random.default_rng(20240229)
_FACTOR = _rng.integers(0, 1 << 63, PERMUTATIONS, dtype="uint64") * np.uint64(2) + np.uint64(1)
_PLACE = _rng.integers(0, 1 << 63, 16, dtype="uint64") * np.uint64(2) + np.uint64(1)
_BAND = _rng.integers(0, 1 << 63, 2 * _PER_BAND, dtype="uint64") * np.uint64(2) + np.uint64(1)
BLOCK = 1024
#: Bits of a set's parities.
ODD = 2048


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def words(text: bytes) -> list[bytes]:
    return text.lower().split()  # bytes fold and split ASCII only


def shingles(w: list[bytes], size: int = WORDS) -> set[tuple[bytes, ...]]:
    if len(w) < size:
        return {tuple(w)} if w else set()
    return set(zip(*(w[i:] for i in range(size))))


class _Hashes(dict):
    """64-bit hash of a word, remembered."""

    def __missing__(self, w: bytes) -> int:
        h = self[w] = xxhash.xxh64_intdigest(w)
        return h


def shingle_hashes(w: list[bytes], known: _Hashes, size: int = WORDS) -> np.ndarray:
    """Distinct 64-bit shingle hashes, sorted."""
    if not w:
        return np.zeros(0, "uint64")
    h = np.fromiter(map(known.__getitem__, w), dtype="uint64", count=len(w))
    k = min(size, len(w))
    s = np.full(len(h) - k + 1, k, dtype="uint64")
    for i in range(k):
        s = mixed(s + h[i:len(h) - k + 1 + i] * _PLACE[i])
    return np.unique(s)


def signature(s: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Minima and maxima of a set under every order."""
    low = np.full(PERMUTATIONS, np.iinfo("uint64").max, dtype="uint64")
    high = np.zeros(PERMUTATIONS, dtype="uint64")
    for i in range(0, len(s), BLOCK):
        x = s[None, i:i + BLOCK] * _FACTOR[:, None]
        np.minimum(low, x.min(1), out=low)
        np.maximum(high, x.max(1), out=high)
    return low, high


def bands(s: np.ndarray) -> np.ndarray:
    low, high = signature(s)
    both = np.hstack([low.reshape(BANDS, _PER_BAND), high.reshape(BANDS, _PER_BAND)])
    return mixed((mixed(both) * _BAND[None, :]).sum(1, dtype="uint64") + np.arange(BANDS, dtype="uint64")).view("int64")


def parities(s: np.ndarray) -> np.ndarray:
    """Whether a set holds an odd number of shingles of each of ``ODD`` parts of the hash range, as 64-bit words.

    Every shingle that only one of two sets holds turns one bit, so their parities differ
    in no more places than the sets differ in shingles.
    """
    return np.packbits(np.bincount((s >> np.uint64(32)).astype("int64") % ODD, minlength=ODD).astype("uint8") & 1).view("int64")


_SIGNED = "doc_id string, n bigint, class_a bigint, class_b bigint, bands array<bigint>, odd array<bigint>"


def _sign(batches: Iterator[pd.DataFrame], size: int) -> Iterator[pd.DataFrame]:
    known = _Hashes()
    for b in batches:
        out = []
        for doc_id, text in zip(b["doc_id"], b["text"]):
            if len(known) > 60_000:
                known.clear()
            s = shingle_hashes(words(text), known, size)
            if len(s):
                a, c = (mixed(s ^ np.uint64(k)).sum(dtype="uint64").view("int64") for k in (0x51, 0xA3))
                out.append((doc_id, len(s), a, c, bands(s), parities(s)))
            else:
                out.append((doc_id, 0, 0, 0, np.zeros(0, "int64"), np.zeros(0, "int64")))
        got = pd.DataFrame(out, columns=["doc_id", "n", "class_a", "class_b", "bands", "odd"])
        got["doc_id"] = got["doc_id"].astype("object")
        yield got


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(docs["doc_id"].cast("bigint").alias("doc_id"), utf8(docs["text"]).alias("text"))


def signed(docs: DataFrame, size: int = WORDS) -> DataFrame:
    """doc_id, size, class (128 bits), bands and parities of every document."""
    rows = _texts(docs).withColumn("doc_id", F.col("doc_id").cast("string")).mapInPandas(lean(lambda b: _sign(b, size)), _SIGNED)
    return rows.withColumn("doc_id", F.col("doc_id").cast("bigint"))


def _compare(batches: Iterator[pd.DataFrame], size: int) -> Iterator[pd.DataFrame]:
    last, left = None, set()
    for b in batches:
        both, union = [], []
        for p, tp, tx in zip(b["pivot"], b["text_pivot"], b["text"]):
            if (p, tp) != last:
                last, left = (p, tp), shingles(words(tp), size)
            right = shingles(words(tx), size)
            k = len(left & right)
            both.append(k)
            union.append(len(left) + len(right) - k)
        yield pd.DataFrame({"pivot": b["pivot"], "node": b["node"], "same": pd.Series(both, dtype="int64"), "all": pd.Series(union, dtype="int64")})


def verified(pairs: DataFrame, docs: DataFrame, size: int = WORDS) -> DataFrame:
    """Exact intersection and union sizes of (pivot, node) pairs."""
    texts = _texts(docs)
    one = pairs.join(texts.withColumnRenamed("doc_id", "node"), "node")
    other = texts.select(F.col("doc_id").alias("pivot"), F.col("text").alias("text_pivot"))
    found = one.join(other, "pivot").select("pivot", "node", "text_pivot", "text")
    return found.mapInPandas(lean(lambda b: _compare(b, size)), "pivot bigint, node bigint, same bigint, all bigint").groupBy("pivot", "node").agg(
        F.max_by(F.struct("same", "all"), F.col("same") / F.col("all")).alias("s")).select("pivot", "node", "s.same", "s.all")


def _linked(v: DataFrame) -> DataFrame:
    return v.where(DEN * F.col("same") >= NUM * F.col("all")).select(F.col("node").alias("a"), F.col("pivot").alias("b"))


def _close(n: str, m: str) -> F.Column:
    return DEN * F.least(n, m) >= NUM * F.greatest(n, m)


def groups(docs: DataFrame, size: int = WORDS) -> DataFrame:
    """doc_id, n_shingles, component_id, kept of every row, by shingles of ``size`` words."""
    s = shared_table(signed(docs, size))
    named = s.where(F.col("doc_id").isNotNull() & (F.col("n") > 0))
    key = ["class_a", "class_b", "n"]
    classes = shared_table(named.groupBy(*key).agg(F.min("doc_id").alias("rep")))
    reps = named.join(classes.withColumnRenamed("rep", "doc_id"), [*key, "doc_id"], "left_semi")
    spread = reps.select(F.col("doc_id").alias("node"), "n", F.posexplode("bands").alias("place", "band"))
    sizes = spread.groupBy("place", "band").agg(F.count("*").alias("members")).where("members > 1")
    shared = shared_table(spread.join(sizes, ["place", "band"]))
    # the pivot of a bucket meets most others in all its buckets: of copies with edits, most likely their source
    company = shared.groupBy("node").agg(F.sum("members").alias("company"))
    ranked = shared.join(company, "node")
    pivots = ranked.groupBy("place", "band").agg(F.max(F.struct("company", (-F.col("node")).alias("node"), "n")).alias("p"))
    pivots = pivots.select("place", "band", (-F.col("p.node")).alias("pivot"), F.col("p.n").alias("pivot_n"))
    met = shared_table(shared.drop("members").join(pivots, ["place", "band"]))
    pairs = met.where((F.col("node") != F.col("pivot")) & _close("n", "pivot_n")).select("pivot", "node").distinct()
    first = shared_table(verified(pairs, docs, size))
    # rows of one id in several classes connect them
    spans = named.join(classes, key).groupBy("doc_id").agg(F.min("rep").alias("b"), F.max("rep").alias("a")).where("a > b").select("a", "b")
    links = _linked(first).unionByName(spans)
    found = components(links)
    second = _across(met, first, found, named, reps, docs, size)
    more = shared_table(_linked(verified(second, docs, size)))
    if not more.isEmpty():
        found = components(found.select(F.col("node").alias("a"), F.col("component").alias("b")).unionByName(more))  # found stands for the links
    of_rep = classes.join(found, classes["rep"] == found["node"], "left").select(*key, F.coalesce("component", "rep").alias("component_id"))
    rows = s.select("doc_id", *key).join(of_rep, key, "left")
    alone = F.col("doc_id").isNull() | (F.col("n") == 0)
    component = F.when(alone, F.col("doc_id")).otherwise(F.col("component_id"))
    return rows.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(component == F.col("doc_id"), F.lit(True)).alias("kept"))


def _lists(batches: Iterator[pd.DataFrame], size: int) -> Iterator[pd.DataFrame]:
    known = _Hashes()
    for b in batches:
        for node, text in zip(b["node"], b["text"]):
            if len(known) > 60_000:
                known.clear()
            h = shingle_hashes(words(text), known, size)
            yield pd.DataFrame({"node": np.full(len(h), node, "int64"), "h": h.view("int64")})


def _own(nodes: DataFrame, docs: DataFrame, size: int) -> DataFrame:
    """(node, own): shingles of a node that no other of the given nodes holds, so that no link can share them."""
    texts = _texts(docs).withColumnRenamed("doc_id", "node")
    lists = texts.join(nodes, "node").mapInPandas(lean(lambda b: _lists(b, size)), "node bigint, h bigint")
    once = lists.groupBy("h").agg(F.count("*").alias("times"), F.min("node").alias("node")).where("times = 1")
    return once.groupBy("node").agg(F.count("*").alias("own"))


def _across(met: DataFrame, first: DataFrame, found: DataFrame, named: DataFrame, reps: DataFrame, docs: DataFrame, size: int) -> DataFrame:
    """Pairs of a bucket that its pivot could not settle: in other components, with distances to the pivot that allow a link.

    What a node shares with another is at most its set without the shingles that
    only it has; where that is too little for the similarity no pair is made (of a
    group of copies with many edits each, hardly any).  Nor is one made where the
    parities differ in more places than the sets of a link may differ in shingles:
    of a group of copies, only pairs close to the similarity asked for are left.
    Both are bounds, not estimates.  A pair is met in the first band that it shares,
    so it is made once.
    """
    key = ["place", "band"]
    split = met.join(found, "node", "left").withColumn("component", F.coalesce("component", "node")).drop("pivot_n")
    several = split.groupBy(*key).agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low < high").select(*key)
    here = split.join(several, key, "left_semi").where(F.col("node") != F.col("pivot")).join(first, ["pivot", "node"], "left")
    here = here.select(*key, "node", "n", "component", (1 - F.col("same") / F.col("all")).alias("far"))
    several_texts = named.groupBy(F.col("doc_id").alias("node")).agg(F.min("class_a").alias("x"), F.max("class_a").alias("y")).where("x <> y").select("node", F.lit(0).cast("bigint").alias("none"))
    here = shared_table(here)
    own = _own(here.select("node").distinct(), docs, size).join(several_texts, "node", "left").select("node", F.coalesce("none", "own").alias("own"))
    here = here.join(own, "node", "left").withColumn("most", F.col("n") - F.coalesce("own", F.lit(0)))
    here = here.where(DEN * F.col("most") >= NUM * F.col("n"))  # else nothing can be similar enough
    here = here.join(reps.select(F.col("doc_id").alias("node"), "bands", "odd"), "node")
    a = here.select(*key, F.col("node").alias("pivot"), F.col("n").alias("pn"), F.col("component").alias("pc"), F.col("far").alias("pf"), F.col("bands").alias("pb"), F.col("odd").alias("po"), F.col("most").alias("pm"))
    apart = F.coalesce(F.abs(F.col("far") - F.col("pf")) <= 1 - NUM / DEN + 1e-9, F.lit(True))
    earlier = F.exists(F.slice(F.zip_with("bands", "pb", lambda x, y: x == y), F.lit(1), F.col("place")), lambda e: e)
    share = F.least("most", "pm")
    enough = DEN * share >= NUM * (F.col("n") + F.col("pn") - share)
    differ = F.aggregate(F.zip_with("odd", "po", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda total, x: total + x)
    few = (DEN + NUM) * differ <= (DEN - NUM) * (F.col("n") + F.col("pn"))
    pairs = a.join(here, key).where(enough & (F.col("pivot") < F.col("node")) & (F.col("pc") != F.col("component")) & _close("n", "pn") & apart & ~earlier & few)
    return pairs.select("pivot", "node").distinct()
