"""Phrase matching over turns and over the running text of a call."""
from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parleo.functions.columns import constant, explode_once, let, norm
from parleo.plans.skew import attach, dim, lookahead, salted_join


def longest(vocab: DataFrame) -> int:
    """Words of the longest phrase: how far a call-level match can look ahead."""
    n = vocab.agg(F.max(F.size(F.split(F.trim(F.col("phrase")), r"\s+")))).first()[0]
    return max(1, n or 1)


def with_heads(vocab: DataFrame) -> DataFrame:
    """Phrases in normal form, keyed by their first word."""
    v = vocab.withColumn("nphrase", norm(F.col("phrase")))
    return v.withColumn("head", F.split("nphrase", " ")[0]).where(F.col("head") != "")


def padded(c: Column) -> Column:
    return F.concat(F.lit(" "), c, F.lit(" "))


def phrase_hits(rows: DataFrame, vocab: DataFrame, ids: Sequence[str], text: str, start_text: str | None = None) -> DataFrame:
    """Whole-word phrase matches by an equi-join on the first word of the phrase.

    Each distinct word of a text meets only the phrases that begin with it; a
    containment test on the normal form and on the raw text settles the match.
    ``start_text`` limits where a phrase may begin when ``text`` looks ahead.
    The vocabulary is broadcast when it is counted to be small, and joined with
    salted keys otherwise, since a few first words ("we", "you") are very common.
    """
    own = norm(F.col(start_text or text))
    base = rows.withColumn("_raw", F.lower(text)).withColumn("_norm", norm(F.col(text)))
    words = explode_once(base, [*ids, "_raw", "_norm"], F.array_distinct(F.split(own, " ")), "head")
    v, small = dim(with_heads(vocab))
    joined = words.join(v, "head") if small else salted_join(words, v, ["head"], list(ids))
    hit = F.contains(padded(F.col("_norm")), padded(F.col("nphrase"))) & F.contains(F.col("_raw"), F.lower("phrase"))
    return joined.where(hit).drop("_raw", "_norm", "head", "nphrase")


def call_phrases(turns: DataFrame, vocab: DataFrame, extra: Sequence[str] = ()) -> DataFrame:
    """Phrases found in the joined text of the given turns of each call, over as many turns as the longest phrase spans."""
    reach = longest(vocab)
    hay = lookahead(turns, ["call_id"], "chunk", ["segment_id"], "text", reach, "hay")
    hits = phrase_hits(hay, vocab, ["call_id", "segment_id", *extra], "hay", "text")
    return hits


def substring_hits(rows: DataFrame, phrases: Sequence[tuple[str, str]], ids: Sequence[str], text: str) -> DataFrame:
    """Plain substring matches of a short fixed list: one array filter per row, no join."""
    table = constant([{"category": c, "phrase": p.lower(), "rank": i} for i, (c, p) in enumerate(phrases)], "category:string,phrase:string,rank:int")
    found = let(F.lower(F.col(text)), lambda t: F.filter(table, lambda s: F.contains(t, s["phrase"])))
    return explode_once(rows, ids, found, "h").select(*ids, "h.category", "h.phrase", "h.rank")


def first_segment_with(turns: DataFrame, phrases: Sequence[str]) -> DataFrame:
    """First turn of the call, by any speaker, that contains the phrase."""
    hits = substring_hits(turns, [("", p) for p in phrases], ["call_id", "segment_id"], "text")
    return hits.groupBy("call_id", "phrase").agg(F.min("segment_id").alias("first_segment"))


def first_turn_of(turns: DataFrame, hits: DataFrame) -> DataFrame:
    """First single turn, by any speaker, that contains a phrase found in its call (call_id, phrase).

    Only turns of calls with hits are looked at; the phrases of a call are bounded by the vocabulary.
    """
    per_call = hits.groupBy("call_id").agg(F.collect_set("phrase").alias("_ps"))
    own = attach(turns.select("call_id", "chunk", "segment_id", F.lower("text").alias("_t")), per_call, ["call_id"], "chunk")
    found = explode_once(own, ["call_id", "segment_id"], F.filter("_ps", lambda p: F.contains(F.col("_t"), F.lower(p))), "phrase")
    return found.groupBy("call_id", "phrase").agg(F.min("segment_id").alias("first_segment"))


def running_hits(turns: DataFrame, phrases: Sequence[tuple[str, str]]) -> DataFrame:
    """Substring matches over the joined text of a call, one row per call, category and phrase."""
    reach = max((len(p.split()) for _, p in phrases), default=1)
    hay = lookahead(turns, ["call_id"], "chunk", ["segment_id"], "text", reach, "hay")
    return substring_hits(hay, phrases, ["call_id"], "hay").distinct()


LIST_ROWS = 2_000  # phrases that one array filter looks for


def running_table_hits(turns: DataFrame, table: DataFrame) -> DataFrame:
    """``running_hits`` for a table (category, phrase, rank) of any size: one array filter per ``LIST_ROWS`` phrases.

    A phrase listed twice in a category counts once, at its first place.
    """
    hay = lookahead(turns, ["call_id"], "chunk", ["segment_id"], "text", longest(table), "hay").select("call_id", F.lower("hay").alias("hay"))
    blocks = max(1, -(-table.count() // LIST_ROWS))

    def block(b: int) -> DataFrame:
        part = table.where(F.pmod(F.xxhash64("category", "phrase"), F.lit(blocks)) == b)
        one = part.agg(F.collect_list(F.struct("category", F.lower("phrase").alias("phrase"), F.col("rank").cast("int").alias("rank")))).scalar()
        found = F.filter(F.col("_listed"), lambda s: F.contains(F.col("hay"), s["phrase"]))
        return explode_once(hay.withColumn("_listed", one), ["call_id"], found, "h").select("call_id", "h.category", "h.phrase", "h.rank")
    hits = reduce(DataFrame.unionByName, [block(b) for b in range(blocks)])
    return hits.groupBy("call_id", "category", "phrase").agg(F.min("rank").alias("rank"))
