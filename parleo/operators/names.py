"""Speaker names from introductions, hand-offs and thanks."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parleo.functions.columns import explode_once
from parleo.plans.skew import with_halo
from parleo.sources import seeds

# Patterns that reveal a name.
NAME2 = r"([A-Z][a-z]+(?:\s+[A-Z][a-z]+)?)"
SELF = [rf"(?:I'm|I am|my name is|this is)\s+{NAME2}", rf"(?:speaking|here)\s+is\s+{NAME2}"]
HANDOFF = [rf"(?:turn (?:the )?(?:call|conference|floor) over to|hand (?:it )?over to|introduce)\s+{NAME2}", rf"(?:joined by|welcome)\s+{NAME2}"]
ADDRESS = [r"(?:Thank you|Thanks),?\s+([A-Z][a-z]+)", r"(?:over to you|go ahead),?\s+([A-Z][a-z]+)"]
KINDS = [("self", SELF, 2), ("handoff", HANDOFF, 2), ("address", ADDRESS, 1)]


def captured(text: Column) -> Column:
    """All (kind, name) of a text; titles, months and fillers are no names."""
    parts = []
    for kind, pats, _ in KINDS:
        for p in pats:
            parts.append(F.transform(F.regexp_extract_all(text, F.lit(p), F.lit(1)), _one(kind)))
    both = F.flatten(F.array(*parts))
    skip = F.array(*[F.lit(n) for n in seeds.SKIP_NAMES])
    return F.filter(both, lambda s: (F.length(s["name"]) > 2) & ~F.array_contains(skip, F.split(s["name"], r"\s+")[0]))


def _one(kind: str):
    def make(n):
        return F.struct(F.lit(kind).alias("kind"), F.trim(n).alias("name"))
    return make


def evidence(seg: DataFrame, reach: int = 4, size: int = 4096) -> DataFrame:
    """Who a captured name belongs to: the speaker, the next or the previous different speaker within ``reach`` turns."""
    h = with_halo(seg.select("call_id", "segment_id", "speaker", "text"), ["call_id"], "segment_id", reach, size)
    w = Window.partitionBy("call_id", "_b").orderBy("segment_id")

    def other(step) -> Column:
        cand = [step("speaker", i).over(w) for i in range(1, reach + 1)]
        return F.coalesce(*[F.when(c != F.col("speaker"), c) for c in cand])
    h = h.withColumns({"nxt": other(F.lead), "prv": other(F.lag)}).where("_own")
    e = explode_once(h, ["call_id", "segment_id", "speaker", "nxt", "prv"], captured(F.col("text")), "c").select("*", "c.kind", "c.name")
    owner = F.when(F.col("kind") == "self", F.col("speaker")).when(F.col("kind") == "handoff", F.col("nxt")).otherwise(F.col("prv"))
    weight = F.when(F.col("kind") == "address", 1).otherwise(2)
    return e.select("call_id", "segment_id", "kind", "name", owner.alias("owner"), weight.alias("weight"))


def vote(ev: DataFrame, need: int = 2) -> DataFrame:
    """Best name per speaker with enough votes; a name goes to its strongest speaker."""
    v = ev.where("owner is not null").groupBy("call_id", "owner", "name").agg(F.sum("weight").alias("votes"))
    best = v.groupBy("call_id", "owner").agg(F.min_by(F.struct("name", "votes"), F.struct(-F.col("votes"), F.col("name"))).alias("b")).select("call_id", "owner", "b.name", "b.votes")
    return best.where(F.col("votes") >= need).groupBy("call_id", "name").agg(F.min_by(F.struct("owner", "votes"), F.struct(-F.col("votes"), F.col("owner"))).alias("o")).select(
        "call_id", F.col("o.owner").alias("speaker"), F.col("name").alias("speaker_name"), F.col("o.votes").alias("votes"))
