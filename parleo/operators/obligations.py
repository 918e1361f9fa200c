"""Obligations: commitments, consents and denials of a turn, tied to the nearest amount and date in it.

Everything happens inside the row: cues are found with their offsets, amounts
and dates come from the entity patterns, and each cue takes the amount and the
date whose text lies nearest to it (the earlier one where two are as near).
"""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parleo.functions.columns import constant, explode_once, let
from parleo.operators import entities as ent
from parleo.sources import vocab

#: What is said and the kind of obligation it makes; earlier cues win where two start at one place.
CUES = {
    "payment_promise": ["i will pay", "i'll pay", "i promise to pay", "i will clear", "i will transfer", "i will deposit", "payment will be made"],
    "authorization": ["i authorize", "i authorise", "you may debit", "you can debit", "i give permission"],
    "consent": ["i agree to", "i consent", "i accept the", "i give my consent"],
    "commitment": ["we will waive", "we will refund", "we will call you back", "i will arrange", "we will reverse", "i will send you"],
    "denial": ["i refuse to", "i will not pay", "i never took", "not my loan", "i cannot pay"],
    "dispute": ["wrong charge", "i dispute", "already paid", "incorrect amount"],
}
CONDITIONS = ["if", "unless", "provided", "once i get", "when i get", "as soon as"]
HEDGES = ["maybe", "perhaps", "probably", "might", "i will try", "let me see"]
#: Kinds and strengths with legal weight.
FIRM = ["consent", "authorization"]

EDGE = r"\p{L}\p{M}\p{N}_"
OBLIGATION = ("segment_id bigint, speaker string, text string, obligation_type string, strength string, amount struct<value:double,currency:string,raw_text:string>, "
              "date_referenced string, start_ds bigint, legally_significant boolean")


def _phrase(listed: Sequence[str]) -> str:
    return rf"(?i)(?<![{EDGE}])(?:" + "|".join(w.replace(" ", r"\s+") for w in listed) + rf")(?![{EDGE}])"


def starts(text: Column, pieces: Column, gaps: Column) -> Column:
    """Offsets (from 0) of matches, from the text between them."""
    def at(i: Column) -> Column:
        return F.aggregate(F.slice(gaps, 1, i + 1), F.lit(0), lambda a, g: a + F.length(g)) + F.aggregate(F.slice(pieces, 1, i), F.lit(0), lambda a, p: a + F.length(p))
    return F.transform(pieces, lambda p, i: at(i))


def occurrences(text: Column, raw: Column) -> Column:
    """Offsets of a literal text."""
    gaps = F.split(text, F.concat(F.lit(r"\Q"), raw, F.lit(r"\E")), -1)
    return F.transform(F.slice(gaps, 1, F.size(gaps) - 1), lambda g, i: F.aggregate(F.slice(gaps, 1, i + 1), i * F.length(raw), lambda a, x: a + F.length(x)))


def placed(text: Column, items: Column) -> Column:
    """Entity items with every place they stand at."""
    return F.flatten(F.transform(F.filter(items, lambda e: e["raw_text"] != ""), lambda e: F.transform(occurrences(text, e["raw_text"]), lambda s: F.struct(
        s.alias("start"), (s + F.length(e["raw_text"])).alias("end"), e["value"].alias("value"), e["raw_text"].alias("raw_text")))))


def nearest(spans: Column, start: Column, end: Column) -> Column:
    """The span with the fewest characters between itself and [start, end)."""
    return F.array_min(F.transform(spans, lambda s: F.struct(
        F.greatest(s["start"] - end, start - s["end"], F.lit(0)).alias("gap"), s["start"].alias("start"), s["value"].alias("value"), s["raw_text"].alias("raw_text"))))


def iso_date(value: Column) -> Column:
    """A numeric date, day first, as ISO; other dates as they were said (there is no call date to count from)."""
    p = r"^(\d{1,2})[/\-.](\d{1,2})[/\-.](\d{4})$"
    d, m, y = (F.regexp_extract(value, p, i) for i in (1, 2, 3))
    iso = F.concat_ws("-", y, F.lpad(m, 2, "0"), F.lpad(d, 2, "0"))
    return F.when(value.rlike(p), F.coalesce(F.try_to_date(iso, "yyyy-MM-dd").cast("string"), value)).otherwise(value)


def obligations(turns: DataFrame, lang: Column | None = None, lex: DataFrame | None = None) -> DataFrame:
    """One row per cue: call_id, item and the columns of ``OBLIGATION``.

    Strength: denials and disputes deny; consents and authorisations bind; of
    promises and commitments those under a condition are conditional, hedged ones
    vague, those with both an amount and a date binding, all others promises.  A
    null text holds none.
    """
    cols = ["call_id", "segment_id", "speaker", "start_ds"]
    kinds = constant([{"cue": w, "kind": k} for k, ws in CUES.items() for w in ws], "cue:string,kind:string")
    cue_re = _phrase([w for ws in CUES.values() for w in ws])
    some = turns.withColumn("text", F.coalesce("text", F.lit(""))).where(F.col("text").rlike(cue_re))
    x, own, english = ent.with_lexicon(some, lang if lang is not None else F.lit("en"), ent.lexicon(vocab.seed_vocab(turns.sparkSession)) if lex is None else lex)
    t = F.col("text")
    empty = F.array().cast("array<struct<entity_type:string,value:string,raw_text:string,confidence:double>>")
    conditional, hedged = t.rlike(_phrase(CONDITIONS)), t.rlike(_phrase(HEDGES))

    def made(found: Column) -> Column:
        def one(cue: Column, start: Column) -> Column:
            said = F.regexp_replace(F.lower(cue), r"\s+", " ")
            kind = F.get(F.filter(kinds, lambda k: k["cue"] == said), F.lit(0))["kind"]
            end = start + F.length(cue)

            def shaped(near: Column) -> Column:
                amount, date = near["amount"], near["date"]
                strength = (F.when(kind.isin("denial", "dispute"), "denial").when(kind.isin(*FIRM), "binding").when(conditional, "conditional").when(hedged, "vague")
                            .when(amount.isNotNull() & date.isNotNull(), "binding").otherwise("promise"))
                money = F.when(amount.isNotNull(), F.struct(F.split(amount["value"], " ")[0].cast("double").alias("value"), F.split(amount["value"], " ")[1].alias("currency"), amount["raw_text"].alias("raw_text")))
                return F.struct(kind.alias("obligation_type"), strength.alias("strength"), money.alias("amount"), iso_date(date["value"]).alias("date_referenced"),
                                (strength.isin("binding", "denial") | kind.isin(*FIRM)).alias("legally_significant"))
            return let(F.struct(nearest(F.col("_money"), start, end).alias("amount"), nearest(F.col("_dates"), start, end).alias("date")), shaped)
        return F.transform(found, lambda c: one(c["cue"], c["start"]))

    x = x.withColumns({"_money": placed(t, F.coalesce(ent.money_items(t, own, english), empty)), "_dates": placed(t, F.coalesce(ent.date_items(t, own, english), empty))})
    cues = let(F.regexp_extract_all(t, F.lit(cue_re), F.lit(0)), lambda c: F.zip_with(c, starts(t, c, F.split(t, cue_re, -1)), lambda w, s: F.struct(w.alias("cue"), s.alias("start"))))
    x = x.withColumn("_cues", cues)
    rows = explode_once(x, [*cols, "text"], made(F.col("_cues")), "o", "item")
    return rows.select("call_id", "item", "segment_id", "speaker", "text", "o.obligation_type", "o.strength", "o.amount", "o.date_referenced", "start_ds", "o.legally_significant")
