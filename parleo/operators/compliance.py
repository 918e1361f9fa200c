"""Conduct and disclosure rules; every rule family yields the same columns."""
from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parleo.functions.columns import any_contains
from parleo.operators.matching import first_turn_of, longest, phrase_hits
from parleo.operators.turns import agent_domination, agent_opening, is_customer, opening_text, talk_shares
from parleo.plans.skew import attach, dim, lookahead, salted_join
from parleo.plans.stage import settle
from parleo.sources import seeds

COLUMNS = ["call_id", "check_name", "passed", "violation_type", "segment_id", "severity", "regulation", "evidence"]

# Kinds of violation.
MISSING, LANGUAGE, COLLECTION, PRIVACY = "missing_disclosure", "prohibited_language", "improper_collection", "privacy_violation"


def conduct_agent(speaker: Column) -> Column:
    return F.lower(speaker).isin("agent", "speaker_00")


def severity_map() -> list[tuple[str, str, str]]:
    return [(ct, raw, shown) for ct, row in seeds.SEVERITY_BY_CALL_TYPE.items() for raw, shown in row.items()]


def mapped_severity(call_type: Column, raw: Column) -> Column:
    """Severity by call type; unknown types count as general."""
    pairs = F.create_map(*[F.lit(x) for ct, r, shown in severity_map() for x in (f"{ct}/{r}", shown)])
    known = F.when(call_type.isin(*seeds.SEVERITY_BY_CALL_TYPE), call_type).otherwise("general")
    return pairs[F.concat(known, F.lit("/"), raw)]


def effective_vocab(vocab: DataFrame, langs: DataFrame) -> DataFrame:
    """Own-language phrases plus the English ones for every language in use, without doubles."""
    cols = ["domain", "call_type", "category", "phrase", "regulation", "rank"]
    used = langs.select("lang").distinct()
    # a row for each language in use: the vocabulary is the large side, languages are few
    own = vocab.join(used, "lang").select("lang", *cols, F.lit(True).alias("is_own"))
    english = vocab.where(F.col("lang") == "en").drop("lang").join(used.withColumn("_e", F.lit("en")), F.col("_e") == "en").select("lang", *cols, (F.col("lang") == "en").alias("is_own"))
    both = own.unionByName(english)
    return both.groupBy("lang", "domain", "category", "phrase", F.coalesce("call_type", F.lit("")).alias("call_type")).agg(
        F.min("rank").alias("rank"), F.max_by("regulation", F.struct("is_own", "regulation")).alias("regulation"), F.bool_or("is_own").alias("is_own"))


def disclosure_checks(seg: DataFrame, vocab: DataFrame) -> DataFrame:
    """One row per required disclosure of a regulated call, looked up in the agent's opening."""
    calls = seg.where(F.col("call_type").isin(*seeds.REGULATED)).select("call_id", "call_type", "lang").distinct()
    opening = opening_text(agent_opening(seg)).select("call_id", F.lower("opening").alias("opening"))
    base = settle(calls.join(opening, "call_id", "left").fillna("", ["opening"]))  # one bounded text a call, read twice
    v = settle(effective_vocab(vocab.where(F.col("domain") == "disclosure"), base).select(
        F.col("lang").alias("v_lang"), F.col("call_type").alias("v_type"), "category", "phrase", "regulation", "is_own"))
    hits = phrase_hits(base, v.select("v_lang", "v_type", "category", "phrase"), ["call_id", "call_type", "lang"], "opening").where(
        (F.col("v_type") == F.col("call_type")) & (F.col("v_lang") == F.col("lang"))).select(
        "call_id", F.col("category").alias("check_name")).distinct().withColumn("_hit", F.lit(True))
    # one row for each check of a language: its own regulation before the English one
    need, small = dim(v.groupBy(F.col("v_lang").alias("lang"), F.col("v_type").alias("call_type"), F.col("category").alias("check_name")).agg(
        F.max_by("regulation", F.struct("is_own", "regulation")).alias("regulation")))
    rows = (base.join(need, ["lang", "call_type"]) if small else salted_join(base, need, ["lang", "call_type"], ["call_id"]))
    rows = rows.join(hits, ["call_id", "check_name"], "left")
    ok = F.coalesce("_hit", F.lit(False))
    return rows.select("call_id", "check_name", ok.alias("passed"), F.when(~ok, MISSING).alias("violation_type"), F.lit(None).cast("bigint").alias("segment_id"),
                       mapped_severity(F.col("call_type"), F.when(ok, "low").otherwise("high")).alias("severity"), "regulation",
                       F.when(~ok, F.substring("opening", 1, 200)).alias("evidence"))


#: Turns that a kind of phrase is looked for in: agent turns in regulated calls and all turns elsewhere, any turn, the customer's turns.
STREAMS = {
    "prohibited": lambda: ~F.col("call_type").isin(*seeds.REGULATED) | conduct_agent(F.col("speaker")),
    "third_party": lambda: F.lit(True),
    "end_call": lambda: is_customer(F.col("speaker")),
}


def phrase_pass(seg: DataFrame, vocab: DataFrame, domains: Sequence[str] = tuple(STREAMS)) -> DataFrame:
    """Phrases of several kinds found in one pass: each kind reads the running text of its own turns.

    One row per call, kind and phrase with the first single turn that contains it;
    phrases count in the call's own language and in English.
    """
    v = vocab.where(F.col("domain").isin(*domains)).select(F.col("domain").alias("v_domain"), F.col("lang").alias("v_lang"), "category", "phrase", "rank")
    kinds = F.array_compact(F.array(*[F.when(STREAMS[d](), F.lit(d)) for d in domains]))
    rows = seg.select("call_id", "chunk", "segment_id", "call_type", "lang", "text", F.explode(kinds).alias("domain"))
    hay = lookahead(rows, ["call_id", "domain"], "chunk", ["segment_id"], "text", longest(v), "hay")
    hits = phrase_hits(hay, v, ["call_id", "segment_id", "domain", "call_type", "lang"], "hay", "text").where(
        (F.col("v_domain") == F.col("domain")) & ((F.col("v_lang") == "en") | (F.col("v_lang") == F.col("lang"))))
    shown = F.when(F.col("domain") == "prohibited", F.lower("phrase")).otherwise(F.col("phrase"))
    found = settle(hits.withColumn("phrase", shown).groupBy("call_id", "call_type", "lang", "domain", "v_lang", "category", "phrase").agg(F.min("rank").alias("rank")))
    return found.join(first_turn_of(seg, found), ["call_id", "phrase"], "left")


def prohibited_phrases(seg: DataFrame, vocab: DataFrame, hits: DataFrame | None = None) -> DataFrame:
    """One failed check per forbidden phrase: agent turns in regulated calls, all turns elsewhere."""
    hits = phrase_pass(seg, vocab, ["prohibited"]) if hits is None else hits.where("domain = 'prohibited'")
    raw = F.when(F.col("category").isin("threats", "coercion", "misleading"), "critical").otherwise("high")
    return hits.select("call_id", "call_type", "category", "phrase", "first_segment").distinct().select(
        "call_id", F.concat(F.lit("prohibited_"), "category").alias("check_name"), F.lit(False).alias("passed"), F.lit(LANGUAGE).alias("violation_type"),
        F.col("first_segment").alias("segment_id"), mapped_severity(F.col("call_type"), raw).alias("severity"),
        F.lit("RBI_Fair_Practice_Code").alias("regulation"), F.concat(F.lit('Agent said: "'), "phrase", F.lit('"')).alias("evidence"))


def third_party_disclosure(seg: DataFrame, vocab: DataFrame, hits: DataFrame | None = None) -> DataFrame:
    hits = phrase_pass(seg, vocab, ["third_party"]) if hits is None else hits.where("domain = 'third_party'")
    return hits.select("call_id", "phrase", "first_segment").distinct().select(
        "call_id", F.lit("third_party_disclosure").alias("check_name"), F.lit(False).alias("passed"), F.lit(PRIVACY).alias("violation_type"),
        F.col("first_segment").alias("segment_id"), F.lit("critical").alias("severity"),
        F.lit("RBI_Fair_Practice_Code_Section_8d").alias("regulation"),
        F.concat(F.lit('Possible third-party disclosure: "'), "phrase", F.lit('"')).alias("evidence"))


def ignored_end_request(seg: DataFrame, vocab: DataFrame, allowed: int = 3, hits: DataFrame | None = None) -> DataFrame:
    """The first listed phrase a customer used to end the call, and the agent turns after it."""
    said = phrase_pass(seg, vocab, ["end_call"]) if hits is None else hits.where("domain = 'end_call'")
    # the call's own language comes before English
    asked = said.groupBy("call_id").agg(F.min_by(F.struct("phrase", "first_segment"), F.struct(F.col("v_lang") != F.col("lang"), "rank", "phrase")).alias("p"))
    at = asked.select("call_id", "p.phrase", "p.first_segment").where("first_segment is not null")
    agent = seg.where(conduct_agent(F.col("speaker"))).select("call_id", "chunk", "segment_id")
    after = attach(agent, at, ["call_id"], "chunk").where(F.col("segment_id") > F.col("first_segment"))
    n = after.groupBy("call_id", "phrase", "first_segment").agg(F.count(F.lit(1)).alias("n_after")).where(F.col("n_after") > allowed)
    return n.select("call_id", F.lit("ignored_call_end_request").alias("check_name"), F.lit(False).alias("passed"), F.lit(COLLECTION).alias("violation_type"),
                    F.col("first_segment").alias("segment_id"), F.lit("high").alias("severity"),
                    F.lit("RBI_Fair_Practice_Code_Section_8c").alias("regulation"),
                    F.concat(F.lit('Customer said: "'), "phrase", F.lit('" but agent continued ('), F.col("n_after").cast("string"),
                             F.lit(" more segments)")).alias("evidence"))


def domination_checks(seg: DataFrame) -> DataFrame:
    d = agent_domination(talk_shares(seg)).where("violated")
    return d.select("call_id", F.lit("agent_domination").alias("check_name"), F.lit(False).alias("passed"), F.lit(COLLECTION).alias("violation_type"),
                    F.lit(None).cast("bigint").alias("segment_id"), F.lit("medium").alias("severity"),
                    F.lit("RBI_Fair_Practice_Code_Section_8").alias("regulation"),
                    F.concat(F.lit("Agent spoke "), F.floor(F.col("agent_share") * 100 + 0.5).cast("string"), F.lit("% of call")).alias("evidence"))


def general_checks(seg: DataFrame) -> DataFrame:
    """Three keyword checks for unregulated calls, always reported."""
    reach = max(len(k.split()) for _, _, kws, _ in seeds.GENERAL_CHECKS for k in kws)
    hay = lookahead(seg.where(F.col("call_type") == "general"), ["call_id"], "chunk", ["segment_id"], "text", reach, "hay")
    low = F.lower("hay")
    agg = hay.groupBy("call_id").agg(*[F.bool_or(any_contains(low, kws)).alias(f"c{i}")
                                       for i, (_, _, kws, _) in enumerate(seeds.GENERAL_CHECKS)])
    rows = F.array(*[F.struct(F.lit(n).alias("check_name"), F.lit(r).alias("regulation"), F.col(f"c{i}").alias("passed"),
                              F.when(~F.col(f"c{i}"), why).alias("evidence")) for i, (n, r, _, why) in enumerate(seeds.GENERAL_CHECKS)])
    return agg.select("call_id", F.explode(rows).alias("r")).select(
        "call_id", "r.check_name", "r.passed", F.when(~F.col("r.passed"), MISSING).alias("violation_type"), F.lit(None).cast("bigint").alias("segment_id"),
        F.lit("low").alias("severity"), "r.regulation", "r.evidence")


def all_checks(seg: DataFrame, vocab: DataFrame) -> DataFrame:
    """Union of the rule families; their phrases are looked for in one pass."""
    hits = settle(phrase_pass(seg, vocab))
    parts = [disclosure_checks(seg, vocab), prohibited_phrases(seg, vocab, hits), third_party_disclosure(seg, vocab, hits),
             domination_checks(seg), ignored_end_request(seg, vocab, hits=hits), general_checks(seg)]
    return reduce(DataFrame.unionByName, [p.select(*COLUMNS) for p in parts])


def detect_call_type(opening: DataFrame, min_hits: int = 2) -> DataFrame:
    """Score call types by keyword hits in the opening; the first listed type wins a tie."""
    lines = F.sort_array(F.collect_list(F.struct("segment_id", F.lower("text").alias("t"))))
    text = opening.groupBy("call_id").agg(F.array_join(F.transform(lines, lambda s: s["t"]), " ").alias("t"))
    by_type: dict[str, list[str]] = {}
    for ct, kw in seeds.entries(seeds.CALL_TYPE_SIGNALS):
        by_type.setdefault(ct, []).append(kw)
    scores = F.array(*[F.struct(sum((F.contains(F.col("t"), F.lit(k)).cast("int") for k in kws), F.lit(0)).alias("score"),
                                F.lit(-i).alias("rank"), F.lit(ct).alias("call_type"))
                       for i, (ct, kws) in enumerate(by_type.items())])
    best = F.array_max(F.filter(scores, lambda s: s["score"] >= min_hits))
    return text.withColumn("b", F.when(F.length("t") >= 20, best)).select(
        "call_id", F.coalesce("b.call_type", F.lit("general")).alias("detected_type"),
        F.coalesce("b.score", F.lit(0)).cast("bigint").alias("score"))
