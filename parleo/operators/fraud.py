"""Fraud signals: scam phrases, voice stress, emotion fusion, incongruent answers."""
from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parleo.functions.columns import any_contains, constant, half_up
from parleo.operators.compliance import conduct_agent
from parleo.operators.matching import first_turn_of, running_table_hits
from parleo.plans.skew import attach, with_halo
from parleo.plans.stage import settle
from parleo.sources import seeds
from parleo.sources.vocab import seed_vocab

# Category, signal, hits needed, base and step and cap of the confidence, phrases shown, description.
# In a description {phrases} are the phrases shown and {n} is the number of hits.
SCAM_RULES = [
    ("remote_access_tools", "remote_access_request", 1, 0.85, 0.0, 0.85, 1, "Remote access tool request detected: '{phrases}'. Common in tech support scams."),
    ("urgency_pressure", "urgency_pressure", 2, 0.5, 0.1, 0.9, 5, "Multiple urgency/pressure phrases ({n}): {phrases}."),
    ("credential_requests", "credential_request", 1, 0.75, 0.0, 0.75, 1, "Credential/access request detected: '{phrases}'."),
    ("authority_impersonation", "authority_impersonation", 1, 0.80, 0.0, 0.80, 1, "Authority impersonation detected: '{phrases}'. Scammers impersonate government agencies."),
    ("vague_identity", "vague_identity", 1, 0.6, 0.0, 0.6, 1, "Vague organizational identity: '{phrases}'. Legitimate callers identify specifically."),
    ("financial_threats", "financial_threat", 1, 0.6, 0.1, 0.9, 3, "Financial threats detected: {phrases}."),
    ("social_engineering", "social_engineering", 2, 0.5, 0.1, 0.85, 3, "Social engineering patterns ({n}): {phrases}."),
]
RULE_FIELDS = "category:string,signal:string,need:int,base:double,step:double,cap:double,show:int,said:string"


def scam_signals(seg: DataFrame, indicators: DataFrame | None = None) -> DataFrame:
    """Scam rules over the whole text of a call; a phrase counts once per call.

    ``indicators`` is any table of phrases (domain, category, phrase, rank), such as
    ``read_indicators_json`` gives; without one the built-in lists count.  Rows of
    other domains and of categories without a rule give nothing.
    """
    table = seed_vocab(seg.sparkSession) if indicators is None else indicators
    known = [r[0] for r in SCAM_RULES]
    table = table.where((F.col("domain") == "scam") & F.col("category").isin(known) & (F.trim("phrase") != ""))
    hits = running_table_hits(seg, table)
    per = hits.groupBy("call_id", "category").agg(
        F.count(F.lit(1)).alias("n_hits"), F.sort_array(F.collect_list(F.struct("rank", "phrase"))).alias("ps"))
    rules = constant([dict(zip([f.split(":")[0] for f in RULE_FIELDS.split(",")], r)) for r in SCAM_RULES], RULE_FIELDS)
    per = per.withColumn("r", F.filter(rules, lambda r: r["category"] == F.col("category"))[0]).where(F.col("n_hits") >= F.col("r.need"))
    conf = half_up(F.least(F.col("r.cap"), F.col("r.base") + F.col("n_hits") * F.col("r.step")), 4)
    shown = F.array_join(F.transform(F.slice("ps", 1, F.col("r.show")), lambda s: s["phrase"]), ", ")
    per = per.withColumn("phrases", shown)
    said = F.replace(F.replace(F.col("r.said"), F.lit("{n}"), F.col("n_hits").cast("string")), F.lit("{phrases}"), F.col("phrases"))
    out = settle(per.select("call_id", F.col("r.signal").alias("signal_type"), "n_hits", conf.alias("confidence"), "phrases",
                            F.col("ps")[0]["phrase"].alias("phrase"), said.alias("description")))
    remote = out.where("signal_type = 'remote_access_request'").select("call_id", "phrase")
    first = first_turn_of(seg, remote).withColumn("signal_type", F.lit("remote_access_request"))
    return out.join(first, ["call_id", "phrase", "signal_type"], "left").withColumn(
        "segment_id", F.coalesce("first_segment", F.lit(0).cast("bigint"))).drop("first_segment", "phrase")


def calm_baseline(feat: DataFrame, early_ds: int = 900, span_ds: int = 300) -> DataFrame:
    """Per speaker the calmest forward window of the first part of the call.

    Only rows of the first ``early_ds`` enter a window, so the ordered group is
    bounded by call time, not by the length of the call.
    """
    keys = ["call_id", "speaker"]
    n = feat.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("start_ds") < early_ds).alias("n_early")).where("n >= 3")
    firsts = Window.partitionBy(*keys).orderBy("start_ds", "segment_id")
    first3 = feat.withColumn("rn", F.row_number().over(firsts)).where(F.col("rn") <= 3).drop("rn")
    early = feat.where(F.col("start_ds") < early_ds)
    cand = early.join(n.where("n_early >= 2"), keys).unionByName(first3.join(n.where("n_early < 2"), keys))

    def means(over: Window | None) -> list[Column]:
        cols = {"b_pitch": F.when(F.col("pitch") > 0, F.col("pitch")), "b_pitch_sd": F.col("pitch_sd"),
                "b_jitter": F.col("jitter"), "b_shimmer": F.col("shimmer"), "b_hnr": F.col("hnr")}
        return [(F.avg(c).over(over) if over is not None else F.avg(c)).alias(k) for k, c in cols.items()]

    w = Window.partitionBy(*keys).orderBy("start_ds").rangeBetween(0, span_ds - 1)
    win = cand.select(*keys, "start_ds", "segment_id", F.count(F.lit(1)).over(w).alias("nw"), *means(w)).where("nw >= 2")
    best = win.groupBy(*keys).agg(F.min_by(F.struct("b_pitch", "b_pitch_sd", "b_jitter", "b_shimmer", "b_hnr"),
                                           F.struct(F.col("b_jitter") + F.col("b_shimmer"), "start_ds", "segment_id")).alias("b"))
    plain = first3.groupBy(*keys).agg(F.struct(*means(None)).alias("p"))
    j = n.join(best, keys, "left").join(plain, keys).withColumn("c", F.coalesce("b", "p"))
    return j.select(*keys, "n", "c.b_pitch", "c.b_pitch_sd", "c.b_jitter", "c.b_shimmer", "c.b_hnr")


def voice_stress(feat: DataFrame, baseline: DataFrame, limit: float = 1.5) -> DataFrame:
    """Mean positive deviation from the speaker's calm baseline; above the limit it is a signal."""
    f = attach(feat, baseline, ["call_id", "speaker"], "chunk")
    zero = F.lit(0.0)
    dev = [F.greatest(zero, (F.col("pitch") - F.col("b_pitch")) / F.greatest(F.col("b_pitch_sd"), F.lit(10.0))),
           F.greatest(zero, F.col("jitter") / F.col("b_jitter") - 1), F.greatest(zero, F.col("shimmer") / F.col("b_shimmer") - 1),
           F.greatest(zero, (F.col("b_hnr") - F.col("hnr")) / F.greatest(F.col("b_hnr"), F.lit(1.0)))]
    score = (dev[0] + dev[1] + dev[2] + dev[3]) / 4 + 1.0
    return f.withColumn("stress", score).where(F.col("stress") > limit).select(
        "call_id", "segment_id", "speaker", half_up(F.col("stress"), 4).alias("stress"),
        half_up(F.least(F.lit(0.9), F.col("stress") / 3), 4).alias("confidence"))


def emotion_diversity(emo: DataFrame) -> DataFrame:
    """Entropy of emotions over its maximum; one half below two rows, zero for a single emotion."""
    c = emo.groupBy("call_id", "emotion").agg(F.count(F.lit(1)).alias("c"))
    per = c.groupBy("call_id").agg(F.sum("c").alias("n"), F.count(F.lit(1)).alias("k"), F.sum(F.col("c") * F.log2("c")).alias("s"))
    ent = F.log2("n") - F.col("s") / F.col("n")
    d = F.when(F.col("n") < 2, 0.5).when(F.col("k") <= 1, 0.0).otherwise(ent / F.log2("k"))
    return per.select("call_id", F.col("n").alias("n_rows"), F.col("k").alias("n_emotions"), half_up(d, 6).alias("diversity"))


def fuse_with_emotions(signals: DataFrame, emo: DataFrame, diversity: DataFrame) -> DataFrame:
    """Reweigh stress by the emotion of the turn and coached speech by the variety of emotions."""
    e = emo.select("call_id", "chunk", "segment_id", "emotion")
    j = attach(signals.join(e, ["call_id", "chunk", "segment_id"], "left"), diversity.select("call_id", "diversity"), ["call_id"], "chunk", "left")
    c, d = F.col("confidence"), F.coalesce("diversity", F.lit(0.5))
    stress = F.when(F.col("emotion").isin("angry", "anger"), c * 0.6).when(
        F.col("emotion").isin("neutral", "fearful", "fear", "sad"), c * 1.3).otherwise(c)
    coached = F.when(d < 0.25, c * 1.25).when(d > 0.5, c * 0.5).otherwise(c)
    new = F.when(F.col("signal_type") == "voice_stress_anomaly", stress).when(F.col("signal_type") == "coached_speech", coached).otherwise(c)
    return j.select("call_id", "segment_id", "signal_type", half_up(F.greatest(F.lit(0.0), F.least(F.lit(1.0), new)), 4).alias("confidence"))


def emotional_incongruence(seg: DataFrame, emo: DataFrame, size: int = 4096) -> DataFrame:
    """Fear or surprise in the customer's first answer (within two turns) to a verification question."""
    e = emo.select("call_id", "chunk", "segment_id", "emotion", "score_bp", "fear_bp", "surprise_bp")
    t = seg.select("call_id", "chunk", "segment_id", "speaker", F.lower("text").alias("t")).join(e, ["call_id", "chunk", "segment_id"], "left")
    t = t.withColumn("asks", conduct_agent(F.col("speaker")) & any_contains(F.col("t"), seeds.VERIFICATION)).drop("t", "chunk")
    me = F.struct("segment_id", F.lower("speaker").isin("customer", "speaker_01").alias("cust"), "emotion", "score_bp", "fear_bp", "surprise_bp")
    h = with_halo(t.withColumn("me", me), ["call_id"], "segment_id", 2, size)
    w = Window.partitionBy("call_id", "_b").orderBy("segment_id")
    n1, n2 = F.lead("me", 1).over(w), F.lead("me", 2).over(w)
    h = h.withColumns({"n1": n1, "n2": n2}).where(F.col("_own") & F.col("asks"))
    r = h.withColumn("r", F.when(F.col("n1.cust"), F.col("n1")).when(F.col("n2.cust"), F.col("n2"))).where(
        F.col("r.emotion").isNotNull())
    odd = ((F.col("r.emotion").isin("fearful", "fear") & (F.col("r.score_bp") > 5000)) |
           (F.col("r.emotion").isin("surprised", "surprise") & (F.col("r.score_bp") > 6000)) |
           (F.col("r.fear_bp") > 5000) | (F.col("r.surprise_bp") > 6000))
    conf = F.least(F.lit(0.85), F.greatest("r.fear_bp", "r.surprise_bp") / 10000)
    return r.where(odd).select("call_id", F.col("segment_id").alias("question_segment"), F.col("r.segment_id").alias("segment_id"),
                               F.col("r.emotion").alias("emotion"), half_up(conf, 4).alias("confidence"))


def union_signals(*parts: DataFrame) -> DataFrame:
    """Detectors side by side: call, turn, type and confidence."""
    cols = ["call_id", "segment_id", "signal_type", "confidence"]
    return reduce(DataFrame.unionByName, [p.select(*cols) for p in parts])
