"""Emotion and sentiment: summaries, trajectories, transitions, context."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parleo.functions.columns import half_up
from parleo.operators.turns import is_agent, is_customer
from parleo.plans.skew import scan, with_halo
from parleo.plans.stage import settle

NEGATIVE_EMOTIONS = ["angry", "fearful", "sad", "disgusted"]
POSITIVE_EMOTIONS = ["happy", "surprised"]
EMOTIONAL_TYPES = ["collections", "complaint", "kyc", "consent"]
# Emotion labels in order of matching.
EMOTION_LABELS = ["angry", "disgusted", "fearful", "happy", "neutral", "sad", "surprised", "other"]


def emotion_summary(emo: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Dominant emotion by mean score, distribution by count, escalation moments; two-level grouping."""
    per = emo.groupBy(*keys, "emotion").agg(
        F.count(F.lit(1)).alias("c"), F.sum("score_bp").alias("s"),
        F.count_if(F.col("emotion").isin("angry", "fearful") & (F.col("score_bp") > 6000)).alias("esc"))
    tot = F.aggregate("d", F.lit(0).cast("bigint"), lambda a, x: a + x["c"])
    agg = per.groupBy(*keys).agg(
        F.min_by("emotion", F.struct(-(F.col("s") / F.col("c")), F.col("emotion"))).alias("dominant"),
        F.sum("c").alias("total_segments"), F.sum("esc").alias("n_escalations"),
        F.sort_array(F.collect_list(F.struct("emotion", "c"))).alias("d"))
    share = F.transform("d", lambda x: F.concat(x["emotion"], F.lit("="), F.floor(x["c"] * 1000 / tot + 0.5).cast("string")))
    return agg.withColumn("distribution_m", F.array_join(share, ",")).drop("d")


def transitions(emo: DataFrame, keys: Sequence[str], order: Sequence[str], at: str, size: int = 4096) -> DataFrame:
    """Accepted emotion changes per speaker.

    A confident row counts if its emotion holds in the next confident row or
    its score is at least 0.7; whatever it says then becomes the state.  So the
    state before a row is the emotion of the last counting row, which a scan
    carries over chunks; no ordered group is folded in one task.
    """
    one = F.lit(1).cast("bigint")
    conf = scan(emo.where(F.col("score_bp") >= 4000), keys, "chunk", order, {"pos": ("sum", one, False), "n": ("all_sum", one, True)}).where("n >= 3")
    h = with_halo(conf.select(*keys, "pos", at, "emotion", "score_bp"), keys, "pos", 1, size)
    nxt = F.lead("emotion").over(Window.partitionBy(*keys, "_b").orderBy("pos"))
    h = h.withColumn("nxt", nxt).where("_own")
    counts = h.where((F.col("pos") == 0) | (F.col("nxt") == F.col("emotion")) | (F.col("score_bp") >= 7000))
    q = settle(counts.select(*keys, "_b", "pos", at, "emotion"))
    q = scan(q, keys, "_b", ["pos"], {"state": ("last", F.col("emotion"), False)})
    changed = settle(q.where((F.col("pos") == 0) | (F.col("state") != F.col("emotion"))))
    c = scan(changed, keys, "_b", ["pos"], {"from_at": ("last", F.col(at), False)}).where("pos > 0")
    to_neg, from_neg = F.col("emotion").isin(*NEGATIVE_EMOTIONS), F.col("state").isin(*NEGATIVE_EMOTIONS)
    sig = (F.when((F.col("state") == "neutral") & to_neg, "high").when(from_neg & F.col("emotion").isin(*POSITIVE_EMOTIONS), "medium")
           .when(to_neg & ~from_neg, "high").otherwise("low"))
    return c.select(*keys, F.col("state").alias("from_emotion"), F.col("emotion").alias("to_emotion"), F.col(at).alias("at_segment"),
                    F.col("from_at").alias("from_segment"), sig.alias("significance"))


def signed_scores(rows: DataFrame) -> DataFrame:
    """Sentiment in thousandths per role; an unknown speaker counts for both roles."""
    neutral = F.greatest(F.lit(20), F.floor((1000 - F.col("score_m")) * 0.3 + 0.5))
    s = F.when(F.col("label") == "positive", F.col("score_m")).when(F.col("label") == "negative", -F.col("score_m")).otherwise(neutral)
    roles = F.when(is_agent(F.col("speaker")), F.array(F.lit("agent"))).when(is_customer(F.col("speaker")), F.array(F.lit("customer"))).otherwise(
        F.array(F.lit("customer"), F.lit("agent")))
    return rows.withColumn("signed_m", s.cast("bigint")).withColumn("role", F.explode(roles))


def trajectory(signed: DataFrame, order: Sequence[str]) -> DataFrame:
    """Ordinal of every score inside the call and role: the trajectory as rows, however long."""
    one = F.lit(1).cast("bigint")
    return scan(signed, ["call_id", "role"], "chunk", order, {"ordinal": ("sum", one, False), "n": ("all_sum", one, True)})


def zip_trajectories(traj: DataFrame) -> DataFrame:
    """Customer and agent scores side by side; the shorter side ends in nulls."""
    c = traj.where("role = 'customer'").select("call_id", "ordinal", F.col("signed_m").alias("customer_m"))
    a = traj.where("role = 'agent'").select("call_id", "ordinal", F.col("signed_m").alias("agent_m"))
    return c.join(a, ["call_id", "ordinal"], "full_outer")


def trend(traj: DataFrame, role: str = "customer") -> DataFrame:
    """Second half against first half of the trajectory, and the escalation risk that follows."""
    t = traj.where(F.col("role") == role)
    half = F.floor(F.col("n") / 2)
    first = F.col("ordinal") < half
    s = F.col("signed_m")
    g = t.groupBy("call_id").agg(F.count(F.lit(1)).alias("n"), F.sum(s).alias("tot"), F.sum(F.when(first, s)).alias("s1"), F.count_if(first).alias("n1"),
                                 F.sum(F.when(~first, s)).alias("s2"), F.count_if(~first).alias("n2"))
    second = F.col("s2") / (F.col("n2") * 1000)
    delta = second - F.col("s1") / (F.col("n1") * 1000)
    avg = F.col("tot") / (F.col("n") * 1000)
    long = F.when((delta < -0.3) & (second < -0.3), "high").when(delta < -0.15, "medium").otherwise("low")
    risk = F.when(F.col("n") >= 4, long).otherwise(F.when(avg < -0.4, "medium").otherwise("low"))
    return g.select("call_id", "n", half_up(avg, 4).alias("mean"), half_up(F.when(F.col("n") >= 4, delta), 4).alias("trend"), risk.alias("escalation_risk"))


def dominant_from_mean(avg: Column) -> Column:
    return F.when(avg > 0.3, "positive").when(avg < -0.5, "angry").when(avg < -0.3, "frustrated").otherwise("neutral")


def sentiment_context(traj: DataFrame, call_type: Column) -> DataFrame:
    """Sentiment type of both sides, whether somebody should act, and the escalation risk."""
    m = traj.groupBy("call_id").agg(
        *[F.coalesce(F.sum(F.when(F.col("role") == r, F.col("signed_m"))) / (F.count_if(F.col("role") == r) * 1000), F.lit(0.0)).alias(f"{r}_avg")
          for r in ("customer", "agent")])
    emotional = call_type.isin(*EMOTIONAL_TYPES)

    def kind(avg: Column, customer: bool) -> Column:
        low = F.when(emotional, "emotional_negative").otherwise("financial_negative") if customer else F.lit("financial_negative")
        return F.when(avg > 0.2, "positive").when(avg > -0.2, "neutral").otherwise(low)

    ct, at = kind(F.col("customer_avg"), True), kind(F.col("agent_avg"), False)
    act = (ct == "emotional_negative") | (at.isin("emotional_negative", "financial_negative") & (F.col("agent_avg") < -0.4))
    j = m.join(trend(traj).select("call_id", "escalation_risk"), "call_id", "left")
    return j.select("call_id", ct.alias("customer_sentiment_type"), at.alias("agent_sentiment_type"), act.alias("actionable"),
                    F.coalesce("escalation_risk", F.lit("low")).alias("escalation_risk"))


def parse_emotion(labels: Column, scores: Column) -> Column:
    """Model labels and scores to (emotion, score, low_confidence); scores in thousandths.

    Weak or unclassifiable results fall back to neutral.  Of equal scores the
    first label wins.
    """
    def clean(l):
        base = F.lower(F.trim(F.regexp_replace(l, "^/+|/+$", "")))
        e = None
        for x in EMOTION_LABELS:
            e = F.when(F.contains(base, F.lit(x)), x) if e is None else e.when(F.contains(base, F.lit(x)), x)
        return e.otherwise(base)
    named = F.zip_with(labels, scores, lambda l, s: F.struct(s.alias("s"), clean(l).alias("e")))
    ranked = F.transform(named, lambda x, i: F.struct(x["s"].alias("s"), (-i).alias("i"), x["e"].alias("e")))
    top = F.array_max(ranked)
    neutral = F.array_max(F.transform(F.filter(named, lambda x: x["e"] == "neutral"), lambda x: x["s"]))
    low = (top["s"] < 400) | (top["e"] == "other")
    return F.struct(F.when(low, "neutral").otherwise(top["e"]).alias("emotion"), F.when(low, F.coalesce(neutral, top["s"])).otherwise(top["s"]).alias("score_m"),
                    low.alias("low_confidence"))


def label_windows(emo: DataFrame, order: Sequence[str], labels: Sequence[str], n_windows: int = 30) -> DataFrame:
    """Percent of each label in count-based windows of max(1, n div 30) rows."""
    one = F.lit(1).cast("bigint")
    p = scan(emo, ["call_id"], "chunk", order, {"pos": ("sum", one, False), "n": ("all_sum", one, True)})
    size = F.greatest(F.lit(1), F.floor(F.col("n") / n_windows))
    return p.groupBy("call_id", (F.floor(F.col("pos") / size) + 1).alias("window_no")).agg(
        *[F.floor(F.count_if(F.col("emotion") == l) * 100 / F.count(F.lit(1)) + 0.5).alias(f"pct_{l}") for l in labels])
