"""Call-level roll-ups: risk, score, review queue, dashboards, insights."""
from __future__ import annotations


from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parleo.functions.columns import half_up, lookup
from parleo.operators.entities import keyword_sentiment
from parleo.plans.skew import scan
from parleo.sources import seeds

LEVELS = ["low", "medium", "high", "critical"]


def weight_of(call_type: Column) -> Column:
    return F.coalesce(lookup(call_type, seeds.CALL_TYPE_WEIGHT), F.lit(1.0))


def score_calls(calls: DataFrame, checks: DataFrame) -> DataFrame:
    """Violations and fraud signals weighted by call type to risk level, score and review priority."""
    agg = checks.groupBy("call_id").agg(
        F.count_if(~F.col("passed")).alias("n_violations"), F.count_if(F.col("fraud")).alias("n_fraud"), F.count(F.lit(1)).alias("n_checks"),
        F.coalesce(F.bool_or(~F.col("passed") & (F.col("severity") == "critical")), F.lit(False)).alias("has_critical"))
    j = calls.join(agg, "call_id", "left").fillna(0, ["n_violations", "n_fraud", "n_checks"]).fillna(False, ["has_critical"])
    return with_risk(j)


def with_risk(j: DataFrame) -> DataFrame:
    w = weight_of(F.col("call_type"))
    wv, wf = F.col("n_violations") * w, F.col("n_fraud") * w
    risk = (F.when((F.col("has_critical") & (w >= 1.0)) | (wv >= 3) | (wf >= 2), "critical").when((wv >= 2) | (wf >= 1), "high")
            .when(wv >= 1, "medium").otherwise("low"))
    score = F.greatest(F.lit(0), F.lit(100) - F.col("n_violations") * F.floor(15 * w)).cast("bigint")
    j = j.withColumns({"risk": risk, "compliance_score": score})
    prio = (F.when(F.col("risk") == "critical", 1).when(F.col("risk") == "high", 2)
            .when((F.col("n_fraud") > 0) | (F.col("n_violations") > 0), 3).otherwise(5))
    return j.withColumns({"review_priority": prio.cast("bigint"), "requires_review": F.col("risk").isin("high", "critical")})


def global_stats(scored: DataFrame) -> DataFrame:
    return scored.agg(F.count(F.lit(1)).alias("total_calls"), half_up(F.sum("dur_cs") / 100, 1).alias("total_duration"),
                      half_up(F.sum("compliance_score") / F.greatest(F.count(F.lit(1)), F.lit(1)), 1).alias("avg_compliance"),
                      F.count_if("requires_review").alias("pending_reviews"))


def risk_distribution(scored: DataFrame) -> DataFrame:
    """One row with a column per level, zero where nothing falls."""
    return scored.agg(*[F.count_if(F.col("risk") == l).alias(l) for l in LEVELS])


def review_reasons(checks: DataFrame, calls: DataFrame) -> DataFrame:
    """Failed checks and fraud types (with their number), then the conditional tags.

    Names repeat far less than rows do, so they are counted before anything is
    put in a list.
    """
    bad = checks.where(~F.col("passed")).groupBy("call_id", F.col("check_name").alias("r")).agg(F.count(F.lit(1)).alias("n"))
    fr = checks.where("fraud").groupBy("call_id").agg(F.count(F.lit(1)).alias("n")).select("call_id", F.lit("unusual_quantity").alias("r"), "n")
    both = bad.withColumn("k", F.lit(0)).unionByName(fr.withColumn("k", F.lit(1)))
    lists = both.groupBy("call_id").agg(F.sort_array(F.collect_list(F.struct("k", "r", "n"))).alias("rs"))
    j = calls.join(lists, "call_id", "left")
    named = F.transform(F.coalesce("rs", F.array().cast("array<struct<k:int,r:string,n:bigint>>")), lambda x: F.concat(x["r"], F.lit("*"), x["n"].cast("string")))
    tags = F.array_compact(F.array(
        F.when(F.col("n_low_confidence") > 0, "low_confidence_transcript"), F.when(F.col("agent_toxic"), "agent_toxicity"),
        F.when(F.col("tamper_risk").isin("medium", "high"), "tamper_risk"), F.when(F.col("pii_count") > 0, F.concat(F.lit("pii_detected_"), F.col("pii_count").cast("string")))))
    return j.select("call_id", F.array_join(F.concat(named, tags), ",").alias("review_reasons"))


def topic_of(intent: Column) -> Column:
    return F.coalesce(lookup(intent, seeds.TOPICS), F.initcap(F.replace(intent, F.lit("_"), F.lit(" "))))


def discussion_topics(intents: DataFrame, min_pct: int = 2) -> DataFrame:
    """Share of each intent in a call; trivial ones count in the total but are not shown."""
    c = intents.groupBy("call_id", "intent").agg(F.count(F.lit(1)).alias("mentions"))
    total = F.sum("mentions").over(Window.partitionBy("call_id"))  # one row per intent and call
    p = c.withColumn("percentage", F.floor(F.col("mentions") * 100 / total + 0.5))
    return p.where(~F.col("intent").isin(*seeds.TRIVIAL_INTENTS) & (F.col("percentage") >= min_pct)).select(
        "call_id", topic_of(F.col("intent")).alias("topic"), "mentions", "percentage")


def topic_sentiment(intents: DataFrame) -> DataFrame:
    """Mean keyword sentiment per call and topic, from exact hundredths."""
    x = intents.where(~F.col("intent").isin(*seeds.TRIVIAL_INTENTS)).withColumn("s", F.floor(keyword_sentiment(F.col("text")) * 100 + 0.5))
    return x.groupBy("call_id", topic_of(F.col("intent")).alias("topic")).agg(half_up(F.sum("s") / (F.count(F.lit(1)) * 100.0), 2).alias("sentiment"))


def intent_counts(intents: DataFrame) -> DataFrame:
    from parleo.operators.policy import VALID_INTENTS
    return intents.groupBy("call_id", "call_type").agg(F.count(F.lit(1)).alias("n_intents"), *[F.count_if(F.col("intent") == i).alias(f"i_{i}") for i in VALID_INTENTS])


def risk_factors(intents: DataFrame, counts: DataFrame) -> DataFrame:
    """First four stated risks, then counts of complaints, escalations, disputes and a high refusal rate."""
    w = Window.partitionBy("call_id").orderBy("segment_id")
    stated = intents.where(F.col("intent") == "risk_warning").withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= 4).select(
        "call_id", F.lit("stated_risk").alias("type"), F.trim(F.substring("text", 1, 120)).alias("detail"))

    def counted(col: str, kind: str, text: str) -> Column:
        return F.when(F.col(col) > 0, F.struct(F.lit(kind).alias("type"), F.concat(F.col(col).cast("string"), F.lit(text)).alias("detail")))
    pct = F.col("i_refusal") * 100 / F.col("n_intents")
    items = F.array_compact(F.array(
        counted("i_complaint", "complaint_detected", " complaint(s) raised during call"), counted("i_escalation", "escalation_detected", " escalation event(s)"),
        counted("i_dispute", "dispute_detected", " dispute(s) identified"),
        F.when(pct > 10, F.struct(F.lit("high_refusal_rate").alias("type"), F.concat(F.lit("Refusal rate "), F.floor(pct + 0.5).cast("string"), F.lit("%")).alias("detail")))))
    return stated.unionByName(counts.select("call_id", F.explode(items).alias("x")).select("call_id", "x.type", "x.detail"))


def effectiveness(turns: DataFrame, counts: DataFrame, n_entities: DataFrame) -> DataFrame:
    """Sizes, rates and balance of a call; the balance compares the two busiest speakers."""
    from parleo.functions.columns import n_words
    sp = turns.groupBy("call_id", "speaker").agg(F.count(F.lit(1)).alias("c"), F.sum(n_words(F.col("text"))).alias("w"))
    g = sp.groupBy("call_id").agg(F.sum("c").alias("total_segments"), F.count(F.lit(1)).alias("total_speakers"), F.sum("w").alias("total_words"),
                                  F.sort_array(F.collect_list("c"), asc=False).alias("cs"))
    j = g.join(counts, "call_id", "left").join(n_entities, "call_id", "left").fillna(0, ["n_entities"])
    t = F.greatest(F.col("n_intents"), F.lit(1))

    def rate(c: Column) -> Column:
        return half_up(c * 100.0 / t, 1)
    return j.select("call_id", "call_type", "total_segments", "total_speakers", F.col("n_entities").alias("entities_extracted"), F.col("n_intents").alias("intents_classified"),
                    rate(F.col("i_unknown")).alias("unknown_rate"), rate(F.col("i_financial_disclosure")).alias("disclosure_rate"),
                    rate(F.col("i_question") + F.col("i_explanation")).alias("qa_rate"), "total_words", half_up(F.col("total_words") / F.col("total_segments"), 1).alias("avg_words"),
                    F.when(F.size("cs") >= 2, half_up(F.col("cs")[1] * 100.0 / F.col("cs")[0], 1)).otherwise(0.0).alias("speaker_balance"))


# Advice per call type: (type, intent, more than, text).
ADVICE = [
    ("collections", "payment_promise", 0, "Follow up on payment commitments made during call"),
    ("collections", "refusal", 0, "Customer expressed refusal — consider alternative resolution paths"),
    ("collections", "escalation", 0, "Escalation detected — route to senior handler"),
    ("collections", "negotiation", 0, "Negotiation activity detected — review settlement terms"),
    ("kyc onboarding", "consent_given", 0, "Consent obtained — archive for audit trail"),
    ("kyc onboarding", "consent_denied", 0, "Consent denied — escalate to compliance team"),
    ("kyc onboarding", "info_request", 2, "Multiple information requests — ensure all disclosures were completed"),
    ("complaint", "escalation", 0, "Customer requested escalation — assign to senior resolution team"),
    ("complaint", "agreement", 0, "Resolution agreed upon — confirm follow-through within SLA"),
    ("complaint", "agreement", -1, "No resolution reached — schedule follow-up within 48 hours"),
    ("general", "guidance_forecast", 0, "Forward-looking statements made — verify against subsequent filings"),
    ("general", "risk_warning", 0, "Risk factors disclosed — flag for compliance review"),
    ("general", "financial_disclosure", 5, "Heavy financial disclosure — extract and reconcile with earnings report"),
]
NO_ADVICE = "Standard call — no immediate action required"


def recommendations(counts: DataFrame, eff: DataFrame, amounts: DataFrame, orgs: DataFrame) -> DataFrame:
    """Advice by call type and intent counts, then general patterns; a default when nothing fires."""
    j = counts.join(eff.select("call_id", "total_words", "speaker_balance", "total_speakers"), "call_id").join(amounts, "call_id", "left").join(orgs, "call_id", "left").fillna(
        0, ["n_amounts", "n_orgs", "n_org_names"])

    def when(types: str, intent: str, more: int, text: str) -> Column:
        hit = F.col(f"i_{intent}") > more if more >= 0 else F.col(f"i_{intent}") == 0
        return F.when(F.col("call_type").isin(*types.split()) & hit, text)
    general = F.col("call_type") == "general"
    rules = [when(*a) for a in ADVICE]
    rules[12:12] = [F.when(general & (F.col("n_amounts") > 5), F.concat(F.col("n_amounts").cast("string"), F.lit(" financial figures discussed — cross-reference with filings")))]
    rules += [F.when(general & (F.col("n_orgs") > 3), F.concat(F.col("n_org_names").cast("string"), F.lit(" entities mentioned — verify counterparty relationships"))),
              F.when(F.col("total_words") > 5000, F.concat(F.lit("Extended call ("), F.format_number("total_words", 0), F.lit(" words) — review key decision points"))),
              F.when((F.col("speaker_balance") < 20.0) & (F.col("total_speakers") >= 2), "Highly unbalanced speaker distribution — verify all parties were heard"),
              F.when(F.col("i_info_request") / F.col("n_intents") > 0.5, "Call dominated by information requests — consider proactive disclosure")]
    got = F.array_compact(F.array(*rules))
    return j.select("call_id", F.when(F.size(got) == 0, NO_ADVICE).otherwise(F.array_join(got, " | ")).alias("recommendations"))


def apply_reviews(records: DataFrame, actions: DataFrame) -> DataFrame:
    """Latest action per call: approve clears the review flag, escalate makes it urgent."""
    last = actions.groupBy("call_id").agg(F.max_by(F.struct("action", "ts"), F.struct("ts", "event_id")).alias("a"))
    j = records.join(last, "call_id", "left")
    act = F.col("a.action")
    return j.withColumns({"review_status": act, "requires_review": F.when(act == "approve", False).otherwise(F.col("requires_review")),
                          "review_priority": F.when(act == "escalate", F.lit(1).cast("bigint")).otherwise(F.col("review_priority"))}).drop("a")


def cross_call_patterns(calls: DataFrame, failed: DataFrame) -> DataFrame:
    """Per customer: promises without later fulfilment, sentiment trend, repeated violations, consent reversals.

    ``calls`` holds customer_id, call_id, ts, promise, fulfilled, sentiment_m,
    consent, chunk (a slice of time); the order over a customer's calls is a
    scan, since one customer may own a third of them.
    """
    one = F.lit(1).cast("bigint")
    x = scan(calls, ["customer_id"], "chunk", ["ts", "call_id"], {
        "pos": ("sum", one, False), "last_fulfilled": ("all_max", F.when(F.col("fulfilled"), F.col("ts")), True), "before": ("last", F.col("consent"), False)})
    px, s = F.col("pos"), F.col("sentiment_m")
    g = x.groupBy("customer_id").agg(
        F.count(F.lit(1)).alias("n_calls"),
        F.count_if(F.col("promise") & (F.col("last_fulfilled").isNull() | (F.col("ts") >= F.col("last_fulfilled")))).alias("unfulfilled_promises"),
        F.sum(px).alias("sx"), F.sum(s).alias("sy"), F.sum(px * s).alias("sxy"), F.sum(px * px).alias("sxx"),
        F.count_if(F.col("before") & ~F.col("consent")).alias("consent_reversals"))
    den = F.col("n_calls") * F.col("sxx") - F.col("sx") * F.col("sx")
    slope = F.when(den != 0, (F.col("n_calls") * F.col("sxy") - F.col("sx") * F.col("sy")) / den)
    rep = failed.groupBy("customer_id", "check_name").agg(F.count(F.lit(1)).alias("n")).where("n > 1").groupBy("customer_id").agg(F.count(F.lit(1)).alias("repeated_violations"))
    return g.join(rep, "customer_id", "left").select(
        "customer_id", "n_calls", "unfulfilled_promises", half_up(slope, 3).alias("sentiment_slope"), F.coalesce(slope < 0, F.lit(False)).alias("worsening"),
        F.coalesce("repeated_violations", F.lit(0).cast("bigint")).alias("repeated_violations"), "consent_reversals")


def page(calls: DataFrame, limit: int = 50, offset: int = 0, after: tuple | None = None) -> DataFrame:
    """One page of calls, newest first, by offset or after the last row (ingested_at, call_id) of the page before.

    Going on after a row reads no earlier page again.  A limit outside 1 to 500 or
    a negative offset is an error; calls without a time come last.
    """
    if not 1 <= limit <= 500:
        raise ValueError("limit must be from 1 to 500")
    if offset < 0:
        raise ValueError("offset must not be negative")
    if after is not None:
        ts, call_id = F.lit(after[0]), F.lit(after[1])
        older = F.col("ingested_at").isNull() & (ts.isNotNull() | (F.col("call_id") > call_id)) | (F.col("ingested_at") < ts) | (F.col("ingested_at") == ts) & (F.col("call_id") > call_id)
        calls = calls.where(older)
    rows = calls.orderBy(F.desc_nulls_last("ingested_at"), "call_id")
    return (rows.offset(offset) if offset else rows).limit(limit)


def lookup_record(call_id: int, *places: tuple[str, DataFrame]) -> DataFrame:
    """The record of one call from the first of several named tables that has it; the id reaches every scan as a filter."""
    found = [df.where(F.col("call_id") == call_id).select("call_id", F.lit(n).alias("_n"), F.lit(name).alias("location")) for n, (name, df) in enumerate(places)]
    out = found[0]
    for d in found[1:]:
        out = out.unionByName(d)
    return out.groupBy("call_id").agg(F.min_by("location", "_n").alias("location"))
