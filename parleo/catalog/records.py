"""Queries that build, write, read and export call records."""
from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import functions as F

from parleo.catalog.affect import INTENTS, seg_intents, summary_sql
from parleo.catalog.base import *  # noqa: F403
from parleo.catalog.conduct import A49, ALLCHECKS
from parleo.catalog.dashboard import POBL, W
from parleo.catalog.entities import pii_cte
from parleo.catalog.series import TAMP, _tamper as tamper_signals
from parleo.functions.columns import half_up
from parleo.operators import compliance as comp
from parleo.operators import emotion as emo
from parleo.operators import entities as ent
from parleo.operators import fraud, policy, records, rollup
from parleo.operators import obligations as obl
from parleo.operators import series as ser
from parleo.operators import turns as op
from parleo.plans.skew import chunk_rows
from parleo.plans.stage import settle
from parleo.sources import sinks, tables, vocab
from parleo.sources.tables import segments


def children_of(seg) -> dict:
    """Child tables of the calls, one row per child."""
    checks = settle(comp.all_checks(seg, vocab.seed_vocab(seg.sparkSession)))
    return {"intents": seg_intents(seg).withColumn("confidence", half_up(F.col("confidence"), 2)), "checks": checks, "signals": settle(fraud.scam_signals(seg)),
            "obligations": obl.obligations(seg, F.col("lang"))}


# Stand-ins for the seven scores of a toxicity model, in thousandths.
SCORES = {"toxicity": (7919, 31, 1001), "severe_toxicity": (31, 7, 601), "obscene": (13, 3, 801), "identity_attack": (17, 5, 751), "insult": (19, 11, 901), "threat": (23, 13, 851), "sexual_explicit": (29, 3, 721)}


def call_headers(seg, kids, tamper):
    """One row per call: header fields and numbers of children.

    What belongs to a turn is counted in its row, and only the counts are
    grouped; no child is nested and no text leaves its row for it.  Where the
    entities are listed for the records anyway, the list is counted.
    """
    scores = {k: (F.col("conv_id") * a + F.col("turn") * b) % m for k, (a, b, m) in SCORES.items()}
    toxic = reduce(or_, [scores[k] >= least for k, least in policy.TOXIC])
    listed = kids.get("entities")
    x, found = (seg, F.array()) if listed is not None else ent.entity_arrays(seg, F.col("lang"))
    own = x.select("call_id", "call_type", F.size(found).alias("n_ent"), F.size(ent.pii_spans(F.coalesce("text", F.lit("")))).alias("n_pii"), toxic.cast("int").alias("tox"), ((F.col("conv_id") * 1777 + F.col("turn") * 911) % 1001).alias("conf_m"))
    turns = own.groupBy("call_id").agg(F.count(F.lit(1)).alias("num_segments"), F.sum("n_ent").alias("num_entities"), F.sum("n_pii").alias("pii_count"), F.sum("tox").alias("num_toxicity_flags"),
                                       half_up(F.sum("conf_m") / (F.count(F.lit(1)) * 1000.0), 3).alias("overall_transcript_confidence"))
    intents = kids["intents"].groupBy("call_id").agg(F.count(F.lit(1)).alias("num_intents"), F.count_if(F.col("intent") == "payment_promise").alias("num_promises"), F.bool_or(F.col("intent") == "escalation").alias("by_intent"))
    promised = kids["obligations"].groupBy("call_id").agg(F.count(F.lit(1)).alias("num_obligations"), F.count_if(F.col("strength") == "binding").alias("num_binding_obligations"))
    bad = kids["checks"].groupBy("call_id").agg(F.count(F.lit(1)).alias("num_compliance_checks"), F.count_if(~F.col("passed")).alias("n_violations"), F.count_if(~F.col("passed") & (F.col("severity") == "critical")).alias("num_critical_violations"))
    signals = kids["signals"].groupBy("call_id").agg(F.count(F.lit(1)).alias("n_fraud"))
    mood = emo.emotion_summary(tables.segment_emotions(seg), ["call_id"]).select("call_id", F.col("dominant").alias("customer_emotion_dominant"))
    mix = op.language_mix(seg, "call_id").select("call_id", F.col("primary_language").alias("detected_language"), "has_code_switching")
    speakers = op.speaker_counts(seg).select("call_id", F.col("n_speakers").alias("num_speakers"))
    if listed is not None:
        turns = turns.drop("num_entities").join(listed.groupBy("call_id").agg(F.count(F.lit(1)).alias("num_entities")), "call_id", "left").fillna(0, ["num_entities"])
    h = op.talk_shares(seg).join(turns, "call_id").join(mix, "call_id")
    for d in (intents, promised, bad, signals, mood, speakers, tamper.select("call_id", "tamper_risk")):
        h = h.join(d, "call_id", "left")
    h = h.fillna(0, ["num_intents", "num_promises", "num_obligations", "num_binding_obligations", "num_compliance_checks", "n_violations", "num_critical_violations", "n_fraud", "num_speakers"]).fillna(False, ["by_intent"]).fillna("none", ["tamper_risk"])
    h = rollup.with_risk(h.withColumn("has_critical", F.col("num_critical_violations") > 0))
    cid = F.col("call_id").cast("string")
    score = 40 + F.col("call_id") * 7 % 60  # of the audio front end, as is the noise ratio
    return h.withColumns({
        "audio_file": F.concat(F.lit("calls/2024/call_"), cid, F.lit(".wav")), "duration_seconds": F.col("total_ds") / 10, "language": F.col("detected_language"), "audio_quality_score": score,
        "snr_db": half_up(score / F.lit(3.0), 1), "agent_talk_percentage": F.col("agent_pct"), "customer_talk_percentage": F.col("customer_pct"), "overall_risk_level": F.col("risk"),
        "requires_human_review": F.col("requires_review"), "escalation_detected": F.col("by_intent") | F.coalesce(F.col("customer_emotion_dominant").isin("angry", "frustrated"), F.lit(False)),
        "num_compliance_violations": F.col("n_violations"), "num_fraud_signals": F.col("n_fraud"), "call_summary": F.concat(F.lit("Call "), cid, F.lit(" of type "), "call_type", F.lit(": "), F.repeat(F.lit("summary "), 40))})


def flat_calls(spark, sf):
    seg = settle(segments(spark, sf))
    return records.flat_row(call_headers(seg, children_of(seg), ser.tamper_risk(tamper_signals(spark, sf))))


def call_records(spark, sf):
    """All stages on the scripted turns, put together as nested records."""
    seg = settle(segments(spark, sf))
    # header and record both read the children: each is worked out once and written
    kids = children_of(seg) | {"entities": ent.entities(seg, ["call_id", "segment_id"], F.col("lang"))}
    kids["intents"] = kids["intents"].select("call_id", "segment_id", "speaker", "intent", "confidence")
    kids |= {k: settle(kids[k]) for k in ("intents", "entities", "obligations")}
    return records.build(seg, call_headers(seg, kids, ser.tamper_risk(tamper_signals(spark, sf))), kids["intents"], kids["entities"], kids["checks"], kids["signals"], chunk_rows(spark), kids["obligations"])


_TOXIC = " OR ".join(f"(conv_id * {SCORES[k][0]} + turn * {SCORES[k][1]}) % {SCORES[k][2]} >= {least}" for k, least in policy.TOXIC)
RECS = f"""{INTENTS}, {POBL}, {ALLCHECKS}, {A49}, {EMO}, {summary_sql('emo', 'call_id')}, {pii_cte('seg', 'call_id, segment_id')}, {TAMP},
ni AS (SELECT call_id, count(*) AS num_intents, count(*) FILTER (WHERE intent = 'payment_promise') AS num_promises, bool_or(intent = 'escalation') AS by_intent FROM intents GROUP BY 1), nen AS (SELECT call_id, count(*) AS num_entities FROM ents GROUP BY 1),
nc AS (SELECT call_id, count(*) AS num_compliance_checks, count(*) FILTER (WHERE NOT passed) AS nv, count(*) FILTER (WHERE NOT passed AND severity = 'critical') AS ncr FROM allc GROUP BY 1), nf AS (SELECT call_id, count(*) AS num_fraud_signals FROM f49 GROUP BY 1),
nob AS (SELECT call_id, count(*) AS num_obligations, count(*) FILTER (WHERE strength = 'binding') AS num_binding_obligations FROM obls GROUP BY 1), npi AS (SELECT call_id, count(*) AS pii_count FROM pii GROUP BY 1),
tmp AS (SELECT call_id, CASE WHEN n_types >= 3 AND n_high >= 2 THEN 'high' WHEN n_types >= 2 AND (n_high >= 1 OR n_signals >= 4) THEN 'medium' ELSE 'low' END AS tamper_risk FROM (SELECT call_id, count(DISTINCT signal_type) AS n_types, count(*) FILTER (WHERE severity = 'high') AS n_high, count(*) AS n_signals FROM tp GROUP BY 1)),
lm0 AS (SELECT call_id, CASE WHEN length(trim(text, ' ')) < 15 THEN 'en' ELSE lang END AS l, count(*) AS n FROM seg GROUP BY ALL), lm AS (SELECT call_id, arg_max(l, struct_pack(n := n, l := l)) AS primary_language, (sum(n) - max(n)) / sum(n) > 0.10 AS has_code_switching FROM lm0 GROUP BY 1),
cc AS (SELECT call_id, min(call_type) AS call_type, count(*) AS num_segments, count(DISTINCT speaker) AS num_speakers, count(*) FILTER (WHERE {_TOXIC}) AS num_toxicity_flags, {hu('sum((conv_id * 1777 + turn * 911) % 1001) / (count(*) * 1000e0)', 3)} AS transcript_confidence, {W} AS w FROM seg GROUP BY 1, call_type),
rr AS (SELECT cc.*, primary_language, has_code_switching, coalesce(by_intent, false) OR coalesce(dominant IN ('angry', 'frustrated'), false) AS escalation_detected, coalesce(tamper_risk, 'none') AS tamper_risk, coalesce(pii_count, 0) AS pii_count, coalesce(num_obligations, 0) AS num_obligations, coalesce(num_binding_obligations, 0) AS num_binding_obligations,
 coalesce(num_intents, 0) AS num_intents, coalesce(num_promises, 0) AS num_promises, coalesce(num_entities, 0) AS num_entities, coalesce(num_compliance_checks, 0) AS num_compliance_checks, coalesce(nv, 0) AS nv, coalesce(ncr, 0) AS ncr, coalesce(num_fraud_signals, 0) AS nfs, total_ds, agent_ds, customer_ds, dominant
 FROM cc JOIN lm USING (call_id) LEFT JOIN ni USING (call_id) LEFT JOIN nen USING (call_id) LEFT JOIN nc USING (call_id) LEFT JOIN nf USING (call_id) LEFT JOIN nob USING (call_id) LEFT JOIN npi USING (call_id) LEFT JOIN tmp USING (call_id) JOIN sh USING (call_id) LEFT JOIN es2 USING (call_id)),
rk AS (SELECT *, CASE WHEN (ncr > 0 AND w >= 1) OR nv * w >= 3 OR nfs * w >= 2 THEN 'critical' WHEN nv * w >= 2 OR nfs * w >= 1 THEN 'high' WHEN nv * w >= 1 THEN 'medium' ELSE 'low' END AS risk FROM rr),
flat AS (SELECT call_id, 'call_' || call_id || '.wav' AS audio_file, total_ds / 10e0 AS duration_sec, primary_language AS language, has_code_switching, call_type, 40 + call_id * 7 % 60 AS audio_quality_score,
 CASE WHEN 40 + call_id * 7 % 60 >= 70 THEN 'TRUSTWORTHY' WHEN 40 + call_id * 7 % 60 >= 40 THEN 'DEGRADED' ELSE 'UNRELIABLE' END AS audio_quality_flag, {hu('(40 + call_id * 7 % 60) / 3e0', 1)} AS snr_db, transcript_confidence, num_speakers, {hu('agent_ds * 10e0 / greatest(total_ds / 10e0, 0.01e0)', 1)} AS agent_talk_pct, {hu('customer_ds * 10e0 / greatest(total_ds / 10e0, 0.01e0)', 1)} AS customer_talk_pct,
 pii_count, num_toxicity_flags, tamper_risk, CAST(greatest(0, 100 - nv * floor(15 * w)) AS BIGINT) AS compliance_score, risk AS risk_level, dominant AS customer_emotion, escalation_detected, risk IN ('high', 'critical') AS requires_review,
 CASE WHEN risk = 'critical' THEN 1 WHEN risk = 'high' THEN 2 WHEN nfs > 0 OR nv > 0 THEN 3 ELSE 5 END AS review_priority, left('Call ' || call_id || ' of type ' || call_type || ': ' || repeat('summary ', 40), 200) AS call_summary,
 num_segments, num_intents, num_entities, num_obligations, num_binding_obligations, num_compliance_checks, nv AS num_compliance_violations, ncr AS num_critical_violations, nfs AS num_fraud_signals, num_promises FROM rk)"""


@query("P1_flat_record", f"WITH {SEG}, {RECS} SELECT * FROM flat")
def p1(spark, sf):
    return flat_calls(spark, sf)


@query("S2_record_sink", f"WITH {SEG}, {RECS} SELECT call_type, count(*) AS n_calls, CAST(sum(num_segments) AS BIGINT) AS n_segments, CAST(sum(num_compliance_checks) AS BIGINT) AS n_checks FROM flat GROUP BY 1")
def s2(spark, sf):
    path = records.write(call_records(spark, sf), sinks.work_path(spark, "records"), "parquet")
    r = spark.read.parquet(path)
    return r.groupBy("call_type").agg(F.count_distinct("call_id").alias("n_calls"), F.sum(F.size("transcript_segments")).alias("n_segments"), F.sum(F.size("compliance_checks")).alias("n_checks"))


@query("S1_record_scan", f"WITH {SEG}, {RECS} SELECT 'good' AS kind, count(*) AS n_calls, CAST(sum(num_intents) AS BIGINT) AS n_intents, CAST(sum(num_entities) AS BIGINT) AS n_entities FROM flat UNION ALL SELECT 'quarantine', count(*), 0, 0 FROM (SELECT DISTINCT call_id FROM seg WHERE call_id % 4 = 1)")
def s1(spark, sf):
    """JSON records read back with a fixed schema; damaged lines (written for a quarter of the calls) go to quarantine."""
    path = sinks.work_path(spark, "scan")
    rec = settle(call_records(spark, sf))
    records.write(rec, path)
    rec.where(F.col("call_id") % 4 == 1).select("call_id").distinct().select(F.concat(F.lit('{"call_id": '), F.col("call_id").cast("string"), F.lit(', "call_type": "ky'))).write.mode("append").text(path + "/type=broken")
    good, bad = records.scan(spark, path)
    zero = F.lit(0).cast("bigint")
    g = good.select("call_id", "intents", "financial_entities").agg(F.count_distinct("call_id").alias("n_calls"), F.sum(F.size("intents")).alias("n_intents"), F.sum(F.size("financial_entities")).alias("n_entities"))
    # count the quarantined rows through a written copy: a scan may not be asked for the corrupt column alone
    b = settle(bad).agg(F.count(F.lit(1)).alias("n_calls")).select("n_calls", zero.alias("n_intents"), zero.alias("n_entities"))
    return g.select(F.lit("good").alias("kind"), "*").unionByName(b.select(F.lit("quarantine").alias("kind"), "*"))


def _back(spark, sf, fmt):
    flat = flat_calls(spark, sf)
    path = sinks.export(flat, fmt, sinks.work_path(spark, fmt))
    if fmt == "csv":
        return spark.read.option("header", True).option("escape", '"').schema(flat.schema).csv(path)
    return spark.read.parquet(path)


@query("S8_csv_export", f"WITH {SEG}, {RECS} SELECT call_id, audio_file, risk_level, compliance_score, num_segments, requires_review, call_summary FROM flat")
def s8(spark, sf):
    return _back(spark, sf, "csv").select("call_id", "audio_file", "risk_level", "compliance_score", "num_segments", "requires_review", "call_summary")


@query("S9_parquet_export", f"WITH {SEG}, {RECS} SELECT * FROM flat")
def s9(spark, sf):
    return _back(spark, sf, "parquet")


@query("S10_jsonl_export", f"WITH {SEG}, {RECS}, am AS (SELECT call_id, sum(amount) AS promised FROM obls GROUP BY 1) SELECT call_id, num_segments, num_intents, num_obligations, coalesce(promised, 0e0) AS promised FROM flat LEFT JOIN am USING (call_id)")
def s10(spark, sf):
    path = sinks.export(call_records(spark, sf), "jsonl", sinks.work_path(spark, "jsonl"))
    good, _ = records.scan(spark, path)
    amounts = F.aggregate("obligations", F.lit(0.0), lambda a, o: a + F.coalesce(o["amount"]["value"], F.lit(0.0)))
    return good.groupBy("call_id").agg(F.sum(F.size("transcript_segments")).alias("num_segments"), F.sum(F.size("intents")).alias("num_intents"), F.sum(F.size("obligations")).alias("num_obligations"), F.sum(amounts).alias("promised"))


def child_outputs(rec, seg_text):
    return {"entities": records.children(rec, "financial_entities"), "compliance": records.children(rec, "compliance_checks"),
            "intents": records.children(rec, "intents").join(seg_text, ["call_id", "segment_id"], "left").fillna("", ["text"])}


def _texts(rec):
    return records.children(rec, "transcript_segments").select("call_id", F.col("id").alias("segment_id"), "text")


@query("S11_child_exports", f"WITH {SEG}, {RECS} SELECT 'entities' AS output, call_id, count(*) AS n FROM ents GROUP BY 2 UNION ALL SELECT 'compliance', call_id, count(*) FROM allc GROUP BY 2 UNION ALL SELECT 'intents', call_id, count(*) FROM intents GROUP BY 2")
def s11(spark, sf):
    rec = settle(call_records(spark, sf))
    out = None
    for name, df in child_outputs(rec, _texts(rec)).items():
        path = sinks.export(df, "csv", sinks.work_path(spark, name))
        # texts may hold line breaks, so rows are read back as whole CSV records
        back = spark.read.option("header", True).option("multiLine", True).option("escape", '"').schema(df.schema).csv(path)
        n = back.groupBy("call_id").agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("output"), "call_id", "n")
        out = n if out is None else out.unionByName(n)
    return out


def all_outputs(rec):
    """The nine outputs of an export, from one settled set of records."""
    t = _texts(rec)
    flat = records.flatten(rec)
    kids = child_outputs(rec, t)
    pairs = kids["intents"].where(F.trim("text") != "").select("text", F.col("intent").alias("label"), "speaker", "confidence", "call_id")
    ner = kids["entities"].join(t, ["call_id", "segment_id"]).select("call_id", "segment_id", "text", "entity_type", "value")
    sent = t.where(F.length(F.trim("text")) >= 5).select("call_id", "segment_id", "text", ent.keyword_sentiment(F.col("text")).alias("score"))
    return {"call_summary": (flat, "csv"), "entities": (kids["entities"], "csv"), "intents": (kids["intents"], "csv"), "compliance": (kids["compliance"], "csv"), "calls_parquet": (flat, "parquet"),
            "calls_jsonl": (rec, "jsonl"), "training_intents": (pairs, "jsonl"), "training_sentiment": (sent.where("score <> 0"), "jsonl"), "training_entities": (ner, "jsonl")}


@query("S12_export_all", f"WITH {SEG}, {RECS} SELECT unnest(['call_summary', 'entities', 'intents', 'compliance', 'calls_parquet', 'calls_jsonl', 'training_intents', 'training_sentiment', 'training_entities']) AS name, unnest(['csv', 'csv', 'csv', 'csv', 'parquet', 'jsonl', 'jsonl', 'jsonl', 'jsonl']) AS format, (SELECT count(*) > 0 FROM flat) AS written")
def s12(spark, sf):
    m = sinks.export_all(all_outputs(settle(call_records(spark, sf))), sinks.work_path(spark, "exports"))
    return m.select("name", "format", (F.length("path") > 0).alias("written"))


@query("S13_export_dispatch", f"WITH {SEG}, {RECS} SELECT f.format, count(*) AS n_rows, CAST(sum(compliance_score) AS BIGINT) AS score_sum FROM flat, (SELECT unnest(['csv', 'parquet', 'jsonl']) AS format) f GROUP BY 1")
def s13(spark, sf):
    flat = settle(flat_calls(spark, sf))
    out = None
    for fmt in sinks.FORMATS:
        path = sinks.export(flat, fmt, sinks.work_path(spark, fmt))
        r = spark.read.schema(flat.schema)
        back = r.option("header", True).option("escape", '"').csv(path) if fmt == "csv" else r.parquet(path) if fmt == "parquet" else r.json(path)
        n = back.agg(F.count(F.lit(1)).alias("n_rows"), F.sum("compliance_score").alias("score_sum")).select(F.lit(fmt).alias("format"), "*")
        out = n if out is None else out.unionByName(n)
    return out
