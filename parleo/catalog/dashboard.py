"""Queries behind dashboards, queues, insights and digests."""
from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from parleo.catalog.affect import EVINT, INTENTS, seg_intents
from parleo.catalog.base import *  # noqa: F403
from parleo.catalog.conduct import A49, ALLCHECKS
from parleo.catalog.entities import ENTS, KS, KSV, LAYERS, NOISE, OBL, SEGOB, layers, pii_cte, promising
from parleo.functions.columns import half_up, n_words, pick
from parleo.operators import compliance as comp
from parleo.operators import entities as ent
from parleo.operators import fraud, policy, rollup
from parleo.operators import obligations as obl
from parleo.plans.skew import exact_quantile, salted_join
from parleo.plans.stage import settle
from parleo.sources import seeds, tables, vocab
from parleo.sources.tables import calls, checks, event_emotions, event_intents, frames, load, raw_turns, segments, spread, ts_utc

W = "CASE call_type " + " ".join(f"WHEN {q(k)} THEN {v}e0" for k, v in seeds.CALL_TYPE_WEIGHT.items()) + " ELSE 1e0 END"
SCORED = f"""{CALLS}, {CHECKS}, ag AS (SELECT call_id, count(*) FILTER (WHERE NOT passed) AS n_violations, count(*) FILTER (WHERE fraud) AS n_fraud, count(*) AS n_checks, bool_or(NOT passed AND severity = 'critical') AS has_critical FROM checks GROUP BY 1),
sc0 AS (SELECT c.*, coalesce(n_violations, 0) AS n_violations, coalesce(n_fraud, 0) AS n_fraud, coalesce(n_checks, 0) AS n_checks, coalesce(has_critical, false) AS has_critical, {W} AS w FROM calls c LEFT JOIN ag USING (call_id)),
sc1 AS (SELECT *, CASE WHEN (has_critical AND w >= 1) OR n_violations * w >= 3 OR n_fraud * w >= 2 THEN 'critical' WHEN n_violations * w >= 2 OR n_fraud * w >= 1 THEN 'high' WHEN n_violations * w >= 1 THEN 'medium' ELSE 'low' END AS risk,
 CAST(greatest(0, 100 - n_violations * floor(15 * w)) AS BIGINT) AS compliance_score FROM sc0),
scored AS (SELECT *, CASE WHEN risk = 'critical' THEN 1 WHEN risk = 'high' THEN 2 WHEN n_fraud > 0 OR n_violations > 0 THEN 3 ELSE 5 END AS review_priority, risk IN ('high', 'critical') AS requires_review FROM sc1)"""

# Turns with promises in them under the name that the other fragments read.
PSEG = SEG.replace("seg AS (", "seg0 AS (") + ", " + SEGOB.replace("segob AS", "seg AS").replace("FROM seg)", "FROM seg0)")
POBL = OBL.replace(SEGOB, "segob AS (SELECT * FROM seg)")


def scored(spark, sf):
    return rollup.score_calls(calls(spark, sf), checks(spark, sf))


@query("A20_risk_rollup", f"WITH {SCORED} SELECT call_id, call_type, n_violations, n_fraud, has_critical, risk FROM scored")
def a20(spark, sf):
    return scored(spark, sf).select("call_id", "call_type", "n_violations", "n_fraud", "has_critical", "risk")


@query("A21_compliance_score", f"WITH {SEG}, {ALLCHECKS}, v AS (SELECT call_id, count(*) AS n_checks, count(*) FILTER (WHERE NOT passed) AS n_violations, bool_or(NOT passed AND severity = 'critical') AS has_critical FROM allc GROUP BY 1), c AS (SELECT DISTINCT call_id, call_type, {W} AS w FROM seg), j AS (SELECT c.*, coalesce(n_checks, 0) AS n_checks, coalesce(n_violations, 0) AS n_violations, coalesce(has_critical, false) AS has_critical FROM c LEFT JOIN v USING (call_id)) SELECT call_id, call_type, n_checks, n_violations, CAST(greatest(0, 100 - n_violations * floor(15 * w)) AS BIGINT) AS compliance_score, CASE WHEN (has_critical AND w >= 1) OR n_violations * w >= 3 THEN 'critical' WHEN n_violations * w >= 2 THEN 'high' WHEN n_violations * w >= 1 THEN 'medium' ELSE 'low' END AS risk FROM j")
def a21(spark, sf):
    """Flagship: turns -> rule families -> per-call scorecard."""
    seg = settle(segments(spark, sf))
    c = comp.all_checks(seg, vocab.seed_vocab(spark)).withColumn("fraud", F.lit(False))
    per_call = seg.select("call_id", "call_type").distinct()
    return rollup.score_calls(per_call, c).select("call_id", "call_type", "n_checks", "n_violations", "compliance_score", "risk")


@query("A1_global_stats", f"WITH {SCORED} SELECT count(*) AS total_calls, {hu('sum(dur_cs) / 100e0', 1)} AS total_duration, {hu('sum(compliance_score) / count(*)', 1)} AS avg_compliance, count(*) FILTER (WHERE requires_review) AS pending_reviews FROM scored")
def a1(spark, sf):
    return rollup.global_stats(scored(spark, sf))


@query("A2_risk_distribution", f"WITH {SCORED} SELECT " + ", ".join(f"count(*) FILTER (WHERE risk = '{l}') AS {l}" for l in rollup.LEVELS) + " FROM scored")
def a2(spark, sf):
    return rollup.risk_distribution(scored(spark, sf))


@query("A3_language_distribution", f"SELECT lang, count(*) AS n, {hu('count(*) * 100e0 / sum(count(*)) OVER ()', 2)} AS pct FROM documents GROUP BY 1")
def a3(spark, sf):
    c = load(spark, sf, "documents").groupBy("lang").agg(F.count(F.lit(1)).alias("n"))
    return c.withColumn("pct", half_up(F.col("n") * 100.0 / F.sum("n").over(Window.partitionBy()), 2)).orderBy(F.desc("n"), "lang")


@query("A4_alert_rates", f"WITH {SCORED} SELECT count(*) FILTER (WHERE risk IN ('high', 'critical')) AS fraud_alerts, {hu('count(*) FILTER (WHERE compliance_score >= 80) * 100e0 / count(*)', 2)} AS pct_compliant, {hu('sum(dur_cs) / (count(*) * 100e0)', 2)} AS avg_duration FROM scored")
def a4(spark, sf):
    return scored(spark, sf).agg(F.count_if("requires_review").alias("fraud_alerts"), half_up(F.count_if(F.col("compliance_score") >= 80) * 100.0 / F.count(F.lit(1)), 2).alias("pct_compliant"),
                                 half_up(F.sum("dur_cs") / (F.count(F.lit(1)) * 100.0), 2).alias("avg_duration"))


@query("A5_score_histogram", "WITH s AS (SELECT CAST(floor(p_retailprice) AS BIGINT) % 101 AS score FROM part), b AS (SELECT least(score // 20, 4) AS bin, count(*) AS n FROM s GROUP BY 1) SELECT r.bin, coalesce(n, 0) AS n FROM (SELECT unnest(range(0, 5)) AS bin) r LEFT JOIN b ON b.bin = r.bin")
def a5(spark, sf):
    s = load(spark, sf, "part").select((F.floor("p_retailprice") % 101).alias("score"))
    b = F.least(F.floor(F.col("score") / 20), F.lit(4).cast("bigint"))
    one = s.agg(*[F.count_if(b == i).alias(f"b{i}") for i in range(5)])
    return one.select(F.explode(F.array(*[F.struct(F.lit(i).cast("bigint").alias("bin"), F.col(f"b{i}").alias("n")) for i in range(5)])).alias("x")).select("x.bin", "x.n")


@query("A6_top_intents", f"WITH {EVINT} SELECT replace(intent, '_', ' ') AS name, count(*) AS n FROM ei GROUP BY 1 ORDER BY n DESC, name LIMIT 10")
def a6(spark, sf):
    return event_intents(spark, sf).groupBy(F.replace("intent", F.lit("_"), F.lit(" ")).alias("name")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "name").limit(10)


EXTRA = "x.dur_cs % 7 AS n_low_confidence, x.call_id % 11 = 0 AS agent_toxic, ['none', 'low', 'medium', 'high'][x.call_id % 4 + 1] AS tamper_risk, x.dur_cs % 3 AS pii_count"


@query("A25_review_reasons", f"""WITH {SCORED}, bad AS (SELECT call_id, 0 AS k, check_name AS r, count(*) AS n FROM checks WHERE NOT passed GROUP BY ALL UNION ALL SELECT call_id, 1, 'unusual_quantity', count(*) FROM checks WHERE fraud GROUP BY 1),
l AS (SELECT call_id, list(r || '*' || n ORDER BY k, r) AS rs FROM bad GROUP BY 1), x AS (SELECT x.call_id, {EXTRA} FROM calls x)
SELECT x.call_id, array_to_string(coalesce(rs, []) || list_filter([CASE WHEN n_low_confidence > 0 THEN 'low_confidence_transcript' END, CASE WHEN agent_toxic THEN 'agent_toxicity' END, CASE WHEN tamper_risk IN ('medium', 'high') THEN 'tamper_risk' END, CASE WHEN pii_count > 0 THEN 'pii_detected_' || pii_count END], lambda z: z IS NOT NULL), ',') AS review_reasons FROM x LEFT JOIN l USING (call_id)""")
def a25(spark, sf):
    c = calls(spark, sf).select("call_id", (F.col("dur_cs") % 7).alias("n_low_confidence"), (F.col("call_id") % 11 == 0).alias("agent_toxic"),
                                pick(F.col("call_id") % 4, ["none", "low", "medium", "high"]).alias("tamper_risk"), (F.col("dur_cs") % 3).alias("pii_count"))
    return rollup.review_reasons(checks(spark, sf), c)


@query("A26_review_priority", f"WITH {SCORED} SELECT call_id, risk, review_priority, requires_review FROM scored")
def a26(spark, sf):
    return scored(spark, sf).select("call_id", "risk", "review_priority", "requires_review")


@query("A27_review_tiers", f"WITH {SCORED} SELECT count(*) FILTER (WHERE review_priority <= 2) AS urgent, count(*) FILTER (WHERE review_priority = 3) AS watch, count(*) FILTER (WHERE review_priority >= 4) AS routine FROM scored")
def a27(spark, sf):
    p = F.col("review_priority")
    return scored(spark, sf).agg(F.count_if(p <= 2).alias("urgent"), F.count_if(p == 3).alias("watch"), F.count_if(p >= 4).alias("routine"))


@query("A28_pass_rate", f"WITH {CHECKS} SELECT call_id, count(*) AS n_checks, {hu('count(*) FILTER (WHERE passed) * 100e0 / count(*)', 1)} AS pass_rate FROM checks GROUP BY 1")
def a28(spark, sf):
    return checks(spark, sf).groupBy("call_id").agg(F.count(F.lit(1)).alias("n_checks"), half_up(F.count_if("passed") * 100.0 / F.count(F.lit(1)), 1).alias("pass_rate"))


TOPIC = case("intent", seeds.TOPICS)


@query("A29_discussion_topics", f"WITH {EVINT}, c AS (SELECT call_id, intent, count(*) AS mentions FROM ei GROUP BY 1, 2), p AS (SELECT *, CAST(floor(mentions * 100 / sum(mentions) OVER (PARTITION BY call_id) + 0.5) AS BIGINT) AS percentage FROM c) SELECT call_id, {TOPIC} AS topic, mentions, percentage FROM p WHERE intent NOT IN {inlist(seeds.TRIVIAL_INTENTS)} AND percentage >= 2")
def a29(spark, sf):
    return rollup.discussion_topics(event_intents(spark, sf))


TSENT = f"{INTENTS}, seg2 AS (SELECT i.call_id, i.intent, i.text FROM intents i WHERE intent NOT IN {inlist(seeds.TRIVIAL_INTENTS)}), {KS.replace('FROM seg)', 'FROM seg2)')}, ts AS (SELECT call_id, {TOPIC} AS topic, {hu(f'sum(floor({KSV} * 100 + 0.5)) / (count(*) * 100e0)', 2)} AS sentiment FROM ks GROUP BY 1, 2)"


@query("A30_topic_sentiment", f"WITH {SEG}, {TSENT} SELECT * FROM ts")
def a30(spark, sf):
    return rollup.topic_sentiment(seg_intents(segments(spark, sf)))


@query("K7_ordered_displays", f"WITH {SEG}, {TSENT} SELECT call_id, topic, sentiment, abs(sentiment) AS strength FROM ts")
def k7(spark, sf):
    return rollup.topic_sentiment(seg_intents(segments(spark, sf))).withColumn("strength", F.abs("sentiment")).orderBy("call_id", F.desc("strength"), "topic")


ICOUNTS = "ic AS (SELECT call_id, call_type, count(*) AS n_intents, " + ", ".join(f"count(*) FILTER (WHERE intent = '{i}') AS i_{i}" for i in policy.VALID_INTENTS) + " FROM intents GROUP BY 1, 2)"


@query("A31_risk_factors", f"""WITH {SEG}, {INTENTS}, {ICOUNTS}, s AS (SELECT call_id, text, row_number() OVER (PARTITION BY call_id ORDER BY segment_id) AS rn FROM intents WHERE intent = 'risk_warning')
SELECT call_id, 'stated_risk' AS type, trim(left(text, 120), ' ') AS detail FROM s WHERE rn <= 4
UNION ALL SELECT call_id, 'complaint_detected', i_complaint || ' complaint(s) raised during call' FROM ic WHERE i_complaint > 0
UNION ALL SELECT call_id, 'escalation_detected', i_escalation || ' escalation event(s)' FROM ic WHERE i_escalation > 0
UNION ALL SELECT call_id, 'dispute_detected', i_dispute || ' dispute(s) identified' FROM ic WHERE i_dispute > 0
UNION ALL SELECT call_id, 'high_refusal_rate', 'Refusal rate ' || CAST(floor(i_refusal * 100 / n_intents + 0.5) AS BIGINT) || '%' FROM ic WHERE i_refusal * 100 / n_intents > 10""")
def a31(spark, sf):
    i = settle(seg_intents(segments(spark, sf)).select("call_id", "call_type", "segment_id", "text", "intent"))
    return rollup.risk_factors(i, rollup.intent_counts(i))


EFF = f"""ne AS (SELECT call_id, count(*) AS n_entities, count(*) FILTER (WHERE entity_type IN ('payment_amount', 'emi_amount', 'loan_amount')) AS n_amounts, count(*) FILTER (WHERE entity_type = 'organization') AS n_orgs, count(DISTINCT CASE WHEN entity_type = 'organization' AND length(trim(value)) > 2 THEN lower(trim(value)) END) AS n_org_names FROM clean GROUP BY 1),
sp2 AS (SELECT call_id, speaker, count(*) AS c, sum(len({words_sql('text')})) AS w FROM seg GROUP BY 1, 2),
sg2 AS (SELECT call_id, CAST(sum(c) AS BIGINT) AS total_segments, count(*) AS total_speakers, CAST(sum(w) AS BIGINT) AS total_words, list(c ORDER BY c DESC) AS cs FROM sp2 GROUP BY 1),
eff AS (SELECT s.call_id, call_type, total_segments, total_speakers, coalesce(n_entities, 0) AS entities_extracted, n_intents AS intents_classified, {hu('i_unknown * 100e0 / n_intents', 1)} AS unknown_rate, {hu('i_financial_disclosure * 100e0 / n_intents', 1)} AS disclosure_rate,
 {hu('(i_question + i_explanation) * 100e0 / n_intents', 1)} AS qa_rate, total_words, {hu('total_words / total_segments', 1)} AS avg_words, CASE WHEN len(cs) >= 2 THEN {hu('cs[2] * 100e0 / cs[1]', 1)} ELSE 0e0 END AS speaker_balance FROM sg2 s LEFT JOIN ic USING (call_id) LEFT JOIN ne USING (call_id))"""


def _insight_inputs(spark, sf):
    seg = settle(segments(spark, sf))
    i = settle(rollup.intent_counts(seg_intents(seg)))
    e = settle(ent.drop_noise(layers(spark, sf, seg)).select("call_id", "entity_type", "value"))
    n = e.groupBy("call_id").agg(F.count(F.lit(1)).alias("n_entities"))
    return seg, i, e, rollup.effectiveness(seg, i, n)


@query("A32_call_effectiveness", f"WITH {SEG}, {INTENTS}, {ICOUNTS}, {ENTS}, {LAYERS}, {NOISE}, {EFF} SELECT * FROM eff")
def a32(spark, sf):
    return _insight_inputs(spark, sf)[3]


@query("X25_effectiveness_axes", f"WITH {SEG}, {INTENTS}, {ICOUNTS}, {ENTS}, {LAYERS}, {NOISE}, {EFF} SELECT call_id, least(100, total_segments) AS segments, total_speakers * 25 AS speakers, least(100, entities_extracted * 5) AS entities, least(100, intents_classified) AS intents, disclosure_rate, qa_rate FROM eff")
def x25(spark, sf):
    h = F.lit(100).cast("bigint")
    return _insight_inputs(spark, sf)[3].select("call_id", F.least(h, "total_segments").alias("segments"), (F.col("total_speakers") * 25).alias("speakers"), F.least(h, F.col("entities_extracted") * 5).alias("entities"),
                                               F.least(h, "intents_classified").alias("intents"), "disclosure_rate", "qa_rate")


def _advice_sql() -> str:
    rules = []
    for types, intent, more, text in rollup.ADVICE:
        hit = f"i_{intent} > {more}" if more >= 0 else f"i_{intent} = 0"
        rules.append(f"CASE WHEN ic.call_type IN {inlist(types.split())} AND {hit} THEN {q(text)} END")
    rules[12:12] = ["CASE WHEN ic.call_type = 'general' AND coalesce(n_amounts, 0) > 5 THEN n_amounts || ' financial figures discussed — cross-reference with filings' END"]
    rules += ["CASE WHEN ic.call_type = 'general' AND coalesce(n_orgs, 0) > 3 THEN n_org_names || ' entities mentioned — verify counterparty relationships' END",
              "CASE WHEN total_words > 5000 THEN 'Extended call (' || format('{:,}', total_words) || ' words) — review key decision points' END",
              "CASE WHEN speaker_balance < 20 AND total_speakers >= 2 THEN 'Highly unbalanced speaker distribution — verify all parties were heard' END",
              "CASE WHEN i_info_request / n_intents > 0.5e0 THEN 'Call dominated by information requests — consider proactive disclosure' END"]
    return "[" + ", ".join(rules) + "]"


@query("A34_recommendations", f"WITH {SEG}, {INTENTS}, {ICOUNTS}, {ENTS}, {LAYERS}, {NOISE}, {EFF}, r AS (SELECT ic.call_id, list_filter({_advice_sql()}, lambda z: z IS NOT NULL) AS rs FROM ic JOIN eff USING (call_id) LEFT JOIN ne USING (call_id)) SELECT call_id, CASE WHEN len(rs) = 0 THEN {q(rollup.NO_ADVICE)} ELSE array_to_string(rs, ' | ') END AS recommendations FROM r")
def a34(spark, sf):
    _, counts, e, eff = _insight_inputs(spark, sf)
    nm = F.lower(F.trim("value"))
    amounts = e.where(F.col("entity_type").isin("payment_amount", "emi_amount", "loan_amount")).groupBy("call_id").agg(F.count(F.lit(1)).alias("n_amounts"))
    orgs = e.where(F.col("entity_type") == "organization").groupBy("call_id").agg(F.count(F.lit(1)).alias("n_orgs"), F.count_distinct(F.when(F.length(nm) > 2, nm)).alias("n_org_names"))
    return rollup.recommendations(counts, eff, amounts, orgs)


# ---- pipeline progress -------------------------------------------------------------------------
STAGE = case("event_type", tables.EVENT_STAGE)


@query("A44_stage_timings", f"WITH {FR}, s AS (SELECT {STAGE} AS stage, v100 FROM fr) SELECT stage, count(*) AS n, {hu('sum(v100) / (count(*) * 100e0)', 2)} AS mean_s, {hu('quantile_cont(v100, 0.5) / 100', 3)} AS p50_s, {hu('quantile_cont(v100, 0.95) / 100', 3)} AS p95_s FROM s GROUP BY 1")
def a44(spark, sf):
    s = frames(spark, sf).select(tables._map("event_type", tables.EVENT_STAGE).alias("stage"), "v100")
    m = s.groupBy("stage").agg(F.count(F.lit(1)).alias("n"), half_up(F.sum("v100") / (F.count(F.lit(1)) * 100.0), 2).alias("mean_s"))
    p = [exact_quantile(s, ["stage"], "v100", x, c) for x, c in ((0.5, "p50"), (0.95, "p95"))]
    return m.join(p[0], "stage").join(p[1], "stage").select("stage", "n", "mean_s", half_up(F.col("p50") / 100, 3).alias("p50_s"), half_up(F.col("p95") / 100, 3).alias("p95_s"))


@query("A45_batch_summary", "SELECT CASE WHEN event_type = 'error' THEN 'failed' ELSE 'success' END AS status, count(*) AS n, count(DISTINCT user_id) AS n_calls FROM events GROUP BY 1")
def a45(spark, sf):
    e = load(spark, sf, "events").select(F.when(F.col("event_type") == "error", "failed").otherwise("success").alias("status"), "user_id")
    return e.groupBy("status").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("user_id").alias("n_calls"))


@query("K2_latest_progress", f"""WITH e AS (SELECT user_id AS call_id, {STAGE} AS stage, ts, event_id FROM events), l AS (SELECT *, row_number() OVER (PARTITION BY call_id ORDER BY ts DESC, event_id DESC) AS k, row_number() OVER (ORDER BY ts DESC, event_id DESC) AS g FROM e)
SELECT c.c_custkey AS call_id, coalesce(stage, 'unknown') AS stage, coalesce(g = 1, false) AS is_latest FROM customer c LEFT JOIN l ON l.call_id = c.c_custkey AND k = 1""")
def k2(spark, sf):
    e = load(spark, sf, "events").select(F.col("user_id").alias("call_id"), tables._map("event_type", tables.EVENT_STAGE).alias("stage"), ts_utc("ts").alias("ts"), "event_id")
    last = settle(e.groupBy("call_id").agg(F.max_by(F.struct("stage", "ts", "event_id"), F.struct("ts", "event_id")).alias("p")).select("call_id", "p.*"))
    top = last.agg(F.max_by("event_id", F.struct("ts", "event_id")).alias("top")).scalar()
    known = load(spark, sf, "customer").select(F.col("c_custkey").alias("call_id")).join(last, "call_id", "left")
    return known.select("call_id", F.coalesce("stage", F.lit("unknown")).alias("stage"), F.coalesce(F.col("event_id") == top, F.lit(False)).alias("is_latest"))


DISPLAY = "CASE WHEN s IN ('1', '2', '2.5') THEN 0 WHEN s = '3' THEN 1 WHEN s IN ('4A', '4B') THEN 2 WHEN s LIKE '4%' THEN 3 WHEN s IN ('5', 'done') THEN 4 ELSE -1 END"


@query("P18_progress_display", f"""WITH e AS (SELECT user_id AS call_id, {STAGE} AS s, ts, event_id FROM events), g AS (SELECT call_id, count(DISTINCT s) AS n_done, arg_max(s, struct_pack(ts := ts, e := event_id)) AS cur, bool_or(s = 'done') AS complete FROM e GROUP BY 1),
d AS (SELECT *, {DISPLAY.replace(' s ', ' cur ')} AS a FROM g)
SELECT call_id, n_done, CAST(CASE WHEN complete AND call_id % 2 = 0 THEN 100 ELSE least(floor(n_done * 100 / 13 + 0.5), 99) END AS BIGINT) AS percent, array_to_string([CASE WHEN complete AND call_id % 2 = 0 THEN 'done' WHEN i = a THEN 'active' WHEN i < a THEN 'done' ELSE 'idle' END for i in range(0, 5)], ',') AS states FROM d""")
def p18(spark, sf):
    e = load(spark, sf, "events").select(F.col("user_id").alias("call_id"), tables._map("event_type", tables.EVENT_STAGE).alias("s"), "ts", "event_id")
    g = e.groupBy("call_id").agg(F.count_distinct("s").alias("n_done"), F.max_by("s", F.struct("ts", "event_id")).alias("cur"), F.bool_or(F.col("s") == "done").alias("c"))
    cur = F.col("cur")
    at = F.when(cur.isin("1", "2", "2.5"), 0).when(cur == "3", 1).when(cur.isin("4A", "4B"), 2).when(cur.startswith("4"), 3).when(cur.isin("5", "done"), 4).otherwise(-1)
    done = F.col("c") & (F.col("call_id") % 2 == 0)
    states = F.transform(F.sequence(F.lit(0), F.lit(4)), lambda i: F.when(done, "done").when(i == at, "active").when(i < at, "done").otherwise("idle"))
    return g.select("call_id", "n_done", F.when(done, F.lit(100).cast("bigint")).otherwise(F.least(F.floor(F.col("n_done") * 100 / 13 + 0.5), F.lit(99).cast("bigint"))).alias("percent"), F.array_join(states, ",").alias("states"))


# ---- lists and queues -----------------------------------------------------------------------------
@query("K1_call_page", f"WITH {CALLS} SELECT call_id, call_type, ingested_at FROM calls ORDER BY ingested_at DESC, call_id LIMIT 50 OFFSET 100")
def k1(spark, sf):
    return rollup.page(calls(spark, sf).select("call_id", "call_type", "ingested_at"), limit=50, offset=100)


@query("K1_next_page", f"WITH {CALLS} SELECT call_id, call_type, ingested_at FROM calls ORDER BY ingested_at DESC, call_id LIMIT 50 OFFSET 50")
def k1b(spark, sf):
    """The second page, found from the last row of the first."""
    c = calls(spark, sf).select("call_id", "call_type", "ingested_at")
    last = rollup.page(c, 50).collect()[-1]
    return rollup.page(c, 50, after=(last["ingested_at"], last["call_id"]))


@query("P2_call_list", f"WITH {SCORED} SELECT call_id, call_type, coalesce(CASE WHEN call_id % 3 = 0 THEN NULL ELSE 'hi' END, 'en') AS language, risk, compliance_score, requires_review, review_priority, coalesce(CASE WHEN call_id % 5 = 0 THEN NULL ELSE 'low' END, 'none') AS tamper_risk FROM scored")
def p2(spark, sf):
    c = F.col("call_id")
    return scored(spark, sf).select("call_id", "call_type", F.coalesce(F.when(c % 3 != 0, "hi"), F.lit("en")).alias("language"), "risk", "compliance_score", "requires_review", "review_priority",
                                    F.coalesce(F.when(c % 5 != 0, "low"), F.lit("none")).alias("tamper_risk")).orderBy("call_id")


@query("K3_review_queue", f"WITH {SCORED} SELECT call_id, review_priority, risk, call_type, ingested_at FROM scored WHERE requires_review")
def k3(spark, sf):
    return scored(spark, sf).where("requires_review").select("call_id", "review_priority", "risk", "call_type", "ingested_at").orderBy("review_priority", F.desc("ingested_at"))


@query("P10_review_filter", f"WITH {SCORED} SELECT call_id, risk, CASE WHEN review_priority <= 2 THEN 'urgent' WHEN review_priority = 3 THEN 'watch' ELSE 'routine' END AS tier FROM scored WHERE requires_review AND risk = 'high'")
def p10(spark, sf):
    p = F.col("review_priority")
    return scored(spark, sf).where(F.col("requires_review") & (F.col("risk") == "high")).select("call_id", "risk", F.when(p <= 2, "urgent").when(p == 3, "watch").otherwise("routine").alias("tier"))


@query("A57_record_count", "SELECT count(*) AS stored FROM orders")
def a57(spark, sf):
    return load(spark, sf, "orders").agg(F.count(F.lit(1)).alias("stored"))


@query("A59_risk_share", f"WITH {SCORED} SELECT risk, count(*) AS n, {hu('count(*) * 100e0 / sum(count(*)) OVER ()', 1)} AS pct FROM scored GROUP BY 1")
def a59(spark, sf):
    g = scored(spark, sf).groupBy("risk").agg(F.count(F.lit(1)).alias("n"))
    return g.withColumn("pct", half_up(F.col("n") * 100.0 / F.sum("n").over(Window.partitionBy()), 1))  # at most four rows


@query("A59_emotion_pivot", f"WITH {EVEMO} SELECT emotion, " + ", ".join(f"CAST(floor(count(*) FILTER (WHERE speaker = '{s}') * 100 / sum(count(*) FILTER (WHERE speaker = '{s}')) OVER () + 0.5) AS BIGINT) AS {s}" for s in ("agent", "customer")) + " FROM ee GROUP BY 1")
def a59b(spark, sf):
    p = event_emotions(spark, sf).groupBy("emotion").pivot("speaker", ["agent", "customer"]).agg(F.count(F.lit(1))).fillna(0)
    w = Window.partitionBy()  # one row per emotion
    return p.select("emotion", *[F.floor(F.col(s) * 100 / F.sum(s).over(w) + 0.5).alias(s) for s in ("agent", "customer")])


@query("P4_record_lookup", """WITH a AS (SELECT o_orderkey AS call_id, 0 AS prio, 'processed' AS location FROM orders WHERE o_orderstatus = 'F' UNION ALL SELECT o_orderkey, 1, 'batch_results' FROM orders), r AS (SELECT *, row_number() OVER (PARTITION BY call_id ORDER BY prio) AS k FROM a) SELECT call_id, location FROM r WHERE k = 1""")
def p4(spark, sf):
    o = load(spark, sf, "orders")
    first = o.where(F.col("o_orderstatus") == "F").select(F.col("o_orderkey").alias("call_id"), F.lit(0).alias("prio"), F.lit("processed").alias("location"))
    second = o.select(F.col("o_orderkey").alias("call_id"), F.lit(1).alias("prio"), F.lit("batch_results").alias("location"))
    return first.unionByName(second).groupBy("call_id").agg(F.min_by("location", "prio").alias("location"))


@query("P4_single_lookup", "SELECT o_orderkey AS call_id, CASE WHEN o_orderstatus = 'F' THEN 'processed' ELSE 'batch_results' END AS location FROM orders WHERE o_orderkey = (SELECT max(o_orderkey) FROM orders)")
def p4b(spark, sf):
    o = load(spark, sf, "orders").withColumnRenamed("o_orderkey", "call_id")
    return rollup.lookup_record(o.agg(F.max("call_id")).first()[0], ("processed", o.where("o_orderstatus = 'F'")), ("batch_results", o))


@query("P15_transcript_gate", f"WITH {SEG}, c AS (SELECT call_id, sum((conv_id * 1777 + turn * 911) % 1001) / (count(*) * 1000e0) AS conf FROM seg GROUP BY 1) SELECT call_id, {hu('conf', 3)} AS confidence, conf >= 0.55e0 AS extract FROM c")
def p15(spark, sf):
    c = raw_turns(spark, sf).groupBy("call_id").agg((F.sum((F.col("conv_id") * 1777 + F.col("turn") * 911) % 1001) / (F.count(F.lit(1)) * 1000.0)).alias("conf"))
    return c.select("call_id", half_up(F.col("conf"), 3).alias("confidence"), (F.col("conf") >= 0.55).alias("extract"))


# ---- joins to records ---------------------------------------------------------------------------------
@query("J1_intents_with_text", f"WITH {SEG}, {INTENTS}, t AS (SELECT call_id, segment_id, text FROM seg WHERE segment_id % 4 <> 3) SELECT i.call_id, i.segment_id, intent, coalesce(t.text, '') AS text FROM intents i LEFT JOIN t USING (call_id, segment_id)")
def j1(spark, sf):
    seg = settle(segments(spark, sf))
    t = seg.where(F.col("segment_id") % 4 != 3).select("call_id", "segment_id", "text")
    return seg_intents(seg).select("call_id", "segment_id", "intent").join(t, ["call_id", "segment_id"], "left").withColumn("text", F.coalesce("text", F.lit("")))


@query("J2_training_pairs", f"WITH {SEG}, {INTENTS}, t AS (SELECT call_id, segment_id, CASE WHEN segment_id % 5 = 2 THEN '  ' ELSE text END AS text FROM seg) SELECT i.call_id, i.segment_id, trim(t.text, ' ') AS text, intent AS label, i.speaker, {hu('confidence', 2)} AS confidence FROM intents i JOIN t USING (call_id, segment_id) WHERE trim(t.text, ' ') <> ''")
def j2(spark, sf):
    seg = settle(segments(spark, sf))
    t = seg.select("call_id", "segment_id", F.trim(F.when(F.col("segment_id") % 5 == 2, "  ").otherwise(F.col("text"))).alias("text"))
    i = seg_intents(seg).select("call_id", "segment_id", F.col("intent").alias("label"), "speaker", half_up(F.col("confidence"), 2).alias("confidence"))
    return i.join(t, ["call_id", "segment_id"]).where(F.col("text") != "")


@query("J20_customer_link", f"WITH {CALLS}, l AS (SELECT l_orderkey AS call_id, count(*) FILTER (WHERE l_linestatus = 'O') AS n_customer_obligations FROM lineitem GROUP BY 1) SELECT c_custkey AS customer_id, c.call_id, call_type, coalesce(n_customer_obligations, 0) AS n_customer_obligations, 'CUSTOMER CALL — ' || call_type || ' call, ID ' || c.call_id AS digest FROM calls c JOIN customer ON c_custkey = customer_id LEFT JOIN l ON l.call_id = c.call_id")
def j20(spark, sf):
    ob = load(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("call_id")).agg(F.count_if(F.col("l_linestatus") == "O").alias("n_customer_obligations"))
    c = salted_join(calls(spark, sf), load(spark, sf, "customer").select(F.col("c_custkey").alias("customer_id")), ["customer_id"], ["call_id"]).join(ob, "call_id", "left")
    return c.select("customer_id", "call_id", "call_type", F.coalesce("n_customer_obligations", F.lit(0).cast("bigint")).alias("n_customer_obligations"),
                    F.concat(F.lit("CUSTOMER CALL — "), "call_type", F.lit(" call, ID "), F.col("call_id").cast("string")).alias("digest"))


ACTION = "CASE event_type WHEN 'view' THEN 'approve' WHEN 'error' THEN 'escalate' ELSE 'reject' END"


def review_actions(spark, sf):
    e = load(spark, sf, "events")
    a = F.when(F.col("event_type") == "view", "approve").when(F.col("event_type") == "error", "escalate").otherwise("reject")
    return e.select(F.col("user_id").alias("call_id"), a.alias("action"), ts_utc("ts").alias("ts"), "event_id")


@query("J23_review_upsert", f"WITH {SCORED}, l AS (SELECT user_id AS call_id, {ACTION} AS action, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS k FROM events) SELECT s.call_id, action AS review_status, CASE WHEN action = 'approve' THEN false ELSE requires_review END AS requires_review, CASE WHEN action = 'escalate' THEN 1 ELSE review_priority END AS review_priority FROM scored s LEFT JOIN l ON l.call_id = s.call_id AND k = 1")
def j23(spark, sf):
    return rollup.apply_reviews(scored(spark, sf), review_actions(spark, sf)).select("call_id", "review_status", "requires_review", "review_priority")


@query("A46_cross_call_patterns", f"""WITH {CALLS}, c AS (SELECT *, status = 'O' AS promise, status = 'F' AS fulfilled, dur_cs % 2001 - 1000 AS sm, call_id % 3 <> 0 AS consent FROM calls),
p AS (SELECT *, row_number() OVER w - 1 AS pos, lag(consent) OVER w AS before, max(CASE WHEN fulfilled THEN ingested_at END) OVER (PARTITION BY customer_id) AS lf FROM c WINDOW w AS (PARTITION BY customer_id ORDER BY ingested_at, call_id)),
g AS (SELECT customer_id, count(*) AS n_calls, count(*) FILTER (WHERE promise AND (lf IS NULL OR ingested_at >= lf)) AS unfulfilled_promises, sum(pos) AS sx, sum(sm) AS sy, sum(pos * sm) AS sxy, sum(pos * pos) AS sxx, count(*) FILTER (WHERE before AND NOT consent) AS consent_reversals FROM p GROUP BY 1),
sl AS (SELECT *, CASE WHEN n_calls * sxx - sx * sx <> 0 THEN CAST(n_calls * sxy - sx * sy AS DOUBLE) / CAST(n_calls * sxx - sx * sx AS DOUBLE) END AS slope FROM g),
r AS (SELECT customer_id, count(*) AS rv FROM (SELECT customer_id, 'check_' || l_linestatus || '_' || (l_suppkey % 5) AS cn FROM lineitem JOIN calls ON l_orderkey = call_id WHERE l_returnflag = 'R' GROUP BY 1, 2 HAVING count(*) > 1) GROUP BY 1)
SELECT customer_id, n_calls, unfulfilled_promises, {hu('slope', 3)} AS sentiment_slope, coalesce(slope < 0, false) AS worsening, coalesce(rv, 0) AS repeated_violations, consent_reversals FROM sl LEFT JOIN r USING (customer_id)""")
def a46(spark, sf):
    c = calls(spark, sf).select("customer_id", "call_id", F.col("ingested_at").alias("ts"), (F.col("status") == "O").alias("promise"), (F.col("status") == "F").alias("fulfilled"),
                                (F.col("dur_cs") % 2001 - 1000).alias("sentiment_m"), (F.col("call_id") % 3 != 0).alias("consent"), F.unix_date(F.to_date("ingested_at")).alias("chunk"))
    failed = checks(spark, sf).where(~F.col("passed")).select("call_id", "check_name").join(c.select("call_id", "customer_id"), "call_id")
    return rollup.cross_call_patterns(c, failed)


# ---- reports and digests ---------------------------------------------------------------------------------
@query("P5_entities_report", f"WITH {SEG}, {OBL}, {pii_cte('segob', 'call_id, segment_id')} SELECT call_id, 'financial' AS source, entity_type, value, count(*) AS n FROM ents GROUP BY ALL UNION ALL SELECT call_id, 'pii', entity_type, masked_text, count(*) FROM pii GROUP BY ALL UNION ALL SELECT call_id, 'obligation', obligation_type, strength || coalesce(' ' || amount_raw, '') || coalesce(' by ' || date_referenced, ''), count(*) FROM obls GROUP BY ALL")
def p5(spark, sf):
    seg = settle(promising(segments(spark, sf)))
    fin = ent.entities(seg, ["call_id", "segment_id"], F.col("lang")).select("call_id", F.lit("financial").alias("source"), "entity_type", "value")
    pii = ent.pii(seg, ["call_id", "segment_id"]).select("call_id", F.lit("pii").alias("source"), "entity_type", F.col("masked_text").alias("value"))
    said = F.concat("strength", F.coalesce(F.concat(F.lit(" "), F.col("amount.raw_text")), F.lit("")), F.coalesce(F.concat(F.lit(" by "), "date_referenced"), F.lit("")))
    ob = obl.obligations(seg, F.col("lang")).select("call_id", F.lit("obligation").alias("source"), F.col("obligation_type").alias("entity_type"), said.alias("value"))
    return fin.unionByName(pii).unionByName(ob).groupBy("call_id", "source", "entity_type", "value").agg(F.count(F.lit(1)).alias("n"))


@query("P6_compliance_report", f"WITH {SEG}, {ALLCHECKS}, {A49}, v AS (SELECT call_id, count(*) AS n_checks, count(*) FILTER (WHERE NOT passed) AS n_failed FROM allc GROUP BY 1), f AS (SELECT call_id, count(*) AS n_fraud, string_agg(signal_type, ',' ORDER BY signal_type) AS signals FROM f49 GROUP BY 1) SELECT call_id, coalesce(n_checks, 0) AS n_checks, coalesce(n_failed, 0) AS n_failed, coalesce(n_fraud, 0) AS n_fraud, coalesce(signals, '') AS signals FROM (SELECT DISTINCT call_id FROM seg) LEFT JOIN v USING (call_id) LEFT JOIN f USING (call_id)")
def p6(spark, sf):
    seg = settle(segments(spark, sf))
    v = comp.all_checks(seg, vocab.seed_vocab(spark)).groupBy("call_id").agg(F.count(F.lit(1)).alias("n_checks"), F.count_if(~F.col("passed")).alias("n_failed"))
    f = fraud.scam_signals(seg).groupBy("call_id").agg(F.count(F.lit(1)).alias("n_fraud"), F.array_join(F.sort_array(F.collect_list("signal_type")), ",").alias("signals"))
    return seg.select("call_id").distinct().join(v, "call_id", "left").join(f, "call_id", "left").fillna(0, ["n_checks", "n_failed", "n_fraud"]).fillna("", ["signals"])


@query("P11_audit_summary", f"WITH {PSEG}, {ALLCHECKS}, {POBL} SELECT call_id, 'violation' AS kind, check_name AS name, severity, regulation AS detail, count(*) AS n FROM allc WHERE NOT passed GROUP BY ALL UNION ALL SELECT call_id, 'obligation', obligation_type, strength, coalesce(amount_raw, ''), count(*) FROM obls WHERE legally_significant GROUP BY ALL")
def p11(spark, sf):
    """Failed checks and legally significant obligations of each call."""
    seg = settle(promising(segments(spark, sf)))
    c = comp.all_checks(seg, vocab.seed_vocab(spark)).where(~F.col("passed")).select("call_id", F.lit("violation").alias("kind"), F.col("check_name").alias("name"), "severity", F.col("regulation").alias("detail"))
    o = obl.obligations(seg, F.col("lang")).where("legally_significant").select(
        "call_id", F.lit("obligation").alias("kind"), F.col("obligation_type").alias("name"), F.col("strength").alias("severity"), F.coalesce("amount.raw_text", F.lit("")).alias("detail"))
    return c.unionByName(o).groupBy("call_id", "kind", "name", "severity", "detail").agg(F.count(F.lit(1)).alias("n"))


@query("P12_utterance_document", f"WITH {PSEG}, {INTENTS}, {POBL}, e AS (SELECT call_id, segment_id, string_agg(entity_type || '=' || value, '; ' ORDER BY item) AS entities FROM ents GROUP BY 1, 2), o AS (SELECT call_id, segment_id, string_agg(obligation_type || ' [' || strength || ']' || coalesce(' ' || amount_raw, ''), '; ' ORDER BY item) AS obligations FROM obls GROUP BY 1, 2) SELECT i.call_id, i.segment_id, text, speaker AS speaker_role, intent, {hu('confidence', 2)} AS intent_confidence, coalesce(entities, '') AS entities, coalesce(obligations, '') AS obligations FROM intents i LEFT JOIN e USING (call_id, segment_id) LEFT JOIN o USING (call_id, segment_id)")
def p12(spark, sf):
    seg = settle(promising(segments(spark, sf)))

    def listed(rows, shown, name):
        items = F.sort_array(F.collect_list(F.struct("item", shown.alias("shown"))))  # those of one turn
        return rows.groupBy("call_id", "segment_id").agg(F.array_join(F.transform(items, lambda x: x["shown"]), "; ").alias(name))

    e = listed(ent.entities(seg, ["call_id", "segment_id"], F.col("lang")), F.concat("entity_type", F.lit("="), "value"), "entities")
    o = listed(obl.obligations(seg, F.col("lang")), F.concat("obligation_type", F.lit(" ["), "strength", F.lit("]"), F.coalesce(F.concat(F.lit(" "), F.col("amount.raw_text")), F.lit(""))), "obligations")
    i = seg_intents(seg).select("call_id", "segment_id", "text", F.col("speaker").alias("speaker_role"), "intent", half_up(F.col("confidence"), 2).alias("intent_confidence"))
    return i.join(e, ["call_id", "segment_id"], "left").join(o, ["call_id", "segment_id"], "left").fillna("", ["entities", "obligations"])


CDIG = f"""{PSEG}, {ALLCHECKS}, {A49}, {INTENTS}, {POBL},
vs AS (SELECT call_id, 'VIOLATIONS (' || CAST(sum(n) AS BIGINT) || '): ' || string_agg(check_name || ' [' || severity || '] x' || n, '; ' ORDER BY check_name, severity) AS t FROM (SELECT call_id, check_name, severity, count(*) AS n FROM allc WHERE NOT passed GROUP BY ALL) GROUP BY 1),
os AS (SELECT call_id, 'OBLIGATIONS (' || CAST(sum(n) AS BIGINT) || '): ' || string_agg(k || ' x' || n, '; ' ORDER BY k) AS t FROM (SELECT call_id, speaker || ': ' || obligation_type || ' [' || strength || ']' AS k, count(*) AS n FROM obls GROUP BY ALL) GROUP BY 1),
es AS (SELECT call_id, 'ENTITIES: ' || string_agg(entity_type || '=' || value, ', ' ORDER BY segment_id, item) AS t FROM (SELECT *, row_number() OVER (PARTITION BY call_id ORDER BY segment_id, item) AS k FROM ents) WHERE k <= 10 GROUP BY 1),
fs AS (SELECT call_id, 'FRAUD SIGNALS: ' || string_agg(signal_type || ' (conf=' || printf('%.2f', confidence) || ')', '; ' ORDER BY signal_type) AS t FROM f49 GROUP BY 1),
ins AS (SELECT call_id, 'INTENTS: ' || string_agg(intent || ' x' || n, ', ' ORDER BY intent) AS t FROM (SELECT call_id, intent, count(*) AS n FROM intents GROUP BY ALL) GROUP BY 1),
h AS (SELECT call_id, min(call_type) AS call_type, min(lang) AS lang, max(end_ds) // 10 AS secs FROM seg GROUP BY 1)"""


@query("X18_call_digest", f"WITH {CDIG} SELECT call_id, concat_ws(chr(10), 'CALL RECORD — ID: ' || call_id, 'Type: ' || call_type, 'Duration: ' || secs || 's', 'Language: ' || lang, vs.t, os.t, es.t, fs.t, ins.t) AS digest FROM h LEFT JOIN vs USING (call_id) LEFT JOIN os USING (call_id) LEFT JOIN es USING (call_id) LEFT JOIN fs USING (call_id) LEFT JOIN ins USING (call_id)")
def x18b(spark, sf):
    """Digest of a call from its children; repeated ones show once with their number, so a digest stays short."""
    seg = settle(promising(segments(spark, sf)))

    def counted(rows, shown, head, sep, total=True):
        n = rows.groupBy("call_id", shown.alias("k")).agg(F.count(F.lit(1)).alias("n"))
        g = n.groupBy("call_id").agg(F.sum("n").alias("all"), F.array_sort(F.collect_list(F.struct("k", "n"))).alias("l"))
        start = F.concat(F.lit(f"{head} ("), F.col("all").cast("string"), F.lit("): ")) if total else F.lit(f"{head}: ")
        return g.select("call_id", F.concat(start, F.array_join(F.transform("l", lambda x: F.concat(x["k"], F.lit(" x"), x["n"].cast("string"))), sep)).alias(head))

    v = counted(comp.all_checks(seg, vocab.seed_vocab(spark)).where(~F.col("passed")), F.concat("check_name", F.lit(" ["), "severity", F.lit("]")), "VIOLATIONS", "; ")
    o = counted(obl.obligations(seg, F.col("lang")), F.concat("speaker", F.lit(": "), "obligation_type", F.lit(" ["), "strength", F.lit("]")), "OBLIGATIONS", "; ")
    i = counted(seg_intents(seg), F.col("intent"), "INTENTS", ", ", total=False)
    w = Window.partitionBy("call_id").orderBy("segment_id", "item")
    first = ent.entities(seg, ["call_id", "segment_id"], F.col("lang")).withColumn("k", F.row_number().over(w)).where("k <= 10")
    e = first.groupBy("call_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", F.concat("entity_type", F.lit("="), "value").alias("s")))), lambda x: x["s"]), ", ").alias("s"))
    f = fraud.scam_signals(seg).groupBy("call_id").agg(F.array_join(F.array_sort(F.collect_list(F.concat("signal_type", F.lit(" (conf="), F.format_string("%.2f", "confidence"), F.lit(")")))), "; ").alias("f"))
    h = seg.groupBy("call_id").agg(F.min("call_type").alias("call_type"), F.min("lang").alias("lang"), F.floor(F.max("end_ds") / 10).alias("secs"))
    for d in (v, o, e, f, i):
        h = h.join(d, "call_id", "left")
    return h.select("call_id", F.concat_ws("\n", F.concat(F.lit("CALL RECORD — ID: "), F.col("call_id").cast("string")), F.concat(F.lit("Type: "), "call_type"), F.concat(F.lit("Duration: "), F.col("secs").cast("string"), F.lit("s")),
                                           F.concat(F.lit("Language: "), "lang"), "VIOLATIONS", "OBLIGATIONS", F.concat(F.lit("ENTITIES: "), "s"), F.concat(F.lit("FRAUD SIGNALS: "), "f"), "INTENTS").alias("digest"))


@query("X18_record_digest", f"""WITH {SCORED}, b AS (SELECT call_id, check_name, severity, count(*) AS n FROM checks WHERE NOT passed GROUP BY 1, 2, 3), v AS (SELECT call_id, sum(n) AS nv, string_agg(check_name || ' [' || severity || '] x' || n, '; ' ORDER BY check_name, severity) AS vs FROM b GROUP BY 1)
SELECT s.call_id, concat_ws(chr(10), 'CALL RECORD — ID: ' || s.call_id, 'Type: ' || call_type, 'Risk: ' || risk, 'Compliance Score: ' || compliance_score || '/100', CASE WHEN nv > 0 THEN 'VIOLATIONS (' || CAST(nv AS BIGINT) || '): ' || vs END, CASE WHEN n_fraud > 0 THEN 'FRAUD SIGNALS: ' || n_fraud END) AS digest FROM scored s LEFT JOIN v USING (call_id)""")
def x18(spark, sf):
    k = checks(spark, sf)
    b = k.where(~F.col("passed")).groupBy("call_id", "check_name", "severity").agg(F.count(F.lit(1)).alias("n"))
    v = b.groupBy("call_id").agg(F.sum("n").alias("nv"), F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("check_name", "severity", "n"))), lambda x: F.concat(
        x["check_name"], F.lit(" ["), x["severity"], F.lit("] x"), x["n"].cast("string"))), "; ").alias("vs"))
    s = scored(spark, sf).join(v, "call_id", "left")
    line = F.concat_ws("\n", F.concat(F.lit("CALL RECORD — ID: "), F.col("call_id").cast("string")), F.concat(F.lit("Type: "), "call_type"), F.concat(F.lit("Risk: "), "risk"),
                       F.concat(F.lit("Compliance Score: "), F.col("compliance_score").cast("string"), F.lit("/100")),
                       F.when(F.col("nv") > 0, F.concat(F.lit("VIOLATIONS ("), F.col("nv").cast("string"), F.lit("): "), "vs")),
                       F.when(F.col("n_fraud") > 0, F.concat(F.lit("FRAUD SIGNALS: "), F.col("n_fraud").cast("string"))))
    return s.select("call_id", line.alias("digest"))


@query("K5_context_digest", f"""WITH {SEG}, {ENTS}, {ALLCHECKS}, {A49}, c20 AS (SELECT call_id, min(call_type) AS call_type, max(end_ds) AS e, count(DISTINCT speaker) AS sp FROM seg GROUP BY 1 ORDER BY call_id DESC LIMIT 20),
am AS (SELECT call_id, string_agg(raw_text, ', ' ORDER BY segment_id, item) AS t FROM (SELECT *, row_number() OVER (PARTITION BY call_id ORDER BY segment_id, item) AS k FROM ents WHERE entity_type = 'payment_amount') WHERE k <= 10 GROUP BY 1),
vi AS (SELECT call_id, string_agg(check_name || ' [' || severity || ']', '; ' ORDER BY check_name, severity, coalesce(segment_id, -1), evidence) AS t FROM (SELECT *, row_number() OVER (PARTITION BY call_id ORDER BY check_name, severity, coalesce(segment_id, -1), evidence) AS k FROM allc WHERE NOT passed) WHERE k <= 5 GROUP BY 1),
fr3 AS (SELECT call_id, string_agg(signal_type, '; ' ORDER BY signal_type) AS t FROM (SELECT *, row_number() OVER (PARTITION BY call_id ORDER BY signal_type) AS k FROM f49) WHERE k <= 3 GROUP BY 1),
pa AS (SELECT call_id, string_agg(left(trim(text, ' '), 200), ' | ' ORDER BY k) AS t FROM (SELECT *, row_number() OVER (PARTITION BY call_id ORDER BY len({words_sql('text')}) DESC, segment_id) AS k FROM seg) WHERE k <= 5 GROUP BY 1)
SELECT call_id, concat_ws(chr(10), '[CALL ' || call_id || '] type=' || call_type || ' duration=' || (e // 10) || 's speakers=' || sp, 'Amounts: ' || am.t, 'Violations: ' || vi.t, 'Fraud: ' || fr3.t, 'Key passages: ' || pa.t) AS digest
FROM c20 LEFT JOIN am USING (call_id) LEFT JOIN vi USING (call_id) LEFT JOIN fr3 USING (call_id) LEFT JOIN pa USING (call_id)""")
def k5(spark, sf):
    """Last 20 calls with their top children; each child list is cut by row_number before it is joined."""
    seg = settle(segments(spark, sf))
    c20 = seg.groupBy("call_id").agg(F.min("call_type").alias("call_type"), F.max("end_ds").alias("e"), F.count_distinct("speaker").alias("sp")).orderBy(F.desc("call_id")).limit(20)
    last = settle(c20)
    near = seg.join(F.broadcast(last.select("call_id")), "call_id", "left_semi")  # at most 20 rows

    def top(df, order, k, text, sep, name):
        w = Window.partitionBy("call_id").orderBy(*order)
        r = df.withColumn("k", F.row_number().over(w)).where(F.col("k") <= k)
        return r.groupBy("call_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("k", text.alias("t")))), lambda x: x["t"]), sep).alias(name))

    e = ent.entities(near, ["call_id", "segment_id"], F.col("lang")).where("entity_type = 'payment_amount'")
    v = comp.all_checks(near, vocab.seed_vocab(spark)).where(~F.col("passed"))
    sid = F.coalesce("segment_id", F.lit(-1).cast("bigint"))
    j = (last.join(top(e, ["segment_id", "item"], 10, F.col("raw_text"), ", ", "am"), "call_id", "left")
         .join(top(v, ["check_name", "severity", sid, F.asc_nulls_last("evidence")], 5, F.concat("check_name", F.lit(" ["), "severity", F.lit("]")), "; ", "vi"), "call_id", "left")
         .join(top(fraud.scam_signals(near), ["signal_type"], 3, F.col("signal_type"), "; ", "fr"), "call_id", "left")
         .join(top(near.withColumn("nw", n_words(F.col("text"))), [F.desc("nw"), "segment_id"], 5, F.substring(F.trim("text"), 1, 200), " | ", "pa"), "call_id", "left"))
    head = F.concat(F.lit("[CALL "), F.col("call_id").cast("string"), F.lit("] type="), "call_type", F.lit(" duration="), F.floor(F.col("e") / 10).cast("string"), F.lit("s speakers="), F.col("sp").cast("string"))
    return j.select("call_id", F.concat_ws("\n", head, F.concat(F.lit("Amounts: "), "am"), F.concat(F.lit("Violations: "), "vi"), F.concat(F.lit("Fraud: "), "fr"), F.concat(F.lit("Key passages: "), "pa")).alias("digest"))


@query("K6_frequency_list", f"SELECT w AS term, count(*) AS n FROM (SELECT unnest({words_sql('lower(text)')}) AS w FROM documents) GROUP BY 1 ORDER BY n DESC, term LIMIT 100")
def k6(spark, sf):
    from parleo.functions.columns import words
    w = spread(load(spark, sf, "documents").select("text")).select(F.explode(words(F.lower("text"))).alias("term"))
    return w.groupBy("term").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "term").limit(100)


@query("S14_correction_sink", "SELECT user_id AS call_id, arg_max(props, struct_pack(ts := ts, e := event_id)) AS corrections, count(*) AS n_versions FROM events GROUP BY 1")
def s14(spark, sf):
    from parleo.sources.sinks import append_corrections, latest_corrections, work_path
    path = work_path(spark, "corrections")
    e = load(spark, sf, "events").select(F.col("user_id").alias("call_id"), F.col("props").alias("corrections"), ts_utc("ts").alias("ts"), "event_id")
    append_corrections(e.where("event_id % 2 = 0"), path)
    append_corrections(e.where("event_id % 2 = 1"), path)
    return latest_corrections(spark, path)
