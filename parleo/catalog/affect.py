"""Queries over emotion, sentiment, routing and model-output policies."""
from __future__ import annotations


from pyspark.sql import functions as F

from parleo.catalog.base import *  # noqa: F403
from parleo.catalog.conduct import A49, W9S
from parleo.functions.columns import half_up, pick
from parleo.operators import emotion as emo
from parleo.operators import fraud, policy
from parleo.operators import turns as op
from parleo.plans.stage import settle
from parleo.sources import seeds, tables
from parleo.sources.tables import event_emotions, event_sentiment, frames, load, raw_turns, segments, vocal_features


def summary_sql(src: str, keys: str) -> str:
    return f"""pe AS (SELECT {keys}, emotion, count(*) AS c, sum(score_bp) AS s, count(*) FILTER (WHERE emotion IN ('angry', 'fearful') AND score_bp > 6000) AS esc FROM {src} GROUP BY ALL),
tt AS (SELECT *, sum(c) OVER (PARTITION BY {keys}) AS tot, row_number() OVER (PARTITION BY {keys} ORDER BY s / c DESC, emotion) AS rn FROM pe),
es2 AS (SELECT {keys}, max(CASE WHEN rn = 1 THEN emotion END) AS dominant, CAST(sum(c) AS BIGINT) AS total_segments, CAST(sum(esc) AS BIGINT) AS n_escalations,
 string_agg(emotion || '=' || CAST(floor(c * 1000 / tot + 0.5) AS BIGINT), ',' ORDER BY emotion) AS distribution_m FROM tt GROUP BY {keys})"""


@query("A13_emotion_summary", f"WITH {EVEMO}, {summary_sql('ee', 'call_id')} SELECT * FROM es2")
def a13(spark, sf):
    return emo.emotion_summary(event_emotions(spark, sf), ["call_id"])


@query("A14_speaker_emotions", f"WITH {EVEMO}, {summary_sql('ee', 'call_id, speaker')} SELECT * FROM es2")
def a14(spark, sf):
    return emo.emotion_summary(event_emotions(spark, sf), ["call_id", "speaker"])


@query("P7_emotion_report", f"""WITH {EVEMO}, {summary_sql('ee', 'call_id')}, mode AS (SELECT call_id, emotion, row_number() OVER (PARTITION BY call_id ORDER BY c DESC, emotion DESC) AS k FROM pe)
SELECT e.call_id, CASE WHEN dominant = 'neutral' THEN m.emotion ELSE dominant END AS shown_emotion, distribution_m, n_escalations FROM es2 e JOIN mode m ON m.call_id = e.call_id AND m.k = 1""")
def p7(spark, sf):
    s = settle(event_emotions(spark, sf).groupBy("call_id", "emotion").agg(F.count(F.lit(1)).alias("c"), F.sum("score_bp").alias("score_bp"),
               F.count_if(F.col("emotion").isin("angry", "fearful") & (F.col("score_bp") > 6000)).alias("esc")))
    dist = F.map_from_entries(F.sort_array(F.collect_list(F.struct("emotion", "c"))))
    a = s.groupBy("call_id").agg(F.min_by("emotion", F.struct(-(F.col("score_bp") / F.col("c")), F.col("emotion"))).alias("dominant"), dist.alias("d"), F.sum("esc").alias("n_escalations"))
    best = F.array_max(F.transform(F.map_entries("d"), lambda e: F.struct(e["value"].alias("v"), e["key"].alias("k"))))["k"]
    total = F.aggregate(F.map_values("d"), F.lit(0).cast("bigint"), lambda x, y: x + y)
    shown = F.when(F.col("dominant") == "neutral", best).otherwise(F.col("dominant"))
    return a.select("call_id", shown.alias("shown_emotion"), F.array_join(F.transform(F.map_entries("d"), lambda e: F.concat(
        e["key"], F.lit("="), F.floor(e["value"] * 1000 / total + 0.5).cast("string"))), ",").alias("distribution_m"), "n_escalations")


@query("X22_map_helpers", """WITH c AS (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY 1, 2)
SELECT user_id, arg_max(event_type, struct_pack(n := n, k := event_type)) AS most_frequent, string_agg(event_type || ':' || n, ',' ORDER BY event_type) AS counts, CAST(sum(n) AS BIGINT) AS total FROM c GROUP BY 1""")
def x22(spark, sf):
    c = load(spark, sf, "events").groupBy("user_id", "event_type").agg(F.count(F.lit(1)).alias("n"))
    m = c.groupBy("user_id").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("event_type", "n")))).alias("m"))
    best = F.array_max(F.transform(F.map_entries("m"), lambda e: F.struct(e["value"].alias("v"), e["key"].alias("k"))))["k"]
    return m.select("user_id", best.alias("most_frequent"), F.array_join(F.transform(F.map_entries("m"), lambda e: F.concat(e["key"], F.lit(":"), e["value"].cast("string"))), ",").alias("counts"),
                    F.aggregate(F.map_values("m"), F.lit(0).cast("bigint"), lambda a, x: a + x).alias("total"))


@query("W6_emotion_transitions", f"""WITH {EVEMO}, cf AS (SELECT *, row_number() OVER w AS rn, lead(emotion) OVER w AS nxt, count(*) OVER (PARTITION BY call_id, speaker) AS n FROM ee WHERE score_bp >= 4000 WINDOW w AS (PARTITION BY call_id, speaker ORDER BY t_ms, event_id)),
q0 AS (SELECT * FROM cf WHERE n >= 3 AND (rn = 1 OR nxt = emotion OR score_bp >= 7000)),
q1 AS (SELECT *, lag(emotion) OVER (PARTITION BY call_id, speaker ORDER BY rn) AS st FROM q0),
q2 AS (SELECT *, lag(event_id) OVER (PARTITION BY call_id, speaker ORDER BY rn) AS fr_at FROM q1 WHERE rn = 1 OR st <> emotion)
SELECT call_id, speaker, st AS from_emotion, emotion AS to_emotion, event_id AS at_segment, fr_at AS from_segment, CASE WHEN st = 'neutral' AND emotion IN {inlist(emo.NEGATIVE_EMOTIONS)} THEN 'high' WHEN st IN {inlist(emo.NEGATIVE_EMOTIONS)} AND emotion IN {inlist(emo.POSITIVE_EMOTIONS)} THEN 'medium'
 WHEN emotion IN {inlist(emo.NEGATIVE_EMOTIONS)} AND st NOT IN {inlist(emo.NEGATIVE_EMOTIONS)} THEN 'high' ELSE 'low' END AS significance FROM q2 WHERE rn > 1""")
def w6(spark, sf):
    return emo.transitions(event_emotions(spark, sf), ["call_id", "speaker"], ["t_ms", "event_id"], "event_id")


TRAJ = f"""{EVSEN}, sg0 AS (SELECT *, CASE label WHEN 'positive' THEN score_m WHEN 'negative' THEN -score_m ELSE greatest(20, CAST(floor((1000 - score_m) * 0.3e0 + 0.5) AS BIGINT)) END AS signed_m FROM es),
sg AS (SELECT *, unnest(CASE speaker WHEN 'agent' THEN ['agent'] WHEN 'customer' THEN ['customer'] ELSE ['customer', 'agent'] END) AS role FROM sg0),
tr AS (SELECT *, row_number() OVER (PARTITION BY call_id, role ORDER BY t_ms, event_id) - 1 AS ordinal, count(*) OVER (PARTITION BY call_id, role) AS n FROM sg)"""
TREND = """hv AS (SELECT call_id, any_value(n) AS n, sum(signed_m) / (count(*) * 1000e0) AS av, sum(signed_m) FILTER (WHERE ordinal < n // 2) / (count(*) FILTER (WHERE ordinal < n // 2) * 1000e0) AS a1,
 sum(signed_m) FILTER (WHERE ordinal >= n // 2) / (count(*) FILTER (WHERE ordinal >= n // 2) * 1000e0) AS a2 FROM tr WHERE role = 'customer' GROUP BY 1),
td AS (SELECT *, CASE WHEN n >= 4 THEN CASE WHEN a2 - a1 < -0.3e0 AND a2 < -0.3e0 THEN 'high' WHEN a2 - a1 < -0.15e0 THEN 'medium' ELSE 'low' END WHEN av < -0.4e0 THEN 'medium' ELSE 'low' END AS risk FROM hv)"""


def _traj(spark, sf):
    return emo.trajectory(emo.signed_scores(event_sentiment(spark, sf)), ["t_ms", "event_id"])


@query("X17_sentiment_sign", f"WITH {TRAJ} SELECT call_id, role, ordinal, event_id, signed_m FROM tr")
def x17(spark, sf):
    return _traj(spark, sf).select("call_id", "role", "ordinal", "event_id", "signed_m")


@query("J24_trajectory_zip", f"WITH {TRAJ}, c AS (SELECT call_id, ordinal, signed_m AS customer_m FROM tr WHERE role = 'customer'), a AS (SELECT call_id, ordinal, signed_m AS agent_m FROM tr WHERE role = 'agent') SELECT call_id, ordinal, customer_m, agent_m FROM c FULL JOIN a USING (call_id, ordinal)")
def j24(spark, sf):
    return emo.zip_trajectories(_traj(spark, sf))


@query("W7_trajectory_trend", f"WITH {TRAJ}, {TREND} SELECT call_id, n, {hu('av', 4)} AS mean, CASE WHEN n >= 4 THEN {hu('a2 - a1', 4)} END AS trend, risk AS escalation_risk FROM td")
def w7(spark, sf):
    return emo.trend(_traj(spark, sf))


CTYPE = f"{lst(tables.CALL_TYPES)}[call_id % 6 + 1]"


@query("A17_dominant_emotion", f"WITH {TRAJ} SELECT call_id, CASE WHEN sum(signed_m) / (count(*) * 1000e0) > 0.3e0 THEN 'positive' WHEN sum(signed_m) / (count(*) * 1000e0) < -0.5e0 THEN 'angry' WHEN sum(signed_m) / (count(*) * 1000e0) < -0.3e0 THEN 'frustrated' ELSE 'neutral' END AS dominant FROM tr WHERE role = 'customer' GROUP BY 1")
def a17(spark, sf):
    s = emo.signed_scores(event_sentiment(spark, sf)).where("role = 'customer'")
    return s.groupBy("call_id").agg(emo.dominant_from_mean(F.sum("signed_m") / (F.count(F.lit(1)) * 1000)).alias("dominant"))


@query("A18_sentiment_context", f"""WITH {TRAJ}, {TREND}, m AS (SELECT call_id, coalesce(sum(signed_m) FILTER (WHERE role = 'customer') / (count(*) FILTER (WHERE role = 'customer') * 1000e0), 0) AS c, coalesce(sum(signed_m) FILTER (WHERE role = 'agent') / (count(*) FILTER (WHERE role = 'agent') * 1000e0), 0) AS a, {CTYPE} IN {inlist(emo.EMOTIONAL_TYPES)} AS em FROM tr GROUP BY 1),
k AS (SELECT *, CASE WHEN c > 0.2e0 THEN 'positive' WHEN c > -0.2e0 THEN 'neutral' WHEN em THEN 'emotional_negative' ELSE 'financial_negative' END AS ct, CASE WHEN a > 0.2e0 THEN 'positive' WHEN a > -0.2e0 THEN 'neutral' ELSE 'financial_negative' END AS att FROM m)
SELECT k.call_id, ct AS customer_sentiment_type, att AS agent_sentiment_type, ct = 'emotional_negative' OR (att = 'financial_negative' AND a < -0.4e0) AS actionable, coalesce(risk, 'low') AS escalation_risk FROM k LEFT JOIN td USING (call_id)""")
def a18(spark, sf):
    return emo.sentiment_context(settle(_traj(spark, sf)), tables.call_type_of(F.col("call_id")))


EVLABELS = list(tables.EVENT_EMOTION.values())


@query("W16_label_windows", f"""WITH {EVEMO}, p AS (SELECT *, row_number() OVER (PARTITION BY call_id ORDER BY t_ms, event_id) - 1 AS pos, count(*) OVER (PARTITION BY call_id) AS n FROM ee)
SELECT call_id, CAST(pos // greatest(1, n // 30) + 1 AS BIGINT) AS window_no, {', '.join(f"CAST(floor(count(*) FILTER (WHERE emotion = {q(l)}) * 100 / count(*) + 0.5) AS BIGINT) AS pct_{l}" for l in EVLABELS)} FROM p GROUP BY 1, 2""")
def w16(spark, sf):
    return emo.label_windows(event_emotions(spark, sf), ["t_ms", "event_id"], EVLABELS)


# ---- intents -------------------------------------------------------------------------------
_rules = seeds.INTENT_KEYWORDS
_LOW = "lower(trim(text, ' '))"


def _cond(head: tuple[str, float]) -> str:
    if head[0] == "question":
        return "(rtrim({0}, ' ') LIKE '%?' OR ".format(_LOW) + " OR ".join(f"starts_with({_LOW}, {q(k)})" for k in _rules[head]) + ")"
    return "(" + " OR ".join(f"contains({_LOW}, {q(k)})" for k in _rules[head]) + ")"


KWI = "CASE " + " ".join(f"WHEN {_cond(h)} THEN {q(h[0])}" for h in _rules) + " WHEN call_type = 'general' THEN 'info_request' ELSE 'unknown' END"
KWC = "CASE " + " ".join(f"WHEN {_cond(h)} THEN {h[1]}e0" for h in _rules) + " WHEN call_type = 'general' THEN 0.5e0 ELSE 0.3e0 END"
SEN = "s_label AS (SELECT *, ['negative', 'neutral', 'positive'][(conv_id * 3 + turn) % 3 + 1] AS label, (length(text) * 17 + conv_id * 7) % 1001 AS score_m FROM seg)"
_CLEAN = r"rtrim(regexp_replace(lower(trim(text, ' ')), '\.+$', ''), ' ')"
ROUTE = f"""CASE WHEN nw <= 3 AND lang = 'en' AND {_CLEAN} IN {inlist([p for _, p in seeds.entries(seeds.TRIVIAL_EN)])} THEN 'skip' WHEN nw <= 2 AND lang <> 'en' THEN 'skip'
 WHEN label = 'negative' AND score_m > 850 THEN 'negative_subset' WHEN label = 'neutral' AND score_m > 900 AND nw <= 5 THEN 'skip' ELSE 'full' END"""
ROUTED = f"{SEN}, rt0 AS (SELECT *, len({words_sql('text')}) AS nw FROM s_label), rt AS (SELECT *, {ROUTE} AS route FROM rt0)"
MLABELS = ["payment_promise", "Info Request", "unknown", "bogus label", "refusal", "agreement", "escalation"]
MODEL = f"ml AS (SELECT call_id, segment_id, {lst(MLABELS)}[(conv_id * 11 + turn * 3) % 7 + 1] AS model_label, CASE WHEN turn % 4 = 0 THEN NULL ELSE ((conv_id * 17 + turn * 29) % 130) / 100e0 END AS model_conf FROM seg WHERE (conv_id + turn) % 3 = 0)"
_RAW = "replace(lower(trim(model_label, ' ')), ' ', '_')"
INTENTS = f"""{ROUTED}, {MODEL}, im AS (SELECT rt.*, model_label, model_conf, CASE WHEN {_RAW} IN {inlist(policy.VALID_INTENTS)} THEN {_RAW} WHEN model_label IS NOT NULL THEN 'unknown' END AS vl, {KWI} AS kw, {KWC} AS kc FROM rt LEFT JOIN ml USING (call_id, segment_id) WHERE trim(text, ' ') <> ''),
intents AS (SELECT call_id, segment_id, speaker, call_type, text, lang, CASE WHEN route = 'skip' THEN CASE WHEN lang = 'en' AND {_CLEAN} IN {inlist([p for _, p in seeds.entries(seeds.GREETINGS_EN)])} THEN 'greeting' ELSE 'acknowledgment' END WHEN vl IS NULL OR (vl = 'unknown' AND kw <> 'unknown') THEN kw ELSE vl END AS intent,
 CASE WHEN route = 'skip' THEN 0.9e0 WHEN vl IS NULL OR (vl = 'unknown' AND kw <> 'unknown') THEN kc ELSE greatest(0e0, least(1e0, coalesce(model_conf, 0.7e0))) END AS confidence FROM im)"""


def with_sentiment(seg):
    return seg.withColumns({"label": pick((F.col("conv_id") * 3 + F.col("turn")) % 3, ["negative", "neutral", "positive"]),
                            "score_m": (F.length("text") * 17 + F.col("conv_id") * 7) % 1001})


def routed(seg, vocabulary):
    r = policy.phrase_flags(with_sentiment(seg), vocabulary)
    return r.withColumn("route", policy.route(F.col("text"), F.col("lang"), F.col("label"), F.col("score_m"), F.col("is_trivial"), F.col("lang_known")))


def seg_intents(seg, vocabulary=None):
    r = routed(seg, vocab.seed_vocab(seg.sparkSession) if vocabulary is None else vocabulary)
    ml = seg.where((F.col("conv_id") + F.col("turn")) % 3 == 0).select(
        "call_id", "segment_id", pick((F.col("conv_id") * 11 + F.col("turn") * 3) % 7, MLABELS).alias("model_label"),
        F.when(F.col("turn") % 4 != 0, ((F.col("conv_id") * 17 + F.col("turn") * 29) % 130) / 100).alias("model_conf"))
    return policy.assemble_intents(r, ml)


@query("X12_keyword_intent", f"WITH {SEG} SELECT conv_id, turn, {KWI} AS intent, {KWC} AS confidence FROM seg")
def x12(spark, sf):
    k = policy.keyword_intent(F.col("text"), F.col("call_type"))
    return raw_turns(spark, sf).select("conv_id", "turn", k.alias("k")).select("conv_id", "turn", "k.intent", "k.confidence")


@query("X13_routing", f"WITH {SEG}, {ROUTED} SELECT conv_id, turn, route FROM rt")
def x13(spark, sf):
    return routed(raw_turns(spark, sf), vocab.seed_vocab(spark)).select("conv_id", "turn", "route")


# A vocabulary as it stands in files: two languages of the turns, none for Tamil.
FILES = {
    "en": {"trivial_phrases": [p for _, p in seeds.entries(seeds.TRIVIAL_EN)], "greetings": [p for _, p in seeds.entries(seeds.GREETINGS_EN)]},
    "hi": {"trivial_phrases": ["हाँ", "ठीक है", "नमस्ते"], "greetings": ["नमस्ते"]},
}
SAID = ["नमस्ते.", "हाँ", "ठीक है", "बिल्कुल सही", "Hello"]
SHORTSEG = f"seg AS (SELECT * REPLACE (CASE WHEN (conv_id + turn) % 4 = 0 THEN {lst(SAID)}[(conv_id + turn * 3) % 5 + 1] ELSE text END AS text) FROM seg0)"
SEG0 = SEG.replace("\nseg AS (", "\nseg0 AS (") + ", " + SHORTSEG
_IN = lambda d: " OR ".join(f"(lang = {q(l)} AND {_CLEAN} IN {inlist(v[d])})" for l, v in FILES.items())
VROUTE = f"""CASE WHEN nw <= 3 AND ({_IN('trivial_phrases')}) THEN 'skip' WHEN nw <= 2 AND lang NOT IN ('en', 'hi') THEN 'skip'
 WHEN label = 'negative' AND score_m > 850 THEN 'negative_subset' WHEN label = 'neutral' AND score_m > 900 AND nw <= 5 THEN 'skip' ELSE 'full' END"""


def short_turns(spark, sf):
    t = raw_turns(spark, sf)
    return t.withColumn("text", F.when((F.col("conv_id") + F.col("turn")) % 4 == 0, pick((F.col("conv_id") + F.col("turn") * 3) % 5, SAID)).otherwise(F.col("text")))


@query("X13_vocabulary_routing", f"WITH {SEG0}, {ROUTED.replace(ROUTE, VROUTE)} SELECT conv_id, turn, lang, route, route = 'skip' AND ({_IN('greetings')}) AS greets FROM rt")
def x13b(spark, sf):
    """Routing by vocabulary files that the query writes and reads back."""
    r = routed(short_turns(spark, sf), vocab.round_trip(spark, FILES))
    return r.select("conv_id", "turn", "lang", "route", ((F.col("route") == "skip") & F.col("is_greeting")).alias("greets"))


@query("M7_intent_assembly", f"WITH {SEG}, {INTENTS} SELECT call_id, segment_id, speaker, intent, {hu('confidence', 2)} AS confidence FROM intents")
def m7(spark, sf):
    return seg_intents(segments(spark, sf)).select("call_id", "segment_id", "speaker", "intent", half_up(F.col("confidence"), 2).alias("confidence"))


@query("W22_segment_order", f"WITH {SEG}, {INTENTS} SELECT call_id, segment_id, intent FROM intents")
def w22(spark, sf):
    return seg_intents(segments(spark, sf)).select("call_id", "segment_id", "intent").orderBy("call_id", "segment_id")


@query("P17_intent_split", f"WITH {SEG}, {INTENTS} SELECT call_id, segment_id, intent, CASE WHEN intent = 'unknown' AND confidence < 0.5e0 THEN 'uncertain' ELSE 'confident' END AS bucket FROM intents")
def p17(spark, sf):
    i = seg_intents(segments(spark, sf))
    weak = (F.col("intent") == "unknown") & (F.col("confidence") < 0.5)
    return i.select("call_id", "segment_id", "intent", F.when(weak, "uncertain").otherwise("confident").alias("bucket"))


@query("A22_escalation", f"WITH {SEG}, {INTENTS}, {EMO}, {summary_sql('emo', 'call_id')}, i AS (SELECT call_id, bool_or(intent = 'escalation') AS e FROM intents GROUP BY 1) SELECT call_id, e AS by_intent, dominant, e OR dominant IN ('angry', 'frustrated') AS escalated FROM i JOIN es2 USING (call_id)")
def a22(spark, sf):
    seg = settle(segments(spark, sf))
    i = seg_intents(seg).groupBy("call_id").agg(F.bool_or(F.col("intent") == "escalation").alias("by_intent"))
    d = emo.emotion_summary(tables.segment_emotions(seg), ["call_id"]).select("call_id", "dominant")
    return i.join(d, "call_id").withColumn("escalated", F.col("by_intent") | F.col("dominant").isin("angry", "frustrated"))


# ---- model scores ----------------------------------------------------------------------------
TOX = """tox AS (SELECT d.doc_id, CASE WHEN d.doc_id % 2 = 0 THEN 'agent' ELSE 'customer' END AS speaker, (d.doc_id * 7919 + n_chars * 31) % 1001 AS toxicity, (d.doc_id * 31 + n_chars) % 601 AS severe_toxicity, (d.doc_id * 13 + n_chars * 3) % 801 AS obscene,
 (d.doc_id * 17) % 751 AS identity_attack, (d.doc_id * 19 + n_chars * 5) % 901 AS insult, (d.doc_id * 23 + toxic * 300) % 851 AS threat, (d.doc_id * 29) % 721 AS sexual_explicit FROM documents d JOIN labels l USING (doc_id))"""
_CATS = ", ".join(f"CASE WHEN {c} >= {t} THEN {q(c)} END" for c, t in policy.TOXIC)
TOXF = f"""{TOX}, txf AS (SELECT doc_id, speaker, toxicity, array_to_string(list_filter([{_CATS}], lambda x: x IS NOT NULL), ',') AS categories, CASE WHEN severe_toxicity >= 500 OR threat >= 800 THEN 'critical' WHEN toxicity >= 900 OR (speaker = 'agent' AND toxicity >= 700) THEN 'high' WHEN toxicity >= 700 THEN 'medium' ELSE 'low' END AS severity, speaker = 'agent' AS is_agent FROM tox)"""


def _tox(spark, sf):
    d, n = F.col("doc_id"), F.col("n_chars")
    return load(spark, sf, "documents").select("doc_id", "n_chars").join(load(spark, sf, "labels"), "doc_id").select(
        "doc_id", F.when(d % 2 == 0, "agent").otherwise("customer").alias("speaker"), ((d * 7919 + n * 31) % 1001).alias("toxicity"), ((d * 31 + n) % 601).alias("severe_toxicity"),
        ((d * 13 + n * 3) % 801).alias("obscene"), ((d * 17) % 751).alias("identity_attack"), ((d * 19 + n * 5) % 901).alias("insult"),
        ((d * 23 + F.col("toxic") * 300) % 851).alias("threat"), ((d * 29) % 721).alias("sexual_explicit"))


@query("M1_toxicity_policy", f"WITH {TOXF} SELECT * FROM txf WHERE categories <> ''")
def m1(spark, sf):
    return policy.toxicity_flags(_tox(spark, sf)).select("doc_id", "speaker", "toxicity", "categories", "severity", "is_agent")


ALAB = ["abusive", "not abusive", "Offensive", "hate speech", "neutral"]
ABU = f"""ab0 AS (SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN 'agent' ELSE 'customer' END AS speaker, {lst(ALAB)}[(doc_id * 7 + n_chars) % 5 + 1] AS label, (doc_id * 37 + n_chars * 11) % 1001 AS score_m FROM documents WHERE length(trim(text, ' ')) > 2),
ab1 AS (SELECT *, regexp_matches(lower(label), 'abusive|offensive|hate') AND NOT contains(lower(label), 'not') AS bad FROM ab0),
ab2 AS (SELECT doc_id, speaker, CASE WHEN bad THEN lower(label) ELSE 'possibly_abusive' END AS flag, CASE WHEN bad THEN score_m ELSE 1000 - score_m END AS flag_m FROM ab1 WHERE (bad AND score_m >= 600) OR (NOT bad AND score_m < 400)),
abu AS (SELECT *, CASE WHEN flag_m >= 900 THEN CASE WHEN speaker = 'agent' THEN 'critical' ELSE 'high' END ELSE CASE WHEN speaker = 'agent' THEN 'high' ELSE 'medium' END END AS severity FROM ab2)"""


def _abuse(spark, sf):
    d = load(spark, sf, "documents").where(F.length(F.trim("text")) > 2)
    s = d.select("doc_id", F.when(F.col("doc_id") % 2 == 0, "agent").otherwise("customer").alias("speaker"), pick((F.col("doc_id") * 7 + F.col("n_chars")) % 5, ALAB).alias("label"),
                 ((F.col("doc_id") * 37 + F.col("n_chars") * 11) % 1001).alias("score_m"))
    return policy.abuse_flags(s)


@query("M2_abuse_policy", f"WITH {ABU} SELECT doc_id, speaker, flag, flag_m, severity FROM abu")
def m2(spark, sf):
    return _abuse(spark, sf).select("doc_id", "speaker", "flag", "flag_m", "severity")


@query("J21_toxicity_overlay", f"WITH {TOXF}, {ABU}, f AS (SELECT doc_id, severity FROM txf WHERE categories <> '') SELECT doc_id, severity, 'first' AS model FROM f UNION ALL SELECT doc_id, severity, 'second' FROM abu WHERE doc_id NOT IN (SELECT doc_id FROM f)")
def j21(spark, sf):
    first = policy.toxicity_flags(_tox(spark, sf)).select("doc_id", "severity")
    return policy.overlay_flags(first, _abuse(spark, sf).select("doc_id", "severity"), ["doc_id"])


_H = list(policy.SCAM_HYPOTHESES.values())
ZS = f"""zs0 AS (SELECT doc_id, unnest({lst(_H)}) AS t, unnest([-0, -1, -2, -3, -4]) AS i, unnest([(doc_id * 41 + n_chars) % 1001, (doc_id * 43 + n_chars * 3) % 1001, (doc_id * 47 + n_chars * 7) % 1001, (doc_id * 53) % 1001, (doc_id * 59 + n_chars) % 1001]) AS s FROM documents WHERE length(trim(text, ' ')) > 10),
zs AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY s DESC, i DESC) AS rn FROM zs0)"""


@query("M3_zero_shot_scam", f"WITH {ZS} SELECT doc_id, 'scam_' || t AS signal_type, s AS score_m FROM zs WHERE rn = 1 AND t <> 'legitimate' AND s >= 700")
def m3(spark, sf):
    d, n = F.col("doc_id"), F.col("n_chars")
    cols = [(d * 41 + n) % 1001, (d * 43 + n * 3) % 1001, (d * 47 + n * 7) % 1001, (d * 53) % 1001, (d * 59 + n) % 1001]
    x = load(spark, sf, "documents").where(F.length(F.trim("text")) > 10).withColumn("z", policy.scam_hypothesis(dict(zip(policy.SCAM_HYPOTHESES, cols))))
    return x.where("z is not null").select("doc_id", "z.signal_type", "z.score_m")


M4LAB = [["/angry/", "生气/neutral", "other"], ["HAPPY", "<unk>", "/neutral/"], ["very sad", "Surprised", "other"]]


@query("M4_emotion_parse", f"""WITH {FR}, p AS (SELECT event_id, unnest(CASE event_id % 3 WHEN 0 THEN ['angry', 'neutral', 'other'] WHEN 1 THEN ['happy', '<unk>', 'neutral'] ELSE ['sad', 'surprised', 'other'] END) AS e, unnest([v100 % 1000, event_id * 37 % 1000, event_id * 61 % 1000]) AS s, unnest([0, 1, 2]) AS i FROM fr),
r AS (SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY s DESC, i) AS rn, max(CASE WHEN e = 'neutral' THEN s END) OVER (PARTITION BY event_id) AS ns FROM p)
SELECT event_id, CASE WHEN s < 400 OR e = 'other' THEN 'neutral' ELSE e END AS emotion, CASE WHEN s < 400 OR e = 'other' THEN coalesce(ns, s) ELSE s END AS score_m, s < 400 OR e = 'other' AS low_confidence FROM r WHERE rn = 1""")
def m4(spark, sf):
    sets = F.array(*[F.array(*[F.lit(x) for x in s]) for s in M4LAB])
    labels = F.element_at(sets, (F.col("event_id") % 3 + 1).cast("int"))
    scores = F.array(F.col("v100") % 1000, F.col("event_id") * 37 % 1000, F.col("event_id") * 61 % 1000)
    return frames(spark, sf).select("event_id", emo.parse_emotion(labels, scores).alias("p")).select("event_id", "p.emotion", "p.score_m", "p.low_confidence")


@query("M8_batched_scoring", f"WITH {SEG}, w AS (SELECT conv_id, turn, len(list_intersect(list_distinct({words_sql('lower(text)')}), {lst(seeds.POSITIVE)})) AS p, len(list_intersect(list_distinct({words_sql('lower(text)')}), {lst(seeds.NEGATIVE)})) AS n FROM seg) SELECT conv_id, turn, CASE WHEN p = n THEN 'neutral' WHEN p > n THEN 'positive' ELSE 'negative' END AS label, CASE WHEN p + n = 0 THEN 0.5e0 ELSE greatest(p, n) / (p + n) END AS score FROM w")
def m8(spark, sf):
    return policy.score_texts(raw_turns(spark, sf), ["conv_id", "turn"])


# ---- replies ---------------------------------------------------------------------------------
def _reply(conv, turn, cat):
    return cat([" - ", turn, "|Agreement|0.", conv, "\n", turn, "|made up|abc\n-1|refusal|0.5\nENTITY| currency_amount |", conv, "|raw | text\nOBLIGATION|customer|promise|I will pay ", turn, "\nENTITY|short\nno bars here\n* 7|info request|1.", conv, " *"])


REPLY_SQL = _reply("(conv_id % 90 + 10)", "turn", lambda ps: " || ".join(p if p[0] in "(t" and not p.startswith("text") else q(p).replace("\n", "' || chr(10) || '") for p in ps))
X15 = rf"""rp AS (SELECT conv_id, turn, unnest(string_split({REPLY_SQL}, chr(10))) AS l0 FROM conversations),
ln AS (SELECT *, trim(l0, ' ') AS l, trim(regexp_replace(trim(l0, ' '), '^[-*\s]+|[-*\s]+$', '', 'g'), ' ') AS b FROM rp),
pp AS (SELECT *, string_split(b, '|') AS f, string_split(l, '|') AS g FROM ln),
kk AS (SELECT *, TRY_CAST(trim(f[1], ' ') AS INTEGER) AS idx, CASE WHEN starts_with(l, 'ENTITY|') AND len(g) >= 4 THEN 'entity' WHEN starts_with(l, 'OBLIGATION|') AND len(g) >= 4 THEN 'obligation' WHEN len(f) >= 2 AND TRY_CAST(trim(f[1], ' ') AS INTEGER) >= 0 THEN 'intent' END AS kind FROM pp)"""


def _replies(spark, sf):
    c = (F.col("conv_id") % 90 + 10).cast("string")
    parts = _reply(c, F.col("turn").cast("string"), lambda ps: F.concat(*[F.lit(p) if isinstance(p, str) else p for p in ps]))
    return load(spark, sf, "conversations").select("conv_id", "turn", parts.alias("raw"))


@query("X15_reply_lines", f"""WITH {X15} SELECT conv_id, turn, kind, CASE WHEN kind = 'intent' THEN CAST(idx AS BIGINT) END AS idx, CASE WHEN kind = 'intent' THEN CASE WHEN replace(lower(trim(f[2], ' ')), ' ', '_') IN {inlist(policy.VALID_INTENTS)} THEN replace(lower(trim(f[2], ' ')), ' ', '_') ELSE 'unknown' END ELSE trim(g[2], ' ') END AS label,
 CASE WHEN kind <> 'intent' THEN trim(g[3], ' ') END AS value, CASE WHEN kind <> 'intent' THEN trim(array_to_string(g[4:], '|'), ' ') END AS text, CASE WHEN kind = 'intent' THEN greatest(0e0, least(1e0, coalesce(TRY_CAST(trim(f[3], ' ') AS DOUBLE), 0.7e0))) WHEN kind = 'entity' THEN 0.7e0 END AS confidence FROM kk WHERE kind IS NOT NULL""")
def x15(spark, sf):
    return policy.parse_reply_lines(_replies(spark, sf), ["conv_id", "turn"])


def _sections(conv, turn, cat):
    return cat(["SUMMARY: Call about account ", conv, "\nand its payment\n\nKey OUTCOMES\n- Outcome 1: promise ", turn, "\n- [Outcome 2]\n* first key outcome here\nACTIONS:\n- Action 2: call back ", conv, "\nstray line\n- write a concise note"])


SEC_SQL = _sections("conv_id", "turn", lambda ps: " || ".join(p if p in ("conv_id", "turn") else q(p).replace("\n", "' || chr(10) || '") for p in ps))


@query("X16_summary_sections", """SELECT conv_id, turn, 'Call about account ' || conv_id || ' and its payment' AS summary, 'promise ' || turn AS outcomes, 'call back ' || conv_id AS actions FROM conversations""")
def x16(spark, sf):
    t = _sections(F.col("conv_id").cast("string"), F.col("turn").cast("string"), lambda ps: F.concat(*[F.lit(p) if isinstance(p, str) else p for p in ps]))
    return policy.summary_sections(load(spark, sf, "conversations").select("conv_id", "turn", t.alias("raw")), ["conv_id", "turn"])


@query("X24_status_ladders", f"""WITH {FR} SELECT event_id, CASE WHEN v100 % 2 = 0 THEN 'reviewed' WHEN event_id % 10 >= 7 THEN 'escalated' WHEN event_id % 10 >= 4 THEN 'flagged' ELSE 'pending' END AS status, CASE WHEN v100 % 100 >= 70 THEN 'high' WHEN v100 % 100 >= 40 THEN 'medium' WHEN v100 % 100 >= 10 THEN 'low' ELSE 'none' END AS risk,
 CASE event_id % 4 WHEN 0 THEN 'agent' WHEN 1 THEN 'customer' WHEN 2 THEN 'agent' ELSE 'other' END AS role, lower(trim(' ' || upper(event_type) || ' ', ' ')) AS label FROM fr""")
def x24(spark, sf):
    raw = pick(F.col("event_id") % 4, ["Senior Agent", "SPEAKER_01", "SPEAKER_00", ""])
    low = F.lower(raw)
    role = F.when(low.contains("agent") | (low == "speaker_00"), "agent").when(low.contains("customer") | (low == "speaker_01"), "customer").when(low == "", "other").otherwise(low)
    c, p = F.col("v100") % 100, F.col("event_id") % 10
    return frames(spark, sf).select(
        "event_id", F.when(F.col("v100") % 2 == 0, "reviewed").when(p >= 7, "escalated").when(p >= 4, "flagged").otherwise("pending").alias("status"),
        F.when(c >= 70, "high").when(c >= 40, "medium").when(c >= 10, "low").otherwise("none").alias("risk"), role.alias("role"),
        F.lower(F.trim(F.concat(F.lit(" "), F.upper("event_type"), F.lit(" ")))).alias("label"))


# ---- all detectors ------------------------------------------------------------------------------
ABS = f"ab AS (SELECT call_id, segment_id, {lst(ALAB)}[(conv_id * 7 + length(text)) % 5 + 1] AS label, (conv_id * 37 + length(text) * 11) % 1001 AS score_m FROM seg WHERE length(trim(text, ' ')) > 5), abx AS (SELECT *, regexp_matches(lower(label), 'abusive|offensive|hate') AND NOT contains(lower(label), 'not') AS bad FROM ab)"


@query("U1_all_detectors", f"""WITH {SEG}, {A49}, {W9S}, {ABS}, sp AS (SELECT call_id, count(DISTINCT speaker) AS n FROM seg GROUP BY 1),
sh1 AS (SELECT call_id, sum(CASE WHEN speaker = 'agent' THEN dur_ds ELSE 0 END) AS a, sum(dur_ds) AS t FROM seg GROUP BY 1),
zz AS (SELECT call_id, segment_id, unnest({lst(_H)}) AS t, unnest([0, -1, -2, -3, -4]) AS i, unnest([(conv_id * 41 + length(text)) % 1001, (conv_id * 43 + turn * 3) % 1001, (conv_id * 47 + turn * 7) % 1001, (conv_id * 53) % 1001, (conv_id * 59 + length(text)) % 1001]) AS s FROM seg WHERE length(trim(text, ' ')) > 10),
zr AS (SELECT *, row_number() OVER (PARTITION BY call_id, segment_id ORDER BY s DESC, i DESC) AS rn FROM zz)
SELECT call_id, segment_id, signal_type, confidence FROM f49
UNION ALL SELECT call_id, segment_id, 'voice_stress_anomaly', {hu('least(0.9e0, stress / 3)', 4)} FROM dev WHERE stress > 1.5e0
UNION ALL SELECT call_id, 0, 'third_party_detected', 0.7e0 FROM sp WHERE n > 2
UNION ALL SELECT call_id, 0, 'agent_monologue', 0.5e0 FROM sh1 WHERE t > 600 AND a / greatest(t, 10) > 0.8e0
UNION ALL SELECT call_id, segment_id, 'abusive_content', {hu('CASE WHEN bad THEN score_m ELSE 1000 - score_m END / 1000e0', 4)} FROM abx WHERE (bad AND score_m >= 700) OR (NOT bad AND score_m < 300)
UNION ALL SELECT call_id, segment_id, 'scam_' || t, {hu('s / 1000e0', 4)} FROM zr WHERE rn = 1 AND t <> 'legitimate' AND s >= 700""")
def u1(spark, sf):
    seg = settle(segments(spark, sf))
    return fraud.union_signals(*detectors(seg))


def detectors(seg):
    """The six detectors on the same turns, each in the common shape."""
    zero = F.lit(0).cast("bigint").alias("segment_id")
    feats = vocal_features(seg).where(F.col("dur_ds") >= 5)
    stress = fraud.voice_stress(feats, fraud.calm_baseline(feats)).withColumn("signal_type", F.lit("voice_stress_anomaly"))
    coached = op.coached_speech(seg.withColumn("seg_lang", F.when(F.col("segment_id") % 2 == 0, F.col("lang")).otherwise("en"))).where("coached").select(
        "call_id", F.col("first_segment").alias("segment_id"), F.lit("coached_speech").alias("signal_type"), "confidence")
    third = op.speaker_counts(seg).where("third_party").select("call_id", zero, F.lit("third_party_detected").alias("signal_type"), "confidence")
    mono = op.agent_monologue(op.talk_shares(seg)).where("monologue").select("call_id", zero, F.lit("agent_monologue").alias("signal_type"), "confidence")
    n = F.length("text")
    ab = seg.where(F.length(F.trim("text")) > 5).select("call_id", "segment_id", "speaker", pick((F.col("conv_id") * 7 + n) % 5, ALAB).alias("label"), ((F.col("conv_id") * 37 + n * 11) % 1001).alias("score_m"))
    abuse = policy.abuse_flags(ab, 700).select("call_id", "segment_id", F.lit("abusive_content").alias("signal_type"), half_up(F.col("flag_m") / 1000, 4).alias("confidence"))
    c, t = F.col("conv_id"), F.col("turn")
    cols = [(c * 41 + n) % 1001, (c * 43 + t * 3) % 1001, (c * 47 + t * 7) % 1001, (c * 53) % 1001, (c * 59 + n) % 1001]
    zs = seg.where(F.length(F.trim("text")) > 10).withColumn("z", policy.scam_hypothesis(dict(zip(policy.SCAM_HYPOTHESES, cols)))).where("z is not null").select(
        "call_id", "segment_id", "z.signal_type", half_up(F.col("z.score_m") / 1000, 4).alias("confidence"))
    return [fraud.scam_signals(seg), stress, coached, third, mono, abuse, zs]
