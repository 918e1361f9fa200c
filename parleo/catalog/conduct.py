"""Queries over phrases, conduct rules and fraud signals."""
from __future__ import annotations

from pyspark.sql import functions as F

from parleo.catalog.base import *  # noqa: F403
from parleo.catalog.turns import SHARES
from parleo.functions.columns import half_up
from parleo.operators import compliance as comp
from parleo.operators import fraud, matching
from parleo.operators import turns as op
from parleo.plans.stage import settle
from parleo.sources import seeds, tables, vocab
from parleo.sources.tables import calls, checks, event_emotions, load, raw_turns, segments, segment_emotions, spread, vocal_features

REG = inlist(seeds.REGULATED)
BAD = values_cte("bad", "v_lang, category, phrase", [(r[0], r[3], r[4]) for r in vocab.phrases("prohibited")])
ENDC = vocab_cte("endc", "end_call")
THIRD = vocab_cte("third", "third_party")
DISC = vocab_cte("disc", "disclosure")
SCAM = vocab_cte("scam", "scam")


def token_hit(text: str, phrase: str) -> str:
    return f"(contains(' ' || {norm_sql(text)} || ' ', ' ' || {norm_sql(phrase)} || ' ') AND contains(lower({text}), lower({phrase})))"


def sev(ct: str, raw: str) -> str:
    return (f"CASE WHEN {ct} IN ('collections', 'kyc', 'consent') THEN {raw} WHEN {ct} IN ('complaint', 'onboarding') THEN "
            f"CASE {raw} WHEN 'critical' THEN 'high' WHEN 'high' THEN 'medium' ELSE 'low' END ELSE 'low' END")


def full(name: str, where: str = "true") -> str:
    return f"{name} AS (SELECT call_id, min(call_type) AS call_type, min(lang) AS lang, string_agg(lower(text), ' ' ORDER BY segment_id) AS t FROM seg WHERE {where} GROUP BY 1)"


@query("J12_phrase_match", f"WITH {SEG}, {BAD} SELECT call_id, segment_id, v_lang AS lang, category, phrase FROM seg, bad WHERE {token_hit('text', 'phrase')}")
def j12(spark, sf):
    v = vocab.seed_vocab(spark).where(F.col("domain") == "prohibited").select(F.col("lang").alias("v_lang"), "category", "phrase")
    h = matching.phrase_hits(segments(spark, sf), v, ["call_id", "segment_id"], "text")
    return h.select("call_id", "segment_id", F.col("v_lang").alias("lang"), "category", "phrase")


@query("J12_phrase_match_documents", f"""WITH v AS (SELECT unnest(['inen', 'en er', 'the on', 'la que', 'und der', 'ion']) AS phrase)
SELECT doc_id, phrase FROM documents, v WHERE {token_hit('text', 'phrase')}""")
def j12d(spark, sf):
    v = vocab.local_table(spark, [(p,) for p in ["inen", "en er", "the on", "la que", "und der", "ion"]], "phrase string")
    return matching.phrase_hits(spread(load(spark, sf, "documents").select("doc_id", "text")), v, ["doc_id"], "text").select("doc_id", "phrase")


@query("J13_substring_match", f"WITH {SEG}, {SCAM} SELECT call_id, segment_id, category, phrase FROM seg, scam WHERE contains(lower(text), phrase)")
def j13(spark, sf):
    return matching.substring_hits(segments(spark, sf), seeds.entries(seeds.SCAM_EN), ["call_id", "segment_id"], "text").drop("rank")


@query("J14_effective_vocabulary", f"""WITH {SEG}, langs AS (SELECT DISTINCT lang FROM seg), {BAD},
e AS (SELECT l.lang, category, phrase FROM langs l JOIN bad ON v_lang = l.lang UNION SELECT l.lang, category, phrase FROM langs l, bad WHERE v_lang = 'en'),
n AS (SELECT lang, count(*) AS n_turns FROM seg GROUP BY 1) SELECT e.lang, category, phrase, n_turns FROM e JOIN n USING (lang)""")
def j14(spark, sf):
    seg = raw_turns(spark, sf)
    v = vocab.seed_vocab(spark).where(F.col("domain") == "prohibited")
    n = seg.groupBy("lang").agg(F.count(F.lit(1)).alias("n_turns"))
    return comp.effective_vocab(v, seg).select("lang", "category", "phrase").join(n, "lang")


@query("J19_rule_severity", f"WITH {CALLS}, {CHECKS} SELECT k.call_id, line, call_type, severity AS raw_severity, {sev('call_type', 'severity')} AS severity FROM checks k JOIN calls USING (call_id)")
def j19(spark, sf):
    dim = vocab.local_table(spark, comp.severity_map(), "call_type string, raw_severity string, severity string")
    k = checks(spark, sf).select("call_id", "line", F.col("severity").alias("raw_severity"))
    return k.join(calls(spark, sf).select("call_id", "call_type"), "call_id").join(F.broadcast(dim), ["call_type", "raw_severity"])


@query("W18_first_segment", f"WITH {SEG}, {SCAM} SELECT call_id, phrase, min(segment_id) AS first_segment FROM seg, scam WHERE contains(lower(text), phrase) GROUP BY 1, 2")
def w18(spark, sf):
    return matching.first_segment_with(segments(spark, sf), [p for _, p in seeds.entries(seeds.SCAM_EN)])


OPENING = "op AS (SELECT call_id, string_agg(lower(text), ' ' ORDER BY segment_id) AS opening FROM (SELECT *, sum(dur_ds) OVER (PARTITION BY call_id ORDER BY segment_id) - dur_ds AS before FROM seg WHERE speaker = 'agent') WHERE before < 300 GROUP BY 1)"
A50 = f"""{OPENING}, cl AS (SELECT DISTINCT call_id, call_type FROM seg WHERE call_type IN {REG}), {DISC},
a50 AS (SELECT c.call_id, d.category AS check_name, coalesce(bool_or({token_hit('opening', 'd.phrase')}), false) AS passed, min(c.call_type) AS call_type, min(d.regulation) AS regulation, min(coalesce(opening, '')) AS opening
 FROM cl c JOIN disc d ON d.call_type = c.call_type LEFT JOIN op ON op.call_id = c.call_id GROUP BY 1, 2),
f50 AS (SELECT call_id, check_name, passed, CASE WHEN NOT passed THEN 'missing_disclosure' END AS violation_type, CAST(NULL AS BIGINT) AS segment_id, {sev('call_type', "(CASE WHEN passed THEN 'low' ELSE 'high' END)")} AS severity, regulation, CASE WHEN NOT passed THEN left(opening, 200) END AS evidence FROM a50)"""
A55 = f"""{full('sp', f"call_type NOT IN {REG} OR speaker = 'agent'")}, {BAD},
h55 AS (SELECT call_id, call_type, category, phrase FROM sp, bad WHERE (v_lang = 'en' OR v_lang = lang) AND {token_hit('t', 'phrase')}),
s55 AS (SELECT h.*, (SELECT min(segment_id) FROM seg WHERE seg.call_id = h.call_id AND contains(lower(seg.text), h.phrase)) AS segment_id, CASE WHEN category IN ('threats', 'coercion', 'misleading') THEN 'critical' ELSE 'high' END AS raw FROM h55 h),
f55 AS (SELECT call_id, 'prohibited_' || category AS check_name, false AS passed, 'prohibited_language' AS violation_type, segment_id, {sev('call_type', 'raw')} AS severity, 'RBI_Fair_Practice_Code' AS regulation, 'Agent said: "' || phrase || '"' AS evidence FROM s55)"""
A56 = f"""{full('al')}, {THIRD},
f56 AS (SELECT call_id, 'third_party_disclosure' AS check_name, false AS passed, 'privacy_violation' AS violation_type, (SELECT min(segment_id) FROM seg WHERE seg.call_id = al.call_id AND contains(lower(seg.text), phrase)) AS segment_id, 'critical' AS severity, 'RBI_Fair_Practice_Code_Section_8d' AS regulation,
 'Possible third-party disclosure: "' || phrase || '"' AS evidence FROM al, third WHERE {token_hit('t', 'phrase')})"""
W17 = f"""{full('cu', "speaker = 'customer'")}, {ENDC},
h17 AS (SELECT call_id, arg_min(phrase, rank) AS phrase FROM cu, endc WHERE {token_hit('t', 'phrase')} GROUP BY 1),
p17 AS (SELECT h.*, (SELECT min(segment_id) FROM seg WHERE seg.call_id = h.call_id AND contains(lower(seg.text), h.phrase)) AS segment_id FROM h17 h),
n17 AS (SELECT p.call_id, phrase, p.segment_id, count(*) AS n FROM p17 p JOIN seg s ON s.call_id = p.call_id AND s.segment_id > p.segment_id AND s.speaker = 'agent' GROUP BY 1, 2, 3),
f17 AS (SELECT call_id, 'ignored_call_end_request' AS check_name, false AS passed, 'improper_collection' AS violation_type, segment_id, 'high' AS severity, 'RBI_Fair_Practice_Code_Section_8c' AS regulation, 'Customer said: "' || phrase || '" but agent continued (' || n || ' more segments)' AS evidence FROM n17 WHERE n > 3)"""
A51 = f"""{full('ge', "call_type = 'general'")},
f51 AS ({' UNION ALL '.join(f"SELECT call_id, {q(n)} AS check_name, p AS passed, CASE WHEN NOT p THEN 'missing_disclosure' END AS violation_type, CAST(NULL AS BIGINT) AS segment_id, 'low' AS severity, {q(r)} AS regulation, CASE WHEN NOT p THEN {q(why)} END AS evidence FROM (SELECT call_id, ({' OR '.join(f'contains(t, {q(k)})' for k in kws)}) AS p FROM ge)" for n, r, kws, why in seeds.GENERAL_CHECKS)})"""
A9F = f"""{SHARES}, x9 AS (SELECT call_id, CASE WHEN agent_ds + customer_ds > 0 THEN agent_ds / (agent_ds + customer_ds) ELSE 0e0 END AS s FROM sh WHERE call_type = 'collections'),
f9 AS (SELECT call_id, 'agent_domination' AS check_name, false AS passed, 'improper_collection' AS violation_type, CAST(NULL AS BIGINT) AS segment_id, 'medium' AS severity, 'RBI_Fair_Practice_Code_Section_8' AS regulation, 'Agent spoke ' || CAST(floor({hu('s', 4)} * 100 + 0.5) AS BIGINT) || '% of call' AS evidence FROM x9 WHERE s > 0.75e0)"""
ALLCHECKS = f"{A50}, {A55}, {A56}, {W17}, {A51}, {A9F}, allc AS (SELECT * FROM f50 UNION ALL SELECT * FROM f55 UNION ALL SELECT * FROM f56 UNION ALL SELECT * FROM f17 UNION ALL SELECT * FROM f51 UNION ALL SELECT * FROM f9)"


@query("A50_disclosure_checks", f"WITH {SEG}, {A50} SELECT * FROM f50")
def a50(spark, sf):
    return comp.disclosure_checks(settle(segments(spark, sf)), vocab.seed_vocab(spark))


@query("A55_prohibited_phrases", f"WITH {SEG}, {A55} SELECT * FROM f55")
def a55(spark, sf):
    return comp.prohibited_phrases(segments(spark, sf), vocab.seed_vocab(spark))


@query("A56_third_party_disclosure",
       f"WITH {seg_cte(True).replace('seg AS (', 'seg0 AS (')}, seg AS (SELECT * REPLACE (CASE WHEN (conv_id * 5 + turn) % 9 = 0 THEN 'well i spoke to your' WHEN (conv_id * 5 + turn) % 9 = 1 THEN 'wife and your family knows' ELSE text END AS text) FROM seg0), {A56} SELECT * FROM f56")
def a56(spark, sf):
    k = (F.col("conv_id") * 5 + F.col("turn")) % 9
    seg = segments(spark, sf).withColumn("text", F.when(k == 0, "well i spoke to your").when(k == 1, "wife and your family knows").otherwise(F.col("text")))
    return comp.third_party_disclosure(seg, vocab.seed_vocab(spark))


@query("W17_ignored_end_request", f"WITH {SEG}, {W17} SELECT * FROM f17")
def w17(spark, sf):
    return comp.ignored_end_request(settle(segments(spark, sf)), vocab.seed_vocab(spark))


@query("A51_general_checks", f"WITH {SEG}, {A51} SELECT * FROM f51")
def a51(spark, sf):
    return comp.general_checks(segments(spark, sf))


@query("U3_all_rule_families", f"WITH {SEG}, {ALLCHECKS} SELECT * FROM allc")
def u3(spark, sf):
    return comp.all_checks(settle(segments(spark, sf)), vocab.seed_vocab(spark))


_types: dict[str, list[str]] = {}
for _ct, _kw in seeds.entries(seeds.CALL_TYPE_SIGNALS):
    _types.setdefault(_ct, []).append(_kw)
A48 = f"""o48 AS (SELECT *, max(CASE WHEN start_ds > 450 THEN 1 ELSE 0 END) OVER (PARTITION BY call_id ORDER BY segment_id) AS late FROM seg),
t48 AS (SELECT call_id, string_agg(lower(text), ' ' ORDER BY segment_id) AS t FROM o48 WHERE late = 0 GROUP BY 1),
s48 AS ({' UNION ALL '.join(f"SELECT call_id, {q(ct)} AS ct, {i} AS rk, {' + '.join(f'CAST(contains(t, {q(k)}) AS INTEGER)' for k in kws)} AS score FROM t48 WHERE length(t) >= 20" for i, (ct, kws) in enumerate(_types.items()))}),
b48 AS (SELECT *, row_number() OVER (PARTITION BY call_id ORDER BY score DESC, rk) AS rn FROM s48 WHERE score >= 2)"""


@query("A48_call_type_detection", f"WITH {SEG}, {A48} SELECT t.call_id, coalesce(ct, 'general') AS detected_type, CAST(coalesce(score, 0) AS BIGINT) AS score FROM t48 t LEFT JOIN b48 b ON b.call_id = t.call_id AND rn = 1")
def a48(spark, sf):
    return comp.detect_call_type(op.clock_opening(segments(spark, sf)))


_rules = values_cte("rules", "category, signal_type, need, base, step, cap, shown, said", [r for r in fraud.SCAM_RULES])
A49 = f"""{full('fa')}, {SCAM}, {_rules},
h49 AS (SELECT call_id, category, phrase, rank FROM fa, scam WHERE contains(t, phrase)),
g49 AS (SELECT call_id, category, count(*) AS n_hits, list(phrase ORDER BY rank) AS ps FROM h49 GROUP BY 1, 2),
s49 AS (SELECT call_id, signal_type, n_hits, {hu('least(CAST(cap AS DOUBLE), CAST(base AS DOUBLE) + n_hits * CAST(step AS DOUBLE))', 4)} AS confidence, array_to_string(ps[1:shown], ', ') AS phrases, ps[1] AS phrase, replace(replace(said, '{{n}}', CAST(n_hits AS VARCHAR)), '{{phrases}}', array_to_string(ps[1:shown], ', ')) AS description
 FROM g49 JOIN rules USING (category) WHERE n_hits >= need),
f49 AS (SELECT call_id, signal_type, n_hits, confidence, phrases, description, CASE WHEN signal_type = 'remote_access_request' THEN coalesce((SELECT min(segment_id) FROM seg WHERE seg.call_id = s49.call_id AND contains(lower(seg.text), s49.phrase)), 0) ELSE 0 END AS segment_id FROM s49)"""


@query("A49_scam_rules", f"WITH {SEG}, {A49} SELECT * FROM f49")
def a49(spark, sf):
    """The indicator lists as a file of the indicator layout, read back as a table."""
    lists = {}
    for c, p in seeds.entries(seeds.SCAM_EN):
        lists.setdefault(c, []).append(p)
    table = vocab.round_trip_indicators(spark, lists)
    return fraud.scam_signals(segments(spark, sf), table)


VOC = """voc AS (SELECT call_id, segment_id, speaker, start_ds, 100 + (conv_id * 31 + turn * 17 + length(text)) % 150 AS pitch, 5 + (turn * 7 + length(text)) % 30 AS pitch_sd,
 500 + (length(text) * 13 + conv_id) % 2500 AS jitter, 2000 + (length(text) * 29 + turn) % 6000 AS shimmer, 5 + (length(text) * 3 + conv_id) % 20 AS hnr FROM seg WHERE dur_ds >= 5),
nv AS (SELECT call_id, speaker, count(*) AS n, count(*) FILTER (WHERE start_ds < 900) AS n_early FROM voc GROUP BY 1, 2 HAVING count(*) >= 3),
rk AS (SELECT *, row_number() OVER (PARTITION BY call_id, speaker ORDER BY start_ds, segment_id) AS rn FROM voc),
cand AS (SELECT rk.* FROM rk JOIN nv USING (call_id, speaker) WHERE (n_early >= 2 AND start_ds < 900) OR (n_early < 2 AND rn <= 3)),
wv AS (SELECT a.call_id, a.speaker, a.start_ds, a.segment_id, count(*) AS nw, avg(b.pitch) AS b_pitch, avg(b.pitch_sd) AS b_pitch_sd, avg(b.jitter) AS b_jitter, avg(b.shimmer) AS b_shimmer, avg(b.hnr) AS b_hnr
 FROM cand a JOIN cand b ON a.call_id = b.call_id AND a.speaker = b.speaker AND b.start_ds >= a.start_ds AND b.start_ds < a.start_ds + 300 GROUP BY 1, 2, 3, 4 HAVING count(*) >= 2),
bw AS (SELECT *, row_number() OVER (PARTITION BY call_id, speaker ORDER BY b_jitter + b_shimmer, start_ds, segment_id) AS best FROM wv),
pv AS (SELECT call_id, speaker, avg(pitch) AS b_pitch, avg(pitch_sd) AS b_pitch_sd, avg(jitter) AS b_jitter, avg(shimmer) AS b_shimmer, avg(hnr) AS b_hnr FROM rk WHERE rn <= 3 GROUP BY 1, 2),
base AS (SELECT nv.call_id, nv.speaker, n, coalesce(b.b_pitch, p.b_pitch) AS b_pitch, coalesce(b.b_pitch_sd, p.b_pitch_sd) AS b_pitch_sd, coalesce(b.b_jitter, p.b_jitter) AS b_jitter, coalesce(b.b_shimmer, p.b_shimmer) AS b_shimmer, coalesce(b.b_hnr, p.b_hnr) AS b_hnr
 FROM nv LEFT JOIN bw b ON b.call_id = nv.call_id AND b.speaker = nv.speaker AND best = 1 JOIN pv p ON p.call_id = nv.call_id AND p.speaker = nv.speaker)"""
W9S = f"""{VOC}, dev AS (SELECT v.call_id, v.segment_id, v.speaker, (greatest(0e0, (pitch - b_pitch) / greatest(b_pitch_sd, 10e0)) + greatest(0e0, jitter / b_jitter - 1) + greatest(0e0, shimmer / b_shimmer - 1) + greatest(0e0, (b_hnr - hnr) / greatest(b_hnr, 1e0))) / 4 + 1 AS stress FROM voc v JOIN base USING (call_id, speaker))"""


def _feats(spark, sf):
    return vocal_features(segments(spark, sf)).where(F.col("dur_ds") >= 5)


@query("W8_calm_baseline", f"WITH {SEG}, {VOC} SELECT call_id, speaker, n, {hu('b_pitch', 4)} AS b_pitch, {hu('b_pitch_sd', 4)} AS b_pitch_sd, {hu('b_jitter', 4)} AS b_jitter, {hu('b_shimmer', 4)} AS b_shimmer, {hu('b_hnr', 4)} AS b_hnr FROM base")
def w8(spark, sf):
    b = fraud.calm_baseline(settle(_feats(spark, sf)))
    return b.select("call_id", "speaker", "n", *[half_up(F.col(c), 4).alias(c) for c in ("b_pitch", "b_pitch_sd", "b_jitter", "b_shimmer", "b_hnr")])


@query("W9_stress_deviation", f"WITH {SEG}, {W9S} SELECT call_id, segment_id, speaker, {hu('stress', 4)} AS stress, {hu('least(0.9e0, stress / 3)', 4)} AS confidence FROM dev WHERE stress > 1.5e0")
def w9(spark, sf):
    f = settle(_feats(spark, sf))
    return fraud.voice_stress(f, fraud.calm_baseline(f))


DIV = """dc AS (SELECT call_id, emotion, count(*) AS c FROM {src} GROUP BY 1, 2),
dv AS (SELECT call_id, CAST(sum(c) AS BIGINT) AS n_rows, count(*) AS n_emotions, CASE WHEN sum(c) < 2 THEN 0.5e0 WHEN count(*) <= 1 THEN 0e0 ELSE (log2(sum(c)) - sum(c * log2(c)) / sum(c)) / log2(count(*)) END AS d FROM dc GROUP BY 1)"""


@query("A15_emotion_diversity", f"WITH {EVEMO}, {DIV.format(src='ee')} SELECT call_id, n_rows, n_emotions, {hu('d', 6)} AS diversity FROM dv")
def a15(spark, sf):
    return fraud.emotion_diversity(event_emotions(spark, sf))


J8 = f"""{EMO}, {DIV.format(src="emo WHERE speaker = 'customer'")},
sg AS (SELECT call_id, segment_id, {lst(tables.SIGNALS)}[(conv_id * 7 + turn * 3) % 5 + 1] AS signal_type, ((conv_id * 37 + turn * 59) % 90 + 10) / 100e0 AS c FROM seg),
j8 AS (SELECT sg.*, emotion, coalesce({hu('d', 6)}, 0.5e0) AS d FROM sg LEFT JOIN emo USING (call_id, segment_id) LEFT JOIN dv USING (call_id)),
n8 AS (SELECT *, CASE signal_type WHEN 'voice_stress_anomaly' THEN CASE WHEN emotion IN ('angry', 'anger') THEN c * 0.6e0 WHEN emotion IN ('neutral', 'fearful', 'fear', 'sad') THEN c * 1.3e0 ELSE c END
  WHEN 'coached_speech' THEN CASE WHEN d < 0.25e0 THEN c * 1.25e0 WHEN d > 0.5e0 THEN c * 0.5e0 ELSE c END ELSE c END AS nc FROM j8),
f8 AS (SELECT call_id, segment_id, signal_type, {hu('greatest(0e0, least(1e0, nc))', 4)} AS confidence FROM n8)"""


@query("J8_emotion_fusion", f"WITH {SEG}, {J8} SELECT * FROM f8")
def j8(spark, sf):
    seg = settle(segments(spark, sf).select("call_id", "chunk", "conv_id", "turn", "segment_id", "speaker", "text"))
    emo = segment_emotions(seg)
    div = fraud.emotion_diversity(emo.where(F.col("speaker").isin("customer", "speaker_01")))
    return fraud.fuse_with_emotions(tables.segment_signals(seg), emo, div)


VERIFY = " OR ".join(f"contains(lower(s.text), {q(k)})" for k in seeds.VERIFICATION)
J9 = f"""r9 AS (SELECT s.call_id, s.segment_id AS question_segment, min(r.segment_id) AS rs FROM seg s JOIN seg r ON r.call_id = s.call_id AND r.segment_id BETWEEN s.segment_id + 1 AND s.segment_id + 2 AND r.speaker = 'customer' WHERE s.speaker = 'agent' AND ({VERIFY}) GROUP BY 1, 2),
f9i AS (SELECT r9.call_id, question_segment, e.segment_id, e.emotion, {hu('least(0.85e0, greatest(fear_bp, surprise_bp) / 10000e0)', 4)} AS confidence FROM r9 JOIN emo2 e ON e.call_id = r9.call_id AND e.segment_id = r9.rs
 WHERE (e.emotion = 'fearful' AND score_bp > 5000) OR (e.emotion = 'surprised' AND score_bp > 6000) OR fear_bp > 5000 OR surprise_bp > 6000)"""


@query("J9_emotional_incongruence", f"WITH {SEG}, {EMO}, {J9} SELECT * FROM f9i")
def j9(spark, sf):
    seg = segments(spark, sf)
    return fraud.emotional_incongruence(seg, segment_emotions(seg))


@query("P19_vocabulary_presence", f"WITH v AS (SELECT unnest(['en', 'hi']) AS lang) SELECT lang, count(*) AS n_documents FROM documents d WHERE EXISTS (SELECT 1 FROM v WHERE v.lang = d.lang) GROUP BY 1")
def p19(spark, sf):
    v = vocab.seed_vocab(spark).select("lang").distinct()
    return load(spark, sf, "documents").select("lang").join(F.broadcast(v), "lang", "left_semi").groupBy("lang").agg(F.count(F.lit(1)).alias("n_documents"))
