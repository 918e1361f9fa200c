"""Queries over turns: transcript projections, openings, roles, talk time, pace, language."""
from __future__ import annotations

from pyspark.sql import functions as F

from parleo.catalog.base import *  # noqa: F403
from parleo.functions.columns import half_up, let, mmss, n_words, norm, words
from parleo.operators import turns as op
from parleo.plans.stage import settle
from parleo.sources import seeds
from parleo.sources.tables import load, raw_turns, segments, spread

AG = inlist(seeds.AGENT_LABELS)
CU = inlist(seeds.CUSTOMER_LABELS)


@query("P3_transcript", f"WITH {SEG} SELECT call_id, segment_id, start_ds, end_ds, speaker, text FROM seg")
def p3(spark, sf):
    return segments(spark, sf).select("call_id", "segment_id", "start_ds", "end_ds", "speaker", "text").orderBy("call_id", "segment_id")


@query("P13_output_segments", f"""WITH {SEG}, w AS (SELECT *, {words_sql('text')} AS ws FROM seg)
SELECT call_id, segment_id, {hu('start_ds / 10e0', 2)} AS start_s, {hu('end_ds / 10e0', 2)} AS end_s, text,
 coalesce(speaker, 'unknown') AS speaker, CAST(len(ws) AS BIGINT) AS n_words,
 array_to_string([ws[i] || '@' || (start_ds * 10 + (i - 1) * 7) for i in range(1, len(ws) + 1)], ' ') AS words FROM w""")
def p13(spark, sf):
    s = op.with_words(segments(spark, sf))
    return s.select("call_id", "segment_id", half_up(F.col("start_ds") / 10, 2).alias("start_s"), half_up(F.col("end_ds") / 10, 2).alias("end_s"),
                    "text", F.coalesce("speaker", F.lit("unknown")).alias("speaker"), F.size("words").cast("bigint").alias("n_words"),
                    F.array_join(F.transform("words", lambda w: F.concat(w["word"], F.lit("@"), w["start"].cast("string"))), " ").alias("words"))


@query("P14_speaker_roles", f"""SELECT conv_id, turn, lower(r) IN {AG} AS is_agent, lower(r) IN {CU} AS is_customer
FROM (SELECT conv_id, turn, CASE role WHEN 'assistant' THEN 'SPEAKER_00' WHEN 'user' THEN 'Speaker B' ELSE role END AS r FROM conversations)""")
def p14(spark, sf):
    label = F.when(F.col("role") == "assistant", "SPEAKER_00").when(F.col("role") == "user", "Speaker B").otherwise(F.col("role"))
    return load(spark, sf, "conversations").select("conv_id", "turn", op.is_agent(label).alias("is_agent"), op.is_customer(label).alias("is_customer"))


@query("P16_evidence_gates", f"""WITH {SEG}, w AS (SELECT *, trim(text) AS t, len({words_sql('text')}) * 600e0 / dur_ds AS wpm FROM seg)
SELECT call_id, segment_id, length(t) > 5 AS for_abuse, length(t) > 10 AS for_scam, length(t) > 2 AS for_toxicity, length(t) >= 15 AS for_language,
 dur_ds >= 5 AS for_voice, dur_ds >= 20 AND wpm > 50 AND wpm < 300 AS for_pace FROM w""")
def p16(spark, sf):
    t, wpm = F.length(F.trim("text")), n_words(F.col("text")) * 600.0 / F.col("dur_ds")
    return segments(spark, sf).select("call_id", "segment_id", (t > 5).alias("for_abuse"), (t > 10).alias("for_scam"), (t > 2).alias("for_toxicity"),
                                      (t >= 15).alias("for_language"), (F.col("dur_ds") >= 5).alias("for_voice"),
                                      ((F.col("dur_ds") >= 20) & (wpm > 50) & (wpm < 300)).alias("for_pace"))


@query("W1_agent_opening", f"""WITH {SEG}, a AS (SELECT *, sum(dur_ds) OVER (PARTITION BY call_id ORDER BY segment_id) - dur_ds AS before FROM seg WHERE speaker = 'agent')
SELECT call_id, string_agg(text, ' ' ORDER BY segment_id) AS opening, count(*) AS n_turns, CAST(sum(dur_ds) AS BIGINT) AS talk_ds FROM a WHERE before < 300 GROUP BY 1""")
def w1(spark, sf):
    return op.opening_text(op.agent_opening(segments(spark, sf)))


@query("W2_clock_opening", f"""WITH {SEG}, a AS (SELECT *, max(CASE WHEN start_ds > 450 THEN 1 ELSE 0 END) OVER (PARTITION BY call_id ORDER BY segment_id) AS late FROM seg)
SELECT call_id, segment_id, start_ds, lower(text) AS text FROM a WHERE late = 0""")
def w2(spark, sf):
    return op.clock_opening(segments(spark, sf)).select("call_id", "segment_id", "start_ds", F.lower("text").alias("text"))


@query("W3_role_map", f"""WITH {SEG}, f AS (SELECT call_id, call_type, speaker, min(segment_id) AS first_seen FROM seg GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY call_id ORDER BY first_seen) AS rn, count(*) OVER (PARTITION BY call_id) AS n FROM f),
m AS (SELECT call_id, speaker, CASE WHEN call_type IN {inlist(seeds.REGULATED)} THEN CASE rn WHEN 1 THEN 'agent' WHEN 2 THEN 'customer' ELSE 'other' END ELSE 'Speaker ' || chr(CAST(64 + rn AS INTEGER)) END AS mapped FROM r WHERE n >= 2)
SELECT s.call_id, s.segment_id, coalesce(m.mapped, s.speaker) AS speaker, CASE WHEN m.mapped IS NOT NULL THEN s.speaker END AS original_speaker_id
FROM seg s LEFT JOIN m USING (call_id, speaker)""")
def w3(spark, sf):
    return op.map_roles(segments(spark, sf)).select("call_id", "segment_id", "speaker", "original_speaker_id")


MERGED = """sp AS (SELECT *, trim(text, ' ') AS tx FROM seg WHERE trim(text, ' ') <> ''),
lg AS (SELECT *, CASE WHEN lag(speaker) OVER (PARTITION BY call_id ORDER BY segment_id) = speaker THEN 0 ELSE 1 END AS chg FROM sp),
isl AS (SELECT *, CAST(sum(chg) OVER (PARTITION BY call_id ORDER BY segment_id) - 1 AS BIGINT) AS turn_no FROM lg),
merged AS (SELECT call_id, turn_no, min(speaker) AS speaker, min(start_ds) AS start_ds, min(segment_id) AS first_segment, count(*) AS n_turns,
  string_agg(tx, ' ' ORDER BY segment_id) AS text FROM isl GROUP BY 1, 2)"""


@query("W4_merged_turns", f"WITH {SEG}, {MERGED} SELECT call_id, turn_no, CAST(0 AS BIGINT) AS part, speaker, start_ds, first_segment, n_turns, text FROM merged")
def w4(spark, sf):
    return op.merged_turns(segments(spark, sf))


@query("X23_context_cut", f"""WITH {SEG}, {MERGED}, c AS (SELECT call_id, string_agg('[' || speaker || '] (' || CAST(floor(start_ds / 10) AS BIGINT) || 's): ' || text, chr(10) ORDER BY turn_no) AS t FROM merged GROUP BY 1)
SELECT call_id, length(t) AS n_chars, CASE WHEN length(t) > 6000 THEN left(t, 6000) || chr(10) || '... (truncated)' ELSE t END AS context FROM c""")
def x23(spark, sf):
    return op.context_text(op.merged_turns(segments(spark, sf)))


WORDS = f"""wr AS (SELECT call_id, segment_id, start_ds, unnest({words_sql('text')}) AS word, unnest(range(0, len({words_sql('text')}))) AS i FROM seg),
wd AS (SELECT *, start_ds * 10 + i * 7 AS start, start_ds * 10 + i * 7 + 6 AS "end", CASE WHEN (i + segment_id) % 11 < 4 THEN 'S0' WHEN (i + segment_id) % 11 < 6 THEN NULL ELSE 'S1' END AS speaker,
  CASE WHEN i % 5 = 0 THEN NULL ELSE (length(word) * 997 + i * 131) % 10001 END AS score_bp FROM wr)"""


@query("W5_split_by_word_speaker", f"""WITH {SEG}, {WORDS},
e AS (SELECT *, coalesce(last_value(speaker IGNORE NULLS) OVER w, first_value(speaker IGNORE NULLS) OVER (PARTITION BY call_id, segment_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)) AS sp
  FROM wd WINDOW w AS (PARTITION BY call_id, segment_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
l AS (SELECT *, CASE WHEN lag(sp) OVER v IS DISTINCT FROM sp AND lag(i) OVER v IS NOT NULL THEN 1 ELSE 0 END AS chg FROM e WINDOW v AS (PARTITION BY call_id, segment_id ORDER BY i)),
g AS (SELECT *, sum(chg) OVER (PARTITION BY call_id, segment_id ORDER BY i) AS piece FROM l)
SELECT call_id, segment_id, CAST(piece AS BIGINT) AS piece, min(sp) AS speaker, CAST(min(start) AS BIGINT) AS start_cs, CAST(max("end") AS BIGINT) AS end_cs, string_agg(word, ' ' ORDER BY i) AS text FROM g GROUP BY 1, 2, 3""")
def w5(spark, sf):
    return op.split_by_word_speaker(op.with_words(segments(spark, sf)))


@query("J17_score_restore", f"""WITH {SEG}, {WORDS}, sw AS (SELECT call_id, lower(word) AS wkey, start, CAST(max(length(word) * 500 % 10001) AS BIGINT) AS saved_bp FROM wd WHERE i % 2 = 0 GROUP BY 1, 2, 3),
ss AS (SELECT call_id, start_ds, max((segment_id * 701) % 10001) AS conf_bp FROM seg WHERE segment_id % 2 = 0 GROUP BY 1, 2),
j AS (SELECT wd.*, sw.saved_bp, coalesce(score_bp, saved_bp) AS got FROM wd LEFT JOIN sw ON wd.call_id = sw.call_id AND lower(wd.word) = sw.wkey AND wd.start = sw.start),
p AS (SELECT call_id, segment_id, start_ds, sum(got) AS s, count(got) AS n, count(*) FILTER (WHERE score_bp IS NULL AND saved_bp IS NOT NULL) AS n_restored FROM j GROUP BY 1, 2, 3),
c AS (SELECT p.*, CASE WHEN n > 0 THEN s / (n * 10000e0) ELSE coalesce(conf_bp / 10000e0, 0.5e0) END AS conf FROM p LEFT JOIN ss USING (call_id, start_ds))
SELECT call_id, segment_id, n_restored, {hu('conf', 3)} AS confidence, conf < 0.7e0 AS flagged FROM c""")
def j17(spark, sf):
    return _segconf(spark, sf)


def _segconf(spark, sf):
    seg = op.with_words(settle(segments(spark, sf)))
    w = seg.select("call_id", "segment_id", "start_ds", F.posexplode("words").alias("i", "w")).select(
        "call_id", "segment_id", "start_ds", "i", "w.word", "w.start", "w.score_bp")
    saved = w.where(F.col("i") % 2 == 0).groupBy("call_id", F.lower("word").alias("wkey"), "start").agg(
        F.max(F.length("word") * 500 % 10001).cast("bigint").alias("saved_bp"))
    segs = seg.where(F.col("segment_id") % 2 == 0).groupBy("call_id", "start_ds").agg(F.max(F.col("segment_id") * 701 % 10001).alias("conf_bp"))
    return op.restore_scores(w, saved, segs)


@query("A19_transcript_confidence", ORACLES["J17_score_restore"].replace("SELECT call_id, segment_id, n_restored,", "SELECT call_id, floor(sum(floor(confidence * 1000 + 0.5)) / (count(*) * 1000e0) * 1000e0 + 0.5e0) / 1000e0 AS overall_confidence, count(*) FILTER (WHERE flagged) AS n_low, count(*) AS n_segments FROM (SELECT call_id, segment_id, n_restored,") + ") GROUP BY 1")
def a19(spark, sf):
    return op.transcript_confidence(_segconf(spark, sf))


@query("X19_logprob_timing", f"""WITH {SEG}, w AS (SELECT *, greatest(0e0, least(1e0, 1 - (length(text) % 150) / 100e0)) AS conf, len({words_sql('text')}) AS n FROM seg)
SELECT call_id, segment_id, {hu('conf', 3)} AS confidence, array_to_string([CAST(floor(start_ds * 100 + (i * dur_ds * 100e0) / n + 0.5) AS BIGINT) for i in range(0, n)], ' ') AS word_starts_ms FROM w""")
def x19(spark, sf):
    conf = F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - (F.length("text") % 150) / F.lit(100.0)))
    # the words are split once per turn: a count named outside the loop would be put into it and split the text again for every word
    starts = let(words(F.col("text")), lambda ws: F.transform(ws, lambda w, i: F.floor(F.col("start_ds") * 100 + (i * F.col("dur_ds") * F.lit(100.0)) / F.size(ws) + 0.5).cast("string")))
    return segments(spark, sf).select("call_id", "segment_id", half_up(conf, 3).alias("confidence"), F.array_join(starts, " ").alias("word_starts_ms"))


SHARES = f"""sh AS (SELECT call_id, call_type, CAST(sum(CASE WHEN speaker = 'agent' THEN dur_ds ELSE 0 END) AS BIGINT) AS agent_ds,
 CAST(sum(CASE WHEN speaker = 'customer' THEN dur_ds ELSE 0 END) AS BIGINT) AS customer_ds, CAST(sum(dur_ds) AS BIGINT) AS total_ds FROM seg GROUP BY 1, 2)"""


@query("A8_talk_share", f"WITH {SEG}, {SHARES} SELECT *, {hu('agent_ds * 10e0 / greatest(total_ds / 10e0, 0.01e0)', 1)} AS agent_pct, {hu('customer_ds * 10e0 / greatest(total_ds / 10e0, 0.01e0)', 1)} AS customer_pct FROM sh")
def a8(spark, sf):
    return op.talk_shares(raw_turns(spark, sf))


@query("A9_agent_domination", f"WITH {SEG}, {SHARES}, x AS (SELECT call_id, CASE WHEN agent_ds + customer_ds > 0 THEN agent_ds / (agent_ds + customer_ds) ELSE 0e0 END AS s FROM sh WHERE call_type = 'collections') SELECT call_id, {hu('s', 4)} AS agent_share, s > 0.75e0 AS violated FROM x")
def a9(spark, sf):
    return op.agent_domination(op.talk_shares(raw_turns(spark, sf)))


@query("A10_agent_monologue", f"WITH {SEG}, {SHARES}, x AS (SELECT *, agent_ds / greatest(total_ds, 10) AS s FROM sh) SELECT call_id, {hu('s', 4)} AS agent_share, total_ds > 600 AND s > 0.8e0 AS monologue, CASE WHEN total_ds > 600 AND s > 0.8e0 THEN 0.5e0 ELSE 0e0 END AS confidence FROM x")
def a10(spark, sf):
    return op.agent_monologue(op.talk_shares(raw_turns(spark, sf)))


@query("A11_speaker_count", f"WITH {SEG} SELECT call_id, count(DISTINCT speaker) AS n_speakers, string_agg(DISTINCT speaker, ', ' ORDER BY speaker) AS speakers, count(DISTINCT speaker) > 2 AS third_party, CASE WHEN count(DISTINCT speaker) > 2 THEN 0.7e0 ELSE 0e0 END AS confidence FROM seg GROUP BY 1")
def a11(spark, sf):
    return op.speaker_counts(raw_turns(spark, sf))


@query("A12_language_mix", """WITH t AS (SELECT source, CASE WHEN length(trim(text, ' ')) < 15 THEN 'en' ELSE lang END AS l FROM documents),
c AS (SELECT source, l, count(*) AS n FROM t GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY n DESC, l DESC) AS rn FROM c)
SELECT source, max(CASE WHEN rn = 1 THEN l END) AS primary_language, CAST(sum(n) AS BIGINT) AS n_tagged, string_agg(l || '=' || n, ',' ORDER BY l || '=' || n) AS distribution, (sum(n) - max(n)) / sum(n) > 0.10 AS has_code_switching FROM r GROUP BY 1""")
def a12(spark, sf):
    return op.language_mix(load(spark, sf, "documents"), "source")


@query("A16_coached_speech", f"""WITH {SEG}, t AS (SELECT *, CASE WHEN segment_id % 2 = 0 THEN lang ELSE 'en' END AS seg_lang, len({words_sql('text')}) * 600e0 / dur_ds AS wpm FROM seg WHERE dur_ds >= 20),
f AS (SELECT * FROM t WHERE wpm > 50 AND wpm < 300),
pl AS (SELECT call_id, speaker, seg_lang, count(*) AS n, avg(wpm) AS m, stddev_pop(wpm) AS s FROM f GROUP BY 1, 2, 3),
lg AS (SELECT call_id, speaker, count(*) AS n_langs, bool_and(n < 3 OR s / m < 0.10e0) AS all_steady FROM pl GROUP BY 1, 2),
tt AS (SELECT call_id, speaker, count(*) AS n, avg(wpm) AS mean, stddev_pop(wpm) AS sd, min(segment_id) AS first_segment FROM f GROUP BY 1, 2 HAVING count(*) >= 5),
j AS (SELECT *, sd / mean AS cv, (sd / mean < 0.10e0 AND mean > 100 AND (n_langs = 1 OR all_steady)) AS coached FROM tt JOIN lg USING (call_id, speaker))
SELECT call_id, speaker, first_segment, n AS n_turns, {hu('mean', 3)} AS mean_wpm, {hu('cv', 5)} AS cv, coached, CASE WHEN coached THEN {hu('least(0.85e0, (0.15e0 - cv) / 0.15e0)', 4)} ELSE 0e0 END AS confidence FROM j""")
def a16(spark, sf):
    s = segments(spark, sf).withColumn("seg_lang", F.when(F.col("segment_id") % 2 == 0, F.col("lang")).otherwise("en"))
    return op.coached_speech(s)


@query("W20_subsample", f"""WITH {SEG}, v AS (SELECT *, row_number() OVER (PARTITION BY call_id ORDER BY segment_id) - 1 AS pos, count(*) OVER (PARTITION BY call_id) AS n FROM seg WHERE dur_ds >= 5),
l AS (SELECT *, lag(speaker) OVER w AS ps, lead(speaker) OVER w AS ns FROM v WINDOW w AS (PARTITION BY call_id ORDER BY pos)),
k AS (SELECT *, (pos < 5 OR pos >= n - 5 OR coalesce(ps <> speaker, false) OR coalesce(ns <> speaker, false)) AS kept FROM l),
c AS (SELECT *, count(*) FILTER (WHERE kept) OVER (PARTITION BY call_id) AS nk, count(*) FILTER (WHERE NOT kept) OVER (PARTITION BY call_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS rest FROM k),
s AS (SELECT *, CASE WHEN nk < 60 THEN greatest(1, (n - nk) // (60 - nk)) END AS step FROM c)
SELECT call_id, segment_id, pos, speaker, n AS n_valid FROM s WHERE n <= 100 OR kept OR (nk < 60 AND coalesce(rest, 0) % step = 0 AND coalesce(rest, 0) // step < 60 - nk)""")
def w20(spark, sf):
    return op.subsample(segments(spark, sf))


@query("A52_word_count", rf"""SELECT page_id, CAST(len({words_sql("regexp_replace(html, '<[^>]*>', ' ', 'g')")}) AS BIGINT) AS n_words FROM pages""")
def a52(spark, sf):
    return load(spark, sf, "pages").select("page_id", n_words(F.regexp_replace("html", "<[^>]*>", " ")).alias("n_words"))


@query("X21_display_times", f"WITH {SEG} SELECT call_id, segment_id, (start_ds // 600) || ':' || lpad(CAST((start_ds // 10) % 60 AS VARCHAR), 2, '0') AS at, (end_ds // 36000) || 'h ' || ((end_ds // 600) % 60) || 'm' AS total FROM seg")
def x21(spark, sf):
    m = F.floor(F.col("end_ds") / 600)
    return segments(spark, sf).select("call_id", "segment_id", mmss(F.col("start_ds") / 10).alias("at"),
                                      F.concat(F.floor(m / 60).cast("string"), F.lit("h "), (m % 60).cast("string"), F.lit("m")).alias("total"))


@query("X11_normalise_tokens", f"SELECT doc_id, CAST(len(string_split(t, ' ')) AS BIGINT) AS n_tokens, md5(t) AS norm_md5 FROM (SELECT doc_id, {norm_sql('text')} AS t FROM documents)")
def x11(spark, sf):
    return spread(load(spark, sf, "documents").select("doc_id", "text")).select("doc_id", norm(F.col("text")).alias("t")).select(
        "doc_id", F.size(F.split("t", " ")).cast("bigint").alias("n_tokens"), F.md5("t").alias("norm_md5"))
