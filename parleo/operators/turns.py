"""Turn structure of calls: openings, roles, merged turns, word splits, talk time, pace."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parleo.functions.columns import half_up, n_words, words
from parleo.plans.skew import attach, islands, scan, with_halo
from parleo.plans.stage import settle
from parleo.sources import seeds

KEYS = ["call_id"]
ORDER = ["segment_id"]


def is_agent(speaker: Column) -> Column:
    return F.lower(speaker).isin(*seeds.AGENT_LABELS)


def is_customer(speaker: Column) -> Column:
    return F.lower(speaker).isin(*seeds.CUSTOMER_LABELS)


def agent_opening(seg: DataFrame, limit_ds: int = 300) -> DataFrame:
    """Agent turns until the agent has talked for ``limit_ds``, with the turn that crosses it."""
    agent = seg.where(is_agent(F.col("speaker")))
    return scan(agent, KEYS, "chunk", ORDER, {"talked_ds": ("sum", F.col("dur_ds"), False)}).where(
        F.col("talked_ds") < limit_ds)


def opening_text(opening: DataFrame) -> DataFrame:
    """One line of text per call; the opening is bounded by talk time, so the list is short."""
    lines = F.sort_array(F.collect_list(F.struct("segment_id", "text")))
    return opening.groupBy("call_id").agg(
        F.array_join(F.transform(lines, lambda s: s["text"]), " ").alias("opening"),
        F.count(F.lit(1)).alias("n_turns"), F.sum("dur_ds").alias("talk_ds"))


def clock_opening(seg: DataFrame, limit_ds: int = 450) -> DataFrame:
    """Turns before the first one that starts after ``limit_ds``."""
    late = (F.col("start_ds") > limit_ds).cast("int")
    return scan(seg, KEYS, "chunk", ORDER, {"late": ("max", late, True)}).where(F.col("late") == 0).drop("late")


def role_map(seg: DataFrame) -> DataFrame:
    """Roles by first appearance: agent, customer, other in regulated calls, letters elsewhere."""
    first = seg.where(F.col("speaker").isNotNull() & ~F.col("speaker").isin("", "unknown")).groupBy(
        "call_id", "call_type", "speaker").agg(F.min("segment_id").alias("first_seen"))
    w = Window.partitionBy("call_id")
    rn = F.row_number().over(w.orderBy("first_seen"))
    ranked = first.withColumns({"rn": rn, "n": F.count(F.lit(1)).over(w)}).where(F.col("n") >= 2)
    regulated = F.col("call_type").isin(*seeds.REGULATED)
    role = (F.when(regulated & (F.col("rn") == 1), "agent").when(regulated & (F.col("rn") == 2), "customer")
            .when(regulated, "other").otherwise(F.concat(F.lit("Speaker "), F.char(64 + F.col("rn")))))
    return ranked.select("call_id", "speaker", role.alias("mapped"))


def map_roles(seg: DataFrame) -> DataFrame:
    """Apply the role map; calls with one speaker stay as they are."""
    per_call = role_map(seg).groupBy("call_id").agg(
        F.map_from_entries(F.collect_list(F.struct("speaker", "mapped"))).alias("_roles"))
    out = attach(seg, per_call, KEYS, "chunk", "left")
    mapped = F.col("_roles")[F.col("speaker")]
    return (out.withColumn("original_speaker_id", F.when(mapped.isNotNull(), F.col("speaker")))
            .withColumn("speaker", F.coalesce(mapped, F.col("speaker"))).drop("_roles"))


def merged_turns(seg: DataFrame, part_chars: int = 1_000_000) -> DataFrame:
    """Join consecutive turns of a speaker; blank turns vanish.

    A merged turn longer than ``part_chars`` comes out in several parts, so no
    task ever builds the text of an unbounded turn.
    """
    spoken = seg.withColumn("text", F.trim("text")).where(F.col("text") != "")
    id_cols = ["call_id", "chunk", "segment_id"]
    thin = spoken.select(*id_cols, "speaker", F.length("text").alias("_len"))
    runs = settle(islands(thin, KEYS, "chunk", ORDER, F.col("speaker"), "turn_no"))
    cum = scan(runs, KEYS, "chunk", ORDER, {"_upto": ("sum", F.col("_len") + 1, False)})
    base = cum.groupBy("call_id", "turn_no").agg(F.min("_upto").alias("_at"))
    placed = attach(cum, base, ["call_id", "turn_no"], "chunk").select(
        *id_cols, "turn_no", F.floor((F.col("_upto") - F.col("_at")) / part_chars).alias("part"))
    lines = F.sort_array(F.collect_list(F.struct("segment_id", "text")))
    return spoken.join(placed, id_cols).groupBy("call_id", "turn_no", "part").agg(
        F.min_by("speaker", "segment_id").alias("speaker"), F.min("start_ds").alias("start_ds"),
        F.min("segment_id").alias("first_segment"), F.count(F.lit(1)).alias("n_turns"),
        F.array_join(F.transform(lines, lambda s: s["text"]), " ").alias("text"))


def context_text(merged: DataFrame, max_chars: int = 6000, marker: str = "\n... (truncated)") -> DataFrame:
    """Call text as ``[speaker] (12s): ...`` lines, cut to ``max_chars`` with a marker.

    Lines that start beyond the cut never reach the list that is joined.
    """
    line = F.concat(F.lit("["), F.col("speaker"), F.lit("] ("), F.floor(F.col("start_ds") / 10).cast("string"),
                    F.lit("s): "), F.col("text"))
    line = F.when(F.col("part") == 0, line).otherwise(F.col("text"))
    m = settle(merged.select("call_id", F.floor(F.col("turn_no") / 4096).alias("_chunk"), "turn_no", "part",
                             F.length(line).alias("_len"), F.substring(line, 1, max_chars + 1).alias("line")))
    cum = scan(m, KEYS, "_chunk", ["turn_no", "part"], {"_upto": ("sum", F.col("_len") + 1, False)})
    near = F.when(F.col("_upto") <= max_chars, F.struct("turn_no", "part", "line"))
    got = cum.groupBy("call_id").agg(F.max(F.col("_upto") + F.col("_len")).alias("n_chars"),
                                     F.sort_array(F.collect_list(near)).alias("_l"))
    t = F.array_join(F.transform("_l", lambda s: s["line"]), "\n")
    cut = F.when(F.col("n_chars") > max_chars, F.concat(F.substring(t, 1, max_chars), F.lit(marker))).otherwise(t)
    return got.select("call_id", "n_chars", cut.alias("context"))


def split_by_word_speaker(seg: DataFrame) -> DataFrame:
    """Split segments where the speaker of a word changes; a word without speaker inherits.

    ``words`` is an array of (word, start, end, speaker) inside the row, so this
    is a fold over the array without any shuffle.
    """
    fold = """aggregate(words, cast(array() as array<struct<speaker:string,start:bigint,end:bigint,text:string>>), (acc, w) ->
      CASE WHEN size(acc) > 0 AND (w.speaker IS NULL OR acc[size(acc)-1].speaker IS NULL OR w.speaker = acc[size(acc)-1].speaker)
      THEN concat(slice(acc, 1, size(acc)-1), array(named_struct('speaker', coalesce(acc[size(acc)-1].speaker, w.speaker),
           'start', acc[size(acc)-1].start, 'end', w.end, 'text', concat(acc[size(acc)-1].text, ' ', w.word))))
      ELSE concat(acc, array(named_struct('speaker', w.speaker, 'start', w.start, 'end', w.end, 'text', w.word))) END)"""
    parts = seg.withColumn("_p", F.expr(fold)).select("call_id", "segment_id", F.posexplode_outer("_p").alias("piece", "p"))
    return parts.select("call_id", "segment_id", F.coalesce("piece", F.lit(0)).alias("piece"), F.col("p.speaker").alias("speaker"),
                        F.col("p.start").alias("start_cs"), F.col("p.end").alias("end_cs"), F.col("p.text").alias("text"))


def with_words(seg: DataFrame) -> DataFrame:
    """Timed words of a segment as an array (start and end in hundredths of a second)."""
    w = F.transform(words(F.col("text")), lambda x, i: F.struct(
        x.alias("word"), (F.col("start_ds") * 10 + i * 7).cast("bigint").alias("start"),
        (F.col("start_ds") * 10 + i * 7 + 6).cast("bigint").alias("end"),
        F.when((i + F.col("segment_id")) % 11 < 4, "S0").when((i + F.col("segment_id")) % 11 < 6, F.lit(None))
        .otherwise("S1").alias("speaker"),
        F.when(i % 5 == 0, F.lit(None)).otherwise((F.length(x) * 997 + i * 131) % 10001).cast("bigint").alias("score_bp")))
    return seg.withColumn("words", w)


def talk_shares(turns: DataFrame) -> DataFrame:
    """Talk time per role and its share of the call."""
    d = F.col("dur_ds")
    agg = turns.groupBy("call_id", "call_type").agg(
        F.sum(F.when(is_agent(F.col("speaker")), d).otherwise(0)).alias("agent_ds"),
        F.sum(F.when(is_customer(F.col("speaker")), d).otherwise(0)).alias("customer_ds"), F.sum(d).alias("total_ds"))
    total = F.greatest(F.col("total_ds") / 10, F.lit(0.01))
    return agg.withColumns({
        "agent_pct": half_up(F.col("agent_ds") * 10.0 / total, 1),
        "customer_pct": half_up(F.col("customer_ds") * 10.0 / total, 1)})


def agent_domination(shares: DataFrame, limit: float = 0.75) -> DataFrame:
    """Collections calls where the agent holds more than ``limit`` of agent plus customer talk."""
    both = F.col("agent_ds") + F.col("customer_ds")
    share = F.when(both > 0, F.col("agent_ds") / both).otherwise(0.0)
    return shares.where(F.col("call_type") == "collections").select(
        "call_id", half_up(share, 4).alias("agent_share"), (share > limit).alias("violated"))


def agent_monologue(shares: DataFrame, limit: float = 0.80, min_ds: int = 600) -> DataFrame:
    share = F.col("agent_ds") / F.greatest(F.col("total_ds"), F.lit(10))
    hit = (F.col("total_ds") > min_ds) & (share > limit)
    return shares.select("call_id", half_up(share, 4).alias("agent_share"), hit.alias("monologue"),
                         F.when(hit, 0.5).otherwise(0.0).alias("confidence"))


def speaker_counts(turns: DataFrame, expected: int = 2) -> DataFrame:
    """Distinct speakers per call and the third-party signal."""
    named = turns.where(F.col("speaker").isNotNull() & (F.col("speaker") != "")).select("call_id", "speaker").distinct()
    agg = named.groupBy("call_id").agg(F.count(F.lit(1)).alias("n_speakers"),
                                       F.array_join(F.sort_array(F.collect_list("speaker")), ", ").alias("speakers"))
    over = F.col("n_speakers") > expected
    return agg.withColumns({"third_party": over, "confidence": F.when(over, 0.7).otherwise(0.0)})


def language_mix(rows: DataFrame, key: str, min_chars: int = 15, fallback: str = "en") -> DataFrame:
    """Language counts, most frequent language and code switching (over a tenth in other languages)."""
    lang = F.when(F.length(F.trim("text")) < min_chars, fallback).otherwise(F.col("lang"))
    counts = rows.select(key, lang.alias("l")).groupBy(key, "l").agg(F.count(F.lit(1)).alias("n"))
    agg = counts.groupBy(key).agg(
        F.max_by("l", F.struct("n", F.col("l"))).alias("primary_language"), F.sum("n").alias("n_tagged"),
        F.max("n").alias("n_primary"),
        F.array_join(F.sort_array(F.collect_list(F.concat("l", F.lit("="), F.col("n").cast("string")))), ",").alias("distribution"))
    return agg.withColumn("has_code_switching", (F.col("n_tagged") - F.col("n_primary")) / F.col("n_tagged") > 0.10).drop("n_primary")


def coached_speech(seg: DataFrame) -> DataFrame:
    """Speaking pace per speaker; steady fast pace in every language looks rehearsed."""
    wpm = n_words(F.col("text")) * 600.0 / F.col("dur_ds")
    t = seg.where(F.col("dur_ds") >= 20).withColumn("wpm", wpm).where((F.col("wpm") > 50) & (F.col("wpm") < 300))

    def cv(mean: str, sd: str) -> Column:
        return F.when(F.col(mean) > 0, F.col(sd) / F.col(mean)).otherwise(1.0)

    per_lang = t.groupBy("call_id", "speaker", "seg_lang").agg(
        F.count(F.lit(1)).alias("n"), F.avg("wpm").alias("m"), F.stddev_pop("wpm").alias("s"))
    langs = per_lang.groupBy("call_id", "speaker").agg(
        F.count(F.lit(1)).alias("n_langs"),
        F.bool_and((F.col("n") < 3) | (cv("m", "s") < 0.10)).alias("all_steady"))
    total = t.groupBy("call_id", "speaker").agg(
        F.count(F.lit(1)).alias("n"), F.avg("wpm").alias("mean"), F.stddev_pop("wpm").alias("sd"),
        F.min("segment_id").alias("first_segment")).where(F.col("n") >= 5)
    j = total.join(langs, ["call_id", "speaker"]).withColumn("cv", cv("mean", "sd"))
    coached = (F.col("cv") < 0.10) & (F.col("mean") > 100) & ((F.col("n_langs") == 1) | F.col("all_steady"))
    return j.select("call_id", "speaker", "first_segment", F.col("n").alias("n_turns"), half_up(F.col("mean"), 3).alias("mean_wpm"),
                    half_up(F.col("cv"), 5).alias("cv"), coached.alias("coached"),
                    F.when(coached, half_up(F.least(F.lit(0.85), (0.15 - F.col("cv")) / 0.15), 4)).otherwise(0.0).alias("confidence"))


def subsample(seg: DataFrame, limit: int = 100, edge: int = 5, target: int = 60, min_ds: int = 5, size: int = 4096) -> DataFrame:
    """Thin out long calls: both ends, both sides of speaker changes, then an even fill up to ``target``."""
    one = F.lit(1).cast("bigint")
    thin = seg.where(F.col("dur_ds") >= min_ds).select("call_id", "chunk", "segment_id", "speaker")
    valid = scan(thin, KEYS, "chunk", ORDER, {"pos": ("sum", one, False), "n": ("all_sum", one, True)})
    h = with_halo(valid, KEYS, "pos", 1, size)
    w = Window.partitionBy("call_id", "_b").orderBy("pos")
    change = F.coalesce(F.lag("speaker").over(w) != F.col("speaker"), F.lit(False)) | \
        F.coalesce(F.lead("speaker").over(w) != F.col("speaker"), F.lit(False))
    h = h.withColumn("_edge", change).where("_own")
    h = settle(h.withColumn("kept", (F.col("pos") < edge) | (F.col("pos") >= F.col("n") - edge) | F.col("_edge")))
    h = scan(h, KEYS, "_b", ["pos"], {"rest": ("sum", (~F.col("kept")).cast("bigint"), False),
                                      "n_kept": ("all_sum", F.col("kept").cast("bigint"), True)})
    room = F.col("n_kept") < target
    step = F.greatest(F.lit(1), F.floor((F.col("n") - F.col("n_kept")) / (target - F.col("n_kept"))))
    fill = room & ~F.col("kept") & (F.col("rest") % step == 0) & (F.floor(F.col("rest") / step) < target - F.col("n_kept"))
    keep = (F.col("n") <= limit) | F.col("kept") | F.coalesce(fill, F.lit(False))
    return h.where(keep).select("call_id", "segment_id", "pos", "speaker", F.col("n").alias("n_valid"))


def restore_scores(wordrows: DataFrame, saved_words: DataFrame, saved_segments: DataFrame) -> DataFrame:
    """Word score, else the saved score of the same word and time, else the segment's, else one half."""
    j = wordrows.withColumn("wkey", F.lower(F.trim("word"))).join(saved_words, ["call_id", "wkey", "start"], "left")
    j = j.withColumn("got", F.coalesce("score_bp", "saved_bp"))
    per = j.groupBy("call_id", "segment_id", "start_ds").agg(
        F.sum("got").alias("s"), F.count("got").alias("n"), F.count_if(F.col("score_bp").isNull() & F.col("saved_bp").isNotNull()).alias("n_restored"))
    j2 = per.join(saved_segments, ["call_id", "start_ds"], "left")
    conf = F.when(F.col("n") > 0, F.col("s") / (F.col("n") * 10000.0)).otherwise(F.coalesce(F.col("conf_bp") / 10000.0, F.lit(0.5)))
    return j2.select("call_id", "segment_id", "n_restored", half_up(conf, 3).alias("confidence"), (conf < 0.7).alias("flagged"))


def transcript_confidence(segconf: DataFrame) -> DataFrame:
    """Mean of the segment confidences and number of weak segments."""
    return segconf.groupBy("call_id").agg(
        half_up(F.sum(F.floor(F.col("confidence") * 1000 + 0.5)) / (F.count(F.lit(1)) * 1000.0), 3).alias("overall_confidence"),
        F.count_if("flagged").alias("n_low"), F.count(F.lit(1)).alias("n_segments"))
