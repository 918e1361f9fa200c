"""Exact cases of the rule operators on small fixtures."""
import pytest
from pyspark.sql import functions as F

from parleo.operators import compliance, emotion, entities, fraud, matching, policy, series, turns
from parleo.sources import vocab
from parleo.streaming.jobs import transition_rows

SEG = "call_id bigint, chunk bigint, segment_id bigint, speaker string, text string, call_type string, lang string, start_ds bigint, dur_ds bigint"


def seg(spark, texts, call_type="collections", lang="en"):
    rows = [(1, i // 2, i, sp, t, call_type, lang, i * 50, 50) for i, (sp, t) in enumerate(texts)]
    return spark.createDataFrame(rows, SEG)


def found(spark, text, lang="en"):
    df = spark.createDataFrame([(1, text)], "id int, text string")
    return {(r.entity_type, r.value) for r in entities.entities(df, ["id"], F.lit(lang)).collect()}


@pytest.mark.parametrize("text,want", [
    ("pay ₹5,000 today", ("payment_amount", "5000.00 INR")), ("it is $250.00", ("payment_amount", "250.00 USD")),
    ("about 5 lakh", ("payment_amount", "500000.00 INR")), ("raised €3 million", ("payment_amount", "3000000.00 EUR")),
    ("pan ABCDE1234F", ("pan_number", "ABCDE1234F")), ("ifsc HDFC0001234", ("ifsc_code", "HDFC0001234")),
    ("at 12.5 percent", ("interest_rate", "12.5")), ("emi of Rs 4,500", ("emi_amount", "4500")), ("24 months tenure", ("tenure", "24")),
    ("due 12/03/2025", ("due_date", "12/03/2025")), ("by tomorrow", ("due_date", "by tomorrow"))])
def test_entities(spark, text, want):
    assert want in found(spark, text)


def test_entity_edge_cases(spark):
    assert found(spark, "") == set()
    assert [v for t, v in found(spark, "2 lakh and 3 lakh") if t == "payment_amount"].__len__() == 2
    assert ("payment_amount", "300000.00 INR") in found(spark, "3 लाख", "hi")
    assert len([1 for t, _ in found(spark, "Rs 500 and Rs 500") if t == "payment_amount"]) == 1


def test_masks_leave_nothing_behind(spark):
    text = "card 4111 1111 1111 1111 mail a.b@x.com call (212) 555-0123 upi me@ybl phone 9876543210"
    r = spark.createDataFrame([(text,)], "text string").select(
        entities.pii_spans(F.col("text")).alias("p"), F.col("text")).select(
        "p", entities.mask_positions(F.col("text"), entities.clusters(F.col("p"))).alias("m"), entities.mask_everywhere(F.col("text"), F.col("p")).alias("e")).first()
    for s in r.p:
        assert text[s.start:s.end] == s.text
        assert s.text not in r.m and s.text not in r.e
    assert {s.entity_type for s in r.p} >= {"CREDIT_CARD", "EMAIL_ADDRESS", "PHONE_NUMBER", "IN_UPI_ID", "IN_PHONE"}


def test_overlapping_spans_are_covered(spark):
    # the bank account pattern and the card pattern meet on the same digits
    r = spark.createDataFrame([("my bank account 4111111111111111 end",)], "text string").select(
        entities.mask_positions(F.col("text"), entities.clusters(entities.pii_spans(F.col("text")))).alias("m")).first()
    assert "411111" not in r.m and r.m.startswith("my bank account ") and r.m.endswith(" end")


def test_verhoeff(spark):
    r = spark.createDataFrame([("2363",), ("2364",), ("12a",)], "d string").select(entities.verhoeff_ok(F.col("d")).alias("ok")).collect()
    assert [x.ok for x in r] == [True, False, False]


def test_prohibited_phrase_across_turns(spark):
    s = seg(spark, [("agent", "we will send"), ("customer", "what"), ("agent", "police to you"), ("agent", "you fool")])
    c = compliance.prohibited_phrases(s, vocab.seed_vocab(spark)).collect()
    assert {r.check_name for r in c} == {"prohibited_threats", "prohibited_abusive_language"}
    assert {r.check_name: r.segment_id for r in c} == {"prohibited_threats": None, "prohibited_abusive_language": 3}
    # the customer may say it in a regulated call
    assert compliance.prohibited_phrases(seg(spark, [("customer", "you fool")]), vocab.seed_vocab(spark)).count() == 0


def test_general_calls_check_everybody(spark):
    s = seg(spark, [("Speaker B", "you fool"), ("Speaker A", "my name is x, this call is recorded")], "general")
    assert [r.severity for r in compliance.prohibited_phrases(s, vocab.seed_vocab(spark)).collect()] == ["low"]
    got = {r.check_name: r.passed for r in compliance.general_checks(s).collect()}
    assert got == {"Forward-Looking Disclaimer": False, "Recording Disclosure": True, "Speaker Identification": True}


def test_disclosures_and_end_request(spark):
    s = seg(spark, [("agent", "my name is x calling about your overdue loan"), ("customer", "stop calling me")] + [("agent", "but listen")] * 4)
    got = {r.check_name: r.passed for r in compliance.disclosure_checks(s, vocab.seed_vocab(spark)).collect()}
    assert got == {"caller_identification": True, "purpose_disclosure": True, "recording_consent": False, "mini_miranda": True}
    e = compliance.ignored_end_request(s, vocab.seed_vocab(spark)).collect()
    assert [(r.segment_id, r.severity) for r in e] == [(1, "high")]


def test_scam_rules(spark):
    s = seg(spark, [("agent", "install anydesk now"), ("agent", "act now, limited time, right away"), ("agent", "share your"), ("agent", "otp please")])
    got = {r.signal_type: (r.segment_id, round(r.confidence, 2)) for r in fraud.scam_signals(s).collect()}
    assert got["remote_access_request"] == (0, 0.85)
    assert got["urgency_pressure"] == (0, 0.8)
    assert got["credential_request"] == (0, 0.75)  # found across two turns


@pytest.mark.parametrize("kind,emo_,conf,want", [("voice_stress_anomaly", "angry", 0.8, 0.48), ("voice_stress_anomaly", "neutral", 0.5, 0.65),
                                                  ("voice_stress_anomaly", "happy", 0.5, 0.5), ("voice_stress_anomaly", "sad", 0.9, 1.0), ("third_party_detected", "angry", 0.7, 0.7)])
def test_fusion(spark, kind, emo_, conf, want):
    s = spark.createDataFrame([(1, 0, 5, kind, conf)], "call_id bigint, chunk bigint, segment_id bigint, signal_type string, confidence double")
    e = spark.createDataFrame([(1, 0, 5, emo_)], "call_id bigint, chunk bigint, segment_id bigint, emotion string")
    d = spark.createDataFrame([(1, 0.4)], "call_id bigint, diversity double")
    assert fraud.fuse_with_emotions(s, e, d).first().confidence == pytest.approx(want)


def test_incongruence(spark):
    s = seg(spark, [("agent", "please confirm your date of birth"), ("agent", "hello?"), ("customer", "uh"), ("agent", "nice weather"), ("customer", "yes")])
    e = spark.createDataFrame([(1, 1, 2, "fearful", 7000, 7000, 0), (1, 2, 4, "fearful", 9000, 9000, 0)],
                              "call_id bigint, chunk bigint, segment_id bigint, emotion string, score_bp bigint, fear_bp bigint, surprise_bp bigint")
    got = fraud.emotional_incongruence(s, e, size=2).collect()
    assert [(r.question_segment, r.segment_id, r.confidence) for r in got] == [(0, 2, 0.7)]


def test_merge_and_subtract(spark):
    iv = spark.createDataFrame([(1, 0, 1000, 60000), (1, 1500, 2000, 60000), (1, 2500, 3000, 60000), (2, 0, 1000, 9000), (2, 5000, 6000, 9000)],
                               "call_id bigint, start bigint, end bigint, call_end bigint")
    got = sorted((r.call_id, r.start, r.end) for r in series.merge_close(iv).collect())
    assert got == [(1, 0, 3000), (2, 0, 1000), (2, 5000, 6000)]
    whole = spark.createDataFrame([(1, 0, 10_000)], "call_id bigint, start bigint, end bigint")
    hold = spark.createDataFrame([(1, 3000, 6000)], "call_id bigint, g_start bigint, g_end bigint")
    assert sorted((r.start, r.end) for r in series.subtract(whole, hold).collect()) == [(0, 3000), (6000, 10_000)]
    gaps = sorted((r.g_start, r.g_end) for r in series.gaps(iv.where("call_id = 2")).collect())
    assert gaps == [(1000, 5000), (6000, 9000)]


def test_dominant_and_summary(spark):
    r = spark.createDataFrame([(0.5,), (-0.8,), (-0.4,), (0.0,)], "a double").select(emotion.dominant_from_mean(F.col("a")).alias("d")).collect()
    assert [x.d for x in r] == ["positive", "angry", "frustrated", "neutral"]
    e = spark.createDataFrame([(1, "happy", 5100)] * 3 + [(1, "angry", 9500)] * 2, "call_id bigint, emotion string, score_bp bigint")
    s = emotion.emotion_summary(e, ["call_id"]).first()
    assert (s.dominant, s.n_escalations, s.distribution_m) == ("angry", 2, "angry=400,happy=600")


def brute_transitions(rows):
    """The rule as a plain loop: persists in the next row or scores at least 0.7."""
    if len(rows) < 3:
        return []
    state, at, out = rows[0][1], rows[0][0], []
    for i in range(1, len(rows)):
        seg_, emo_, score = rows[i]
        if emo_ == state:
            continue
        persists = i + 1 < len(rows) and rows[i + 1][1] == emo_
        if persists or score >= 7000:
            out.append((state, emo_, seg_, at))
            state, at = emo_, seg_
    return out


def test_transitions_match_the_loop(spark):
    import random
    rnd = random.Random(5)
    data = []
    for k in range(12):
        for i in range(80 if k == 0 else rnd.randint(1, 12)):
            data.append((k, "agent", i // 3, i, rnd.choice(["neutral", "angry", "happy", "sad"]), rnd.choice([3000, 5000, 6000, 7500])))
    df = spark.createDataFrame(data, "call_id bigint, speaker string, chunk bigint, seg bigint, emotion string, score_bp bigint")
    got = sorted((r.call_id, r.from_emotion, r.to_emotion, r.at_segment, r.from_segment) for r in emotion.transitions(df, ["call_id", "speaker"], ["seg"], "seg", size=2).collect())
    want = []
    for k in range(12):
        conf = [(r[3], r[4], r[5]) for r in data if r[0] == k and r[5] >= 4000]
        want += [(k, *t) for t in brute_transitions(conf)]
    assert got == sorted(want) and want


def test_stream_state_machine_in_pieces():
    rows = [(0, "neutral", 5000), (1, "angry", 8000), (2, "angry", 5000), (3, "happy", 5000), (4, "happy", 4500), (5, "sad", 7200), (6, "neutral", 5000)]
    whole, _ = transition_rows(rows, None)
    parts, state = [], None
    for r in rows:
        out, state = transition_rows([r], state)
        parts += out
    assert parts == whole == brute_transitions(rows)


def test_routing(spark):
    texts = ["Okay.", "yes", "thank you", "the numbers were fine today overall", "हाँ"]
    df = spark.createDataFrame([(t, "hi" if i == 4 else "en") for i, t in enumerate(texts)], "text string, lang string")
    r = df.select(policy.route(F.col("text"), F.col("lang"), F.lit("positive"), F.lit(500)).alias("r")).collect()
    assert [x.r for x in r] == ["skip", "skip", "skip", "full", "skip"]


def test_word_split(spark):
    w = [("a", 0, 1, None), ("b", 1, 2, "S0"), ("c", 2, 3, None), ("d", 3, 4, "S1"), ("e", 4, 5, "S1")]
    df = spark.createDataFrame([(1, 0, w)], "call_id bigint, segment_id bigint, words array<struct<word:string,start:bigint,end:bigint,speaker:string>>")
    got = [(r.speaker, r.text, r.start_cs, r.end_cs) for r in turns.split_by_word_speaker(df).collect()]
    assert got == [("S0", "a b c", 0, 3), ("S1", "d e", 3, 5)]


def test_merged_turn_parts_and_context(spark):
    s = seg(spark, [("agent", "aaaa"), ("agent", "bbbb"), ("agent", "cccc"), ("customer", "dd"), ("agent", "ee")])
    whole = turns.merged_turns(s)
    assert sorted((r.turn_no, r.part, r.text) for r in whole.collect()) == [(0, 0, "aaaa bbbb cccc"), (1, 0, "dd"), (2, 0, "ee")]
    cut = turns.merged_turns(s, part_chars=8)
    assert sorted((r.turn_no, r.part, r.text) for r in cut.collect())[:2] == [(0, 0, "aaaa bbbb"), (0, 1, "cccc")]
    full = "[agent] (0s): aaaa bbbb cccc\n[customer] (15s): dd\n[agent] (20s): ee"
    assert turns.context_text(whole).first().context == full
    assert turns.context_text(whole, max_chars=20).first().context == full[:20] + "\n... (truncated)"


def _call(spark, lines, lang="en", call_type="collections"):
    rows = [(1, 0, i, s, t, lang, call_type, 10 * i, 10 * i + 10, 10) for i, (s, t) in enumerate(lines)]
    return spark.createDataFrame(rows, "call_id bigint, chunk bigint, segment_id bigint, speaker string, text string, lang string, call_type string, start_ds bigint, end_ds bigint, dur_ds bigint")


def _vocab(spark, rows):
    return spark.createDataFrame(rows, "lang string, domain string, call_type string, category string, phrase string, regulation string, rank int")


def test_long_phrase_over_three_turns(spark):
    from parleo.operators import matching
    phrase = "one two three four five six seven eight nine ten eleven twelve thirteen"
    seg = _call(spark, [("agent", "well one two three four five"), ("agent", "six seven eight"), ("agent", "nine ten eleven twelve thirteen bye")])
    v = _vocab(spark, [("en", "prohibited", None, "threats", phrase, None, 0)]).select("category", "phrase")
    assert [r.segment_id for r in matching.call_phrases(seg, v).collect()] == [0]
    assert matching.running_hits(seg, [("threats", phrase)]).count() == 1


def test_vocabulary_phrase_ends_the_call(spark):
    from parleo.operators import compliance
    lines = [("customer", "मुझे परेशान मत करो please")] + [("agent", "but listen")] * 7
    v = _vocab(spark, [("hi", "end_call", None, "end_call", "मुझे परेशान मत करो", None, 0)])
    r = compliance.ignored_end_request(_call(spark, lines, "hi"), v).collect()
    assert [(x.segment_id, x.evidence.count("7 more")) for x in r] == [(0, 1)]
    assert compliance.ignored_end_request(_call(spark, lines, "ta"), v).count() == 0


def test_one_disclosure_row_per_check_and_own_regulation(spark):
    from parleo.operators import compliance
    v = _vocab(spark, [("en", "disclosure", "kyc", "consent", "do you agree", "R_en", 0), ("hi", "disclosure", "kyc", "consent", "सहमति", "R_hi", 0)])
    lines = [("agent", "सहमति चाहिए"), ("customer", "ok")]
    hi = compliance.disclosure_checks(_call(spark, lines, "hi", "kyc"), v).collect()
    en = compliance.disclosure_checks(_call(spark, lines, "en", "kyc"), v).collect()
    assert [(r.passed, r.regulation) for r in hi] == [(True, "R_hi")] and [(r.passed, r.regulation) for r in en] == [(False, "R_en")]


def test_prohibited_phrase_of_any_vocabulary_shows_its_turn(spark):
    from parleo.operators import compliance
    v = _vocab(spark, [("en", "prohibited", None, "threats", "we will repaint your fence", None, 0)])
    r = compliance.prohibited_phrases(_call(spark, [("agent", "hello"), ("agent", "we will repaint your fence"), ("agent", "we will repaint your fence")]), v).collect()
    assert [x.segment_id for x in r] == [1]


def test_every_occurrence_is_masked(spark):
    from pyspark.sql import functions as F

    from parleo.operators import entities
    d = spark.createDataFrame([("pan ABCDE1234F again ABCDE1234F",)], "text string")
    t = d.select(entities.mask_positions(F.col("text"), entities.clusters(entities.pii_occurrences(F.col("text")))).alias("t")).first().t
    assert "ABCDE1234F" not in t and t.count("XXXXX1234X") == 2


def test_alignment_of_unequal_texts(spark):
    from parleo.operators import mining
    rows = [(1, "please pay the emmy today sir", "please pay the emi today"), (2, "a b c d", "a x c d"), (3, "the loan of kayak was good", "well the loan of kyc was very good"),
            (4, "", "word"), (5, "same same same", "same same same"), (6, "a q c", "a r s c")]
    d = spark.createDataFrame(rows, "i int, heard string, truth string")
    got = sorted((r.i, r.pos, r.heard, r.truth) for r in mining.aligned_pairs(d, ["i"]).collect())
    assert got == [(1, 3, "emmy", "emi"), (2, 1, "b", "x"), (3, 3, "kayak", "kyc")] or got[:3] == [(1, 3, "emmy", "emi"), (2, 1, "b", "x"), (3, 3, "kayak", "kyc")] and {g[0] for g in got[3:]} <= {4}


def test_similar_over_all_vectors(spark):
    from parleo.operators import mining
    v = spark.createDataFrame([(0, "a", [1.0, 0.0]), (1, "b", [1.0, 0.1]), (2, "a", [0.0, 1.0]), (3, "c", [0.9, 0.0])], "vec_id bigint, label string, embedding array<float>")
    q = v.where("vec_id = 0").selectExpr("label", "vec_id AS q_id", "embedding AS q")
    assert [(r.vec_id, r.rn) for r in mining.top_similar(v, q, 2).orderBy("rn").collect()] == [(3, 1), (1, 2)]


def test_scam_rules_from_a_table(spark, monkeypatch):
    monkeypatch.setattr(matching, "LIST_ROWS", 2)  # three blocks of phrases
    rows = [("scam", "urgency_pressure", "quick quick", 0), ("scam", "urgency_pressure", "Today Only", 1), ("scam", "urgency_pressure", "quick quick", 2),
            ("scam", "financial_threats", "jail", 0), ("scam", "no_rule", "hello", 0), ("scam_type", "urgency_pressure", "hello", 0), ("scam", "remote_access_tools", "farview", 0)]
    table = spark.createDataFrame(rows, "domain string, category string, phrase string, rank int")
    s = seg(spark, [("agent", "hello quick"), ("agent", "quick or jail"), ("customer", "today only on farview")])
    got = {r.signal_type: (r.segment_id, r.n_hits, r.description) for r in fraud.scam_signals(s, table).collect()}
    assert got == {"urgency_pressure": (0, 2, "Multiple urgency/pressure phrases (2): quick quick, today only."),
                   "financial_threat": (0, 1, "Financial threats detected: jail."),
                   "remote_access_request": (2, 1, "Remote access tool request detected: 'farview'. Common in tech support scams.")}
    assert fraud.scam_signals(s, table.where("false")).count() == 0
