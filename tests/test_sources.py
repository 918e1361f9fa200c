"""Vocabulary files, exports and record scans."""
import json

import pytest

from parleo.operators import mining, records
from parleo.sources import sinks, vocab


def test_missing_vocabulary_is_empty(spark, tmp_path):
    assert vocab.read_vocab_json(spark, str(tmp_path / "none")).count() == 0


def test_vocabulary_file(spark, tmp_path):
    (tmp_path / "en.json").write_text(json.dumps({"greetings": ["hello", "hi"], "prohibited_phrases": {"threats": ["x y"]},
        "compliance_keywords": {"kyc": {"data_consent": {"keywords": ["consent"], "regulation": "R1"}}}}, indent=1))
    got = {(r.lang, r.domain, r.call_type, r.category, r.phrase, r.regulation) for r in vocab.read_vocab_json(spark, str(tmp_path)).collect()}
    assert got == {("en", "greeting", None, "greeting", "hello", None), ("en", "greeting", None, "greeting", "hi", None),
                   ("en", "prohibited", None, "threats", "x y", None), ("en", "disclosure", "kyc", "data_consent", "consent", "R1")}


def test_indicator_file(spark, tmp_path):
    p = tmp_path / "fraud_indicators.json"
    p.write_text(json.dumps({"urgency_pressure": ["act now"], "scam_type_keywords": {"loan_scam": ["upfront fee"]}}, indent=1))
    got = {(r.domain, r.category, r.phrase) for r in vocab.read_indicators_json(spark, str(p)).collect()}
    assert got == {("scam", "urgency_pressure", "act now"), ("scam_type", "loan_scam", "upfront fee")}


def test_record_files_and_quarantine(spark, tmp_path):
    (tmp_path / "a_record.json").write_text(json.dumps({"call_id": 1, "part": 0, "call_type": "kyc", "audio_file": "x/y.wav", "intents": [{"segment_id": 0, "intent": "refusal"}],
        "compliance_checks": [{"check_name": "c", "passed": False, "severity": "critical"}], "financial_entities": [], "fraud_signals": [], "transcript_segments": []}, indent=2))
    (tmp_path / "b_record.json").write_text('{"call_id": 2, "call')
    (tmp_path / "c_progress.json").write_text('{"call_id": 3}')
    good, bad = records.scan(spark, str(tmp_path), "*_record.json", multi_line=True)
    assert [r.call_id for r in good.collect()] == [1] and len(bad.collect()) == 1
    f = records.flatten(good).first()
    assert (f.audio_file, f.num_intents, f.num_compliance_violations, f.num_critical_violations, f.risk_level) == ("y.wav", 1, 1, 1, "low")


def test_unknown_format(spark, tmp_path):
    with pytest.raises(ValueError):
        sinks.export(spark.range(1), "xlsx", str(tmp_path / "o"))


def test_audio_listing_reads_names_only(spark, tmp_path):
    d = tmp_path / "support (DE set)"
    d.mkdir(parents=True)
    (d / "a.mp3").write_bytes(b"x")
    (d / "b.txt").write_bytes(b"x")
    r = mining.list_audio(spark, str(tmp_path)).collect()
    assert [(x.language, x.call_type, x.length) for x in r] == [("de", "complaint", 1)]


def test_text_column_fallback(spark):
    df = spark.createDataFrame([("t", 1)], "sentence string, y int")
    assert mining.text_column(df).first().text == "t"


def test_vocabulary_of_any_language_and_kind(spark, tmp_path):
    (tmp_path / "kok.json").write_text(json.dumps({"end_call_phrases": ["phon"], "currency_words": [{"words": ["rupayo", "rs"], "currency": "INR"}],
        "date_words": {"months": ["janer"]}, "financial_terms": {"acronyms": ["EMI"], "corrections": {"emmy": "EMI"}}}))
    (tmp_path / "fraud_indicators.json").write_text(json.dumps({"brand_new": ["act now"], "scam_type_keywords": {"loan": ["fee"]}}))
    got = {(r.lang, r.domain, r.category, r.phrase) for r in vocab.read_vocab_json(spark, str(tmp_path)).collect()}
    assert got == {("kok", "end_call", "end_call", "phon"), ("kok", "currency", "INR", "rupayo"), ("kok", "currency", "INR", "rs"), ("kok", "date", "months", "janer"),
                   ("kok", "acronym", "acronym", "EMI"), ("kok", "correction", "EMI", "emmy")}
    ind = {(r.domain, r.category, r.phrase) for r in vocab.read_indicators_json(spark, str(tmp_path / "fraud_indicators.json")).collect()}
    assert ind == {("scam", "brand_new", "act now"), ("scam_type", "loan", "fee")}
