"""Extraction and routing driven by vocabulary tables."""
import pytest
from pyspark.sql import functions as F

from parleo.operators import entities, policy
from parleo.sources import vocab

FILES = {
    "en": {"currency_words": [{"words": ["rupees", "rs"], "currency": "INR"}, {"words": ["lakh"], "currency": "INR_LAKH"}], "date_words": {"months": ["may"], "days": ["friday"], "relative": ["today", "next week"]},
           "trivial_phrases": ["Okay"], "greetings": ["hello"]},
    "ta": {"currency_words": [{"words": ["லட்சம்"], "currency": "INR_LAKH"}, {"words": ["ரூபாய்"], "currency": "INR"}], "date_words": {"months": ["மே"], "relative": ["நாளை"]}, "trivial_phrases": ["சரி"]},
    "xx": {"currency_words": [{"words": ["a.b (c)"], "currency": "XXX"}], "date_words": {}},
}


@pytest.fixture(scope="module")
def lex(spark):
    return entities.lexicon(vocab.round_trip(spark, FILES))


@pytest.mark.parametrize("lang, text, want", [
    ("ta", "3 லட்சம் பாக்கி", {("payment_amount", "300000.00 INR")}),
    ("ta", "நாளை மே 5 and may 6 today", {("due_date", "நாளை"), ("due_date", "மே 5"), ("due_date", "may 6")}),  # relative English words count in English only
    ("ta", "நாளைக்கு", set()),  # a longer word is another word
    ("hi", "10 lakh कल", {("payment_amount", "1000000.00 INR")}),  # no file for Hindi: English words still count
    ("xx", "7 A.B (c) now", {("payment_amount", "7.00 XXX")}),
    ("xx", "7 aXb (c) now", set()),
    ("en", "by next  week or this Friday", {("due_date", "by next  week"), ("due_date", "this Friday")}),
    (None, "12 rs today", {("payment_amount", "12.00 INR"), ("due_date", "today")}),
])
def test_words_of_any_file(spark, lex, lang, text, want):
    df = spark.createDataFrame([(1, text, lang)], "id int, text string, l string")
    got = entities.entities(df, ["id"], F.col("l"), ("money", "date"), lex)
    assert {(r.entity_type, r.value) for r in got.collect()} == want


def test_empty_vocabulary_finds_symbols_only(spark):
    none = entities.lexicon(vocab.seed_vocab(spark).limit(0))
    df = spark.createDataFrame([(1, "₹500 and 5 lakh on 01/02/2025 or today", "en")], "id int, text string, l string")
    got = entities.entities(df, ["id"], F.col("l"), ("money", "date"), none)
    assert {r.value for r in got.collect()} == {"500.00 INR", "01/02/2025"}


def test_reference_numbers_show_the_whole_match(spark):
    df = spark.createDataFrame([(1, "ticket no. ABCDEF12X9 closed")], "id int, text string")
    got = [(r.value, r.raw_text) for r in entities.entities(df, ["id"], kinds=("id",)).collect()]
    assert got and all(raw.startswith("ticket no. ") and raw.endswith(value) for value, raw in got)


def test_routing_by_language(spark):
    rows = [("okay.", "en"), ("சரி", "ta"), ("ok fine", "ta"), ("да", "ru"), ("hello", "en"), ("hello", "ta"), (None, "en"), ("Okay", None)]
    t = policy.phrase_flags(spark.createDataFrame(rows, "text string, lang string"), vocab.round_trip(spark, FILES))
    r = t.withColumn("route", policy.route(F.col("text"), F.col("lang"), F.lit("positive"), F.lit(500), F.col("is_trivial"), F.col("lang_known")))
    got = {(x.text, x.lang): (x.route, x.is_greeting) for x in r.collect()}
    assert got["okay.", "en"] == ("skip", False) and got["சரி", "ta"] == ("skip", False) and got["да", "ru"] == ("skip", False)
    assert got["ok fine", "ta"] == ("full", False)  # Tamil has a list, and this is not on it
    assert got["hello", "en"][1] and not got["hello", "ta"][1]
