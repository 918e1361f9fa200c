"""Obligations: nearest amount and date, strength, odd texts."""
import pytest
from pyspark.sql import functions as F

from parleo.operators import obligations as obl

SEG = "call_id bigint, segment_id bigint, speaker string, text string, start_ds bigint"


def found(spark, text, lang="en"):
    df = spark.createDataFrame([(1, 0, "customer", text, 0)], SEG)
    return [(r.obligation_type, r.strength, r.amount and (r.amount.value, r.amount.raw_text), r.date_referenced, r.legally_significant) for r in sorted(obl.obligations(df, F.lit(lang)).collect(), key=lambda r: r.item)]


@pytest.mark.parametrize("text, want", [
    ("I will pay Rs 500 today, Rs 900 later", [("payment_promise", "binding", (500.0, "Rs 500"), "today", True)]),
    ("Rs 900 was due, i will pay Rs 40 on 1/2/2025", [("payment_promise", "binding", (40.0, "Rs 40"), "2025-02-01", True)]),
    ("Rs 900 i will  PAY and much later perhaps Rs 40", [("payment_promise", "vague", (900.0, "Rs 900"), None, False)]),
    ("i will pay if they call", [("payment_promise", "conditional", None, None, False)]),
    ("i will pay 30/02/2025, Rs 1", [("payment_promise", "binding", (1.0, "Rs 1"), "30/02/2025", True)]),
    ("i agree to this and i refuse to that", [("consent", "binding", None, None, True), ("denial", "denial", None, None, True)]),
    ("hi will payments", []), ("", []), (None, []),
    ("Rs 7 Rs 7 i will pay Rs 7", [("payment_promise", "promise", (7.0, "Rs 7"), None, False)]),
])
def test_obligations(spark, text, want):
    assert found(spark, text) == want


def test_long_and_repeated_turns(spark):
    long = "i will pay Rs 5 tomorrow. " * 40 + "word " * 20_000
    df = spark.createDataFrame([(1, 0, None, long, None), (1, 0, None, long, None)], SEG)
    got = obl.obligations(df).collect()
    assert len(got) == 80 and {(r.strength, r.amount.value, r.date_referenced) for r in got} == {("binding", 5.0, "tomorrow")}
