"""Dates count as personal data only beside a word that says whose they are."""
from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from parleo.operators import entities


@pytest.mark.parametrize("text,want", [
    ("my date of birth is 12/03/1985 ok", [("12/03/1985", 20, 30, 0.95)]),
    ("DOB: 1985-03-12, born", [("1985-03-12", 5, 15, 0.95)]),
    ("birthday 3 March, 1985 and 4-Apr-1990", [("3 March, 1985", 9, 22, 0.95), ("4-Apr-1990", 27, 37, 0.95)]),
    ("the emi is due on 12/03/2025", []),  # 0.6 is below the threshold of its type
    ("date one two three four five 12/03/2025", []),  # the word is too far in front
    ("12/03/2025 is the date", []), ("date 12/3", []), ("", []),
])
def test_dates(spark, text, want):
    df = spark.createDataFrame([(text,)], "text string")
    got = df.select(F.filter(entities.pii_spans(F.col("text")), lambda s: s["entity_type"] == "DATE_TIME").alias("p")).first().p
    assert [(r.text, r.start, r.end, r.score) for r in got] == want


def test_mask_and_higher_threshold(spark):
    df = spark.createDataFrame([("date 12/03/2025",)], "text string")
    c = entities.clusters(entities.pii_occurrences(F.col("text")))
    assert df.select(entities.mask_positions(F.col("text"), c).alias("t")).first().t == "date [DATE_TIME]"
    assert df.select(F.size(entities.pii_spans(F.col("text"), 0.96)).alias("n")).first().n == 0
