"""Costly text work is done once per row: neither per branch of an expression nor per word of the text."""
from pyspark.sql import functions as F

from conftest import SF
from parleo.catalog import QUERIES
from parleo.functions.columns import words


def optimized(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_words_of_blank_and_missing_text(spark):
    rows = [("", []), (" \n\t ", []), (None, None), (" a  b\nc ", ["a", "b", "c"])]
    got = spark.createDataFrame(rows, "text string, want array<string>").select("want", words(F.col("text")).alias("ws")).collect()
    assert all(r.want == r.ws for r in got)


def test_word_times_do_not_split_the_text_again_for_each_word(spark):
    assert optimized(QUERIES["X19_logprob_timing"](spark, SF)).count("regexp_replace") == 1
