"""Language guess: right language, and the text is read once per row."""
from pyspark.sql import functions as F

from parleo.functions.language import guess_language


def test_language_guess_reads_the_text_once(spark):
    rows = [("the end of the road", "en"), ("Der Hund und ich", "de"), ("le chat, la table", "fr"), ("el perro y una casa por", "es"), ("नमस्ते the of", "hi"),
            ("zzz", "en"), ("", "en"), (None, "en"), ("the der", "en"), ("der die le", "de")]
    df = spark.createDataFrame(rows, "text string, want string").repartition(2)
    got = df.select("want", guess_language(F.col("text")).alias("guess"))
    assert got._jdf.queryExecution().optimizedPlan().toString().count("regexp_replace") == 1
    assert all(r.want == r.guess for r in got.collect())
