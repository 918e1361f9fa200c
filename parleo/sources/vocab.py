"""Vocabulary as a long table: lang, domain, call_type, category, phrase, regulation, rank."""
from __future__ import annotations

import json
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from parleo.sources import seeds
from parleo.sources.sinks import work_path

INDICATORS = "fraud_indicators"  # this file of the folder holds no language
VOCAB = T.StructType([
    T.StructField(n, T.StringType()) for n in ("lang", "domain", "call_type", "category", "phrase", "regulation")
] + [T.StructField("rank", T.IntegerType())])


def seed_rows() -> list[tuple]:
    """The built-in lists; fewer than a thousand rows by construction."""
    rows: list[tuple] = []

    def add(lang, domain, block, split=None):
        for i, (head, phrase) in enumerate(seeds.entries(block)):
            ct, cat, reg = split(head) if split else (None, head, None)
            rows.append((lang, domain, ct, cat, phrase, reg, i))

    add("en", "disclosure", seeds.DISCLOSURES_EN, tuple)
    add("en", "prohibited", seeds.PROHIBITED_EN)
    add("hi", "prohibited", seeds.PROHIBITED_HI)
    add("en", "end_call", seeds.END_CALL_EN)
    add("en", "third_party", seeds.THIRD_PARTY)
    add("en", "scam", seeds.SCAM_EN)
    add("en", "call_type", seeds.CALL_TYPE_SIGNALS)
    add("en", "trivial", seeds.TRIVIAL_EN)
    add("en", "greeting", seeds.GREETINGS_EN)
    for lang, units in seeds.CURRENCY_WORDS.items():
        add(lang, "currency", units)
    for lang, kinds in seeds.DATE_WORDS.items():
        add(lang, "date", kinds)
    return rows


def local_table(spark: SparkSession, rows: list[tuple], schema: T.StructType | str) -> DataFrame:
    """Small fixed table as a local relation, which the optimiser can filter and broadcast by itself."""
    st = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
    return spark.createDataFrame(pd.DataFrame(rows, columns=[f.name for f in st.fields]), st)


def seed_vocab(spark: SparkSession) -> DataFrame:
    return local_table(spark, seed_rows(), VOCAB)


def phrases(domain: str, lang: str | None = None) -> list[tuple]:
    return [r for r in seed_rows() if r[1] == domain and (lang is None or r[0] == lang)]


def read_vocab_json(spark: SparkSession, path: str, by_folder: bool = False) -> DataFrame:
    """Read ``{lang}.json`` vocabularies; a missing or empty folder gives an empty table.

    With ``by_folder`` the files lie in ``lang=xx`` folders, as a Spark writer leaves them.

    Simple lists become one row per phrase, ``prohibited_phrases`` one row per
    category and phrase, ``compliance_keywords`` one row per call type, check
    and keyword, ``currency_words`` one row per currency (the category) and
    word, ``date_words`` one row per kind (months, days, relative) and word,
    ``financial_terms`` acronyms and corrections (the category is what is meant).
    The name of a file up to its ending is the language.
    """
    kw = T.MapType(T.StringType(), T.MapType(T.StringType(), T.StructType([
        T.StructField("keywords", T.ArrayType(T.StringType())), T.StructField("regulation", T.StringType())])))
    arr = T.ArrayType(T.StringType())
    schema = T.StructType([
        T.StructField("greetings", arr), T.StructField("trivial_phrases", arr), T.StructField("end_call_phrases", arr),
        T.StructField("prohibited_phrases", T.MapType(T.StringType(), arr)), T.StructField("compliance_keywords", kw),
        T.StructField("currency_words", T.ArrayType(T.StructType([T.StructField("words", arr), T.StructField("currency", T.StringType())]))),
        T.StructField("date_words", T.MapType(T.StringType(), arr)),
        T.StructField("financial_terms", T.StructType([
            T.StructField("acronyms", arr), T.StructField("corrections", T.MapType(T.StringType(), T.StringType()))]))])
    try:
        if by_folder:
            raw = spark.read.schema(schema.add("lang", T.StringType())).json(path)
        else:
            raw = spark.read.schema(schema).option("multiLine", True).option("pathGlobFilter", "*.json").json(path)
            raw = raw.withColumn("lang", F.regexp_extract(F.input_file_name(), r"([^/]+)\.json$", 1)).where(F.col("lang") != INDICATORS)
    except Exception as e:  # a path that is not there is an empty vocabulary
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], VOCAB)
    none = F.lit(None).cast("string")

    def simple(col: str, domain: str) -> DataFrame:
        return raw.select("lang", F.lit(domain).alias("domain"), none.alias("call_type"), F.lit(domain).alias("category"),
                          F.posexplode(col).alias("rank", "phrase"), none.alias("regulation"))

    bad = raw.select("lang", F.explode("prohibited_phrases").alias("category", "ps")).select(
        "lang", F.lit("prohibited").alias("domain"), none.alias("call_type"), "category",
        F.posexplode("ps").alias("rank", "phrase"), none.alias("regulation"))
    checks = (raw.select("lang", F.explode("compliance_keywords").alias("call_type", "m"))
              .select("lang", "call_type", F.explode("m").alias("category", "s"))
              .select("lang", F.lit("disclosure").alias("domain"), "call_type", "category",
                      F.posexplode("s.keywords").alias("rank", "phrase"), F.col("s.regulation").alias("regulation")))
    def listed(of: DataFrame, domain: str) -> DataFrame:
        """lang, category, list -> rows."""
        return of.select("lang", F.lit(domain).alias("domain"), none.alias("call_type"), "category", F.posexplode("ps").alias("rank", "phrase"), none.alias("regulation"))

    # the order of the currencies counts too: it is the upper part of the rank
    money = raw.select("lang", F.posexplode("currency_words").alias("at", "c")).select(
        "lang", F.lit("currency").alias("domain"), none.alias("call_type"), F.col("c.currency").alias("category"), "at", F.posexplode("c.words").alias("rank", "phrase"), none.alias("regulation"))
    money = money.withColumn("rank", F.col("at") * 1000 + F.col("rank")).drop("at")
    dates = listed(raw.select("lang", F.explode("date_words").alias("category", "ps")), "date")
    terms = listed(raw.select("lang", F.lit("acronym").alias("category"), F.col("financial_terms.acronyms").alias("ps")), "acronym")
    heard = raw.select("lang", F.explode("financial_terms.corrections").alias("phrase", "category")).select(
        "lang", F.lit("correction").alias("domain"), none.alias("call_type"), "category", F.lit(0).alias("rank"), "phrase", none.alias("regulation"))
    parts = [simple("greetings", "greeting"), simple("trivial_phrases", "trivial"), simple("end_call_phrases", "end_call"),
             bad, checks, money, dates, terms, heard]
    return reduce(DataFrame.unionByName, parts).select(*[f.name for f in VOCAB.fields])


def round_trip(spark: SparkSession, files: dict[str, dict]) -> DataFrame:
    """Write one vocabulary file per language in the layout of ``read_vocab_json`` and read them back."""
    path = work_path(spark, "vocabulary")
    rows = local_table(spark, [(lang, json.dumps(body, ensure_ascii=False)) for lang, body in files.items()], "lang string, value string")
    rows.write.partitionBy("lang").text(path)
    return read_vocab_json(spark, path, by_folder=True)


def read_indicators_json(spark: SparkSession, path: str, multi_line: bool = True) -> DataFrame:
    """Scam indicator file: ``category -> phrases`` for any categories, plus ``scam_type_keywords: type -> phrases``."""
    text = spark.read.text(path, wholetext=multi_line)
    # values stay JSON text until their shape is known from the key
    rows = text.select(F.explode(F.from_json("value", "map<string,string>")).alias("category", "item"))
    item = F.col("item")
    is_types = F.col("category") == "scam_type_keywords"
    lists = rows.where(~is_types).select(F.lit("scam").alias("domain"), "category", F.from_json(item, "array<string>").alias("ps"))
    types = rows.where(is_types).select(F.lit("scam_type").alias("domain"), F.explode(F.from_json(item, "map<string,array<string>>")).alias("category", "ps"))
    return lists.unionByName(types).select("domain", "category", F.posexplode("ps").alias("rank", "phrase"))


def round_trip_indicators(spark: SparkSession, lists: dict) -> DataFrame:
    """Write one indicator file in the layout of ``read_indicators_json`` and read it back."""
    path = work_path(spark, "indicator-file")
    local_table(spark, [(json.dumps(lists, ensure_ascii=False),)], "value string").write.text(path)
    return read_indicators_json(spark, path, multi_line=False)
