"""Engine tables derived from the generic input tables.

``conversations`` -> segments (with or without scripted lines), ``events`` ->
time-series frames, emotions, intents and progress, ``orders``/``lineitem`` ->
calls and checks.  All derivations are column expressions over whole tables.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from parleo.functions.columns import pick
from parleo.plans.skew import chunk_rows, scan

CONVS_PER_CALL = 5
CALL_TYPES = ["collections", "kyc", "consent", "complaint", "onboarding", "general"]
EMOTIONS = ["neutral", "happy", "angry", "fearful", "sad", "surprised", "disgusted"]
EVENT_EMOTION = {"view": "neutral", "click": "happy", "purchase": "surprised", "error": "angry", "signup": "fearful"}
EVENT_INTENT = {"view": "info_request", "click": "agreement", "purchase": "payment_promise", "error": "complaint",
                "signup": "acknowledgment"}
EVENT_STAGE = {"view": "1", "click": "3", "purchase": "4C", "error": "4I", "signup": "done"}
EVENT_TAMPER = {"view": "spectral_discontinuity", "click": "silence_anomaly", "purchase": "noise_floor_inconsistency",
                "error": "double_compression", "signup": "replay_detected"}
EPOCH = "2024-01-01 00:00:00"
FRAME_CHUNK_MS = 20_000

LINES = [
    "hello",
    "my name is asha rao calling from north bank regarding your overdue loan",
    "this call may be recorded for quality",
    "your emi of Rs 5,000 is due on 12/03/2025",
    "i will pay 2 lakh and 3 lakh by friday",
    "we will send police to your house",
    "पुलिस भेजेंगे कल",
    "please share your otp right now immediately",
    "install anydesk and share your screen",
    "stop calling me i want to end this call",
    "can you confirm your date of birth",
    "yes",
    "my pan is ABCDE1234F and ifsc HDFC0001234",
    "the interest rate is 12.5 percent for 24 months tenure",
    "i refuse to pay this is a wrong charge",
    "i want to speak to your manager",
    "let me turn the call over to Ravi Menon",
    "Thank you, Ravi",
    "revenue increased by 4 percent and margin improved",
    "we expect strong growth next quarter",
    "there is risk and uncertainty in demand",
    "why did the expense decline?",
    "நாளை பணம் கட்டுகிறேன்",
    "$3 million was paid to acct 4785380592391139",
]
SHORT_LINES = [0, 11]  # stay alone so that whole-turn rules can fire


def load(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """Deal rows out over all cores when the files give fewer splits than there are cores.

    For work that is heavy per row (patterns over long texts).  With many files
    the splits are there already and nothing is shuffled.
    """
    want = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(want) if df.rdd.getNumPartitions() < want else df


def ts_utc(c: str | Column) -> Column:
    """Wall clock as a zoned timestamp (watermarks reject the zone-less type)."""
    return (F.col(c) if isinstance(c, str) else c).cast("timestamp")


def _turns(spark: SparkSession, sf: str, scripted: bool) -> DataFrame:
    c = load(spark, sf, "conversations")
    size = chunk_rows(spark)
    text = F.coalesce(F.col("text"), F.lit(""))
    k = (F.col("conv_id") * 31 + F.col("turn") * 7) % 24
    if scripted:
        line = pick(k, LINES)
        shown = F.when(k.isin(*SHORT_LINES), line).otherwise(F.concat(line, F.lit(" "), text))
    else:
        shown = text
    speaker = F.when(F.col("role") == "assistant", "agent").when(F.col("role") == "user", "customer").otherwise("other")
    return c.select(
        F.floor(F.col("conv_id") / CONVS_PER_CALL).alias("call_id"),
        ((F.col("conv_id") % CONVS_PER_CALL) * (1 << 40) + F.floor(F.col("turn") / size)).alias("chunk"),
        "conv_id", "turn", speaker.alias("speaker"), shown.alias("text"),
        (10 + F.length(text) % 190).cast("bigint").alias("dur_ds"),
    )


def segments(spark: SparkSession, sf: str, scripted: bool = True) -> DataFrame:
    """Turns of a call with dense ids and running offsets in tenths of a second."""
    seg = scan(_turns(spark, sf, scripted), ["call_id"], "chunk", ["conv_id", "turn"], {
        "segment_id": ("sum", F.lit(1).cast("bigint"), False), "start_ds": ("sum", F.col("dur_ds"), False)})
    return seg.withColumn("end_ds", F.col("start_ds") + F.col("dur_ds")).withColumn(
        "lang", pick(F.col("call_id") % 4, ["en", "hi", "ta", "en"])).withColumn("call_type", call_type_of(F.col("call_id")))


def raw_turns(spark: SparkSession, sf: str, scripted: bool = True) -> DataFrame:
    """Turns without numbering, for work that needs no position (no shuffle at all)."""
    t = _turns(spark, sf, scripted)
    return t.withColumn("lang", pick(F.col("call_id") % 4, ["en", "hi", "ta", "en"])).withColumn(
        "call_type", call_type_of(F.col("call_id")))


def call_type_of(call_id: Column) -> Column:
    return pick(call_id % 6, CALL_TYPES)


def segment_emotions(seg: DataFrame) -> DataFrame:
    """Emotion scores of segments in basis points, computed from the turn itself."""
    score = (F.col("conv_id") * 1777 + F.col("turn") * 911 + F.length("text") * 37) % 10001
    return seg.select("call_id", "chunk", "segment_id", "speaker",
                      pick((F.col("conv_id") * 13 + F.col("turn") * 5) % 7, EMOTIONS).alias("emotion"),
                      score.cast("bigint").alias("score_bp"),
                      F.when(F.col("turn") % 3 == 0, score * 7 % 10001).otherwise(score % 3000).cast("bigint").alias("fear_bp"),
                      (score * 3 % 8000).cast("bigint").alias("surprise_bp"))


def vocal_features(seg: DataFrame) -> DataFrame:
    """Voice features of turns as whole numbers, computed from the turn itself."""
    n, c, t = F.length("text"), F.col("conv_id"), F.col("turn")
    return seg.select("call_id", "chunk", "segment_id", "speaker", "start_ds", "dur_ds",
                      (100 + (c * 31 + t * 17 + n) % 150).alias("pitch"), (5 + (t * 7 + n) % 30).alias("pitch_sd"),
                      (500 + (n * 13 + c) % 2500).alias("jitter"), (2000 + (n * 29 + t) % 6000).alias("shimmer"),
                      (5 + (n * 3 + c) % 20).alias("hnr"))


SIGNALS = ["voice_stress_anomaly", "coached_speech", "third_party_detected", "urgency_pressure", "remote_access_request"]


def segment_signals(seg: DataFrame) -> DataFrame:
    """One fraud signal per turn with a confidence, computed from the turn itself."""
    c, t = F.col("conv_id"), F.col("turn")
    return seg.select("call_id", "chunk", "segment_id", pick((c * 7 + t * 3) % 5, SIGNALS).alias("signal_type"),
                      (((c * 37 + t * 59) % 90 + 10) / 100).alias("confidence"))


def _map(c: str, table: dict[str, str]) -> Column:
    e = None
    for k, v in table.items():
        e = F.when(F.col(c) == k, v) if e is None else e.when(F.col(c) == k, v)
    return e


def frames(spark: SparkSession, sf: str) -> DataFrame:
    """Events as frames of a call: ten hours of wall clock count as one second of call time."""
    e = load(spark, sf, "events")
    secs = F.unix_micros(ts_utc("ts")) - F.unix_micros(F.lit(EPOCH).cast("timestamp"))
    t = F.floor(secs / 36_000_000).alias("t_ms")
    v = F.floor(F.col("value") * 100 + 0.5).alias("v100")
    return e.select("event_id", F.col("user_id").alias("call_id"), t, v, "event_type").withColumn(
        "chunk", F.floor(F.col("t_ms") / FRAME_CHUNK_MS))


def event_emotions(spark: SparkSession, sf: str) -> DataFrame:
    """Events as per-segment emotions with scores in basis points."""
    f = frames(spark, sf)
    return f.select("call_id", "chunk", "event_id", "t_ms", _map("event_type", EVENT_EMOTION).alias("emotion"),
                    F.when(F.col("event_id") % 2 == 0, "agent").otherwise("customer").alias("speaker"),
                    F.least(F.col("v100"), F.lit(10000)).alias("score_bp"))


def event_intents(spark: SparkSession, sf: str) -> DataFrame:
    e = load(spark, sf, "events")
    return e.select("event_id", F.col("user_id").alias("call_id"), _map("event_type", EVENT_INTENT).alias("intent"))


def event_sentiment(spark: SparkSession, sf: str) -> DataFrame:
    """Signed sentiment in thousandths from the event value: label by event type, score by value."""
    f = frames(spark, sf)
    label = (F.when(F.col("event_type").isin("click", "purchase"), "positive")
             .when(F.col("event_type") == "error", "negative").otherwise("neutral"))
    return f.select("call_id", "chunk", "event_id", "t_ms", label.alias("label"),
                    F.when(F.col("event_id") % 3 == 0, "agent").when(F.col("event_id") % 3 == 1, "customer")
                    .otherwise("unknown").alias("speaker"),
                    F.least(F.floor(F.col("v100") / 10), F.lit(1000)).alias("score_m"))


def calls(spark: SparkSession, sf: str) -> DataFrame:
    """Orders as call records: type by priority, duration by price, score by lines is added elsewhere."""
    o = load(spark, sf, "orders")
    ct = (F.when(F.col("o_orderpriority").startswith("1"), "collections")
          .when(F.col("o_orderpriority").startswith("2"), "kyc").when(F.col("o_orderpriority").startswith("3"), "complaint")
          .when(F.col("o_orderpriority").startswith("4"), "onboarding").otherwise("general"))
    return o.select(F.col("o_orderkey").alias("call_id"), F.col("o_custkey").alias("customer_id"), ct.alias("call_type"),
                    F.floor(F.col("o_totalprice") * 100 + 0.5).alias("dur_cs"), F.col("o_orderstatus").alias("status"),
                    ts_utc("o_orderdate").alias("ingested_at"))


def checks(spark: SparkSession, sf: str) -> DataFrame:
    """Line items as rule checks: returned lines failed; discount gives the severity."""
    l = load(spark, sf, "lineitem")
    sev = (F.when(F.col("l_discount") >= 0.09, "critical").when(F.col("l_discount") >= 0.06, "high")
           .when(F.col("l_discount") >= 0.03, "medium").otherwise("low"))
    return l.select(F.col("l_orderkey").alias("call_id"), F.col("l_linenumber").alias("line"),
                    (F.col("l_returnflag") != "R").alias("passed"), sev.alias("severity"),
                    F.concat(F.lit("check_"), F.col("l_linestatus"), F.lit("_"), (F.col("l_suppkey") % 5).cast("string"))
                    .alias("check_name"), (F.col("l_quantity") > 45).alias("fraud"))
