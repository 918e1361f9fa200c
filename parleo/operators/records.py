"""Nested call records: build, flatten, read back.

A record is written in parts of ``chunk`` segments so that no task ever holds
an unbounded call; an ordinary call has exactly one part.  Readers add the
parts up, so flat rows do not depend on how a call was cut.
"""
from __future__ import annotations

from functools import lru_cache

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from parleo.operators.obligations import OBLIGATION

SEGMENT = "id bigint, start_ds bigint, end_ds bigint, speaker string, text string"
INTENT = "segment_id bigint, speaker string, intent string, confidence double"
ENTITY = "segment_id bigint, entity_type string, value string, raw_text string, confidence double"
CHECK = "check_name string, passed boolean, segment_id bigint, severity string, regulation string, evidence string"
FRAUD = "signal_type string, segment_id bigint, confidence double"
HEADER = ("audio_file string, duration_seconds double, language string, detected_language string, call_type string, audio_quality_score bigint, "
          "num_speakers bigint, agent_talk_percentage double, customer_talk_percentage double, compliance_score bigint, overall_risk_level string, "
          "requires_human_review boolean, review_priority bigint, customer_emotion_dominant string, tamper_risk string, pii_count bigint, call_summary string, "
          "has_code_switching boolean, snr_db double, overall_transcript_confidence double, num_toxicity_flags bigint, escalation_detected boolean")
RECORD_DDL = (
    f"call_id bigint, part bigint, {HEADER}, transcript_segments array<struct<{SEGMENT}>>, intents array<struct<{INTENT}>>, "
    f"financial_entities array<struct<{ENTITY}>>, compliance_checks array<struct<{CHECK}>>, fraud_signals array<struct<{FRAUD}>>, obligations array<struct<{OBLIGATION}>>")


@lru_cache(maxsize=1)
def record_schema() -> T.StructType:
    """Schema of a record part (the DDL parser needs a running session)."""
    return T.StructType.fromDDL(RECORD_DDL)


def _children(df: DataFrame, fields: list[str], name: str, size: int, order: list[str]) -> DataFrame:
    part = F.floor(F.coalesce("segment_id", F.lit(0).cast("bigint")) / size)
    s = F.struct(*fields)
    return df.groupBy("call_id", part.alias("part")).agg(F.sort_array(F.collect_list(F.struct(*[F.col(o).alias(f"o{i}") for i, o in enumerate(order)], s.alias("s")))).alias("l")).select(
        "call_id", "part", F.transform("l", lambda x: x["s"]).alias(name))


def build(seg: DataFrame, header: DataFrame, intents: DataFrame, entities: DataFrame, checks: DataFrame, fraud: DataFrame, size: int = 65_536, obligations: DataFrame | None = None) -> DataFrame:
    """One row per call and part with all children nested; header columns repeat on every part."""
    t = _children(seg.withColumn("id", F.col("segment_id")), ["id", "start_ds", "end_ds", "speaker", "text"], "transcript_segments", size, ["segment_id"])
    kids = [_children(intents, ["segment_id", "speaker", "intent", "confidence"], "intents", size, ["segment_id"]),
            _children(entities, ["segment_id", "entity_type", "value", "raw_text", "confidence"], "financial_entities", size, ["segment_id", "item"]),
            _children(checks, ["check_name", "passed", "segment_id", "severity", "regulation", "evidence"], "compliance_checks", size, ["check_name", "evidence"]),
            _children(fraud, ["signal_type", "segment_id", "confidence"], "fraud_signals", size, ["signal_type"])]
    if obligations is not None:
        kids.append(_children(obligations, ["segment_id", "speaker", "text", "obligation_type", "strength", "amount", "date_referenced", "start_ds", "legally_significant"], "obligations", size, ["segment_id", "item"]))
    # the header meets the list of parts first, so that no join runs on the call alone
    heads = seg.select("call_id", F.floor(F.col("segment_id") / size).alias("part")).distinct().join(header, "call_id")
    out = heads.join(t, ["call_id", "part"])
    for k in kids:
        out = out.join(k, ["call_id", "part"], "left")
    empty = {f.name: f.dataType for f in record_schema().fields if isinstance(f.dataType, T.ArrayType)}
    out = out.withColumns({n: F.coalesce(n, F.array().cast(d)) if n in out.columns else F.array().cast(d) for n, d in empty.items()})
    out = out.withColumns({f.name: F.lit(None).cast(f.dataType) for f in record_schema().fields if f.name not in out.columns})
    return out.select(*[F.col(f.name).cast(f.dataType) for f in record_schema().fields])


def write(records: DataFrame, path: str, fmt: str = "json") -> str:
    """One file set per call type; the file names end in the usual suffix of the writer."""
    w = records.withColumn("type", F.col("call_type")).write.mode("overwrite").partitionBy("type")
    (w.json if fmt == "json" else w.parquet)(path)
    return path


def scan(spark: SparkSession, path: str, glob: str | None = None, multi_line: bool = False) -> tuple[DataFrame, DataFrame]:
    """Records with a fixed schema, and the unreadable ones apart."""
    r = spark.read.schema(T.StructType([*record_schema().fields, T.StructField("_bad", T.StringType())])).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_bad")
    if glob:
        r = r.option("pathGlobFilter", glob)
    raw = r.option("recursiveFileLookup", "true").option("multiLine", multi_line).json(path)
    # the corrupt column may not be queried alone, so rows are told apart by the key as well
    return raw.where(F.col("_bad").isNull() & F.col("call_id").isNotNull()).drop("_bad"), raw.where(F.col("_bad").isNotNull() | F.col("call_id").isNull())


COUNTS = ["num_segments", "num_intents", "num_entities", "num_obligations", "num_binding_obligations", "num_compliance_checks", "num_compliance_violations", "num_critical_violations", "num_fraud_signals", "num_promises"]


def shown(row: DataFrame) -> dict[str, Column]:
    """Flat columns of a record's header fields."""
    return {"audio_file": F.element_at(F.split("audio_file", "/"), -1), "duration_sec": F.col("duration_seconds"), "language": F.coalesce("detected_language", "language"),
            "has_code_switching": F.coalesce("has_code_switching", F.lit(False)), "call_type": F.col("call_type"), "audio_quality_score": F.col("audio_quality_score"),
            "audio_quality_flag": F.when(F.col("audio_quality_score") >= 70, "TRUSTWORTHY").when(F.col("audio_quality_score") >= 40, "DEGRADED").otherwise("UNRELIABLE"),
            "snr_db": F.col("snr_db"), "transcript_confidence": F.col("overall_transcript_confidence"),
            "num_speakers": F.col("num_speakers"), "agent_talk_pct": F.col("agent_talk_percentage"), "customer_talk_pct": F.col("customer_talk_percentage"),
            "pii_count": F.coalesce("pii_count", F.lit(0).cast("bigint")), "num_toxicity_flags": F.coalesce("num_toxicity_flags", F.lit(0).cast("bigint")),
            "tamper_risk": F.coalesce("tamper_risk", F.lit("none")), "compliance_score": F.col("compliance_score"),
            "risk_level": F.coalesce("overall_risk_level", F.lit("low")), "customer_emotion": F.col("customer_emotion_dominant"), "escalation_detected": F.col("escalation_detected"),
            "requires_review": F.col("requires_human_review"), "review_priority": F.col("review_priority"), "call_summary": F.substring(F.coalesce("call_summary", F.lit("")), 1, 200)}


def flat_row(calls: DataFrame) -> DataFrame:
    """One flat row per call from header fields and counts: nothing is nested for it."""
    return calls.select("call_id", *[v.alias(k) for k, v in shown(calls).items()], *COUNTS)


def flatten(records: DataFrame) -> DataFrame:
    """One flat row per call of nested records: header fields, numbers of children, short summary."""
    def n(c: str, cond=None) -> Column:
        return F.size(c) if cond is None else F.size(F.filter(c, cond))
    sizes = {"num_segments": n("transcript_segments"), "num_intents": n("intents"), "num_entities": n("financial_entities"), "num_obligations": n("obligations"),
             "num_binding_obligations": n("obligations", lambda o: o["strength"] == "binding"),
             "num_compliance_checks": n("compliance_checks"), "num_compliance_violations": n("compliance_checks", lambda c: ~c["passed"]),
             "num_critical_violations": n("compliance_checks", lambda c: ~c["passed"] & (c["severity"] == "critical")), "num_fraud_signals": n("fraud_signals"),
             "num_promises": n("intents", lambda i: i["intent"] == "payment_promise")}
    part = records.withColumns({k: F.greatest(v, F.lit(0)).cast("bigint") for k, v in sizes.items()})  # a list that is not there has size -1
    return part.groupBy("call_id").agg(*[F.min_by(v, "part").alias(k) for k, v in shown(part).items()], *[F.sum(k).alias(k) for k in sizes])


def children(records: DataFrame, name: str, alias_map: dict[str, str] | None = None) -> DataFrame:
    """One row per child of the record."""
    return records.select("call_id", F.explode(name).alias("c")).select("call_id", "c.*")
