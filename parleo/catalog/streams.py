"""Streaming queries run to the end of their input; results are read back from their sinks."""
from __future__ import annotations

from pyspark.sql import functions as F

from parleo.catalog.base import *  # noqa: F403
from parleo.catalog.dashboard import ACTION, STAGE
from parleo.catalog.records import RECS, call_records
from parleo.operators import records
from parleo.plans.stage import settle
from parleo.sources import tables
from parleo.sources.sinks import work_path
from parleo.streaming import jobs

MAXTS = "(SELECT max(ts) FROM events)"


def _run(spark, df, name):
    path, ck = work_path(spark, name), work_path(spark, name + "-ck")
    jobs.run_available(df, path, ck)
    return spark.read.parquet(path)


@query("T1_record_ingest", f"WITH {SEG}, {RECS} SELECT 'intents' AS child, call_id, num_intents AS n FROM flat WHERE num_intents > 0 UNION ALL SELECT 'checks', call_id, num_compliance_checks FROM flat WHERE num_compliance_checks > 0")
def t1(spark, sf):
    src, out, ck = (work_path(spark, n) for n in ("t1-src", "t1-out", "t1-ck"))
    rec = settle(call_records(spark, sf))
    rec.where("call_id % 2 = 0").write.mode("append").json(src)
    rec.where("call_id % 2 = 1").write.mode("append").json(src)
    rec.where("call_id % 3 = 0").write.mode("append").json(src)  # offered again, in files of their own
    stream = spark.readStream.schema(records.record_schema()).option("maxFilesPerTrigger", 4).json(src)
    jobs.ingest_records(stream, {"intents": "intents", "compliance_checks": "checks"}, out, ck).awaitTermination()
    parts = [spark.read.option("basePath", f"{out}/{t}").parquet(f"{out}/{t}").groupBy("call_id").agg(F.count(F.lit(1)).alias("n")).select(F.lit(t).alias("child"), "call_id", "n") for t in ("intents", "checks")]
    return parts[0].unionByName(parts[1])


@query("T2_current_progress", f"SELECT user_id AS call_id, arg_max({STAGE}, struct_pack(ts := ts, e := event_id)) AS stage, count(*) AS n FROM events GROUP BY 1")
def t2(spark, sf):
    out, ck = work_path(spark, "t2"), work_path(spark, "t2-ck")
    jobs.upsert_batches(jobs.current_progress(jobs.event_stream(spark, sf)), out, ck, "call_id", ["ts", "event_id"]).awaitTermination()
    return jobs.latest(spark, out, "call_id", ["ts", "event_id"]).select("call_id", "stage", "n")


@query("T3_live_stats", f"SELECT time_bucket(INTERVAL 1 HOUR, ts) AS w_start, count(*) AS n, CAST(sum(floor(value * 100 + 0.5)) AS BIGINT) AS v_sum, count(*) FILTER (WHERE event_type = 'error') AS n_errors FROM events GROUP BY 1 HAVING time_bucket(INTERVAL 1 HOUR, any_value(ts)) + INTERVAL 1 HOUR <= {MAXTS} - INTERVAL 10 MINUTE")
def t3(spark, sf):
    return _run(spark, jobs.live_stats(jobs.event_stream(spark, sf)), "t3")


@query("T4_sliding_floor", f"""WITH w AS (SELECT *, unnest(generate_series(time_bucket(INTERVAL 2 HOUR, ts) - INTERVAL 4 HOUR, time_bucket(INTERVAL 2 HOUR, ts), INTERVAL 2 HOUR)) AS w_start FROM events)
SELECT w_start, CAST(min(floor(value * 100 + 0.5)) AS BIGINT) AS floor_v, count(*) AS n FROM w WHERE ts < w_start + INTERVAL 5 HOUR GROUP BY 1 HAVING w_start + INTERVAL 5 HOUR <= {MAXTS} - INTERVAL 10 MINUTE""")
def t4(spark, sf):
    return _run(spark, jobs.sliding_floor(jobs.event_stream(spark, sf)), "t4")


@query("T5_activity_sessions", f"""WITH o AS (SELECT user_id AS call_id, ts, CASE WHEN ts >= lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) + INTERVAL 30 MINUTE OR lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) IS NULL THEN 1 ELSE 0 END AS c FROM events), g AS (SELECT *, sum(c) OVER (PARTITION BY call_id ORDER BY ts) AS s FROM o)
SELECT call_id, min(ts) AS s_start, max(ts) + INTERVAL 30 MINUTE AS s_end, count(*) AS n FROM g GROUP BY call_id, s HAVING max(ts) + INTERVAL 30 MINUTE <= {MAXTS} - INTERVAL 30 MINUTE""")
def t5(spark, sf):
    return _run(spark, jobs.activity_sessions(jobs.event_stream(spark, sf)), "t5")


@query("T6_review_upsert", f"SELECT user_id AS call_id, arg_max({ACTION}, struct_pack(ts := ts, e := event_id)) AS action FROM events GROUP BY 1")
def t6(spark, sf):
    e = jobs.event_stream(spark, sf)
    a = F.when(F.col("event_type") == "view", "approve").when(F.col("event_type") == "error", "escalate").otherwise("reject")
    out, ck = work_path(spark, "t6"), work_path(spark, "t6-ck")
    jobs.upsert_batches(e.select("call_id", a.alias("action"), "ts", "event_id"), out, ck, "call_id", ["ts", "event_id"]).awaitTermination()
    return jobs.latest(spark, out, "call_id", ["ts", "event_id"]).select("call_id", "action")


@query("T7_escalation_alerts", f"SELECT DISTINCT user_id AS call_id, date_trunc('hour', ts) AS hour FROM events WHERE event_type IN ('error', 'signup') AND value > 60")
def t7(spark, sf):
    return _run(spark, jobs.escalation_alerts(jobs.event_stream(spark, sf)), "t7")


IDLE_H = 48  # hours of silence that end a speaker's state
T8 = ORACLES["W6_emotion_transitions"].split(", cf AS")[0]


@query("T8_transition_machine", f"""{T8}, ex AS (SELECT ee.*, e.ts FROM ee JOIN events e USING (event_id) WHERE score_bp >= 4000),
gp AS (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY call_id, speaker ORDER BY t_ms, event_id) > INTERVAL {IDLE_H} HOUR THEN 1 ELSE 0 END AS brk FROM ex),
rn AS (SELECT *, sum(brk) OVER (PARTITION BY call_id, speaker ORDER BY t_ms, event_id) AS run FROM gp),
cf AS (SELECT *, row_number() OVER w AS rn, lead(emotion) OVER w AS nxt, count(*) OVER r AS n, last_value(ts) OVER (PARTITION BY call_id, speaker, run ORDER BY t_ms, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS run_end,
 max(run) OVER (PARTITION BY call_id, speaker) AS last_run FROM rn WINDOW w AS (PARTITION BY call_id, speaker, run ORDER BY t_ms, event_id), r AS (PARTITION BY call_id, speaker, run)),
q0 AS (SELECT * FROM cf WHERE n >= 3 AND (rn = 1 OR nxt = emotion OR score_bp >= 7000) AND (rn < n OR run < last_run OR run_end + INTERVAL {IDLE_H} HOUR <= (SELECT max(ts) FROM events) - INTERVAL 10 MINUTE)),
q1 AS (SELECT *, lag(emotion) OVER (PARTITION BY call_id, speaker, run ORDER BY rn) AS st FROM q0),
q2 AS (SELECT *, lag(event_id) OVER (PARTITION BY call_id, speaker, run ORDER BY rn) AS fr_at FROM q1 WHERE rn = 1 OR st <> emotion)
SELECT call_id, speaker, st AS from_emotion, emotion AS to_emotion, event_id AS at_segment, fr_at AS from_segment FROM q2 WHERE rn > 1""")
def t8(spark, sf):
    """Two days of silence end a speaker's state; only last rows within it of the watermark are pending."""
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key)
    spark.conf.set(key, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    e = jobs.event_stream(spark, sf)
    secs = F.unix_micros("ts") - F.unix_micros(F.lit(tables.EPOCH).cast("timestamp"))
    x = e.select("call_id", F.when(F.col("event_id") % 2 == 0, "agent").otherwise("customer").alias("speaker"), F.col("event_id").alias("segment_id"), F.floor(secs / 36_000_000).alias("t_ms"), "ts",
                 tables._map("event_type", tables.EVENT_EMOTION).alias("emotion"), F.least(F.floor(F.col("value") * 100 + 0.5), F.lit(10000)).alias("score_bp"))
    try:
        return _run(spark, jobs.emotion_transitions(x, idle_ms=IDLE_H * 3_600_000), "t8")
    finally:
        spark.conf.set(key, before)
