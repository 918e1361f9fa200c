"""Transition machine: silence ends a speaker's state, whatever the batches."""
from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from parleo.streaming import jobs

H = 3_600_000_000


def test_idle_runs_do_not_depend_on_batches():
    rows = [(1, "neutral", 5000, 0), (2, "angry", 9000, H), (3, "angry", 5000, 2 * H), (4, "happy", 9000, 3 * H),
            (5, "sad", 9000, 9 * H), (6, "happy", 9000, 10 * H)]  # six hours of silence before 5; the second run has two rows
    want = [("neutral", "angry", 2, 1), ("angry", "happy", 4, 2)]
    assert jobs.idle_runs(iter(rows), None, None, 2 * H)[0] == want
    for cut in range(1, len(rows)):
        a, state, last = jobs.idle_runs(iter(rows[:cut]), None, None, 2 * H)
        b, state, _ = jobs.idle_runs(iter(rows[cut:]), state, last, 2 * H)
        assert a + b == want and jobs.settled_at_end(state) == []


def test_last_row_counts_by_its_score():
    assert jobs.settled_at_end(("neutral", 1, 3, "angry", 7000, 3)) == [("neutral", "angry", 3, 1)]
    assert jobs.settled_at_end(("neutral", 1, 3, "angry", 6999, 3)) == []
    assert jobs.settled_at_end(("neutral", 1, 2, "angry", 9000, 2)) == []  # two rows are too few
    assert jobs.settled_at_end(("neutral", 1, None, None, None, 3)) == []


def test_silent_speaker_ends(spark, tmp_path):
    """One file a batch: the agent falls silent, the customer goes on; the agent's last row is settled by the timer."""
    def at(minute):
        return dt.datetime(2024, 1, 1, 10, tzinfo=dt.timezone.utc) + dt.timedelta(minutes=minute)
    ddl = "call_id bigint, speaker string, segment_id bigint, t_ms bigint, ts timestamp, emotion string, score_bp bigint"
    batches = [[("agent", 1, "neutral", 0), ("agent", 2, "neutral", 1), ("agent", 3, "angry", 2), ("customer", 4, "happy", 3)],
               [("customer", 5, "happy", 100)], [("customer", 6, "sad", 101), ("agent", 7, "happy", 110)]]
    for n, b in enumerate(batches):
        rows = [(1, sp, i, m * 60_000, at(m), e, 9000) for sp, i, e, m in b]
        spark.createDataFrame(rows, ddl).coalesce(1).write.mode("append").parquet(str(tmp_path / "in" / f"n={n}"))
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key)
    spark.conf.set(key, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        s = spark.readStream.schema(ddl).option("maxFilesPerTrigger", 1).parquet(*[str(tmp_path / "in" / "*")]).select(*[c.split()[0] for c in ddl.split(", ")])
        jobs.run_available(jobs.emotion_transitions(s, "1 minute", 30 * 60_000), str(tmp_path / "out"), str(tmp_path / "ck"))
    finally:
        spark.conf.set(key, before)
    got = [tuple(r) for r in spark.read.parquet(str(tmp_path / "out")).orderBy(F.col("at_segment")).collect()]
    assert got == [(1, "agent", "neutral", "angry", 3, 1)]
