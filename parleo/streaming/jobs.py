"""Structured Streaming jobs: ingest, progress, live statistics, sessions, upserts, alerts, transitions.

Every job takes a streaming DataFrame and returns one (or starts a query with a
sink), so the caller chooses source, trigger and checkpoint.  Rows behind the
watermark are dropped.
"""
from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from parleo.sources.tables import EVENT_EMOTION, EVENT_STAGE, _map, ts_utc

EVENT_SCHEMA = "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string"


def event_stream(spark: SparkSession, folder: str, glob: str = "events.parquet", files_per_trigger: int = 64) -> DataFrame:
    """Event files of a folder as a stream with a zoned timestamp."""
    s = spark.readStream.schema(EVENT_SCHEMA).option("pathGlobFilter", glob).option("maxFilesPerTrigger", files_per_trigger).parquet(folder)
    return s.withColumn("ts", ts_utc("ts")).withColumnRenamed("user_id", "call_id")


def run_available(df: DataFrame, path: str, checkpoint: str, mode: str = "append") -> None:
    """Process everything that is there into parquet files and stop."""
    q = df.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination()


BUCKETS = 16


def bucket_of(key: Column, buckets: int = BUCKETS) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")


def folders(spark: SparkSession, path: str, name: str) -> dict[int, str]:
    """Number -> folder of the committed ``name=<number>`` folders (a writer leaves ``_SUCCESS`` last)."""
    hadoop = spark._jvm.org.apache.hadoop.fs
    at = hadoop.Path(path)
    fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(at):
        return {}
    found = [f.getPath() for f in fs.listStatus(at) if f.getPath().getName().startswith(f"{name}=")]
    return {int(f.getName().split("=")[1]): f.toString() for f in found if fs.exists(hadoop.Path(f, "_SUCCESS"))}


def drop_folders(spark: SparkSession, paths: list[str]) -> None:
    for p in paths:
        at = spark._jvm.org.apache.hadoop.fs.Path(p)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def ingest_records(stream: DataFrame, children: dict[str, str], folder: str, checkpoint: str) -> StreamingQuery:
    """New records into one table per child.

    A record part counts once: keys of earlier batches stand in a manifest by
    bucket, and what is listed there is left out, also when a file is offered
    again.  A batch looks at the manifests before its own only, and writes its
    manifest last, so a batch that is repeated writes the same files again.
    """
    def write(batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        batch = batch.dropDuplicates(["call_id", "part"]).withColumn("bucket", bucket_of(F.col("call_id")))
        before = [p for n, p in folders(spark, f"{folder}/_manifest", "batch").items() if n < epoch]
        if before:
            known = spark.read.option("basePath", f"{folder}/_manifest").parquet(*before).select("bucket", "call_id", "part")
            batch = batch.join(known, ["bucket", "call_id", "part"], "left_anti")
        batch = batch.persist()
        try:
            for name, table in children.items():
                batch.select("call_id", F.explode(name).alias("c")).select("call_id", "c.*").write.mode("overwrite").parquet(f"{folder}/{table}/batch={epoch}")
            batch.select("bucket", "call_id", "part").write.mode("overwrite").partitionBy("bucket").parquet(f"{folder}/_manifest/batch={epoch}")
        finally:
            batch.unpersist()
    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def current_progress(events: DataFrame, delay: str = "1 hour") -> DataFrame:
    """Latest stage per call; one state row per call, for update mode."""
    return events.withWatermark("ts", delay).groupBy("call_id").agg(
        F.max_by(F.struct(_map("event_type", EVENT_STAGE).alias("stage"), "ts", "event_id"), F.struct("ts", "event_id")).alias("p"), F.count(F.lit(1)).alias("n")).select(
        "call_id", "p.stage", "p.ts", "p.event_id", "n")


COMPACT_EVERY = 10


def upsert_batches(updates: DataFrame, folder: str, checkpoint: str, key: str, order: list[str], compact_every: int = COMPACT_EVERY, buckets: int = BUCKETS) -> StreamingQuery:
    """Keep the latest row per key as a base and deltas, both by bucket of the key.

    Each batch writes its changes as a delta under its number; every
    ``compact_every`` batches base and deltas become a new base, which counts from
    the moment its ``_SUCCESS`` is there.  Files that only superseded bases need are
    removed one compaction later, so a reader that began before it still finds them.
    """
    def write(batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        _newest(batch, key, order).withColumn("bucket", bucket_of(F.col(key), buckets)).write.mode("overwrite").partitionBy("bucket").parquet(f"{folder}/delta/batch={epoch}")
        if (epoch + 1) % compact_every:
            return
        bases = folders(spark, f"{folder}/base", "version")
        merged = latest(spark, folder, key, order).withColumn("bucket", bucket_of(F.col(key), buckets))
        merged.repartition(buckets, "bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{folder}/base/version={epoch}")
        last = max((v for v in bases if v < epoch), default=-1)  # the base before this one stays with the deltas after it
        old = [p for v, p in bases.items() if v < last] + [p for n, p in folders(spark, f"{folder}/delta", "batch").items() if n <= last]
        drop_folders(spark, old)
    return updates.writeStream.foreachBatch(write).outputMode("update").option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def _newest(rows: DataFrame, key: str, order: list[str]) -> DataFrame:
    cols = [c for c in rows.columns if c != key]
    return rows.groupBy(key).agg(F.max_by(F.struct(*cols), F.struct(*order)).alias("s")).select(key, "s.*")


def latest(spark: SparkSession, folder: str, key: str, order: list[str], only: object = None, buckets: int = BUCKETS) -> DataFrame:
    """Current table behind ``upsert_batches``; with ``only`` the row of one key, from one bucket."""
    bases, deltas = folders(spark, f"{folder}/base", "version"), folders(spark, f"{folder}/delta", "batch")
    base = max(bases, default=-1)
    fresh = [p for n, p in sorted(deltas.items()) if n > base]
    parts = [spark.read.option("basePath", f"{folder}/{at}").parquet(*paths).drop(number) for at, number, paths in (("base", "version", [bases[base]] if bases else []), ("delta", "batch", fresh)) if paths]
    d = reduce(DataFrame.unionByName, parts)
    if only is not None:
        one = F.lit(only).cast(d.schema[key].dataType)
        d = d.where((F.col("bucket") == bucket_of(one, buckets)) & (F.col(key) == one))
    return _newest(d.drop("bucket"), key, order)


def live_stats(events: DataFrame, delay: str = "10 minutes", size: str = "1 hour") -> DataFrame:
    v = F.floor(F.col("value") * 100 + 0.5)
    return events.withWatermark("ts", delay).groupBy(F.window("ts", size)).agg(
        F.count(F.lit(1)).alias("n"), F.sum(v).alias("v_sum"), F.count_if(F.col("event_type") == "error").alias("n_errors")).select(F.col("window.start").alias("w_start"), "n", "v_sum", "n_errors")


def sliding_floor(events: DataFrame, delay: str = "10 minutes", size: str = "5 hours", hop: str = "2 hours") -> DataFrame:
    v = F.floor(F.col("value") * 100 + 0.5)
    return events.withWatermark("ts", delay).groupBy(F.window("ts", size, hop)).agg(F.min(v).alias("floor_v"), F.count(F.lit(1)).alias("n")).select(F.col("window.start").alias("w_start"), "floor_v", "n")


def activity_sessions(events: DataFrame, gap: str = "30 minutes") -> DataFrame:
    """Sessions per call; rows of a busy call are merged inside each task before they meet its state."""
    events.sparkSession.conf.set("spark.sql.streaming.sessionWindow.merge.sessions.in.local.partition", "true")
    return events.withWatermark("ts", gap).groupBy("call_id", F.session_window("ts", gap).alias("s")).agg(F.count(F.lit(1)).alias("n")).select(
        "call_id", F.col("s.start").alias("s_start"), F.col("s.end").alias("s_end"), "n")


def escalation_alerts(events: DataFrame, delay: str = "10 minutes") -> DataFrame:
    """Angry or fearful moments above 0.6, one per call and hour."""
    emotion = _map("event_type", EVENT_EMOTION)
    hot = events.withColumn("emotion", emotion).where(F.col("emotion").isin("angry", "fearful") & (F.col("value") > 60))
    return hot.withColumn("hour", F.date_trunc("hour", "ts")).withWatermark("ts", delay).dropDuplicatesWithinWatermark(["call_id", "hour"]).select("call_id", "hour")


def transition_rows(rows: Iterator[tuple], state: tuple | None) -> tuple[list[tuple], tuple | None]:
    """Fold ordered confident rows (segment, emotion, score_bp) of one speaker.

    State is (accepted emotion, its segment, pending segment, emotion, score,
    rows seen): a row is settled only when the next one is known, since it
    counts if its emotion holds or its score is at least 0.7.
    """
    acc, acc_seg, p_seg, p_emo, p_score, seen = state or (None, None, None, None, None, 0)
    out = []
    for seg, emo, score in rows:
        if p_emo is not None and p_emo != acc and (emo == p_emo or p_score >= 7000):
            out.append((acc, p_emo, p_seg, acc_seg))
            acc, acc_seg = p_emo, p_seg
        if acc is None:
            acc, acc_seg = emo, seg
            p_seg = p_emo = p_score = None
        else:
            p_seg, p_emo, p_score = seg, emo, score
        seen += 1
    return out, (acc, acc_seg, p_seg, p_emo, p_score, seen)


def settled_at_end(state: tuple) -> list[tuple]:
    """The pending last row when nothing follows any more: it counts by its score alone, and only for a speaker with three rows."""
    acc, acc_seg, p_seg, p_emo, p_score, seen = state
    return [(acc, p_emo, p_seg, acc_seg)] if seen >= 3 and p_emo is not None and p_emo != acc and p_score >= 7000 else []


def idle_runs(rows: Iterator[tuple], state: tuple | None, last: int | None, idle_us: int) -> tuple[list[tuple], tuple | None, int | None]:
    """``transition_rows`` over ordered rows (segment, emotion, score_bp, microseconds); more than ``idle_us`` of silence ends a run and the next row starts afresh."""
    out: list[tuple] = []
    run: list[tuple] = []

    def close_run(state):
        found, state = transition_rows(run, state)
        out.extend(found)
        run.clear()
        return state
    for seg, emo, score, at in rows:
        if last is not None and at - last > idle_us:
            state = close_run(state)
            if state:
                out.extend(settled_at_end(state))
            state = None
        run.append((seg, emo, score))
        last = at
    return out, (close_run(state) if run else state), last


TRANSITION_SCHEMA = "call_id bigint, speaker string, from_emotion string, to_emotion string, at_segment bigint, from_segment bigint"
STATE_SCHEMA = "acc string, acc_seg bigint, p_seg bigint, p_emo string, p_score bigint, seen bigint, last_us bigint"


def emotion_transitions(emotions: DataFrame, delay: str = "10 minutes", idle_ms: int = 30 * 60_000) -> DataFrame:
    """Emotion changes per call and speaker as segments (with time ``ts``) arrive in order; state is one small row per speaker.

    A row is settled by the one that follows it.  A timer in event time settles the
    last row of a speaker who has been silent for ``idle_ms`` and ends the state;
    what the speaker says after that starts afresh, however the rows fell into
    batches.  Speakers with fewer than three confident rows have no transition.  A task
    holds the rows of one speaker in one batch, which the source's rate limit bounds.
    """
    import pandas as pd
    from pyspark.sql.streaming.stateful_processor import StatefulProcessor

    names = ["call_id", "speaker", "from_emotion", "to_emotion", "at_segment", "from_segment"]

    class Machine(StatefulProcessor):
        def init(self, handle):
            self.handle = handle
            self.state = handle.getValueState("transition", STATE_SCHEMA)

        def handleInputRows(self, key, rows, timerValues):
            pdf = pd.concat(list(rows)).sort_values(["t_ms", "segment_id"])
            old = tuple(self.state.get()) if self.state.exists() else (*[None] * 6, None)
            ordered = zip(*(pdf[c].tolist() for c in ("segment_id", "emotion", "score_bp", "us")))
            out, new, last = idle_runs(ordered, old[:6] if old[5] else None, old[6], idle_ms * 1000)
            self.state.update((*new, last))
            self.handle.registerTimer(last // 1000 + idle_ms)
            yield pd.DataFrame([(key[0], key[1], *o) for o in out], columns=names)

        def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
            out = []
            if self.state.exists():
                *held, last = self.state.get()
                if last // 1000 + idle_ms <= expiredTimerInfo.getExpiryTimeInMs():  # else a later row has set another timer
                    out = settled_at_end(tuple(held))
                    self.state.clear()
            yield pd.DataFrame([(key[0], key[1], *o) for o in out], columns=names)

        def close(self):
            pass

    timed = emotions.withWatermark("ts", delay).where("score_bp >= 4000")
    conf = timed.select("call_id", "speaker", "segment_id", "t_ms", "emotion", "score_bp", "ts", F.unix_micros("ts").alias("us"))
    return conf.groupBy("call_id", "speaker").transformWithStateInPandas(
        statefulProcessor=Machine(), outputStructType=TRANSITION_SCHEMA, outputMode="Append", timeMode="EventTime")
