"""Snapshots with compaction, ingest that counts a record once, pages and lookups."""
import datetime
import os

import pytest
from pyspark.sql import functions as F

from parleo.operators import records, rollup, turns
from parleo.streaming import jobs


def test_snapshot_stays_small_and_one_key_reads_one_bucket(spark, tmp_path):
    src, out, ck = (str(tmp_path / n) for n in ("src", "out", "ck"))
    for n in range(12):
        spark.range(20).selectExpr("id AS call_id", f"'s{n}' AS stage", f"{n} AS ts").where(f"call_id % 3 = {n} % 3 OR call_id = 7").coalesce(1).write.mode("append").json(src)
    stream = spark.readStream.schema("call_id bigint, stage string, ts bigint").option("maxFilesPerTrigger", 1).json(src)
    jobs.upsert_batches(stream, out, ck, "call_id", ["ts"], compact_every=3).awaitTermination()
    want = {c: max(n for n in range(12) if c % 3 == n % 3 or c == 7) for c in range(20)}
    assert {r.call_id: r.ts for r in jobs.latest(spark, out, "call_id", ["ts"]).collect()} == want
    assert len(os.listdir(f"{out}/base")) <= 2 and len(jobs.folders(spark, f"{out}/delta", "batch")) <= 6
    one = jobs.latest(spark, out, "call_id", ["ts"], only=7)
    assert [(r.call_id, r.ts) for r in one.collect()] == [(7, 11)]
    plan = one._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(bucket" in plan


def test_records_offered_again_count_once(spark, tmp_path):
    src, out = str(tmp_path / "src"), str(tmp_path / "out")
    rec = '{"call_id": %d, "part": 0, "intents": [{"segment_id": 0, "intent": "greeting"}, {"segment_id": 1, "intent": "refusal"}]}'

    def offer(*ids):
        spark.createDataFrame([(rec % i,) for i in ids], "value string").coalesce(1).write.mode("append").text(src)
        stream = spark.readStream.schema(records.record_schema()).json(src)
        jobs.ingest_records(stream, {"intents": "intents"}, out, str(tmp_path / "ck")).awaitTermination()
        return spark.read.option("basePath", f"{out}/intents").parquet(f"{out}/intents").groupBy("call_id").count().collect()

    offer(1, 2, 2)
    assert sorted(tuple(r) for r in offer(2, 3)) == [(1, 2), (2, 2), (3, 2)]
    assert sorted(tuple(r) for r in offer(1, 2, 3)) == [(1, 2), (2, 2), (3, 2)]


def test_pages_follow_each_other(spark):
    day = datetime.datetime(2024, 1, 1)
    rows = [(i, day + datetime.timedelta(days=i // 4) if i % 7 else None) for i in range(60)]
    df = spark.createDataFrame(rows, "call_id bigint, ingested_at timestamp")
    whole = [r.call_id for r in df.orderBy(F.desc_nulls_last("ingested_at"), "call_id").collect()]
    got, after = [], None
    while part := rollup.page(df, 11, after=after).collect():
        got += [r.call_id for r in part]
        after = (part[-1].ingested_at, part[-1].call_id)
    assert got == whole
    assert [r.call_id for r in rollup.page(df, 5, offset=10).collect()] == whole[10:15]
    for bad in ({"limit": 0}, {"limit": 501}, {"offset": -1}):
        with pytest.raises(ValueError):
            rollup.page(df, **bad)


def test_lookup_takes_the_first_place(spark):
    a, b = (spark.createDataFrame([(i,) for i in ids], "call_id bigint") for ids in ([1, 2], [2, 3]))
    got = {i: [r.location for r in rollup.lookup_record(i, ("first", a), ("second", b)).collect()] for i in (1, 2, 3, 4)}
    assert got == {1: ["first"], 2: ["first"], 3: ["second"], 4: []}


def test_subsample_of_a_long_call(spark):
    seg = spark.range(200).selectExpr("1L AS call_id", "id DIV 50 AS chunk", "id AS segment_id", "CASE WHEN id DIV 40 % 2 = 0 THEN 'agent' ELSE 'customer' END AS speaker", "10L AS dur_ds")
    got = sorted(r.segment_id for r in turns.subsample(seg).collect())
    edges = {*range(5), *range(195, 200)} | {e for k in (40, 80, 120, 160) for e in (k - 1, k)}
    rest = [i for i in range(200) if i not in edges]
    step = max(1, len(rest) // (60 - len(edges)))
    assert got == sorted(edges | set(rest[::step][:60 - len(edges)]))
