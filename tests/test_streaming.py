import datetime as dt
import random

import pytest
from conftest import rows
from pyspark.sql import functions as F

from blockledger.operators.anchored import coalesce_requests
from blockledger.operators.ranking import assign_batches
from blockledger.operators.admission import RestorePolls
from blockledger.plans.jobs import restore_run
from blockledger.schema import FINALIZED, KEY
from blockledger.streaming.requests import closed_polls, stream_backup_requests, take_polls
from blockledger.streaming.sinks import due_batches, run_gc_pages, with_retries

START = dt.datetime(2024, 1, 1)


def write_batches(spark, folder, batches):
    for i, batch in enumerate(batches):
        frame = spark.createDataFrame([("p", b, n, 1, START + dt.timedelta(seconds=s)) for b, n, s in batch], FINALIZED)
        frame.coalesce(1).write.mode("append").parquet(f"{folder}/{i}")


def test_stream_equals_batch_however_it_is_cut(spark, tmp_path):
    """Out of order inside the allowed delay, windows across micro-batches, several windows in one of them."""
    batches = [
        [(1, 5, 3), (1, 9, 0), (2, 1, 1), (1, 2, 14)],
        [(1, 7, 4), (2, 3, 6), (2, 4, 7), (1, 1, 9)],
        [(1, 8, 40), (2, 2, 41)],
        [(9, 1, 100)],
        [(9, 1, 200)],
    ]
    write_batches(spark, tmp_path / "in", batches)
    stream = spark.readStream.schema(FINALIZED).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(
        str(tmp_path / "in")
    )
    query = (
        stream_backup_requests(stream, "5 seconds", delay="20 seconds")
        .writeStream.format("parquet")
        .option("path", str(tmp_path / "out"))
        .option("checkpointLocation", str(tmp_path / "state"))
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    got = spark.read.parquet(str(tmp_path / "out"))
    files = spark.read.schema(FINALIZED).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))
    closed = F.col("due_ts") < F.lit(START + dt.timedelta(seconds=180))
    assert rows(got) == rows(coalesce_requests(files, "5 seconds").filter(closed))


def test_retries_until_given_up(spark, blocks, tmp_path):
    handle = with_retries(
        lambda df: df.withColumn("ok", (F.col("block_id") != 2) & ((F.col("block_id") != 1) | (F.col("attempt") == 1))),
        str(tmp_path / "s"),
        lambda i: START + dt.timedelta(minutes=2 * i),
        max_attempts=3,
    )
    first = blocks([("p", 0, 1, 1), ("p", 1, 1, 1), ("p", 2, 1, 1)])
    for i in range(4):
        handle(first if i == 0 else first.limit(0), i)
    handle(first.limit(0), 3)  # a repeated micro-batch replaces what it wrote
    got = spark.read.parquet(str(tmp_path / "s")).select("block_id", "batch_id", "state", "attempt")
    assert rows(got) == [
        (0, 0, "done", 0),
        (1, 0, "retry", 1),
        (1, 1, "done", 1),
        (2, 0, "retry", 1),
        (2, 1, "retry", 2),
        (2, 2, "given_up", 3),
    ]


def test_failed_page_does_not_stop_the_run(blocks):
    pages = assign_batches(blocks([("p", i, 1, 1) for i in range(100)]), 10, by=["pool_id"]).withColumnRenamed("batch_no", "page")
    bad = {r["block_id"] for r in pages.filter("page = 3").collect()}

    def fn(batch):
        if bad & set(batch["block_id"]):
            raise OSError("listing failed")

    got = run_gc_pages(fn, pages)
    assert {r["block_id"] for r in got.filter("not ok").collect()} == bad
    again = run_gc_pages(lambda batch: None, pages, done=got)
    assert {r["block_id"] for r in again.filter("ok").collect()} == bad


@pytest.mark.parametrize("per_batch", [1, 3])
def test_polled_stream_equals_the_batch_job(spark, tmp_path, per_batch):
    """However the sightings are cut into micro-batches: same requests, nodes and answers as one batch run."""
    draw = random.Random(2)
    batches = [[(draw.randint(1, 12), 1, 60 * i + draw.randint(0, 90)) for _ in range(15)] for i in range(3)] + [[(99, 1, 9_000)]]
    write_batches(spark, tmp_path / "in", batches)
    files = spark.read.schema(FINALIZED).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(FINALIZED).option("maxFilesPerTrigger", per_batch).option("recursiveFileLookup", "true").parquet(
        str(tmp_path / "in")
    )
    store = files.select(*KEY).distinct()
    nodes = spark.createDataFrame([("n1",), ("n2",)], "node string")
    rules = dict(poll="40 seconds", ttl="2 minutes", busy="50 seconds", capacity=2)
    polls = RestorePolls.over(nodes, str(tmp_path / "polls"), **rules)
    handle = take_polls(polls)
    query = (
        closed_polls(stream, store, delay="2 minutes", poll="40 seconds")
        .writeStream.foreachBatch(lambda batch, n: [handle(batch, n) for _ in range(per_batch)])  # also repeated
        .option("checkpointLocation", str(tmp_path / "state"))
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    once = restore_run(files.filter("block_id <> 99"), store, store.limit(0), nodes, **rules).requests
    assert rows(polls.requests()) == rows(once)
    assert {r["accepted"] for r in once.collect()} == {True, False}


def test_late_events_come_out_on_their_own(spark, tmp_path):
    """An event behind the watermark changes no window and is told of; kept and late together are all."""
    batches = [
        [(1, 5, 3), (1, 9, 0), (2, 1, 1)],
        [(1, 7, 4), (2, 3, 60), (3, 1, 61)],
        [(1, 8, 2), (2, 2, 35), (2, 4, 62), (4, 1, 30), (4, 2, 30)],  # the watermark is at 41
        [(9, 1, 200)],
    ]
    write_batches(spark, tmp_path / "in", batches)
    stream = spark.readStream.schema(FINALIZED).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(
        str(tmp_path / "in")
    )
    query = (
        stream_backup_requests(stream, "5 seconds", delay="20 seconds", late=True)
        .writeStream.format("parquet")
        .option("path", str(tmp_path / "out"))
        .option("checkpointLocation", str(tmp_path / "state"))
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    got = spark.read.parquet(str(tmp_path / "out"))
    seconds = lambda ts: int((ts - START).total_seconds())
    late = sorted((r["block_id"], r["length"], seconds(r["opened_ts"]), r["n_events"]) for r in got.filter("late").collect())
    assert late == [(1, 8, 2, 1), (2, 2, 35, 1), (4, 2, 30, 2)]
    kept = sorted((r["block_id"], r["length"], seconds(r["opened_ts"]), r["n_events"]) for r in got.filter("not late").collect())
    assert kept == [(1, 9, 0, 3), (2, 1, 1, 1), (2, 4, 60, 2), (3, 1, 61, 1)]


def test_a_retry_is_due_in_one_batch():
    """Against a look at every earlier batch, with batches closer than the delay, further apart, and at one time."""
    draw = random.Random(5)
    for wait in [0, 120] * 100:
        times = [START]
        for _ in range(30):
            times.append(times[-1] + dt.timedelta(seconds=draw.choice([0, 10, 60, 119, 120, 121, 900])))
        due = [next((n for n in range(b + 1, 31) if times[n] >= times[b] + dt.timedelta(seconds=wait)), None) for b in range(31)]
        for n in range(31):
            assert sorted(due_batches(n, times.__getitem__, f"{wait} seconds")) == [b for b in range(n) if due[b] == n]


def test_retries_open_only_the_folders_that_are_due(spark, blocks, tmp_path):
    """A batch whose retries were due long ago is not opened again: its folder may be anything by then."""
    handle = with_retries(
        lambda df: df.withColumn("ok", F.col("attempt") == 1), str(tmp_path / "s"), lambda i: START + dt.timedelta(minutes=2 * i)
    )
    first = blocks([("p", 0, 1, 1)])
    handle(first, 0)
    handle(first.limit(0), 1)
    for name in (tmp_path / "s" / "batch_id=0").glob("*.parquet"):
        name.write_bytes(b"not parquet")
    handle(first.limit(0), 2)
    got = spark.read.parquet(str(tmp_path / "s" / "batch_id=1"), str(tmp_path / "s" / "batch_id=2"))
    assert rows(got.select("block_id", "state", "attempt")) == [(0, "done", 1)]


def test_polls_do_not_move_the_store_in_each_micro_batch(spark, tmp_path):
    """The store is made distinct once; what a micro-batch brings together by key is its sightings. Rows are as before."""
    key = ("p", 1, 1), ("p", 2, 1), ("p", 3, 1), (None, 4, 1)
    seen = [(*k, 1, START + dt.timedelta(seconds=s), f) for k in key for s, f in ((1, False), (9, None), (61, True))]
    seen += [("p", 9, 1, 1, START + dt.timedelta(seconds=s), f) for s, f in ((2, False), (3, True), (70, None))]
    seen += [("p", 1, 1, 1, START + dt.timedelta(seconds=9_000), False)]
    schema = "pool_id string, block_id bigint, length bigint, gen_stamp bigint, ts timestamp, force boolean"
    spark.createDataFrame(seen, schema).coalesce(1).write.parquet(str(tmp_path / "in"))
    stored = [(*key[0], 1)] * 3 + [(*key[2], 1), (*key[3], 1), ("p", 77, 1, 1)]
    store = spark.createDataFrame(stored, "pool_id string, block_id bigint, length bigint, gen_stamp bigint")
    store.write.parquet(str(tmp_path / "store"))
    stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
    closed = closed_polls(stream, spark.read.parquet(str(tmp_path / "store")), delay="1 minute", poll="1 minute")
    got = []
    query = closed.writeStream.foreachBatch(lambda batch, n: got.extend(map(tuple, batch.collect())))
    query = query.option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    query.awaitTermination()
    plan = query._jsq.explainInternal(False)
    assert plan.count("Exchange hashpartitioning") == 1
    at = lambda s: START + dt.timedelta(seconds=s)
    poll = int(START.replace(tzinfo=dt.timezone.utc).timestamp()) // 60
    want = [(poll, *k, 1, at(1), False) for k in key if k[1] != 2] + [(poll, "p", 9, 1, 1, at(3), True)]
    want += [(poll + 1, *k, 1, at(61), True) for k in key]
    assert sorted(got, key=repr) == sorted(want, key=repr)
