"""Rows that the given tables do not hold: ties, nulls, repeats."""

import datetime as dt
import hashlib
import os

import pytest
from conftest import rows
from pyspark.sql import functions as F

from blockledger.operators.anchored import coalesce_requests
from blockledger.operators.callbacks import apply_deletes_with
from blockledger.operators.payload import backup_payload, upsert_payload
from blockledger.operators.ranking import admit
from blockledger.operators.reconcile import reconcile, restore_unknown, unnamed
from blockledger.plans.jobs import node_validate
from blockledger.operators.filters import check_pool
from blockledger.sources.reports import drop_reports, error_events, write_report
from blockledger.streaming.sinks import gc_pages, run_gc_pages

BLOCK = "pool_id string, block_id bigint, length bigint, gen_stamp bigint"


def at(second):
    return dt.datetime(2024, 1, 1) + dt.timedelta(seconds=second)


@pytest.mark.parametrize("limit", [2_000, 1])
def test_one_rule_for_equal_versions(table, limit):
    events = [("p", 1, 9, g, at(0)) for g in (3, 5, 4)]  # one instant: the highest generation
    events += [("p", 2, 9, 7, at(1)), ("p", 2, 9, 8, at(2)), ("p", 2, 4, 9, at(0))]  # equal lengths: the earliest
    events += [(None, 3, 5, g, at(i)) for i, g in enumerate((1, 2, 2))]
    found = coalesce_requests(table(events, f"{BLOCK}, ts timestamp"), "10 seconds", limit=limit)
    assert rows(found.select("pool_id", "block_id", "length", "gen_stamp", "n_events")) == sorted(
        [("p", 1, 9, 5, 3), ("p", 2, 9, 7, 3), (None, 3, 5, 1, 3)], key=repr
    )


def test_missing_names_match_nothing(blocks):
    live, store = blocks([("p", -1, 1, 1), ("", 2, 1, 1)]), blocks([("p", None, 1, 1), (None, 2, 1, 1), ("p", 3, 1, 1)])
    assert rows(reconcile(live, store)) == [("", 2, 1, 1, "backup"), ("p", -1, 1, 1, "backup"), ("p", 3, 1, 1, "delete_orphan")]
    assert rows(unnamed(store)) == sorted([("p", None, 1, 1), (None, 2, 1, 1)], key=repr)


def test_blocks_are_not_dealt_out_by_pool(spark, blocks):
    live, store = blocks([("p", 1, 1, 1)]), blocks([("q", 1, 1, 1), ("q", 2, 1, 1)])
    for df in (reconcile(live, store), restore_unknown(store, live)):
        assert "BroadcastHashJoin [pool_id" in df._jdf.queryExecution().toString()


def test_equal_requests_are_one(table):
    asked = [("n", at(0), "p", 1, 1, 1)] * 2 + [("n", at(1), "p", 2, 1, 1), ("n", at(2), "p", 3, 1, 1), ("n", None, "p", 4, 1, 1)]
    found = admit(table(asked, f"node string, requested_ts timestamp, {BLOCK}"), 2)
    assert rows(found.select("block_id", "accepted")) == [(1, True), (1, True), (2, True), (3, False), (4, False)]


def test_an_untimed_write_replaces(table):
    schema = f"{BLOCK}, data binary, written_at bigint"
    old = table([("p", 1, 1, 1, b"old", 1), ("p", 2, 1, 1, b"kept", 1)], schema)
    new = table([("p", 1, 1, 1, b"new", None), ("p", 3, 1, 1, b"a", 5), ("p", 3, 1, 1, b"b", 5), ("p", 3, 1, 1, b"c", 4)], schema)
    found = {r["block_id"]: bytes(r["data"]) for r in upsert_payload(old, new).collect()}
    assert found == {1: b"new", 2: b"kept", 3: max((b"a", b"b"), key=lambda x: hashlib.md5(x).hexdigest())}


def test_contents_held_twice_are_copied_once(table, blocks):
    held = table([("p", 1, 3, 1, b"abc")] * 2, f"{BLOCK}, data binary")
    assert backup_payload(blocks([("p", 1, 3, 1)]), held).count() == 1


def test_each_batch_is_called_once(blocks, tmp_path):
    def note(batch):
        open(os.path.join(tmp_path, os.urandom(8).hex()), "w").close()

    plan = blocks([("p", i, 1, 1) for i in range(6)]).select("*", F.lit("delete").alias("action"), F.lit(0).alias("batch_no"))
    found = apply_deletes_with(note, plan)
    assert found.count() == 6 and found.filter("ok").count() == 6 and len(found.collect()) == 6
    assert len(os.listdir(tmp_path)) == 1


def test_clean_up_goes_on_after_a_failure(blocks):

    store, live = blocks([("p", i, 1, 1) for i in range(40)]), blocks([])
    first = run_gc_pages(lambda b: "down" if 3 in b["block_id"].tolist() else None, gc_pages(store, live, 10))
    done = {r["block_id"] for r in first.filter("ok").collect()}
    left = store.filter(~F.col("block_id").isin(list(done)))
    second = run_gc_pages(lambda b: None, gc_pages(left, live, 10), done=first)  # other pages under the same numbers
    assert {r["block_id"] for r in second.filter("ok").collect()} == set(range(40)) - done


def test_only_what_is_saved_is_marked(table, blocks):
    local = table([("p", i, 3, 1, i != 2, i == 3) for i in range(5)], f"{BLOCK}, is_valid boolean, is_symlink boolean")
    stored, ledger = blocks([("p", 1, 3, 1)]), blocks([])
    run = node_validate(local, stored, ledger)
    assert {r["block_id"] for r in run.ledger.collect()} == {1, 2, 3}
    held = table([("p", 0, 3, 1, b"abc"), ("p", 4, 3, 1, b"too long")], f"{BLOCK}, data binary")
    run = node_validate(local, stored, ledger, payload=held)
    assert {r["block_id"] for r in run.ledger.collect()} == {0, 1, 2, 3}
    assert {(r["block_id"], r["status"]) for r in run.copied.collect()} == {(0, "ok"), (4, "length_mismatch")}


def test_a_repeated_run_replaces_its_report(spark, table, tmp_path):
    schema = "run_id string, event string"
    for run, events in (("a", ["x", "y"]), ("b", ["z"]), ("a", ["x", "y"])):
        write_report(table([(run, e) for e in events], schema), str(tmp_path / "r"))
    assert spark.read.parquet(str(tmp_path / "r")).count() == 3


def test_errors_of_a_run_leave_its_plan_rows(spark, table, tmp_path):
    plan = table([("run", e) for e in ("start", "deleteBackupBlock", "complete")], "run_id string, event string")
    failed = table([("p", i, 3, 1, False, "down") for i in (1, 2)], f"{BLOCK}, ok boolean, error string")
    folder = str(tmp_path / "r")
    write_report(plan, folder)
    for event in ("deleteBackupBlockError", "backupRequestError", "deleteBackupBlockError"):
        write_report(error_events(failed, event, "run", "2024-01-31").select("run_id", "event"), folder)
    write_report(plan, folder)
    write_report(plan.limit(1), folder, step="second pass")
    counts = {r["step"]: r["count"] for r in spark.read.parquet(folder).groupBy("step").count().collect()}
    assert counts == {"plan": 3, "deleteBackupBlockError": 2, "backupRequestError": 2, "second pass": 1}


def test_a_run_without_errors_empties_those_of_before(spark, table, tmp_path):
    path, schema = str(tmp_path / "r"), "run_id string, event string"
    plan, error = ("a", "deleteBackupBlock"), ("a", "deleteBackupBlockError")
    read = lambda: sorted((r["run_id"], r["event"]) for r in spark.read.parquet(path).collect())
    write_report(table([plan, error], schema), path, run_id="a")
    write_report(table([("b", "start")], schema), path, run_id="b")
    assert read() == [plan, error, ("b", "start")]
    write_report(table([plan], schema), path, run_id="a")
    assert read() == [plan, ("b", "start")]
    write_report(table([error], schema), path, step="deleteBackupBlockError", run_id="a")
    write_report(table([], schema), path, step="deleteBackupBlockError", run_id="a")
    assert read() == [plan, ("b", "start")]


def test_old_reports_are_removed(spark, table, tmp_path):
    path = str(tmp_path / "r")
    runs = ["20240101000000", "20240123235959", "20240124000000", "20240130000000", "by hand"]
    write_report(table([(r, "start") for r in runs], "run_id string, event string"), path)
    assert drop_reports(spark, path, "2024-01-31 00:00:00") == runs[:2]
    assert sorted(os.listdir(path))[-3:] == ["run_id=20240124000000", "run_id=20240130000000", "run_id=by hand"]
    assert drop_reports(spark, path, "2024-01-31 00:00:00") == [] == drop_reports(spark, str(tmp_path / "none"), "2024-01-31 00:00:00")


def test_a_block_of_no_pool_is_foreign(table):
    found = check_pool(table([("p", 1, 1, 1), ("q", 2, 1, 1), (None, 3, 1, 1)], BLOCK), "p").collect()
    assert [r["error"] is None for r in sorted(found, key=lambda r: r["block_id"])] == [True, False, False]
