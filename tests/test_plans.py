import datetime as dt

from conftest import FOLDER, rows
from pyspark.sql import functions as F

from blockledger.operators.assign import elect_owner, rank_replicas
from blockledger.operators.callbacks import apply_deletes_with, send_requests_with
from blockledger.operators.metrics import queue_depth
from blockledger.operators.payload import apply_deletes
from blockledger.operators.ranking import admit, assign_batches, number_rows
from blockledger.operators.reconcile import gc, reconcile
from blockledger.plans import jobs
from blockledger.schema import KEY
from blockledger.sources.reports import prune_reports
from blockledger.workload.fixtures import Tables


def test_plan_covers_both_sides_once(spark):
    t = Tables(spark, FOLDER)
    plan = reconcile(t.live(), t.store())
    union = t.live().union(t.store()).distinct()
    assert plan.count() == union.count() == plan.select(*KEY).intersect(union).count()


def test_converged_store_is_in_sync(spark):
    t = Tables(spark, FOLDER)
    plan = reconcile(t.live(), t.store())
    deletes = plan.filter(F.startswith("action", F.lit("delete")))
    backups = plan.filter(F.col("action") == "backup").select(*KEY)
    applied = apply_deletes(t.store(), deletes).select(*KEY).union(backups)
    done = jobs.converge(t.live(), t.store())
    assert rows(applied) == rows(done.store)
    assert {r["action"] for r in done.audit.select("action").distinct().collect()} == {"in_sync", "restore"}


def test_lost_pool_is_never_deleted(blocks):
    live, store = blocks([("a", 1, 1, 1)]), blocks([("b", 1, 1, 1), ("b", 2, 1, 1), ("a", 1, 1, 1)])
    assert {r["action"] for r in reconcile(live, store).filter("pool_id = 'b'").collect()} == {"restore"}
    known = reconcile(live, store, unknown_only=True).filter("pool_id = 'b'").collect()
    assert [r["block_id"] for r in known] == [2]


def test_copies_of_one_block_do_not_multiply(blocks):
    live = blocks([("a", 1, 1, 1)] * 500 + [("a", 2, 1, 1)])
    store = blocks([("a", 1, 1, 1)] * 300 + [("a", 1, 2, 1)])
    got = sorted((r["block_id"], r["length"], r["action"]) for r in reconcile(live, store).collect())
    assert got == [(1, 1, "in_sync"), (1, 2, "delete_stale"), (2, 1, "backup")]


def test_gc_by_id_keeps_other_versions(blocks):
    live, store = blocks([("a", 1, 1, 5)]), blocks([("a", 1, 1, 4), ("a", 2, 1, 1), ("a", 1, 1, 5)])
    assert rows(gc(store, live).select("block_id", "gen_stamp")) == [(1, 4), (2, 1)]
    assert rows(gc(store, live, "block_id").select("block_id", "gen_stamp")) == [(2, 1)]


def test_batches(blocks):
    plan = blocks([("hot", i, 1, 1) for i in range(2_345)] + [("cold", 1, 1, 1)]).withColumn("action", F.lit("delete"))
    got = assign_batches(plan, 100).groupBy("pool_id", "batch_no").count().collect()
    sizes = sorted((r["count"] for r in got if r["pool_id"] == "hot"), reverse=True)
    assert sizes == [100] * 23 + [45]


def test_numbers_have_no_gaps(blocks):
    df = blocks([("p", i % 50, i, 1) for i in range(1_000)])
    got = number_rows(df, [], KEY).agg(F.min("row_no"), F.max("row_no"), F.countDistinct("row_no")).first()
    assert tuple(got) == (0, 999, 1000)


def test_one_owner_per_block(spark):
    t = Tables(spark, FOLDER)
    owners = rank_replicas(t.replicas()).filter("position = 0").groupBy("pool_id", "block_id").count()
    assert owners.count() == t.live().count()
    assert owners.filter("count <> 1").count() == 0


def test_unlisted_node_is_forced(table):
    asked = table([("p", 1, "n9"), ("p", 2, "n1")], "pool_id string, block_id bigint, node string")
    held = table([("p", 1, "n1"), ("p", 1, "n2")], "pool_id string, block_id bigint, node string")
    assert {r["decision"] for r in elect_owner(asked, held).collect()} == {"force"}


def test_admit_with_queue(table):
    t0 = dt.datetime(2024, 1, 1)
    asked = table(
        [("p", i, 1, 1, "hot", t0 + dt.timedelta(seconds=i)) for i in range(400)] + [("p", 1, 1, 1, "b", t0)],
        "pool_id string, block_id bigint, length bigint, gen_stamp bigint, node string, requested_ts timestamp",
    )
    full = table([("hot", 7)], "node string, in_queue int")
    got = admit(asked, 10, full)
    assert got.count() == 401
    assert rows(got.filter("accepted").select("node", "block_id")) == [("b", 1), ("hot", 0), ("hot", 1), ("hot", 2)]


def test_rank_limit_runs_before_the_shuffle(table):
    asked = table([("p", 1, 1, 1, "b", dt.datetime(2024, 1, 1))], "pool_id string, block_id bigint, length bigint, gen_stamp bigint, node string, requested_ts timestamp")
    assert "WindowGroupLimit" in admit(asked, 10)._jdf.queryExecution().executedPlan().toString()


def test_queue_depth_of_a_busy_node(table):
    t0 = dt.datetime(2024, 1, 1)
    events = [(i, "n", t0 + dt.timedelta(minutes=7 * i), 1 if i % 3 else -1) for i in range(200)]
    got = {r["seq"]: r["depth"] for r in queue_depth(table(events, "seq bigint, node string, ts timestamp, delta bigint")).collect()}
    depth = 0
    for seq, _, _, delta in events:
        depth += delta
        assert got[seq] == depth


def test_reports_kept_for_seven_days(table):
    now = dt.datetime(2024, 3, 1, 12, 0, 0, 500_000)
    stamp = lambda h: (now - dt.timedelta(hours=h)).strftime("report.%Y%m%d%H%M%S")
    names = [(stamp(h),) for h in range(500)] + [("report.bad",), ("other",)]
    assert prune_reports(table(names, "name string"), now).count() == 332
    assert prune_reports(table(names[:5], "name string"), now).count() == 0


def test_failed_batches_do_not_stop_the_rest(blocks):
    plan = blocks([("p", i, i, 1) for i in range(1_000)]).withColumn("action", F.lit("delete"))

    def refuse(batch):
        assert len(batch) <= 100
        if 777 in set(batch["block_id"]):
            raise ValueError("no")

    got = apply_deletes_with(refuse, assign_batches(plan, 100)).groupBy("ok", "error").count().collect()
    assert sorted((r["ok"], r["error"], r["count"]) for r in got) == [(False, "ValueError: no", 100), (True, None, 900)]


def test_requests_go_to_the_chosen_replica(blocks):
    plan = blocks([("p", i, 1, 1) for i in range(50)]).withColumn("action", F.lit("backup"))
    replica = F.when(F.col("block_id") % 5 != 0, F.struct(F.lit("h").alias("ip"), (F.col("block_id") % 2).cast("int").alias("port")))

    def odd_is_down(address, batch):
        if address == "h:1":
            raise IOError("down")

    got = send_requests_with(odd_is_down, assign_batches(plan, 10).withColumn("replica", replica)).collect()
    want = {i: "no replica" if i % 5 == 0 else ("OSError: down" if i % 2 else None) for i in range(50)}
    assert {r["block_id"]: r["error"] for r in got} == want


def test_debug_report_lists_blocks(spark):
    t = Tables(spark, FOLDER)
    ignore = spark.createDataFrame([], "path string")
    check = jobs.block_check(t.files(), t.snapshots(), ignore, t.store(), debug=True)
    listed = check.report.filter("event = 'statusExtendedBlocksFromBackStore'")
    assert listed.count() == t.store().count()
    batch = check.report.filter("event = 'backupRequestBatch'").first()
    assert batch["detail"].count("ExtendedBlock [") == batch["n_blocks"]


def test_forced_restore_skips_the_ttl(blocks, table):
    t0 = dt.datetime(2024, 1, 1)
    seen = table([("p", 1, 1, 1, t0), ("p", 1, 1, 1, t0 + dt.timedelta(minutes=1))], "pool_id string, block_id bigint, length bigint, gen_stamp bigint, ts timestamp")
    nodes, store = table([("n1",), ("n2",)], "node string"), blocks([("p", 1, 1, 1)])
    once = jobs.restore_run(seen, store, store.limit(0), nodes).requests
    forced = jobs.restore_run(seen, store, store.limit(0), nodes, force=seen.filter(F.col("ts") > F.lit(t0))).requests
    assert (once.count(), forced.count()) == (1, 2)


def sighted(table, rows):
    t0 = dt.datetime(2024, 1, 1)
    schema = "pool_id string, block_id bigint, length bigint, gen_stamp bigint, ts timestamp"
    return table([("p", b, 1, 1, t0 + dt.timedelta(minutes=m)) for b, m in rows], schema)


def polled(run):
    base = dt.datetime(2024, 1, 1)
    return sorted((int((r["requested_ts"] - base).total_seconds() // 60), r["block_id"], r["accepted"]) for r in run.requests.collect())


def test_refused_blocks_are_asked_for_again(blocks, table):
    """One place, two blocks, three polls: the second block is taken at its second sighting."""
    seen = sighted(table, [(b, m) for b in (1, 2) for m in (0, 6, 12)])
    store, nodes = blocks([("p", 1, 1, 1), ("p", 2, 1, 1)]), table([("n1",)], "node string")
    run = lambda **kw: polled(jobs.restore_run(seen, store, store.limit(0), nodes, capacity=1, poll="6 minutes", **kw))
    assert run(ttl="30 minutes") == [(0, 1, True), (0, 2, False), (6, 2, True)]
    assert run(ttl="5 minutes") == [(m, b, b == 1) for m in (0, 6, 12) for b in (1, 2)]
    assert run(ttl="30 minutes", busy="7 minutes") == [(0, 1, True), (0, 2, False), (6, 2, False), (12, 2, True)]


def test_polls_as_one_state_machine(blocks, table):
    """Many blocks, nodes and polls against the requests worked out one by one; lost polls, ties and repeats included."""
    import hashlib
    import random

    draw = random.Random(4)
    times = [0, 1, 2, 2.5, 4, 11, 12, 13, 14, 30]
    rows = [(b, draw.choice(times)) for b in [draw.randint(0, 60) for _ in range(600)]]
    forced = [(b, draw.choice(times)) for b in [draw.randint(0, 80) for _ in range(40)]]
    store, present = blocks([("p", b, 1, 1) for b in range(50)]), blocks([("p", b, 1, 1) for b in range(5)])
    nodes = table([(f"n{i}",) for i in range(3)], "node string")
    t0 = dt.datetime(2024, 1, 1)
    run = jobs.restore_run(
        sighted(table, rows), store, present, nodes, ttl="10 minutes", capacity=4, poll="2 minutes", busy="3 minutes", force=sighted(table, forced)
    )
    got = sorted(((r["requested_ts"] - t0).total_seconds() / 60, r["block_id"], r["node"], r["accepted"], r["force"]) for r in run.requests.collect())

    h32 = lambda text: int(hashlib.md5(text.encode()).hexdigest()[:8], 16)
    numbered = sorted((f"n{i}" for i in range(3)), key=lambda n: (hashlib.md5(n.encode()).hexdigest()[:2], n))
    base = 1704067200 // 120
    want, taken = [], []
    events = [(m, b, False) for b, m in rows if 5 <= b < 50] + [(m, b, True) for b, m in forced]
    for poll in sorted({int(m // 2) for m, _, _ in events}):
        asked = {}
        for m, b, f in events:
            if int(m // 2) == poll:
                first, force = asked.get(b, (m, False))
                asked[b] = (min(first, m), force or f)
        free = {n: 4 - sum(x[2] == n and x[0] + 3 > poll * 2 for x in taken) for n in numbered}
        for b, (m, f) in sorted(asked.items(), key=lambda x: (x[1][0], x[0])):
            if f or all(x[1] != b or x[0] + 10 <= m for x in taken if x[0] < poll * 2):
                node = numbered[h32(f"p:{b}:1:1:0:{base + poll}") % 3]
                free[node] -= 1
                want.append((m, b, node, free[node] >= 0, f))
        taken += [x for x in want if x[3] and x[0] >= poll * 2]
    assert got == sorted(want)
    assert any(not x[3] for x in want) and len({x[1] for x in want if not x[3]} & {x[1] for x in want if x[3]}) > 3


def test_polls_of_nothing(blocks, table):
    seen, store = sighted(table, []), blocks([("p", 1, 1, 1)])
    run = jobs.restore_run(seen, store, store.limit(0), table([("n1",)], "node string"))
    assert run.requests.count() == 0
    nobody = jobs.restore_run(sighted(table, [(1, 0)]), store, store.limit(0), table([], "node string"))
    assert nobody.requests.count() == 0
