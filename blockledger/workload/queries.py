"""Every operator run over the given tables, one query each. Times come out as epoch microseconds, lists as text."""

import uuid

from pyspark.errors import StreamingQueryException
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from blockledger.functions.columns import local_name, micros, path_ancestors
from blockledger.operators import aggregates, assign, filters, metrics, payload, ranking, reconcile, restore, validate
from blockledger.operators.admission import RestorePolls
from blockledger.operators.anchored import coalesce_requests, ttl_dedupe
from blockledger.operators.callbacks import apply_deletes_with, send_requests_with
from blockledger.plans import jobs
from blockledger.schema import KEY
from blockledger.session import checkpoint_dir, materialize
from blockledger.sources import inventory, manifest, objects, reports
from blockledger.streaming import requests as streams
from blockledger.streaming import sinks
from blockledger.workload.fixtures import Tables

AGE = "6 hours"
NOW = "2024-01-31 00:00:00"


def scratch(t: Tables, name: str) -> str:
    """A new folder below the shared checkpoint folder."""
    return f"{checkpoint_dir(t.spark)}/{name}-{uuid.uuid4().hex}"


def us(df: DataFrame, *names: str) -> DataFrame:
    for name in names:
        df = df.withColumn(name.replace("_ts", "_us") if name != "ts" else "ts_us", micros(name)).drop(name)
    return df


def addresses(column="replicas"):
    return F.array_join(F.transform(F.col(column), lambda r: F.concat_ws(":", r["ip"], r["port"])), ",")


def address(column="replica"):
    return F.when(F.col(column).isNotNull(), F.concat_ws(":", f"{column}.ip", f"{column}.port"))


# -- sources ------------------------------------------------------------------------------------------------------


def live_blocks(t):
    rows = inventory.live_blocks(t.files())
    return rows.select("path", *KEY, addresses().alias("replicas"))


def with_snapshots(t):
    rows = inventory.with_snapshots(inventory.live_blocks(t.files()), t.snapshots())
    return aggregates.dedupe(rows).select(*KEY, addresses().alias("replicas"))


def store_from_keys(t):
    return inventory.store_from_keys(t.keys("a/b"), "a/b")


def file_listing(t):
    names = F.array(*[F.concat(F.lit("/backup/"), local_name(half)) for half in ("data", "meta")])
    return t.store().select(F.explode(names).alias("path"), "length")


def store_from_files(t):
    return inventory.store_from_files(file_listing(t))


def _objects(t, **layout):
    """A store of real objects, the documents with their checksums."""
    folder = scratch(t, "objects")
    stored = t.payload().withColumn("meta", payload.chunk_sums(F.col("data"), algorithm="md5"))
    objects.put_objects(stored, folder, **layout).write.format("noop").mode("overwrite").save()
    return folder


def list_store(t):
    """Objects that were written are listed in pages of 9 and read as an inventory."""
    keys = objects.list_keys(t.spark, _objects(t, prefix="a/b"), prefix="a/b/meta/", page=9)
    return inventory.store_from_keys(keys, "a/b")


def store_from_real_files(t):
    return inventory.store_from_files(inventory.list_files(t.spark, _objects(t, files=True)))


def gc_resumed(t):
    """A clean-up of the objects, page by page: broken off after some pages and started again on the same checkpoint."""
    folder, log = _objects(t), scratch(t, "gc")
    english = t.read("documents").filter("lang = 'en'").select(F.col("doc_id").alias("block_id"))
    live = materialize(t.payload().join(english, "block_id").select(*KEY))
    handle = sinks.collect_garbage(live, objects.remove_objects(folder), f"{log}/done")
    pages = objects.stream_keys(t.spark, folder, "meta/", page=max(50, english.count() // 2))
    for stop_after in (1, None):

        def once(page, n, last=stop_after):
            if last is not None and n > last:
                raise InterruptedError("broken off")
            handle(page, n)

        query = pages.writeStream.foreachBatch(once).option("checkpointLocation", f"{log}/state").start()
        try:
            query.processAllAvailable()
        except StreamingQueryException:
            pass
        finally:
            query.stop()
    done = t.spark.read.parquet(f"{log}/done").filter("ok").groupBy(*KEY).agg(F.count("*").alias("times"))
    left = inventory.store_from_keys(objects.list_keys(t.spark, folder)).withColumn("times", F.lit(0).cast("bigint"))
    return done.unionByName(left)


def list_after(t):
    return inventory.list_after(t.store(), "meta/BP-2", 10_000)


def _ignored(t):
    return inventory.parse_ignore(t.ignore_lines())


def ignore_list(t):
    """A hand-written file: comments, blanks around the paths, slashes behind them, and repeated lines."""
    path = F.concat_ws("/", F.lit("/wh"), "o_orderstatus", F.year("o_orderdate").cast("string"), F.col("o_orderkey").cast("string"))
    marked = F.when(F.col("o_orderpriority") == "2-HIGH", F.concat(F.lit("# "), path)).otherwise(F.concat(F.lit("  "), path, F.lit("/ ")))
    written = F.explode(F.when(F.col("o_orderpriority") == "1-URGENT", F.array(marked, path)).otherwise(F.array(marked)))
    folder = scratch(t, "ignore")
    t.read("orders").select(written.alias("value")).write.text(folder)
    return inventory.ignore_list(t.spark, folder)


def read_manifest(t):
    return manifest.read_manifest(manifest.write_manifest(t.store(), 100))


def write_manifest(t):
    return manifest.write_manifest(t.store(), 100)


def json_blocks(t):
    texts = manifest.to_json_blocks(t.store())
    return texts.select("*", F.from_json("json", manifest.ONE).alias("b")).select(
        "json", F.col("b.blkid").alias("block_id"), F.col("b.genstamp").alias("gen_stamp")
    )


def parse_reports(t):
    lines = reports.report_lines(t.report_rows())
    return us(reports.parse_reports(lines), "ts")


# -- sinks --------------------------------------------------------------------------------------------------------


def _copied(t):
    return payload.backup_payload(t.payload_plan(), t.payload(), algorithm="md5")


def _digests(df):
    return df.withColumn("data", F.md5("data")).withColumn("meta", F.md5(F.array_join("meta", ",")))


def backup_payload(t):
    return _digests(_copied(t))


def write_payload(t):
    folder = scratch(t, "payload")
    payload.write_payload(_copied(t), folder)
    return _digests(t.spark.read.parquet(folder)).select(*KEY, "data", "meta")


def upsert_payload(t):
    docs = t.payload()
    again = F.explode(F.array(F.lit(1).cast("bigint"), F.lit(2).cast("bigint")))
    new = (
        t.read("documents")
        .filter(F.col("lang") == "en")
        .select(F.col("doc_id").alias("block_id"))
        .join(docs, "block_id")
        .select(*KEY, "data", again.alias("written_at"))
        .withColumn("data", F.encode(F.concat_ws(":", "written_at", F.decode("data", "UTF-8")), "UTF-8"))
    )
    return payload.upsert_payload(docs, new).select(*KEY, F.md5("data").alias("data"))


def merge_payload(t):
    """A stored table, some of whose blocks are written again, twice over."""
    folder = scratch(t, "merged")
    docs = t.payload().withColumn("meta", payload.chunk_sums(F.col("data"), algorithm="md5"))
    english = t.read("documents").filter("lang = 'en'").select(F.col("doc_id").alias("block_id"))
    payload.merge_payload(docs, folder, buckets=4)
    for _ in range(2):
        again = docs.join(english, "block_id").withColumn("data", F.encode(F.concat(F.lit("2:"), F.decode("data", "UTF-8")), "UTF-8"))
        payload.merge_payload(again.select(*docs.columns), folder, buckets=4)
    return payload.read_payload(t.spark, folder, docs.schema).select(*KEY, F.md5("data").alias("data"))


def restore_payload(t):
    docs = t.payload()
    stored = docs.withColumn("meta", payload.chunk_sums(F.col("data"), algorithm="md5"))
    here = docs.join(t.read("documents").filter(F.col("lang") == "de").select(F.col("doc_id").alias("block_id")), "block_id")
    return _digests(payload.restore_payload(t.payload_plan(), stored, here))


def apply_deletes(t):
    deletes = reconcile.reconcile(t.live(), t.store()).filter(F.startswith("action", F.lit("delete")))
    return payload.apply_deletes(t.store(), deletes).select(*KEY)


def delete_keys(t):
    deletes = reconcile.gc(t.store(), t.live())
    return payload.delete_keys(deletes, "a/b").select("half", "key")


def purge(t):
    keys = t.keys("a").unionByName(t.keys("a/b")).unionByName(t.keys())
    return payload.purge(keys, "a/b/")


def write_report(t):
    folder = scratch(t, "report")
    plan = reconcile.reconcile(t.live(), t.store()).filter(F.col("action") != "in_sync")
    events = reports.action_events(ranking.assign_batches(plan, 100), "run1", NOW, debug=False)
    reports.write_report(events, folder)
    return us(t.spark.read.parquet(folder), "ts").drop("run_id", "step")


def write_report_clean(t):
    """A run with errors is reported, then run again without: of the errors nothing is left."""
    folder = scratch(t, "report")
    plan = reconcile.reconcile(t.live(), t.store()).filter(F.col("action") != "in_sync")
    events = materialize(reports.action_events(ranking.assign_batches(plan, 100), "run1", NOW, debug=False))
    failed = reconcile.gc(t.store(), t.live()).select("*", F.lit(False).alias("ok"), F.lit("down").alias("error"))
    errors = reports.error_events(failed, "deleteBackupBlockError", "run1", NOW)
    for found in (errors, errors.limit(0)):
        reports.write_report(events.unionByName(found), folder, run_id="run1")
    return us(t.spark.read.parquet(folder), "ts").drop("run_id", "step")


def report_debug(t):
    """The report of a run that names every block: one row a batch, with all of its blocks."""
    plan = reconcile.reconcile(t.live(), t.store()).filter(F.col("action") != "in_sync")
    events = reports.action_events(ranking.assign_batches(plan, 100), "run1", NOW, debug=True)
    return events.select("event", "pool_id", "seq", "n_blocks", F.md5("detail").alias("detail"))


def drop_reports(t):
    """Reports of every day are written, those of more than a week ago dropped, and the rest read."""
    folder = scratch(t, "reports")
    rows = t.report_rows().withColumn("run_id", F.concat("run_id", F.lit("000000"))).withColumn("pool_id", F.lit(None).cast("string"))
    reports.write_report(rows, folder)
    reports.drop_reports(t.spark, folder, NOW)
    left = t.spark.read.schema("event string, run_id string, step string").parquet(folder)
    return left.groupBy("run_id", "step").agg(F.count("*").alias("n"))


def checksum_meta(t):
    rows = payload.checksum_meta(t.payload(), 512, "md5")
    return rows.select(*KEY, F.size("meta").cast("bigint").alias("chunks"), F.md5(F.array_join("meta", ",")).alias("meta"))


def _crc(t, kind):
    """Sums of the chunks, and of the whole as it follows from them."""
    rows = payload.checksum_meta(t.payload(), 512, kind)
    whole = payload.whole_sums(rows, 512, kind)
    return rows.join(whole, KEY).select(
        *KEY, F.size("meta").cast("bigint").alias("chunks"), F.md5(F.array_join(F.transform("meta", lambda x: x.cast("string")), ",")).alias("meta"), "checksum"
    )


def checksum_crc32(t):
    return _crc(t, "crc32")


def checksum_crc32c(t):
    return _crc(t, "crc32c")


def verify_payload(t):
    docs = t.read("documents").select(
        F.col("doc_id").alias("block_id"),
        F.when(F.col("lang") == "fr", F.replace("text", F.lit(" "), F.lit("_")))
        .when(F.col("lang") == "de", F.concat("text", F.lit("x")))
        .otherwise(F.col("text"))
        .alias("read_back"),
    )
    stored = t.payload().withColumn("meta", payload.chunk_sums(F.col("data"), algorithm="md5"))
    damaged = stored.join(docs, "block_id").withColumn("data", F.encode("read_back", "UTF-8"))
    return payload.verify_payload(damaged, algorithm="md5")


# -- projections and predicates -----------------------------------------------------------------------------------


def render_keys(t):
    return payload.render_keys(t.store(), "a/b").select(*KEY, "half", "key")


def _messy_keys(t):
    """The listing plus names that no block has: web addresses of pages."""
    return t.keys("a").select("key").unionByName(t.read("pages").select(F.col("url").alias("key"))).unionByName(
        t.read("pages").select(F.concat(F.lit("a/meta/"), "url").alias("key"))
    )


def parse_keys(t):
    return inventory.parse_keys(_messy_keys(t), "a")


def parse_files(t):
    other = t.read("pages").select(F.col("url").alias("path"), F.col("page_id").alias("length"))
    return inventory.parse_files(file_listing(t).unionByName(other))


def path_ancestors_(t):
    paths = t.files().select("path")
    return paths.select("path", F.array_join(path_ancestors(F.col("path")), ";").alias("ancestors"))


def drop_ignored(t):
    return filters.drop_ignored(t.files(), _ignored(t)).select("path", F.size("blocks").cast("bigint").alias("blocks"))


def drop_ignored_long_list(t):
    return filters.drop_ignored(t.files(), _ignored(t), inline=1).select(
        "path", F.size("blocks").cast("bigint").alias("blocks")
    )


def has_block(t):
    return filters.has_block(filters.listed_halves(t.listing()))


def half_uploads(t):
    listing = t.listing()
    meta, data = listing.filter(F.col("half") == "meta"), listing.filter(F.col("half") == "data")
    return filters.half_uploads(filters.halves(meta, data))


def backup_eligible(t):
    return filters.backup_eligible(t.local(), t.store())


def check_pool(t):
    return filters.check_pool(t.store(), "BP-1")


def unbackable(t):
    return filters.unbackable(aggregates.dedupe(inventory.live_blocks(t.files()))).select(*KEY)


# -- joins, sets --------------------------------------------------------------------------------------------------


def reconcile_(t):
    return reconcile.reconcile(t.live(), t.store())


def reconcile_kept(t):
    """Both inventories are kept in buckets by block key; tonight's comparison reads bucket against bucket."""
    names = [f"{side}_{uuid.uuid4().hex}" for side in ("live", "stored")]
    try:
        kept = [inventory.keep_inventory(df, name) for df, name in zip((t.live(), t.store()), names, strict=True)]
        return materialize(reconcile.reconcile_kept(*kept))
    finally:
        for name in names:
            t.spark.sql(f"drop table if exists {name}")


def pool_actions(t):
    return reconcile.pool_actions(t.live(), t.store())


def pools(t):
    return reconcile.pools(t.live(), t.store()).select("pool_id")


def restore_unknown(t):
    return reconcile.restore_unknown(t.store(), t.live())


def gc(t):
    return reconcile.gc(t.store(), t.live())


def gc_by_id(t):
    return reconcile.gc(t.store(), t.live(), "block_id")


def restore_candidates(t):
    return restore.restore_candidates(t.corrupt(), t.store(), t.present(), t.requested())


def to_validate(t):
    return validate.to_validate(t.local(), t.ledger())


def to_validate_all(t):
    return validate.to_validate(t.local(), t.ledger(), ignore_previous=True)


def mark_validated(t):
    return validate.mark_validated(t.ledger(), t.corrupt())


def replica_lookup(t):
    held = t.replicas()  # first, as the store is then made from the lines that this has written
    return assign_nodes(aggregates.replica_lookup(t.store().distinct(), held))


def assign_nodes(df):
    return df.withColumn("nodes", F.array_join("nodes", ","))


def in_sync(t):
    return reconcile.in_sync(t.live(), t.store())


def missing(t):
    return reconcile.missing(t.live(), t.store())


def orphans(t):
    return reconcile.orphans(t.store(), t.live())


# -- aggregations -------------------------------------------------------------------------------------------------


def dedupe(t):
    return aggregates.dedupe(inventory.live_blocks(t.files())).select(*KEY, addresses().alias("replicas"))


def _pending(t):
    events = t.finalized().join(t.read("events").select("event_id", "event_type"), "event_id")
    return events.select(
        *KEY, F.timestamp_micros(micros("ts") + 5_000_000).alias("due_ts"), (F.col("event_type") == "error").alias("force")
    )


def longest_pending(t):
    return us(aggregates.longest_pending(_pending(t)), "due_ts")


def last_generation(t):
    return aggregates.last_generation(t.live_raw())


def merge_replicas(t):
    answers = t.lines().select(
        "pool_id",
        "block_id",
        F.array(F.concat(F.lit("dn-"), "l_suppkey")).alias("nodes"),
        (F.col("l_returnflag") == "N").alias("failed"),
    )
    return assign_nodes(aggregates.merge_replicas(answers))


def gc_totals(t):
    return metrics.gc_totals(t.store(), reconcile.gc(t.store(), t.live()))


def cluster_stats(t):
    stats = metrics.cluster_stats(t.node_stats())
    return stats.select(
        *[F.round(c, 2).alias(c) if c.endswith("second") else F.col(c).cast("bigint").alias(c) for c in stats.columns]
    )


def throughput(t):
    return metrics.throughput(t.transfers()).withColumn("bytes_per_second", F.round("bytes_per_second", 4))


def throughput_by_minute(t):
    return us(metrics.throughput_by_minute(t.transfers()).withColumnRenamed("minute", "minute_ts"), "minute_ts")


def retry_drop_metrics(t):
    return metrics.retry_drop_metrics(t.retry_events())


def retry_distribution(t):
    """Sketches of each day's run, merged: amounts of a node, and whether the merged quantiles lie as near as stated."""
    events, percents = t.retry_events(), (50, 95, 99)
    runs = materialize(metrics.amount_sketches(events))
    spread = materialize(metrics.sketch_quantiles(metrics.merge_sketches(runs), percents))
    amount, n, off = F.col("amount"), F.count("*"), metrics.RANK_ERROR

    def near(p):
        below, upto = F.count_if(amount < F.col(f"p{p}")), F.count_if(amount <= F.col(f"p{p}"))
        return ((below <= n * (p / 100 + off)) & (upto >= n * (p / 100 - off))).alias(f"p{p}_near")

    names = ["n_amounts", "min_amount", "max_amount"]
    return events.join(spread, "node").groupBy("node", *names).agg(*[near(p) for p in percents])


def report_summary(t):
    rows = reports.parse_reports(t.report_rows().select("run_id", reports_text().alias("value")))
    return reports.report_summary(rows)


def reports_text():
    return F.concat_ws(" ", F.date_format("ts", "yyyyMMddHHmmss"), "event", "detail")


# -- windows, ranking ---------------------------------------------------------------------------------------------


def assign_batches(t):
    plan = reconcile.reconcile(t.live(), t.store()).filter(F.col("action") != "in_sync")
    return ranking.assign_batches(plan, 100)


def pick_replica(t):
    blocks = aggregates.dedupe(inventory.live_blocks(t.files()))
    return assign.pick_replica(blocks).select(*KEY, address().alias("replica"))


def pick_node(t):
    return assign.pick_node(t.corrupt(), t.nodes()).select(*KEY, "node")


def elect_owner(t):
    asking = t.lines().select(
        "pool_id", "block_id", F.concat(F.lit("dn-"), (F.col("l_partkey") % 100).cast("string")).alias("node")
    )
    both = asking.unionByName(t.replicas()).distinct()
    return assign.elect_owner(both, t.replicas())


def coalesce_(t):
    return us(coalesce_requests(t.finalized(), AGE), "opened_ts", "due_ts")


def ttl_dedupe_(t):
    seen = t.finalized().withColumn("length", F.lit(1).cast("bigint"))
    return us(ttl_dedupe(seen, AGE), "ts")


def queue_depth(t):
    return us(metrics.queue_depth(t.queue_events()), "ts")


def sort_inventory(t):
    """The rows with their places in the sorted output: partition after partition, row after row."""
    row = F.monotonically_increasing_id()
    placed = materialize(
        ranking.sort_inventory(t.store()).select(*KEY, F.shiftright(row, 33).alias("part"), row.bitwiseAND(F.lit((1 << 33) - 1)).alias("at"))
    )
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = placed.groupBy("part").agg(F.count("*").alias("n"))
    starts = sizes.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    return placed.join(starts, "part").select(*KEY, (F.col("start") + F.col("at")).alias("position"))


def next_due(t):
    return us(ranking.next_due(_pending(t), "2024-01-15 00:00:00", 1_000), "due_ts")


def admit(t):
    asked = assign.pick_node(t.corrupt(), t.nodes())
    timed = asked.withColumn("requested_ts", F.timestamp_seconds("gen_stamp"))
    return us(ranking.admit(timed, 10), "requested_ts").drop("requested_us")


# -- jobs and callbacks -------------------------------------------------------------------------------------------


def _check(t, **kw):
    return jobs.block_check(t.files(), t.snapshots(), _ignored(t), t.store(), ts=NOW, **kw)


def block_check(t):
    return _check(t).plan.withColumn("replica", address())


def block_check_report(t):
    events = _check(t).report
    return events.groupBy("event", "pool_id").agg(F.count("*").alias("n"), F.sum("n_blocks").alias("n_blocks"))


def gc_run(t):
    return jobs.gc_run(t.store(), t.live()).deletes


def gc_run_store(t):
    return jobs.gc_run(t.store(), t.live()).store.select(*KEY)


def gc_run_totals(t):
    return jobs.gc_run(t.store(), t.live(), match_on="block_id").totals


def _sightings(t):
    polls = F.explode(F.array(*[F.lit(f"2024-01-01 00:{m:02d}:00").cast("timestamp") for m in (0, 6, 12)]))
    return t.corrupt().select("*", polls.alias("ts"))


def restore_run(t):
    """Three polls: what a node refuses in one of them is asked for again in the next."""
    run = jobs.restore_run(_sightings(t), t.store(), t.present(), t.nodes(), poll="6 minutes")
    return us(run.requests, "requested_ts").drop("force")


def restore_run_busy(t):
    """Places stay taken over a poll, and every fifth corrupt block is asked for by force, stored or not."""
    late = F.lit("2024-01-01 00:06:00").cast("timestamp")
    force = t.corrupt().filter(F.col("block_id") % 5 == 0).select("*", late.alias("ts"))
    run = jobs.restore_run(_sightings(t), t.store(), t.present(), t.nodes(), poll="6 minutes", busy="7 minutes", force=force)
    return us(run.requests, "requested_ts")


def restore_run_copied(t):
    """Documents that are corrupt come back with their contents; some are there already, some are not stored."""
    docs = t.payload()
    lang = t.read("documents").select(F.col("doc_id").alias("block_id"), "lang")
    here = docs.join(lang.filter("lang = 'de'"), "block_id").select(*KEY)
    stored = docs.withColumn("meta", payload.chunk_sums(F.col("data"), algorithm="md5"))
    polls = F.explode(F.array(*[F.lit(f"2024-01-01 00:{m:02d}:00").cast("timestamp") for m in (0, 6, 12)]))
    seen = docs.filter("block_id % 3 <> 0").select(*KEY, polls.alias("ts"))
    force = docs.filter("block_id % 30 = 0").select(*KEY, F.lit("2024-01-01 00:12:00").cast("timestamp").alias("ts"))
    nodes = t.nodes().filter("substring(node, -1) = '1'")
    run = jobs.restore_run(seen, docs.filter("block_id % 7 <> 0"), here, nodes, poll="6 minutes", force=force, payload=stored)
    return _digests(run.copied)


def node_validate(t):
    return jobs.node_validate(t.local(), t.store(), t.ledger()).checked


def node_validate_ledger(t):
    return jobs.node_validate(t.local(), t.store(), t.ledger(), failed=t.requested()).ledger


def node_validate_copied(t):
    """Documents on the nodes: what is eligible is copied, and what came out right is marked."""
    declared = t.payload_plan().filter("pool_id <> 'pages'")
    local = declared.select("*", (F.col("block_id") % 5 != 0).alias("is_valid"), (F.col("block_id") % 11 == 0).alias("is_symlink"))
    stored, ledger = declared.filter("block_id % 3 = 0"), declared.filter("block_id % 4 = 0")
    run = jobs.node_validate(local, stored.select(*KEY), ledger.select(*KEY), payload=t.payload())
    marked = run.ledger.select(*KEY, F.lit("marked").alias("status"))
    return marked.unionByName(run.copied.select(*KEY, "status"))


def converge(t):
    """What the comparison says of the store once its own plan was carried out."""
    return jobs.converge(t.live(), t.store()).audit


def converge_store(t):
    return jobs.converge(t.live(), t.store()).store


def converge_copied(t):
    """Documents, of which some can not be copied as declared: those are still to be backed up afterwards."""
    declared = t.payload_plan()
    store = declared.filter("block_id % 3 = 0").unionByName(declared.filter("block_id % 5 = 0").withColumn("gen_stamp", F.lit(0).cast("bigint")))
    return jobs.converge(declared.select(*KEY), store.select(*KEY), payload=t.payload()).audit


def prune_reports(t):
    return reports.prune_reports(t.report_names(), NOW)


def _refuse_long(batch):
    if int(batch["length"].max()) >= 50_000:
        raise IOError("block too long")


def apply_deletes_callback(t):
    plan = reconcile.gc(t.store(), t.live()).withColumn("action", F.lit("delete"))
    return apply_deletes_with(_refuse_long, ranking.assign_batches(plan, 100))


def error_report(t):
    events = reports.error_events(apply_deletes_callback(t), "deleteBackupBlockError", "run", NOW)
    return events.select("event", "pool_id", "n_blocks", "detail")


def _refuse_host(host, batch):
    if host.startswith("10.0.0.7:"):
        raise IOError("no route")


def send_requests_callback(t):
    plan = assign.pick_replica(aggregates.dedupe(inventory.live_blocks(t.files()))).withColumn("action", F.lit("backup"))
    return send_requests_with(_refuse_host, ranking.assign_batches(plan, 100))


# -- streams ------------------------------------------------------------------------------------------------------


EVENTS = T.StructType(
    [
        T.StructField("event_id", T.LongType()),
        T.StructField("ts", T.TimestampNTZType()),
        T.StructField("user_id", T.LongType()),
        T.StructField("event_type", T.StringType()),
        T.StructField("value", T.DoubleType()),
    ]
)


class StreamTables(Tables):
    """The same derivations with the events table read as a stream."""

    def read(self, name):
        if name != "events" or name in self._read:
            return super().read(name)
        return (
            self.spark.readStream.schema(EVENTS)
            .option("pathGlobFilter", "events.parquet")
            .option("maxFilesPerTrigger", 1)
            .parquet(self.folder)
        )


def run_once(t, stream: DataFrame, name: str) -> DataFrame:
    """Drain the stream into a new folder and read it back."""
    folder = scratch(t, name)
    drain(t, stream.writeStream.format("parquet").option("path", f"{folder}/out"), folder)
    return t.spark.read.schema(stream.schema).parquet(f"{folder}/out")


def drain(t, writer, folder: str) -> None:
    """Run a stream over all there is. State has as many partitions as there are cores: each starts a Python worker."""
    setting, spark = "spark.sql.shuffle.partitions", t.spark
    before = spark.conf.get(setting)
    spark.conf.set(setting, str(spark.sparkContext.defaultParallelism))
    try:
        writer.option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start().awaitTermination()
    finally:
        spark.conf.set(setting, before)


def _rocksdb(t):
    from blockledger.session import ROCKSDB

    t.spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)


def stream_backup_requests(t):
    _rocksdb(t)
    live = StreamTables(t.spark, t.folder)
    return us(run_once(t, streams.stream_backup_requests(live.finalized(), AGE, delay="0 seconds"), "backup"), "opened_ts", "due_ts")


def _arrivals(t, folder: str) -> DataFrame:
    """The events as four files, week by week; every 17th comes with the file after that of its week."""
    events = t.read("events").withColumn(
        "_file", F.floor((F.dayofmonth("ts") - 1) / 8).cast("int") + (F.col("event_id") % 17 == 0).cast("int")
    )
    for k in range(5):
        events.filter(F.col("_file") == k).drop("_file").coalesce(1).write.parquet(f"{folder}/{k}")
    return t.spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(folder)


def stream_backup_late(t):
    """What comes more than two days behind the newest event is told of, and changes no window."""
    _rocksdb(t)
    live = StreamTables(t.spark, t.folder)
    live._read["events"] = _arrivals(t, scratch(t, "arrivals"))
    asked = streams.stream_backup_requests(live.finalized(), AGE, delay="2 days", late=True)
    return us(run_once(t, asked, "late"), "opened_ts", "due_ts")


def stream_restore_requests(t):
    """Sightings of customer blocks by the event stream; the store holds those customers whose pool was lost."""
    _rocksdb(t)
    live = StreamTables(t.spark, t.folder)
    seen = live.finalized().select(
        F.lit("BP-9").alias("pool_id"),
        "block_id",
        F.lit(500).cast("bigint").alias("length"),
        F.lit(7).cast("bigint").alias("gen_stamp"),
        "ts",
    )
    return us(run_once(t, streams.stream_restore_requests(seen, t.store(), AGE, delay="0 seconds"), "restore"), "ts")


def stream_restore_polls(t):
    """The same sightings poll by poll: a node has two places for four days, a restore is not repeated for seven."""
    _rocksdb(t)
    live = StreamTables(t.spark, t.folder)
    seen = live.read("events").select(
        F.lit("BP-9").alias("pool_id"),
        F.col("user_id").cast("bigint").alias("block_id"),
        F.lit(500).cast("bigint").alias("length"),
        F.lit(7).cast("bigint").alias("gen_stamp"),
        F.col("ts").cast("timestamp").alias("ts"),
        ((F.col("event_type") == "error") & (F.col("user_id") % 7 == 0)).alias("force"),
    )
    folder = scratch(t, "polls")
    nodes = t.nodes().filter("substring(node, -1) = '1'")
    polls = RestorePolls.over(nodes, f"{folder}/requests", poll="3 days", ttl="7 days", busy="4 days", capacity=2)
    closed = streams.closed_polls(seen, t.store(), delay="1 hour", poll="3 days")
    drain(t, closed.writeStream.foreachBatch(streams.take_polls(polls)), folder)
    return us(polls.requests(), "requested_ts")


def stream_throughput(t):
    live = StreamTables(t.spark, t.folder)
    rows = run_once(t, sinks.stream_throughput(live.transfers()), "throughput")
    return us(rows.withColumnRenamed("minute", "minute_ts"), "minute_ts")


def with_retries(t):
    """Two micro-batches over the event stream: requests of some lengths fail, wait and are tried again."""
    live = StreamTables(t.spark, t.folder)
    asked = live.finalized().select(*KEY)
    folder = scratch(t, "retries")
    start = 1_704_067_200

    def attempt(df):
        return df.withColumn("ok", F.col("length") % 1000 != 0)

    def clock(batch_id):
        import datetime

        return datetime.datetime.fromtimestamp(start + 120 * batch_id, datetime.timezone.utc).replace(tzinfo=None)

    handle = sinks.with_retries(attempt, f"{folder}/states", clock)
    query = (
        asked.writeStream.foreachBatch(handle)
        .option("checkpointLocation", f"{folder}/log")
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    nothing = t.spark.createDataFrame([], asked.schema)
    for later in (1, 2):  # what further triggers do when no event has come
        handle(nothing, later)
    states = t.spark.read.option("basePath", f"{folder}/states").parquet(f"{folder}/states")
    return us(states.withColumn("batch_id", F.col("batch_id").cast("bigint")), "due_ts")


def retry_step(t):
    rows = t.finalized().select(
        *KEY, (F.col("length") % 1000 != 0).alias("ok"), F.lit(1).alias("attempt"), F.lit(False).alias("force")
    )
    out = sinks.retry_step(rows, NOW, max_attempts=3)
    return us(out.withColumn("attempt", F.col("attempt").cast("bigint")), "due_ts")


def incremental_validate(t):
    """The local blocks arrive as a stream of lines; the ledger keeps what was checked."""
    schema = t.read("lineitem").schema
    lines = (
        t.spark.readStream.schema(schema).option("pathGlobFilter", "lineitem.parquet").parquet(t.folder)
    )
    orders = t.read("orders").select("o_orderkey", F.substring("o_orderpriority", 1, 1).alias("p"))
    local = lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).select(
        F.concat(F.lit("BP-"), "p").alias("pool_id"),
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).cast("bigint").alias("block_id"),
        (F.floor("l_quantity").cast("bigint") * 1000).alias("length"),
        (1000 + F.col("l_partkey") % 50).cast("bigint").alias("gen_stamp"),
    )
    folder = scratch(t, "ledger")
    handle = sinks.incremental_validate(lambda df: df, f"{folder}/ledger", t.ledger())
    query = (
        local.writeStream.foreachBatch(handle)
        .option("checkpointLocation", f"{folder}/log")
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    return t.spark.read.parquet(f"{folder}/ledger").select(*KEY)


def gc_pages(t):
    return sinks.gc_pages(t.store(), t.live(), 1_000)


QUERIES = {
    "live_blocks": live_blocks,
    "with_snapshots": with_snapshots,
    "store_from_keys": store_from_keys,
    "store_from_files": store_from_files,
    "list_store": list_store,
    "store_from_real_files": store_from_real_files,
    "list_after": list_after,
    "ignore_list": ignore_list,
    "read_manifest": read_manifest,
    "write_manifest": write_manifest,
    "json_blocks": json_blocks,
    "parse_reports": parse_reports,
    "backup_payload": backup_payload,
    "write_payload": write_payload,
    "upsert_payload": upsert_payload,
    "merge_payload": merge_payload,
    "restore_payload": restore_payload,
    "apply_deletes": apply_deletes,
    "delete_keys": delete_keys,
    "purge": purge,
    "write_report": write_report,
    "write_report_clean": write_report_clean,
    "report_debug": report_debug,
    "checksum_meta": checksum_meta,
    "checksum_crc32": checksum_crc32,
    "checksum_crc32c": checksum_crc32c,
    "verify_payload": verify_payload,
    "render_keys": render_keys,
    "parse_keys": parse_keys,
    "parse_files": parse_files,
    "path_ancestors": path_ancestors_,
    "drop_ignored": drop_ignored,
    "drop_ignored_long_list": drop_ignored_long_list,
    "has_block": has_block,
    "half_uploads": half_uploads,
    "backup_eligible": backup_eligible,
    "check_pool": check_pool,
    "unbackable": unbackable,
    "reconcile": reconcile_,
    "reconcile_kept": reconcile_kept,
    "pool_actions": pool_actions,
    "pools": pools,
    "restore_unknown": restore_unknown,
    "gc": gc,
    "gc_by_id": gc_by_id,
    "restore_candidates": restore_candidates,
    "to_validate": to_validate,
    "to_validate_all": to_validate_all,
    "mark_validated": mark_validated,
    "replica_lookup": replica_lookup,
    "in_sync": in_sync,
    "missing": missing,
    "orphans": orphans,
    "dedupe": dedupe,
    "longest_pending": longest_pending,
    "last_generation": last_generation,
    "merge_replicas": merge_replicas,
    "gc_totals": gc_totals,
    "cluster_stats": cluster_stats,
    "throughput": throughput,
    "throughput_by_minute": throughput_by_minute,
    "retry_drop_metrics": retry_drop_metrics,
    "retry_distribution": retry_distribution,
    "report_summary": report_summary,
    "assign_batches": assign_batches,
    "pick_replica": pick_replica,
    "pick_node": pick_node,
    "elect_owner": elect_owner,
    "coalesce_requests": coalesce_,
    "ttl_dedupe": ttl_dedupe_,
    "queue_depth": queue_depth,
    "sort_inventory": sort_inventory,
    "next_due": next_due,
    "admit": admit,
    "block_check": block_check,
    "block_check_report": block_check_report,
    "gc_run": gc_run,
    "gc_run_totals": gc_run_totals,
    "gc_run_store": gc_run_store,
    "error_report": error_report,
    "restore_run": restore_run,
    "restore_run_busy": restore_run_busy,
    "restore_run_copied": restore_run_copied,
    "node_validate": node_validate,
    "node_validate_ledger": node_validate_ledger,
    "node_validate_copied": node_validate_copied,
    "converge": converge,
    "converge_store": converge_store,
    "converge_copied": converge_copied,
    "prune_reports": prune_reports,
    "drop_reports": drop_reports,
    "apply_deletes_with": apply_deletes_callback,
    "send_requests_with": send_requests_callback,
    "stream_backup_requests": stream_backup_requests,
    "stream_backup_late": stream_backup_late,
    "stream_restore_requests": stream_restore_requests,
    "stream_restore_polls": stream_restore_polls,
    "stream_throughput": stream_throughput,
    "with_retries": with_retries,
    "retry_step": retry_step,
    "incremental_validate": incremental_validate,
    "gc_pages": gc_pages,
    "gc_resumed": gc_resumed,
}
