"""Run reports: the text form, the table form, and how long they are kept."""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from blockledger.functions.columns import BLOCK_PATTERN, block_text, micros
from blockledger.schema import KEY, REPORT_KEEP, REPORT_PREFIX, REPORT_TIME
from blockledger.functions.columns import interval_micros

# The event names of a report.
EVENTS = [
    "start",
    "complete",
    "startBlockMetaDataFetchFromNameNode",
    "completeBlockMetaDataFetchFromNameNode",
    "startBlockPoolCheck",
    "completeBlockPoolCheck",
    "startRestoreAll",
    "completeRestoreAll",
    "restoreBlock",
    "restoreBlockError",
    "startBackupAll",
    "completeBackupAll",
    "backupRequestBatch",
    "backupRequestError",
    "deleteBackupBlock",
    "deleteBackupBlockError",
    "statusBlockMetaDataFetchFromNameNode",
    "statusBlockMetaDataFetchFromBackStore",
    "statusExtendedBlocksFromNameNode",
    "statusExtendedBlocksFromBackStore",
]

LINE = r"^(\d{14}) (\S+) ?(.*)$"


def parse_reports(lines: DataFrame) -> DataFrame:
    """Report lines (`value`) to rows; a line of another form keeps only its text, in `detail`."""
    ok = F.rlike("value", F.lit(LINE))
    pick = lambda i: F.when(ok, F.regexp_extract("value", LINE, i))
    event, detail = pick(2), F.when(ok, F.trim(F.regexp_extract("value", LINE, 3))).otherwise(F.col("value"))
    others = [c for c in lines.columns if c != "value"]
    rows = lines.select(
        *others,
        F.try_to_timestamp(pick(1), F.lit(REPORT_TIME)).alias("ts"),
        event.alias("event"),
        F.when(detail != "", detail).alias("detail"),
    )
    block = lambda i: F.when(
        F.rlike("detail", F.lit(BLOCK_PATTERN)), F.regexp_extract("detail", BLOCK_PATTERN, i)
    )
    pool = F.coalesce(block(1), F.when(F.endswith("event", F.lit("BlockPoolCheck")), F.col("detail")))
    return rows.select(
        *others,
        "ts",
        "event",
        pool.alias("pool_id"),
        block(2).try_cast("bigint").alias("block_id"),
        block(3).try_cast("bigint").alias("length"),
        block(4).try_cast("bigint").alias("gen_stamp"),
        "detail",
    )


def report_lines(events: DataFrame) -> DataFrame:
    """The text form of report rows."""
    return events.select(
        F.concat_ws(" ", F.date_format("ts", REPORT_TIME), "event", "detail").alias("value")
    )


def action_events(batches: DataFrame, run_id: str, ts, debug: bool) -> DataFrame:
    """Report rows of a batched plan: one per delete and restore, one per backup batch.

    A batch row lists its blocks when `debug` is set and only their number otherwise, so the normal report never
    carries the blocks across the shuffle.
    """
    stamp = F.lit(ts).cast("timestamp")
    text = block_text()
    single = batches.filter(F.col("action") != "backup").select(
        F.when(F.startswith("action", F.lit("delete")), F.lit("deleteBackupBlock"))
        .otherwise(F.lit("restoreBlock"))
        .alias("event"),
        "pool_id",
        F.col("row_no").alias("seq"),
        F.lit(1).cast("bigint").alias("n_blocks"),
        text.alias("detail"),
    )
    backups = batches.filter(F.col("action") == "backup")
    if debug:
        detail = F.concat_ws(" ", F.array_sort(F.collect_list(text)))
    else:
        detail = F.count("*").cast("string")
    grouped = backups.groupBy("pool_id", F.col("batch_no").alias("seq")).agg(
        F.count("*").alias("n_blocks"), detail.alias("detail")
    )
    requests = grouped.select(F.lit("backupRequestBatch").alias("event"), "pool_id", "seq", "n_blocks", "detail")
    return single.unionByName(requests).select(
        F.lit(run_id).alias("run_id"), stamp.alias("ts"), "seq", "event", "pool_id", "n_blocks", "detail"
    )


def error_events(outcomes: DataFrame, event: str, run_id: str, ts) -> DataFrame:
    """Report rows of what a callback could not do (`ok`, `error`): one per block, under an `...Error` event."""
    return outcomes.filter(~F.col("ok")).select(
        F.lit(run_id).alias("run_id"),
        F.lit(ts).cast("timestamp").alias("ts"),
        F.lit(0).cast("bigint").alias("seq"),
        F.lit(event).alias("event"),
        "pool_id",
        F.lit(1).cast("bigint").alias("n_blocks"),
        F.concat_ws(" ", block_text(), "error").alias("detail"),
    )


def framing_events(pools: DataFrame, run_id: str, ts) -> DataFrame:
    """The rows that open and close a run, each pool in it, and the handling of a pool that one side lacks."""
    spark = pools.sparkSession
    stamp = F.lit(ts).cast("timestamp")
    row = lambda event, pool: [
        F.lit(run_id).alias("run_id"),
        stamp.alias("ts"),
        F.lit(0).cast("bigint").alias("seq"),
        event.alias("event"),
        pool.cast("string").alias("pool_id"),
        F.lit(None).cast("bigint").alias("n_blocks"),
        pool.cast("string").alias("detail"),
    ]
    per_pool = F.explode(
        F.concat(
            F.array(F.lit("startBlockPoolCheck"), F.lit("completeBlockPoolCheck")),
            F.when(~F.col("in_live"), F.array(F.lit("startRestoreAll"), F.lit("completeRestoreAll")))
            .when(~F.col("in_store"), F.array(F.lit("startBackupAll"), F.lit("completeBackupAll")))
            .otherwise(F.array().cast("array<string>")),
        )
    )
    inner = pools.select("pool_id", per_pool.alias("e")).select(*row(F.col("e"), F.col("pool_id")))
    marks = [
        "start",
        "startBlockMetaDataFetchFromNameNode",
        "completeBlockMetaDataFetchFromNameNode",
        "complete",
    ]
    outer = spark.createDataFrame([(m,) for m in marks], "e string").select(*row(F.col("e"), F.lit(None)))
    return outer.unionByName(inner)


def listing_events(blocks: DataFrame, run_id: str, ts, event: str, debug: bool) -> DataFrame:
    """One row per listed block; written only when `debug` is set."""
    rows = blocks.select(
        F.lit(run_id).alias("run_id"),
        F.lit(ts).cast("timestamp").alias("ts"),
        F.lit(0).cast("bigint").alias("seq"),
        F.lit(event).alias("event"),
        "pool_id",
        F.lit(1).cast("bigint").alias("n_blocks"),
        block_text().alias("detail"),
    )
    return rows if debug else rows.limit(0)


def write_report(events: DataFrame, path: str, step: str | None = None, run_id: str | None = None) -> None:
    """Write report rows, a folder for each `step` in one per run, so that old runs can be dropped without a scan.

    A step that is written again replaces its own folder and leaves the run's other steps and other runs alone. Rows
    without a given `step` belong to one named by their event if that is an `...Error`, and to `plan` otherwise. With
    `run_id` the rows are that run's, and no rows are a result too: they empty the given `step`, or all steps that `events` could have written.
    """
    if run_id is not None:
        of_run = events.drop("run_id", "step")
        for name in [step] if step is not None else ["plan", *ERRORS]:
            own = F.lit(True) if step is not None else (_step() == name)
            of_run.filter(own).write.mode("overwrite").parquet(f"{path}/run_id={run_id}/step={name}")
        return
    events = events.withColumn("step", _step() if step is None else F.lit(step))
    writer = events.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
    writer.partitionBy("run_id", "step").parquet(path)


ERRORS = [e for e in EVENTS if e.endswith("Error")]


def _step() -> Column:
    return F.when(F.endswith("event", F.lit("Error")), F.col("event")).otherwise(F.lit("plan"))


def report_runs(spark: SparkSession, path: str) -> DataFrame:
    """The runs that have a report below `path`, as `name` (report.RUN) and `run_id`; one row for each folder."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    found = [f.getPath().getName() for f in files.listStatus(folder)] if files.exists(folder) else []
    runs = [n.removeprefix("run_id=") for n in found if n.startswith("run_id=")]
    return spark.createDataFrame([(REPORT_PREFIX + r, r) for r in runs], "name string, run_id string")


def drop_reports(spark: SparkSession, path: str, now, keep=REPORT_KEEP) -> list[str]:
    """Remove the folders of runs older than `keep` and name them. No report is read; a run whose name is no time stays."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    old = sorted(r["run_id"] for r in prune_reports(report_runs(spark, path), now, keep).collect())
    for run in old:
        files.delete(spark._jvm.org.apache.hadoop.fs.Path(f"{path}/run_id={run}"), True)
    return old


def prune_reports(reports: DataFrame, now, keep=REPORT_KEEP) -> DataFrame:
    """Names of reports older than `keep`; a name that holds no time is left alone."""
    named = reports.filter(F.startswith("name", F.lit(REPORT_PREFIX)))
    stamp = F.try_to_timestamp(F.expr(f"substring(name, {len(REPORT_PREFIX) + 1})"), F.lit(REPORT_TIME))
    limit = micros(F.lit(now).cast("timestamp")) - F.lit(interval_micros(keep))
    return named.filter(micros(stamp) < limit)


def report_summary(events: DataFrame) -> DataFrame:
    """Events per run and pool, one column per event name."""
    return (
        events.groupBy("run_id", "pool_id")
        .pivot("event", EVENTS)
        .agg(F.count(F.lit(1)))
        .na.fill(0, EVENTS)
    )
