"""Work done per micro-batch: retries, incremental validation, throughput, paged clean-up.

Each handler writes under a folder named after the micro-batch and replaces it when the batch is run again, so a lost
executor or a restart repeats work without doubling results.
"""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from blockledger.functions.columns import interval_micros, micros
from blockledger.operators.callbacks import apply_deletes_with
from blockledger.operators.ranking import assign_batches
from blockledger.operators.reconcile import gc
from blockledger.operators.validate import to_validate
from blockledger.schema import BLOCK, DELETE_BATCH, KEY, PAGE_SIZE, RETRY_DELAY
from blockledger.session import folder_exists
from blockledger.sources.inventory import store_from_keys


def retry_step(results: DataFrame, now, delay=RETRY_DELAY, max_attempts=None) -> DataFrame:
    """What becomes of each attempted request (`ok`, `attempt`): done, tried again at `due_ts` with force, or given up."""
    again = ~F.col("ok")
    if max_attempts is not None:
        state = F.when(F.col("ok"), "done").when(F.col("attempt") + 1 >= max_attempts, "given_up").otherwise("retry")
    else:
        state = F.when(F.col("ok"), "done").otherwise("retry")
    later = F.timestamp_micros(micros(F.lit(now)) + F.lit(interval_micros(delay)))
    return results.select(
        *KEY,
        state.alias("state"),
        F.when(again, F.col("attempt") + 1).otherwise(F.col("attempt")).cast("int").alias("attempt"),
        F.when(state == "retry", later).alias("due_ts"),
        (F.col("force") | (state == "retry")).alias("force"),
    )


def with_retries(attempt, path: str, clock, delay=RETRY_DELAY, max_attempts=None):
    """A foreachBatch handler: new requests and the retries that are due go through `attempt(df) -> df with ok`.

    A request is tried until it succeeds, unless `max_attempts` says after how many it is given up.

    `clock(batch_id)` gives the time of a batch as a datetime: the same one when the batch is repeated, and never an
    earlier one for a later batch. All retries of a batch are due `delay` after its time, in exactly one later batch, the
    first whose time has reached it. So each batch opens only the folders of the batches whose retries fell due since
    the one before, however many there have been.
    """

    def handle(batch: DataFrame, batch_id: int) -> None:
        spark, now = batch.sparkSession, clock(batch_id)
        fresh = batch.select(
            *KEY, F.lit(0).alias("attempt"), F.col("force") if "force" in batch.columns else F.lit(False).alias("force")
        )
        folders = [f"{path}/batch_id={b}" for b in due_batches(batch_id, clock, delay)]
        folders = [f for f in folders if folder_exists(spark, f)]
        if folders:
            earlier = spark.read.schema(RETRY_STATE).parquet(*folders)
            fresh = fresh.unionByName(earlier.filter(F.col("state") == "retry").select(*fresh.columns))
        states = retry_step(attempt(fresh), now, delay, max_attempts)
        states.write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")

    return handle


RETRY_STATE = T.StructType(
    [
        *BLOCK.fields,
        T.StructField("state", T.StringType()),
        T.StructField("attempt", T.IntegerType()),
        T.StructField("due_ts", T.TimestampType()),
        T.StructField("force", T.BooleanType()),
    ]
)


def due_batches(batch_id: int, clock, delay=RETRY_DELAY) -> list[int]:
    """The earlier batches whose retries are due in this one: by its time, and not yet by that of the batch before it.

    What the batch before left is due here with no delay at all, too. Times never fall, so the search ends at the first
    batch whose retries were due before.
    """
    due = lambda b: instant(clock(b)) + interval_micros(delay)
    found, last = [], batch_id - 1
    for b in range(last, -1, -1):
        if b < last and due(b) <= instant(clock(last)):
            break
        if due(b) <= instant(clock(batch_id)):
            found.append(b)
    return found


def instant(ts) -> int:
    """Microseconds of a datetime, as a column made of it has them."""
    return round(ts.timestamp() * 1_000_000)


def read_states(spark: SparkSession, path: str, before=None):
    if not folder_exists(spark, path):
        return None
    rows = spark.read.option("basePath", path).parquet(path)
    return rows if before is None else rows.filter(F.col("batch_id") < before)


def stream_throughput(transfers: DataFrame, delay="1 minute") -> DataFrame:
    """Bytes per minute, node and direction."""
    return (
        transfers.withWatermark("ts", delay)
        .groupBy("node", "direction", F.window("ts", "1 minute").alias("w"))
        .agg(F.sum("bytes").alias("bytes"), F.count("*").alias("n_transfers"))
        .select("node", "direction", F.col("w.start").alias("minute"), "bytes", "n_transfers")
    )


def incremental_validate(check, ledger_path: str, ledger: DataFrame | None = None):
    """A foreachBatch handler that passes only blocks not in the ledger to `check(df) -> df of checked blocks`."""

    def handle(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        seen = read_states(spark, ledger_path, before=batch_id)
        seen = spark.createDataFrame([], BLOCK) if seen is None else seen.select(*KEY)
        if ledger is not None:
            seen = seen.unionByName(ledger.select(*KEY))
        checked = check(to_validate(batch, seen))
        checked.select(*KEY).write.mode("overwrite").parquet(f"{ledger_path}/batch_id={batch_id}")

    return handle


def gc_pages(store: DataFrame, live: DataFrame, n=PAGE_SIZE, match_on="key") -> DataFrame:
    """Deletes in pages of at most `n` blocks per pool, found in one pass over the whole store."""
    deletes = gc(store, live, match_on)
    return assign_batches(deletes, n, by=["pool_id"]).withColumnRenamed("batch_no", "page")


def run_gc_pages(fn, pages: DataFrame, done: DataFrame | None = None) -> DataFrame:
    """Carry pages out on the executors; a failed page does not stop the others.

    `done` is what earlier calls returned. Blocks carried out then are left out by their own keys, not by page: a page
    that is computed again may hold other blocks under the same number.
    """
    if done is not None:
        pages = pages.join(done.filter("ok").select(*KEY).distinct(), KEY, "left_anti")
    return apply_deletes_with(fn, pages, by=("pool_id", "page"))


def collect_garbage(live: DataFrame, fn, path: str, match_on="key", prefix=None):
    """A foreachBatch handler for a stream of listed keys: each page is compared with `live` and its garbage given to `fn`.

    What was carried out is written below `path`, a folder for each page. A page that was done before a restart is not
    done again; one that failed is told of and does not stop those after it.
    """

    def handle(page: DataFrame, batch_id: int) -> None:
        folder = f"{path}/page={batch_id}"
        if folder_exists(page.sparkSession, f"{folder}/_SUCCESS"):
            return
        deletes = gc(store_from_keys(page, prefix), live, match_on).withColumn("action", F.lit("delete"))
        done = apply_deletes_with(fn, assign_batches(deletes, DELETE_BATCH))
        done.write.mode("overwrite").parquet(folder)

    return handle
