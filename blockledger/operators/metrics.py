"""Totals, rates and queue depths."""

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from blockledger.functions.columns import interval_micros, micros, time_slot

TICK = 5  # seconds between updates of the one-minute rate (fixed value)
ALPHA = 1 - math.exp(-TICK / 60)


def gc_totals(store: DataFrame, deletes: DataFrame, errors: DataFrame | None = None) -> DataFrame:
    """Rows and bytes looked at, rows and bytes deleted, batches that failed: always exactly one row."""
    zero = F.lit(0).cast("bigint")
    rows = store.select(F.col("length").alias("seen"), zero.alias("gone"), F.lit("store").alias("kind")).unionByName(
        deletes.select(zero.alias("seen"), F.col("length").alias("gone"), F.lit("delete").alias("kind"))
    )
    if errors is not None:
        rows = rows.unionByName(errors.select(zero.alias("seen"), zero.alias("gone"), F.lit("error").alias("kind")))
    return rows.agg(
        F.count_if(F.col("kind") == "store").alias("store_blocks"),
        F.coalesce(F.sum("seen"), zero).alias("store_bytes"),
        F.count_if(F.col("kind") == "delete").alias("deleted_blocks"),
        F.coalesce(F.sum("gone"), zero).alias("deleted_bytes"),
        F.count_if(F.col("kind") == "error").alias("errors"),
    )


STATS = [
    "backups_in_progress",
    "backup_bytes_per_second",
    "restore_blocks",
    "restores_in_progress",
    "restore_bytes_per_second",
]


def cluster_stats(node_stats: DataFrame) -> DataFrame:
    """Sums over the nodes that answered."""
    up = node_stats.dropna(how="all", subset=STATS)
    return up.agg(*[F.sum(c).alias(c) for c in STATS], F.count("*").alias("nodes"))


def throughput(transfers: DataFrame, now=None) -> DataFrame:
    """One-minute exponentially weighted bytes per second for each node and direction, in closed form.

    A tick that ended `a` ticks ago weighs alpha * (1 - alpha)^a. Without `now` the rate is as of the last transfer
    of each node and direction.
    """
    tick = time_slot(micros("ts"), TICK * 1_000_000)
    sums = transfers.groupBy("node", "direction", tick.alias("tick")).agg(F.sum("bytes").alias("bytes"))
    if now is None:
        last = sums.groupBy("node", "direction").agg(F.max("tick").alias("last"))
        sums = sums.join(last, ["node", "direction"])
    else:
        at = time_slot(micros(F.lit(now)), TICK * 1_000_000)
        sums = sums.withColumn("last", at).filter(F.col("tick") <= F.col("last"))
    weight = F.lit(ALPHA) * F.pow(F.lit(1 - ALPHA), F.col("last") - F.col("tick"))
    return sums.groupBy("node", "direction").agg(
        F.sum(F.col("bytes") / F.lit(TICK) * weight).alias("bytes_per_second"), F.sum("bytes").alias("total_bytes")
    )


def throughput_by_minute(transfers: DataFrame) -> DataFrame:
    return (
        transfers.groupBy("node", "direction", F.window("ts", "1 minute").alias("w"))
        .agg(F.sum("bytes").alias("bytes"), F.count("*").alias("n_transfers"))
        .select("node", "direction", F.col("w.start").alias("minute"), "bytes", "n_transfers")
    )


def retry_drop_metrics(events: DataFrame) -> DataFrame:
    """Retries and drops per node, and how their amounts are spread."""
    return events.groupBy("node").agg(
        F.count_if(F.col("kind") == "retry").alias("retries"),
        F.count_if(F.col("kind") == "drop").alias("drops"),
        F.min("amount").alias("min_amount"),
        F.max("amount").alias("max_amount"),
        *[F.expr(f"percentile_disc(0.{p}) within group (order by amount)").alias(f"p{p}") for p in (50, 95, 99)],
    )


SKETCH_K = 800  # items a sketch keeps on its lowest level
RANK_ERROR = 0.01  # of a quantile, as a share of all amounts: about three times what a sketch of this size has


def amount_sketches(events: DataFrame, by=("node", "run"), amount="amount") -> DataFrame:
    """A quantile sketch of the amounts of each group, some kilobytes however many there are, with count and ends.

    Sketches are made on the map side and merged after the shuffle, so a hot node is no large group. Up to SKETCH_K
    amounts are kept as they are. Null amounts do not count; a group without others has no row.
    """
    value = F.col(amount).cast("bigint")
    return events.filter(F.col(amount).isNotNull()).groupBy(*by).agg(
        F.kll_sketch_agg_bigint(value, SKETCH_K).alias("sketch"),
        F.count("*").alias("n_amounts"),
        F.min(value).alias("min_amount"),
        F.max(value).alias("max_amount"),
    )


def merge_sketches(sketches: DataFrame, by=("node",)) -> DataFrame:
    """The sketches of several runs as one for each group. What was measured is not read again."""
    return sketches.groupBy(*by).agg(
        F.kll_merge_agg_bigint("sketch", SKETCH_K).alias("sketch"),
        F.sum("n_amounts").alias("n_amounts"),
        F.min("min_amount").alias("min_amount"),
        F.max("max_amount").alias("max_amount"),
    )


def sketch_quantiles(sketches: DataFrame, percents=(50, 95, 99)) -> DataFrame:
    """`p50` and so on, each an amount that was seen, whose rank is off by at most RANK_ERROR of all amounts."""
    found = [F.kll_sketch_get_quantile_bigint("sketch", F.lit(p / 100)).alias(f"p{p}") for p in percents]
    return sketches.select(*[c for c in sketches.columns if c != "sketch"], *found)


def queue_depth(events: DataFrame, slot="1 hour") -> DataFrame:
    """Depth of each node's queue after each event (`delta` is +1 for an offer, -1 for a take).

    Time is cut into slots: depths are summed inside a slot and shifted by the total of the slots before it, so a
    busy node is spread over as many tasks as it has slots.
    """
    width = interval_micros(slot)
    rows = events.withColumn("_slot", time_slot(micros("ts"), width))
    totals = rows.groupBy("node", "_slot").agg(F.sum("delta").alias("_total"))
    before = Window.partitionBy("node").orderBy("_slot").rowsBetween(Window.unboundedPreceding, -1)
    shifts = totals.select("node", "_slot", F.coalesce(F.sum("_total").over(before), F.lit(0)).alias("_shift"))
    inside = Window.partitionBy("node", "_slot").orderBy("ts", "seq").rowsBetween(Window.unboundedPreceding, 0)
    return (
        rows.withColumn("_depth", F.sum("delta").over(inside))
        .join(shifts, ["node", "_slot"])
        .select(*events.columns, (F.col("_depth") + F.col("_shift")).alias("depth"))
    )
