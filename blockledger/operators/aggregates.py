"""Collapsing rows per block: duplicates, versions, replica lists."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from blockledger.schema import ID, KEY


def dedupe(df: DataFrame) -> DataFrame:
    """One row per block; the replicas of its copies are merged and sorted.

    Copies meet one replica at a time and combine before the shuffle, so a block with many copies yields at most
    one row per node that holds it. A block nobody holds keeps a null list.
    """
    if "replicas" not in df.columns:
        return df.select(*KEY).distinct()
    each = df.select(*KEY, F.explode_outer("replicas").alias("r")).distinct()
    return each.groupBy(*KEY).agg(F.collect_list("r").alias("r")).select(
        *KEY, F.when(F.size("r") > 0, F.array_sort("r")).alias("replicas")
    )


def longest_pending(pending: DataFrame, on=tuple(ID)) -> DataFrame:
    """Per block the longest pending version; among equals the one due first."""
    on = list(on)
    rest = [c for c in [*KEY, "due_ts", "force"] if c not in on and c not in ("length", "due_ts")]
    rank = F.struct(
        F.col("length").alias("length"),
        (-F.unix_micros("due_ts")).alias("_due"),
        *[F.col(c).alias(c) for c in rest],
    )
    best = pending.groupBy(*on).agg(F.max(rank).alias("b"), F.count("*").alias("n_pending"))
    return best.select(
        *[F.col(c) if c in on else F.col(f"b.{c}").alias(c) for c in KEY],
        F.timestamp_micros(-F.col("b._due")).alias("due_ts"),
        F.col("b.force").alias("force"),
        "n_pending",
    )


def last_generation(df: DataFrame, on=tuple(ID)) -> DataFrame:
    """Per block the version with the highest generation; among equals the longest."""
    on = list(on)
    rest = [c for c in KEY if c not in on and c not in ("gen_stamp", "length")]
    rank = F.struct("gen_stamp", "length", *rest)
    best = df.groupBy(*on).agg(F.max(rank).alias("b"))
    return best.select(*[F.col(c) if c in on else F.col(f"b.{c}").alias(c) for c in KEY])


def merge_replicas(answers: DataFrame) -> DataFrame:
    """Union of the replica ids several directories answered; failed answers count only when all failed.

    `answers` has the block, `nodes` (array) and `failed`.
    """
    each = answers.select(
        *ID,
        F.coalesce("failed", F.lit(False)).alias("failed"),
        F.explode_outer(F.when(~F.coalesce("failed", F.lit(False)), F.col("nodes"))).alias("node"),
    ).distinct()
    return each.groupBy(*ID).agg(
        F.array_sort(F.collect_set("node")).alias("nodes"), F.min("failed").alias("no_answer")
    )


def replica_lookup(blocks: DataFrame, replicas: DataFrame) -> DataFrame:
    """Each block with the sorted ids of the nodes that hold it; an unknown block has an empty list."""
    lists = replicas.select(*ID, "node").distinct().groupBy(*ID).agg(F.array_sort(F.collect_list("node")).alias("nodes"))
    return blocks.join(lists, ID, "left").withColumn(
        "nodes", F.coalesce("nodes", F.array().cast("array<string>"))
    )
