"""Row numbers and batches per group that never sort a whole group in one task."""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from blockledger.schema import KEY

PART_DIGITS = 2  # hexadecimal digits of a part's name: 256 parts


def number_rows(df: DataFrame, group: list[str], order: list[str], digits=PART_DIGITS, name="row_no") -> DataFrame:
    """Number the rows of each group 0, 1, 2, ... without gaps.

    A group is cut into 16^digits even parts by a hash of `order`, which must tell its rows apart. Rows are numbered
    inside their part and shifted by the size of the parts before it; those sizes are at most 16^digits rows per
    group, however large the group is. The order is (part, *order).
    """
    text = F.concat_ws(":", *[F.col(c).cast("string") for c in order])
    part = F.substring(F.md5(text), 1, digits)
    part = F.coalesce(part, F.lit(""))  # never null: joining on it adds no filters below a shared exchange
    rows = df.withColumn("_part", part)
    sizes = rows.groupBy(*group, "_part").agg(F.count("*").alias("_size"))
    before = Window.partitionBy(*(group or [F.lit(0)])).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    shifts = sizes.select(*group, "_part", F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_shift"))
    inside = Window.partitionBy(*group, "_part").orderBy(*order)
    return (
        rows.withColumn("_rank", F.row_number().over(inside) - 1)
        .join(shifts, [*group, "_part"])
        .withColumn(name, (F.col("_rank") + F.col("_shift")).cast("bigint"))
        .select(*df.columns, name)
    )


def assign_batches(plan: DataFrame, n: int, by=("pool_id", "action"), order=KEY) -> DataFrame:
    """Cut each group of a plan into batches of `n` rows (the last one may be shorter)."""
    numbered = number_rows(plan, list(by), list(order))
    return numbered.withColumn("batch_no", F.floor(F.col("row_no") / F.lit(n)).cast("bigint"))


def sort_inventory(df: DataFrame) -> DataFrame:
    """Total order by pool, block, generation, length: range partitions, each sorted and spilled on its own."""
    order = ["pool_id", "block_id", "gen_stamp", "length"]
    return df.repartitionByRange(*order).sortWithinPartitions(*order)


def next_due(pending: DataFrame, now, k: int) -> DataFrame:
    """The `k` entries that have been due longest at `now`."""
    return pending.filter(F.col("due_ts") <= F.lit(now).cast("timestamp")).orderBy("due_ts", *KEY).limit(k)


def admit(requests: DataFrame, capacity: int, occupied: DataFrame | None = None) -> DataFrame:
    """Accept the first requests of each node while it has room and refuse the rest.

    Only `capacity` rows per node survive the rank filter, and the planner applies it before the shuffle as well, so
    a node that is asked for a third of all rows costs no more than any other. The accepted rows are then marked by
    a join on the whole request key. Equal requests are one request: they take one slot and get the same answer. A
    request without a time is refused and takes none.
    """
    keys = ["node", "requested_ts", *KEY]
    w = Window.partitionBy("node").orderBy("requested_ts", *KEY)
    timed = requests.filter(F.col("requested_ts").isNotNull()).select(*keys).distinct()
    first = timed.withColumn("_rank", F.row_number().over(w)).filter(F.col("_rank") <= F.lit(capacity))
    if occupied is not None:
        first = first.join(occupied.select("node", "in_queue"), "node", "left").filter(
            F.col("_rank") <= F.lit(capacity) - F.coalesce("in_queue", F.lit(0))
        )
    accepted = first.select(*keys, F.lit(True).alias("_accepted"))
    return requests.join(accepted, keys, "left").select(
        *requests.columns, F.coalesce("_accepted", F.lit(False)).alias("accepted")
    )
