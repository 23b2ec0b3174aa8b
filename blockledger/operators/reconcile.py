"""Compare the live inventory with the stored one."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from blockledger.operators.joins import small_side
from blockledger.schema import ID, KEY

LIVE, STORE = 1, 2


def named():
    return F.col("pool_id").isNotNull() & F.col("block_id").isNotNull()


def unnamed(df: DataFrame) -> DataFrame:
    """Rows without a pool or a block id. They match nothing, and no comparison has them: look at them on their own."""
    return df.filter(~named())


def presence(**sides: DataFrame) -> DataFrame:
    """One row per distinct block with a bit for each side that holds it (first side 1, second 2, third 4, ...).

    One aggregation does the work of a de-duplication of every side and a full outer join: each row crosses the
    network at most once, and copies of one block collapse before they do. Rows that `unnamed` tells are left out.
    """
    # Keys are not null here. Saying so once more keeps the planner from adding null filters to some of the branches that read this
    # aggregation, so that they all share one exchange.
    pool, block = F.coalesce("pool_id", F.lit("")), F.coalesce("block_id", F.lit(-1))
    tagged = None
    for i, df in enumerate(sides.values()):
        side = df.filter(named()).select(
            pool.alias("pool_id"), block.alias("block_id"), "length", "gen_stamp", F.lit(1 << i).alias("sides")
        )
        tagged = side if tagged is None else tagged.unionByName(side)
    return tagged.groupBy(*KEY).agg(F.bit_or("sides").alias("sides"))


def has(bit):
    return F.col("sides").bitwiseAND(F.lit(bit)) != 0


def reconcile(live: DataFrame, store: DataFrame, unknown_only=False) -> DataFrame:
    """The plan: what is in sync, what to back up, what to delete, what to restore.

    in_sync        the same block on both sides
    backup         only live
    delete_stale   only stored, and another version of the block is live
    delete_orphan  only stored, the block is not live, its pool is
    restore        only stored, and the whole pool is absent from live: nothing of it is ever deleted

    With `unknown_only`, a restore is left out when the bare block id is live in any pool.
    """
    return _actions(presence(live=live, store=store), live, unknown_only)


def reconcile_kept(live: DataFrame, store: DataFrame, unknown_only=False) -> DataFrame:
    """`reconcile` of two inventories kept by `keep_inventory` with equally many buckets: neither crosses the network.

    Each bucket of one side meets that of the other on the executor that reads them. Only rows found on the stored
    side alone are then looked up elsewhere. Kept inventories hold a block once and none without a name.
    """
    return _actions(presence_kept(live, store), live, unknown_only)


def presence_kept(live: DataFrame, store: DataFrame) -> DataFrame:
    here = live.select(*KEY, F.lit(LIVE).alias("_live"))
    there = store.select(*KEY, F.lit(STORE).alias("_store"))
    sides = F.coalesce("_live", F.lit(0)) + F.coalesce("_store", F.lit(0))
    return here.join(there, KEY, "full").select(*KEY, sides.alias("sides"))


def _actions(blocks: DataFrame, live: DataFrame, unknown_only: bool) -> DataFrame:
    current = blocks.filter(has(LIVE)).select(
        *KEY, F.when(has(STORE), F.lit("in_sync")).otherwise(F.lit("backup")).alias("action")
    )
    stored_only = blocks.filter(F.col("sides") == STORE).drop("sides")
    # The lookups scan one or two columns of live again, which is cheaper than aggregating all blocks once more. They
    # carry no broadcast hints: the adaptive planner measures them and else splits the hot side of a sort-merge join. The
    # pools are few and are counted: blocks never move by a key that has a handful of values.
    ids = live.select(*ID).distinct().withColumn("_id_live", F.lit(True))
    pools = small_side(live.filter(named()).select("pool_id").distinct()).withColumn("_pool_live", F.lit(True))
    flagged = stored_only.join(ids, ID, "left").join(pools, "pool_id", "left")
    if unknown_only:
        anywhere = live.select("block_id").distinct().withColumn("_known", F.lit(True))
        flagged = flagged.join(anywhere, "block_id", "left").filter(
            F.col("_pool_live").isNotNull() | F.col("_known").isNull()
        )
    extra = flagged.select(
        *KEY,
        F.when(F.col("_pool_live").isNull(), F.lit("restore"))
        .when(F.col("_id_live"), F.lit("delete_stale"))
        .otherwise(F.lit("delete_orphan"))
        .alias("action"),
    )
    return current.unionByName(extra)


def pools(live: DataFrame, store: DataFrame) -> DataFrame:
    """All pools on either side, and on which."""
    tagged = live.select("pool_id", F.lit(LIVE).alias("sides")).unionByName(
        store.select("pool_id", F.lit(STORE).alias("sides"))
    )
    flags = tagged.groupBy("pool_id").agg(F.bit_or("sides").alias("sides"))
    return flags.select("pool_id", has(LIVE).alias("in_live"), has(STORE).alias("in_store"))


def pool_actions(live: DataFrame, store: DataFrame) -> DataFrame:
    """The rule for whole pools: lost from live means restore, absent from the store means back up everything."""
    rule = (
        F.when(~F.col("in_live"), "restore_all").when(~F.col("in_store"), "backup_all").otherwise("compare")
    )
    return pools(live, store).withColumn("rule", rule)


def restore_unknown(store: DataFrame, live: DataFrame) -> DataFrame:
    """Blocks of lost pools whose bare id the namespace does not know under any pool."""
    pools = small_side(live.filter(named()).select("pool_id").distinct())
    lost = store.filter(named()).select(*KEY).join(pools, "pool_id", "left_anti")
    return lost.join(live.select("block_id").distinct(), "block_id", "left_anti").select(*KEY).distinct()


def gc(store: DataFrame, live: DataFrame, match_on="key") -> DataFrame:
    """Stored entries without a live owner. `match_on='block_id'` keeps every version of an id that is live."""
    on = {"key": KEY, "block_id": ["block_id"]}[match_on]
    owners = live.select(*on).distinct()
    return store.select(*KEY).join(owners, on, "left_anti").select(*KEY)


def in_sync(live: DataFrame, store: DataFrame) -> DataFrame:
    return live.select(*KEY).intersect(store.select(*KEY))


def missing(live: DataFrame, store: DataFrame) -> DataFrame:
    return live.select(*KEY).subtract(store.select(*KEY))


def orphans(store: DataFrame, live: DataFrame) -> DataFrame:
    return store.select(*KEY).subtract(live.select(*KEY))
