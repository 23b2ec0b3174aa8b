"""Bringing stored blocks back."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from blockledger.operators.joins import small_side
from blockledger.operators.reconcile import has, presence
from blockledger.schema import KEY


def restore_candidates(corrupt: DataFrame, store: DataFrame, present: DataFrame, requested: DataFrame) -> DataFrame:
    """Corrupt or missing live blocks with what is to be done about each.

    Corrupt blocks are few against the inventories: when they are counted to be few, the inventories are filtered by
    a broadcast of them and only the hits are shuffled.
    """
    wanted = corrupt.select(*KEY).distinct()
    probe = small_side(wanted)
    near = {
        name: df.select(*KEY).join(probe, KEY, "left_semi")
        for name, df in {"store": store, "present": present, "requested": requested}.items()
    }
    blocks = presence(corrupt=wanted, **near)
    reason = (
        F.when(has(8), "already_requested")
        .when(~has(2), "not_stored")
        .when(has(4), "already_valid")
        .otherwise("restore")
    )
    return blocks.filter(has(1)).select(*KEY, reason.alias("reason"))
