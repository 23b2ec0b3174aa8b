"""Block lists as JSON: one block per text, or many blocks per text."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from blockledger.operators.ranking import assign_batches
from blockledger.schema import KEY

# Field names of the JSON form.
ONE = "poolId string, blkid bigint, len bigint, genstamp bigint"
MANY = f"blocks array<struct<{ONE.replace(' ', ':')}>>".replace(",:", ",")


def _json_block():
    return F.struct(
        F.col("pool_id").alias("poolId"),
        F.col("block_id").alias("blkid"),
        F.col("length").alias("len"),
        F.col("gen_stamp").alias("genstamp"),
    )


def _columns(block):
    return [
        block["poolId"].alias("pool_id"),
        block["blkid"].alias("block_id"),
        block["len"].alias("length"),
        block["genstamp"].alias("gen_stamp"),
    ]


def to_json_blocks(blocks: DataFrame) -> DataFrame:
    return blocks.select(F.to_json(_json_block()).alias("json"))


def from_json_blocks(texts: DataFrame) -> DataFrame:
    return texts.select(*_columns(F.from_json("json", ONE)))


def write_manifest(blocks: DataFrame, n: int) -> DataFrame:
    """At most `n` blocks of one pool per text."""
    batches = assign_batches(blocks.select(*KEY), n, by=["pool_id"])
    lists = batches.groupBy("pool_id", "batch_no").agg(
        F.array_sort(F.collect_list(_json_block())).alias("blocks")
    )
    return lists.select("pool_id", "batch_no", F.to_json(F.struct("blocks")).alias("json"))


def read_manifest(manifests: DataFrame) -> DataFrame:
    lists = manifests.select(F.explode(F.from_json("json", MANY)["blocks"]).alias("b"))
    return lists.select(*_columns(F.col("b")))
