"""Which node does the work. All choices are seeded hashes, so a re-run makes the same ones."""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from blockledger.functions.columns import hash32
from blockledger.operators.ranking import number_rows
from blockledger.schema import ID, KEY


def attach_replicas(plan: DataFrame, live: DataFrame) -> DataFrame:
    """Give each row of a plan the replica list of its block."""
    return plan.join(live.select(*KEY, "replicas"), KEY, "left")


def pick_replica(plan: DataFrame, seed=0) -> DataFrame:
    """One replica of each block, evenly spread; null when there is none."""
    held = F.coalesce(F.size("replicas"), F.lit(0)) > 0
    index = F.pmod(hash32(*KEY, F.lit(seed)), F.size("replicas")).cast("int")
    return plan.withColumn("replica", F.when(held, F.get("replicas", index)))


def number_nodes(nodes: DataFrame) -> tuple[DataFrame, int]:
    """The nodes, numbered from 0 in `_no`, and how many there are."""
    names = nodes.select("node").distinct()
    return number_rows(names, [], ["node"], name="_no"), names.count()


def pick_numbered(requests: DataFrame, numbered: DataFrame, total: int, seed=0) -> DataFrame:
    wanted = requests.withColumn("_no", F.pmod(hash32(*KEY, F.lit(seed)), F.lit(max(total, 1))).cast("bigint"))
    return wanted.join(numbered, "_no").drop("_no")


def pick_node(requests: DataFrame, nodes: DataFrame, seed=0) -> DataFrame:
    """One node for each request, evenly spread over all nodes.

    Nodes are numbered and the request's hash picks a number, so this is an equi-join and no list of nodes is ever
    gathered in one place. Without a node there is no request.
    """
    return pick_numbered(requests, *number_nodes(nodes), seed)


def rank_replicas(replicas: DataFrame) -> DataFrame:
    """A seeded order of the nodes of each block; position 0 owns it. Rows per block never exceed its nodes."""
    turn = F.md5(F.concat_ws(":", F.col("block_id").cast("string"), "node"))
    w = Window.partitionBy(*ID).orderBy(turn, "node")
    return replicas.select(*ID, "node").distinct().withColumn("position", (F.row_number().over(w) - 1).cast("bigint"))


def elect_owner(requests: DataFrame, replicas: DataFrame, retry_delay_ms=60_000) -> DataFrame:
    """Per (block, asking node): back up now, wait for one's turn, or force because the node is not listed."""
    ranked = rank_replicas(replicas)
    decided = requests.join(ranked, [*ID, "node"], "left")
    position = F.col("position")
    return decided.withColumn(
        "decision", F.when(position.isNull(), "force").when(position == 0, "backup").otherwise("wait")
    ).withColumn("wait_ms", F.coalesce(position, F.lit(0)) * F.lit(retry_delay_ms))
