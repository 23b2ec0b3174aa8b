"""Restore requests poll by poll: which corrupt blocks are asked for, of which node, and what the nodes have room for.

A poll takes in all sightings of one slot of time. A block is asked for once in it, unless a node took it less than the
time-to-live ago or it is asked for by force. Each request goes to a node drawn for block and poll; a node takes as many
as it has free places, a place being taken for as long as a restore keeps a node busy. What is refused leaves no trace,
so the next sighting asks again, of another node. What polls have to know of one another is thus the requests that were
taken of late, at most the places of all nodes in each poll of that time; they are kept in one folder a poll, and a
poll that is run again replaces its own.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from blockledger.functions.columns import interval_micros, micros, time_slot
from blockledger.operators.assign import number_nodes, pick_numbered
from blockledger.operators.ranking import admit
from blockledger.schema import KEY, RESTORE_CAPACITY, RESTORE_POLL, RESTORE_TTL
from blockledger.session import folder_exists, materialize

REQUESTS = "pool_id string, block_id bigint, length bigint, gen_stamp bigint, requested_ts timestamp, force boolean, node string, accepted boolean"


def polls_of(seen: DataFrame, poll=RESTORE_POLL) -> DataFrame:
    """`seen` (key, ts, force) as one row for each block and poll: its first sighting, and whether any was by force.

    The number of a poll is that of its slot since 1970. A sighting without a time is none.
    """
    slot = time_slot(micros("ts"), interval_micros(poll)).alias("poll")
    known = seen.filter(F.col("ts").isNotNull())
    return known.groupBy(slot, *KEY).agg(F.min("ts").alias("ts"), F.bool_or("force").alias("force"))


def admit_poll(asked: DataFrame, taken: DataFrame, numbered: DataFrame, total: int, now_us: int, *, ttl, busy, capacity, seed) -> DataFrame:
    """One poll: the requests that are made, with node and answer.

    `asked` has key, ts, force; `taken` key, requested_ts, node of requests that were taken before. Nodes are filled in
    the order of time and key.
    """
    known = taken.groupBy(*KEY).agg(F.max(micros("requested_ts")).alias("_last"))
    rows = asked.join(known, KEY, "left")
    open_ = F.col("force") | F.col("_last").isNull() | (F.col("_last") + F.lit(interval_micros(ttl)) <= micros("ts"))
    rows = rows.filter(open_).select(*KEY, F.col("ts").alias("requested_ts"), "force")
    occupied = taken.filter(micros("requested_ts") + F.lit(interval_micros(busy)) > F.lit(now_us))
    occupied = occupied.groupBy("node").agg(F.count("*").alias("in_queue"))
    return admit(pick_numbered(rows, numbered, total, seed), capacity, occupied)


@dataclass
class RestorePolls:
    """The polls of one run or stream, in the folder `path`. `nodes` are numbered, `total` of them."""

    spark: SparkSession
    path: str
    nodes: DataFrame
    total: int
    poll: str
    ttl: str
    busy: str
    capacity: int
    seed: int

    @classmethod
    def over(cls, nodes: DataFrame, path: str, *, poll=RESTORE_POLL, ttl=RESTORE_TTL, busy=None, capacity=RESTORE_CAPACITY, seed=0):
        """`busy` is how long a restore takes its place at a node: until the next poll, unless said otherwise."""
        numbered, total = number_nodes(nodes)
        return cls(nodes.sparkSession, path, materialize(numbered), total, poll, ttl, busy or poll, capacity, seed)

    def _taken(self, poll: int) -> DataFrame:
        """What earlier polls may still tell this one: only those within reach are opened."""
        reach = max(interval_micros(self.ttl), interval_micros(self.busy))
        width = interval_micros(self.poll)
        folders = [f"{self.path}/poll={p}" for p in range(poll - reach // width - 1, poll)]
        folders = [f for f in folders if folder_exists(self.spark, f)]
        if not folders:
            return self.spark.createDataFrame([], REQUESTS)
        return self.spark.read.schema(REQUESTS).parquet(*folders).filter("accepted")

    def take(self, asked: DataFrame, poll: int) -> None:
        """Run one poll. Earlier ones must have been run."""
        now = poll * interval_micros(self.poll)
        requests = admit_poll(
            asked, self._taken(poll), self.nodes, self.total, now,
            ttl=self.ttl, busy=self.busy, capacity=self.capacity, seed=f"{self.seed}:{poll}",
        )
        requests.write.mode("overwrite").parquet(f"{self.path}/poll={poll}")

    def run(self, seen: DataFrame) -> DataFrame:
        """All polls of `seen` (key, ts, force), one after the other, and their requests."""
        folder = f"{self.path}-seen"
        polls_of(seen, self.poll).write.partitionBy("poll").parquet(folder)
        self.take_all(self.spark.read.schema(polls_of(seen, self.poll).schema).parquet(folder))
        return self.requests()

    def take_all(self, asked: DataFrame) -> None:
        """Run the polls in `asked` (poll, key, ts, force) in order; no poll may come in two calls."""
        for (poll,) in asked.select("poll").distinct().sort("poll").collect():
            self.take(asked.filter(F.col("poll") == poll).drop("poll"), poll)

    def requests(self) -> DataFrame:
        if not folder_exists(self.spark, self.path):
            return self.spark.createDataFrame([], REQUESTS)
        return self.spark.read.schema(f"{REQUESTS}, poll bigint").parquet(self.path).drop("poll")
