"""Inventories, events and payloads derived from the given tables. Everything covers the whole tables."""

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from blockledger.functions.columns import BLOCK_TEXT, object_key
from blockledger.schema import ID, KEY
from blockledger.session import checkpoint_dir, size_tasks
from blockledger.sources.inventory import inventory_of, parse_keys, replicas_from_arrays

IGNORED = ["/wh/P", "/wh/F/1997", "/wh/O/19", "/wh/O/2000/12"]
NODES = "supplier"
INVENTORY = ["lineitem", "orders", "customer"]


_WRITTEN = {}


STORED = []


def stored(make):
    """Write the derived table to the shared checkpoint folder on first use and read it from there afterwards.

    Inventories are tables in their own right: jobs read them as such, with column pruning, statistics and pushdown.
    """

    def get(self):
        name = make.__name__
        key = (self.spark.sparkContext.applicationId, self.folder, name)
        if key not in _WRITTEN:
            path = f"{checkpoint_dir(self.spark)}/{name}-{uuid.uuid4().hex}"
            make(self).write.option("compression", "zstd").parquet(path)
            _WRITTEN[key] = path
        if name not in self._read:
            self._read[name] = self.spark.read.parquet(_WRITTEN[key])
        return self._read[name]

    STORED.append(make.__name__)
    return get


def is_written(tables: "Tables", name: str) -> bool:
    return (tables.spark.sparkContext.applicationId, tables.folder, name) in _WRITTEN


class Tables:
    """The given tables, and what is derived from them. Plans only, no data."""

    def __init__(self, spark: SparkSession, folder: str):
        spark.conf.set("spark.sql.session.timeZone", "UTC")
        size_tasks(spark, [f"{folder}/{name}.parquet" for name in INVENTORY])
        self.spark, self.folder, self._read = spark, folder, {}

    def read(self, name: str) -> DataFrame:
        if name not in self._read:
            self._read[name] = self.spark.read.parquet(f"{self.folder}/{name}.parquet")
        return self._read[name]

    # -- inventories ---------------------------------------------------------------------------------------------

    def _lines(self) -> DataFrame:
        orders = self.read("orders").select(
            "o_orderkey",
            F.concat(F.lit("BP-"), F.substring("o_orderpriority", 1, 1)).alias("pool_id"),
            "o_orderstatus",
            F.year("o_orderdate").cast("string").alias("year"),
        )
        joined = self.read("lineitem").join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
        return joined.select(
            "pool_id",
            (F.col("l_orderkey") * 10 + F.col("l_linenumber")).cast("bigint").alias("block_id"),
            (F.floor("l_quantity").cast("bigint") * 1000).alias("length"),
            (1000 + F.col("l_partkey") % 50).cast("bigint").alias("gen_stamp"),
            "l_suppkey",
            "l_partkey",
            "l_returnflag",
            "l_linestatus",
            "l_tax",
            F.concat_ws(
                "/", F.lit("/wh"), "o_orderstatus", "year", F.col("o_orderkey").cast("string")
            ).alias("path"),
        )

    @stored
    def lines(self) -> DataFrame:
        """One row per order line as a block version, with the columns other fixtures need."""
        return self._lines()

    def live_raw(self) -> DataFrame:
        return self.lines().select(*KEY)

    @stored
    def live_flags(self) -> DataFrame:
        """Latest version per block with the flags of its line.

        Lines are read if they have been written; else they are not written for this, and only what it needs of them moves.
        """
        lines = self.lines() if is_written(self, "lines") else self._lines()
        best = F.max(F.struct("gen_stamp", "length", "l_returnflag", "l_linestatus")).alias("b")
        return (
            lines.groupBy(*ID)
            .agg(best)
            .select(*ID, "b.length", "b.gen_stamp", "b.l_returnflag", "b.l_linestatus")
        )

    def live(self) -> DataFrame:
        return self.live_flags().select(*KEY)

    @stored
    def store(self) -> DataFrame:
        """The stored inventory as it differs from live: one generate step over one pass, plus a lost pool."""
        b, n, g = F.col("block_id"), F.col("length"), F.col("gen_stamp")
        entry = lambda block, length, gen: F.struct(
            block.alias("block_id"), length.alias("length"), gen.alias("gen_stamp")
        )
        known = F.col("pool_id") != "BP-5"
        copies = F.array(
            F.when(
                known & (b % 7 != 0),
                entry(b, F.when(b % 13 == 0, n + 1).otherwise(n), F.when(b % 11 == 0, g - 1).otherwise(g)),
            ),
            F.when(known & (b % 17 == 0), entry(b + 1_000_000_000, n, g)),
            F.when(known & (b % 19 == 0), entry(b, n, g - 5)),
        )
        derived = (
            self.live()
            .select("pool_id", F.explode(copies).alias("c"))
            .filter(F.col("c").isNotNull())
            .select("pool_id", "c.block_id", "c.length", "c.gen_stamp")
        )
        lost = self.read("customer").select(
            F.lit("BP-9").alias("pool_id"),
            F.col("c_custkey").cast("bigint").alias("block_id"),
            F.lit(500).cast("bigint").alias("length"),
            F.lit(7).cast("bigint").alias("gen_stamp"),
        )
        return derived.unionByName(lost)

    # -- files ---------------------------------------------------------------------------------------------------

    def _placed(self, rows: DataFrame) -> DataFrame:
        """Lines with their replicas, the lines of a path together: numbers cross the network, not the addresses."""
        host = lambda c: F.concat(
            F.lit("10.0."), F.floor(F.col(c) / 256).cast("string"), F.lit("."), (F.col(c) % 256).cast("string")
        )
        ips = F.when(F.col("l_tax") == 0.08, F.lit(None)).when(F.col("l_tax") == 0.07, F.array().cast("array<string>"))
        ports = F.when(F.col("l_tax") == 0.08, F.lit(None)).when(F.col("l_tax") == 0.07, F.array().cast("array<int>"))
        moved = rows.select("path", *KEY, "l_suppkey", "l_partkey", "l_tax").repartition("path")
        with_hosts = moved.select(
            "path",
            *KEY,
            ips.otherwise(F.array(host("l_suppkey"), host("l_partkey"))).alias("ip_addrs"),
            ports.otherwise(F.array(F.lit(50020), F.lit(50020))).alias("ipc_ports"),
        )
        return replicas_from_arrays(with_hosts)

    def _files(self, rows: DataFrame) -> DataFrame:
        return rows.groupBy("path").agg(F.collect_list(F.struct(*KEY, "replicas")).alias("blocks"))

    @stored
    def files(self) -> DataFrame:
        """Files of the namespace: the lines of an order that were not returned."""
        return self._files(self._placed(self.lines().filter(F.col("l_returnflag") != "R")))

    @stored
    def snapshots(self) -> DataFrame:
        """Files below snapshot folders: lines that were accepted or returned, before and after removal."""
        rows = self.lines().filter(F.col("l_returnflag") != "N")
        return self._files(self._placed(rows.withColumn("path", F.regexp_replace("path", "^/wh/", "/wh/.snapshot/s0/"))))

    def ignore_lines(self) -> DataFrame:
        text = ["# folders left out of the check", *[f" {p}/ " for p in IGNORED], "wh/relative", IGNORED[0]]
        return self.spark.createDataFrame([(t,) for t in text], "value string")

    # -- nodes ---------------------------------------------------------------------------------------------------

    def replicas(self) -> DataFrame:
        return self.lines().select(*ID, F.concat(F.lit("dn-"), F.col("l_suppkey")).alias("node"))

    def nodes(self) -> DataFrame:
        return self.read("supplier").select(F.concat(F.lit("dn-"), F.col("s_suppkey")).alias("node"))

    def node_stats(self) -> DataFrame:
        up = F.col("s_acctbal") >= 0
        val = lambda c: F.when(up, c)
        return self.read("supplier").select(
            F.concat(F.lit("dn-"), F.col("s_suppkey")).alias("node"),
            val((F.col("s_suppkey") % 5).cast("int")).alias("backups_in_progress"),
            val(F.col("s_acctbal")).alias("backup_bytes_per_second"),
            val((F.col("s_suppkey") % 3).cast("int")).alias("restore_blocks"),
            val((F.col("s_suppkey") % 2).cast("int")).alias("restores_in_progress"),
            val(F.col("s_acctbal") / 2).alias("restore_bytes_per_second"),
        )

    # -- restore and validation ----------------------------------------------------------------------------------

    def corrupt(self) -> DataFrame:
        return self.live_flags().filter(F.col("l_returnflag") == "R").select(*KEY)

    def present(self) -> DataFrame:
        return self.live_flags().filter(F.col("l_linestatus") == "O").select(*KEY)

    def requested(self) -> DataFrame:
        return self.live_flags().filter(F.col("length") >= 40_000).select(*KEY)

    def ledger(self) -> DataFrame:
        return self.live_flags().filter(F.col("l_linestatus") == "F").select(*KEY)

    def local(self) -> DataFrame:
        """Finalized blocks on the nodes, with what the node knows about each."""
        return self.live_flags().select(
            *KEY,
            (F.col("l_returnflag") != "R").alias("is_valid"),
            (F.col("length") == 17_000).alias("is_symlink"),
        )

    # -- keys ----------------------------------------------------------------------------------------------------

    def keys(self, prefix=None) -> DataFrame:
        """A full listing with sizes: both halves of each entry, some halves lost, some of a wrong size."""
        n = F.col("length")
        half = F.explode(
            F.filter(
                F.array(
                    F.when(n != 14_000, F.struct(F.lit("meta").alias("half"), F.lit(7).cast("bigint").alias("size"))),
                    F.when(
                        n != 13_000,
                        F.struct(F.lit("data").alias("half"), F.when(n == 37_000, n - 1).otherwise(n).alias("size")),
                    ),
                ),
                lambda h: h.isNotNull(),
            )
        )
        rows = self.store().select(*KEY, half.alias("h"))
        return rows.select(object_key(F.col("h.half"), prefix).alias("key"), F.col("h.size").alias("size"))

    def listing(self) -> DataFrame:
        return inventory_of(parse_keys(self.keys()))

    # -- events --------------------------------------------------------------------------------------------------

    def finalized(self) -> DataFrame:
        return self.read("events").select(
            "event_id",
            F.concat(F.lit("BP-"), (F.col("user_id") % 3).cast("string")).alias("pool_id"),
            F.col("user_id").cast("bigint").alias("block_id"),
            F.floor(F.col("value") * 1000).cast("bigint").alias("length"),
            F.lit(1).cast("bigint").alias("gen_stamp"),
            F.col("ts").cast("timestamp").alias("ts"),
        )

    def queue_events(self) -> DataFrame:
        """Offers to and takes from the queue of each node."""
        offer = F.col("event_type").isin("click", "view", "purchase")
        return self.read("events").select(
            F.col("event_id").alias("seq"),
            F.concat(F.lit("dn-"), (F.col("user_id") % 10).cast("string")).alias("node"),
            F.col("ts").cast("timestamp").alias("ts"),
            F.when(offer, 1).otherwise(-1).cast("bigint").alias("delta"),
        )

    def retry_events(self) -> DataFrame:
        return self.read("events").select(
            F.concat(F.lit("dn-"), (F.col("user_id") % 10).cast("string")).alias("node"),
            F.when(F.col("event_type") == "error", "drop").otherwise("retry").alias("kind"),
            F.floor("value").cast("bigint").alias("amount"),
            F.date_format(F.col("ts").cast("timestamp"), "yyyyMMdd").alias("run"),
        )

    def transfers(self) -> DataFrame:
        return self.read("events").select(
            F.concat(F.lit("dn-"), (F.col("user_id") % 10).cast("string")).alias("node"),
            F.when(F.col("event_type").isin("click", "view"), "backup").otherwise("restore").alias("direction"),
            F.col("ts").cast("timestamp").alias("ts"),
            F.floor(F.col("value") * 1000).cast("bigint").alias("bytes"),
        )

    def report_rows(self) -> DataFrame:
        """One report row per event; the text columns are built from it by the report writer."""
        kind = F.col("event_type")
        name = (
            F.when(kind == "click", "deleteBackupBlock")
            .when(kind == "view", "backupRequestBatch")
            .when(kind == "error", "deleteBackupBlockError")
            .when(kind == "signup", "restoreBlock")
            .otherwise("startBlockPoolCheck")
        )
        pool = F.concat(F.lit("BP-"), (F.col("user_id") % 3).cast("string"))
        block = F.format_string(
            BLOCK_TEXT, pool, F.col("user_id"), F.floor(F.col("value") * 1000).cast("bigint"), F.col("event_id")
        )
        return self.read("events").select(
            F.date_format(F.col("ts").cast("timestamp"), "yyyyMMdd").alias("run_id"),
            F.col("ts").cast("timestamp").alias("ts"),
            name.alias("event"),
            F.when(kind == "purchase", pool)
            .when(kind == "view", F.floor("value").cast("string"))
            .otherwise(block)
            .alias("detail"),
        )

    def report_names(self) -> DataFrame:
        stamp = F.date_format(F.col("ts").cast("timestamp"), "yyyyMMddHHmmss")
        return self.read("events").select(
            F.when(F.col("event_type") == "error", F.concat(F.lit("report.bad"), F.col("event_id")))
            .when(F.col("event_type") == "signup", F.concat(F.lit("other."), stamp))
            .otherwise(F.concat(F.lit("report."), stamp))
            .alias("name")
        )

    # -- payload -------------------------------------------------------------------------------------------------

    def payload(self) -> DataFrame:
        data = F.encode("text", "UTF-8")
        return self.read("documents").select(
            F.col("source").alias("pool_id"),
            F.col("doc_id").cast("bigint").alias("block_id"),
            F.octet_length("text").cast("bigint").alias("length"),
            F.lit(1).cast("bigint").alias("gen_stamp"),
            data.alias("data"),
        )

    def payload_plan(self) -> DataFrame:
        """What is asked to be copied: documents declared by their characters, which is wrong for some, plus pages
        that no node holds."""
        declared = self.read("documents").select(
            F.col("source").alias("pool_id"),
            F.col("doc_id").cast("bigint").alias("block_id"),
            F.when(F.col("lang") == "en", F.octet_length("text")).otherwise(F.col("n_chars")).cast("bigint").alias("length"),
            F.lit(1).cast("bigint").alias("gen_stamp"),
        )
        absent = self.read("pages").select(
            F.lit("pages").alias("pool_id"),
            F.col("page_id").cast("bigint").alias("block_id"),
            F.lit(1).cast("bigint").alias("length"),
            F.lit(1).cast("bigint").alias("gen_stamp"),
        )
        return declared.unionByName(absent)
