"""Where the two inventories come from: the namespace (files, snapshots) and the store (keys or files)."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from blockledger.functions.columns import normal_path, object_key
from blockledger.schema import KEY, PAGE_SIZE
from blockledger.sources.objects import walk


def live_blocks(files: DataFrame) -> DataFrame:
    """Flatten files into their blocks, keeping the path and the replica list of each block."""
    return files.select("path", F.explode("blocks").alias("b")).select(
        "path", *[F.col(f"b.{c}").alias(c) for c in KEY], F.col("b.replicas").alias("replicas")
    )


def with_snapshots(live: DataFrame, snapshot_files: DataFrame) -> DataFrame:
    """Add the blocks that are reachable through snapshot directories."""
    return live.unionByName(live_blocks(snapshot_files))


def replicas_from_arrays(df: DataFrame, ips="ip_addrs", ports="ipc_ports") -> DataFrame:
    """Two parallel arrays become one array of (ip, port)."""
    pairs = F.arrays_zip(F.col(ips).alias("ip"), F.col(ports).alias("port"))
    pairs = F.transform(pairs, lambda p: F.struct(p["ip"].alias("ip"), p["port"].cast("int").alias("port")))
    return df.withColumn("replicas", pairs).drop(ips, ports)


def parse_keys(keys: DataFrame, prefix=None, half=None) -> DataFrame:
    """Object keys to inventory rows. Rows that do not follow the layout keep `error` filled and no key columns.

    The exact prefix is stripped, however many segments it has. The split is a row of its own (`inline_outer`), or else
    the optimiser would split the key again for every column and every condition on one.
    """
    key = F.col("key")
    if prefix:
        head = prefix.strip("/") + "/"
        inside = F.startswith(key, F.lit(head))
        rest = F.when(inside, F.substring(key, F.lit(len(head) + 1), F.length(key)))
    else:
        rest = key
    part = F.col("_part")
    number = lambda i: F.get(part, F.lit(i)).try_cast("bigint")
    parsed = keys.select("*", F.inline_outer(F.array(F.struct(F.split(rest, "/").alias("_part"))))).select(
        *keys.columns,
        part,
        F.get(part, F.lit(0)).alias("half"),
        F.get(part, F.lit(1)).alias("pool_id"),
        number(2).alias("block_id"),
        number(4).alias("length"),
        number(3).alias("gen_stamp"),
        F.size(part).alias("_n"),
    )
    fault = (
        F.when(part.isNull(), "prefix")
        .when(F.col("_n") != 5, "segments")
        .when(~F.col("half").isin("meta", "data"), "half")
        .when(F.col("pool_id") == "", "pool")
        .when(F.col("block_id").isNull() | F.col("gen_stamp").isNull() | F.col("length").isNull(), "number")
    )
    parsed = parsed.withColumn("error", fault).drop("_n")
    if half:
        parsed = parsed.filter(F.col("error").isNotNull() | (F.col("half") == half))
    bad = F.col("error").isNotNull()
    return parsed.select(
        *keys.columns, *[F.when(~bad, F.col(c)).alias(c) for c in ["half", *KEY]], "error"
    )


def inventory_of(parsed: DataFrame) -> DataFrame:
    return parsed.filter(F.col("error").isNull())


def store_from_keys(keys: DataFrame, prefix=None) -> DataFrame:
    """The store's inventory: one entry per `meta` key; the payload objects are never looked at."""
    head = (prefix.strip("/") + "/meta/") if prefix else "meta/"
    listing = keys.filter(F.startswith("key", F.lit(head)))
    return inventory_of(parse_keys(listing.select("key"), prefix)).select(*KEY)


def list_files(spark: SparkSession, root: str) -> DataFrame:
    """Names and sizes of the data files below `root`; contents are never read.

    An empty data file is a block only if its side file is there and has something in it.
    """
    listed = walk(spark, root)
    data = listed.filter(F.endswith("path", F.lit(".data")))
    side = listed.filter(F.endswith("path", F.lit(".meta")) & (F.col("length") > 0))
    side = side.select(F.regexp_replace("path", r"\.meta$", ".data").alias("path"))
    empty = data.filter("length = 0").join(side, "path", "left_semi")
    return data.filter("length > 0").unionByName(empty)


def parse_files(listing: DataFrame) -> DataFrame:
    """`.../pool/block_generation.data` plus the size to inventory rows; other names get `error`."""
    name = F.substring_index("path", "/", -1)
    above = F.substring(F.col("path"), F.lit(1), F.length("path") - F.length(name) - 1)
    pool = F.when(name == "", "").otherwise(F.substring_index(above, "/", -1))
    part = F.split(F.substring_index(name, ".", 1), "_")
    block, gen = F.get(part, F.lit(0)).try_cast("bigint"), F.get(part, F.lit(1)).try_cast("bigint")
    fault = (
        F.when(pool == "", "pool")
        .when(~F.contains(name, F.lit(".")), "name")
        .when(block.isNull() | gen.isNull(), "number")
    )
    ok = fault.isNull()
    return listing.select(
        "path",
        F.when(ok, pool).alias("pool_id"),
        F.when(ok, block).alias("block_id"),
        F.when(ok, F.col("length").cast("bigint")).alias("length"),
        F.when(ok, gen).alias("gen_stamp"),
        fault.alias("error"),
    )


def store_from_files(listing: DataFrame) -> DataFrame:
    """The inventory of a directory store: one entry per `.data` file, length = file size."""
    return inventory_of(parse_files(listing.filter(F.endswith("path", F.lit(".data"))))).select(*KEY)


def keep_inventory(df: DataFrame, table: str, buckets: int | None = None) -> DataFrame:
    """Write the distinct blocks of an inventory as a table bucketed and sorted by block key, and read it.

    Two inventories with equally many buckets are compared without moving either. There are as many buckets as shuffle
    partitions unless told otherwise; then a bucket is one file, since the exchange that finds the distinct blocks has
    dealt them out. Blocks without a pool or an id, which match nothing, are left out. An older table of that name goes.
    """
    spark = df.sparkSession
    buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    blocks = df.filter(F.col("pool_id").isNotNull() & F.col("block_id").isNotNull()).select(*KEY).distinct()
    blocks.write.mode("overwrite").format("parquet").bucketBy(buckets, *KEY).sortBy(*KEY).saveAsTable(table)
    return spark.table(table)


def list_after(store: DataFrame, after_key=None, n=PAGE_SIZE, prefix=None) -> DataFrame:
    """The next `n` entries in key order after `after_key` (from the start when null)."""
    keyed = store.select(object_key("meta", prefix).alias("key"), *KEY)
    if after_key is not None:
        keyed = keyed.filter(F.col("key") > F.lit(after_key))
    return keyed.orderBy("key").limit(n)


def ignore_list(spark: SparkSession, path: str) -> DataFrame:
    """Paths to leave out, one per line; lines not starting with '/' are comments; no file means no paths."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop):
        return spark.createDataFrame([], "path string")
    return parse_ignore(spark.read.text(path))


def parse_ignore(lines: DataFrame) -> DataFrame:
    line = F.trim("value")
    return lines.filter(F.startswith(line, F.lit("/"))).select(normal_path(line).alias("path")).distinct()
