"""Session set-up for local runs, and lineage cuts that survive the loss of an executor."""

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(cpus="*", partitions=8, name="blockledger", **conf):
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(name)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", conf.pop("driver_memory", "8g"))
        .config("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    )
    for key, value in conf.items():
        builder = builder.config(key, value)
    session = builder.getOrCreate()
    session.sparkContext.setLogLevel("ERROR")
    return session


ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder the cluster names in spark.checkpoint.dir; a scratch folder in local mode only."""
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.sparkContext.getCheckpointDir()
    if named:
        return named
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that every executor can reach")
    scratch = tempfile.mkdtemp(prefix="blockledger-ckpt-")
    spark.sparkContext.setCheckpointDir(scratch)
    return scratch


def materialize(df: DataFrame) -> DataFrame:
    """Write `df` to the checkpoint folder once, so that several consumers read it instead of recomputing it."""
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark).rstrip('/')}/kept-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


SHUFFLED = 8 << 20  # bytes a task gets from a shuffle; sorted or hashed they are some twenty times that
SCANNED = 16 << 20  # bytes of files a task reads


def size_tasks(spark: SparkSession, paths: list[str]) -> None:
    """Let the number of tasks follow the input, so that what one of them holds in memory stays the same.

    By itself Spark makes as few partitions as there are cores, up to 64 MB each, and at most the number set. Settings
    that ask for smaller tasks or more of them stay as they are.
    """
    total = sum(folder_bytes(spark, p) for p in paths)
    for name, most in (("spark.sql.adaptive.advisoryPartitionSizeInBytes", SHUFFLED), ("spark.sql.files.maxPartitionBytes", SCANNED)):
        if spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(name)) > most:
            spark.conf.set(name, str(most))
    wanted = 2 * total // SHUFFLED  # what is shuffled at once is up to twice what was read, as both are compressed
    if wanted > int(spark.conf.get("spark.sql.shuffle.partitions")):
        spark.conf.set("spark.sql.shuffle.partitions", str(wanted))


def folder_bytes(spark: SparkSession, path: str) -> int:
    """Bytes of a file or of all files below a folder; none if it is not there."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    system = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    return system.getContentSummary(folder).getLength() if system.exists(folder) else 0


def folder_exists(spark: SparkSession, path: str) -> bool:
    """Whether a folder is there, in whatever store its path names."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    return folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder)
