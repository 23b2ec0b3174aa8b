"""Intermediate tables and output files in the folder that the whole cluster shares."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from blockledger.session import checkpoint_dir


def shared_path(spark: SparkSession, name: str) -> str:
    """A new place under spark.checkpoint.dir. Every call gives another one."""
    return f"{checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def staged(df: DataFrame, name: str, drop_shuffles: bool = False) -> DataFrame:
    """Write `df` to the shared folder as Parquet and read it back: lineage ends there and survives lost executors.

    With `drop_shuffles` the write's shuffle files go as soon as it has ended, not when the driver collects its garbage.
    """
    spark, path = df.sparkSession, shared_path(df.sparkSession, name)
    before = spark.conf.get(FILE_CLEANUP, None)
    if drop_shuffles:
        spark.conf.set(FILE_CLEANUP, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        if drop_shuffles:
            spark.conf.unset(FILE_CLEANUP) if before is None else spark.conf.set(FILE_CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


FILE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shuffle_parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def open_store(uri: str):
    """The file system and path of an output folder, for tasks that write files of a format Spark has no writer for."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else f"file://{uri}")


def free_of(df: DataFrame, *names: str) -> DataFrame:
    """`df` without its columns of these names, in upper or lower case: an operator's own columns take their place."""
    return df.drop(*[c for c in df.columns if c.lower() in names])


def keyed(docs: DataFrame) -> DataFrame:
    """Adds `_key`, a number that names a document by its doc_id and text; it is never null."""
    return docs.withColumn("_key", F.xxhash64(F.col("doc_id").cast("long"), F.lit("|"), F.xxhash64("text")))


def chunked(df: DataFrame, name: str, size: int = 4 << 20) -> DataFrame:
    """A copy of `df` in the shared folder with `chunk`, the same number for rows with about `size` bytes of `text`.

    Chunks are cut where the rows are read, so nothing moves; one row may be larger. The copy is dealt out by chunk: work
    on whole chunks, and joins with what is known of each, do not move it either.
    """
    columns, at = ["chunk", *df.columns], df.columns.index("text")

    def cut(batches):
        import pyarrow as pa
        import pyarrow.compute as pc
        from pyspark import TaskContext

        chunk, held = TaskContext.get().partitionId() << 32, 0
        for batch in batches:
            sizes = pc.fill_null(pc.binary_length(batch.column(at)), 0)
            total = sizes.to_numpy(zero_copy_only=False).astype("int64").cumsum() + held
            chunks = pa.array(chunk + (total - 1).clip(0) // size)
            held = int(total[-1]) if len(total) else held
            yield pa.RecordBatch.from_arrays([chunks, *batch.columns], names=columns)

    tagged = df.mapInArrow(cut, StructType([StructField("chunk", LongType()), *df.schema.fields]))
    return _dealt(tagged, "chunk", name)


def bucketed(df: DataFrame, column: str, name: str) -> DataFrame:
    """A copy of `df` in the shared folder, dealt out by `column`, so that later joins on it do not move it again."""
    return _dealt(df.repartition(shuffle_parts(df.sparkSession), column), column, name)


def _dealt(df: DataFrame, column: str, name: str) -> DataFrame:
    spark = df.sparkSession
    path = shared_path(spark, name)
    table = "kept_" + path[-32:]
    writer = df.write.format("parquet").option("compression", "zstd").option("path", path)
    writer.bucketBy(shuffle_parts(spark), column).saveAsTable(table)
    return spark.table(table)


COPIES = 1 << 16  # of one row that a task writes out


def repeated(counted: DataFrame, *by: str) -> DataFrame:
    """Every row of `counted` `copies` times, told apart by `copy`. Many copies of one row are written by many tasks.

    `by` names columns by which blocks of copies are dealt out where there are more than a task should write.
    """
    blocks = F.sequence(F.lit(0).cast("long"), F.expr(f"(copies - 1) div {COPIES}"))
    many = counted.withColumn("_block", F.explode(blocks))
    if not counted.where(F.col("copies") > COPIES).isEmpty():
        many = many.repartition(shuffle_parts(counted.sparkSession), *by, "_block")
    last = F.least(F.col("copies"), (F.col("_block") + 1) * COPIES) - 1
    return many.withColumn("copy", F.explode(F.sequence(F.col("_block") * COPIES, last))).drop("_block", "copies")
