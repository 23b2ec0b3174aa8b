"""What may be looked at, backed up or trusted."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from blockledger.functions.columns import below_any, normal_path, parent_path, path_ancestors
from blockledger.operators.joins import small_side
from blockledger.schema import KEY

# An ignore list is a hand-written file; up to this many paths go into the filter itself.
INLINE_PATHS = 1_000


def drop_ignored(files: DataFrame, ignore: DataFrame, inline=INLINE_PATHS) -> DataFrame:
    """Drop files whose path, or any directory above it, is on the ignore list.

    A short list becomes a filter without any join or shuffle, applied before the block lists are opened. A longer
    one is joined against the distinct directories, which are far fewer than the files. A file without a path lies
    below no directory and stays.
    """
    head = [r["path"] for r in ignore.select("path").distinct().limit(inline + 1).collect()]
    if not head:
        return files
    if len(head) <= inline:
        return files.filter(~F.coalesce(below_any(F.col("path"), head), F.lit(False)))
    listed = ignore.select(F.col("path").alias("_hit")).distinct()
    placed = files.withColumn("_path", normal_path(F.col("path"))).withColumn("_dir", parent_path(F.col("path")))
    folders = placed.select("_dir").distinct()
    bad = (
        folders.select("_dir", F.explode(path_ancestors(F.col("_dir"))).alias("_hit"))
        .join(listed, "_hit", "left_semi")
        .select("_dir")
        .distinct()
    )
    kept = placed.join(small_side(bad), "_dir", "left_anti")
    return kept.join(listed, kept["_path"] == listed["_hit"], "left_anti").select(*files.columns)


def halves(meta: DataFrame, data: DataFrame) -> DataFrame:
    """One row per block that has either half: whether the meta half exists, and the sizes of its data half."""
    m = meta.select(*KEY, F.lit(1).alias("_m"), F.lit(None).cast("bigint").alias("_size"))
    d = data.select(*KEY, F.lit(0).alias("_m"), F.col("size").cast("bigint").alias("_size"))
    return m.unionByName(d).groupBy(*KEY).agg(
        (F.max("_m") == 1).alias("has_meta"), F.max("_size").alias("data_size")
    )


def listed_halves(listing: DataFrame) -> DataFrame:
    """The same from one parsed listing of both halves (`half`, `size`), in one pass."""
    return listing.groupBy(*KEY).agg(
        (F.max((F.col("half") == "meta").cast("int")) == 1).alias("has_meta"),
        F.max(F.when(F.col("half") == "data", F.col("size").cast("bigint"))).alias("data_size"),
    )


def has_block(halves: DataFrame) -> DataFrame:
    """Blocks the store really has: both halves, and the data half is as long as declared."""
    return halves.filter(F.col("has_meta") & (F.col("data_size") == F.col("length"))).select(*KEY)


def half_uploads(halves: DataFrame) -> DataFrame:
    """Blocks whose upload broke off: one half alone, or data of another length."""
    fault = (
        F.when(F.col("data_size").isNull(), "data_missing")
        .when(~F.col("has_meta"), "meta_missing")
        .when(F.col("data_size") != F.col("length"), "length_differs")
    )
    rows = halves.withColumn("fault", fault).filter(F.col("fault").isNotNull())
    return rows.select(*KEY, "data_size", "fault")


def backup_eligible(candidates: DataFrame, stored: DataFrame) -> DataFrame:
    """Say for each candidate why it is backed up or not."""
    marked = candidates.join(
        stored.select(*KEY).distinct().withColumn("_stored", F.lit(True)), KEY, "left"
    )
    reason = (
        F.when(F.col("_stored"), "already_stored")
        .when(~F.col("is_valid"), "not_valid")
        .when(F.col("is_symlink"), "symbolic_link")
        .otherwise("eligible")
    )
    return marked.select(*candidates.columns, reason.alias("reason"))


def check_pool(df: DataFrame, pool: str) -> DataFrame:
    """Mark rows of a foreign pool, or of none, as errors."""
    named = F.coalesce(F.col("pool_id"), F.lit("null"))
    fault = F.when(
        ~F.col("pool_id").eqNullSafe(F.lit(pool)), F.concat(F.lit("Block pool id "), named, F.lit(f" does not match {pool}"))
    )
    return df.withColumn("error", fault)


def unbackable(plan: DataFrame) -> DataFrame:
    """Blocks no node holds: they can be reported, not requested."""
    return plan.filter(F.col("replicas").isNull() | (F.size("replicas") <= 0))
