"""Moving block contents and checking them.

Contents are joined with a plan of keys. When the plan is counted to be small it is broadcast and the contents are
read in place; only larger plans make them cross the network. Which of several contents counts is decided where there
are several, which keys alone tell.
"""

from functools import reduce
from operator import or_

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from blockledger.functions.checksums import combined_crc, crc_chunks
from blockledger.functions.columns import hash32, object_key
from blockledger.operators.joins import small_side
from blockledger.schema import KEY
from blockledger.session import folder_exists

VERSION = ["pool_id", "block_id", "gen_stamp"]  # a block's name without the length, which is what is verified
BYTES_PER_CHECKSUM = 512


def chunk_sums(data, bytes_per_checksum=BYTES_PER_CHECKSUM, algorithm="crc32"):
    """Checksums of the consecutive chunks of a binary column: crc32, crc32c or md5."""
    if algorithm == "crc32c":
        return crc_chunks(data, bytes_per_checksum, algorithm)
    size = F.octet_length(data)
    digest = {"crc32": F.crc32, "md5": F.md5}[algorithm]
    last = F.ceil(size / F.lit(bytes_per_checksum)).cast("int") - 1
    sums = F.transform(
        F.sequence(F.lit(0), last),
        lambda i: digest(F.substring(data, i * F.lit(bytes_per_checksum) + 1, F.lit(bytes_per_checksum))),
    )
    empty = F.array().cast("array<bigint>" if algorithm == "crc32" else "array<string>")
    return F.when(size > 0, sums).when(size == 0, empty)


def checksum_meta(payload: DataFrame, bytes_per_checksum=BYTES_PER_CHECKSUM, algorithm="crc32") -> DataFrame:
    """The side file of each block: one checksum per chunk, with the parameters needed to check it."""
    return payload.select(
        *KEY,
        F.lit(algorithm).alias("algorithm"),
        F.lit(bytes_per_checksum).alias("bytes_per_checksum"),
        chunk_sums(F.col("data"), bytes_per_checksum, algorithm).alias("meta"),
    )


def whole_sums(stored: DataFrame, bytes_per_checksum=BYTES_PER_CHECKSUM, algorithm="crc32") -> DataFrame:
    """The checksum of each block from its side file alone: `meta` and the declared length, no contents are read."""
    whole = combined_crc(F.col("meta"), F.col("length"), bytes_per_checksum, algorithm)
    return stored.select(*KEY, whole.alias("checksum"))


def one_of_each(contents: DataFrame, on: list[str], *rank) -> DataFrame:
    """`contents` with one row for each key `on`: of several the first by `rank`, then that of the least MD5 of `data`.

    Keys are counted first, without the contents; only rows of keys that come more than once are brought together.
    """
    several = contents.groupBy(*on).count().filter(F.col("count") > 1).select(*on)
    if several.isEmpty():
        return contents
    several = small_side(several)
    best = F.min_by(F.struct(*contents.columns), F.struct(*[r.alias(f"r{i}") for i, r in enumerate(rank)], F.md5("data"))).alias("b")
    chosen = contents.join(several, on, "left_semi").groupBy(*on).agg(best).select("b.*")
    return contents.join(several, on, "left_anti").select(*contents.columns).unionByName(chosen)


def backup_payload(
    plan: DataFrame, payload: DataFrame, bytes_per_checksum=BYTES_PER_CHECKSUM, algorithm="crc32"
) -> DataFrame:
    """What a copy of each planned block would write, and whether it may.

    status is ok, length_mismatch (contents are not as long as declared) or no_payload; only ok rows carry contents. Of
    several contents of one version those of the right length are taken, then those of the least MD5.
    """
    asked = plan.select(*KEY).distinct()
    found = payload.select(*VERSION, "data").join(small_side(asked), VERSION).select(*KEY, "data")
    found = one_of_each(found, KEY, F.octet_length("data") != F.col("length"))
    good = F.octet_length("data") == F.col("length")
    copied = found.select(
        *KEY,
        F.octet_length("data").cast("bigint").alias("n_bytes"),
        F.when(good, F.col("data")).alias("data"),
        F.when(good, chunk_sums(F.col("data"), bytes_per_checksum, algorithm)).alias("meta"),
        F.when(good, "ok").otherwise("length_mismatch").alias("status"),
    )
    absent = asked.join(payload.select(*VERSION).distinct(), VERSION, "left_anti")
    return copied.unionByName(
        absent.select(*KEY, F.lit(0).cast("bigint").alias("n_bytes"), F.lit("no_payload").alias("status")),
        allowMissingColumns=True,
    )


BUCKETS = 64  # of a pool
LISTED = 5_000  # touched buckets that are named to the scan


def write_payload(copied: DataFrame, path: str, buckets=BUCKETS) -> None:
    """Put the good rows of a copy into the table at `path`. Errors stay in `copied` for the report."""
    merge_payload(copied.filter(F.col("status") == "ok").select(*KEY, "data", "meta"), path, buckets)


def merge_payload(new: DataFrame, path: str, buckets=BUCKETS) -> None:
    """Put blocks into a stored table; a block written again replaces the one under its key.

    The table has a folder for each pool and bucket of blocks. Only folders that `new` has blocks of are read and written
    anew, all others keep their files, and writing the same blocks twice leaves what writing them once does. Of rows of `new` with
    one key that of the least MD5 stays. `buckets` must be the same each time.
    """
    named = one_of_each(new, KEY).withColumn("bucket", F.pmod(hash32("block_id"), F.lit(buckets)).cast("int"))
    rows = named
    if folder_exists(new.sparkSession, path):
        held = read_payload(new.sparkSession, path, named.schema)
        touched = named.select("pool_id", "bucket").distinct()
        pairs = touched.limit(LISTED + 1).collect()
        if len(pairs) <= LISTED:
            of = {pool: [r["bucket"] for r in pairs if r["pool_id"] == pool] for pool in {r["pool_id"] for r in pairs}}
            held = held.filter(reduce(or_, [(F.col("pool_id") == p) & F.col("bucket").isin(b) for p, b in of.items()], F.lit(False)))
        else:
            held = held.join(touched, ["pool_id", "bucket"], "left_semi")
        kept = held.join(small_side(named.select(*KEY)), KEY, "left_anti")
        rows = kept.select(*named.columns).unionByName(named)
    writer = rows.repartition("pool_id", "bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
    writer.partitionBy("pool_id", "bucket").parquet(path)


def read_payload(spark, path: str, schema) -> DataFrame:
    return spark.read.schema(schema).parquet(path)


def upsert_payload(existing: DataFrame, new: DataFrame, order="written_at") -> DataFrame:
    """An object written again replaces the one under the same key; of several writes the last one stays.

    A write without a time counts as the first one. Of writes of one time that with the highest MD5 of its data stays.
    """
    latest = Window.partitionBy(*KEY).orderBy(F.col(order).desc_nulls_last(), F.md5("data").desc())
    winners = new.withColumn("_rank", F.row_number().over(latest)).filter("_rank = 1")
    keys = small_side(new.select(*KEY).distinct())
    return existing.join(keys, KEY, "left_anti").unionByName(winners.select(*existing.columns))


def restore_payload(plan: DataFrame, stored: DataFrame, present: DataFrame) -> DataFrame:
    """For each requested block: not_stored, already_valid, or restored with its contents and their size.

    A block that is stored more than once is restored once, with contents of the right length if there are any.
    """
    asked = plan.select(*KEY).distinct()
    probe = small_side(asked)
    valid = present.select(*KEY).join(probe, KEY, "left_semi").distinct()
    known = stored.select(*KEY).join(probe, KEY, "left_semi").distinct()
    flags = asked.join(known.withColumn("_stored", F.lit(True)), KEY, "left").join(
        valid.withColumn("_valid", F.lit(True)), KEY, "left"
    )
    status = (
        F.when(F.col("_stored").isNull(), "not_stored")
        .when(F.col("_valid").isNotNull(), "already_valid")
        .otherwise("restored")
    )
    decided = flags.select(*KEY, status.alias("status"))
    todo = decided.filter(F.col("status") == "restored")
    held = stored.select(*KEY, "data", "meta").join(small_side(todo), KEY)
    back = one_of_each(held, KEY, F.octet_length("data") != F.col("length")).select(
        *KEY, "status", F.octet_length("data").cast("bigint").alias("bytes_copied"), "data", "meta"
    )
    rest = decided.filter(F.col("status") != "restored").withColumn("bytes_copied", F.lit(0).cast("bigint"))
    return back.unionByName(rest, allowMissingColumns=True)


def delete_keys(deletes: DataFrame, prefix=None) -> DataFrame:
    """Both object keys of each block to delete."""
    half = F.explode(F.array(F.lit("meta"), F.lit("data")))
    return deletes.select(*KEY, half.alias("half")).withColumn("key", object_key(F.col("half"), prefix))


render_keys = delete_keys


def apply_deletes(store: DataFrame, deletes: DataFrame) -> DataFrame:
    return store.join(deletes.select(*KEY).distinct(), KEY, "left_anti")


def purge(keys: DataFrame, prefix=None) -> DataFrame:
    """What is left after removing everything, or everything below a prefix."""
    return keys.filter(~F.startswith("key", F.lit(prefix))) if prefix else keys.limit(0)


def verify_payload(stored: DataFrame, bytes_per_checksum=BYTES_PER_CHECKSUM, algorithm="crc32") -> DataFrame:
    """Read the stored contents again: are they as long as declared, and does every chunk match its checksum?"""
    now = chunk_sums(F.col("data"), bytes_per_checksum, algorithm)
    bad = F.size(F.filter(F.zip_with("meta", now, lambda a, b: ~a.eqNullSafe(b)), lambda differs: differs))
    checked = stored.select(
        *KEY, F.octet_length("data").cast("bigint").alias("n_bytes"), bad.cast("bigint").alias("bad_chunks")
    )
    fault = F.when(F.col("n_bytes") != F.col("length"), "length").when(F.col("bad_chunks") > 0, "checksum")
    return checked.withColumn("fault", F.coalesce(fault, F.lit("none")))
