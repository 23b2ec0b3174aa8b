"""Shuffled shards by a two-pass external shuffle. DataFrame functions only.

A first pass counts, the second scatters: a seeded hash of a row names its cell, a stretch of neighbouring cells is a
bucket that fits in memory and goes to one task, and one task writes one bucket. The cells are what is shuffled by
Fisher and Yates' swaps: their draws depend on the seed, the cell and its number of rows alone, so a task that is
repeated makes the same order again. A cell has few rows because in SQL each swap copies the list; only numbers are
swapped, the rows follow. The counts of the first pass give every cell the place where it begins, and so the shard.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from blockledger.functions.columns import hash32
from blockledger.llm.langid import quoted
from blockledger.llm.staging import free_of, repeated, shuffle_parts, staged
from blockledger.operators.joins import small_side

LAWS = ("rows", "bytes", "key")
CELL_ROWS = 64  # rows of a cell, on average
CROWDED = 8  # a cell of so many times that holds copies of one row
BUCKET_BYTES = 64 << 20
OWN = ("shard", "slot", "grown_shard", "_size", "_crc", "_hash", "_cell", "_bucket", "_head", "_lead", "_copy", "_rank", "_pos", "_first", "_bytes", "_home", "copies", "copy")


def size_of(text: str | Column) -> Column:
    """UTF-8 bytes of a text, none for null, and 8 for its number."""
    return (F.coalesce(F.octet_length(text), F.lit(0)) + 8).cast("long")


def crc_of(text: str | Column) -> Column:
    return F.crc32(F.coalesce(text if isinstance(text, Column) else F.col(text), F.lit("")).cast("binary"))


def home(shards: int, seed: int) -> Column:
    """The shard of a doc_id by the highest of one hash a shard: with one more shard, rows move only there."""
    name = F.coalesce(F.col("doc_id").cast("string"), F.lit("-"))
    draws = [F.struct(hash32(F.lit(seed), F.lit("shard"), F.lit(k), name), F.lit(k)) for k in range(shards)]
    return F.array_max(F.array(*draws))["col2"]


def swapped(cell: str, n: str, seed: int) -> Column:
    """The numbers 0 to n - 1 in the order of a Fisher-Yates shuffle drawn for the cell."""
    last = F.col(n).cast("int") - 1
    draw = lambda i: F.struct(i.alias("i"), (hash32(F.lit(seed), F.lit("swap"), cell, i) % (i + 1)).cast("int").alias("j"))
    swap = lambda order, d: F.transform(
        order,
        lambda x, k: F.when(k == d["i"], F.element_at(order, d["j"] + 1)).when(k == d["j"], F.element_at(order, d["i"] + 1)).otherwise(x),
    )
    draws = F.when(last > 0, F.transform(F.sequence(last, F.lit(1), F.lit(-1)), draw)).otherwise(F.array().cast("array<struct<i: int, j: int>>"))
    return F.aggregate(draws, F.sequence(F.lit(0), last), swap)


def _hashed(docs: DataFrame, seed: int) -> DataFrame:
    rows = docs.withColumns({"_size": size_of("text"), "_crc": crc_of("text")})
    name = F.coalesce(F.col("doc_id").cast("string"), F.lit("-"))
    return rows.withColumn("_hash", hash32(F.lit(seed), F.lit("cell"), name, "_crc", "_size", "_copy"))


def _cells(rows: DataFrame) -> DataFrame:
    return staged(rows.groupBy("_cell").agg(F.count("*").alias("n"), F.sum("_size").alias("bytes")), "shard-cells")


def _spread(docs: DataFrame, rows: DataFrame, cells: DataFrame, cell_rows: int) -> DataFrame:
    """`docs` with `_copy`, a number that tells apart what would crowd one cell: rows alike in doc_id and text.

    Rows alike in every column are counted before they are sent, and written out again by many tasks.
    """
    crowded = cells.where(F.col("n") > CROWDED * cell_rows).select("_cell")
    keys = rows.join(crowded, "_cell", "left_semi").groupBy("doc_id", "_crc", "_size").count().where(F.col("count") > cell_rows)
    keys = small_side(staged(keys.select(F.col("doc_id").alias("_home"), F.col("_crc").alias("_first"), F.col("_size").alias("_bytes")), "shard-copies"))
    same = F.col("doc_id").eqNullSafe(F.col("_home")) & (crc_of("text") == F.col("_first")) & (size_of("text") == F.col("_bytes"))
    counted = docs.join(keys, same, "left_semi").groupBy(*[quoted(c) for c in docs.columns]).agg(F.count("*").alias("copies"))
    many = repeated(staged(counted, "shard-repeats"), "doc_id", "text").withColumnRenamed("copy", "_copy")
    return docs.join(keys, same, "left_anti").withColumn("_copy", F.lit(0).cast("long")).unionByName(many)


def _located(cells: DataFrame) -> DataFrame:
    """`cells` with the rows and bytes before each: sums within stretches of cells, and over the stretches before."""
    stretch = F.shiftright("_cell", 12)
    inside = Window.partitionBy("_stretch").orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)
    over = Window.orderBy("_stretch").rowsBetween(Window.unboundedPreceding, -1)
    before = lambda name, w: F.coalesce(F.sum(name).over(w), F.lit(0))
    cells = cells.withColumn("_stretch", stretch)
    sums = cells.groupBy("_stretch").agg(F.sum("n").alias("_n"), F.sum("bytes").alias("_b"))
    sums = sums.select("_stretch", before("_n", over).alias("_n"), before("_b", over).alias("_b"))
    cells = cells.withColumns({"_in": before("n", inside), "_ib": before("bytes", inside)}).join(sums, "_stretch")
    return cells.select("_cell", "n", "bytes", (F.col("_n") + F.col("_in")).alias("_first"), (F.col("_b") + F.col("_ib")).alias("_lead"))


def _ranked(rows: DataFrame, cells: DataFrame, buckets: int, total: int, seed: int) -> DataFrame:
    """`rows` with `_pos`, their place in the shuffled order, and `_bytes`, the bytes before their cell.

    What is known of a cell travels as a row ahead of its rows, so texts are moved once and joined with nothing.
    """
    heads = cells.withColumn("_head", F.struct(swapped("_cell", "n", seed).alias("order"), "_first", "_lead")).select("_cell", "_head")
    bucket = lambda df: df.withColumn("_bucket", (F.col("_cell") * buckets / (total)).cast("int"))
    both = bucket(rows.unionByName(heads, allowMissingColumns=True)).repartitionById(buckets, F.col("_bucket"))
    cell = Window.partitionBy("_bucket", "_cell").orderBy(F.col("_head").isNull(), "doc_id", "_crc", "_size", "_copy")
    both = both.withColumns({"_rank": F.row_number().over(cell), "_lead": F.first("_head", ignorenulls=True).over(cell)})
    rows = both.where(F.col("_head").isNull())
    pos = F.col("_lead._first") + F.element_at("_lead.order", F.col("_rank") - 1)
    return rows.withColumns({"_pos": pos, "_bytes": F.col("_lead._lead")})


def write_shards(
    docs: DataFrame, path: str, *, shards=24, law="rows", seed=0, cell_rows=CELL_ROWS, bucket_bytes=BUCKET_BYTES
) -> DataFrame:
    """Write `docs` shuffled into `shards` folders below `path` and return them as read back.

    Added are `shard`, `slot` (0, 1, 2, ... in each shard) and `grown_shard`; a file holds its rows in order of slot.
    Law `rows`: shards are equal pieces of one shuffled order, their counts at most one apart. Law `bytes`: they are
    pieces of equal bytes, a row being where it begins, so sizes differ by no more than the largest rows. Law `key`: the
    shard follows from doc_id and the number of shards, and `grown_shard` is the one among one more; with the other laws it is null.

    The order follows from the seed, doc_id and text, whatever the partitions of `docs`; rows alike in both are
    interchangeable. A null doc_id is an id of its own, a null text has no bytes. Repeated rows are all kept, also where
    one row is a third of all (columns must then be comparable, so no maps). Columns of the names in `OWN` are replaced.
    No rows give no rows.
    """
    if law not in LAWS:
        raise ValueError(f"law must be one of {LAWS}")
    spark = docs.sparkSession
    docs = free_of(docs, *OWN)
    plain = docs.withColumn("_copy", F.lit(0).cast("long"))
    found = plain.agg(F.count("*"), F.sum(size_of("text"))).first()
    n, size = found[0], found[1] or 0
    counts = [0] * shards
    if law == "key":
        for k, held in docs.groupBy(home(shards, seed)).count().collect():
            counts[k] = held
    width = [max(1, -(-held // cell_rows)) for held in counts] if law == "key" else [max(1, -(-n // cell_rows))]
    base = [sum(width[:k]) for k in range(len(width))]

    def celled(rows):
        rows = _hashed(rows, seed)
        if law != "key":
            return rows.withColumn("_cell", F.shiftright(F.col("_hash") * width[0], 32))
        at = lambda values: F.element_at(F.array(*[F.lit(v).cast("long") for v in values]), F.col("_home") + 1)
        return rows.withColumn("_home", home(shards, seed)).withColumn("_cell", at(base) + F.shiftright(F.col("_hash") * at(width), 32))

    rows = celled(plain)
    cells = _cells(rows)
    if not cells.where(F.col("n") > CROWDED * cell_rows).isEmpty():
        rows = celled(_spread(docs, rows, cells, cell_rows))
        cells = _cells(rows)
    buckets = max(shuffle_parts(spark), -(-size // bucket_bytes))
    cells = staged(_located(cells), "shard-places")
    ranked = _ranked(rows, cells, buckets, sum(width), seed)
    if law == "rows":
        starts = [-(-s * n // shards) for s in range(shards)]
        ranked = ranked.withColumn("shard", F.expr(f"_pos * {shards} div {max(n, 1)}").cast("int"))
    elif law == "bytes":
        ranked, starts = _by_bytes(ranked, cells, lambda c: _ranked(rows.join(c, "_cell", "left_semi"), cells.join(c, "_cell", "left_semi"), shards, sum(width), seed), shards, size)
    else:
        starts = [sum(counts[:s]) for s in range(shards)]
        ranked = ranked.withColumn("shard", F.col("_home"))
    start = F.element_at(F.array(*[F.lit(s).cast("long") for s in starts]), F.col("shard") + 1)
    grown = home(shards + 1, seed) if law == "key" else F.lit(None).cast("int")
    out = ranked.select(*[quoted(c) for c in docs.columns], (F.col("_pos") - start).alias("slot"), grown.alias("grown_shard"), "shard")
    writer = out.sortWithinPartitions("shard", "slot").write.option("compression", "zstd")
    writer.partitionBy("shard").parquet(path)
    return spark.read.schema(out.schema).parquet(path)


def _by_bytes(ranked: DataFrame, cells: DataFrame, again, shards: int, size: int):
    """`ranked` with `shard` by the bytes before each row, and the first place of every shard.

    A shard begins within one cell; only the rows of those cells, fewer than `shards`, are looked at for it.
    """
    order = Window.partitionBy("_bucket", "_cell").orderBy("_pos").rowsBetween(Window.unboundedPreceding, -1)
    begins = F.col("_bytes") + F.coalesce(F.sum("_size").over(order), F.lit(0))
    placed = lambda df: df.withColumn("_lead", begins)
    limits = [-(-s * size // shards) for s in range(1, shards)]
    inner = F.array(*[F.lit(limit) for limit in limits]) if limits else F.array().cast("array<bigint>")
    cut = F.filter(inner, lambda x: (F.col("_lead") < x) & (x <= F.col("_lead") + F.col("bytes")))
    met = cells.select("_cell", "_first", F.explode(cut).alias("_limit"))
    looked = placed(again(met.select("_cell").distinct())).select("_cell", F.col("_lead").alias("_begin"))
    within = looked.join(met, "_cell").groupBy("_limit").agg((F.min("_first") + F.sum((F.col("_begin") < F.col("_limit")).cast("long"))).alias("at"))
    at = dict(within.collect())
    shard = F.expr(f"_lead * {shards} div {max(size, 1)}").cast("int")
    return placed(ranked).withColumn("shard", shard), [0, *[at.get(limit, 0) for limit in limits]]


def read_shards(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)
