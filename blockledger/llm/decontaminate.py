"""Benchmark passages in documents: a prefix-filtered containment join. DataFrame functions only.

An item is cut into windows of consecutive words. A document holds a window only if it holds all its word shingles, so one
shingle is a long enough prefix: the one that the corpus has least often. Documents are joined on that shingle alone, the
places where the window would begin and end must lie in the document, and all words are then compared.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from blockledger.llm.langid import quoted
from blockledger.llm.lines import KEY, same_key, with_key
from blockledger.llm.staging import free_of, staged

# What separates words.
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
BLOCK_ROWS, BLOCK_BYTES = 50_000, 32 << 20  # windows that are broadcast at once


def lower_ascii(text: Column) -> Column:
    """A-Z in lower case and nothing else. lower() does the same, and faster, where there is nothing but ASCII."""
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def words_of(text: Column) -> Column:
    """Runs of digits, ASCII letters and anything that is not ASCII. Null for a null text."""
    return F.array_remove(F.split(lower_ascii(text), SEPARATORS), "")


def windows_of(items: DataFrame, size: int) -> DataFrame:
    """`item_id`, `words`: every `size` words in a row; the whole item if it has fewer, nothing if it has none."""
    n = F.size("w")
    starts = F.sequence(F.lit(1), F.greatest(n - size + 1, F.lit(1)))
    split = items.select("item_id", words_of(F.col("text")).alias("w")).where(n > 0)
    return split.select("item_id", "w", F.explode(starts).alias("i")).select(
        "item_id", F.slice("w", F.col("i"), size).alias("words")
    )


def shingle(words: str, at: Column, size: Column | int) -> Column:
    """Hash of `size` (1 to 3) words from place `at`, counted from 1; also of the size."""
    word = lambda k: F.get(words, at + (k - 1))
    size = size if isinstance(size, Column) else F.lit(size)
    return F.xxhash64(size, word(0), F.when(size > 1, word(1)), F.when(size > 2, word(2)))


def anchored(docs: DataFrame, sizes: list[int]) -> DataFrame:
    """Every shingle of the sizes in every document: its hash and its place, beside the key and all words.

    The outer form keeps the optimiser from splitting each text once more to look for words first.
    """
    words = with_key(docs).select(*KEY, words_of(F.col("text")).alias("words"))
    places = words.select(*KEY, "words", F.posexplode_outer("words").alias("p", "word")).drop("word")
    if len(sizes) > 1:
        places = places.select("*", F.explode(F.array(*[F.lit(s) for s in sizes])).alias("size"))
    else:
        places = places.withColumn("size", F.lit(sizes[0]))
    return places.withColumn("key", shingle("words", F.col("p") + 1, F.col("size"))).where(
        F.col("p") + F.col("size") <= F.size("words")
    )


def prefixes(docs: DataFrame, items: DataFrame, size: int, grain: int) -> tuple[DataFrame, DataFrame | None, list[int], int]:
    """The windows of all items; the distinct ones with the shingle that the corpus has least often; all shingle sizes;
    and how many blocks there are to broadcast.

    `window` names a window; `key` is the shingle, `off` its place, from 0; `block` is the same for equal keys.
    """
    named = windows_of(items, size).withColumn("window", F.concat(F.xxhash64("words"), F.lit(":"), F.hash("words")))
    windows = staged(named.select("item_id", "window", "words"), "windows")
    distinct = windows.select("window", "words").dropDuplicates(["window"])
    grain_of = F.least(F.size("words"), F.lit(grain))
    each = distinct.select(
        "window", "words", grain_of.alias("size"), F.explode(F.sequence(F.lit(1), F.size("words") - grain_of + 1)).alias("k")
    ).select("window", "words", "size", (F.col("k") - 1).alias("off"), shingle("words", F.col("k"), F.col("size")).alias("key"))
    measured = distinct.agg(
        F.count("*").alias("n"),
        F.sum(F.octet_length(F.array_join("words", " ")) + 64).alias("bytes"),
        F.sort_array(F.collect_set(grain_of)).alias("sizes"),
    ).first()
    blocks = 1 + max((measured["n"] or 0) * grain // BLOCK_ROWS, (measured["bytes"] or 0) // BLOCK_BYTES)
    each = staged(each.withColumn("block", F.pmod(F.xxhash64("key"), F.lit(blocks))), "window-shingles")
    sizes = measured["sizes"]
    if not sizes:
        return windows, None, [], 0
    counts = None
    for block in range(blocks):
        keys = each.where(F.col("block") == block).select("key").distinct()
        counted = anchored(docs, sizes).join(F.broadcast(keys), "key").groupBy("key").agg(F.count("*").alias("often"))
        counts = counted if counts is None else counts.unionByName(counted)
    rare = each.join(staged(counts, "shingle-counts"), "key", "left").fillna(0, ["often"])
    least = Window.partitionBy("window").orderBy("often", "key", "off")
    chosen = rare.withColumn("k", F.row_number().over(least)).where("k = 1 and often > 0")  # 0: it is nowhere
    return windows, staged(chosen.select("window", "words", "off", "key", "block"), "window-prefixes"), sizes, blocks


def occurrences(docs: DataFrame, items: DataFrame, size: int, grain: int) -> DataFrame:
    """`_doc`, `_sig`, `start` (from 0), `length`, `item_id`: every occurrence of every window, once for each item."""
    windows, chosen, sizes, blocks = prefixes(docs, items, size, grain)
    if chosen is None:
        empty = with_key(docs).where(F.lit(False)).select(*KEY)
        nothing = F.lit(None).cast(items.schema["item_id"].dataType)
        return empty.withColumns({"start": F.lit(0), "length": F.lit(0), "item_id": nothing})
    found = None
    for block in range(blocks):
        mine = chosen.where(F.col("block") == block).select(
            "window", "off", "key", F.col("words").alias("wanted"), F.size("words").alias("length")
        )
        begin = F.col("p") - F.col("off")
        fits = (begin >= 0) & (begin + F.col("length") <= F.size("words"))
        hit = anchored(docs, sizes).join(F.broadcast(mine), "key").where(fits)
        hit = hit.where(F.slice("words", begin + 1, F.col("length")) == F.col("wanted"))
        hit = hit.select(*KEY, begin.alias("start"), "length", "window")
        found = hit if found is None else found.unionByName(hit)
    found = staged(found.distinct(), "window-hits")
    return found.join(windows.select("window", "item_id").distinct(), "window").drop("window")


def decontaminate(docs: DataFrame, items: DataFrame, size: int = 10, grain: int = 3) -> DataFrame:
    """`docs` with `n_words`, `n_hit`, `n_items`, `item_ids` (sorted as text) and `contaminated`.

    `n_hit` counts the words inside any occurrence of a window of any item, `n_items` the items with one. Null and empty
    texts have no words, and items without words no windows. An item with a null item_id makes words hit, but is not
    counted. Items given twice count once. Rows that agree in doc_id and text are one document and treated alike; all
    stay. Other columns are kept, but for those called like the five or `_doc`, `_sig`. Without documents there are no
    rows, without items nothing is hit.
    """
    docs = free_of(docs, "n_words", "n_hit", "n_items", "item_ids", "contaminated", "_doc", "_sig")
    hits = occurrences(docs.select("doc_id", "text"), items.select("item_id", "text"), size, grain)
    hits = staged(hits, "hits")
    order = Window.partitionBy(*KEY).orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    stop = F.col("start") + F.col("length")
    spans = hits.groupBy(*KEY, "start").agg(F.max("length").alias("length"))
    covered = spans.withColumn("new", stop - F.greatest("start", F.coalesce(F.max(stop).over(order), F.col("start"))))
    n_hit = covered.groupBy(*KEY).agg(F.sum(F.greatest("new", F.lit(0))).alias("n_hit"))
    names = hits.select(*KEY, F.col("item_id").cast("string").alias("item_id")).distinct()
    names = names.groupBy(*KEY).agg(F.array_sort(F.collect_list("item_id")).alias("item_ids"))
    found = n_hit.join(names, same_key(n_hit, names)).select(n_hit["_doc"], n_hit["_sig"], "n_hit", "item_ids")
    counted = with_key(docs).withColumn("n_words", F.coalesce(F.size(words_of(F.col("text"))), F.lit(0)).cast("long"))
    counted = counted.withColumn("n_words", F.greatest("n_words", F.lit(0).cast("long")))
    joined = counted.join(found, same_key(counted, found), "left")
    return joined.select(
        *[quoted(c) for c in docs.columns],
        "n_words",
        F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"),
        F.coalesce(F.size("item_ids"), F.lit(0)).cast("long").alias("n_items"),
        F.coalesce("item_ids", F.array().cast("array<string>")).alias("item_ids"),
        (F.coalesce("n_hit", F.lit(0)) > 0).alias("contaminated"),
    )
