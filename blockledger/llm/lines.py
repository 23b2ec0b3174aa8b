"""Removal of repeated runs of lines, found by winnowing over line hashes. DataFrame functions only.

Of every `window` consecutive lines the one with the smallest hash is a fingerprint, so two runs of that many equal lines
always have one in common. Positions of fingerprints that occur again are joined through the first place their
surroundings occur at; a match reaches as far to the left and to the right of it as the lines stay equal.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from blockledger.llm.langid import quoted
from blockledger.llm.staging import free_of, staged

KEY = ["_doc", "_sig"]
LONG_WORDS = 20  # a line of so many words is deleted on its own where it is repeated


def with_key(docs: DataFrame) -> DataFrame:
    """Adds `_doc`, the doc_id, and `_sig`, a hash of the text: together they name a document."""
    return docs.withColumns({"_doc": F.col("doc_id").cast("long"), "_sig": F.xxhash64("text")})


def same_key(a: DataFrame, b: DataFrame, key=KEY) -> Column:
    """Equality of the key columns, nulls being equal to each other."""
    condition = F.lit(True)
    for name in key:
        condition = condition & a[name].eqNullSafe(b[name])
    return condition


def lines_of(text: str | Column) -> Column:
    return F.split(text, "\n")


HOT = 1_000  # a key with more than one in HOT of all rows is hot; there are fewer than HOT of them


def spread_join(rows: DataFrame, found: DataFrame, on: list[str], how: str) -> DataFrame:
    """`rows` joined with `found`, which has one row for each key and in `n` how many of `rows` have that key.

    Hot keys are broadcast, and their rows stay where they are read. There are always fewer than HOT of them, and no other
    key has more than one in HOT of the rows, so no task of the shuffled join gathers more of one key than that.
    """
    total = F.lit(rows.count())
    hot = F.broadcast(found.where(F.col("n") * HOT > total).drop("n"))
    rest = found.where(F.col("n") * HOT <= total).drop("n")
    cold = rows.join(hot, on, "left_anti").join(rest, on, how)
    return rows.join(hot, on, how).unionByName(cold)


def repeated_windows(docs: DataFrame, window: int) -> DataFrame:
    """`_doc`, `_sig`, `at`: every `window` lines in a row that also begin at an earlier place in the corpus.

    Places are ordered by doc_id, then by the hash of the text, then by line. Windows of empty lines alone do not count.
    """
    n = F.size("h")
    there = lambda i: F.slice("h", i, window)
    fingerprint = lambda i: i + F.array_position(there(i), F.array_min(there(i))).cast("int") - 1
    hashed = with_key(docs.where(F.col("text").isNotNull())).select(
        *KEY, F.transform(lines_of("text"), lambda line: F.xxhash64(line)).alias("h")
    )
    positions = (
        hashed.where(n >= window)
        .select(*KEY, "h", F.explode_outer(F.array_distinct(F.transform(F.sequence(F.lit(1), n - window + 1), fingerprint))).alias("at"))
        .select(
            *KEY,
            F.greatest(F.col("at") - window + 1, F.lit(1)).alias("low"),
            "at",
            F.element_at("h", F.col("at")).alias("print"),
            F.expr(f"slice(h, greatest(at - {window - 1}, 1), at + {window - 1} - greatest(at - {window - 1}, 1) + 1)").alias("around"),
        )
    )
    positions = staged(positions, "line-prints")
    again = positions.groupBy("print").agg(F.count("*").alias("n")).where("n > 1")
    shared = spread_join(positions, again, ["print"], "left_semi")
    empty = F.array_repeat(F.xxhash64(F.lit("")), window)
    windows = (
        shared.select(
            *KEY,
            "low",
            "at",
            "print",
            "around",
            F.explode(F.sequence(F.lit(1), F.size("around") - window + 1)).alias("k"),
        )
        .withColumn("lines", F.slice("around", F.col("k"), window))
        .where((F.array_min("lines") == F.col("print")) & (F.col("lines") != empty))
        .select(*KEY, (F.col("low") + F.col("k") - 1).alias("start"), "print", F.xxhash64(F.lit(1), "lines").alias("content"))
    )
    windows = staged(windows.distinct(), "line-windows")
    place = F.struct(*KEY, "start")
    first = windows.groupBy("print", "content").agg(F.min(place).alias("first"), F.count("*").alias("n")).where("n > 1")
    found = spread_join(windows, first, ["print", "content"], "inner")
    return found.where(~place.eqNullSafe(F.col("first"))).select(*KEY, F.col("start").alias("at"))


def repeated_long_lines(docs: DataFrame, words: int) -> DataFrame:
    """`_doc`, `_sig`, `at`: every line of at least `words` words that also stands at an earlier place in the corpus."""
    line = F.col("line")
    n_words = F.size(F.regexp_extract_all(line, F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0)))
    split = with_key(docs.where(F.col("text").isNotNull())).select(*KEY, F.posexplode(lines_of("text")).alias("k", "line"))
    long = split.where((F.length(line) >= 2 * words - 1) & (n_words >= words))
    long = long.select(*KEY, (F.col("k") + 1).alias("at"), F.xxhash64(line).alias("print"), F.xxhash64(F.lit(1), line).alias("content"))
    long = staged(long.distinct(), "long-lines")
    place = F.struct(*KEY, "at")
    first = long.groupBy("print", "content").agg(F.min(place).alias("first"), F.count("*").alias("n")).where("n > 1")
    found = spread_join(long, first, ["print", "content"], "inner")
    return found.where(~place.eqNullSafe(F.col("first"))).select(*KEY, "at")


def repeated_runs(docs: DataFrame, window: int, long_words: int | None = None) -> DataFrame:
    """`_doc`, `_sig`, `_runs`: sorted, disjoint `start` (from 1) and `stop` (exclusive) of the lines to delete."""
    order = Window.partitionBy(*KEY).orderBy("at", "stop")
    matched = repeated_windows(docs, window).withColumn("stop", F.col("at") + window)
    if long_words is not None:
        matched = matched.unionByName(repeated_long_lines(docs, long_words).withColumn("stop", F.col("at") + 1))
    before = F.max("stop").over(order.rowsBetween(Window.unboundedPreceding, -1))
    opens = (F.col("at") > before) | before.isNull()
    matched = matched.withColumn("run", F.sum(opens.cast("int")).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    runs = matched.groupBy(*KEY, "run").agg(F.min("at").alias("start"), F.max("stop").alias("stop"))
    return runs.groupBy(*KEY).agg(F.sort_array(F.collect_list(F.struct("start", "stop"))).alias("_runs"))


def drop_repeated_lines(docs: DataFrame, window: int = 2, long_words: int | None = LONG_WORDS) -> DataFrame:
    """`docs` with the repeated lines cut out of `text`, and `n_lines`, `n_removed`, `n_runs`.

    Deleted is every run of at least `window` lines that also begins earlier: in a document with a smaller doc_id, or
    further up in the same one. So is every single line of at least `long_words` words (what stands between blanks) that is
    there earlier; a shorter one alone stays, and with None any. The first occurrence stays. Lines are compared byte for byte. Null texts stay null and
    have no lines; an empty text is one empty line. Rows with the same doc_id are ordered by a hash of their texts; rows
    that also have the same text are one document and treated alike. A null doc_id comes before all others. Other
    columns are kept, but for those called like the three or `_doc`, `_sig`, `_lines`, `_runs`. No rows give no rows.
    """
    docs = free_of(docs, "n_lines", "n_removed", "n_runs", "_doc", "_sig", "_lines", "_runs")
    keyed = with_key(docs)
    runs = repeated_runs(docs.select("doc_id", "text"), window, long_words)
    joined = keyed.join(runs, same_key(keyed, runs), "left").drop(runs["_doc"]).drop(runs["_sig"])
    parts = F.expr(
        "zip_with(concat(array(1), _runs.stop), concat(_runs.start, array(size(_lines) + 1)), (a, b) -> slice(_lines, a, b - a))"
    )
    text = F.when(F.col("_runs").isNull(), F.col("text")).otherwise(F.array_join(F.flatten(parts), "\n"))
    removed = F.expr("aggregate(_runs, 0, (n, r) -> n + r.stop - r.start)")
    columns = [quoted(c) for c in docs.columns if c != "text"]
    joined = joined.withColumn("_lines", lines_of("text"))
    return joined.select(
        *columns,
        text.alias("text"),
        F.coalesce(F.when(F.col("text").isNotNull(), F.size("_lines")), F.lit(0)).cast("long").alias("n_lines"),
        F.coalesce(removed, F.lit(0)).cast("long").alias("n_removed"),
        F.coalesce(F.when(F.col("_runs").isNotNull(), F.size("_runs")), F.lit(0)).cast("long").alias("n_runs"),
    )
