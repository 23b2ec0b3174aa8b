"""Join helpers whose broadcasts are decided by a measured size."""

from functools import reduce
from operator import and_

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Rows of a few key columns: some tens of megabytes on each executor at most.
BROADCAST_ROWS = 500_000


def small_side(df: DataFrame, max_rows=BROADCAST_ROWS) -> DataFrame:
    """`df` marked for broadcast if it is counted to be small; unchanged otherwise.

    Used only where the other side is far larger than the count is dear, above all where it carries payload bytes.
    """
    return F.broadcast(df) if df.count() <= max_rows else df


def split_heavy(df: DataFrame, on: list[str], limit: int):
    """Split rows by whether their key has more than `limit` rows: (light, heavy); heavy is None when there is none.

    The counts combine on the map side, so finding a hot key never gathers its rows. Heavy keys number at most
    rows / limit. They are broadcast when few; otherwise both sides are joined on the key plus a salt, which keeps
    one key's rows apart.
    """
    counts = df.groupBy(*on).count().filter(F.col("count") > limit)
    hot = counts.select(*[F.col(c).alias(f"_hot_{c}") for c in on])
    found = hot.count()
    if not found:
        return df, None
    same = lambda a: reduce(and_, [a[c].eqNullSafe(F.col(f"_hot_{c}")) for c in on])  # noqa: E731  nulls are a key too
    if found <= BROADCAST_ROWS:
        hot = F.broadcast(hot)
        return df.join(hot, same(df), "left_anti"), df.join(hot, same(df), "left_semi")
    salts = 16
    salted = df.withColumn("_salt", F.pmod(F.xxhash64(*df.columns), F.lit(salts)).cast("int"))
    hot = hot.withColumn("_hot_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    met = same(salted) & (F.col("_salt") == F.col("_hot_salt"))
    return (
        salted.join(hot, met, "left_anti").drop("_salt"),
        salted.join(hot, met, "left_semi").drop("_salt"),
    )
