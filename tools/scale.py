"""Compare two generated inventories of N blocks (default 10 million) and collect garbage: seconds and row counts.

A third of the stored rows are copies or versions of one block, so the run also shows what a hot key costs.
"""

import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from pyspark.sql import functions as F  # noqa: E402

from blockledger.operators.ranking import assign_batches  # noqa: E402
from blockledger.operators.reconcile import gc, reconcile  # noqa: E402
from blockledger.session import checkpoint_dir, local_session  # noqa: E402


def main(n=10_000_000):
    spark = local_session(8, partitions=64)
    folder = f"{checkpoint_dir(spark)}/scale"
    ids = spark.range(n)
    pool = F.concat(F.lit("BP-"), (F.col("id") % 3).cast("string"))
    row = lambda block, gen: [pool.alias("pool_id"), block.alias("block_id"), F.lit(1).cast("bigint").alias("length"), gen.cast("bigint").alias("gen_stamp")]
    ids.select(*row(F.col("id"), F.lit(5))).write.parquet(f"{folder}/live")
    hot = F.col("id") % 3 == 0
    stored = ids.select(
        F.when(hot, "BP-0").otherwise(pool).alias("pool_id"),
        F.when(hot, F.lit(0)).otherwise(F.col("id")).alias("block_id"),
        F.lit(1).cast("bigint").alias("length"),
        F.when(hot, F.col("id")).when(F.col("id") % 7 == 0, F.lit(4)).otherwise(F.lit(5)).cast("bigint").alias("gen_stamp"),
    )
    stored.write.parquet(f"{folder}/store")
    live, store = spark.read.parquet(f"{folder}/live"), spark.read.parquet(f"{folder}/store")

    def timed(name, df):
        start = time.perf_counter()
        out = df.collect()
        print(name, round(time.perf_counter() - start, 1), "s", [tuple(r) for r in out], flush=True)

    plan = reconcile(live, store)
    timed("reconcile", plan.groupBy("action").count().orderBy("action"))
    timed("gc", gc(store, live).agg(F.count("*"), F.sum("length")))
    todo = assign_batches(plan.filter(F.col("action") != "in_sync"), 100)
    timed("batches", todo.groupBy("action").agg(F.count("*"), F.countDistinct("pool_id", "batch_no")).orderBy("action"))


if __name__ == "__main__":
    main(*map(int, sys.argv[1:]))
