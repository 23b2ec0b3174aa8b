"""Exact top-k search by inner product: a Voronoi kNN join.

Queries and data are grouped by their nearest pivots. For each group a summary is kept: how far its members lie from the
pivot, and how near its nearest few. From the summaries alone follow, for each group of queries, a score that its k best
surely reach, and for each group of data a score that none of its members can pass. Data whose bound is below is never
sent; the rest goes to the queries in blocks, and each pair of blocks is solved on its own.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from blockledger.llm.staging import staged

SLACK = 1e-6  # relative, for rounding in the bounds


def vectors_of(rows: DataFrame, name: str, vector: str, scale: int) -> DataFrame:
    """`id` and `x`, the components as floor(scale * component), of the rows whose components are all finite numbers."""
    x = F.col(vector)
    finite = lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))
    whole = F.transform(x, lambda c: F.floor(F.lit(float(scale)) * c.cast("double")))
    kept = rows.where(F.col(name).isNotNull() & x.isNotNull() & F.forall(x, finite))
    return kept.select(F.col(name).cast("long").alias("id"), whole.alias("x")).dropDuplicates(["id", "x"])


class Pivots:
    """Pivots by dimension. A dimension without one has the origin as its pivot, under the negative dimension."""

    def __init__(self, rows: list[list[int]]):
        self.of: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        self.at = {i: np.array(x, float) for i, x in enumerate(rows)}
        for dim in {len(x) for x in rows}:
            names = np.array([i for i, x in enumerate(rows) if len(x) == dim])
            self.of[dim] = names, np.array([rows[i] for i in names], float).reshape(len(names), dim)

    def point(self, cell: int) -> np.ndarray:
        return self.at[cell] if cell >= 0 or cell in self.at else np.zeros(-cell - 1)

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        dim = x.shape[1]
        if dim not in self.of:
            return np.full(len(x), -dim - 1), np.sqrt((x * x).sum(1))
        names, points = self.of[dim]
        squares = ((x[:, None, :] - points[None, :, :]) ** 2).sum(2)
        best = squares.argmin(1)
        return names[best], np.sqrt(squares[np.arange(len(x)), best])


def assigned(vectors: DataFrame, pivots: Pivots) -> DataFrame:
    """`id`, `x` with `cell`, the nearest pivot, and `off`, the distance to it."""

    def run(batches):
        for batch in batches:
            for low in range(0, batch.num_rows, 1024):
                part = batch.slice(low, 1024)
                x = part.column(1)
                sizes = np.diff(x.offsets.to_numpy())
                flat = x.flatten().to_numpy(zero_copy_only=False).astype(float)
                ends = np.concatenate([[0], np.cumsum(sizes)])
                cell, off = np.zeros(len(sizes), np.int64), np.zeros(len(sizes))
                for dim in np.unique(sizes):
                    rows = np.flatnonzero(sizes == dim)
                    block = flat[(ends[rows, None] + np.arange(dim)).ravel()].reshape(len(rows), dim)
                    cell[rows], off[rows] = pivots.nearest(block)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(cell), pa.array(off)], names=["id", "x", "cell", "off"])

    return vectors.mapInArrow(run, "id long, x array<long>, cell long, off double")


BLOCK = "cell long, block long, n int, dim int, bits int, ids binary, data binary, keys binary"


def blocks_of(rows: DataFrame, size: int) -> DataFrame:
    """Vectors packed by cell, about `size` to a block, in the narrowest whole numbers that hold them."""
    counts = rows.groupBy("cell").agg(F.ceil(F.count("*") / size).alias("parts"))
    dealt = rows.join(counts, "cell").withColumn("block", F.pmod(F.xxhash64("id", "x"), F.col("parts")))

    def pack(table: pa.Table) -> pa.Table:
        table = table.combine_chunks().sort_by("id")
        x = np.array(table["x"].to_pylist(), np.int64).reshape(table.num_rows, -1)
        most = int(np.abs(x).max()) if x.size else 0
        bits = 16 if 0 <= most < 1 << 15 else 64
        return pa.table(
            {
                "cell": [table["cell"][0].as_py()],
                "block": [table["block"][0].as_py()],
                "n": pa.array([len(x)], pa.int32()),
                "dim": pa.array([x.shape[1]], pa.int32()),
                "bits": pa.array([bits], pa.int32()),
                "ids": [table["id"].to_numpy().astype("<i8").tobytes()],
                "data": [x.astype(f"<i{bits // 8}").tobytes()],
                "keys": [table["key"].to_numpy().astype("<i8").tobytes()],
            }
        )

    keyed = dealt.select("cell", "block", "id", "x", F.xxhash64("x").alias("key"))
    return keyed.groupBy("cell", "block").applyInArrow(pack, BLOCK)


def qualified(queries: list, data: list, pivots: Pivots, k: int) -> list[tuple[int, int]]:
    """The pairs of a query cell and a data cell whose members may score among the k best, by the cells' summaries.

    Summaries are cell, n, radius, and for data the distances of the k + 1 nearest of different ids, with those ids (without
    them all rows count as different). Of each id only the best row of all cells counts, so one at most is the query's own.
    """
    found = []
    for q in queries:
        p = pivots.point(q["cell"])
        norm = np.linalg.norm(p) + q["radius"]
        upper, sure = [], {}
        for d in data:
            c = pivots.point(d["cell"])
            if len(c) != len(p):
                continue
            middle, slip = float(p @ c), q["radius"] * float(np.linalg.norm(c))
            wide = SLACK * (1 + abs(middle) + slip + norm * d["radius"])
            upper.append((middle + slip + norm * d["radius"] + wide, d["cell"]))
            names = d["ids"] if "ids" in d else [(d["cell"], i) for i in range(len(d["near"]))]
            for name, x in zip(names, d["near"], strict=True):
                sure[name] = max(sure.get(name, -np.inf), middle - slip - norm * x - wide)
        reached = sorted(sure.values(), reverse=True)[k] if len(sure) > k else -np.inf
        found += [(q["cell"], cell) for bound, cell in upper if bound >= reached]
    return found


def top_of_blocks(queries: list[dict], data: list[dict], k: int) -> tuple[np.ndarray, ...]:
    """query id, query key, vector id and score of the k best of each query; equal scores go to the smaller id."""
    out = []
    for q in queries:
        a = unpacked(q)
        q_ids, q_keys = np.frombuffer(q["ids"], "<i8"), np.frombuffer(q["keys"], "<i8")
        for low in range(0, len(a), 512):
            kept = None
            for d in data:
                b, ids = unpacked(d), np.frombuffer(d["ids"], "<i8")
                scores = products(a[low : low + 512], b)
                own = q_ids[low : low + 512, None] == ids[None, :]
                scores[own] = np.iinfo(np.int64).min
                row, column = best(scores, k)
                real = ~own[row, column]
                row, column = row[real], column[real]
                new = row, ids[column], scores[row, column]
                kept = new if kept is None else tuple(np.concatenate(x) for x in zip(kept, new, strict=True))
                order = np.lexsort((kept[1], -kept[2], kept[0]))
                kept = tuple(x[order][rank_in(kept[0][order]) < k] for x in kept)
            out.append((q_ids[low + kept[0]], q_keys[low + kept[0]], kept[1], kept[2]))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def unpacked(block: dict) -> np.ndarray:
    return np.frombuffer(block["data"], f"<i{block['bits'] // 8}").reshape(block["n"], block["dim"]).astype(np.int64)


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products as 64-bit integers; by floating point where every sum is exact in it."""
    most = float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * max(a.shape[1], 1)
    if most < 2.0**52:
        return (a.astype(float) @ b.astype(float).T).astype(np.int64)
    return a @ b.T


def best(scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows and columns of all entries that reach the k-th best of their row."""
    n = scores.shape[1]
    if n <= k:
        row, column = np.indices(scores.shape)
        return row.ravel(), column.ravel()
    least = np.partition(scores, n - k, axis=1)[:, n - k]
    return np.nonzero(scores >= least[:, None])


def rank_in(group: np.ndarray) -> np.ndarray:
    """Place of each entry in its group, from 0, where equal entries stand together."""
    first = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]])) if len(group) else np.zeros(0, np.int64)
    return np.arange(len(group)) - np.repeat(first, np.diff(np.append(first, len(group))))


def top_k(
    queries: DataFrame, data: DataFrame, name: str, vector: str, k: int = 5, scale: int = 256, pivots: int = 16, rows: int = 2048
) -> DataFrame:
    """`query_id`, `rank` (from 1), `vec_id`, `score`: the `k` data rows of highest integer inner product for each query.

    Components become floor(scale * x). A row is not its own candidate: equal ids never match. Equal scores go to the
    smaller id; with fewer than `k` candidates all come. Rows with a null id or vector, or with a null, infinite or NaN
    component, take no part. Vectors of different lengths are not compared. Repeated rows count once; an id with several
    vectors is several rows. Other columns are not read. Of equal vectors only the `k` + 1 smallest ids can be in a result,
    so no more are kept; any number of them is one point. Empty tables give no rows.
    """
    spark = data.sparkSession
    points = staged(vectors_of(data, name, vector, scale), "vectors")
    same = Window.partitionBy("x").orderBy("id")
    points = points.withColumn("k", F.row_number().over(same)).where(F.col("k") <= k + 1).drop("k")
    chosen = points.orderBy(F.xxhash64("id"), "id").select("x").limit(pivots).collect()  # `pivots` rows
    near = Pivots([r["x"] for r in chosen])
    points = staged(assigned(points, near), "cells")
    asked = staged(assigned(vectors_of(queries, name, vector, scale), near), "query-cells")
    order = Window.partitionBy("cell").orderBy("off", "id")
    single = points.groupBy("cell", "id").agg(F.min("off").alias("off"))
    nearest = single.withColumn("k", F.row_number().over(order)).where(F.col("k") <= k + 1)
    nearest = nearest.groupBy("cell").agg(F.sort_array(F.collect_list(F.struct("off", "id"))).alias("near"))
    nearest = nearest.select("cell", F.col("near.off").alias("near"), F.col("near.id").alias("ids"))
    summary = points.groupBy("cell").agg(F.max("off").alias("radius"), F.count("*").alias("n")).join(nearest, "cell")
    summary, wanted = summary.collect(), asked.groupBy("cell").agg(F.max("off").alias("radius")).collect()  # a row a cell
    pairs = spark.createDataFrame(qualified(wanted, summary, near, k) or [(0, 0)], "query_cell long, cell long")
    data_blocks = staged(blocks_of(points, rows), "data-blocks")
    query_blocks = staged(blocks_of(asked, 2 * rows), "query-blocks")
    slots = max(1, -(-sum(s["n"] for s in summary) // (16 * rows)))
    targets = query_blocks.select(F.col("cell").alias("query_cell"), F.col("block").alias("query_block"))
    targets = targets.join(pairs, "query_cell")
    sent = data_blocks.join(targets, "cell").withColumn("slot", F.pmod(F.xxhash64("cell", "block"), F.lit(slots)))
    group = ["query_cell", "query_block", "slot"]
    asking = query_blocks.withColumnsRenamed({"cell": "query_cell", "block": "query_block"})
    asking = asking.withColumn("slot", F.explode(F.sequence(F.lit(0), F.lit(slots - 1)))).withColumn("slot", F.col("slot").cast("long"))

    def solve(left: pa.Table, right: pa.Table) -> pa.Table:
        found = [np.zeros(0, np.int64)] * 4
        if left.num_rows and right.num_rows:
            found = top_of_blocks(left.to_pylist(), right.to_pylist(), k)
        return pa.table(dict(zip(["query_id", "query_key", "vec_id", "score"], map(pa.array, found), strict=True)))

    found = (
        asking.groupBy(*group)
        .cogroup(sent.groupBy(*group))
        .applyInArrow(solve, "query_id long, query_key long, vec_id long, score long")
    )
    order = Window.partitionBy("query_id", "query_key").orderBy(F.desc("score"), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
