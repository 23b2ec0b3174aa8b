"""A Merkle manifest of a data set, with a proof for every row, as a content-addressed graph that is descended by rank.

Every row is a leaf, the digest of its fields. The leaves of a group (a language) stand in order of their ids; every
`arity` neighbours become a node whose digest is that of theirs, until one is left, and the groups' last ones form a tree
of the same kind. The graph is kept as records from a digest to the digests below it.

A proof is found from the root: the rank of a leaf, written in digits to the base `arity`, names the child to go to at
every step, and the children not chosen are what the proof needs. Leaves below one node share the way to it, so the way
is followed once a node, not once a leaf; turned round, it leads from the leaf to the root.

Nothing is sorted in one place: ranks are places in range partitions plus the sizes of the partitions before. Only
digests move, never texts. Equal rows are counted before they are sent, and come out as many times.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from blockledger.llm.langid import quoted
from blockledger.llm.staging import repeated, shared_path, shuffle_parts, staged

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
SEGMENT = "struct<before: string, after: string>"


def field(value: Column) -> Column:
    """A field as the digest reads it: its length in bytes, a colon and the value, or a dash for null."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_digest(fields=FIELDS, **replaced: Column) -> Column:
    """The digest of a row; `replaced` gives other values for some of its fields."""
    return F.sha2(F.concat(*[field(replaced.get(name, quoted(name))) for name in fields]), 256)


@dataclass
class Manifest:
    """A manifest in the folder `path`.

    leaves: group, id, leaf, rank in the group, n of the group, and what was carried along; groups: group, n, subroot,
    place; nodes: by tree and level, the records digest to children. `root` is null if there are no rows.
    """

    spark: SparkSession
    path: str
    root: str | None
    group_levels: int
    levels: int
    arity: int

    def leaves(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/leaves")

    def groups(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/groups")

    def nodes(self, tree: str, level: int) -> DataFrame:
        """`digest`, `children`: each record once, however many nodes have the same content."""
        rows = self.spark.read.parquet(f"{self.path}/nodes/{tree}/level={level}").select("digest", "children")
        return rows.dropDuplicates(["digest"])


def placed(rows: DataFrame, order: list[str], name: str) -> DataFrame:
    """`rows` with `pos`, their place from 0 in `order`, nulls first. `order` tells all rows apart.

    Written once where it stands, so that places are not given twice; the sizes of the partitions, one row each, are
    what is broadcast.
    """
    ranged = rows.repartitionByRange(shuffle_parts(rows.sparkSession), *order).sortWithinPartitions(*order)
    kept = staged(ranged.withColumn("_at", F.monotonically_increasing_id()), name).withColumn("_part", F.shiftright("_at", 33))
    sizes = kept.groupBy("_part").agg(F.count("*").alias("_n"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    pos = F.col("_start") + F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))
    return kept.join(F.broadcast(starts), "_part").withColumn("pos", pos).drop("_at", "_part", "_start")


def _climb(rows: DataFrame, most: int, path: str, arity: int) -> tuple[DataFrame, int]:
    """Writes the nodes above `rows` (tree, rank, n, digest), n of a tree. Returns tree and digest of each top, and levels."""
    spark, level = rows.sparkSession, 0
    tops = rows.where(F.col("n") == 1).select("tree", "digest")
    while most > 1:
        level, most = level + 1, -(-most // arity)
        one = F.transform(F.array_sort(F.collect_list(F.struct("rank", "digest"))), lambda x: x["digest"])
        nodes = (
            rows.where(F.col("n") > 1)
            .groupBy("tree", F.expr(f"rank div {arity}").alias("rank"), F.expr(f"(n + {arity - 1}) div {arity}").alias("n"))
            .agg(one.alias("children"))
            .withColumn("digest", F.sha2(F.array_join("children", ""), 256))
        )
        nodes.write.option("compression", "zstd").parquet(f"{path}/level={level}")
        rows = spark.read.schema(nodes.schema).parquet(f"{path}/level={level}").drop("children")
        tops = tops.unionByName(rows.where(F.col("n") == 1).select("tree", "digest"))
    return tops, level


def write_manifest(
    docs: DataFrame, path: str, *, group="lang", order="doc_id", fields=FIELDS, carry: dict[str, Column] | None = None, arity=8
) -> Manifest:
    """Write the manifest of `docs` below `path`, a folder that all executors reach.

    Leaves of a group stand in order of `order`, null first, equal ones by digest; groups in order of their names, null
    first. Any column may be null; an empty text is a field of no bytes. Rows alike in all that is read are as many leaves. `carry`
    names further values of a row to keep with its leaf. Other columns are not read, whatever their names. A group of one
    row is its own subroot. No rows give a manifest without a root.
    """
    spark, extra = docs.sparkSession, carry or {}
    read = docs.select(
        quoted(group).alias("group"), quoted(order).alias("id"), leaf_digest(fields).alias("leaf"),
        *[value.alias(name) for name, value in extra.items()],
    )
    counted = staged(read.groupBy(*read.columns).agg(F.count("*").alias("copies")), "manifest-leaves")
    rows = placed(repeated(counted, "leaf"), ["group", "id", "leaf", *extra, "copy"], "manifest-order").drop("copy")
    spans = rows.groupBy("group").agg(F.min("pos").alias("_first"), F.count("*").alias("n"))
    names = placed(spans, ["group"], "manifest-groups").withColumnRenamed("pos", "place")
    leaves = rows.join(names.withColumnRenamed("group", "_group"), F.col("group").eqNullSafe(F.col("_group")))
    leaves = leaves.select("group", "place", "id", "leaf", (F.col("pos") - F.col("_first")).alias("rank"), "n", *extra)
    leaves.write.option("compression", "zstd").parquet(f"{path}/leaves")
    leaves = spark.read.schema(leaves.schema).parquet(f"{path}/leaves")

    sizes = names.agg(F.max("n"), F.count("*")).first()
    trees = leaves.select(F.col("place").alias("tree"), "rank", "n", F.col("leaf").alias("digest"))
    tops, levels = _climb(trees, sizes[0] or 0, f"{path}/nodes/leaves", arity)
    groups = names.join(tops.withColumnRenamed("digest", "subroot"), F.col("place") == F.col("tree"))
    groups = groups.select("group", "place", "n", "subroot")
    groups.write.parquet(f"{path}/groups")
    groups = spark.read.schema(groups.schema).parquet(f"{path}/groups")
    above = groups.select(F.lit(0).cast("long").alias("tree"), F.col("place").alias("rank"), F.lit(sizes[1]).alias("n"), F.col("subroot").alias("digest"))
    top, group_levels = _climb(above, sizes[1], f"{path}/nodes/groups", arity)
    top.coalesce(1).write.parquet(f"{path}/root")
    root = spark.read.schema(top.schema).parquet(f"{path}/root").first()
    return Manifest(spark, path, root and root["digest"], group_levels, levels, arity)


def _chosen(children: str, k: Column) -> Column:
    """What stands before and after child `k`."""
    before = F.array_join(F.slice(children, F.lit(1), k), "")
    after = F.array_join(F.slice(children, k + 2, F.size(children)), "")
    return F.struct(before.alias("before"), after.alias("after"))


def _down(frontier: DataFrame, nodes: DataFrame, arity: int, wanted: DataFrame | None, enters: Column) -> DataFrame:
    """One step: from each node of `frontier` (tree, at, digest, way) that `enters` to its children, the others stay."""
    records = nodes.select(F.col("digest").alias("_digest"), "children")
    opened = frontier.join(records, (F.col("digest") == F.col("_digest")) & enters, "left")
    rest = [c for c in frontier.columns if c not in ("at", "digest", "way")]
    steps = opened.select("*", F.posexplode_outer("children").alias("k", "child"))
    there = F.col("k").isNotNull()
    steps = steps.select(
        *rest,
        F.when(there, F.col("at") * arity + F.col("k")).otherwise(F.col("at")).alias("at"),
        F.coalesce("child", "digest").alias("digest"),
        F.when(there, F.concat("way", F.array(_chosen("children", F.col("k"))))).otherwise(F.col("way")).alias("way"),
    )
    return steps if wanted is None else steps.join(wanted, ["tree", "at"], "left_semi")


def _powers(arity: int) -> Column:
    powers = [1]
    while powers[-1] < 1 << 56:
        powers.append(powers[-1] * arity)
    return F.array(*[F.lit(p).cast("long") for p in powers])


def depth(n: str, arity: int) -> Column:
    """Steps from the top of a tree of `n` leaves to them."""
    return F.size(F.filter(_powers(arity), lambda p: p < F.col(n)))


def prove(manifest: Manifest, requests: DataFrame | None = None) -> DataFrame:
    """`requests` with `subroot`, `root` and `path`: the digests before and after it at every step from leaf to root.

    `requests` are rows of `manifest.leaves()`, all of them if none are given; only nodes on their ways are opened. A
    step at which a node stands alone has two empty strings. Repeated requests are answered each. No requests give no
    rows.
    """
    spark, arity = manifest.spark, manifest.arity
    asked = manifest.leaves() if requests is None else requests
    if manifest.root is None:
        return asked.withColumns({"subroot": F.lit(None).cast("string"), "root": F.lit(None).cast("string"), "path": F.array().cast(f"array<{SEGMENT}>")})
    ways = spark.read.parquet(f"{manifest.path}/root").select(
        "tree", F.lit(0).cast("long").alias("at"), "digest", F.array().cast(f"array<{SEGMENT}>").alias("way")
    )
    for level in range(manifest.group_levels, 0, -1):
        ways = _down(ways, manifest.nodes("groups", level), arity, None, F.lit(True))
    tops = manifest.groups().select(F.col("place").alias("at"), depth("n", arity).alias("deep"), "subroot")
    if requests is not None:
        tops = tops.join(asked.select(F.col("place").alias("at")).distinct(), "at", "left_semi")
    ways = ways.join(tops, "at").select(F.col("at").alias("tree"), F.lit(0).cast("long").alias("at"), "digest", "way", "deep", "subroot")
    wanted = None if requests is None else _wanted(asked, manifest.levels, arity)
    for level in range(manifest.levels, 1, -1):
        here = wanted and wanted[level - 1]
        ways = _down(ways, manifest.nodes("leaves", level), arity, here, F.col("deep") >= level)
    if manifest.levels:
        records = manifest.nodes("leaves", 1).select(F.col("digest").alias("_digest"), "children")
        ways = ways.join(records, (F.col("digest") == F.col("_digest")) & (F.col("deep") > 0), "left")
    else:
        ways = ways.withColumn("children", F.lit(None).cast("array<string>"))
    ways = ways.select(F.col("tree").alias("_tree"), F.col("at").alias("_run"), "way", "children", "subroot")
    met = (F.col("place") == F.col("_tree")) & (F.expr(f"rank div {arity}") == F.col("_run"))
    last = F.when(F.col("children").isNotNull(), F.array(_chosen("children", (F.col("rank") % arity).cast("int"))))
    path = F.reverse(F.concat("way", F.coalesce(last, F.array().cast(f"array<{SEGMENT}>"))))
    return asked.join(ways, met).select(*[quoted(c) for c in asked.columns], "subroot", F.lit(manifest.root).alias("root"), path.alias("path"))


def _wanted(asked: DataFrame, levels: int, arity: int) -> list[DataFrame]:
    """By level, tree and number of the nodes on the ways of `asked`. A tree whose top is lower down waits as number 0."""
    found = [staged(asked.select(F.col("place").alias("tree"), F.col("rank").alias("at")).distinct(), "ways")]
    for level in range(1, levels):
        found.append(staged(found[-1].select("tree", F.expr(f"at div {arity}").alias("at")).distinct(), "ways"))
    return found


def folded(leaf: str, path: str = "path") -> Column:
    """The root that follows from a leaf's digest and its path."""
    step = lambda digest, at: F.sha2(F.concat(at["before"], digest, at["after"]), 256)
    return F.aggregate(path, F.col(leaf), step)


def proof_digest(path: str = "path") -> Column:
    return F.sha2(F.array_join(F.transform(path, lambda at: F.concat(at["before"], at["after"])), ""), 256)


def verify(docs: DataFrame, claim: Column, *, path: str | None = None, **options) -> DataFrame:
    """The manifest of `docs`, with every row held against the digest `claim` of what it is said to be.

    Gives id, leaf, claim, subroot, root, path, folded_root and verified (the claim leads to the root), one row for each of `docs`.
    """
    place = path or shared_path(docs.sparkSession, "manifest")
    manifest = write_manifest(docs, place, carry={"claim": claim}, **options)
    proofs = prove(manifest).withColumn("folded_root", folded("claim"))
    return proofs.withColumn("verified", F.col("folded_root") == F.col("root"))
