"""Near duplicates by n-gram Jaccard similarity, exact: a join over a token-group matrix.

Tokens are hashes of word shingles; a document is the set of its own, and equal sets are one node. Similar sets share one
of their first few tokens in any common order, and in one that puts frequent tokens last few others do.

1. Nodes that share such a token are compared with one of them, which stands for it; links found so make groups.
2. For the tokens still found in several components, the matrix tells which groups of about `GROUP` nodes have them. A
   node is sent to such a group only if sizes allow a link, and if as many of its first tokens are in the group's row as
   any link would need. There it is compared with the union of all tokens of the group, and the group is opened, that
   is the node compared with every member, only if the union holds enough of its tokens.

Pairs within a component are not enumerated, and no link between components is lost.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from blockledger.llm.bpe import slices
from blockledger.llm.components import components
from blockledger.llm.hashing import BLANKS, mixed, text_bytes, word_hashes
from blockledger.llm.langid import quoted
from blockledger.llm.staging import bucketed, free_of, keyed, shuffle_parts, staged

GROUP = 256  # members of a group
BAND = 1.05  # sizes in a group differ by no more than this
FREQUENT, LISTED = 32, 100_000  # a token in so many prefixes is frequent; so many of the most frequent are put last
POSTING = 4_096  # nodes of a frequent token that are looked at together
LOAD = 2_000_000  # tokens of the nodes that a group is compared with at once
STEPS = [np.uint64(int(x)) for x in np.random.default_rng(7).integers(1, 1 << 62, 64) * 2 + 1]


def token_sets(column: pa.Array, width: int) -> list[np.ndarray]:
    """The sorted distinct tokens of every text: its `width`-word shingles, or all its words if it has fewer."""
    data, cuts = text_bytes(column)
    words, ends, _, _ = word_hashes(data, cuts, BLANKS)
    n = len(words) - width + 1
    grams = np.zeros(max(n, 0), np.uint64)
    for i in range(width if n > 0 else 0):
        grams += words[i : i + n] * STEPS[i]
    grams = mixed(grams)
    sets = []
    for a, b in zip(ends.tolist(), ends[1:].tolist(), strict=False):
        if b - a >= width:
            sets.append(np.unique(grams[a : b - width + 1]))
        elif b > a:
            short = (words[a:b] * np.array(STEPS[: b - a])).sum(dtype=np.uint64, keepdims=True)
            sets.append(mixed(short + np.array([b - a], np.uint64) * STEPS[-1]))
        else:
            sets.append(np.zeros(0, np.uint64))
    return sets


def node_of(tokens: np.ndarray) -> np.uint64:
    return mixed(mixed(tokens).sum(dtype=np.uint64, keepdims=True))[0]


def prefix(tokens: np.ndarray, share: int, frequent: np.ndarray) -> np.ndarray:
    """The first tokens of a sorted set, frequent ones last, of which a set of at least that similarity has one too."""
    n = len(tokens)
    first = n + share * n // -100 + 1
    if len(frequent):
        at = np.searchsorted(frequent, tokens)
        late = frequent[np.minimum(at, len(frequent) - 1)] == tokens
        tokens = np.concatenate([tokens[~late], tokens[late]])
    return tokens[:first]


def dealt(tokens: np.ndarray, nodes: np.ndarray, sizes: np.ndarray, salts: np.ndarray, parts: int) -> pa.RecordBatch:
    """Postings as one row of packed numbers for each of `parts` buckets."""
    bucket = (mixed(tokens + salts * STEPS[-2]) % np.uint64(parts)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    ends = np.searchsorted(bucket[order], np.arange(parts + 1))
    full = [i for i in range(parts) if ends[i] < ends[i + 1]]
    packed = [[x[order[ends[i] : ends[i + 1]]].tobytes() for i in full] for x in (tokens, nodes, sizes)]
    names = ["bucket", "tokens", "nodes", "sizes"]
    return pa.RecordBatch.from_arrays([pa.array(full, pa.int64()), *[pa.array(x, pa.binary()) for x in packed]], names=names)


POSTINGS = "bucket long, tokens binary, nodes binary, sizes binary"


def postings(docs: DataFrame, width: int, share: int, frequent: dict[str, np.ndarray], parts: int) -> DataFrame:
    """The prefix tokens of every text with its node and size. The postings of a frequent token go to several buckets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list[tuple[np.ndarray, ...]] = []
        held = 0

        def flush():
            tokens, nodes, sizes = (np.concatenate(x) for x in zip(*kept, strict=True))
            kept.clear()
            salts = np.zeros(len(tokens), np.uint64)
            if len(frequent["token"]):
                at = np.minimum(np.searchsorted(frequent["token"], tokens), len(frequent["token"]) - 1)
                many = np.where(frequent["token"][at] == tokens, frequent["n"][at] // POSTING + 1, 1).astype(np.uint64)
                salts = nodes % many
            return dealt(tokens, nodes, sizes, salts, parts)

        for batch in batches:
            for part in slices(batch, 2 << 20):
                for tokens in token_sets(part.column(1), width):
                    if len(tokens):
                        chosen = prefix(tokens, share, frequent["token"])
                        n = len(chosen)
                        kept.append((chosen, np.full(n, node_of(tokens)), np.full(n, len(tokens), np.int32)))
                        held += n
                if held > 2_000_000:
                    held = 0
                    yield flush()
        if kept:
            yield flush()

    return docs.select("_key", "text").mapInArrow(run, POSTINGS)


def unpacked(table: pa.Table) -> tuple[np.ndarray, ...]:
    """Distinct postings of a bucket in order of token and node, and where those of each token begin and end."""
    tokens = np.frombuffer(b"".join(table["tokens"].to_pylist()), np.uint64)
    nodes = np.frombuffer(b"".join(table["nodes"].to_pylist()), np.uint64)
    sizes = np.frombuffer(b"".join(table["sizes"].to_pylist()), np.int32)
    order = np.lexsort((nodes, tokens))
    tokens, nodes, sizes = tokens[order], nodes[order], sizes[order]
    new = np.ones(len(tokens), bool)
    new[1:] = (tokens[1:] != tokens[:-1]) | (nodes[1:] != nodes[:-1])
    tokens, nodes, sizes = tokens[new], nodes[new], sizes[new]
    starts = np.flatnonzero(np.concatenate([[True], tokens[1:] != tokens[:-1]]))
    return tokens, nodes, sizes, starts, np.append(starts[1:], len(tokens))


def frequent_tokens(posted: DataFrame) -> dict[str, np.ndarray]:
    """The most frequent prefix tokens, at most `LISTED`, with their counts and the first of their nodes.

    Only the order of tokens and the split of their postings depend on it, never a result.
    """

    def count(table: pa.Table) -> pa.Table:
        tokens, nodes, sizes, starts, stops = unpacked(table)
        often = np.flatnonzero(stops - starts >= FREQUENT)
        at = starts[often]
        columns = (tokens[at].view(np.int64), (stops - starts)[often], nodes[at].view(np.int64), sizes[at])
        return pa.table(dict(zip(["token", "n", "node", "size"], map(pa.array, columns), strict=True)))

    counted = posted.groupBy("bucket").applyInArrow(count, "token long, n long, node long, size int")
    rows = counted.orderBy(F.desc("n"), "token").limit(LISTED).toPandas()  # at most LISTED rows of four numbers
    token = rows["token"].to_numpy(np.int64).view(np.uint64)
    order = np.argsort(token)
    return {
        "token": token[order],
        "n": rows["n"].to_numpy(np.int64)[order],
        "node": rows["node"].to_numpy(np.int64).view(np.uint64)[order],
        "size": rows["size"].to_numpy(np.int32)[order],
    }


def shared_postings(posted: DataFrame, frequent: dict[str, np.ndarray]) -> DataFrame:
    """`token`, `node`, `size`, `first`, `first_size` of the tokens that more than one node has."""

    def run(table: pa.Table) -> pa.Table:
        tokens, nodes, sizes, starts, stops = unpacked(table)
        count = stops - starts
        first, first_size = np.repeat(nodes[starts], count), np.repeat(sizes[starts], count)
        kept = np.repeat(count > 1, count)
        if len(frequent["token"]) and len(tokens):
            at = np.minimum(np.searchsorted(frequent["token"], tokens), len(frequent["token"]) - 1)
            listed = frequent["token"][at] == tokens
            first = np.where(listed, frequent["node"][at], first)
            first_size = np.where(listed, frequent["size"][at], first_size)
            kept |= listed
        columns = (tokens.view(np.int64), nodes.view(np.int64), sizes, first.view(np.int64), first_size)
        names = ["token", "node", "size", "first", "first_size"]
        return pa.table(dict(zip(names, (pa.array(x[kept]) for x in columns), strict=True)))

    return posted.groupBy("bucket").applyInArrow(run, "token long, node long, size int, first long, first_size int")


def least_common(a: str, b: str, share: int) -> str:
    """How many tokens linked sets of these sizes share at least among their prefixes.

    All they share up to the end of the prefix that ends first is in both, and beyond it one of them has only so many.
    """
    return f"{share} / {100 + share} * ({a} + {b}) - {share} / 100 * greatest({a}, {b}) - 1e-6"


def fits(a: str, b: str, share: int) -> str:
    """Do the sizes of two sets allow the similarity?"""
    return f"{share} * greatest({a}, {b}) <= 100 * least({a}, {b})"


def _bounds(smallest: str, largest: str, share: int) -> tuple[str, str]:
    return f"greatest({smallest}, {share} / 100 * size)", f"least({largest}, 100 / {share} * size)"


def _near(smallest: str, largest: str, share: int) -> Column:
    """May a set of `size` be linked with one of these sizes?"""
    low, high = _bounds(smallest, largest, share)
    return F.expr(f"{low} <= {high} + 1e-6")


def _enough(smallest: str, largest: str, share: int) -> Column:
    """Are there as many common tokens in `common` as any such link needs? The need is least at one of the ends."""
    low, high = _bounds(smallest, largest, share)
    return F.expr(f"common >= least({least_common('size', low, share)}, {least_common('size', high, share)})")


def sets_of(kept: DataFrame, named: DataFrame, wanted: DataFrame, width: int) -> DataFrame:
    """`node`, `tokens` (packed) of the nodes in `wanted`, once each, from a text that has them."""
    chosen = named.join(wanted.select("node").distinct(), "node", "left_semi").groupBy("node").agg(F.min("_key").alias("_key"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 2 << 20):
                sets = [x.tobytes() for x in token_sets(part.column(1), width)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(sets, pa.binary())], names=["node", "tokens"])

    texts = kept.select("_key", "text").join(chosen.hint("shuffle_hash"), "_key").dropDuplicates(["_key"])  # moves nothing
    return texts.select("node", "text").mapInArrow(run, "node long, tokens binary")


def groups(postings: DataFrame) -> DataFrame:
    """`gid`, `band`, `node`, `size`, `rank`, `root` of every node: groups of about `GROUP` nodes of one band of sizes.

    Nodes are put together that share most tokens with the same other node. `rank` is how many nodes are in a component.
    """
    shares = postings.groupBy("node", "size", "root", "first").agg(F.count("*").alias("n"))
    nodes = shares.groupBy("node", "size", "root").agg(F.max_by("first", F.struct("n", "first")).alias("like"))
    nodes = nodes.withColumn("band", F.floor(F.log("size") / F.log(F.lit(BAND))))
    counts = nodes.groupBy("like", "band").agg(F.ceil(F.count("*") / GROUP).alias("parts"))
    ranks = nodes.groupBy("root").agg(F.count("*").alias("rank"))
    dealt = nodes.join(counts, ["like", "band"]).join(ranks, "root")
    gid = F.xxhash64("like", "band", F.pmod(F.xxhash64("node"), F.col("parts")))
    return dealt.select(gid.alias("gid"), "band", "node", "size", "rank", "root")


def opened(members: DataFrame, queries: DataFrame, sets: DataFrame, share: int) -> DataFrame:
    """Links `a`, `b` between the `node`s of `queries` and the members of higher (`rank`, `root`) with the same `gid`.

    Pairs that links found in the same call connect already are not compared. Queries of a group are cut into parts of
    about `LOAD` tokens, each beside a copy of the members.
    """
    loads = queries.groupBy("gid").agg((F.sum("size") / LOAD + 1).cast("int").alias("parts"))
    part = F.pmod(F.xxhash64("node"), F.col("parts")).cast("int").alias("part")
    columns = ["node", "rank", "root"]
    asked = queries.join(loads, "gid").select("gid", part, *columns, F.lit(True).alias("asks"))
    copies = F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part")
    held = members.join(loads, "gid").select("gid", copies, *columns, F.lit(False).alias("asks"))

    def compare(table: pa.Table) -> pa.Table:
        left, right = table.filter(pc.invert(table["asks"])), table.filter(table["asks"])
        found: list[tuple[int, int]] = []
        own = list(zip(*(left[c].to_pylist() for c in ("node", "rank", "root")), strict=True))
        inside = [np.frombuffer(x, np.uint64) for x in left["tokens"].to_pylist()]
        union = np.unique(np.concatenate(inside)) if inside else np.zeros(0, np.uint64)
        into: dict[int, int] = {}

        def top(root: int) -> int:
            while root in into:
                root = into[root]
            return root

        for row in right.select(["node", "rank", "root", "tokens"]).to_pylist() if inside else []:
            tokens = np.frombuffer(row["tokens"], np.uint64)
            if 100 * common(tokens, union) < share * len(tokens):
                continue
            for (node, rank, root), its in zip(own, inside, strict=True):
                small, large = sorted((len(tokens), len(its)))
                if (rank, root) <= (row["rank"], row["root"]) or share * large > 100 * small or top(root) == top(row["root"]):
                    continue
                both = common(tokens, its)
                if 100 * both >= share * (small + large - both):
                    found.append((row["node"], node))
                    into[top(row["root"])] = top(root)
        return pa.table({"a": pa.array([x[0] for x in found], pa.int64()), "b": pa.array([x[1] for x in found], pa.int64())})

    # Where a node goes is known before its tokens are: they move to it, and then to the groups, and no further.
    rows = asked.unionByName(held).join(sets, "node")
    return rows.groupBy("gid", "part").applyInArrow(compare, "a long, b long")


def common(a: np.ndarray, b: np.ndarray) -> int:
    """How many numbers two sorted sets share."""
    if len(a) > len(b):
        a, b = b, a
    if not len(a):
        return 0
    at = np.searchsorted(b, a)
    return int((b[np.minimum(at, len(b) - 1)] == a).sum())


def near_components(docs: DataFrame, width: int, share: int) -> tuple[DataFrame, DataFrame]:
    """The bucketed copy of `docs`, and `_key`, `node`, `n_shingles`, `root` of every document."""
    spark = docs.sparkSession
    kept = bucketed(keyed(docs), "_key", "texts")
    parts = 4 * shuffle_parts(spark)

    def name(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 2 << 20):
                sets = token_sets(part.column(1), width)
                nodes = np.array([node_of(x) for x in sets], np.uint64).view(np.int64)
                sizes = pa.array([len(x) for x in sets], pa.int64())
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(nodes), sizes], names=["_key", "node", "n_shingles"])

    none = {k: np.zeros(0, t) for k, t in (("token", np.uint64), ("n", np.int64), ("node", np.uint64), ("size", np.int32))}
    source = keyed(docs.select("doc_id", "text"))
    frequent = frequent_tokens(postings(source, width, share, none, parts))
    named = staged(source.select("_key", "text").mapInArrow(name, "_key long, node long, n_shingles long"), "nodes")
    some = named.where("n_shingles > 0")
    shared = staged(shared_postings(postings(source, width, share, frequent, parts), frequent), "postings")
    stars = shared.where("node <> first").where(fits("size", "first_size", share))
    stars = stars.groupBy("first", "node", "size", "first_size").agg(F.count("*").alias("common"))
    stars = staged(stars.where(f"common >= {least_common('size', 'first_size', share)}"), "stars")
    leaders = stars.select(*[F.col("first").alias(c) for c in ("gid", "node", "root")], F.lit(1).alias("rank")).distinct()
    queries = stars.select(F.col("first").alias("gid"), "node", F.col("node").alias("root"), "size", F.lit(0).alias("rank"))
    sets = sets_of(kept, some, leaders.select("node").unionByName(queries.select("node")), width)
    links = staged(opened(leaders, queries, sets, share), "links")
    roots = staged(components(links), "roots")
    placed = shared.select("token", "node", "size", "first").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    cross = placed.groupBy("token").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low < high")
    open_postings = staged(placed.join(cross.select("token"), "token", "left_semi"), "open-postings")
    grouped = staged(groups(open_postings), "groups")
    matrix = open_postings.select("token", "node").join(grouped.select("node", "gid", "band"), "node").select("token", "gid", "band").distinct()
    facts = grouped.groupBy("gid").agg(
        F.min("size").alias("smallest"), F.max("size").alias("largest"), F.max(F.struct("rank", "root")).alias("above")
    )
    # Sizes and tokens rule most groups out by the band alone, before anything is sent on; the rest by the group's own facts.
    asking = open_postings.select("token", "node", "size").join(matrix, "token")
    asking = asking.where(_near(f"pow({BAND}, band) * (1 - 1e-9)", f"pow({BAND}, band + 1) * (1 + 1e-9)", share))
    asking = asking.groupBy("gid", "band", "node", "size").agg(F.count("*").alias("common"))
    asking = asking.where(_enough(f"pow({BAND}, band) * (1 - 1e-9)", f"pow({BAND}, band + 1) * (1 + 1e-9)", share)).drop("band", "size")
    asking = asking.join(grouped.drop("gid", "band"), "node").join(facts, "gid").where(F.struct("rank", "root") < F.col("above"))
    asking = asking.where(_near("smallest", "largest", share)).where(_enough("smallest", "largest", share))
    asking = asking.select("gid", "node", "size", "rank", "root")
    asking = staged(asking, "asking")
    members = grouped.join(asking.select("gid").distinct(), "gid", "left_semi").select("gid", "node", "rank", "root")
    sets = sets_of(kept, some, members.select("node").unionByName(asking.select("node")), width)
    more = opened(members, asking, sets, share)
    roots = components(links.unionByName(more))
    found = named.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    return kept, found


def near_duplicates(docs: DataFrame, width: int = 4, share: int = 85) -> DataFrame:
    """`doc_id`, `n_shingles`, `component_id` of every row: the smallest doc_id that links lead to, its own included.

    Tokens are `width`-word shingles; two documents link if 100 * common >= `share` * all of their tokens. A document with
    fewer words has its whole sequence as its one token. Null and empty texts and those without words have none and link
    with nothing. Rows that agree in doc_id and text come as often as they were given. A null doc_id is no smallest one;
    a component of such rows alone has a null component_id. Other columns are not read. An empty table gives no rows.
    """
    kept, found = near_components(docs.select("doc_id", "text"), width, share)
    found = staged(found, "found")
    ids = kept.select("_key", F.col("doc_id").cast("long").alias("doc_id")).join(found.dropDuplicates(["_key"]), "_key")
    least = ids.where("n_shingles > 0").groupBy("root").agg(F.min("doc_id").alias("least"))
    joined = ids.join(least, "root", "left")
    component = F.when(F.col("n_shingles") > 0, F.col("least")).otherwise(F.col("doc_id"))
    return joined.select("doc_id", "n_shingles", component.alias("component_id"))


def drop_near_duplicates(docs: DataFrame, width: int = 4, share: int = 85) -> DataFrame:
    """`docs` with one row of each component: that of the smallest doc_id, and of equal ones that with the smaller hash.

    All rows without tokens stay, those that agree in doc_id and text too. All columns of `docs` are kept, but for one
    called `_key`. No rows give no rows.
    """
    docs = free_of(docs, "_key")
    kept, found = near_components(docs, width, share)
    found = staged(found.dropDuplicates(["_key"]), "found")
    ids = kept.select("_key", F.col("doc_id").cast("long").alias("doc_id")).join(found, "_key")
    first = ids.where("n_shingles > 0").groupBy("root").agg(F.min_by("_key", F.struct(F.col("doc_id").isNull(), "doc_id", "_key")).alias("_key"))
    rows = [quoted(c) for c in docs.columns]
    single = kept.join(first.select("_key").hint("shuffle_hash"), "_key", "left_semi").dropDuplicates(["_key"])
    bare = kept.join(found.where("n_shingles = 0").select("_key").hint("shuffle_hash"), "_key", "left_semi")
    return single.select(*rows).unionByName(bare.select(*rows))
