"""Language-model scores by deleted interpolation of bigrams.

The probability of a token after another is w * (share of the pair among the pairs of that context) + (1 - w) * (add-one
share of the token). The weight w depends on how often the context was seen, by powers of two. Weights are learnt by
expectation-maximisation: counts of one part of the training texts are mixed to predict the other, held-out part. Scores
then use the counts of all training texts.

1. Every chunk of documents sends its distinct words and pairs, with their training counts, to buckets, which are ranges
   of their hashes: in order, so that the gaps between them are sent, in as few bytes as hold them.
2. The buckets add them up and send each chunk the totals of what it has.
3. With those the chunks tell how often which choice came up in the held-out part, and, weights learnt, score their texts.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from blockledger.llm.hashing import BLANKS, mixed, text_bytes, word_hashes
from blockledger.llm.langid import fold
from blockledger.llm.staging import chunked, shuffle_parts, staged

LEVELS = 24  # context frequencies 1, 2-3, 4-7, ... have a weight each
CHUNK = 8 << 20  # bytes of text that send a word or pair once
READ = 2 << 20  # bytes of text hashed at once: hashing takes some thirty bytes for each
FINE = 64  # steps of a power of two in which EM tells the ratio of the two shares apart
START, END = np.uint64(0x51ED270B2D4F1A63), np.uint64(0x7C15D4E3B9A60F29)  # the border of a text, as context and as token
TURN = np.uint64(0x9FB21C651E98DF25)
# What a text adds to a pair of counts, by its part: those over all training texts, and those over the kept ones alone.
ADDS = np.array([[1, 1], [1, 0], [0, 0]], np.int64)


@dataclass(frozen=True)
class Totals:
    tokens: int
    distinct: int
    kept_tokens: int
    kept_distinct: int


def words_of(table: pa.Table):
    """Hashes of the words of all texts in a row, and where each text's begin and end; read a stretch of texts at a time."""
    data, cuts = text_bytes(table["text"].combine_chunks())
    turns = np.flatnonzero(np.diff(cuts[:-1] // READ, prepend=0))  # the texts with which a stretch begins
    hashes, ends, last = [], [np.zeros(1, np.int64)], 0
    for i, k in zip([0, *turns], [*turns, len(cuts) - 1], strict=True):
        some, at, _, _ = word_hashes(data[cuts[i] : cuts[k]], cuts[i : k + 1] - cuts[i], BLANKS)
        hashes.append(some)
        ends.append(at[1:] + last)
        last += len(some)
    return np.concatenate(hashes), np.concatenate(ends)


def of_texts(table: pa.Table):
    """For a chunk: tokens and contexts of all texts in a row, the pairs' hashes, and where each text begins and ends."""
    table = table.combine_chunks()
    words, ends = words_of(table)
    n = table.num_rows
    at = np.arange(len(words)) + np.repeat(np.arange(n), np.diff(ends))
    tokens = np.full(len(words) + n, END)
    tokens[at] = words
    ends = ends + np.arange(n + 1)
    context = np.empty_like(tokens)
    context[1:] = tokens[:-1]
    context[ends[:-1]] = START
    return tokens, context, mixed(context * TURN + tokens), ends


def counted(keys: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys and the sums of the weights of each."""
    order = np.argsort(keys)
    keys, weight = keys[order], weight[order]
    starts = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else order
    return keys[starts], np.add.reduceat(weight, starts) if len(keys) else weight


def vocabulary(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct words, contexts among them, of a chunk with their counts, and distinct pairs with theirs."""
    tokens, context, pairs, ends = of_texts(table)
    part = table["part"].to_numpy()
    weight = np.repeat(ADDS[part], np.diff(ends), axis=0)
    words, counts = counted(tokens, weight)
    border = ADDS[part].sum(0, keepdims=True)
    return *counted(np.append(words, START), np.concatenate([counts, border])), *counted(pairs, weight)


def edges(keys: np.ndarray, parts: int) -> np.ndarray:
    """Where each of `parts` even ranges of hashes begins and ends in sorted keys."""
    first = np.array([-(-(i << 64) // parts) for i in range(parts)], np.uint64)
    return np.append(np.searchsorted(keys, first), len(keys))


def totals_of(kept: DataFrame, parts: int) -> tuple[DataFrame, Totals]:
    """For each chunk the total counts of its words and pairs, and the sums over all words."""

    def send(table: pa.Table) -> pa.Table:
        words, word_counts, pairs, pair_counts = vocabulary(table)
        chunk = table["chunk"][0].as_py()
        rows: dict[str, list] = {"bucket": [], "chunk": [], "pairs": [], "keys": [], "counts": []}
        for kind, keys, counts in ((False, words, word_counts), (True, pairs, pair_counts)):
            ends = edges(keys, parts)
            for i in range(parts):
                if ends[i] < ends[i + 1]:
                    some = slice(ends[i], ends[i + 1])
                    for name, value in zip(rows, (i, chunk, kind, gaps(keys[some]), narrow(counts[some])), strict=True):
                        rows[name].append(value)
        return pa.table(rows, schema=pa.schema(SENT))

    def add(table: pa.Table) -> pa.Table:
        out: dict[str, list] = {"chunk": [], "bucket": [], "pairs": [], "counts": []}
        sums = [0, 0, 0, 0]
        for kind in (False, True):
            mine = table.filter(pc.equal(table["pairs"], kind))
            if not mine.num_rows:
                continue
            lists = [from_gaps(x) for x in mine["keys"].to_pylist()]
            weight = np.concatenate([wide(x) for x in mine["counts"].to_pylist()])
            keys, at = np.unique(np.concatenate(lists), return_inverse=True)
            total = np.stack([np.bincount(at, weight[:, i], len(keys)).astype(np.int64) for i in (0, 1)], axis=1)
            if not kind:
                real = total[keys != START]
                sums = [int(f(real[:, i])) for i in (0, 1) for f in (np.sum, np.count_nonzero)]
            ends = np.cumsum([0, *map(len, lists)])
            found = total[at]
            for i, chunk in enumerate(mine["chunk"].to_pylist()):
                values = chunk, table["bucket"][0].as_py(), kind, narrow(found[ends[i] : ends[i + 1]])
                for name, value in zip(out, values, strict=True):
                    out[name].append(value)
        n = len(out["chunk"])
        for name, value in zip(("tokens", "distinct", "kept_tokens", "kept_distinct"), sums, strict=True):
            out[name] = [value] + [0] * (n - 1)
        return pa.table(out, schema=pa.schema(ADDED))

    sent = kept.groupBy("chunk").applyInArrow(send, "bucket long, chunk long, pairs boolean, keys binary, counts binary")
    schema = "chunk long, bucket long, pairs boolean, counts binary, tokens long, distinct long, kept_tokens long, kept_distinct long"
    added = staged(sent.groupBy("bucket").applyInArrow(add, schema), "totals", drop_shuffles=True)
    names = ["tokens", "distinct", "kept_tokens", "kept_distinct"]
    row = added.agg(*[F.coalesce(F.sum(x), F.lit(0)).alias(x) for x in names]).first()
    return added.drop(*names), Totals(*(row[x] for x in names))


SENT = [("bucket", pa.int64()), ("chunk", pa.int64()), ("pairs", pa.bool_()), ("keys", pa.binary()), ("counts", pa.binary())]
ADDED = [
    *[("chunk", pa.int64()), ("bucket", pa.int64()), ("pairs", pa.bool_()), ("counts", pa.binary())],
    *[(x, pa.int64()) for x in ("tokens", "distinct", "kept_tokens", "kept_distinct")],
]


def planes(values: np.ndarray) -> bytes:
    """Whole numbers in as few bytes as hold them all; first that many, then all lowest bytes, all second ones and so on.

    High bytes are mostly zeros; side by side they are compressed away.
    """
    size = (int(values.max(initial=0)).bit_length() + 7) // 8
    return bytes([size]) + values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :size].T.tobytes()


def from_planes(packed: bytes, n: int) -> np.ndarray:
    values = np.zeros((n, 8), np.uint8)
    values[:, : packed[0]] = np.frombuffer(packed, np.uint8, n * packed[0], 1).reshape(packed[0], n).T
    return values.reshape(-1).view("<u8")


def gaps(keys: np.ndarray) -> bytes:
    """Sorted hashes as how many they are, the first one, and the steps from each to the next."""
    return np.array([len(keys), keys[0]], "<u8").tobytes() + planes(np.diff(keys))


def from_gaps(packed: bytes) -> np.ndarray:
    n, first = np.frombuffer(packed, "<u8", 2)
    return np.cumsum(np.append(first, from_planes(packed[16:], int(n) - 1)), dtype=np.uint64)


def narrow(counts: np.ndarray) -> bytes:
    """Pairs of counts, of which the second is at most the first: their number, the first ones, and what the others lack."""
    return len(counts).to_bytes(8, "little") + planes(counts[:, 0]) + planes(counts[:, 0] - counts[:, 1])


def wide(packed: bytes) -> np.ndarray:
    n = int.from_bytes(packed[:8], "little")
    second = 9 + packed[8] * n
    both = from_planes(packed[8:second], n), from_planes(packed[second:], n)
    return np.stack([both[0], both[0] - both[1]], axis=1).astype(np.int64)


def looked_up(table: pa.Table, answers: pa.Table, parts: int, which: int):
    """A total of every token, context and pair in a chunk, in the order of of_texts, and where its texts begin and end.

    `which` is 0 for that over all training texts, 1 for that over the kept ones.
    """
    tokens, _, pairs, ends = of_texts(table)
    words, at = np.unique(np.append(tokens, START), return_inverse=True)
    before = np.append(at[-1], at[:-2])  # a context is the token before, or the border
    before[ends[:-1]] = at[-1]
    distinct, pair_at = np.unique(pairs, return_inverse=True)
    found = []
    for kind, keys in ((False, words), (True, distinct)):
        total = np.zeros(len(keys), np.int64)
        starts = edges(keys, parts)
        mine = answers.filter(pc.equal(answers["pairs"], kind))
        for i, packed in zip(mine["bucket"].to_pylist(), mine["counts"].to_pylist(), strict=True):
            total[starts[i] : starts[i + 1]] = wide(packed)[:, which]
        found.append(total)
    return found[0][at[:-1]], found[0][before], found[1][pair_at], ends


def level(count: np.ndarray) -> np.ndarray:
    return np.minimum(np.log2(np.maximum(count, 1)).astype(np.int64), LEVELS - 1)


def choices(kept: DataFrame, totals: DataFrame, sums: Totals, parts: int) -> DataFrame:
    """`level`, `ratio`, `n`: how often held-out tokens came with which ratio of pair share to token share.

    Ratios are rounded to 1 / `FINE` of a power of two; a pair that the kept texts do not have has ratio null. Contexts
    that they do not have leave no choice.
    """

    def run(table: pa.Table, answers: pa.Table) -> pa.Table:
        names = ["level", "ratio", "n"]
        if not table.num_rows or not (table["part"].to_numpy() == 1).any():
            return pa.table({x: pa.array([], pa.int64()) for x in names})
        token, context, pair, ends = looked_up(table, answers, parts, 1)
        held = np.repeat(table["part"].to_numpy() == 1, np.diff(ends))
        token, context, pair = (x[held] for x in (token, context, pair))
        seen = context > 0
        token, context, pair = token[seen], context[seen], pair[seen]
        base = (token + 1) / (sums.kept_tokens + sums.kept_distinct + 1)
        ratio = np.full(len(token), np.iinfo(np.int64).min)
        both = pair > 0
        ratio[both] = np.round(np.log2(pair[both] / context[both] / base[both]) * FINE)
        found, n = np.unique(np.stack([level(context), ratio]), axis=1, return_counts=True)
        ratio = pa.array(found[1], mask=found[1] == np.iinfo(np.int64).min)
        return pa.table(dict(zip(names, [pa.array(found[0]), ratio, pa.array(n.astype(np.int64))], strict=True)))

    both = kept.groupBy("chunk").cogroup(totals.groupBy("chunk"))
    return both.applyInArrow(run, "level long, ratio long, n long").groupBy("level", "ratio").agg(F.sum("n").alias("n"))


def learn(rows: list, steps: int) -> np.ndarray:
    """Weights by level from the rows of `choices`. Levels without any take those of the level below."""
    weights = np.full(LEVELS, -1.0)
    for i in {r["level"] for r in rows}:
        mine = [r for r in rows if r["level"] == i]
        n = np.array([r["n"] for r in mine], float)
        ratio = np.array([0.0 if r["ratio"] is None else 2.0 ** (r["ratio"] / FINE) for r in mine])
        w = 0.5
        for _ in range(steps):
            w = float((n * w * ratio / (w * ratio + 1 - w)).sum() / n.sum())
            w = min(max(w, 1e-6), 1 - 1e-6)
        weights[i] = w
    last = 0.0
    for i in range(LEVELS):
        last = weights[i] = weights[i] if weights[i] >= 0 else last
    return weights


def score(docs: DataFrame, held_out: int = 2, folds: int = 7, held_share: int = 10, steps: int = 100) -> DataFrame:
    """`doc_id`, `held_out`, `n_tokens`, `n_known`, `train_tokens`, `base_score`, `score` of every row.

    A row is held out, and not learnt from, if crc32 of its doc_id as text, modulo `folds`, is `held_out`; a null doc_id
    counts as empty text. One in `held_share` of the others, by a hash of doc_id, is the part that weights are learnt on.
    Tokens are words with A-Z in lower case and one end for each text. Null, empty and blank texts are the end alone.
    Scores are log10 probabilities. Repeated rows are learnt from as often as they come. Without training rows all
    counts are 0 and every token has probability 1. Words and pairs are told apart by 64-bit hashes. Other columns are
    not read.
    """
    parts = 4 * shuffle_parts(docs.sparkSession)
    out = fold("doc_id", folds) == held_out
    part = F.when(out, 2).when(F.pmod(F.xxhash64(F.col("doc_id").cast("long"), F.lit("part")), F.lit(held_share)) == 0, 1).otherwise(0)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), part.cast("int").alias("part"), "text")
    kept = chunked(rows, "chunks", CHUNK)
    totals, sums = totals_of(kept, parts)
    # at most LEVELS * 128 * FINE rows: ratios lie between 2^-64 and 2^64
    weights = learn(choices(kept, totals, sums, parts).collect(), steps)

    def run(table: pa.Table, answers: pa.Table) -> pa.Table:
        if not table.num_rows:
            return pa.table({n: pa.array([], t) for n, t in RESULT})
        token, context, pair, ends = looked_up(table, answers, parts, 0)
        base = (token + 1) / (sums.tokens + sums.distinct + 1)
        w = np.where(context > 0, weights[level(context)], 0.0)
        p = w * pair / np.maximum(context, 1) + (1 - w) * base
        add = lambda x: np.add.reduceat(x, ends[:-1])
        n = table.num_rows
        columns = [
            table["doc_id"],
            pa.array(table["part"].to_numpy() == 2),
            np.diff(ends),
            add((token > 0).astype(np.int64)),
            np.full(n, sums.tokens),
            add(np.log10(base)),
            add(np.log10(p)),
        ]
        return pa.table([pa.array(x) if isinstance(x, np.ndarray) else x for x in columns], names=[x for x, _ in RESULT])

    both = kept.groupBy("chunk").cogroup(totals.groupBy("chunk"))
    return both.applyInArrow(
        run,
        "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double",
    )


RESULT = [
    ("doc_id", pa.int64()),
    ("held_out", pa.bool_()),
    *[(x, pa.int64()) for x in ("n_tokens", "n_known", "train_tokens")],
    *[(x, pa.float64()) for x in ("base_score", "score")],
]
