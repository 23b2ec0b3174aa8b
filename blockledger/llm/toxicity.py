"""Toxicity by multiple-instance learning.

Only documents are labelled. A document is taken as toxic if any of its sentences is: with sentence probabilities
p = sigmoid(bias + weights of the sentence's features), the document's is the noisy-or 1 - prod(1 - p). The weights are
fitted to the document labels through that, and then tell which sentences offend. Features are letter 5-grams, blanks
counting at their ends, hashed to `SLOTS` places.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, StructType

from blockledger.llm.bpe import slices
from blockledger.llm.hashing import LOWER, mixed, text_bytes
from blockledger.llm.langid import quoted
from blockledger.llm.staging import free_of, staged

SLOTS = 1 << 22
LETTER = np.zeros(256, bool)
LETTER[0x61:0x7B] = True
LETTER[0x80:] = True
STOP = np.zeros(256, bool)
STOP[[0x0A, 0x21, 0x2E, 0x3F]] = True  # new line ! . ?
BLANK = 0x20


@dataclass
class Model:
    slots: np.ndarray  # sorted places of the features that count
    weights: np.ndarray
    bias: float


def instances(column: pa.Array):
    """Slots of all features, the sentence each is in, the document of each sentence, and where sentences begin and end.

    Places are bytes from the beginning of the document.
    """
    data, cuts = text_bytes(column)
    spaced = np.insert(data, cuts, BLANK)  # a blank before every text and after the last
    starts = cuts[:-1] + np.arange(len(cuts) - 1) + 1
    stop = STOP[spaced]
    stop[starts - 1] = True
    stop[-1] = True
    inside = ~stop
    first = np.flatnonzero(inside & np.concatenate([[True], stop[:-1]]))
    last = np.flatnonzero(inside & np.concatenate([stop[1:], [True]])) + 1
    document = np.searchsorted(starts, first, "right") - 1
    folded = LOWER[spaced]
    letter = LETTER[folded]
    folded = np.where(letter, folded, np.uint8(BLANK)).astype(np.uint64)
    n = len(folded) - 4
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), document, first - starts[document], last - starts[document]
    at = np.flatnonzero(letter[1 : n + 1] & letter[2 : n + 2] & letter[3 : n + 3])
    key = np.zeros(len(at), np.uint64)
    for i in range(5):
        key = (key << np.uint64(8)) | folded[at + i]
    slots = (mixed(key) & np.uint64(SLOTS - 1)).astype(np.int64)
    sentence = np.searchsorted(first, at + 2, "right") - 1
    return slots, sentence, document, first - starts[document], last - starts[document]


def sample(docs: DataFrame, labels: DataFrame, most: int) -> DataFrame:
    """`text` and `toxic` of at most `most` labelled documents, those whose doc_id has the smallest hashes.

    A null label is no label; of several labels of a document the highest counts.
    """
    known = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull())
    known = known.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("toxic").cast("int").alias("toxic"))
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)  # at most `most` rows of two numbers
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return texts.join(F.broadcast(chosen), "doc_id").select("toxic", "text")


def train(
    docs: DataFrame, labels: DataFrame, most: int = 20_000, features: int = 2_048, steps: int = 60, rate: float = 0.3
) -> Model:
    """Fit on at most `most` labelled rows; `features` is how many 5-grams get a weight.

    Which do is decided by how far apart their document frequencies are in both classes, in standard errors. Without rows
    of both classes nothing is learnt: the bias alone stays, and every score is near 0. Null texts are empty.
    """
    rows = staged(sample(docs, labels, most), "toxic-sample")

    def frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros((2, SLOTS), np.int32)
        total = [0, 0]
        for batch in batches:
            for part in slices(batch, 1 << 20):
                slots, sentence, document, _, _ = instances(part.column(1))
                label = (part.column(0).to_numpy(zero_copy_only=False) > 0).astype(np.int64)
                once = np.unique(document[sentence] * SLOTS + slots)
                np.add.at(seen, (label[once // SLOTS], once % SLOTS), 1)
                total[0] += int((label == 0).sum())
                total[1] += int(label.sum())
        slots = np.flatnonzero(seen.any(0))
        columns = [slots, seen[0, slots].astype(np.int64), seen[1, slots].astype(np.int64)]
        columns = [np.append(c, x) for c, x in zip(columns, (-1, *total), strict=True)]
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["slot", "clean", "toxic"])

    few = rows.repartition(8)  # a bounded sample
    counts = few.mapInArrow(frequencies, "slot long, clean long, toxic long").groupBy("slot")
    counts = staged(counts.agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic")), "toxic-counts")
    total = counts.where("slot = -1").first()
    if not total or not total["clean"] or not total["toxic"]:
        return Model(np.zeros(0, np.int64), np.zeros(0), -8.0)
    a, b = F.col("toxic") / F.lit(total["toxic"]), F.col("clean") / F.lit(total["clean"])
    mean = (F.col("toxic") + F.col("clean") + 1) / F.lit(total["toxic"] + total["clean"] + 2)
    apart = (a - b) / F.sqrt(mean * (1 - mean) * F.lit(1 / total["toxic"] + 1 / total["clean"]) + F.lit(1e-12))
    odds = F.log((F.col("toxic") + 0.5) / F.lit(total["toxic"] + 1)) - F.log((F.col("clean") + 0.5) / F.lit(total["clean"] + 1))
    chosen = counts.where("slot >= 0 and toxic + clean >= 5").orderBy(F.desc(F.abs(apart)), "slot").limit(features)
    chosen = sorted((r["slot"], r["odds"]) for r in chosen.select("slot", odds.alias("odds")).collect())
    slots = np.array([x[0] for x in chosen], np.int64)

    def compact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 1 << 20):
                found, sentence, document, _, _ = instances(part.column(1))
                at = np.searchsorted(slots, found)
                kept = slots[np.minimum(at, len(slots) - 1)] == found
                at, sentence = at[kept], sentence[kept]
                bags, rank = np.unique(sentence, return_inverse=True)
                n = part.num_rows
                sentences = np.bincount(document, minlength=n)
                own = np.bincount(document[bags], minlength=n)
                offset = np.concatenate([[0], np.cumsum(own)])
                where = np.searchsorted(offset, rank, "right") - 1  # the document of each feature
                ends = np.searchsorted(where, np.arange(n + 1))
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0),
                        pa.array(sentences - own),
                        pa.array([at[x:y] for x, y in zip(ends, ends[1:], strict=False)], pa.list_(pa.int64())),
                        pa.array(
                            [rank[x:y] - o for x, y, o in zip(ends, ends[1:], offset, strict=False)], pa.list_(pa.int64())
                        ),
                    ],
                    names=["toxic", "bare", "features", "sentences"],
                )

    bags = staged(few.mapInArrow(compact, "toxic int, bare long, features array<long>, sentences array<long>"), "bags")
    weights = np.array([x[1] for x in chosen]) * 0.5
    bias = -6.0
    moment, square = np.zeros(len(weights) + 1), np.zeros(len(weights) + 1)
    for step in range(1, steps + 1):
        slope = gradient(bags, weights, bias, total["clean"], total["toxic"]) + np.append(1e-4 * weights, 0.0)
        moment, square = 0.9 * moment + 0.1 * slope, 0.99 * square + 0.01 * slope**2
        change = rate * (moment / (1 - 0.9**step)) / (np.sqrt(square / (1 - 0.99**step)) + 1e-8)
        weights, bias = weights - change[:-1], bias - change[-1]
    return Model(slots, weights, float(bias))


def gradient(bags: DataFrame, weights: np.ndarray, bias: float, clean: int, toxic: int) -> np.ndarray:
    """Slope of the mean logarithmic loss over all documents; both classes weigh the same. The last entry is the bias's."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slope = np.zeros(len(weights) + 1)
        for batch in batches:
            label = batch.column(0).to_numpy(zero_copy_only=False) > 0
            bare = batch.column(1).to_numpy(zero_copy_only=False)
            lists = batch.column(2)
            n = batch.num_rows
            sizes = np.diff(lists.offsets.to_numpy())
            features = lists.flatten().to_numpy(zero_copy_only=False)
            document = np.repeat(np.arange(n), sizes)
            sentence = document * (1 << 32) + batch.column(3).flatten().to_numpy(zero_copy_only=False)
            bags_, rank = np.unique(sentence, return_inverse=True)
            owner = bags_ >> 32
            z = bias + np.bincount(rank, weights[features], len(bags_))
            p = 1 / (1 + np.exp(-np.clip(z, -50, 50)))
            p0 = 1 / (1 + np.exp(-bias))
            none = np.bincount(owner, np.log1p(-np.minimum(p, 1 - 1e-12)), n) + bare * np.log1p(-p0)
            clear = np.exp(none)
            pull = np.where(label, -clear / np.maximum(1 - clear, 1e-12) / toxic, 1.0 / clean) / 2
            each = pull[owner] * p
            slope[:-1] += np.bincount(features, each[rank], len(weights))
            slope[-1] += each.sum() + (pull * bare * p0).sum()
        yield pa.RecordBatch.from_arrays([pa.array([slope.tolist()], pa.list_(pa.float64()))], names=["slope"])

    rows = bags.coalesce(8).mapInArrow(run, "slope array<double>").collect()  # one row a task
    return np.sum([r["slope"] for r in rows], axis=0)


SENTENCE = StructType().add("start", IntegerType()).add("stop", IntegerType()).add("score", DoubleType())
SCORED = StructType().add("score", DoubleType()).add("predicted", IntegerType()).add("offending", ArrayType(SENTENCE))


def predict(docs: DataFrame, model: Model, threshold: float = 0.7, offends: float = 0.5) -> DataFrame:
    """`docs` with `score`, `predicted` (score >= `threshold`) and `offending`: the sentences of at least `offends`.

    Those are given by their bytes in the text. Null and empty texts, and texts without a sentence, score 0. Rows and
    their other columns stay as they are, but for those called like the three or `_row`. An empty table gives no rows.
    """
    docs = free_of(docs, "score", "predicted", "offending", "_row")
    slots, weights = model.slots, model.weights

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.zeros(SLOTS)
        table[slots] = weights
        for batch in batches:
            for part in slices(batch, 1 << 20):
                found, sentence, document, first, last = instances(part.column(1))
                w = table[found]
                z = model.bias + np.bincount(sentence[w != 0], w[w != 0], len(first))
                p = 1 / (1 + np.exp(-np.clip(z, -50, 50)))
                n = part.num_rows
                score = -np.expm1(np.bincount(document, np.log1p(-np.minimum(p, 1 - 1e-12)), n))
                bad = np.flatnonzero(p >= offends)
                ends = np.searchsorted(document[bad], np.arange(n + 1))
                structs = pa.StructArray.from_arrays(
                    [pa.array(first[bad].astype(np.int32)), pa.array(last[bad].astype(np.int32)), pa.array(p[bad])],
                    names=["start", "stop", "score"],
                )
                columns = [
                    *part.columns,
                    pa.array(score),
                    pa.array((score >= threshold).astype(np.int32)),
                    pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), structs),
                ]
                yield pa.RecordBatch.from_arrays(columns, names=[*names, "score", "predicted", "offending"])

    others = [c for c in docs.columns if c != "text"]
    if not others:
        docs, others = docs.withColumn("_row", F.lit(0)), ["_row"]
    names = [others[0], "text", *others[1:]]
    plain = docs.select(*[quoted(c) for c in names])
    scored = plain.mapInArrow(run, StructType([*plain.schema.fields, *SCORED.fields]))
    kept = [c for c in docs.columns if c != "_row"]
    return scored.select(*[quoted(c) for c in [*kept, "score", "predicted", "offending"]])
