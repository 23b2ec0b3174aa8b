"""Removal of long byte strings that an earlier document has, by prefix-free parsing and suffix sorting.

A rolling hash over `gram` bytes triggers where it is smallest among all that lie in a window of `size` bytes, so equal
windows contain the same trigger at the same place. The phrase of a trigger is the text of all windows that it rules;
together the phrases are a parse of the corpus.

1. Every chunk of documents tells which triggers it has; those of a single document cannot be in a repeat and are dropped.
2. The phrases of the others are sent once for each chunk, with the first and the last document that has them. These make
   the dictionary. It is dealt out by trigger, and its suffixes, down to `size` bytes, are sorted: equal neighbours are
   the same string, and the first document of any is that of all.
3. Every chunk reads what holds for its phrases off the sorted suffixes and cuts its documents.

The work follows the dictionary, not the number of copies, and no list of the documents of a string is ever made.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from blockledger.llm.hashing import BASE, BYTES, mixed, text_bytes
from blockledger.llm.staging import chunked, shuffle_parts, staged

BLOCK = 1 << 20  # windows looked at together
SORTED = 400_000  # suffixes sorted together
SHORT = 6  # bytes of a trigger that tell whether it is shared
FIRST = -(1 << 63)  # stands for a null doc_id


def shortened(triggers: np.ndarray) -> bytes:
    """The low `SHORT` bytes of each trigger. Two that agree in these alone only let more phrases through."""
    return np.ascontiguousarray(triggers).astype("<u8").view(np.uint8).reshape(-1, 8)[:, :SHORT].tobytes()


def long(packed: bytes) -> np.ndarray:
    short = np.frombuffer(packed, np.uint8).reshape(-1, SHORT)
    return np.pad(short, ((0, 0), (0, 8 - SHORT))).view("<u8").ravel()


@dataclass(frozen=True)
class Shape:
    size: int
    gram: int

    @property
    def places(self) -> int:
        """Triggers lie in so many places of a window."""
        return self.size - self.gram + 1

    @property
    def span(self) -> int:
        """The longest phrase."""
        return self.size + self.places - 1


def rolled(data: np.ndarray, gram: int) -> np.ndarray:
    """Hashes of every `gram` bytes in a row; `gram` is a power of two."""
    h, size = BYTES[data], 1
    while size < gram:
        h = h[:-size] + h[size:] * np.uint64(pow(BASE, size, 1 << 64))
        size *= 2
    return mixed(h)


def smallest(h: np.ndarray, places: int) -> np.ndarray:
    """Where the smallest of every `places` hashes in a row is, the leftmost of equal ones."""
    value, at, size = h, np.arange(len(h), dtype=np.int32), 1
    while size < places:
        step = min(size, places - size)
        right = value[step:] < value[: len(value) - step]
        at = np.where(right, at[step:], at[: len(at) - step])
        value = np.minimum(value[step:], value[: len(value) - step])
        size += step
    return at


@dataclass
class Phrases:
    """Triggers with the windows they rule. `text` is packed from the first place a window could begin at, other bytes 0."""

    trigger: np.ndarray
    low: np.ndarray  # the first window, counted from the first place one could begin at
    high: np.ndarray  # the last window
    start: np.ndarray  # where that first place is in the data
    document: np.ndarray

    def take(self, kept: np.ndarray) -> Phrases:
        return Phrases(self.trigger[kept], self.low[kept], self.high[kept], self.start[kept], self.document[kept])


def phrases(data: np.ndarray, cuts: np.ndarray, shape: Shape) -> Phrases:
    """The phrases of the texts between `cuts`. A window's trigger depends on its own bytes alone."""
    found = []
    for begin in range(0, len(data) - shape.size + 1, BLOCK):
        h = rolled(data[begin : begin + BLOCK + shape.size - 1], shape.gram)
        at = smallest(h, shape.places)
        window = np.arange(len(at)) + begin
        document = np.repeat(np.arange(len(cuts) - 1), np.diff(cuts))[begin : begin + len(at)]
        valid = window + shape.size <= cuts[document + 1]
        change = np.ones(len(at), bool)
        change[1:] = (at[1:] != at[:-1]) | (document[1:] != document[:-1])
        first = np.flatnonzero(change & valid)
        last = np.searchsorted(np.flatnonzero(change), first, "right")
        ends = np.append(np.flatnonzero(change), len(at))[last] - 1
        last = np.minimum(ends, cuts[document[first] + 1] - shape.size - begin)
        start = at[first].astype(np.int64) + begin - shape.places + 1
        found.append((h[at[first]], first + begin - start, last + begin - start, start, document[first]))
    if not found:
        none = np.zeros(0, np.int64)
        return Phrases(none.view(np.uint64), none, none, none, none)
    return Phrases(*(np.concatenate(x) for x in zip(*found, strict=True)))


def entries(found: Phrases, data: np.ndarray, shape: Shape) -> np.ndarray:
    """Each phrase as a row of bytes: trigger, first window, last window, text."""
    rows = np.zeros((len(found.trigger), 10 + shape.span), np.uint8)
    rows[:, :8] = found.trigger.astype(">u8").view(np.uint8).reshape(-1, 8)
    rows[:, 8], rows[:, 9] = found.low, found.high
    place = np.arange(shape.span)
    for low in range(0, len(rows), 1 << 15):
        some = slice(low, low + (1 << 15))
        at = found.start[some, None] + place
        inside = (place >= found.low[some, None]) & (place < found.high[some, None] + shape.size)
        rows[some, 10:] = np.where(inside, data[np.clip(at, 0, len(data) - 1)], 0)
    return rows


def sorted_rows(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The order of rows of bytes, and which of them, in that order, differ from the one before."""
    keys = np.ascontiguousarray(rows).view(f"S{rows.shape[1]}").ravel()
    order = np.argsort(keys, kind="stable")
    new = np.ones(len(keys), bool)
    new[1:] = keys[order[1:]] != keys[order[:-1]]
    return order, new


def of_chunk(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bytes of all texts of a chunk, where they begin and end, and their doc_ids."""
    table = table.combine_chunks()
    data, cuts = text_bytes(table["text"].combine_chunks() if table.num_rows else pa.array([], pa.string()))
    return data, cuts, table["doc_id"].fill_null(FIRST).to_numpy().astype(np.int64)


def parts_of(values: np.ndarray, parts: int) -> tuple[np.ndarray, np.ndarray]:
    """The order of triggers by bucket, and where each bucket begins and ends in it."""
    bucket = (mixed(values) % np.uint64(parts)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    return order, np.searchsorted(bucket[order], np.arange(parts + 1))


def shared_dictionary(table: pa.Table, known: pa.Table, shape: Shape):
    """The phrases of a chunk whose triggers are shared: all occurrences, the sorted distinct rows, and which row each is."""
    data, cuts, ids = of_chunk(table)
    found = phrases(data, cuts, shape)
    wanted = [long(x) for x in known["triggers"].to_pylist() if x is not None]
    wanted = np.unique(np.concatenate(wanted)) if wanted else np.zeros(0, np.uint64)
    short = long(shortened(found.trigger))
    at = np.minimum(np.searchsorted(wanted, short), max(len(wanted) - 1, 0))
    found = found.take(wanted[at] == short if len(wanted) else np.zeros(len(short), bool))
    rows = entries(found, data, shape)
    order, new = sorted_rows(rows)
    which = np.zeros(len(rows), np.int64)
    which[order] = np.cumsum(new) - 1
    return data, cuts, ids, found, rows[order[new]], which


ANSWER = "chunk long, triggers binary, phrase binary, low binary, high binary, first binary"


def repeats(kept: DataFrame, shape: Shape, parts: int) -> DataFrame:
    """For each chunk the shared triggers, and for its phrases the windows with the first document that has them."""

    def tell(table: pa.Table) -> pa.Table:
        data, cuts, ids = of_chunk(table)
        found = phrases(data, cuts, shape)
        order = np.lexsort((ids[found.document], found.trigger))
        trigger, document = found.trigger[order], ids[found.document][order]
        starts = np.flatnonzero(np.concatenate([[True], trigger[1:] != trigger[:-1]])) if len(trigger) else order
        last = np.append(starts[1:], len(trigger)) - 1 if len(trigger) else order
        several = document[starts] != document[last]
        trigger = trigger[starts]
        order, ends = parts_of(trigger, parts)
        full = [i for i in range(parts) if ends[i] < ends[i + 1]]
        pieces = [order[ends[i] : ends[i + 1]] for i in full]
        packed = [[shortened(trigger[x]) for x in pieces], [several[x].tobytes() for x in pieces]]
        chunk = table["chunk"][0].as_py()
        return pa.table(
            {
                "bucket": pa.array(full, pa.int64()),
                "chunk": pa.array([chunk] * len(full), pa.int64()),
                "triggers": pa.array(packed[0], pa.binary()),
                "several": pa.array(packed[1], pa.binary()),
            }
        )

    def compare(table: pa.Table) -> pa.Table:
        lists = [long(x) for x in table["triggers"].to_pylist()]
        every = np.concatenate(lists)
        several = np.frombuffer(b"".join(table["several"].to_pylist()), bool)
        values, at, count = np.unique(every, return_inverse=True, return_counts=True)
        shared = count > 1
        shared[at[several]] = True
        mine = np.split(shared[at], np.cumsum([len(x) for x in lists])[:-1])
        packed = [shortened(x[m]) for x, m in zip(lists, mine, strict=True)]
        return pa.table({"chunk": table["chunk"], "triggers": pa.array(packed, pa.binary())})

    told = kept.groupBy("chunk").applyInArrow(tell, "bucket long, chunk long, triggers binary, several binary")
    shared = told.groupBy("bucket").applyInArrow(compare, "chunk long, triggers binary")
    shared = staged(shared, "shared-triggers")

    def send(table: pa.Table, known: pa.Table) -> pa.Table:
        names = ["bucket", "chunk", "phrase", "rows", "first", "last"]
        if not table.num_rows:
            return pa.table({n: pa.array([], pa.binary() if i > 1 else pa.int64()) for i, n in enumerate(names)})
        _, _, ids, found, rows, which = shared_dictionary(table, known, shape)
        first, last = np.full(len(rows), np.iinfo(np.int64).max), np.full(len(rows), FIRST)
        np.minimum.at(first, which, ids[found.document])
        np.maximum.at(last, which, ids[found.document])
        order, ends = parts_of(np.ascontiguousarray(rows[:, :8]).view(">u8").ravel().astype(np.uint64), parts)
        full = [i for i in range(parts) if ends[i] < ends[i + 1]]
        columns = (np.arange(len(rows), dtype=np.int32), rows, first, last)
        packed = [[x[order[ends[i] : ends[i + 1]]].tobytes() for i in full] for x in columns]
        packed[1] = [pa.compress(x, "zstd", asbytes=True) for x in packed[1]]
        chunk = table["chunk"][0].as_py()
        heads = [pa.array(full, pa.int64()), pa.array([chunk] * len(full), pa.int64())]
        return pa.table(dict(zip(names, [*heads, *[pa.array(x, pa.binary()) for x in packed]], strict=True)))

    def sort(table: pa.Table) -> pa.Table:
        width = 10 + shape.span
        counts = [len(x) // 4 for x in table["phrase"].to_pylist()]
        phrase, first, last = (
            np.frombuffer(b"".join(table[c].to_pylist()), t) for c, t in (("phrase", "<i4"), ("first", "<i8"), ("last", "<i8"))
        )
        packed = zip(table["rows"].to_pylist(), counts, strict=True)
        rows = b"".join(pa.decompress(x, n * width, "zstd", asbytes=True) for x, n in packed)
        rows = np.frombuffer(rows, np.uint8).reshape(-1, width)
        order, new = sorted_rows(rows)
        starts = np.flatnonzero(new)
        distinct = rows[order[starts]]
        least = np.minimum.reduceat(first[order], starts)
        which = np.zeros(len(rows), np.int64)
        which[order] = np.cumsum(new) - 1
        entry, low, high, least = first_documents(distinct, least, shape)  # runs of windows of each distinct phrase
        ends = np.searchsorted(entry, np.arange(len(distinct) + 1))
        size = np.diff(ends)[which]
        source = np.repeat(np.arange(len(rows)), size)
        run = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size) + np.repeat(ends[which], size)
        worth = least[run] < last[source]
        source, run = source[worth], run[worth]
        cut = np.searchsorted(source, np.cumsum([0, *counts]))
        columns = (phrase[source], low[run], high[run], least[run])
        packed = [[x[a:b].tobytes() for a, b in zip(cut, cut[1:], strict=False)] for x in columns]
        names = ["phrase", "low", "high", "first"]
        return pa.table({"chunk": table["chunk"]} | dict(zip(names, [pa.array(x, pa.binary()) for x in packed], strict=True)))

    sent = kept.groupBy("chunk").cogroup(shared.groupBy("chunk"))
    sent = sent.applyInArrow(send, "bucket long, chunk long, phrase binary, rows binary, first binary, last binary")
    answers = sent.groupBy("bucket").applyInArrow(sort, "chunk long, phrase binary, low binary, high binary, first binary")
    return staged(shared.unionByName(answers, allowMissingColumns=True), "repeats")


def first_documents(rows: np.ndarray, first: np.ndarray, shape: Shape):
    """Runs of windows of the phrases in `rows`, sorted by phrase, with the first document that has them.

    The suffixes of one trigger are sorted together with as many others as `SORTED` allows.
    """
    found = []
    low, high = rows[:, 8].astype(np.int64), rows[:, 9].astype(np.int64)
    count = high - low + 1
    trigger = np.ascontiguousarray(rows[:, :8]).view(">u8").ravel()
    starts = np.flatnonzero(np.concatenate([[True], trigger[1:] != trigger[:-1]])) if len(rows) else np.zeros(0, np.int64)
    total = np.concatenate([[0], np.cumsum(count)])
    part = total[starts] // SORTED
    begin = starts[np.concatenate([[True], part[1:] != part[:-1]])] if len(rows) else starts
    for a, b in zip(begin, [*begin[1:], len(rows)], strict=True):
        n = count[a:b]
        entry = np.repeat(np.arange(a, b), n)
        window = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + low[entry]
        suffix = np.empty((len(entry), 9 + shape.size), np.uint8)
        suffix[:, :8] = rows[entry, :8]
        suffix[:, 8] = window
        for i in range(shape.size):
            suffix[:, 9 + i] = rows[entry, 10 + window + i]
        order, new = sorted_rows(suffix)
        least = np.empty(len(entry), np.int64)
        classes = np.flatnonzero(new)
        least[order] = np.repeat(
            np.minimum.reduceat(first[entry[order]], classes), np.diff(np.append(classes, len(entry)))
        )
        change = np.ones(len(entry), bool)
        change[1:] = (entry[1:] != entry[:-1]) | (least[1:] != least[:-1])
        runs = np.flatnonzero(change)
        stops = np.append(runs[1:], len(entry)) - 1
        found.append((entry[runs], window[runs].astype(np.uint8), window[stops].astype(np.uint8), least[runs]))
    if not found:
        none = np.zeros(0, np.int64)
        return none, none.astype(np.uint8), none.astype(np.uint8), none
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def drop_repeats(docs: DataFrame, size: int = 50, gram: int = 16) -> DataFrame:
    """`doc_id`, `n_bytes`, `n_removed`, `n_spans`, `kept` (binary) of every row.

    Removed is every byte of a text, as UTF-8, that lies in a string of `size` bytes which also begins in a document with
    a smaller doc_id; strings are those of the input. `n_spans` counts the maximal removed runs. Null texts are empty,
    and shorter texts than `size` stay whole. Rows with the same doc_id do not remove from each other. A null doc_id is
    smaller than all others. What is kept may not be valid UTF-8. Other columns are not read.
    """
    spark = docs.sparkSession
    shape = Shape(size, gram)
    parts = shuffle_parts(spark)
    kept = chunked(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), "chunks")
    known = repeats(kept, shape, parts)

    def cut(table: pa.Table, known: pa.Table) -> pa.Table:
        names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept"]
        if not table.num_rows:
            return pa.table({n: pa.array([], pa.int64() if i < 4 else pa.binary()) for i, n in enumerate(names)})
        data, cuts, ids, found, rows, which = shared_dictionary(table, known, shape)
        answers = [x for x in known.select(["phrase", "low", "high", "first"]).to_pylist() if x["phrase"] is not None]
        phrase, low, high, first = (
            np.frombuffer(b"".join(x[c] for x in answers), t)
            for c, t in (("phrase", "<i4"), ("low", "u1"), ("high", "u1"), ("first", "<i8"))
        )
        order = np.argsort(phrase, kind="stable")
        ends = np.searchsorted(phrase[order], np.arange(len(rows) + 1))
        count = np.diff(ends)[which] if len(rows) else np.zeros(0, np.int64)
        source = np.repeat(np.arange(len(which)), count)
        run = order[np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + np.repeat(ends[which], count)]
        later = ids[found.document[source]] > first[run]
        source, run = source[later], run[later]
        depth = np.zeros(len(data) + 1, np.int32)
        np.add.at(depth, found.start[source] + low[run], 1)
        np.add.at(depth, found.start[source] + high[run].astype(np.int64) + size, -1)
        gone = np.cumsum(depth[:-1]) > 0
        opens = gone.copy()
        opens[1:] &= ~gone[:-1]
        inner = cuts[1:-1]
        inner = inner[inner < len(data)]
        opens[inner] = gone[inner]
        totals = [np.concatenate([[0], np.cumsum(x)]) for x in (gone, opens)]
        left = data[~gone].tobytes()
        place = cuts - totals[0][cuts]
        binary = [left[a:b] for a, b in zip(place.tolist(), place[1:].tolist(), strict=False)]
        columns = [table["doc_id"], np.diff(cuts), np.diff(totals[0][cuts]), np.diff(totals[1][cuts])]
        columns = [columns[0], *[pa.array(x, pa.int64()) for x in columns[1:]], pa.array(binary, pa.binary())]
        return pa.table(dict(zip(names, columns, strict=True)))

    both = kept.groupBy("chunk").cogroup(known.groupBy("chunk"))
    return both.applyInArrow(cut, "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary")
