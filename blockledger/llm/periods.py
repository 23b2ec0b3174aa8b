"""Periodic runs of words: stretches that repeat with a period, found by suffix trees.

The tree of a word sequence and that of its reversal are built by Ukkonen's algorithm. On the way round each, the depth
at which the walk turns between two leaves that follow one another is noted, and the least of those between two leaves is
how long their suffixes agree, told in constant time from a table of minima over powers of two. A run's root is, in
the order of words or in its reverse, the longest Lyndon word that begins at some place, which ends where the next
smaller suffix begins; every such candidate is extended to the right in the one tree and to the left in the other.

Only stretches whose words stand in a repeated sequence of half the least length are put in a tree: every word of a run
does, since a run of length L and period q has two copies, q apart, of L - q >= q words, which are no fewer than half
the least length, and together they are the run. Documents are independent, so nothing is shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from blockledger.llm.bpe import slices
from blockledger.llm.hashing import BLANKS, mixed, text_bytes, word_hashes
from blockledger.llm.staging import free_of

AS_IS = np.arange(256, dtype=np.uint8)
RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
ADDED = T.StructType(
    [
        T.StructField("runs", T.ArrayType(T.StructType([T.StructField(x, T.LongType()) for x in ("start", "length", "period")]))),
        T.StructField("collapsed", T.StringType()),
    ]
)


class SuffixTree:
    """The suffix tree of numbers of which the last stands nowhere else.

    `rank[i]` is the place of suffix i among all in order; `agree(i, j)` tells how many numbers suffixes i and j share.
    """

    def __init__(self, numbers: list[int]):
        first, last, kids, suffix = self._built(numbers)
        self.rank, turns = self._walked(first, last, kids, suffix, len(numbers))
        self.least = [turns]
        step = 1
        while 2 * step <= len(turns):
            below = self.least[-1]
            self.least.append(np.minimum(below[:-step], below[step:]))
            step *= 2

    @staticmethod
    def _built(s: list[int]):
        """Ukkonen: one number after the other, all suffixes at once, by suffix links from one end to the next."""
        n = len(s)
        first, last, link, kids, suffix = [0], [0], [0], [{}], [-1]
        node = edge = length = waiting = leaves = 0
        for i in range(n):
            c, unlinked = s[i], 0
            waiting += 1
            while waiting:
                if not length:
                    edge = i
                below = kids[node]
                child = below.get(s[edge])
                if child is None:
                    below[s[edge]] = len(first)
                    first.append(i)
                    last.append(n)
                    link.append(0)
                    kids.append(None)
                    suffix.append(leaves)
                    leaves += 1
                    if unlinked:
                        link[unlinked] = node
                        unlinked = 0
                else:
                    begin = first[child]
                    size = (last[child] if last[child] <= i else i + 1) - begin
                    if length >= size:
                        edge += size
                        length -= size
                        node = child
                        continue
                    if s[begin + length] == c:
                        length += 1
                        if unlinked:
                            link[unlinked] = node
                        break
                    middle = len(first)
                    below[s[edge]] = middle
                    first += (begin, i)
                    last += (begin + length, n)
                    link += (0, 0)
                    kids += ({s[begin + length]: child, c: middle + 1}, None)
                    suffix += (-1, leaves)
                    leaves += 1
                    first[child] = begin + length
                    if unlinked:
                        link[unlinked] = middle
                    unlinked = middle
                waiting -= 1
                if node:
                    node = link[node]
                elif length:
                    length -= 1
                    edge = i - waiting + 1
        return first, last, kids, suffix

    @staticmethod
    def _walked(first, last, kids, suffix, n):
        """Ranks of the suffixes, and the depth at which the walk turns between each two leaves."""
        rank, turns, seen = [0] * n, [], 0
        todo = [(0, 0)]
        while todo:
            node, depth = todo.pop()
            if node < 0:
                turns.append(depth)
            elif kids[node] is None:
                rank[suffix[node]] = seen
                seen += 1
            else:
                below = kids[node]
                order = [below[c] for c in sorted(below, reverse=True)]
                for child in order[:-1]:
                    todo.append((child, depth + last[child] - first[child]))
                    todo.append((-1, depth))
                child = order[-1]
                todo.append((child, depth + last[child] - first[child]))
        return np.array(rank, np.int64), np.array(turns, np.int32)

    def agree(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """For pairs of different suffixes."""
        a, b = np.minimum(self.rank[i], self.rank[j]), np.maximum(self.rank[i], self.rank[j])
        level = np.frexp((b - a).astype(np.float64))[1] - 1
        out = np.zeros(len(a), np.int64)
        for k in np.unique(level).tolist():
            of = level == k
            row = self.least[k]
            out[of] = np.minimum(row[a[of]], row[b[of] - (1 << k)])
        return out


def lyndon_ends(rank: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """Where the longest Lyndon word from each place ends, in the order of the numbers and in its reverse."""
    n = len(rank)
    ends = []
    for sign in (1, -1):
        end, stack = [n] * n, []
        for i in range(n):
            r = sign * rank[i]
            while stack and stack[-1][0] > r:
                end[stack.pop()[1]] = i
            stack.append((r, i))
        ends.append(np.array(end, np.int64))
    return ends[0], ends[1]


def runs_of(numbers: list[int], least: int = 12) -> np.ndarray:
    """Rows of start, length and smallest period of every run of at least `least` and two periods, by start and period."""
    m = len(numbers)
    if m < least:
        return np.zeros((0, 3), np.int64)
    ahead, back = SuffixTree([*numbers, -1]), SuffixTree([*numbers[::-1], -1])
    found = []
    for end in lyndon_ends(ahead.rank[:m].tolist()):
        i = np.arange(m)
        i, q = i[end < m], (end - i)[end < m]
        right = ahead.agree(i, i + q)
        at = np.flatnonzero(right + q > 0)
        i, q, right = i[at], q[at], right[at]
        left = np.zeros(len(i), np.int64)
        inner = i > 0
        left[inner] = back.agree(m - i[inner], m - i[inner] - q[inner])
        length = left + q + right
        good = length >= np.maximum(least, 2 * q)
        found.append(np.stack([(i - left)[good], length[good], q[good]], axis=1))
    rows = np.unique(np.concatenate(found), axis=0)
    return rows[np.lexsort((rows[:, 2], rows[:, 0]))]


def stretches(hashes: np.ndarray, ends: np.ndarray, width: int, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Begin and end of the stretches of words that stand in a sequence of `width` words repeated in their document."""
    n = len(hashes) - width + 1
    none = np.zeros(0, np.int64)
    if n <= 0:
        return none, none
    steps = [np.uint64(int(x)) for x in np.random.default_rng(11).integers(1, 1 << 62, width + 1) * 2 + 1]
    grams = np.zeros(n, np.uint64)
    for k in range(width):
        grams += hashes[k : k + n] * steps[k]
    doc = np.searchsorted(ends, np.arange(n), side="right")
    whole = np.arange(n) + width <= ends[np.minimum(doc, len(ends) - 1)]
    at = np.flatnonzero(whole)
    keys = mixed(grams[at] + doc[at].astype(np.uint64) * steps[width])
    order = np.argsort(keys)
    same = keys[order][1:] == keys[order][:-1]
    again = np.zeros(len(at), bool)
    again[order[1:][same]] = again[order[:-1][same]] = True
    cover = np.zeros(len(hashes) + 1, np.int32)
    np.add.at(cover, at[again], 1)
    np.add.at(cover, at[again] + width, -1)
    inside = np.cumsum(cover[:-1]) > 0
    cut = np.zeros(len(hashes) + 1, bool)
    cut[ends[ends < len(hashes)]] = True
    opens = inside & np.concatenate([[True], ~inside[:-1] | cut[1 : len(hashes)]])
    closes = inside & np.concatenate([~inside[1:] | cut[1 : len(hashes)], [True]])
    begin, end = np.flatnonzero(opens), np.flatnonzero(closes) + 1
    long = end - begin >= least
    return begin[long], end[long]


def joined(data: np.ndarray, starts: np.ndarray, stops: np.ndarray, kept: np.ndarray, ends: np.ndarray) -> list[bytes]:
    """The kept words of every document with one space between."""
    size = (stops - starts + 1) * kept
    total = np.concatenate([[0], np.cumsum(size)])
    take = np.flatnonzero(kept)
    offset = np.repeat(starts[take] - total[take], size[take])
    source = np.arange(total[-1]) + offset
    out = data[np.minimum(source, max(len(data) - 1, 0))]
    out[total[1:][take] - 1] = 0x20
    cuts = total[np.concatenate([[0], ends])]
    raw = out.tobytes()
    return [raw[a : b - 1] if b > a else b"" for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)]


def collapsed(column: pa.Array, least: int) -> tuple[pa.Array, pa.Array]:
    """Runs and collapsed text of every text."""
    data, cuts = text_bytes(column)
    hashes, ends, starts, stops = word_hashes(data, cuts, BLANKS, AS_IS)
    ends = ends[1:]
    begin, end = stretches(hashes, ends, max(least // 2, 1), least)
    kept = np.ones(len(starts), bool)
    owner = np.searchsorted(ends, begin, side="right")
    rows: list[np.ndarray] = [np.zeros((0, 3), np.int64)] * len(column)
    for d in np.unique(owner).tolist():
        words: dict[bytes, int] = {}
        numbers, places = [], []
        for k, (a, b) in enumerate(zip(begin[owner == d].tolist(), end[owner == d].tolist(), strict=True)):
            for x, y in zip(starts[a:b].tolist(), stops[a:b].tolist(), strict=True):
                numbers.append(words.setdefault(data[x:y].tobytes(), len(words)))
            numbers.append(-2 - k)  # stands nowhere else, so no run goes over it
            places.append(np.arange(a, b + 1))
        place = np.concatenate(places)
        found = runs_of(numbers, least)
        off = ends[d - 1] if d else 0
        gone = np.zeros(len(place) + 1, np.int64)
        np.add.at(gone, found[:, 0] + found[:, 2], 1)
        np.add.at(gone, found[:, 0] + found[:, 1], -1)
        kept[place[np.cumsum(gone[:-1]) > 0]] = False
        rows[d] = np.column_stack([place[found[:, 0]] - off, found[:, 1], found[:, 2]])
    texts = pa.array(joined(data, starts, stops, kept, ends), pa.binary()).cast(pa.string())
    flat = np.concatenate(rows) if rows else np.zeros((0, 3), np.int64)
    fields = [pa.array(flat[:, k]) for k in range(3)]
    sizes = np.concatenate([[0], np.cumsum([len(r) for r in rows])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(sizes), pa.StructArray.from_arrays(fields, fields=list(RUN))), texts


def collapse(docs: DataFrame, least: int = 12) -> DataFrame:
    """`docs` with `runs` and `collapsed` in the place of `text`.

    Words stand between blanks (space, tab, line and page ends) and are compared byte for byte. A run is a stretch with smallest
    period q, of at least `least` and 2 q words, that its neighbours do not prolong; `runs` has start (from 0), length
    and period of each, by start, then period. `collapsed` has the words without those that some run has after its first
    q, one space between. Null and empty texts have no runs and collapse to an empty text. Repeated rows are each answered.
    Other columns stay, but for those called like the two. No rows give no rows. A task holds the trees of one document
    at a time, about a kilobyte for each word in repeated sequences.
    """
    docs = free_of(docs, "runs", "collapsed")
    at = docs.columns.index("text")
    rest = [k for k in range(len(docs.columns)) if k != at]
    schema = T.StructType([docs.schema.fields[k] for k in rest] + ADDED.fields)
    names = [f.name for f in schema.fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 2 << 20, at):
                yield pa.RecordBatch.from_arrays([*[part.column(k) for k in rest], *collapsed(part.column(at), least)], names=names)

    return docs.mapInArrow(run, schema)
