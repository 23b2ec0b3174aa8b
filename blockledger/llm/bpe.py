"""BPE encoding by backtracking over Aho-Corasick matches, and decoding with an offset table.

The encoder takes the longest vocabulary entry at each place from an automaton over all entries. It walks through the
word with those and steps back to a shorter entry whenever two neighbours are not *compatible*, that is when
the merges would not have left exactly these two side by side. Words get the same ids as by merging, in linear time.
"""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from blockledger.llm.words import WORD_END, WordEncoder, rules, splitter, vocabulary

END = "\x01"  # stands for the word end; no byte character has this code
NEVER = 1 << 60
# A worker stays for the steps that follow and holds on to what it remembers: two of them must fit beside the executor.
KEPT, PAIRS, EDGES = 100_000, 200_000, 8_000  # pre-tokens (or pieces) remembered, up to twice; pairs; edges of tokens


class Vocabulary:
    def __init__(self, path: str, pairs_kept: int = PAIRS):
        data = vocabulary(path)
        text_of = {i: t for t, i in data["model"]["vocab"].items()}
        self.added = {x["content"]: x["id"] for x in data["added_tokens"]}
        plain = {i: (t[: -len(WORD_END)] + END if t.endswith(WORD_END) else t) for i, t in text_of.items()}
        id_of = {t: i for i, t in plain.items()}
        self.text = plain
        self.rank: dict[tuple[int, int], int] = {}  # order of the merge of two neighbours
        self.parts: dict[int, tuple[int, int]] = {}  # what a token is merged from
        self.made = {}  # order of the merge that makes a token
        for order, (a, b) in enumerate(data["model"]["merges"]):
            b = b[: -len(WORD_END)] + END if b.endswith(WORD_END) else b
            left, right = id_of[a], id_of[b]
            self.rank[left, right] = order
            self.parts.setdefault(id_of[a + b], (left, right))
            self.made.setdefault(id_of[a + b], order)
        self.pairs: dict[tuple[int, int], bool] = {}
        self.pairs_kept = pairs_kept
        self.last, self.first = {}, {}
        reached = self._reached()
        self.length = {i: len(plain[i]) for i in reached}
        self.shorter = self._shorter(reached)
        self.found = ahocorasick.Automaton()
        for i in reached:
            self.found.add_word(plain[i], i)
        self.found.make_automaton()
        self._decoding(text_of, data["added_tokens"])

    def edge(self, token: int, side: int) -> list[tuple[int, int]]:
        """The tokens at one edge of a token while it is being merged, each with the order of the merge that ends it."""
        kept = self.last if side else self.first
        got = kept.get(token)
        if got is None:
            got, at = [(token, NEVER)], token
            while at in self.parts:
                until = self.made[at]
                at = self.parts[at][side]
                got.append((at, until))
            if len(kept) >= EDGES:
                kept.clear()
            kept[token] = got
        return got

    def _crosses(self, left: int, right: int, until: int) -> bool:
        """Does a merge over the border of two tokens come before the merges inside them, and before `until`?

        Equal merges are done from the left, so one over the border wins against an equal one to its right.
        """
        for x, x_until in self.edge(left, 1):
            for y, y_until in self.edge(right, 0):
                order = self.rank.get((x, y), NEVER)
                if order < x_until and order <= y_until and order < until:
                    return True
        return False

    def compatible(self, left: int, right: int) -> bool:
        got = self.pairs.get((left, right))
        if got is None:
            got = not self._crosses(left, right, NEVER)
            if len(self.pairs) >= self.pairs_kept:
                self.pairs.clear()
            self.pairs[left, right] = got
        return got

    def _reached(self) -> set[int]:
        """Tokens that their own text is encoded to; merges never produce the others."""
        good = {i for i in self.text if i not in self.parts}
        for token, (a, b) in sorted(self.parts.items(), key=lambda x: self.made[x[0]]):
            if a in good and b in good and not self._crosses(a, b, self.made[token]):
                good.add(token)
        return good

    def _shorter(self, reached: set[int]) -> dict[int, int]:
        """The longest other token that a token begins with, or -1."""
        id_of = {self.text[i]: i for i in reached}
        found = {}
        for i in reached:
            text = self.text[i]
            found[i] = next((id_of[text[:n]] for n in range(len(text) - 1, 0, -1) if text[:n] in id_of), -1)
        return found

    def encode(self, word: str) -> list[int]:
        """Ids of one word given in byte characters."""
        word += END
        end = len(word)
        length, shorter, pairs = self.length, self.shorter, self.pairs
        longest = [-1] * end
        for stop, token in self.found.iter_long(word):  # one pass from match to match; other places when they come up
            longest[stop + 1 - length[token]] = token
        ids: list[int] = []
        dead: set[int] = set()
        place, token = 0, longest[0]
        while True:
            while token >= 0:
                after = place + length[token]
                if after not in dead:
                    if not ids:
                        break
                    fits = pairs.get((ids[-1], token))
                    if fits if fits is not None else self.compatible(ids[-1], token):
                        break
                token = shorter[token]
            if token >= 0:
                ids.append(token)
                place = after
                if place == end:
                    return ids
                token = longest[place]
                if token < 0:
                    token = longest[place] = self._longest(word, place)
            else:
                dead.add(place)
                token = ids.pop()
                place -= length[token]
                token = shorter[token]

    def _longest(self, word: str, place: int) -> int:
        for stop, token in self.found.iter_long(word, place):
            return token if stop + 1 - self.length[token] == place else -1
        return -1

    def _decoding(self, text_of: dict[int, str], added: list[dict]) -> None:
        """All token texts in one buffer and where each begins; every token is followed by the space that joins them."""
        size = max([*text_of, *(x["id"] for x in added)]) + 1
        texts = [b""] * size
        for i, t in text_of.items():
            texts[i] = t.encode("utf-8") + b" "
        for x in added:
            texts[x["id"]] = x["content"].encode("utf-8") + b" "
        self.buffer = np.frombuffer(b"".join(texts), np.uint8)
        self.offsets = np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)

    def decode(self, ids: np.ndarray) -> bytes:
        """Token texts joined by spaces, as UTF-8."""
        if not len(ids):
            return b""
        starts, sizes = self.offsets[ids], self.offsets[ids + 1] - self.offsets[ids]
        ends = np.cumsum(sizes)
        at = np.arange(ends[-1]) + np.repeat(starts - ends + sizes, sizes)
        return self.buffer[at].tobytes()[:-1]


_LOADED: dict[str, tuple[Vocabulary, WordEncoder]] = {}


def loaded(path: str) -> tuple[Vocabulary, WordEncoder]:
    """The tables of a vocabulary file, built once in each Python worker."""
    if path not in _LOADED:
        table = Vocabulary(path)
        _LOADED[path] = table, WordEncoder(table.encode, splitter(rules(path)), table.added, KEPT)
    return _LOADED[path]


SCHEMA = "doc_id long, ids binary, decoded binary"


def encode_decode(docs: DataFrame, path: str) -> DataFrame:
    """`doc_id`, `ids` (unsigned 32-bit little-endian) and `decoded` (UTF-8) of every text in `docs`.

    Null and empty texts, and those of white space alone, give empty ids and an empty decoded text. A null doc_id is
    kept. Repeated rows are encoded as often as they come; other columns are not read. An empty table gives no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, encoder = loaded(path)
        for batch in batches:
            for part in slices(batch):
                ids = [encoder.encode(text) for text in part.column(1).to_pylist()]
                decoded = [table.decode(np.frombuffer(x, "<u4").astype(np.int64)) for x in ids]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(ids, pa.binary()), pa.array(decoded, pa.binary())],
                    names=["doc_id", "ids", "decoded"],
                )

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, SCHEMA)


def slices(batch: pa.RecordBatch, most: int = 4 << 20, at: int = 1) -> Iterator[pa.RecordBatch]:
    """Cut a batch whose column `at` is text into parts of about `most` bytes; one text may be larger."""
    column = batch.column(at)
    if not batch.num_rows:
        return
    if column.nbytes <= most:
        yield batch
        return
    import pyarrow.compute as pc

    sizes = pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False).cumsum()
    parts = sizes // most
    cuts = [0, *(np.flatnonzero(np.diff(parts)) + 1).tolist(), batch.num_rows]
    for a, b in zip(cuts, cuts[1:], strict=False):
        if b > a:
            yield batch.slice(a, b - a)


def digests(encoded: DataFrame, *others: str) -> DataFrame:
    """Counts and SHA-256 sums of what encode_decode gives, and any of its own columns."""
    return encoded.select(
        "doc_id",
        (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
        *others,
    )
