"""Language identification by rank-order profiles.

The most frequent character n-grams of a language, in order of frequency, are its profile. A document's own profile is
compared with each: every n-gram counts by how far out of place it is, and as much as can be if it is not there at all.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from blockledger.llm.bpe import slices
from blockledger.llm.staging import free_of, staged

UNKNOWN = "und"
_LETTERS: list[np.ndarray] = []


def letters() -> np.ndarray:
    if not _LETTERS:
        _LETTERS.append(np.array([chr(c).isalpha() for c in range(0x110000)]))
    return _LETTERS[0]


def grams(text: str, longest: int) -> np.ndarray:
    """Every n-gram of 1 to `longest` (at most 3) characters as a number. What is no letter is one blank."""
    codes = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    codes = np.concatenate([[32], codes, [32]]).astype(np.int64)
    letter = letters()[codes]
    kept = letter.copy()
    kept[1:] |= letter[:-1]  # the first of a run of others
    kept[0] = True
    codes = np.where(letter, codes, 32)[kept]
    if len(codes) < 3:
        return np.zeros(0, np.int64)
    found = [codes[codes != 32]]
    if longest > 1:
        pairs = codes[:-1] << 21 | codes[1:]
        found.append(pairs)
        if longest > 2:
            found.append(pairs[:-1] << 21 | codes[2:])
    return np.concatenate(found)


def ranked(keys: np.ndarray, counts: np.ndarray, size: int) -> np.ndarray:
    """The `size` most frequent keys, equal counts in order of the key."""
    return keys[np.lexsort((keys, -counts))[:size]]


def train(docs: DataFrame, longest: int = 3, size: int = 300, most_languages: int = 5_000) -> DataFrame:
    """`lang`, `gram`, `rank` (from 0): the profile of every language in `docs` over all of its texts.

    Rows with a null lang or text add nothing, empty texts neither; repeated rows count as often as they come. The
    result has at most `size` rows a language; more than `most_languages` languages raise an error, since scoring holds
    all profiles in memory. An empty table gives no rows.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: dict[str, tuple[np.ndarray, np.ndarray]] = {}

        def rows(lang):
            keys, counts = kept.pop(lang)
            return pa.RecordBatch.from_arrays(
                [pa.array([lang] * len(keys), pa.string()), pa.array(keys), pa.array(counts)],
                names=["lang", "gram", "n"],
            )

        for batch in batches:
            for part in slices(batch, 1 << 20):
                texts: dict[str, list[np.ndarray]] = {}
                for lang, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                    texts.setdefault(lang, []).append(grams(text, longest))
                for lang, found in texts.items():
                    keys, counts = np.unique(np.concatenate(found), return_counts=True)
                    if lang in kept:
                        old, n = kept[lang]
                        keys, at = np.unique(np.concatenate([old, keys]), return_inverse=True)
                        counts = np.bincount(at, np.concatenate([n, counts]), len(keys)).astype(np.int64)
                    kept[lang] = keys, counts.astype(np.int64)
                    if len(keys) > 1_000_000:
                        yield rows(lang)
        for lang in list(kept):
            yield rows(lang)

    known = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull()).select("lang", "text")
    counted = known.mapInArrow(count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    order = Window.partitionBy("lang").orderBy(F.desc("n"), "gram")
    profiles = counted.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= size)
    profiles = staged(profiles.select("lang", "gram", (F.col("rank") - 1).alias("rank")), "profiles")
    if profiles.select("lang").distinct().limit(most_languages + 1).count() > most_languages:
        raise ValueError(f"more than {most_languages} languages")
    return profiles


def predict(docs: DataFrame, profiles: DataFrame, longest: int = 3, size: int = 300) -> DataFrame:
    """`docs` with `lang_pred` and `score`: 1 less the share of the largest possible distance, so 1 is the same profile.

    Null and empty texts, and those without a letter, get `und` and 0; so does everything if there are no profiles.
    Equal distances go to the language whose name comes first. Repeated rows and null doc_ids are judged like others. All
    other columns are kept, but for those called like the two or `_row`. An empty table gives no rows.
    """
    docs = free_of(docs, "lang_pred", "score", "_row")
    known = profiles.collect()  # bounded: `size` rows a language, and the languages are counted
    langs = sorted({r["lang"] for r in known})
    keys = np.unique(np.array([r["gram"] for r in known], np.int64))
    ranks = np.full((len(keys) + 1, len(langs)), -1, np.int32)
    for r in known:
        ranks[np.searchsorted(keys, r["gram"]), langs.index(r["lang"])] = r["rank"]

    def judge(text: str | None) -> tuple[str, float]:
        found = grams(text, longest) if text else np.zeros(0, np.int64)
        if not len(found) or not langs:
            return UNKNOWN, 0.0
        own = ranked(*np.unique(found, return_counts=True), size)
        at = np.searchsorted(keys, own)
        at[keys[np.minimum(at, len(keys) - 1)] != own] = len(keys)
        there = ranks[at]
        off = np.where(there < 0, size, np.abs(there - np.arange(len(own))[:, None])).sum(0)
        best = int(off.argmin())
        return langs[best], 1.0 - float(off[best]) / (size * len(own))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                found = [judge(t) for t in part.column(1).to_pylist()]
                columns = [*part.columns, pa.array([x[0] for x in found], pa.string()), pa.array([x[1] for x in found])]
                yield pa.RecordBatch.from_arrays(columns, names=[*names, "lang_pred", "score"])

    others = [c for c in docs.columns if c != "text"]
    names = [*others[:1], "text", *others[1:]]
    if not others:
        docs, names = docs.withColumn("_row", F.lit(0)), ["_row", "text"]
    plain = docs.select(*[quoted(c) for c in names])
    schema = StructType([*plain.schema.fields, StructField("lang_pred", StringType()), StructField("score", DoubleType())])
    judged = plain.mapInArrow(run, schema)
    return judged.select(*[quoted(c) for c in [*(c for c in docs.columns if c != "_row"), "lang_pred", "score"]])


def quoted(name: str) -> Column:
    return F.col(f"`{name.replace('`', '``')}`")


def fold(column: str, parts: int) -> Column:
    """crc32 of a number as text, modulo `parts`. A null counts as the empty text."""
    return F.pmod(F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")), F.lit(parts))
