"""Token ids of a corpus as flat unsigned integer files with 64-bit document offsets, and reading them back.

A folder holds, for part p in ascending order of doc_id:

    part-p.ids      the token ids of all its documents in a row, unsigned 16 or 32 bits, little-endian
    part-p.docs     the doc_id of each document, signed 64 bits
    part-p.offsets  where each document begins in the whole corpus and where the last one ends, unsigned 64 bits
    manifest/       Parquet: part, n_docs, n_null, n_tokens, base, width

`base`, the number of ids in all parts before, is a prefix sum over the parts' sizes, so parts are written side by side.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow.fs import FileType
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from blockledger.llm.bpe import slices
from blockledger.llm.staging import open_store, shuffle_parts, staged
from blockledger.llm.words import WordEncoder, splitter, tokenizer

_ENCODERS: dict[str, WordEncoder] = {}


def encoder(path: str) -> WordEncoder:
    """The tokenizer's model behind a memory of pre-tokens, built once in each Python worker."""
    if path not in _ENCODERS:
        library = tokenizer(path)
        tokenize = library.model.tokenize
        added = {t.content: i for i, t in library.get_added_tokens_decoder().items()}
        _ENCODERS[path] = WordEncoder(lambda word: [t.id for t in tokenize(word)], splitter(library), added)
    return _ENCODERS[path]


def _name(folder: str, part: int, kind: str) -> str:
    return f"{folder}/part-{part:06d}.{kind}"


def _replace(store, path: str, write) -> None:
    """Write under a name of this attempt's own, then move: a repeated task leaves the same file.

    Stores that refuse to move over an existing file have the older one removed first; both hold the same bytes.
    """
    own = f"{path}.{TaskContext.get().taskAttemptId()}"
    with store.open_output_stream(own) as out:
        write(out)
    try:
        store.move(own, path)
    except OSError:
        if store.get_file_info(path).type == FileType.NotFound:
            raise
        store.delete_file(path)
        store.move(own, path)


def write_tokens(docs: DataFrame, vocabulary: str, folder: str, end_id: int, width: int = 16) -> None:
    """Encode every whole text and write the ids, each document closed by `end_id`, in ascending order of doc_id.

    Null and empty texts are the end id alone. Null doc_ids come first. Equal doc_ids are ordered by a hash of their texts;
    equal rows are all written. Other columns are not read. An empty table gives a manifest without parts. `width` is 16 or 32 bits;
    ids that do not fit raise an error.
    """
    spark = docs.sparkSession
    kind = np.dtype(f"<u{width // 8}")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(vocabulary).encode
        end = np.array([end_id], "<u4").tobytes()
        store, place = open_store(folder)
        part = TaskContext.get().partitionId()
        ids_of: list[np.ndarray] = []
        sizes: list[int] = []
        nulls = 0

        def out(stream):
            nonlocal nulls
            for batch in batches:
                for piece in slices(batch):
                    texts = [encode(t) + end for t in piece.column(1).to_pylist()]
                    ids = np.frombuffer(b"".join(texts), "<u4")
                    if len(ids) and int(ids.max()) > np.iinfo(kind).max:
                        raise ValueError(f"token ids need more than {width} bits")
                    stream.write(ids.astype(kind).tobytes())
                    sizes.extend(len(t) // 4 for t in texts)
                    nulls += piece.column(0).null_count
                    ids_of.append(piece.column(0).fill_null(0).to_numpy(zero_copy_only=False))

        _replace(store, _name(place, part, "ids"), out)
        if not sizes:
            store.delete_file(_name(place, part, "ids"))
            return
        doc_ids = np.concatenate(ids_of).astype("<i8")
        _replace(store, _name(place, part, "docs"), lambda s: s.write(doc_ids.tobytes()))
        _replace(store, _name(place, part, "sizes"), lambda s: s.write(np.array(sizes, "<u8").tobytes()))
        row = {"part": [part], "n_docs": [len(sizes)], "n_null": [nulls], "n_tokens": [sum(sizes)]}
        yield pa.RecordBatch.from_pydict(row)

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, place = open_store(folder)
        for batch in batches:
            for row in batch.to_pylist():
                with store.open_input_file(_name(place, row["part"], "sizes")) as file:
                    sizes = np.frombuffer(file.read(), "<u8")
                offsets = np.concatenate([[0], np.cumsum(sizes)]).astype("<u8") + np.uint64(row["base"])
                _replace(store, _name(place, row["part"], "offsets"), lambda s, x=offsets: s.write(x.tobytes()))
            yield batch

    store, place = open_store(folder)
    store.create_dir(place)
    digest = F.xxhash64("text")  # a long text is no bound of a range; the same keys deal and sort
    ordered = (
        docs.select(F.col("doc_id").cast("long"), "text")
        .repartitionByRange(shuffle_parts(spark), "doc_id", digest)
        .sortWithinPartitions("doc_id", digest, "text")
    )
    sizes = staged(ordered.mapInArrow(write, "part long, n_docs long, n_null long, n_tokens long"), "token-parts")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    based = sizes.withColumn("base", F.coalesce(F.sum("n_tokens").over(before), F.lit(0))).withColumn("width", F.lit(width))
    based.mapInArrow(index, based.schema).write.mode("overwrite").parquet(f"{folder}/manifest")


class Numbers:
    """A file of numbers: mapped into memory where the file system is local, else read span by span."""

    def __init__(self, store, path: str, kind: str):
        from pyarrow import fs

        self.kind = np.dtype(kind)
        local = isinstance(store, fs.LocalFileSystem)
        self.mapped = np.memmap(path, self.kind, "r") if local else None
        self.file = None if local else store.open_input_file(path)

    def span(self, start: int, stop: int) -> np.ndarray:
        if self.mapped is not None:
            return self.mapped[start:stop]
        size = self.kind.itemsize
        return np.frombuffer(self.file.read_at((stop - start) * size, start * size), self.kind)


def read_tokens(spark: SparkSession, folder: str, block: int = 1 << 20) -> DataFrame:
    """`doc_id`, `start` (ids of all documents before), `n_tokens`, `ids` (unsigned 32 bits, little-endian) from the files.

    About `block` ids are in memory at once; one document may be longer.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, place = open_store(folder)
        for row in (r for batch in batches for r in batch.to_pylist()):
            part, n = row["part"], row["n_docs"]
            ids = Numbers(store, _name(place, part, "ids"), f"<u{row['width'] // 8}")
            doc_ids = Numbers(store, _name(place, part, "docs"), "<i8").span(0, n)
            offsets = Numbers(store, _name(place, part, "offsets"), "<u8").span(0, n + 1).astype(np.int64)
            at = offsets - offsets[0]
            low = 0
            while low < n:
                high = min(n, max(low + 1, int(np.searchsorted(at, at[low] + block))))
                flat = ids.span(int(at[low]), int(at[high])).astype("<u4")
                cuts = ((at[low : high + 1] - at[low]) * 4).astype(np.int32)
                binary = pa.Array.from_buffers(pa.binary(), high - low, [None, pa.py_buffer(cuts), pa.py_buffer(flat)])
                names = pa.array(doc_ids[low:high], mask=np.arange(low, high) < row["n_null"])
                columns = [names, pa.array(offsets[low:high]), pa.array(np.diff(at[low : high + 1])), binary]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "start", "n_tokens", "ids"])
                low = high

    manifest = spark.read.parquet(f"{folder}/manifest").repartitionByRange(shuffle_parts(spark), "part")
    return manifest.mapInArrow(read, "doc_id long, start long, n_tokens long, ids binary")
