"""A store of real objects, one for each key below a folder: writing, deleting, and listing page by page after a key.

`spark.read.format("block_keys")` lists on the executors, each a range of the key space; as a stream it gives a page in
each micro-batch, and its offset is the last key of the page, so what is stopped goes on behind the last page that was
done. Keys come in the order of their text, as an object store lists them, and no state but a key is needed to go on.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator
from itertools import islice

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition, SimpleDataSourceStreamReader

from blockledger.functions.columns import local_name, object_key
from blockledger.schema import KEY, PAGE_SIZE
from blockledger.session import materialize

LISTED = "key string, size bigint"
BEHIND_ALL = "\U0010ffff"
HALVES = ("meta", "data")
FOUND = "path string, length bigint, folder boolean"
FRAME = 10_000  # names a task holds at a time


def open_store(uri: str):
    """The file system and path of a folder, for tasks that work on single objects."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(re.sub("^file:/+", "file:///", uri) if ":/" in uri else f"file://{uri}")


def keys_after(store, root: str, after: str = "", until: str = BEHIND_ALL, below: str = "") -> Iterator[tuple[str, int]]:
    """Keys and sizes with after < key <= until, in order; folders wholly outside are not opened.

    A folder sorts as its name with the slash behind it, which is where its keys are. The few objects of one block are
    listed in one call.
    """
    from pyarrow import fs

    names = below.split("/")
    whole = len(names) > 3 and names[-4] in HALVES
    place = f"{root}/{below}".rstrip("/")
    found = []
    for info in store.get_file_info(fs.FileSelector(place, allow_not_found=True, recursive=whole)):
        is_folder = info.type == fs.FileType.Directory
        if not (whole and is_folder):
            found.append((below + info.path[len(place) :].lstrip("/") + ("/" if is_folder else ""), info, is_folder))
    for key, info, is_folder in sorted(found, key=lambda x: x[0]):
        if key > until:
            return
        if is_folder:
            if after.startswith(key) or key > after:
                yield from keys_after(store, root, after, until, key)
        elif key > after and not info.base_name.startswith(("_", ".")):
            yield key, info.size


def key_pages(uri: str, after: str, until: str, n: int) -> Iterator[list[tuple[str, int]]]:
    """The listing in pages of at most `n` keys. Each goes on where the one before stopped, so a folder is opened once
    however many pages it fills; whoever begins anew needs only the last key of a page."""
    store, root = open_store(uri)
    keys = keys_after(store, root, after, until)
    while page := list(islice(keys, n)):
        yield page


class KeyRange(InputPartition):
    def __init__(self, after: str, until: str):
        self.after, self.until = after, until


class KeyReader(DataSourceReader):
    """Ranges cover every possible key, whatever is there: pools are cut by the first digit of the block's name."""

    def __init__(self, path: str, prefix: str, page: int):
        self.path, self.prefix, self.page = path, prefix, page

    def partitions(self):
        store, root = open_store(self.path)
        pools = pool_folders(store, root, self.prefix)
        cuts = sorted({f"{pool}{digit}" for pool in pools for digit in ("", *"123456789")})
        cuts = ["", *[c for c in cuts if c.startswith(self.prefix)], BEHIND_ALL]
        return [KeyRange(a, b) for a, b in zip(cuts, cuts[1:])]

    def read(self, partition):
        for page in key_pages(self.path, max(partition.after, self.prefix), partition.until, self.page):
            for key, size in page:
                if key.startswith(self.prefix):
                    yield key, size
            if not page[-1][0].startswith(self.prefix):
                return


class KeyPages(SimpleDataSourceStreamReader):
    """A page for each micro-batch: at most `page` names pass the driver at a time, as in the listing call itself."""

    def __init__(self, path: str, prefix: str, page: int):
        self.path, self.prefix, self.page = path, prefix, page

    def initialOffset(self):
        return {"after": self.prefix}

    def read(self, start):
        pages = key_pages(self.path, start["after"], self.prefix + BEHIND_ALL, self.page)
        page = [x for x in next(pages, []) if x[0].startswith(self.prefix)]
        return iter(page), {"after": page[-1][0] if page else start["after"]}

    def readBetweenOffsets(self, start, end):
        store, root = open_store(self.path)
        return (x for x in keys_after(store, root, start["after"], end["after"]) if x[0].startswith(self.prefix))


class BlockKeys(DataSource):
    """Options: `path`; `prefix` of the keys wanted; `page`, how many a listing call gives."""

    @classmethod
    def name(cls):
        return "block_keys"

    def schema(self):
        return LISTED

    def _settings(self):
        return self.options["path"], self.options.get("prefix", ""), int(self.options.get("page", PAGE_SIZE))

    def reader(self, schema):
        return KeyReader(*self._settings())

    def simpleStreamReader(self, schema):
        return KeyPages(*self._settings())


def _folders(store, path: str) -> list[str]:
    from pyarrow import fs

    found = store.get_file_info(fs.FileSelector(path, allow_not_found=True))
    return [i.base_name for i in found if i.type == fs.FileType.Directory]


def pool_folders(store, root: str, prefix: str = "") -> list[str]:
    """The folders of pools below the last folder of `prefix`, found by the halves above them.

    Without a half on the way they are looked for two levels down; blocks are never listed here.
    """

    def below(folder, levels):
        names = folder.rstrip("/").split("/")
        if names[-1] in HALVES or not levels:
            return [f"{folder}{name}/" for name in _folders(store, f"{root}/{folder}".rstrip("/"))]
        return [p for name in _folders(store, f"{root}/{folder}".rstrip("/")) for p in below(f"{folder}{name}/", levels - 1)]

    head = prefix.rpartition("/")[0]
    names = head.split("/") if head else []
    if len(names) > 1 and names[-2] in HALVES:
        return [f"{head}/"]
    if any(name in HALVES for name in names[:-2]):
        return []
    return below(f"{head}/" if head else "", 1)


def list_keys(spark: SparkSession, path: str, prefix="", page=PAGE_SIZE) -> DataFrame:
    """Every key below `path` that begins with `prefix`, and the object's size. A folder that is not there has none."""
    spark.dataSource.register(BlockKeys)
    return spark.read.format("block_keys").option("prefix", prefix).option("page", page).option("path", path).load()


def stream_keys(spark: SparkSession, path: str, prefix="", page=PAGE_SIZE) -> DataFrame:
    """The same as a stream of pages, which starts again behind the last page that its checkpoint has."""
    spark.dataSource.register(BlockKeys)
    return spark.readStream.format("block_keys").option("prefix", prefix).option("page", page).option("path", path).load()


def walk(spark: SparkSession, root: str) -> DataFrame:
    """Names and sizes (`path`, `length`) of all files below `root`, level by level.

    Each level is a job whose tasks open folders and write down what they find, so no names pass the driver. Names that
    Spark's own listing passes over are left out.
    """
    head = spark._jvm.org.apache.hadoop.fs.Path(root)
    head = head.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(head).toString().rstrip("/")

    def run(frames):
        store, place = open_store(head)
        for frame in frames:
            for folder in frame["path"]:
                inside = folder[len(head) :]
                for part in _entries(store, place + inside, missing=bool(inside)):
                    rows = [(f"{folder}/{name}", size, is_folder) for name, size, is_folder in part if _listed(name)]
                    yield pd.DataFrame(rows, columns=["path", "length", "folder"])

    level, found = spark.createDataFrame([(head,)], "path string"), None
    while True:
        here = materialize(level.repartition(spark.sparkContext.defaultParallelism, "path").mapInPandas(run, FOUND))
        files = here.filter(~F.col("folder")).select("path", "length")
        found = files if found is None else found.unionByName(files)
        level = here.filter("folder").select("path")
        if level.isEmpty():
            return found


def _listed(name: str) -> bool:
    return not (name.startswith(".") or name.startswith("_") and "=" not in name or name.endswith("._COPYING_"))


def _entries(store, path: str, missing=False):
    """What is in a folder, as (name, size, whether a folder), some at a time."""
    from pyarrow import fs

    if isinstance(store, fs.LocalFileSystem):
        try:
            with os.scandir(path) as inside:
                while part := [(e.name, e) for e in islice(inside, FRAME)]:
                    yield [(name, 0 if e.is_dir() else e.stat().st_size, e.is_dir()) for name, e in part]
        except FileNotFoundError:
            if not missing:
                raise
        return
    found = store.get_file_info(fs.FileSelector(path, allow_not_found=missing))
    for i in range(0, len(found), FRAME):
        yield [(x.base_name, x.size or 0, x.type == fs.FileType.Directory) for x in found[i : i + FRAME]]


def put_objects(copied: DataFrame, path: str, prefix=None, files=False) -> DataFrame:
    """Write the contents (`data`) and checksums (`meta`) of blocks as objects; gives the key and size of each.

    With `files` they are named pool/block_generation.data and .meta instead. An object that is written again replaces
    the one there, so a repeated task leaves the same store. The objects are written when the result is read.
    """

    def run(frames):
        store, root = open_store(path)
        for frame in frames:
            for key, body in zip(frame["key"], frame["body"]):
                place = f"{root}/{key}"
                store.create_dir(place.rpartition("/")[0], recursive=True)
                with store.open_output_stream(place) as out:
                    out.write(body)
            yield pd.DataFrame({"key": frame["key"], "size": frame["body"].map(len)})

    name = local_name if files else lambda half: object_key(half, prefix)
    sums = F.encode(F.array_join(F.transform("meta", lambda x: x.cast("string")), "\n"), "UTF-8")
    halves = F.array(*[F.struct(name(half).alias("key"), body.alias("body")) for half, body in (("data", F.col("data")), ("meta", sums))])
    return copied.select(F.inline(halves)).mapInPandas(run, LISTED)


def remove_objects(path: str, prefix=None):
    """A function of a batch of blocks that deletes both objects of each. What is gone already is no error."""

    def remove(blocks: pd.DataFrame) -> None:
        store, root = open_store(path)
        head = f"{root}/{prefix.strip('/')}" if prefix else root
        for row in blocks[KEY].itertuples(index=False):
            for half in ("meta", "data"):
                place = f"{head}/{half}/{row.pool_id}/{row.block_id}/{row.gen_stamp}/{row.length}"
                try:
                    store.delete_file(place)
                except FileNotFoundError:
                    pass

    return remove
