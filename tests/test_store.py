import glob
import os
import random

from conftest import rows
from pyspark.sql import functions as F

from blockledger.operators.filters import halves, half_uploads, has_block
from blockledger.operators.payload import (
    backup_payload, chunk_sums, delete_keys, merge_payload, restore_payload, verify_payload, write_payload,
)
from blockledger.schema import KEY
from blockledger.sources.inventory import list_after, list_files, parse_files, parse_keys, store_from_files, store_from_keys
from blockledger.sources.objects import KeyReader, key_pages, keys_after, list_keys, open_store, put_objects, remove_objects
from blockledger.sources.manifest import read_manifest, write_manifest


def some_blocks(n, seed=1):
    rnd = random.Random(seed)
    return [("poolid", rnd.randrange(-(2**63), 2**63), rnd.randrange(1000), rnd.randrange(2000)) for _ in range(n)]


def test_keys_round_trip(blocks):
    df = blocks(some_blocks(100))
    for prefix in (None, "a", "a/b"):
        assert rows(store_from_keys(delete_keys(df, prefix).select("key"), prefix)) == rows(df)


def test_bad_keys_are_set_aside(table):
    keys = table([("meta/p/1/2/3",), ("meta/p/x/2/3",), ("meta/p/1/2",), ("other/p/1/2/3",), ("meta//1/2/3",)], "key string")
    got = {r["key"]: r["error"] for r in parse_keys(keys).collect()}
    assert got == {
        "meta/p/1/2/3": None,
        "meta/p/x/2/3": "number",
        "meta/p/1/2": "segments",
        "other/p/1/2/3": "half",
        "meta//1/2/3": "pool",
    }


def test_paging_reaches_everything(blocks):
    df, after, seen = blocks(some_blocks(100)), None, []
    while page := list_after(df, after, 9).collect():
        assert len(page) <= 9
        seen += page
        after = page[-1]["key"]
    assert sorted(tuple(r[c] for c in KEY) for r in seen) == sorted(tuple(r) for r in df.collect())


def test_files_on_disk(spark, blocks, tmp_path):
    wanted = [("pool1", 5, 3, 10), ("pool1", 6, 0, 11), ("pool2", -7, 4, 12)]
    for pool, block, length, gen in wanted:
        (tmp_path / pool).mkdir(exist_ok=True)
        (tmp_path / pool / f"{block}_{gen}.data").write_bytes(b"x" * length)
        (tmp_path / pool / f"{block}_{gen}.meta").write_bytes(b"mm")
    assert rows(store_from_files(list_files(spark, str(tmp_path)))) == rows(blocks(wanted))


def test_files_are_listed_by_tasks(spark, tmp_path, monkeypatch):
    """Below folders in folders, without Spark's listing in the driver; an empty file counts if its side file does not lack."""
    files = {"p/1_1.data": 2, "a b/c%20/2_1.data": 3, "p/3_1.data": 0, "p/3_1.meta": 1, "p/4_1.data": 0, "p/5_1.data": 0, "p/5_1.meta": 0,
             "_p/6_1.data": 1, "p/.7_1.data": 1, "p/_8_1.data": 1, "_a=1/9_1.data": 1, "p/other": 4}
    for name, size in files.items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_bytes(b"x" * size)
    monkeypatch.setattr("pyspark.sql.readwriter.DataFrameReader.format", None)
    for root in (str(tmp_path), f"file:{tmp_path}/"):
        want = {f"file:{tmp_path}/{n}": files[n] for n in ("p/1_1.data", "a b/c%20/2_1.data", "p/3_1.data", "_a=1/9_1.data")}
        assert {r["path"]: r["length"] for r in list_files(spark, root).collect()} == want


def test_odd_file_names(table):
    names = ["a/p/1_2.data", "/p/1_2.data", "p/1_2.data", "1_2.data", "/1_2.data", "a//1_2.data", "a/p/", "a/p/1_2.d/", "p/\n", "p/1_2.x\n", "", None, "é/ü/3_4.data"]
    got = {r["path"]: (r["pool_id"], r["error"]) for r in parse_files(table([(n, 1) for n in names], "path string, length bigint")).collect()}
    ok = {"a/p/1_2.data": "p", "/p/1_2.data": "p", "p/1_2.data": "p", "p/1_2.x\n": "p", "é/ü/3_4.data": "ü"}
    bad = {"1_2.data": "pool", "/1_2.data": "pool", "a//1_2.data": "pool", "a/p/": "pool", "a/p/1_2.d/": "pool", "p/\n": "name", "": "pool", None: "number"}
    assert got == {n: (ok.get(n), bad.get(n)) for n in names}


def test_manifest_sizes(blocks):
    df = blocks(some_blocks(95))
    lists = write_manifest(df, 10)
    assert lists.count() == 10
    assert rows(read_manifest(lists)) == rows(df)


def test_copy_verify_restore(spark, blocks, table, tmp_path):
    data = {1: b"a" * 1300, 2: b"", 3: b"zz"}
    payload = table(
        [("p", b, len(d), 1, bytearray(d)) for b, d in data.items()],
        "pool_id string, block_id bigint, length bigint, gen_stamp bigint, data binary",
    )
    plan = blocks([("p", 1, 1300, 1), ("p", 2, 0, 1), ("p", 3, 5, 1), ("p", 4, 1, 1)])
    copied = backup_payload(plan, payload)
    assert {r["block_id"]: r["status"] for r in copied.collect()} == {
        1: "ok", 2: "ok", 3: "length_mismatch", 4: "no_payload",
    }
    write_payload(copied, str(tmp_path / "out"))
    stored = spark.read.parquet(str(tmp_path / "out"))
    assert {r["fault"] for r in verify_payload(stored).collect()} == {"none"}
    flipped = stored.withColumn("data", F.expr("encode(concat('b', substring(decode(data, 'UTF-8'), 2)), 'UTF-8')"))
    faults = {r["block_id"]: (r["bad_chunks"], r["fault"]) for r in verify_payload(flipped).collect()}
    assert faults == {1: (1, "checksum"), 2: (1, "length")}
    back = restore_payload(plan, stored, blocks([("p", 2, 0, 1)]))
    got = {r["block_id"]: (r["status"], r["bytes_copied"], r["data"]) for r in back.collect()}
    assert got == {
        1: ("restored", 1300, bytearray(data[1])),
        2: ("already_valid", 0, None),
        3: ("not_stored", 0, None),
        4: ("not_stored", 0, None),
    }


def test_has_block_after_write(blocks):
    df = blocks(some_blocks(8))
    data = df.withColumn("size", F.col("length"))
    assert rows(has_block(halves(df, data))) == rows(df)
    assert half_uploads(halves(df, data)).count() == 0
    assert half_uploads(halves(df, data.limit(0))).filter("fault = 'data_missing'").count() == 8


def put(df, path, **kw):
    rows = df.withColumn("data", F.encode(F.col("block_id").cast("string"), "UTF-8")).withColumn("meta", F.array(F.lit(1), F.lit(2)))
    return put_objects(rows, path, **kw).collect()


def test_listing_is_in_key_order_and_cut_anywhere(blocks, tmp_path):
    """Names that sort before and after a slash, negative numbers, prefixes of one another."""
    df = blocks([(p, b, n, n) for p in ("a", "a-b", "a.c", "ab", "a0") for b in (-5, -50, 5, 50, 500, 6) for n in (1, 10, 2)])
    keys = sorted(r["key"] for r in put(df, str(tmp_path)))
    store, root = open_store(str(tmp_path))
    assert [k for k, _ in keys_after(store, root)] == keys and len(keys) == 180
    for i in (0, 17, 90, 179):
        assert [k for k, _ in keys_after(store, root, keys[i])] == keys[i + 1 :]
        assert [k for k, _ in keys_after(store, root, keys[i] + "x", keys[-2])] == keys[i + 1 : -1]
    for n in (1, 7, 1000):
        assert [k for page in key_pages(str(tmp_path), "", "\U0010ffff", n) for k, _ in page] == keys


def test_listing_as_a_source(spark, blocks, tmp_path):
    df = blocks(some_blocks(100))
    written = put(df, str(tmp_path), prefix="x/y")
    assert rows(list_keys(spark, str(tmp_path), page=9)) == sorted((tuple(r) for r in written), key=repr)
    listed = list_keys(spark, str(tmp_path), "x/y/meta/", page=9)
    assert listed.count() == 100 and rows(store_from_keys(listed, "x/y")) == rows(df)
    assert list_keys(spark, str(tmp_path / "none")).count() == 0 and list_keys(spark, str(tmp_path), "z").count() == 0
    remove = remove_objects(str(tmp_path), "x/y")
    for _ in range(2):
        remove(df.limit(40).toPandas())
    assert list_keys(spark, str(tmp_path)).count() == 120


def test_a_folder_is_opened_once_for_all_its_pages(blocks, tmp_path, monkeypatch):
    """And ranges cut the pools below a prefix, not only those at the top."""
    df = blocks([(p, b, 1, 1) for p in ("p", "q") for b in range(40)])
    put(df, str(tmp_path), prefix="a/b")
    opened = []

    class Counted:
        def __init__(self, store):
            self.store = store

        def get_file_info(self, selector):
            opened.append(selector.base_dir)
            return self.store.get_file_info(selector)

    store, root = open_store(str(tmp_path))
    monkeypatch.setattr("blockledger.sources.objects.open_store", lambda uri: (Counted(store), root))
    pages = list(key_pages(str(tmp_path), "a/b/meta/", "a/b/meta/\U0010ffff", 3))
    assert [len(page) for page in pages] == [3] * 26 + [2] and len(opened) == len(set(opened)) <= 90
    for prefix in ("", "a", "a/b/", "a/b/meta", "a/b/meta/", "a/b/meta/p", "a/b/meta/p/", "a/b/meta/p/3", "a/b/meta/p/3/1/"):
        reader = KeyReader(str(tmp_path), prefix, 7)
        parts = reader.partitions()
        found = [key for part in parts for key, _ in reader.read(part)]
        assert len(found) == len(set(found)) == {"": 160, "a": 160, "a/b/": 160, "a/b/meta": 80, "a/b/meta/": 80, "a/b/meta/p": 40,
                                                 "a/b/meta/p/": 40, "a/b/meta/p/3": 11, "a/b/meta/p/3/1/": 1}[prefix]
        assert len(parts) >= 10 or prefix in ("", "a", "a/b/meta/p/3", "a/b/meta/p/3/1/")


HELD = "pool_id string, block_id bigint, length bigint, gen_stamp bigint, data binary"


def held(table, rows):
    df = table(rows, HELD)
    return df.withColumn("meta", chunk_sums(df["data"], algorithm="md5"))


def test_contents_stay_where_they_are_read(table, blocks):
    """Above the join with a small plan nothing with contents is shuffled, sorted or grouped."""
    payload = table([("p", i, 3, 1, b"abc") for i in range(50)], HELD)
    plan = backup_payload(blocks([("p", i, 3, 1) for i in range(5)]), payload)._jdf.queryExecution().executedPlan().toString()
    moved = [line for line in plan.splitlines() if "Exchange hashpartitioning" in line or "SortAggregate" in line]
    assert "BroadcastHashJoin" in plan and not any("data" in line for line in moved)


def test_one_of_several_contents(table, blocks):
    rows_ = [("p", 1, 3, 1, x) for x in (b"zz", b"abc", b"abc", b"xyz", b"long")] + [("p", 2, 9, 1, b"b"), ("p", 2, 9, 1, b"a"), ("p", 3, 1, 1, b"c")]
    plan = blocks([("p", 1, 3, 1), ("p", 2, 9, 1), ("p", 3, 1, 1)])
    import hashlib

    least = lambda *xs: min(xs, key=lambda x: hashlib.md5(x).hexdigest())
    for order in (rows_, rows_[::-1]):
        got = {r["block_id"]: (r["status"], r["data"] and bytes(r["data"])) for r in backup_payload(plan, held(table, order)).collect()}
        assert got == {1: ("ok", least(b"abc", b"xyz")), 2: ("length_mismatch", None), 3: ("ok", b"c")}
        back = restore_payload(plan, held(table, order), blocks([])).collect()
        assert sorted((r["block_id"], bytes(r["data"])) for r in back) == [(1, least(b"abc", b"xyz")), (2, least(b"a", b"b")), (3, b"c")]


def test_only_touched_buckets_are_written_anew(spark, table, tmp_path):
    path = str(tmp_path / "t")
    names = lambda: {f: os.stat(f).st_mtime_ns for f in glob.glob(f"{path}/*/*/*.parquet")}
    state = lambda: sorted((r["pool_id"], r["block_id"], bytes(r["data"])) for r in spark.read.parquet(path).collect())
    rows_ = [(p, i, 1, 1, b"a") for p in ("p", "7") for i in range(60)]
    merge_payload(held(table, rows_), path, buckets=8)
    first, before = names(), state()
    assert len(first) == 16 and before == sorted((r[0], r[1], b"a") for r in rows_)
    new = held(table, [("p", 3, 1, 1, b"b"), ("p", 3, 1, 1, b"b"), ("7", 100, 1, 1, b"c")])
    merge_payload(new, path, buckets=8)
    second, after = names(), state()
    assert len(set(first) & set(second)) == 14 and all(first[f] == second[f] for f in set(first) & set(second))
    want = sorted([x for x in before if x[:2] != ("p", 3)] + [("p", 3, b"b"), ("7", 100, b"c")])
    assert after == want
    merge_payload(new, path, buckets=8)
    assert state() == want
