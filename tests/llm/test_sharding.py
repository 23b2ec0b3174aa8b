"""Shards under each of the three laws."""

from collections import Counter

import pytest
from given import frame, odd_rows  # noqa: F401
from pyspark.sql import functions as F

from blockledger.llm import sharding
from blockledger.llm.staging import shared_path


def made(docs, **options):
    return sharding.write_shards(docs, shared_path(docs.sparkSession, "shards"), **options)


def gapless(rows):
    slots = {}
    for r in rows:
        slots.setdefault(r["shard"], []).append(r["slot"])
    return all(sorted(s) == list(range(len(s))) for s in slots.values())


def plain(rows):
    return Counter((r[0], r[1], r[2], r[3], r[4]) for r in rows)


@pytest.fixture(scope="module")
def many():
    return [(i, f"text {i} " * (i % 50) if i % 11 else None, "en", "s", i) for i in range(1500)]


def test_rows(frame, many, odd_rows):
    for rows in (many, odd_rows, many[:3]):
        found = made(frame(rows), shards=7, cell_rows=16).collect()
        assert plain(found) == Counter(rows) and gapless(found)
        counts = Counter(r["shard"] for r in found)
        assert max(counts.values()) - min(counts[s] for s in range(7)) <= 1 and {r["grown_shard"] for r in found} == {None}


def test_bytes(frame, many, odd_rows):
    for rows in (many, odd_rows, many[:3]):
        found = made(frame(rows), shards=7, law="bytes", cell_rows=16).collect()
        assert plain(found) == Counter(rows) and gapless(found)
        sizes, counts = [0] * 7, max(len((r[1] or "").encode()) + 8 for r in rows)
        for r in found:
            sizes[r["shard"]] += len((r["text"] or "").encode()) + 8
        assert all(abs(x - sum(sizes) / 7) <= counts for x in sizes)


def test_key(frame, many, odd_rows):
    docs = frame([*many, *odd_rows])
    found = made(docs, shards=5, law="key", cell_rows=16).collect()
    more = made(docs, shards=6, law="key", cell_rows=16).collect()
    assert plain(found) == Counter([*many, *odd_rows]) and gapless(found) and gapless(more)
    at = {r["doc_id"]: {r["shard"]} for r in found}
    grown = {r["doc_id"]: r["shard"] for r in more}
    for r in found:
        assert at[r["doc_id"]] == {r["shard"]} and r["grown_shard"] == grown[r["doc_id"]] and r["grown_shard"] in (r["shard"], 5)
    moved = sum(r["grown_shard"] == 5 for r in found)
    assert 0.5 < moved / (len(found) / 6) < 1.5
    alone = made(docs.where("doc_id % 3 = 0"), shards=5, law="key").collect()
    assert all({r["shard"]} == at[r["doc_id"]] for r in alone)


@pytest.mark.parametrize("law", sharding.LAWS)
def test_same_seed_same_order(frame, many, law):
    docs = frame(many)
    key = lambda df: sorted((r["shard"], r["slot"], r["doc_id"]) for r in df.collect())
    one = key(made(docs, shards=4, law=law, seed=3, cell_rows=16))
    assert one == key(made(docs.repartition(11), shards=4, law=law, seed=3, cell_rows=16, bucket_bytes=4096))
    assert one != key(made(docs, shards=4, law=law, seed=4, cell_rows=16))
    order = [d for _, _, d in one]
    rising = sum(a < b for a, b in zip(order, order[1:], strict=False)) / len(order)
    assert 0.45 < rising < 0.55


@pytest.mark.parametrize("law", sharding.LAWS)
def test_one_row_many_times(frame, many, law, monkeypatch):
    """Half of all rows are alike in doc_id and text, and most of those in all columns; cells stay small."""
    monkeypatch.setattr("blockledger.llm.staging.COPIES", 64)
    rows = many + [(None, None, None, "a", 1)] * 900 + [(None, None, "x", f"s{i % 3}", 1) for i in range(400)] + [(3, "same", "en", "s", 1)] * 300
    seen = []
    cells = sharding._cells
    monkeypatch.setattr(sharding, "_cells", lambda r: seen.append(cells(r)) or seen[-1])
    found = made(frame(rows), shards=6, law=law, cell_rows=16).collect()
    assert plain(found) == Counter(rows) and gapless(found)
    assert len(seen) == 2 and seen[-1].agg(F.max("n")).first()[0] < 8 * 16
    if law == "rows":
        assert set(Counter(r["shard"] for r in found).values()) <= {len(rows) // 6, len(rows) // 6 + 1}


def test_clashing_names_and_nothing(frame, many, spark):
    docs = frame(many).withColumns({name: F.lit(5) for name in ("Shard", "slot", "_cell", "_pos", "n", "bytes", "order", "kept")})
    found = made(docs, shards=3).collect()
    assert plain(found) == Counter(many) and gapless(found) and {r["kept"] for r in found} == {5}
    for law in sharding.LAWS:
        assert made(frame([]), law=law).count() == 0
    with pytest.raises(ValueError):
        made(frame([]), law="luck")


def test_files_hold_pieces_in_order(frame, many, spark):
    path = shared_path(spark, "shards")
    sharding.write_shards(frame(many), path, shards=4, bucket_bytes=2048)
    read = sharding.read_shards(spark, path).withColumn("file", F.input_file_name())
    rows = read.select("file", "slot").collect()
    files = {}
    for r in rows:
        files.setdefault(r["file"], []).append(r["slot"])
    assert all(sorted(s) == list(range(min(s), max(s) + 1)) for s in files.values())


def test_swaps_are_even(spark):
    """Every number comes to every place about as often."""
    found = spark.range(4000).withColumn("n", F.lit(4)).select(sharding.swapped("id", "n", 1).alias("o")).collect()
    places = Counter((k, x) for (o,) in found for k, x in enumerate(o))
    assert all(sorted(o) == [0, 1, 2, 3] for (o,) in found) and all(850 < places[k, x] < 1150 for k in range(4) for x in range(4))


def test_no_python_on_the_main_path(frame, many):
    docs = frame(many)
    rows = sharding._hashed(docs.withColumn("_copy", F.lit(0)), 0).withColumn("_cell", F.shiftright("_hash", 28))
    plan = sharding._ranked(rows, sharding._located(sharding._cells(rows)), 4, 16, 0)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
