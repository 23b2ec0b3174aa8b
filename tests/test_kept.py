"""Inventories kept in buckets, and quantile sketches kept per run."""

import random

import pytest
from conftest import rows

from blockledger.operators.metrics import RANK_ERROR, amount_sketches, merge_sketches, sketch_quantiles
from blockledger.operators.reconcile import presence_kept, reconcile, reconcile_kept
from blockledger.sources.inventory import keep_inventory


@pytest.fixture
def kept(spark, tmp_path):
    names = []

    def keep(df, name, **options):
        spark.sql(f"drop table if exists {name}")
        names.append(name)
        return keep_inventory(df, name, **options)

    yield keep
    for name in names:
        spark.sql(f"drop table if exists {name}")


def sides(blocks):
    draw = random.Random(3)
    block = lambda: (draw.choice("pq"), draw.randrange(60), draw.randrange(3), 1)
    odd = [(None, 1, 1, 1), ("p", None, 1, 1), ("p", 7, 7, 7), ("p", 7, 7, 7)]
    live = [block() for _ in range(300)] + odd
    store = [block() for _ in range(300)] + [("gone", i, 1, 1) for i in range(20)] + odd
    return blocks(live), blocks(store)


@pytest.mark.parametrize("unknown_only", [False, True])
def test_kept_inventories_compare_as_others_do(blocks, kept, unknown_only):
    live, store = sides(blocks)
    got = reconcile_kept(kept(live, "kept_live"), kept(store, "kept_store"), unknown_only)
    assert rows(got) == rows(reconcile(live, store, unknown_only))


def test_no_side_of_a_kept_comparison_moves(blocks, kept):
    live, store = sides(blocks)
    found = presence_kept(kept(live, "kept_live"), kept(store, "kept_store"))
    found.collect()
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Join" in plan and "Exchange" not in plan


def test_an_empty_inventory_is_kept(blocks, kept):
    live, store = blocks([]), blocks([("p", 1, 1, 1)])
    got = reconcile_kept(kept(live, "kept_live"), kept(store, "kept_store"))
    assert rows(got) == [("p", 1, 1, 1, "restore")]
    kept(store, "kept_live", buckets=3)


def test_merged_quantiles_are_as_near_as_stated(spark):
    draw = random.Random(4)
    amounts = [("hot", f"run{draw.randrange(9)}", int(draw.paretovariate(1.1) * 100)) for _ in range(60_000)]
    amounts += [("even", "run1", i) for i in range(500)] + [("even", "run2", None), ("none", "run1", None)]
    sketches = amount_sketches(spark.createDataFrame(amounts, "node string, run string, amount bigint"))
    assert sketches.count() == 10
    for r in sketch_quantiles(merge_sketches(sketches)).collect():
        own = [a for node, _, a in amounts if node == r["node"] and a is not None]
        assert (r["n_amounts"], r["min_amount"], r["max_amount"]) == (len(own), min(own), max(own))
        for p in (50, 95, 99):
            below, upto = sum(a < r[f"p{p}"] for a in own), sum(a <= r[f"p{p}"] for a in own)
            assert below <= len(own) * (p / 100 + RANK_ERROR) and upto >= len(own) * (p / 100 - RANK_ERROR)


def test_no_amounts_give_no_sketches(spark):
    none = spark.createDataFrame([], "node string, run string, amount bigint")
    assert sketch_quantiles(merge_sketches(amount_sketches(none))).count() == 0
