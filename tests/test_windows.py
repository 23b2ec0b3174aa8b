import bisect
import datetime as dt
import random

import numpy as np
import pytest
from conftest import rows
from pyspark.sql import functions as F

import blockledger.operators.joins as joins
from blockledger.operators.aggregates import longest_pending
from blockledger.operators.anchored import _composed, _passed, anchored_windows, coalesce_requests, ttl_dedupe

START = dt.datetime(2024, 1, 1)
EVENT = "pool_id string, block_id bigint, length bigint, gen_stamp bigint, ts timestamp"


def at(seconds):
    return START + dt.timedelta(seconds=seconds)


def brute(events, age, inclusive):
    out, state = [], {}
    for pool, block, length, gen, ts in sorted(events, key=lambda e: (e[4], -e[2], -e[3])):
        key, w = (pool, block), None
        w = state.get(key)
        if w and (ts <= w[0] + age if inclusive else ts < w[0] + age):
            if length > w[1]:
                w[1], w[2] = length, gen
            w[3] += 1
            continue
        w = state[key] = [ts, length, gen, 1]
        out.append((key, w))
    return sorted((p, b, w[1], w[2], w[0], w[0] + age, w[3]) for (p, b), w in out)


def test_anchored_not_session(table):
    events = [("p", 1, n, 1, at(s)) for s, n in [(0, 1), (2, 10), (4, 2), (6, 3)]]
    got = rows(coalesce_requests(table(events, EVENT), "5 seconds").select("length", "n_events"))
    assert got == [(10, 3), (3, 1)]


def test_bounds(table):
    events = table([("p", 1, 1, 1, at(0)), ("p", 1, 1, 1, at(600)), ("p", 1, 1, 1, at(1200))], EVENT)
    assert coalesce_requests(events, "600 seconds").count() == 2
    assert [r.n_ignored for r in ttl_dedupe(events, "10 minutes").collect()] == [0, 0, 0]


def hot_events(seed):
    rnd = random.Random(seed)
    hot = [("p", 1, rnd.randrange(50), rnd.randrange(3), at(rnd.randrange(4000) / 4)) for _ in range(1500)]
    even = [("p", 2, 1, 1, at(s * 2.5)) for s in range(400)]  # periodic: chains never merge
    rest = [("q", rnd.randrange(300), rnd.randrange(9), 1, at(rnd.randrange(1000))) for _ in range(900)]
    return hot + even + rest


@pytest.mark.parametrize("inclusive", [True, False])
@pytest.mark.parametrize("span", [1, 3])
def test_hot_blocks(table, inclusive, span):
    events = hot_events(span)
    got = anchored_windows(table(events, EVENT), "20 seconds", inclusive=inclusive, limit=100, span=span)
    want = brute(events, dt.timedelta(seconds=20), inclusive)
    assert sorted(tuple(r) for r in got.collect()) == want


@pytest.mark.parametrize("inclusive", [True, False])
@pytest.mark.parametrize("fan", [2, 5])
def test_pieces_are_chained_level_by_level(table, inclusive, fan):
    events = hot_events(fan) + [("p", 3, 1, 1, at(-900 + s * 7)) for s in range(300)]  # also before its pieces' zero
    events += [(None, 1, 1, 1, at(s * 3)) for s in range(300)]
    got = anchored_windows(table(events, EVENT), "20 seconds", inclusive=inclusive, limit=100, span=1, fan=fan)
    want = brute([("" if e[0] is None else e[0], *e[1:]) for e in events], dt.timedelta(seconds=20), inclusive)
    assert sorted(("" if r[0] is None else r[0], *r[1:]) for r in got.collect()) == want


@pytest.mark.parametrize("side", ["left", "right"])
def test_a_composed_passage_is_one_after_the_other(side):
    rnd = random.Random(1)
    for _ in range(300):
        points = sorted(rnd.sample(range(400), rnd.randint(2, 30)))
        cut = rnd.randint(1, len(points) - 1)
        parts = []
        for part in (points[:cut], points[cut:]):
            leave = []
            for p in part:
                while (i := int(np.searchsorted(part, p + 40, side=side))) < len(part):
                    p = part[i]
                leave.append(p + 40)
            parts.append((np.array(part), np.array(leave)))
        upto, leave = _composed(*parts, points[0] + 40, side)
        for busy in range(points[0] - 5, points[0] + 41):
            want = _passed(*parts[1], _passed(*parts[0], np.int64(busy), side), side)
            assert _passed(upto, leave, np.int64(busy), side) == want


def test_a_block_of_a_million_instants(spark):
    n, age = 1_000_000, 20_000_000
    micros = F.col("id") * 1_000_000 + F.pmod(F.xxhash64("id"), F.lit(1_000_000))
    block = [F.lit("p").alias("pool_id"), F.lit(1).cast("long").alias("block_id"), F.col("id").alias("length")]
    events = spark.range(n).select(*block, F.lit(1).cast("long").alias("gen_stamp"), F.timestamp_micros(micros).alias("ts"))
    got = anchored_windows(events, "20 seconds").select(F.unix_micros("opened_ts"), "length", "n_events").collect()
    ts = [r[0] for r in spark.range(n).select(micros).collect()]
    want, i = [], 0
    while i < n:
        end = bisect.bisect_right(ts, ts[i] + age, i)
        want.append((ts[i], end - 1, end - i))
        i = end
    assert sorted(tuple(r) for r in got) == want


def test_many_hot_keys_take_the_salted_way(table, monkeypatch):
    monkeypatch.setattr(joins, "BROADCAST_ROWS", 0)
    events = hot_events(9)
    got = anchored_windows(table(events, EVENT), "60 seconds", limit=100)
    assert sorted(tuple(r) for r in got.collect()) == brute(events, dt.timedelta(seconds=60), True)


def test_longest_pending(table):
    pending = table(
        [("p", 1, 1, 1, at(0), False), ("p", 1, 10, 1, at(3), False), ("p", 1, 10, 1, at(2), True), ("p", 2, 1, 1, at(0), False)],
        "pool_id string, block_id bigint, length bigint, gen_stamp bigint, due_ts timestamp, force boolean",
    )
    got = rows(longest_pending(pending).select("block_id", "length", "due_ts", "force", "n_pending"))
    assert got == [(1, 10, at(2), True, 3), (2, 1, at(0), False, 1)]
