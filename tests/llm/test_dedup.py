"""Near duplicates, repeated substrings and nearest vectors against brute force."""

import random

import numpy as np
from brute import jaccard_components, substring_dedup
from given import frame, odd_rows, sentences  # noqa: F401
from pyspark.sql import functions as F

from blockledger.llm import jaccard, knn, substrings


def copies(sentences, n=40):
    """Exact and near copies, chains whose ends are not alike, and texts of their own."""
    draw = random.Random(3)
    rows, base = [], [sentences(60).split() for _ in range(4)]
    for i in range(n):
        w = list(base[i % 4])
        for _ in range(draw.choice([0, 0, 1, 1, 2, 3])):
            w[draw.randrange(len(w))] = f"new{draw.randrange(99)}"
        rows.append((300 + i, " ".join(w), "en", "s", 1))
    chain = sentences(80).split()
    for i in range(14):
        chain = chain[:]
        chain[(11 * i) % 78] = f"link{i}"
        rows.append((100 + i, " ".join(chain), "en", "s", 1))
    return rows + [(200 + i, sentences(draw.randint(1, 50)), "en", "s", 1) for i in range(30)]


def test_components(frame, odd_rows, sentences, monkeypatch):
    rows = odd_rows + copies(sentences)
    wanted = sorted((repr(r[0]), *x) for r, x in zip(rows, jaccard_components([r[:2] for r in rows]), strict=True))
    for frequent, posting, load, group in ((32, 4096, 500_000, 64), (2, 3, 100, 2)):
        for name, value in zip(("FREQUENT", "POSTING", "LOAD", "GROUP"), (frequent, posting, load, group), strict=True):
            monkeypatch.setattr(jaccard, name, value)
        found = jaccard.near_duplicates(frame(rows).withColumn("node", F.lit(1)).withColumn("_key", F.lit(1)))
        assert sorted((repr(r["doc_id"]), r["n_shingles"], r["component_id"]) for r in found.collect()) == wanted


def test_one_of_each_group_stays(frame, odd_rows, sentences):
    rows = odd_rows + copies(sentences)
    kept = [r["doc_id"] for r in jaccard.drop_near_duplicates(frame(rows)).collect()]
    named = [(r[0], n, c) for r, (n, c) in zip(rows, jaccard_components([r[:2] for r in rows]), strict=True)]
    groups = {c for i, n, c in named if n}
    bare = [i for i, n, c in named if not n]
    alone = [r[0] for r in rows if r[0] == 1][2:]  # the other text under number 1
    wanted = [c for c in groups] + bare + alone
    assert sorted(map(repr, kept)) == sorted(map(repr, wanted))


def test_groups_of_nothing(frame):
    assert jaccard.near_duplicates(frame([])).count() == 0
    assert jaccard.drop_near_duplicates(frame([(1, None, None, None, None), (2, "", None, None, None)])).count() == 2


def test_substrings(frame, odd_rows, sentences, monkeypatch):
    monkeypatch.setattr(substrings, "BLOCK", 700)
    monkeypatch.setattr(substrings, "SORTED", 500)
    draw = random.Random(9)
    shared = [sentences(30) for _ in range(6)]
    rows = [r for r in odd_rows if r[0] not in (6, 7)]
    rows.append((7, "z" * 400, "de", "a", 400))
    for i in range(40):
        cut = draw.randrange(40)
        rows.append((100 + i, f"{sentences(9)} {draw.choice(shared)[cut : cut + draw.randrange(30, 140)]}ü{sentences(9)}", "en", "s", 1))
    rows += [(200, "z" * 90 + "y", "en", "s", 1), (201, "ab" * 60, "en", "s", 1), (202, "ba" * 60, "en", "s", 1)]
    found = substrings.drop_repeats(frame(rows).withColumn("chunk", F.lit(1)))
    got = sorted((repr(r["doc_id"]), bytes(r["kept"]), r["n_removed"], r["n_spans"]) for r in found.collect())
    numbers = [(-(1 << 63) if r[0] is None else r[0], r[1]) for r in rows]
    assert got == sorted((repr(r[0]), *x) for r, x in zip(rows, substring_dedup(numbers), strict=True))
    assert substrings.drop_repeats(frame([])).count() == 0


VECTORS = "vec_id long, embedding array<float>, label int"


def best(rows, queries, k=5):
    out = []
    x = {i: np.floor(256 * np.array(v, float)).astype(np.int64) for i, v in rows}
    for q in queries:
        scores = sorted((-int(x[q] @ v), i) for i, v in x.items() if i != q and len(v) == len(x[q]))[:k]
        out += [(q, n + 1, i, -s) for n, (s, i) in enumerate(scores)]
    return sorted(out)


def test_nearest(spark):
    draw = np.random.default_rng(4)
    centres = draw.normal(size=(6, 8)) * 4
    rows = [(i, (centres[i % 6] + draw.normal(size=8) * 0.3).astype(np.float32).tolist()) for i in range(400)]
    rows += [(1000 + i, rows[0][1]) for i in range(60)] + [(2000 + i, [0.0] * 8) for i in range(20)]
    rows += [(3000, [1.0, 2.0]), (3050, [0.5, 0.25]), (3100, [])]
    odd = [(50, None), (None, rows[1][1]), (4000, [1.0, None] * 4), (4050, [float("nan")] * 8), (4100, [float("inf")] * 8)]
    table = spark.createDataFrame([(i, v, 0) for i, v in [*rows, *odd, rows[3]] if i != 50], VECTORS)
    kept = [r for r in rows if r[0] != 50]
    table = table.unionByName(spark.createDataFrame([(50, None, 0)], VECTORS)).withColumn("score", F.lit(1))
    asked = [i for i, _ in kept if i % 50 == 0]
    for pivots, size in ((16, 2048), (3, 16)):
        found = knn.top_k(table.where("vec_id % 50 = 0"), table, "vec_id", "embedding", pivots=pivots, rows=size)
        assert sorted(tuple(r) for r in found.collect()) == best(kept, asked)


def test_bounds_leave_far_cells_out():
    pivots = knn.Pivots([[100, 0], [-100, 0]])
    near = {"cell": 0, "radius": 5.0, "n": 9, "near": [1.0, 2.0, 3.0]}
    far = {"cell": 1, "radius": 5.0, "n": 9, "near": [1.0, 2.0, 3.0]}
    assert knn.qualified([{"cell": 0, "radius": 5.0}], [near, far], pivots, 2) == [(0, 0)]


def test_nearest_of_an_id_with_many_vectors(spark):
    own = [(0, [1000.0 + i, float(i)], 0) for i in range(10)]
    spread = [(0, [-1000.0 - i, 1.0], 0) for i in range(10)]
    others = [(i, [-10.0, 500.0 + i], 0) for i in range(1, 21)]
    for rows in (own + others, own + spread + others):
        table = spark.createDataFrame(rows, VECTORS)
        x = {(i, tuple(v)): np.floor(256 * np.array(v)).astype(np.int64) for i, v, _ in rows}
        for pivots in (2, 16):
            found = knn.top_k(table.where("vec_id = 0").limit(1), table, "vec_id", "embedding", pivots=pivots).collect()
            q = x[0, (1000.0, 0.0)]
            want = sorted((-int(q @ v), i) for (i, _), v in x.items() if i)[:5]
            assert sorted((-r["score"], r["vec_id"]) for r in found) == want


def test_nearest_of_few(spark):
    none = spark.createDataFrame([], VECTORS)
    assert knn.top_k(none, none, "vec_id", "embedding").count() == 0
    one = spark.createDataFrame([(50, [1.0], 0)], VECTORS)
    assert knn.top_k(one, one, "vec_id", "embedding").count() == 0
    large = spark.createDataFrame([(50, [3e9, 1.0], 0), (1, [2e9, 5.0], 0)], VECTORS)
    rows = knn.top_k(large.where("vec_id = 50"), large, "vec_id", "embedding").collect()
    x = [np.floor(256 * np.array(v, np.float32).astype(float)).astype(np.int64) for v in ([3e9, 1.0], [2e9, 5.0])]
    with np.errstate(over="ignore"):
        assert [r["score"] for r in rows] == [int((x[0] * x[1]).sum())]
