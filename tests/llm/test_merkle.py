"""The manifest and its proofs against trees built in one piece."""

import random
import zlib

import pytest
from brute import sha
from given import frame, odd_rows  # noqa: F401
from pyspark.sql import functions as F

from blockledger.llm import merkle
from blockledger.llm.staging import shared_path


def field(x):
    return "-" if x is None else f"{len(str(x).encode())}:{x}"


def leaf(row, text):
    key, _, lang, source, n = row
    return sha("".join(map(field, (key, source, lang, n, text))))


def tree(leaves, arity):
    """The top and, for each leaf, what stands before and after it level by level."""
    ways, level, owner = [[] for _ in leaves], list(leaves), list(range(len(leaves)))
    while len(level) > 1:
        for i, at in enumerate(owner):
            run, k = level[at // arity * arity : at // arity * arity + arity], at % arity
            ways[i].append(("".join(run[:k]), "".join(run[k + 1 :])))
            owner[i] = at // arity
        level = [sha("".join(level[i : i + arity])) for i in range(0, len(level), arity)]
    return level[0], ways


def by_hand(rows, tampered, arity=8):
    groups = {}
    for row in rows:
        groups.setdefault(row[2], []).append((row[0] is not None, row[0] or 0, leaf(row, row[1]), leaf(row, tampered(row)), row[0]))
    names = sorted(groups, key=lambda x: (x is not None, (x or "").encode()))
    tops, ways = [], {}
    for name in names:
        groups[name].sort(key=lambda x: x[:4])
        top, ways[name] = tree([x[2] for x in groups[name]], arity)
        tops.append(top)
    root, above = tree(tops, arity)
    out = []
    for g, name in enumerate(names):
        for (*_, own, claim, key), way in zip(groups[name], ways[name], strict=True):
            path, x = way + above[g], claim
            for a, b in path:
                x = sha(a + x + b)
            out.append((repr(key), own, tops[g], root, sha("".join(a + b for a, b in path)), x, x == root))
    return sorted(out)


def checked(docs, arity=8):
    claim = F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0, merkle.leaf_digest(text=F.lower("text"))).otherwise(merkle.leaf_digest())
    found = merkle.verify(docs, claim, arity=arity)
    rows = found.select("id", "leaf", "subroot", "root", merkle.proof_digest(), "folded_root", "verified").collect()
    return sorted((repr(r[0]), *r[1:]) for r in rows)


def tampered(row):
    hit = row[0] is not None and zlib.crc32(str(row[0]).encode()) % 3 == 0 and row[1] is not None
    return row[1].lower() if hit else row[1]


@pytest.mark.parametrize("arity", [2, 8])
def test_proofs_of_odd_rows(frame, odd_rows, arity):
    draw = random.Random(arity)
    rows = list(odd_rows)
    for i in range(150):
        lang = draw.choice(["en"] * 12 + ["de", "fr", "Zz", "é", "", None, "xx"])
        rows.append((draw.randint(10, 90), draw.choice(["Abc", "abc", None, "x Y z" * i, ""]), lang, draw.choice(["a", None]), draw.choice([1, None])))
    rows.append((1, "a lone leaf", "only", "s", 1))
    docs = frame(rows).withColumns({name: F.lit(1) for name in ("leaf", "rank", "N", "pos", "claim", "copies", "Group", "path")})
    assert checked(docs, arity) == by_hand(rows, tampered, arity)


def test_many_languages_and_one(frame):
    many = [(i, f"Text {i}", f"l{i % 70}" if i < 200 else "hot", None, i) for i in range(800)]
    assert checked(frame(many)) == by_hand(many, tampered)
    one = [(5, "Alone", "en", "s", 1)]
    assert checked(frame(one)) == by_hand(one, tampered)
    assert checked(frame([])) == []


def test_one_row_many_times(frame, monkeypatch):
    """A third of all rows are one row; copies are written in blocks."""
    monkeypatch.setattr("blockledger.llm.staging.COPIES", 16)
    rows = [(7, "Same", "en", "s", 1)] * 150 + [(i, f"t{i}", "en", "s", 1) for i in range(300)]
    assert checked(frame(rows)) == by_hand(rows, tampered)


def test_some_requests(frame, spark):
    rows = [(i, f"Text {i}", f"l{i % 3}", None, i) for i in range(400)] + [(1, "x", "lone", None, 1)]
    manifest = merkle.write_manifest(frame(rows), shared_path(spark, "manifest"), arity=4)
    asked = manifest.leaves().where("id % 37 = 1")
    found = {(r["group"], r["id"], r["leaf"]): [tuple(x) for x in r["path"]] for r in merkle.prove(manifest, asked).collect()}
    whole = {(r["group"], r["id"], r["leaf"]): [tuple(x) for x in r["path"]] for r in merkle.prove(manifest).collect()}
    assert len(whole) == 401 and len(found) == asked.count() and all(whole[k] == v for k, v in found.items())
    assert merkle.prove(manifest, asked.limit(0)).count() == 0


def test_nodes_are_records_of_digests(frame, spark):
    rows = [(i, f"Text {i % 40}", "en", None, 1) for i in range(100)]
    manifest = merkle.write_manifest(frame(rows), shared_path(spark, "manifest"))
    for level in range(1, manifest.levels + 1):
        for digest, children in manifest.nodes("leaves", level).collect():
            assert digest == sha("".join(children)) and len(children) <= 8
