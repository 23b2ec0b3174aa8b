"""Every stage of the pipeline against brute force on its own input, and every query against its SQL."""

import duckdb
import numpy as np
import pytest
from brute import DOCS, contamination, jaccard_components, line_dedup, tokenizer
from pyspark.sql import functions as F

import corpus_pipeline
from blockledger.llm.oracle import ORACLE
from blockledger.llm.queries import QUERIES

FOLDER = "/root/testdata/sf0.001"
TABLES = "documents embeddings benchmark"


def by_name(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(columns), sorted((tuple(r[i] for i in order) for r in data), key=repr)


@pytest.fixture(scope="module")
def sql():
    con = duckdb.connect()
    for name in TABLES.split():
        con.execute(f"create view {name} as select * from '{FOLDER}/{name}.parquet'")
    return con


@pytest.mark.parametrize("name", list(ORACLE))
def test_query(spark, sql, name):
    df = QUERIES[name](spark, FOLDER)
    got = by_name(df.columns, [tuple(r) for r in df.collect()])
    cursor = sql.execute(ORACLE[name])
    want = by_name([c[0] for c in cursor.description], cursor.fetchall())
    assert got == want


def test_stages(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    junk = [(9000, None, "en", "s", 0), (9001, "", None, None, None), (9002, "12 34 --", "en", "s", 8)]
    docs = docs.unionByName(spark.createDataFrame(junk, DOCS)).withColumn("extra", F.lit(1)).withColumn("n_hit", F.lit(1))
    items = [tuple(r) for r in spark.read.parquet(f"{FOLDER}/benchmark.parquet").collect()]
    rows = {r["doc_id"]: r for r in docs.select(*corpus_pipeline.COLUMNS).collect()}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, FOLDER)
        got = {r["doc_id"]: r for r in out.collect()}
        before = sorted((i, r["text"]) for i, r in rows.items())
        if name == "bpe":
            library = tokenizer()
            for i, text in before:
                assert np.frombuffer(got[i]["ids"], "<u4").tolist() == library.encode(text, add_special_tokens=False).ids
            assert set(got) == set(rows)
            break
        assert out.columns == corpus_pipeline.COLUMNS
        if name == "language_id":
            assert set(rows) - set(got) == {9000, 9001, 9002}
        elif name == "line_dedup":
            left = {i: t for (i, old), t in zip(before, line_dedup(before), strict=True) if t == old or t.strip()}
            assert {i: r["text"] for i, r in got.items()} == left
            assert all(r["n_chars"] == len(r["text"]) for r in got.values())
        elif name == "jaccard_join":
            assert set(got) == {c for _, c in jaccard_components(before)}
        elif name == "decontamination":
            assert set(got) == {i for i, t in before if not contamination(t, items)[1]}
        rows, docs = got, spark.createDataFrame(list(got.values()), DOCS)


def test_stages_of_nothing(spark):
    docs = spark.createDataFrame([], DOCS)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, FOLDER)
        assert docs.count() == 0
        if "text" not in docs.columns:
            break


def test_near_copies_by_five_words_and_four_fifths(spark):
    words = [f"w{i}" for i in range(60)]
    near = words[:30] + ["other"] + words[31:]  # 51 of 61 shingles of five words, 53 of 61 of four
    far = words[:20] + ["one"] + words[21:40] + ["two"] + words[41:]
    end = words[:54] + [f"x{i}" for i in range(6)]  # 50 of 62 at five words, 51 of 63 at four: 0.806 and 0.81
    rows = [(i, " ".join(w), "en", "s", 1) for i, w in enumerate((words, near, far, end), 1)]
    before = [r[:2] for r in rows]
    wanted = {c for _, c in jaccard_components(before, 5, 80)}
    assert wanted != {c for _, c in jaccard_components(before)}
    out = corpus_pipeline.dedupe_documents(spark, spark.createDataFrame(rows, DOCS), FOLDER)
    assert {r["doc_id"] for r in out.collect()} == wanted


def test_short_texts_of_large_scripts_stay(spark):
    draw = np.random.default_rng(2)
    share = 1 / np.arange(1, 3501)
    text = lambda n: "".join(chr(0x4E00 + c) for c in draw.choice(3500, n, p=share / share.sum()))
    rows = [(i, text(100 if i % 2 else 30), "zh", "s", 1) for i in range(300)]
    rows += [(1000 + i, "plain words of a text with letters", "en", "s", 1) for i in range(20)]
    rows += [(2000, "\u10d0\u10d1\u10d2\u10d3", None, "s", 4), (2001, "12 -- 3", "en", "s", 7), (2002, None, "zh", "s", 0)]
    rows += [(2003, "more plain words", None, "s", 16)]
    out = corpus_pipeline.identify_language(spark, spark.createDataFrame(rows, DOCS), FOLDER)
    got = {r["doc_id"]: r["lang"] for r in out.collect()}
    assert set(got) == {r[0] for r in rows} - {2001, 2002}
    assert (got[2000], got[2003]) == (None, "en")
