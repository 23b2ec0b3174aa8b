import hashlib
import zlib

import numpy as np
from brute import DOCS, PATH, tokenizer
from given import frame, odd_rows  # noqa: F401
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from blockledger.llm import bpe, tokens
from blockledger.llm.queries import QUERIES
from blockledger.llm.staging import shared_path

LIBRARY = tokenizer()
ANY = st.characters(exclude_categories=["Cs"])


def expected(text):
    return LIBRARY.encode(text or "", add_special_tokens=False).ids


def test_odd_rows_encode_as_the_library_does(frame, odd_rows):
    rows = bpe.encode_decode(frame(odd_rows), PATH).collect()
    got = sorted((repr(r["doc_id"]), np.frombuffer(r["ids"], "<u4").tolist(), r["decoded"].decode()) for r in rows)
    ids = [(repr(r[0]), expected(r[1])) for r in odd_rows]
    assert got == sorted((i, x, LIBRARY.decode(x, skip_special_tokens=False)) for i, x in ids)


@settings(max_examples=300, deadline=None)
@given(st.text(ANY, max_size=60) | st.text("ab'st éß\n", max_size=60) | st.text("etaoinshr", min_size=1, max_size=30))
def test_any_text_encodes_as_the_library_does(text):
    table, encoder = bpe.loaded(PATH)
    ids = np.frombuffer(encoder.encode(text), "<u4").astype(np.int64)
    assert ids.tolist() == expected(text)
    assert encoder.encode(text) == tokens.encoder(PATH).encode(text)
    assert table.decode(ids).decode() == LIBRARY.decode(ids.tolist(), skip_special_tokens=False)


def test_every_character_encodes_as_in_the_library():
    characters = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    texts = [" ".join(f"a{c}b {c}" for c in characters[i : i + 64]) for i in range(0, len(characters), 64)]
    want = [np.array(expected(t), "<u4").tobytes() for t in texts]
    for encode in (bpe.loaded(PATH)[1].encode, tokens.encoder(PATH).encode):
        assert [encode(t) for t in texts] == want


def test_latin_texts_are_looked_up_by_pre_token_alone():
    stock = ["don't", "STRASSE", "größe", "\u0130x", "x2y", "'ll", "a--b"]
    texts = [f"{a}{i}{m}{b}" for i, m in enumerate(",.;\x1c\x85\xa0\n|'") for a in stock for b in stock]
    texts += [" ".join(texts), "one <|endoftext|>two<|startoftext|> <| three", " \t\n", ""]
    encoder = tokens.encoder(PATH)
    encoder.pieces.clear()
    got = [encoder.encode(t) for t in texts]
    assert got == [np.array(expected(t), "<u4").tobytes() for t in texts]
    assert not encoder.pieces
    mixed = "größe, don't — 中文字 naïve <|endoftext|>İ"
    assert encoder.encode(mixed) == np.array(expected(mixed), "<u4").tobytes()
    assert encoder.pieces


def test_a_worker_remembers_few_words_whatever_it_has_read(monkeypatch):
    monkeypatch.setattr(bpe, "_LOADED", {})
    table, encoder = bpe.loaded(PATH)
    words = ["".join(chr(97 + i // 26**k % 26) for k in range(4)) for i in range(260_000)]
    texts = [" ".join(words[i : i + 1_000]) for i in range(0, len(words), 1_000)]
    got = [encoder.encode(t) for t in texts]
    kept = [encoder.words, encoder.shown, encoder.pieces]
    assert sum(len(x) + len(x.older) for x in kept) <= 200_000
    assert len(table.pairs) <= 200_000 and max(len(table.first), len(table.last)) <= 8_000
    assert [np.frombuffer(x, "<u4").tolist() for x in got[::50]] == [expected(t) for t in texts[::50]]


def test_one_doc_id_over_several_parts_keeps_one_order(spark, frame):
    rows = [(7, f"text {i} " * (i % 5 + 1), None, None, None) for i in range(400)]
    rows = [tuple(r[: len(DOCS)]) for r in rows]
    given = frame(rows).repartition(4)
    folder = shared_path(spark, "tokens")
    tokens.write_tokens(given, PATH, folder, end_id=2)
    got = [r["ids"] for r in tokens.read_tokens(spark, folder).orderBy("start").collect()]
    ordered = sorted((r["h"], r["text"]) for r in given.select("text", F.xxhash64("text").alias("h")).collect())
    assert [bytes(x) for x in got] == [np.array([*expected(t), 2], "<u4").tobytes() for _, t in ordered]


def test_the_query_over_a_given_table(spark):
    folder = "/root/testdata/sf0.001"
    docs = sorted((r["doc_id"], r["text"]) for r in spark.read.parquet(f"{folder}/documents.parquet").collect())
    want, start = [], 0
    for doc_id, text in docs:
        ids = [*expected(text), 2]
        want.append((doc_id, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    got = QUERIES["op1_token_files"](spark, folder).select("doc_id", "start", "n_tokens", "ids_crc32").collect()
    assert sorted(tuple(r) for r in got) == want
    sums = QUERIES["op4_bpe"](spark, folder).select("doc_id", "ids_sha256", "decoded_sha256").collect()
    by_hand = []
    for doc_id, text in docs:
        ids = expected(text)
        decoded = LIBRARY.decode(ids, skip_special_tokens=False).encode()
        raw = np.array(ids, "<u4").tobytes()
        by_hand.append((doc_id, hashlib.sha256(raw).hexdigest(), hashlib.sha256(decoded).hexdigest()))
    assert sorted(tuple(r) for r in sums) == by_hand


def test_files_hold_the_corpus_in_order(spark, frame, odd_rows):
    folder = shared_path(spark, "tokens")
    tokens.write_tokens(frame(odd_rows).withColumn("ids", F.lit(1)), PATH, folder, end_id=2)
    rows = sorted(tokens.read_tokens(spark, folder).collect(), key=lambda r: (r["start"]))
    texts = sorted({r[1] for r in odd_rows if r[1] is not None})
    hashed = spark.createDataFrame([(t,) for t in texts] + [(None,)], "text string").select("text", F.xxhash64("text").alias("h"))
    place = {r["text"]: r["h"] for r in hashed.collect()}
    order = sorted(odd_rows, key=lambda r: (r[0] is not None, r[0] or 0, place[r[1]], r[1] is not None, r[1] or ""))
    start = 0
    for row, doc in zip(rows, order, strict=True):
        ids = [*expected(doc[1]), 2]
        assert (row["doc_id"], row["start"], row["n_tokens"]) == (doc[0], start, len(ids))
        assert zlib.crc32(np.array(ids, "<u4").tobytes()) == zlib.crc32(row["ids"])
        start += len(ids)


def test_empty_tables(spark, frame):
    folder = shared_path(spark, "tokens")
    tokens.write_tokens(frame([]), PATH, folder, end_id=2)
    assert tokens.read_tokens(spark, folder).count() == 0
    assert bpe.encode_decode(frame([]), PATH).count() == 0
    assert DOCS.fieldNames()[0] == "doc_id"
