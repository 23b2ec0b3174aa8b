"""Language, toxicity and language-model scores."""

import math
import random
import zlib
from collections import Counter

import numpy as np
from brute import words
from given import frame, odd_rows  # noqa: F401
from pyspark.sql import functions as F

from blockledger.llm import langid, lm, toxicity

SYLLABLES = {"xx": "ba be bi bo bu da de", "yy": "kra kre kri stro stru", "zz": "åsa øre æle yfi nuo"}


def spoken(lang, n, draw):
    parts = SYLLABLES[lang].split()
    return " ".join("".join(draw.choices(parts, k=draw.randint(1, 3))) for _ in range(n))


def test_profiles_against_brute_force(frame, odd_rows):
    draw = random.Random(1)
    rows = odd_rows + [(100 + i, spoken(g := draw.choice(list(SYLLABLES)), draw.randint(3, 60), draw), g, "s", 1) for i in range(90)]
    docs = frame(rows).withColumn("score", F.lit("clash")).withColumn("gram", F.lit(1))
    train = docs.where(langid.fold("doc_id", 5) != 0)
    found = langid.predict(docs, langid.train(train, size=40), size=40)

    def grams(text):
        text = " ".join("".join(c if c.isalpha() else " " for c in text.lower()).split())
        padded = f" {text} "
        return Counter(g for n in (1, 2, 3) for g in (padded[i : i + n] for i in range(len(padded) - n + 1)) if g != " ")

    def top(count):
        number = lambda g: sum(ord(c) << 21 * i for i, c in enumerate(reversed(g)))
        return sorted(count, key=lambda g: (-count[g], number(g)))[:40]

    def learnt(i):
        return zlib.crc32(str(i).encode() if i is not None else b"") % 5 != 0

    total = {}
    for i, text, lang, *_ in rows:
        if learnt(i) and text is not None and lang is not None:
            total.setdefault(lang, Counter()).update(grams(text) if any(map(str.isalpha, text)) else ())
    profile = {g: {x: n for n, x in enumerate(top(c))} for g, c in total.items()}

    def judged(text):
        own = top(grams(text)) if text and any(map(str.isalpha, text)) else []
        if not own:
            return "und", 0.0
        off = {g: sum(abs(n - p[x]) if x in p else 40 for n, x in enumerate(own)) for g, p in profile.items() if p}
        best = min(sorted(off), key=off.get)
        return best, 1 - off[best] / (40 * len(own))

    got = sorted((repr(r["doc_id"]), r["lang_pred"], round(r["score"], 9)) for r in found.collect())
    assert got == sorted((repr(r[0]), judged(r[1])[0], round(judged(r[1])[1], 9)) for r in rows)
    held = found.where((langid.fold("doc_id", 5) == 0) & F.col("lang").isin(*SYLLABLES) & (F.col("doc_id") >= 100))
    assert held.count() > 8 and held.where("lang <> lang_pred").count() == 0


def test_no_languages(frame, odd_rows):
    none = langid.train(frame([]))
    assert none.count() == 0
    assert {r["lang_pred"] for r in langid.predict(frame(odd_rows), none).collect()} == {"und"}
    assert langid.predict(frame([]), none).count() == 0


def toxic_rows(n=600):
    draw = random.Random(2)
    rows, labels = [], []
    for i in range(n):
        parts = [spoken("xx", 6, draw).capitalize() for _ in range(draw.randint(2, 8))]
        bad = i % 6 == 0
        if bad:
            at = draw.randrange(len(parts))
            parts[at] = f"{spoken('xx', 2, draw)} {draw.choice(['grumpot', 'snarkle', 'blighter'])} {spoken('xx', 2, draw)}"
        rows.append((i, ". ".join(parts) + ".", "en", "s", 1))
        labels.append((i, 1, int(bad)))
    return rows, labels


def test_toxic_documents_and_their_sentences(spark, frame, odd_rows):
    rows, labels = toxic_rows()
    docs = frame(rows + odd_rows[1:]).withColumn("predicted", F.lit("clash"))
    known = spark.createDataFrame(labels + [(None, 1, 1), (3, 1, None), (0, 1, 0)], "doc_id long, quality int, toxic int")
    model = toxicity.train(docs, known.where(langid.fold("doc_id", 3) != 1), most=400, steps=60)
    found = toxicity.predict(docs, model).where("doc_id >= 12 or doc_id is null").collect()
    for r in found:
        if r["doc_id"] is None or zlib.crc32(str(r["doc_id"]).encode()) % 3 != 1:
            continue
        assert r["predicted"] == (r["doc_id"] % 6 == 0) == (r["score"] >= 0.7)
        if r["predicted"]:
            worst = max(r["offending"], key=lambda s: s["score"])
            told = r["text"].encode()[worst["start"] : worst["stop"]].decode()
            assert any(w in told for w in ("grumpot", "snarkle", "blighter"))
    empty = toxicity.predict(frame([(1, None, None, None, None), (2, "", "", "", 0)]), model).collect()
    assert [r["score"] for r in empty] == [0.0, 0.0]


def test_toxicity_against_plain_python(spark, frame):
    """The slope against differences of the loss, document by document; scores against the noisy-or of their sentences."""
    draw = random.Random(6)
    rows = []
    for i in range(40):
        n = draw.randint(0, 5)
        marks = sorted((draw.randrange(n), draw.randrange(4)) for _ in range(draw.randint(1, 9))) if n else []
        rows.append((i % 3 == 0, draw.randint(0, 3), [f for _, f in marks], [s for s, _ in marks]))
    clean, toxic = sum(not r[0] for r in rows), sum(r[0] for r in rows)
    weights, bias = [0.7, -0.4, 1.3, 0.2], -1.1

    def loss(weights, bias):
        total = 0.0
        for label, bare, features, sentences in rows:
            z = {s: bias for s in sentences}
            for f, s in zip(features, sentences, strict=True):
                z[s] += weights[f]
            clear = math.prod(1 - 1 / (1 + math.exp(-x)) for x in [*z.values(), *[bias] * bare])
            if label and clear < 1:
                total -= math.log(1 - clear) / toxic / 2
            elif not label:
                total -= math.log(clear) / clean / 2
        return total

    schema = "toxic int, bare long, features array<long>, sentences array<long>"
    bags = spark.createDataFrame([(int(r[0]), *r[1:]) for r in rows], schema).repartition(3)
    got = toxicity.gradient(bags, np.array(weights), bias, clean, toxic)
    h = 1e-5
    for i in range(5):
        up, down = [*weights, bias], [*weights, bias]
        up[i], down[i] = up[i] + h, down[i] - h
        want = (loss(up[:-1], up[-1]) - loss(down[:-1], down[-1])) / (2 * h)
        assert math.isclose(got[i], want, rel_tol=1e-4, abs_tol=1e-7)

    texts, labels = toxic_rows(240)
    known = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    model = toxicity.train(frame(texts), known, most=240, steps=10)
    for r in toxicity.predict(frame(texts), model, offends=0.0).collect():
        assert math.isclose(r["score"], 1 - math.prod(1 - s["score"] for s in r["offending"]), abs_tol=1e-9)


def test_nothing_to_learn_toxicity_from(spark, frame, odd_rows):
    none = spark.createDataFrame([], "doc_id long, toxic int")
    model = toxicity.train(frame(odd_rows), none)
    assert {r["predicted"] for r in toxicity.predict(frame(odd_rows), model).collect()} == {0}
    assert toxicity.predict(frame([]), model).count() == 0


def test_scores_against_brute_force(spark, frame, odd_rows):
    draw = random.Random(8)
    rows = [r for r in odd_rows if r[0] != 6] + [(100 + i, spoken(draw.choice(list(SYLLABLES)), 40, draw), "en", "s", 1) for i in range(120)]
    docs = frame(rows).withColumn("chunk", F.lit(0)).withColumn("part", F.lit(0))
    found = lm.score(docs, held_share=4).collect()
    folds = spark.createDataFrame([(r[0],) for r in rows], "doc_id long").select(
        "doc_id", (F.pmod(F.xxhash64("doc_id", F.lit("part")), F.lit(4)) == 0).alias("x")
    )
    part = {r["doc_id"]: r["x"] for r in folds.collect()}
    tokens = {}
    out = lambda i: zlib.crc32(b"" if i is None else str(i).encode()) % 7 == 2
    sums = {}
    for name, keep in (("all", lambda i: not out(i)), ("kept", lambda i: not out(i) and not part[i])):
        one, two, border = Counter(), Counter(), 0
        for i, text, *_ in rows:
            if keep(i):
                t = [*words(text, r"[^\x20\x09-\x0D]+"), None]
                one.update(t)
                two.update(zip(["<"] + t[:-1], t, strict=True))
                border += 1
        sums[name] = one, two, Counter({**one, "<": border})
    one, two, before = sums["kept"]
    n, v = sum(one.values()), len(one)
    events = {}
    for i, text, *_ in rows:
        if not out(i) and part[i]:
            t = [*words(text, r"[^\x20\x09-\x0D]+"), None]
            for c, w in zip(["<"] + t[:-1], t, strict=True):
                if before[c]:
                    events.setdefault(int(math.log2(before[c])), []).append((two[c, w] / before[c], (one[w] + 1) / (n + v + 1)))
    weight, last = {}, 0.0
    for k in range(24):
        if k in events:
            w = 0.5
            for _ in range(100):
                w = np.mean([w * a / (w * a + (1 - w) * b) for a, b in events[k]])
                w = min(max(w, 1e-6), 1 - 1e-6)
            last = w
        weight[k] = last
    one, two, before = sums["all"]
    n, v = sum(one.values()), len(one)
    wanted = {}
    for i, text, *_ in rows:
        t = [*words(text, r"[^\x20\x09-\x0D]+"), None]
        base = [(one[w] + 1) / (n + v + 1) for w in t]
        mix = []
        for c, w, b in zip(["<"] + t[:-1], t, base, strict=True):
            k = weight[int(math.log2(before[c]))] if before[c] else 0.0
            mix.append(k * two[c, w] / max(before[c], 1) + (1 - k) * b)
        wanted.setdefault(repr(i), []).append(
            (out(i), len(t), sum(one[w] > 0 for w in t), n, sum(map(math.log10, base)), sum(map(math.log10, mix)))
        )
    for r in found:
        values = tuple(r)[1:]
        close = [x for x in wanted[repr(r["doc_id"])] if x[:4] == values[:4] and abs(x[4] - values[4]) < 1e-6]
        assert any(abs(x[5] - values[5]) < 0.01 * abs(x[5]) for x in close), (r, wanted[repr(r["doc_id"])])
    assert len(found) == len(rows)


def test_scores_without_texts(frame):
    assert lm.score(frame([])).count() == 0
    held = next(i for i in range(99) if zlib.crc32(str(i).encode()) % 7 == 2)
    row = lm.score(frame([(held, "a b", None, None, None)])).first()
    assert row["held_out"] and row["n_tokens"] == 3 and row["train_tokens"] == 0 and row["base_score"] == 0.0
    assert len(words("a b")) == 2


def test_hashes_and_counts_are_packed():
    """Sorted hashes cross the network in the bytes of their steps, counts in as few as hold them; nothing is lost."""
    rng = np.random.default_rng(5)
    keys = np.unique(rng.integers(0, 1 << 64, 200_000, np.uint64))
    assert (lm.from_gaps(lm.gaps(keys)) == keys).all()
    ends = lm.edges(keys, 40)
    assert sum(len(lm.gaps(keys[i:k])) for i, k in zip(ends, ends[1:])) < 7.1 * len(keys)
    for some in (keys[:1], np.array([0, (1 << 64) - 1], np.uint64)):
        assert (lm.from_gaps(lm.gaps(some)) == some).all()
    for most in (1, 2, 300, 1 << 33):
        first = rng.integers(0, most, 1000)
        counts = np.stack([first, rng.integers(0, first + 1)], axis=1)
        assert (lm.wide(lm.narrow(counts)) == counts).all()
    assert len(lm.narrow(np.ones((1000, 2), np.int64))) < 1100


def test_texts_are_hashed_a_stretch_at_a_time(monkeypatch):
    import pyarrow as pa

    texts = ["a b", None, "", " c\n", "d" * 50, "e é", "", "f"]
    table = pa.table({"text": pa.array(texts, pa.string())})
    whole = lm.words_of(table)
    for size in (1, 2, 7, 60):
        monkeypatch.setattr(lm, "READ", size)
        assert all((x == y).all() for x, y in zip(lm.words_of(table), whole, strict=True))
    assert len(lm.words_of(table.slice(0, 0))[0]) == 0 and list(whole[1]) == [0, 2, 2, 2, 3, 4, 6, 6, 7]


def test_shuffle_files_of_a_staged_table_go_at_once(spark):
    """What is staged between two shuffles need not wait for the driver's garbage: its files count against the disk."""
    import gc
    import time

    from blockledger.llm.staging import FILE_CLEANUP, staged

    blocks = lambda: spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles().size()
    rows = spark.range(0, 5000, 1, 4).groupBy((F.col("id") % 99).alias("k")).count()
    gc.disable()
    try:
        before = blocks()
        kept = staged(rows, "given", drop_shuffles=True)
        for _ in range(50):
            if blocks() <= before:
                break
            time.sleep(0.1)
        assert blocks() <= before and kept.count() == 99
    finally:
        gc.enable()
    assert spark.conf.get(FILE_CLEANUP, "false") == "false"
