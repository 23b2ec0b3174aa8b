"""Periodic runs against a search over all periods."""

import random

import pytest
from brute import sha
from given import frame, odd_rows  # noqa: F401
from pyspark.sql import functions as F

from blockledger.llm import periods, queries
from blockledger.llm.periods import SuffixTree, runs_of


def by_hand(w, least):
    """Every maximal stretch of each period, but for those that a smaller period has too."""
    n, out = len(w), []
    for q in range(1, n // 2 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and w[j] == w[j + q]:
                j += 1
            if j > i and j + q - i >= max(least, 2 * q):
                if not any(all(w[k] == w[k + r] for k in range(i, j + q - r)) for r in range(1, q)):
                    out.append((i, j + q - i, q))
            i = j + 1
    return sorted(out, key=lambda r: (r[0], r[2]))


def by_hand_text(text, least):
    w = [x for x in "".join(" " if c in "\t\n\v\f\r" else c for c in text or "").split(" ") if x]
    runs = by_hand(w, least)
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    return [tuple(r) for r in runs], " ".join(x for i, x in enumerate(w) if i not in gone)


def test_trees_tell_order_and_agreement():
    draw = random.Random(3)
    for _ in range(60):
        s = [draw.randrange(3) for _ in range(draw.randint(2, 40))] + [-1]
        tree = SuffixTree(s)
        assert [i for _, i in sorted((s[i:], i) for i in range(len(s)))] == sorted(range(len(s)), key=lambda i: tree.rank[i])
        for i in range(len(s)):
            for j in range(i + 1, len(s)):
                k = next(k for k in range(len(s) - j) if s[i + k] != s[j + k])
                assert tree.agree(*(periods.np.array([x]) for x in (i, j)))[0] == k


@pytest.mark.parametrize("least", [2, 4, 12])
def test_runs_of_random_sequences(least):
    draw = random.Random(least)
    for _ in range(400):
        n, letters = draw.randint(0, 60), draw.choice([1, 2, 3])
        w = [draw.randrange(letters) for _ in range(n)]
        if draw.random() < 0.4 and n:
            p = draw.randint(1, n)
            w = [w[i % p] for i in range(n)]
        assert [tuple(r) for r in runs_of(w, least).tolist()] == by_hand(w, least)


def test_runs_of_texts(frame, odd_rows):
    draw = random.Random(9)
    stock = [f"w{i}" for i in range(30)]
    rows = [r for r in odd_rows if r[0] != 6]
    for i in range(80):
        w = [draw.choice(stock) for _ in range(draw.randint(0, 50))]
        for _ in range(draw.randint(0, 3)):
            at, p, n = draw.randint(0, len(w)), draw.randint(1, 15), draw.randint(5, 60)
            piece = [draw.choice(stock) for _ in range(p)]
            w[at:at] = [piece[k % p] for k in range(n)]
        blank = draw.choice([" ", "\n", "  ", "\t\r", " \x0b\x0c"])
        rows.append((100 + i, blank * (i % 3) + blank.join(w) + blank * (i % 2), "en", "s", 1))
    rows.append((300, "ab " * 4000, "en", "s", 1))
    rows.append((301, " ".join(["Straße", "straße", "中文"] * 500), "en", "s", 1))
    docs = frame(rows).withColumn("RUNS", F.lit(7)).withColumn("Collapsed", F.lit(8)).withColumn("start", F.lit(9))
    for least in (6, 12):
        found = periods.collapse(docs, least).collect()
        got = sorted((repr(r["doc_id"]), [tuple(x) for x in r["runs"]], r["collapsed"], r["start"]) for r in found)
        assert got == sorted((repr(r[0]), *by_hand_text(r[1], least), 9) for r in rows)
    assert periods.collapse(frame([])).count() == 0


def test_many_texts_at_once(frame):
    """More than one slice, with runs at the ends of texts that lie side by side."""
    rows = [(i, " ".join([f"x{i % 5}", "y"] * 40) if i % 2 else f"x{(i + 1) % 5} y " * 20 + "word " * 30_000, "en", "s", 1) for i in range(40)]
    found = {r["doc_id"]: ([tuple(x) for x in r["runs"]], r["collapsed"]) for r in periods.collapse(frame(rows).coalesce(1)).collect()}
    for i, text, *_ in rows:
        head = [(0, 80, 2)] if i % 2 else [(0, 40, 2), (40, 30_000, 1)]
        assert found[i] == (head, text.split()[0] + (" y" if i % 2 else " y word"))


def test_planted_tails(frame, odd_rows):
    import zlib

    rows = [(i, f" {i} a  b\tc d e f g h i j k l m n o p q r s t u v w x y z {i}\n", "en", "s", 1) for i in range(400)] + odd_rows
    rows = [r for r in rows if r[0] != 6 or len(r[1]) < 100]
    got = sorted((repr(r["doc_id"]), r["text"] or "") for r in queries.with_tails(frame(rows)).collect())
    want, planted = [], 0
    for key, text, *_ in rows:
        w = [x for x in "".join(" " if c in "\t\n\v\f\r" else c for c in text or "").split(" ") if x]
        n, h = len(w), 1 if key is None else zlib.crc32(str(key).encode())
        if h % 10 == 0 and n:
            a, planted = h // 10 % n, planted + 1
            p = 1 + (n - a) // (3 + h // 10 % 8)
            text = " ".join(w[i if i < a else a + (i - a) % p] for i in range(n))
        want.append((repr(key), text or ""))
    assert got == sorted(want) and planted > 20
    assert sha("") == sha(b"")
