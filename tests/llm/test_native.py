"""Line dedup and decontamination, which use DataFrame functions alone."""

from brute import contamination, line_dedup, sha
from given import frame, odd_rows, sentences  # noqa: F401
from pyspark.sql import functions as F

from blockledger.llm import decontaminate, lines

ITEMS = "item_id long, text string"
CLASH = ["runs", "_runs", "N_WORDS", "n_hit", "at", "print", "words", "window", "w"]


def with_clashes(df):
    for name in CLASH:
        df = df.withColumn(name, F.lit(7))
    return df


def test_lines_as_by_hand(frame):
    rows = [
        (1, "a\nb\nc\nd", "en", "s", 1),
        (2, "x\na\nb\nc\ny", "en", "s", 1),  # a run of three within
        (3, "a\nc\nb\na", "en", "s", 1),  # single lines only
        (4, "\n\n\n\nq", "en", "s", 1),  # empty lines are no run
        (5, "r\nr\nr\nr", "en", "s", 1),  # repeats itself
        (6, "b\nc\nc\nd\nz\nx\na", "en", "s", 1),
        (7, None, "en", "s", 1),
        (8, "", "en", "s", 1),
    ]
    for window in (2, 3):
        got = {r["doc_id"]: r["text"] for r in lines.drop_repeated_lines(with_clashes(frame(rows)), window).collect()}
        assert [got[r[0]] for r in rows] == line_dedup([r[:2] for r in rows], window)


def test_long_runs_and_hot_lines(frame, sentences):
    block = [sentences(5) for _ in range(40)]
    rows = []
    for i in range(120):
        own = [sentences(4) for _ in range(6)]
        at = i % 5
        text = own[:at] + (block[i % 7 : i % 7 + 9] if i % 3 == 0 else ["the same line", own[0]]) + own[at:]
        rows.append((i, "\n".join(text), "en", "s", 1))
    for window in (1, 2, 4):
        got = {r["doc_id"]: r["text"] for r in lines.drop_repeated_lines(frame(rows), window).collect()}
        assert [got[r[0]] for r in rows] == line_dedup([r[:2] for r in rows], window)


def test_lines_of_odd_rows(frame, odd_rows):
    got = lines.drop_repeated_lines(with_clashes(frame(odd_rows))).collect()
    assert len(got) == len(odd_rows) and {"RUNS", "runs"} & set(got[0].asDict())
    same = [r["text"] for r in got if r["doc_id"] == 1 and r["text"].startswith("Plain")]
    assert len(same) == 2 and same[0] == odd_rows[0][1]  # one document, given twice
    assert {r["text"] for r in got if r["doc_id"] == 2} == {None}
    assert lines.drop_repeated_lines(frame([])).count() == 0


def test_contamination_as_by_hand(frame, spark, odd_rows, sentences):
    items = [
        (1, sentences(30)),
        (2, sentences(12)),
        (3, "two words"),
        (4, "single"),
        (5, sentences(9)),
        (6, None),
        (7, " ,; "),
        (None, sentences(11)),
        (2, "given twice under one number, with enough words to make more than one window of ten"),
        (8, sentences(30)),
    ]
    items.append((9, items[0][1]))
    rows = [r for r in odd_rows if r[0] != 6]
    for i, (_, text) in enumerate(items):
        w = (text or "").split()
        rows.append((100 + i, f"{sentences(8)} {(text or '').upper()}, {sentences(3)} {text}", "en", "s", 1))
        rows.append((200 + i, f"{sentences(5)} {' '.join(w[:9])} {sentences(4)} {' '.join(w[3:14])}", "en", "s", 1))
    rows.append((300, "it is a single two  words thing", "en", "s", 1))
    docs = with_clashes(frame(rows))
    found = decontaminate.decontaminate(docs, spark.createDataFrame(items, ITEMS))
    got = sorted((repr(r["doc_id"]), r["n_words"], r["n_hit"], r["item_ids"]) for r in found.collect())
    assert got == sorted((repr(r[0]), *contamination(r[1], items)) for r in rows)
    assert found.where("contaminated <> (n_hit > 0) or n_items <> size(item_ids)").count() == 0


def test_contamination_of_nothing(frame, spark, odd_rows):
    none = spark.createDataFrame([], ITEMS)
    found = decontaminate.decontaminate(frame(odd_rows), none)
    assert found.count() == len(odd_rows) and found.where("contaminated").count() == 0
    some = spark.createDataFrame([(1, "a b c")], ITEMS)
    assert decontaminate.decontaminate(frame([]), some).count() == 0
    assert sha("") == "e3b0c44298fc1c149afbf4c8996fb92427ae41e4649b934ca495991b7852b855"


def test_no_python_on_the_main_path(frame, spark, odd_rows):
    some = spark.createDataFrame([(1, "plain words here and there")], ITEMS)
    for df in (lines.drop_repeated_lines(frame(odd_rows)), decontaminate.decontaminate(frame(odd_rows), some)):
        assert "Python" not in df._jdf.queryExecution().toString() and "Arrow" not in df._jdf.queryExecution().toString()


def test_long_lines_are_runs_of_their_own(frame):
    long, other = " ".join(f"w{i}" for i in range(8)), "\t".join(f"v{i}" for i in range(9))
    short = "only seven words are in this one"
    texts = [long, f"a\n{long}\nb", f"{short}\nc", f"{short}\n{other}", f"x\ny\n{other}\nz\n{long}\n{long}", f"x\ny\n{long}\ny\nz", None, ""]
    rows = [(i, t, "en", "s", 1) for i, t in enumerate(texts)]
    found = lines.drop_repeated_lines(frame(rows), long_words=8).collect()
    got = {r["doc_id"]: (r["text"], r["n_removed"], r["n_runs"]) for r in found}
    assert got == {
        0: (long, 0, 0),
        1: ("a\nb", 1, 1),
        2: (f"{short}\nc", 0, 0),
        3: (f"{short}\n{other}", 0, 0),
        4: ("x\ny\nz", 3, 2),
        5: ("y\nz", 3, 1),
        6: (None, 0, 0),
        7: ("", 0, 0),
    }


def test_hot_keys_of_lines_are_joined_whole(spark):
    """Keys with more than one in a thousand of all rows and others: the same rows as a plain join."""
    rows = spark.range(30_000).select(F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id") % 7_000).alias("print"), "id")
    found = rows.groupBy("print").agg(F.min("id").alias("first"), F.count("*").alias("n")).where("n > 1")
    for how in ("inner", "left_semi"):
        got = lines.spread_join(rows, found, ["print"], how)
        want = rows.join(found.drop("n"), ["print"], how)
        assert got.columns == want.columns and got.count() == want.count()
        assert got.exceptAll(want).isEmpty()
    assert 0 < found.where(F.col("n") * lines.HOT > 30_000).count() < found.count()
    assert lines.spread_join(rows.limit(0), found, ["print"], "inner").isEmpty()
