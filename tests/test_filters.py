import pytest
from conftest import rows
from pyspark.sql import functions as F

from blockledger.functions.columns import normal_path, path_ancestors
from blockledger.operators.filters import drop_ignored
from blockledger.sources.inventory import ignore_list

FILES = ["/logs/app/today.txt", "/logs/application/old.txt", "/logs", "/data/x//y/", "/", None]


@pytest.mark.parametrize("inline", [1_000, 0])
@pytest.mark.parametrize(
    "listed, kept",
    [
        ([], FILES),
        (["/logs/app"], FILES[1:]),  # a sibling that begins alike stays
        (["/logs/app/"], FILES[1:]),
        (["/logs/app/today.txt", "/nowhere"], FILES[1:]),
        (["/logs/app/today.txt/below"], FILES),
        (["/data/x", "/logs"], ["/", None]),
        (["/"], [None]),  # a file without a path lies nowhere
    ],
)
def test_ignored(table, listed, kept, inline):
    ignore = table([(p,) for p in listed], "path string").select(normal_path(F.col("path")).alias("path"))
    files = table([(p,) for p in FILES], "path string")
    assert rows(drop_ignored(files, ignore, inline=inline)) == sorted([(p,) for p in kept], key=repr)


def test_ancestors(table):
    df = table([("/a/b",), ("/",), ("hdfs://nn:8020/x//y/",)], "path string")
    got = [r[0] for r in df.select(path_ancestors(F.col("path"))).collect()]
    assert got == [["/a/b", "/a", "/"], ["/"], ["/x/y", "/x", "/"]]


def test_ignore_file(spark, tmp_path):
    assert ignore_list(spark, str(tmp_path / "absent")).count() == 0
    (tmp_path / "ignore").write_text("  /a/b/ \n# no\nrelative\n/a/b\n/c\n")
    assert rows(ignore_list(spark, str(tmp_path / "ignore"))) == [("/a/b",), ("/c",)]
