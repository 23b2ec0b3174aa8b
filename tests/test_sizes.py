"""What a task holds follows settings of its own, not the size of the tables."""

import pytest

from blockledger.session import SCANNED, SHUFFLED, folder_bytes, size_tasks
from blockledger.workload.fixtures import Tables, is_written

ADVISED, FILES, PARTITIONS = "spark.sql.adaptive.advisoryPartitionSizeInBytes", "spark.sql.files.maxPartitionBytes", "spark.sql.shuffle.partitions"


@pytest.fixture
def settings(spark):
    before = {n: spark.conf.get(n) for n in (ADVISED, FILES, PARTITIONS)}
    yield spark.conf
    for name, value in before.items():
        spark.conf.set(name, value)


def test_more_tables_make_more_tasks_not_larger_ones(spark, settings, tmp_path):
    for name, size in (("lineitem", 900 << 20), ("orders", 124 << 20)):
        with open(tmp_path / f"{name}.parquet", "wb") as f:
            f.truncate(size)
    settings.set(ADVISED, "64MB")
    settings.set(FILES, "128MB")
    Tables(spark, str(tmp_path))
    assert int(settings.get(PARTITIONS)) == 2 * (1024 << 20) // SHUFFLED
    assert settings.get(ADVISED) == str(SHUFFLED) and settings.get(FILES) == str(SCANNED)


def test_settings_for_smaller_tasks_stay(spark, settings, tmp_path):
    settings.set(ADVISED, "1m")
    settings.set(FILES, "2m")
    settings.set(PARTITIONS, "7")
    size_tasks(spark, [str(tmp_path / "none"), "/root/testdata/sf0.001/lineitem.parquet"])
    assert [settings.get(n) for n in (ADVISED, FILES, PARTITIONS)] == ["1m", "2m", "7"]
    assert folder_bytes(spark, str(tmp_path / "none")) == 0


def test_addresses_do_not_cross_the_network(spark):
    """Lines of a path are brought together before their replicas are written out; nothing is gathered below that."""
    t = Tables(spark, "/root/testdata/sf0.001")
    plan = t._files(t._placed(t.lines()))._jdf.queryExecution().sparkPlan().toString().splitlines()
    plan = [line for line in plan if "Exchange" in line or "Aggregate" in line or "10.0." in line]
    assert "Exchange" in plan[-1] and sum("Exchange" in line for line in plan) == 1 and any("10.0." in line for line in plan)


def test_blocks_do_not_carry_what_else_lines_have(spark, tmp_path):
    """Without written lines the latest versions are made of the columns they need, with the same rows."""
    import os

    os.symlink("/root/testdata/sf0.001", tmp_path / "given")
    first, second = Tables(spark, "/root/testdata/sf0.001"), Tables(spark, str(tmp_path / "given"))
    first.lines()
    got = second.live_flags()
    assert not is_written(second, "lines") and is_written(first, "lines")
    assert sorted(got.collect()) == sorted(first.live_flags().collect())
