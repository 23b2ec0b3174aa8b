import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from blockledger.session import local_session  # noqa: E402

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    return local_session(8, partitions=4, name="tests")


@pytest.fixture
def blocks(spark):
    def make(rows):
        return spark.createDataFrame(rows, "pool_id string, block_id bigint, length bigint, gen_stamp bigint")

    return make


@pytest.fixture
def table(spark):
    def make(rows, schema):
        return spark.createDataFrame(rows, schema)

    return make


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)
