import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

SF001 = "/root/testdata/sf0.001"
SF01 = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def spark():
    from bitextkit.session import get_session
    s = get_session("local[8]", shuffle_partitions=8)
    yield s


@pytest.fixture
def df_of(spark):
    def make(rows, schema):
        return spark.createDataFrame(rows, schema)
    return make
