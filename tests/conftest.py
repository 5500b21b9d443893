import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from tiermem.session import local_session

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    return local_session(4, memory="4g", **{"spark.sql.shuffle.partitions": "4"})


@pytest.fixture(scope="session")
def views(spark):
    from tiermem.sources.views import MemoryViews

    return MemoryViews(spark, SMALL)
