import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SF_SMALL = "/root/testdata/sf0.001"
SF_ORACLE = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def spark():
    from logspark.session import local_session

    s = local_session(cores=8, app="logspark-tests", shuffle_partitions=8)
    yield s
    s.stop()


@pytest.fixture(scope="session")
def raw_frame(spark):
    """Build flat raw records from python tuples (title, severity, source,
    color, description, body, created_at)."""
    from logspark.schema import RAW_FLAT

    def make(rows):
        full = []
        for r in rows:
            r = tuple(r) + (None,) * (7 - len(r))
            full.append(r)
        return spark.createDataFrame(full, RAW_FLAT)

    return make
