import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from sqlprism.session import get_session
    s = get_session("local[4]", shuffle_partitions=8, app_name="sqlprism-tests")
    yield s


@pytest.fixture(scope="session")
def sf_dir():
    return SMALL


def frame(spark, rows, key="datapoint_id"):
    """Datapoints frame from (id, sql) pairs."""
    return spark.createDataFrame([(i, "ds", "train", "db_0", q) for i, q in rows],
                                 f"{key} long, dataset string, split string, db_id string, sql_query string")
