import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from tidewell.session import local_session

    return local_session("tests", 4, "6g")


@pytest.fixture(scope="session")
def tables():
    """Smallest set of the given tables."""
    path = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
    if not os.path.isdir(path):
        pytest.skip("no test tables here")
    return path


@pytest.fixture(scope="session")
def make_panel(spark):
    """Panel from {series: values}: monthly rows from January 2000."""
    import datetime as dt

    def build(series):
        rows = []
        for name, values in series.items():
            for i, v in enumerate(values):
                rows.append((name, dt.datetime(2000 + i // 12, i % 12 + 1, 1), None if v is None else float(v)))
        return spark.createDataFrame(rows, "series_id string, ts timestamp, y double")

    return build
