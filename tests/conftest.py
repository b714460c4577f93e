import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
sys.path.insert(0, os.path.join(ROOT, "tests"))


@pytest.fixture(scope="session")
def spark():
    from voxmill.session import local_session

    session = local_session(8, "voxmill-tests")
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


RECORDS = "streamID string, dataSetKey string, recordID string, fields map<string,string>, seq long, ts timestamp"


@pytest.fixture(scope="session")
def make_records(spark):
    def make(rows):
        """rows of (stream, dataset, id, fields); seq follows list order."""
        data = [(s, d, i, {k: None if v is None else str(v) for k, v in f.items()}, n, None) for n, (s, d, i, f) in enumerate(rows)]
        return spark.createDataFrame(data, RECORDS)

    return make
