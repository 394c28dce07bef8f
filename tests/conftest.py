import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[1]
sys.path.insert(0, str(ROOT))
sys.path.insert(0, str(ROOT / "tests"))

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from redactframe.session import local_session

    session = local_session("redactframe-tests", spark__sql__shuffle__partitions="4", spark__driver__memory="4g")
    yield session
    session.stop()


@pytest.fixture
def rows(spark):
    def make(data, schema):
        return spark.createDataFrame(data, schema)

    return make
