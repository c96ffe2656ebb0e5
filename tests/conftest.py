import os

os.environ.setdefault("TZ", "UTC")

import pytest

from ledgerloom.session import local_session


@pytest.fixture(scope="session")
def spark():
    s = local_session("tests", "4", **{"spark.sql.shuffle.partitions": "4", "spark.driver.memory": "4g"})
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()
