import os
import sys

import duckdb
import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from check import TABLES  # noqa: E402
from trackloom.session import local_session  # noqa: E402

DATA = os.environ.get("TRACKLOOM_TESTDATA", "/root/testdata")


@pytest.fixture(scope="session")
def spark():
    session = local_session("8", 4, "trackloom-tests")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def sf():
    return f"{DATA}/sf0.001"


@pytest.fixture(scope="session")
def duck(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con
