from __future__ import annotations

import os
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    os.environ.setdefault("PYSPARK_SUBMIT_ARGS", "--driver-memory 4g pyspark-shell")
    from tallyforge.session import session

    work = tmp_path_factory.mktemp("spark")
    s = session("tests", spark__master="local[4]", spark__sql__shuffle__partitions="4", spark__ui__enabled="false", spark__ui__showConsoleProgress="false", spark__checkpoint__dir=f"{work}/shared", spark__sql__warehouse__dir=f"{work}/warehouse")
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


DATA = Path(os.environ.get("TEST_DATA", "/root/testdata/sf0.001"))


@pytest.fixture(scope="session")
def data():
    if not DATA.is_dir():
        pytest.skip("no test tables")
    return str(DATA)
