"""One small session for all tests."""

import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from quadloom.runtime import drop_scratch, local_session  # noqa: E402

DATA = os.environ.get("QUADLOOM_TEST_DATA", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark():
    session = local_session("tests", cpus=4, shuffle=4)
    session.sparkContext.setLogLevel("ERROR")
    yield session
    drop_scratch()
    session.stop()


@pytest.fixture(scope="session")
def data():
    if not os.path.isdir(DATA):
        pytest.skip("no test tables")
    return DATA
