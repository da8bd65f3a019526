import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from fundlens.session import close_run, local_session, ship_package

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark():
    session = local_session("4", "tests", 4)
    session.sparkContext.setLogLevel("ERROR")
    ship_package(session)
    yield session
    close_run(session)
    session.stop()


@pytest.fixture(scope="session")
def sf():
    return SF
