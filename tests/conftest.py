import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    os.environ.setdefault("PRICELENS_DRIVER_MEMORY", "8g")
    from pricelens.session import build_session

    session = build_session("tests", 8, 8)
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()
