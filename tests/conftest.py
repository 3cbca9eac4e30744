import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from lakebrook.session import session, ship  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    s = session("tests", 4)
    ship(s)
    yield s
    s.stop()
