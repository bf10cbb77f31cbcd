import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from tallyspark.runtime import build_session, drop_scratch  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    s = build_session("local[4]", 4, "tests")
    yield s
    drop_scratch(s)
    s.stop()
