"""One Spark session for all tests."""

from __future__ import annotations

import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from lintarium.session import session

    s = session("tests", cores="8", partitions=4, memory="6g")
    yield s
    s.stop()
