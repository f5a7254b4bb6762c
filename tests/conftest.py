import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from symptomlake.session import build_local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = build_local_session("tests", spark__sql__shuffle__partitions="4")
    yield session
    session.stop()
