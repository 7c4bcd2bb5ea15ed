import os
import sys

import pytest

sys.path[:0] = [os.path.dirname(os.path.dirname(os.path.abspath(__file__))), os.path.dirname(os.path.abspath(__file__))]


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from casebook.session import build_session

    shared = tmp_path_factory.mktemp("shared")
    session = build_session("tests", "4", 4, spark__checkpoint__dir=f"file://{shared}", spark__driver__memory="4g")
    yield session
    session.stop()
