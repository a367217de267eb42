import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from caselens.session import build_session  # noqa: E402

SF = os.environ.get("CASELENS_SF", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark():
    session = build_session("local[4]", 4)
    yield session
    session.stop()


@pytest.fixture(scope="session")
def sf():
    return SF
