from __future__ import annotations

import pytest

from rollbook.session import build_session


@pytest.fixture(scope="session")
def spark():
    session = build_session("tests", cores=8)
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()
