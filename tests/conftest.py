import pytest

from pitrank.session import build_session


@pytest.fixture(scope="session")
def spark():
    session = build_session(4, "pitrank-tests", 4)
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()
