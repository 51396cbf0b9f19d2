import pytest

from marquee.runtime import local_session


@pytest.fixture(scope="session")
def spark():
    session = local_session("marquee-tests", "4", 4)
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()
