import pytest

from lexloom.session import local_session


@pytest.fixture(scope="session")
def spark():
    session = local_session(4, "4g", spark__sql__shuffle__partitions="4")
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()
