import pytest

from graphloom.session import local_session


@pytest.fixture(scope="session")
def spark():
    session = local_session(cpus=8, shuffle_partitions=8)
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()
