import pytest

from quire.session import local_session


@pytest.fixture(scope="session")
def spark():
    return local_session(cores=4, partitions=4, memory="6g", app="quire-tests")
