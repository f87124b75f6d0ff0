import pytest

from siltstone import runtime


@pytest.fixture(scope="session")
def spark():
    s = runtime.session(cores=4, shuffle_partitions=4, memory="4g")
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def sf():
    return DATA
