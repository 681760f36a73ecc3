"""One local session for all tests."""

import pytest

from quillog.session import local_session

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    return local_session("4", partitions=4, app="tests")


@pytest.fixture(scope="session")
def sf_dir():
    return SF
