import os
import sys

import pytest

HERE = os.path.dirname(os.path.abspath(__file__))
sys.path[:0] = [os.path.dirname(HERE), HERE]

from admitflow.session import clear_run, local_session  # noqa: E402

DATA = "/root/testdata"


@pytest.fixture(scope="session")
def spark():
    session = local_session("tests", 8)
    yield session
    clear_run(session)
    session.stop()


@pytest.fixture(scope="session")
def folder():
    return f"{DATA}/sf0.01"


@pytest.fixture(scope="session")
def small():
    return f"{DATA}/sf0.001"
