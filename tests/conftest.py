"""One local session for all tests."""

import os
import sys
from pathlib import Path

import pytest

sys.path[:0] = [str(Path(__file__).resolve().parents[1]), str(Path(__file__).resolve().parent)]
os.environ.setdefault("PYSPARK_PYTHON", sys.executable)

from barlattice.session import local_session, prepare  # noqa: E402

DATA = os.environ.get("BARLATTICE_TESTDATA", "/root/testdata")


@pytest.fixture(scope="session")
def spark():
    session = prepare(local_session(4, "tests"))
    yield session
    session.stop()


@pytest.fixture(scope="session")
def tiny():
    return f"{DATA}/sf0.001"


@pytest.fixture(scope="session")
def small():
    return f"{DATA}/sf0.01"
