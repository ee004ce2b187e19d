"""One session for all tests."""

import os
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
os.environ["PYTHONPATH"] = f"{Path(__file__).resolve().parents[1]}:{os.environ.get('PYTHONPATH', '')}"


@pytest.fixture(scope="session")
def spark():
    from linkloom.session import local_session

    session = local_session(8, app="tests", memory="4g")
    session.conf.set("spark.sql.shuffle.partitions", "8")
    yield session
    session.stop()
