from __future__ import annotations

import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[1]
for folder in (ROOT, ROOT / "tests"):
    if str(folder) not in sys.path:
        sys.path.insert(0, str(folder))

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from fleetkpi.session import local_session

    session = local_session(4, "fleetkpi-tests")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def database():
    from compare import database as open_database

    return open_database(SF_DIR)
