"""One local session for all tests."""

from __future__ import annotations

import os
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
sys.path.insert(0, str(ROOT))
os.environ.setdefault("PYTHONPATH", str(ROOT))


@pytest.fixture(scope="session")
def spark():
    from tidewell.session import attach, local_session

    session = local_session(4, 4)
    session.sparkContext.setLogLevel("ERROR")
    return attach(session)


@pytest.fixture(scope="session")
def sf_dir() -> str:
    return os.environ.get("TIDEWELL_TEST_SF", "/root/testdata/sf0.001")
