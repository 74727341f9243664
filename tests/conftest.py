import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))


@pytest.fixture(scope="session")
def spark():
    from bench import session

    return session("4")


SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def sf():
    return SF
