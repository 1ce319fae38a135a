import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))


@pytest.fixture(scope="session")
def spark():
    from tessitura.session import build_session

    return build_session("local[4]", 4)


@pytest.fixture(scope="session")
def sf():
    return "/root/testdata/sf0.001"
