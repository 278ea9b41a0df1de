import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
sys.path.insert(0, os.path.join(ROOT, "tests"))

SF001 = "/root/testdata/sf0.001"
SF01 = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def spark():
    from notewise.session import build_session
    s = build_session("local[4]", shuffle_partitions=8)
    yield s


@pytest.fixture(scope="session")
def duck01():
    from oracle import duck
    return duck(SF01)
