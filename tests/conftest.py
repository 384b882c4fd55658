import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))


@pytest.fixture(scope="session")
def spark():
    from sedge.session import local_session

    s = local_session(cores=4, shuffle_partitions=4, memory="4g", app="tests")
    s.sparkContext.setLogLevel("ERROR")
    return s


SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def small():
    if not Path(SMALL).exists():
        pytest.skip("test tables aren't here")
    return SMALL
