import os
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from tallgrass.plans.session import local_session  # noqa: E402

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    shared = tmp_path_factory.mktemp("shared")
    session = local_session("tests", cores=min(4, os.cpu_count() or 4), shuffle_partitions=4, spark__checkpoint__dir=f"file://{shared}")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def small():
    if not os.path.isdir(SMALL):
        pytest.skip("no test tables here")
    return SMALL


@pytest.fixture
def rows():
    return lambda df: sorted(map(tuple, df.collect()), key=lambda r: tuple((x is not None, str(x)) for x in r))
