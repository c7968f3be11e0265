import os
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))
os.environ.setdefault("BENCH_MEMORY", "6g")


@pytest.fixture(scope="session")
def spark():
    from ledgerloom.session import session

    found = session(cpus=4, partitions=4)
    found.sparkContext.setLogLevel("ERROR")
    return found


@pytest.fixture(scope="session")
def sf():
    return "/root/testdata/sf0.001"
