import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
os.environ.setdefault("QUARRY_DRIVER_MEMORY", "3g")


@pytest.fixture(scope="session")
def spark():
    from quarrymill.session import get_spark

    s = get_spark("tests", "4", 4)
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()
