import os
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))
sys.path.insert(0, str(Path(__file__).resolve().parent))
os.environ.setdefault("TZ", "UTC")


@pytest.fixture(scope="session")
def spark():
    from querymill.session import local_session, ship

    s = local_session(4, shuffle_partitions=4, driver_memory="4g")
    s.sparkContext.setLogLevel("OFF")
    ship(s)
    yield s
    s.stop()
