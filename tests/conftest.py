import pathlib
import sys

import pytest

sys.path.insert(0, str(pathlib.Path(__file__).resolve().parents[1]))

from filingscope.session import local_session


@pytest.fixture(scope="session")
def spark():
    session = local_session(cores=8, shuffle_partitions=8, memory="8g")
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()
