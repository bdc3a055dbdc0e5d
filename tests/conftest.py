import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from voxtable.session import build_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    s = build_session("local[8]", "voxtable-tests", partitions=8, spark__ui__enabled="false",
                      spark__driver__memory="8g", spark__checkpoint__dir=tempfile.mkdtemp(prefix="voxtable-tests-"))
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture
def scratch(tmp_path):
    return str(tmp_path)
