import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
os.environ["PYTHONPATH"] = os.pathsep.join([sys.path[0], os.path.dirname(os.path.abspath(__file__)), os.environ.get("PYTHONPATH", "")])


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from bookflow.session import build_session

    s = build_session("local[4]", "tests", partitions=4, memory="4g", **{"spark.checkpoint.dir": "file://" + str(tmp_path_factory.mktemp("shared"))})
    yield s
    s.stop()


@pytest.fixture(scope="session")
def data():
    return os.environ.get("BOOKFLOW_TEST_DIR", "/root/testdata/sf0.001")
