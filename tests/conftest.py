import os
import sys

import pytest

HERE = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, HERE)
os.environ["PYTHONPATH"] = os.pathsep.join([HERE, *filter(None, [os.environ.get("PYTHONPATH")])])


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from latticework.session import local_session

    s = local_session(cores=4, shuffle_partitions=4, memory="4g", app="tests")
    s.sparkContext.setLogLevel("ERROR")
    s.conf.set("spark.sql.autoBroadcastJoinThreshold", "10m")
    s.sparkContext.setCheckpointDir(str(tmp_path_factory.mktemp("checkpoints")))
    return s
