import os
import sys
import tempfile
from pathlib import Path

import pytest

ROOT = str(Path(__file__).resolve().parent.parent)
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = os.pathsep.join(dict.fromkeys([ROOT, *filter(None, os.environ.get("PYTHONPATH", "").split(os.pathsep))]))

TESTDATA = "/root/testdata"


@pytest.fixture(scope="session")
def spark():
    from kinspark.session import session

    s = session("tests", cpus=4, **{"spark.sql.shuffle.partitions": "4", "spark.driver.memory": "4g", "spark.ui.showConsoleProgress": "false", "spark.checkpoint.dir": tempfile.mkdtemp(prefix="kinspark-tests-")})
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()
