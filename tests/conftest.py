import os
import sys
from pathlib import Path

import pytest

ROOT = str(Path(__file__).resolve().parent.parent)
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = ROOT + os.pathsep + os.environ.get("PYTHONPATH", "")  # for the Python workers


@pytest.fixture(scope="session")
def spark():
    from tidegrid.session import session

    own = session("tests", "local[4]", **{"spark.sql.shuffle.partitions": "4", "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false", "spark.driver.memory": "4g"})
    own.sparkContext.setLogLevel("ERROR")
    return own


@pytest.fixture(scope="session")
def sf():
    return "/root/testdata/sf0.001"
