import os
import sys
from pathlib import Path

import pytest

REPO = str(Path(__file__).resolve().parents[1])
sys.path.insert(0, REPO)
os.environ["PYTHONPATH"] = os.pathsep.join(x for x in (REPO, os.environ.get("PYTHONPATH")) if x)
os.environ.setdefault("PYSPARK_PYTHON", sys.executable)
os.environ.setdefault("OMP_NUM_THREADS", "1")


@pytest.fixture(scope="session")
def spark():
    from duespark.session import build_session

    session = build_session("tests", "local[4]", **{"spark.sql.shuffle.partitions": 4, "spark.driver.memory": "4g"})
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def small():
    """The smallest driver tables."""
    return "/root/testdata/sf0.001"
