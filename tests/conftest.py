import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from turnstone.session import send, session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    s = session("tests", "4", "4g")
    s.conf.set("spark.sql.shuffle.partitions", "4")
    # On tables of a few rows compiling plans would take nearly all the time.
    s.conf.set("spark.sql.codegen.wholeStage", "false")
    s.conf.set("spark.sql.codegen.factoryMode", "NO_CODEGEN")
    s.sparkContext.setLogLevel("ERROR")
    return send(s)
