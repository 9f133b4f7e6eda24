import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from lorespark.session import local_session


@pytest.fixture(scope="session")
def spark():
    session = local_session("lorespark-tests", cores=4, shuffle_partitions=2)
    # Tiny inputs: compiling a class per plan and re-planning at run time cost more than the rows.
    session.conf.set("spark.sql.codegen.wholeStage", "false")
    session.conf.set("spark.sql.adaptive.enabled", "false")
    yield session
    session.stop()
