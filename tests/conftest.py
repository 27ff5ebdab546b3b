import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import towline  # noqa: E402, F401
from towline.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = local_session(4, app="towline-tests", memory="6g")
    session.conf.set("spark.sql.shuffle.partitions", "4")
    return session


@pytest.fixture(scope="session")
def rows():
    def collect(df, *order):
        return sorted((tuple(r) for r in (df.select(*order) if order else df).collect()), key=repr)

    return collect
