import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from fleetpulse.session import local_session

    session = local_session(8, "fleetpulse-tests")
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def readings(spark):
    from fleetpulse.catalog.views import readings as view

    return view(spark, SMALL)


@pytest.fixture(scope="session")
def scored(spark):
    from fleetpulse.catalog.views import scored as view

    return view(spark, SMALL)


def rows(df, digits=9):
    """Order-free comparable form."""
    def cell(v):
        if isinstance(v, float):
            return round(v, digits) + 0.0
        if isinstance(v, list):
            return tuple(cell(x) for x in v)
        return v
    names = sorted(df.columns)
    return sorted((tuple(cell(r[c]) for c in names) for r in df.collect()), key=repr)
