from __future__ import annotations

import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from liftgrid.session import checkpoint_dir, local_session  # noqa: E402
from liftgrid.sources.testbed import SPEC  # noqa: E402
from liftgrid.spec import ExperimentSpec  # noqa: E402

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    session = local_session(8)
    session.sparkContext.setLogLevel("OFF")
    checkpoint_dir(session)
    yield session
    session.stop()


@pytest.fixture(scope="session")
def folder():
    return FOLDER


@pytest.fixture(scope="session")
def spec():
    return SPEC


@pytest.fixture(scope="session")
def small_spec():
    return ExperimentSpec(features=("f0", "f1"))


@pytest.fixture(scope="session")
def units(spark, folder):
    from liftgrid.catalog.queries import units

    return units(spark, folder)


@pytest.fixture
def two_arm_frame(spark):
    """420 units: f0 alike in both arms, f1 far apart, more successes among the treated."""
    rows = []
    for arm, centre, visit, conversion in ((1, -2.0, 7, 42), (0, 3.5, 14, 70)):
        for i in range(210):
            shift = 0.03 * ((i * 5) % 7)
            rows.append((f"{arm}-{i:03d}", 2.0 + shift, centre + shift, arm, int(i % visit == 3), int(i % conversion == 3)))
    return spark.createDataFrame(
        rows, "unit_id string, f0 double, f1 double, treatment int, visit int, conversion int"
    )
