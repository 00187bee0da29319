"""Shared Spark session for the tests (local[*], 8 shuffle partitions) and the smoke data folder."""

import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from rareflow.session import build_session

    s = build_session("local[*]", app="rareflow-tests", shuffle_partitions=8)
    yield s
    s.stop()


SF = "/root/testdata/sf0.001"
