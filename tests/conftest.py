import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

SF_SMALL = "/root/testdata/sf0.001"
SF_ORACLE = os.environ.get("LEDGERWASH_ORACLE_SF", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark():
    from ledgerwash.session import local_session
    s = local_session(cores="*", shuffle_partitions=8, app="ledgerwash-tests")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def tables(spark):
    from ledgerwash.plans.registry import Tables
    return Tables(spark, SF_SMALL)
