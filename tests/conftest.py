"""Shared Spark session for the tests (local mode, 8 shuffle partitions).

The checkpoint root is only set here because no cluster names one; library
code reads ``spark.checkpoint.dir`` from the session.
"""

from __future__ import annotations

import os
import sys
import tempfile

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

SF_SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from vaultline.session import get_session
    s = get_session("local[4]", app="vaultline-tests", shuffle_partitions=8,
                    extra={"spark.checkpoint.dir": tempfile.mkdtemp(prefix="vl-test-ckpt-")})
    yield s
    s.stop()


@pytest.fixture(scope="session")
def bank(spark):
    from vaultline.sources.tables import Bank
    return Bank(spark, SF_SMALL)
