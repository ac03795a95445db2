from __future__ import annotations

import os
import sys
import tempfile

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
if ROOT not in sys.path:
    sys.path.insert(0, ROOT)

SF_SMALL = "/root/testdata/sf0.001"
SF_CHECK = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def spark():
    from hearth.session import get_spark
    s = get_spark("hearth-tests", master="local[4]", shuffle_partitions=8,
                  extra={"spark.checkpoint.dir": tempfile.mkdtemp(prefix="hearth-test-ckpt-")})
    yield s
    s.stop()


@pytest.fixture(scope="session")
def star_small(spark):
    from hearth.sources.testviews import load_star
    return load_star(spark, SF_SMALL)


def rows(df, order=None):
    """Collect a small test result as a list of tuples (sorted if asked)."""
    out = [tuple(r) for r in df.collect()]
    return sorted(out, key=repr) if order is None else out
