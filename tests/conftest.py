import os
import sys
import tempfile

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from odspark.constants import OD_COLUMNS  # noqa: E402
from odspark.schema import OD_SCHEMA  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    from odspark.session import get_spark
    s = get_spark(master="local[4]", shuffle_partitions=8, app_name="odspark-tests")
    yield s
    s.stop()


@pytest.fixture()
def tmpdir_path():
    return tempfile.mkdtemp(prefix="odspark-test-", dir="/tmp")


def od_row(date="20231017", route="R1", rid=100001, bseq=1, bars="01001", bcode="100001001",
           bname="S1001", aseq=2, aars="01002", acode="100001002", aname="S1002", riders=1):
    return (date, route, rid, bseq, bars, bcode, bname, aseq, aars, acode, aname, riders)


@pytest.fixture()
def make_od(spark):
    def mk(rows):
        return spark.createDataFrame(rows, OD_SCHEMA)
    return mk


def rows_of(df, cols=None, order=None):
    cols = cols or df.columns
    out = [tuple(r[c] for c in cols) for r in df.collect()]
    return sorted(out, key=lambda t: tuple((x is None, str(x)) for x in t))
