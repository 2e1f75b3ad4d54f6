"""Every log query with SQL gives the SQL's rows on the smallest tables."""

import os
import subprocess
import sys
from pathlib import Path

import pytest
from compare import connect, differences

from logspark.plans import queries as P

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def duck():
    return connect(SF)


@pytest.mark.parametrize("name", list(P.queries()))
def test_query(spark, duck, name):
    df = P.queries()[name](spark, SF)
    if name in P.oracle_sql():
        assert differences(df, duck, P.oracle_sql()[name]) == []
    else:
        assert df.count() > 0


def test_entry_contract():
    import __spark_entry__ as e

    assert set(P.queries()) <= set(e.queries()) and set(e.oracle_sql()) <= set(e.queries())


def test_registry_needs_no_session():
    """The registry is read before any session exists, so no Column may be built at import."""
    code = "import __spark_entry__ as e; from pyspark import SparkContext; print(len(e.queries()), len(e.oracle_sql()), SparkContext._active_spark_context)"
    said = subprocess.run([sys.executable, "-c", code], cwd=Path(__file__).resolve().parent.parent, capture_output=True, text=True, timeout=120, check=True).stdout.split()
    assert int(said[-3]) >= int(said[-2]) > 0 and said[-1] == "None"
