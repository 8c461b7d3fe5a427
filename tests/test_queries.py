"""Every registered query against its SQL on the smallest tables."""

import os
import sys

import pytest

sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "tools"))

from check_queries import compare, connect  # noqa: E402
from workload import ORACLES, QUERIES  # noqa: E402

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    if not os.path.isdir(SF):
        pytest.skip("test tables are not there")
    return connect(SF)


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, con, name):
    assert compare(spark, con, SF, name) == ""


def test_entry(spark):
    import __spark_entry__ as e

    df = e.entry(spark)
    assert df.columns == ["dataset", "scope", "subject", "check", "severity", "message", "level"]
    assert df.count() > 0
    assert set(e.oracle_sql()) <= set(e.queries()) and set(ORACLES) <= set(e.oracle_sql())


def test_queries_without_optional_libraries():
    """Where a library of the training-data operators is absent, all other queries are still offered."""
    import subprocess

    code = ("import sys; sys.modules['sentencepiece'] = None; sys.modules['public_tokenizers'] = None\n"
            "import __spark_entry__ as e; from workload import QUERIES; assert set(e.queries()) == set(QUERIES) and len(QUERIES) > 100")
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    done = subprocess.run([sys.executable, "-c", code], cwd=root, capture_output=True, text=True, timeout=120)
    assert done.returncode == 0, done.stderr
    assert "left out" in done.stderr
