"""Every registered query: equal to its SQL where there is one, else it must run."""

import os

import oracle
import pytest
from inkspan.plans import catalogue

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
SQL = catalogue.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return oracle.connect(SF)


@pytest.mark.parametrize("name", list(catalogue.queries()))
def test_query(spark, con, name):
    f = catalogue.queries()[name]
    if name in SQL:
        assert oracle.same(spark, con, SF, f, SQL[name]) == ""
    else:
        assert f(spark, SF).count() >= 0


def test_entry_point(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())


def test_entry_point_without_corpus_operators():
    import subprocess
    import sys
    from pathlib import Path

    code = "import sys; sys.modules['corpus_pipeline'] = None; sys.modules['inkspan.llm'] = None; import __spark_entry__ as e; assert e.queries() and not [k for k in e.queries() if k.startswith('op')]"
    subprocess.run([sys.executable, "-c", code], check=True, cwd=Path(__file__).resolve().parent.parent)
