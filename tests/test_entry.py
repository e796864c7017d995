import os

import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"


def test_names():
    q, o = entry.queries(), entry.oracle_sql()
    assert set(o) <= set(q) and "stats_lineitem" in q


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")
def test_entry(spark):
    assert entry.entry(spark).count() == 6
