"""Every registered query against its SQL on the smallest given tables."""

import pytest

import __spark_entry__ as entry
import oracle

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return oracle.connect(SF)


@pytest.mark.parametrize("name", list(entry.queries()))
def test_query(spark, con, name):
    # A tiny table may leave both sides empty; that is agreement too.
    told = oracle.compare(spark, con, SF, name)
    assert told in (None, "both empty"), told
