"""Every registered query next to its SQL counterpart, on the smallest data set."""

import pytest

import check_queries
from __spark_entry__ import entry
from oracles import ORACLES
from quillstream.queries import QUERIES

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def db():
    return check_queries.connect(DATA)


def test_each_query_has_a_counterpart():
    assert set(ORACLES) == set(QUERIES)


def test_entry_has_rows(spark):
    assert entry(spark).count() > 0


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, db, name):
    assert check_queries.compare(spark, db, name, DATA) is None
