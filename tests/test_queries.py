"""Every query beside its SQL twin, and the driver contract."""

import pytest

import __spark_entry__ as entry
import bindings
from tests.compare import connect, problems

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(FOLDER)


@pytest.mark.parametrize("name", sorted(bindings.QUERIES))
def test_query_agrees(spark, con, name):
    assert problems(spark, con, FOLDER, name) == []


def test_entry_has_rows(spark):
    assert entry.entry(spark).count() > 0


def test_twins_belong_to_queries():
    assert set(entry.oracle_sql()) <= set(entry.queries())
