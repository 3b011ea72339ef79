import pytest

import __spark_entry__ as entry
from tests.compare import connect, same
from tests.conftest import SF
from veinmap import queries as engine


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", list(engine.oracle_sql()))
def test_query_equals_its_sql(spark, con, name):
    same(engine.queries()[name](spark, SF), con, engine.oracle_sql()[name])


def test_every_query_but_the_alignment_has_sql():
    assert set(engine.queries()) - set(engine.oracle_sql()) == {"join_alignment"}


def test_entry(spark):
    assert entry.entry(spark).count() == 6


def test_entry_lists_what_is_there():
    assert set(engine.queries()) <= set(entry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())
