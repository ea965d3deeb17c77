"""Every query of the core against its SQL, on the smallest tables."""

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent))
from compare import database, rows

from lodegraph.plans import catalogue

Q, O = catalogue.queries(), catalogue.oracle_sql()


@pytest.fixture(scope="module")
def duck(data):
    return database(data)


@pytest.mark.parametrize("name", sorted(O))
def test_query_equals_sql(spark, data, duck, name):
    got, want = Q[name](spark, data).toPandas(), duck.execute(O[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


@pytest.mark.parametrize("name", sorted(set(Q) - set(O) - {"p4_found", "p4_descendants", "p4_paths"}))
def test_query_without_sql_runs(spark, data, name):
    df = Q[name](spark, data)
    assert df.columns and df.count() >= 0


def test_all_sql_belongs_to_a_query():
    assert set(O) <= set(Q)
