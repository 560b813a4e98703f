import pytest
from oracle import DATA, connection, same

from rootline.plans import PLANS

CASES = [(name, part.QUERIES[name], sql) for part in PLANS for name, sql in part.ORACLES.items()]


@pytest.fixture(scope="module")
def duck():
    return connection()


@pytest.mark.parametrize(("name", "query", "sql"), CASES, ids=[c[0] for c in CASES])
def test_equals_sql(spark, duck, name, query, sql):
    same(query(spark, DATA), sql, duck)


def test_every_query_has_a_place():
    names = [n for part in PLANS for n in part.QUERIES]
    assert len(names) == len(set(names))
    assert all(n in part.QUERIES for part in PLANS for n in part.ORACLES)
