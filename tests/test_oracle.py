"""Every registered query against its SQL counterpart, on the smallest tables."""

import pytest

from checks.compare import connect, difference
from checks.oracles import ORACLES
from checks.queries import QUERIES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    return connect(SF)


def test_only_random_ids_lack_a_counterpart():
    assert set(QUERIES) - set(ORACLES) == {"random_id"} and set(ORACLES) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, duck, name):
    got = QUERIES[name](spark, SF).toArrow()
    assert difference(got, duck.sql(ORACLES[name]).to_arrow_table()) is None
