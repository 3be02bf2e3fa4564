import os

import pytest
from oracle import database, same

from stageledger.plans import catalogue

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.fixture(scope="module")
def connection():
    return database(SF)


@pytest.mark.parametrize("name", sorted(catalogue.oracle_sql()))
def test_query_matches_its_sql(spark, connection, name):
    same(catalogue.queries()[name](spark, SF), connection, catalogue.oracle_sql()[name])


def test_every_query_runs(spark):
    for name in catalogue.queries().keys() - catalogue.oracle_sql().keys():
        assert catalogue.queries()[name](spark, SF).count() >= 1
