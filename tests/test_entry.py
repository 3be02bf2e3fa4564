import os

import pytest

import __spark_entry__ as driver


def test_contract():
    assert driver.oracle_sql().keys() <= driver.queries().keys()
    assert len(driver.queries()) >= 70


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="no test tables")
def test_flagship(spark):
    df = driver.entry(spark)
    assert df.columns == ["user_id", "day", "status"] and df.count() > 0
