"""Every registered query against its SQL twin, over the whole small tables."""

import pytest

import __spark_entry__ as contract
from siftlake.plans import catalogue
from tools.check import compare, connect

SF = "/root/testdata/sf0.001"
ORACLES = contract.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", list(catalogue.queries()))
def test_query(spark, con, name):
    df = contract.queries()[name](spark, SF)
    assert name in ORACLES
    result = compare(df, con, ORACLES[name])
    assert isinstance(result, tuple), result


def test_entry(spark):
    df = contract.entry(spark)
    assert df.columns == ["host", "records"] and df.count() > 0


def test_every_query_names_its_operators():
    assert all(ids for ids in catalogue.operator_ids().values())
