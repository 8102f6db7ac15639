"""Every registered query against its SQL."""

import oracle
import pytest

from audira.plans import all_queries


@pytest.mark.parametrize("name", list(all_queries()))
def test_query_matches_sql(spark, con, sf_dir, name):
    assert oracle.differences(spark, con, all_queries()[name], sf_dir) is None


def test_contract_lists_the_same_names():
    import __spark_entry__ as contract

    assert set(contract.oracle_sql()) <= set(contract.queries())
    assert set(all_queries()) <= set(contract.queries())
    assert set(all_queries()) - set(contract.oracle_sql()) == {"ridge_all_features"}
