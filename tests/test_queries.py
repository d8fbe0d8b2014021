"""Every registered query of the content-safety part against its SQL, on the smallest tables."""

import pytest

from palisade import catalog
from tests.conftest import DATA


@pytest.mark.parametrize("name", sorted(catalog.ORACLE))
def test_query_matches_sql(name, spark, duck, same):
    same(catalog.QUERIES[name](spark, str(DATA)), duck.execute(catalog.ORACLE[name]).df())


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLE)))
def test_query_runs(name, spark):
    assert catalog.QUERIES[name](spark, str(DATA)).count() > 0


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
