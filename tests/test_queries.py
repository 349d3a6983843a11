"""Every query of the operators against its SQL."""

import pytest
from helpers import DATA, same_as_sql

from textweir.plans.registry import QUERIES, SQL


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_as_sql(spark, name):
    same_as_sql(QUERIES[name](spark, DATA), SQL[name])


def test_take_subset(spark):
    got = QUERIES["take_subset"](spark, DATA)
    assert got.count() == int(0.1 * spark.read.parquet(f"{DATA}/documents.parquet").count())
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, QUERIES["take_subset"](spark, DATA).collect()))
