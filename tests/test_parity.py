"""Each query against its SQL on the smallest tables."""

from __future__ import annotations

import pytest

from annolens.catalog import ORACLE, QUERIES
from tests.conftest import DATA, plain


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_matches_sql(spark, duck, name):
    got, want = QUERIES[name](spark, DATA).toPandas(), duck.sql(ORACLE[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert plain(got) == plain(want)


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLE)


def test_entry_gives_rows(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
