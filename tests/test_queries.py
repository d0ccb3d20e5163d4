"""Every registered query of the record engine against its DuckDB oracle."""

import pytest

from tabulon.queries import ORACLE, QUERIES
from tests.compare import rows


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, sf_dir, duck, name):
    got = QUERIES[name](spark, sf_dir).toPandas()
    if name not in ORACLE:
        assert len(got)
        return
    expected = duck.sql(ORACLE[name]).df()
    assert rows(got) == rows(expected)


def test_not_vacuous(spark, duck):
    empty = [n for n in ORACLE if not len(duck.sql(ORACLE[n]).df())]
    assert len(empty) <= 4, empty  # the smallest tables leave a few selections empty
