"""Every registered query with SQL gives the same rows as DuckDB over the same tables; the others run."""

import pytest
from clicklake.plans.queries import QUERIES
from clicklake.plans import stream_queries  # noqa: F401  registers its queries

from .conftest import DATA, canonical, run_sql


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, name):
    run, sql = QUERIES[name]
    got = run(spark, DATA).toPandas()
    if sql is None:
        assert len(got)
        return
    want = run_sql(sql)
    assert sorted(got.columns) == sorted(want.columns)
    assert canonical(got) == canonical(want)
