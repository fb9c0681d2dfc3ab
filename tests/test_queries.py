"""Every core query with SQL gives what its SQL gives."""

import pytest

from lodestrata.plans import general, graph_queries, retrieval_queries, source_queries, table_queries
from tests.compare import rows_of, sql_rows

MODULES = (general, graph_queries, retrieval_queries, source_queries, table_queries)
CASES = [(name, module) for module in MODULES for name in module.ORACLE]


@pytest.mark.parametrize(("name", "module"), CASES, ids=[c[0] for c in CASES])
def test_query_equals_sql(spark, data, name, module):
    assert rows_of(module.QUERIES[name](spark, data)) == sql_rows(module.ORACLE[name], data)


@pytest.mark.parametrize("name", [n for n in source_queries.QUERIES if n not in source_queries.ORACLE])
def test_query_runs(spark, data, name):
    assert source_queries.QUERIES[name](spark, data).count() > 0
