import pytest
from oracle import assert_same

from weftline.plans import catalog_queries, job_queries

QUERIES = {**catalog_queries.QUERIES, **job_queries.QUERIES}
ORACLE_SQL = {**catalog_queries.ORACLE_SQL, **job_queries.ORACLE_SQL}


@pytest.mark.parametrize("name", QUERIES)
def test_query_equals_sql(spark, sf_dir, name):
    df = QUERIES[name](spark, sf_dir)
    if name in ORACLE_SQL:
        assert_same(df, ORACLE_SQL[name], sf_dir)
    else:
        df.collect()


def test_points_of_curves_are_parsed_once(spark, sf_dir):
    plan = job_queries.QUERIES["curves_stroked"](spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
    assert "split(" not in plan and "regexp" not in plan  # the gaps are taken from stored points
