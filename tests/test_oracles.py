"""Every query against its SQL, and what its plan must not contain."""

import pytest

from checks.compare import connect, oracle_rows, rows_of
from checks.oracles import ORACLES
from checks.queries import QUERIES

WITHOUT_SQL = {"ann_topk", "ivf_topk"}  # approximate results


@pytest.fixture(scope="module")
def duck(sf_dir):
    return connect(sf_dir)


def test_every_query_has_its_sql():
    assert set(QUERIES) - set(ORACLES) == WITHOUT_SQL
    assert set(ORACLES) <= set(QUERIES)


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, duck, sf_dir, name):
    df = QUERIES[name](spark, sf_dir)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoopJoin" not in plan
    assert "PythonUDF" not in plan and "BatchEvalPython" not in plan
    rows = rows_of(df.columns, [tuple(r) for r in df.collect()])
    assert rows[1] or name == "lookup_article"
    if name in ORACLES:
        assert rows == oracle_rows(duck, name)
