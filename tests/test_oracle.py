"""Every query with SQL gives the same rows as DuckDB."""

import pytest

import __spark_entry__
import oracle

QUERIES, ORACLES = __spark_entry__.queries(), __spark_entry__.oracle_sql()


@pytest.fixture(scope="module")
def db(folder):
    return oracle.connect(folder)


@pytest.fixture(scope="module")
def small_db(small):
    return oracle.connect(small)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_rows(spark, folder, db, name):
    assert oracle.compare(QUERIES[name](spark, folder), db, ORACLES[name]) is None


@pytest.mark.parametrize("name", ["count_previous", "describe_numeric", "kfold_assign", "pr_auc", "roc_auc_by_group", "weighted_bootstrap"])
def test_same_rows_small(spark, small, small_db, name):
    assert oracle.compare(QUERIES[name](spark, small), small_db, ORACLES[name]) is None


def test_oracles_belong_to_queries():
    assert set(ORACLES) <= set(QUERIES)


def test_entry(spark):
    df = __spark_entry__.entry(spark)
    assert df.columns[0] == "hadm_id" and df.count() > 0
