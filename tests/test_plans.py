"""The physical plans are the intended ones."""

import pytest

import __spark_entry__
from admitflow.operators import events
from workload.roles import Tables

QUERIES, ORACLES = __spark_entry__.queries(), __spark_entry__.oracle_sql()


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


# Encoders and nets run in Python; two statistics rows are joined without a key.
PYTHON = {"fit_encoder", "encode_rows", "encoder_loss", "encoded_cohort", "net_train_score", "net_skill", "dropout_grid", "multilabel_net"}
# What these return is a scan of stored scores: reading their plans would train every model again and show nothing.
TRAINED = {
    "model_roundtrip", "rf_train_score", "gbt_train_score", "mlp_train_score", "multilabel_train_score", "grid_sweep", "cross_validate", "learning_curve",
    "validation_curve", "feature_importance", "topk_retrain", "topk_feature_table", "label_chain",
}
RELATIONAL = sorted(set(ORACLES) - PYTHON - TRAINED - {"roc_of_model"})


@pytest.mark.parametrize("name", RELATIONAL)
def test_no_python_and_no_cross_join(spark, small, name):
    text = plan(QUERIES[name](spark, small))
    for bad in ("CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython", "ArrowEvalPython", "MapInPandas", "FlatMapGroups"):
        assert bad not in text


def test_keep_last_limits_groups_before_the_shuffle(spark, small):
    text = plan(events.keep_last(Tables(spark, small).labs, ["hadm_id", "itemid"]))
    assert text.count("WindowGroupLimit") == 2


def test_scans_read_needed_columns_and_push_filters(spark, small):
    text = plan(QUERIES["filter_codes"](spark, small))
    assert "l_extendedprice" not in text and "PushedFilters: [IsNotNull(l_linestatus)" in text
    text = plan(QUERIES["filter_contains_any"](spark, small))
    assert "StringContains(p_name,ring)" in text
    text = plan(QUERIES["filter_prefix_any"](spark, small))
    assert "StringStartsWith(p_brand,Brand#1)" in text
    text = plan(QUERIES["scan_project"](spark, small))
    assert "ReadSchema: struct<l_orderkey:bigint,l_partkey:bigint,l_quantity:double>" in text


def test_pivot_moves_rows_once(spark, small):
    from admitflow.operators import reshape

    text = plan(reshape.pivot_values(Tables(spark, small).labs, "hadm_id", "itemid", "valuenum", [1, 2]))
    assert text.count("Exchange hashpartitioning(hadm_id") == 1


def test_lookback_joins_on_subject_and_time_bucket(spark, small):
    text = plan(QUERIES["join_lookback_interval"](spark, small))
    assert "_bucket" in text and "Inner" in text


@pytest.mark.parametrize("name", ["join_lookback_interval", "join_hot_subject", "join_previous_360d"])
def test_window_joins_only_compare_per_pair(spark, small, name):
    """The bounds of a span are computed before the join, not for every pair."""
    joins = [line for line in plan(QUERIES[name](spark, small)).splitlines() if "_bucket" in line and "Inner" in line]
    assert joins and all(">" in line and "INTERVAL" not in line for line in joins)


def test_sample_split_does_not_shuffle(spark, small):
    assert "Exchange" not in plan(QUERIES["split_exact"](spark, small))
    assert "Exchange" not in plan(QUERIES["kfold_assign"](spark, small))


def test_narrow_pivots_are_one_aggregation(spark, small):
    for name in ("pivot_values", "pivot_flags"):
        text = plan(QUERIES[name](spark, small))
        assert "pivotfirst" not in text and text.count("HashAggregate(") == 2
    assert spark.conf.get("spark.sql.adaptive.advisoryPartitionSizeInBytes") == "16m"
