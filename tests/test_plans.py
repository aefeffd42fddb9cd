"""Plan checks: no Python in the hot path, no cross/nested-loop joins, pruned scans."""

import pytest

import __spark_entry__ as E
import helio.plans.catalog  # noqa: F401
from helio.plans.registry import QUERIES

from conftest import SF_SMALL

PY_OK = {"knn_impute", "prepare_features"}  # the one grouped-Arrow function (Q1)
NO_PLAN = {"train_models", "feature_importance_top20", "model_store", "sink_observations",
           "feed_kp", "feed_wind", "feed_alerts", "feed_kp_last60", "tracked_objects",
           "report_rows", "stream_feed", "stream_dedup", "stream_alerts", "stream_risk",
           "stream_latest", "describe", "winsorize", "global_rolling", "prepare_features"}


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("key", sorted(set(QUERIES) - NO_PLAN))
def test_no_python_no_cross_join(spark, key):
    plan = _plan(E.queries()[key](spark, SF_SMALL))
    assert "CartesianProduct" not in plan
    assert "BroadcastNestedLoopJoin" not in plan
    if key not in PY_OK:
        assert "BatchEvalPython" not in plan and "ArrowEvalPython" not in plan


def test_alerts_plan_is_one_projection(spark):
    plan = _plan(E.queries()["threshold_alerts"](spark, SF_SMALL))
    assert "Exchange" not in plan and "Join" not in plan


def test_scan_prunes_columns(spark):
    df = E.queries()["composite_risk"](spark, SF_SMALL)
    plan = _plan(df)
    assert "ReadSchema: struct<event_id:bigint,ts:timestamp_ntz,user_id:bigint,value:double,props:string>" in plan \
        or "event_type" not in plan


def test_tail_uses_group_limit(spark):
    plan = _plan(E.queries()["tail_n"](spark, SF_SMALL))
    assert "WindowGroupLimit" in plan
