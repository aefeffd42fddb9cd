"""Every registered query against its DuckDB oracle text (sf0.001)."""

import pytest

import __spark_entry__ as E
import helio.plans.catalog  # noqa: F401
from helio.plans.check import duck_connect, table_digest
from helio.plans.registry import QUERIES

from conftest import SF_SMALL

#: Optional subpackages bring their own tests.
OWN = set(QUERIES)
SLOW = {"train_models", "feature_importance_top20", "model_store"}
KEYS = sorted(k for k in E.oracle_sql() if k in OWN)


@pytest.fixture(scope="module")
def con():
    return duck_connect(SF_SMALL)


@pytest.mark.parametrize("key", KEYS)
def test_matches_oracle(spark, con, key):
    df = E.queries()[key](spark, SF_SMALL)
    got = table_digest(df.columns, [tuple(r) for r in df.collect()])
    rel = con.sql(E.oracle_sql()[key])
    want = table_digest(rel.columns, rel.fetchall())
    assert got[1] == want[1], (got[1], want[1])
    assert got[0] == want[0]
    assert got == want


def test_every_key_has_a_function():
    assert set(E.oracle_sql()) <= set(E.queries())
    assert OWN <= set(E.queries())
    assert OWN - set(E.oracle_sql()) == SLOW


def test_entry_runs(spark):
    df = E.entry(spark)
    assert df.count() > 0
    assert "alert_rank" in df.columns
