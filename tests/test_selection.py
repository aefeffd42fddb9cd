"""Quantiles by selection, and correlations from sums: against definitions, ties and skew."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from helio.operators import quality, quantiles, stats
from helio.operators.windows import KEYED, Layout

PROBS = [0.0, 0.01, 0.25, 0.5, 0.75, 0.99, 1.0]


@pytest.fixture(scope="module")
def wide(spark):
    rng = np.random.default_rng(1)
    n = 6000
    pdf = pd.DataFrame({
        "smooth": rng.normal(size=n), "hot": np.where(rng.random(n) < 0.9, 7.0, rng.random(n)),
        "few": rng.integers(0, 5, n).astype(float), "heavy": rng.pareto(1, n) * 1e6,
        "const": np.full(n, 3.3), "two": np.where(np.arange(n) % 2, -1.0, 1.0)})
    pdf.loc[::7, "smooth"] = np.nan
    df = spark.createDataFrame(pdf).withColumn("none", F.lit(None).cast("double"))
    return pdf, df.repartition(5).persist()


@pytest.mark.parametrize("options", [{}, {"accuracy": 100, "limit": 300},
                                     {"accuracy": 50, "limit": 20}])
def test_quantiles_are_exact(wide, options):
    """Small limits need several rounds of narrowing; NaN and NULL are missing."""
    pdf, df = wide
    got = quantiles.select_quantiles(df, df.columns, PROBS, **options)
    assert "none" not in got
    for c in pdf.columns:
        assert got[c] == pytest.approx([pdf[c].quantile(p) for p in PROBS], rel=1e-14, abs=0)


def test_a_frequent_value_is_one_counter(spark, monkeypatch):
    """One value in 90 % of a column: no task sees its rows together, and what comes back
    is bounded.  The plans have no sort, no window and no exchange of rows."""
    df = spark.range(50_000).select(
        F.when(F.col("id") % 10 > 0, 5.0).otherwise(F.col("id").cast("double")).alias("x"))
    plans, kept = [], type(df).collect

    def collect(frame):
        rows = kept(frame)
        plans.append((frame._jdf.queryExecution().executedPlan().toString(), len(rows)))
        return rows
    monkeypatch.setattr(type(df), "collect", collect)
    got = quantiles.select_quantiles(df, ["x"], [0.05, 0.5, 0.95])
    ordered = np.sort([5.0 if i % 10 else float(i) for i in range(50_000)])
    assert got["x"] == pytest.approx(list(np.quantile(ordered, [0.05, 0.5, 0.95])))
    assert plans and all(n < 200 for _, n in plans)
    for plan, _ in plans:
        assert "Window" not in plan and "rangepartitioning" not in plan and "Sort " not in plan


def test_a_refuted_bracket_is_replaced(spark):
    """Ranks outside their bracket are found in the segment that the counts name."""
    df = spark.createDataFrame([(float(i % 97),) for i in range(1000)], "x double").select(
        F.col("x").alias("_0"))
    want = sorted(float(i % 97) for i in range(1000))
    for low, high in ((90.0, 91.0), (-5.0, -4.0), (20.0, 20.0), (0.0, 96.0)):
        found, brackets = {}, [quantiles.Bracket("_0", 500, 501, low, high)]
        while brackets:
            brackets = quantiles._settled(df, brackets, found, {"_0": (0.0, 96.0)})
        assert found["_0", 500] == want[500] and found["_0", 501] == want[501]


def test_bounds_and_description_use_them(spark, wide):
    pdf, df = wide
    bounds = quality.winsor_bounds(df, ["hot", "smooth"])
    assert bounds["hot"] == pytest.approx(tuple(pdf["hot"].quantile([0.01, 0.99])))
    got = {r["feature"]: r for r in stats.describe(df, ["hot", "none"], 6).collect()}
    assert got["hot"]["p50"] == 7.0 and got["hot"]["count"] == len(pdf)
    assert got["none"]["p50"] is None and got["none"]["count"] == 0
    empty = stats.describe(df.limit(0), ["hot"], 6).collect()
    assert [r["p50"] for r in empty] in ([], [None])


def test_correlations_are_pairwise_complete(spark):
    rng = np.random.default_rng(4)
    pdf = pd.DataFrame(rng.normal(size=(900, 4)), columns=list("abcd"))
    pdf["b"] += 0.5 * pdf["a"]
    pdf["c"] = pdf["c"] * 1e-2 + 1e4  # a large offset costs no digits
    for i, c in enumerate("abd"):
        pdf.loc[i::5 + i, c] = np.nan
    pdf["flat"] = 1e9 + 0.1
    df = spark.createDataFrame(pdf).repartition(3)
    cols = [*"abcd", "flat"]
    got = {(r["col_a"], r["col_b"]): r["corr"] for r in stats.correlation_matrix(df, cols).collect()}
    want = pdf.corr()
    assert len(got) == 25
    for a in cols:
        for b in cols:
            if "flat" in (a, b):
                assert got[a, b] is None
            else:
                assert got[a, b] == pytest.approx(want.loc[a, b], abs=1e-9)
    lower = stats.correlation_matrix(df, cols, lower_only=True).collect()
    assert {(r["col_a"], r["col_b"]) for r in lower} == {
        (a, b) for i, a in enumerate(cols) for b in cols[:i]}
    plan = stats.correlation_matrix(df, cols)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Generate") == 1 and plan.index("Generate") < plan.index("HashAggregate")
    assert stats.correlation_matrix(df.limit(0), cols).where("corr is not null").count() == 0


@pytest.mark.parametrize("layout", [Layout(chunk_rows=20, partitions=3), KEYED])
def test_lagged_correlations_cross_chunks_and_batches(spark, layout):
    """Series longer than a chunk, batches shorter than a lag."""
    rng = np.random.default_rng(5)
    rows = []
    for s, n in (("hot", 137), ("b", 21), ("c", 3), ("d", 1)):
        for t in range(n):
            v = rng.normal(size=3).tolist()
            rows.append((s, t, len(rows), None if t % 11 == 4 else v[0], v[1],
                         None if t % 7 == 2 else v[2]))
    df = spark.createDataFrame(rows, "s string, t int, event_id long, x double, y double, z double")
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 5)
    try:
        got = {r["lag"]: r for r in stats.lagged_xcorr(
            df.repartition(4), "x", ["y", "z"], 14, "s", ["t", "event_id"], layout).collect()}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    pdf = df.toPandas()
    assert set(got) == set(range(-14, 15))
    for lag, row in got.items():
        for y in "yz":
            shifted = pdf.groupby("s")[y].shift(-lag)
            assert row[f"xcorr_{y}"] == pytest.approx(pdf["x"].corr(shifted), abs=1e-12)


def test_lags_without_pairs_are_null(spark):
    df = spark.createDataFrame([("s", 1, 1, 2.0, 3.0), ("s", 2, 2, 4.0, 1.0)],
                               "s string, t int, event_id long, x double, y double")
    got = {r["lag"]: r["xcorr_y"] for r in stats.lagged_xcorr(
        df, "x", ["y"], 3, "s", ["t", "event_id"]).collect()}
    assert got[0] == pytest.approx(-1.0) and got[1] is None and got[-3] is None
    assert math.isfinite(got[0])
