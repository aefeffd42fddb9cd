"""L1–L3: threshold alerts over every observation.

The threshold table is tiny and fixed (5 metrics x 4 levels), so it is compiled
into per-metric CASE expressions instead of being joined: scoring a row is a
projection, there is no join and no shuffle, and the work stays inside one
whole-stage-codegen span no matter how large the table grows.  The per-row
ranking (L2) is a sum of comparisons between the row's ≤5 alert ranks, so it
needs no window and no repartitioning either.  A missing reading compares as
unknown and raises nothing.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from helio.schema import (ALERT_METRICS, LEVEL_RANK, LEVEL_TO_SEVERITY, SEVERITY_LABELS,
                          THRESHOLDS)

KEYS = ("event_id", "series_id", "timestamp")


def _level_rank_case(metric: str) -> Column:
    v = F.col(metric)
    expr = None
    for thr, level, _ in THRESHOLDS[metric]:
        cond = v >= F.lit(float(thr))
        r = F.lit(LEVEL_RANK[level])
        expr = F.when(cond, r) if expr is None else expr.when(cond, r)
    return expr


def threshold_alerts(df: DataFrame, metrics: Sequence[str] = ALERT_METRICS,
                     keys: Sequence[str] = KEYS) -> DataFrame:
    """L1 + L2: one row per (observation, metric) with a crossed threshold.

    Columns: keys, ``metric_no``, ``metric``, ``level``, ``level_rank``,
    ``message``, ``value`` (rounded to 2), ``threshold`` and ``alert_rank``
    (1 = most severe in the observation; ties kept in metric order).
    Fan-out is bounded: at most ``len(metrics)`` rows per observation.

    Each metric's crossed level is one CASE column (its rank); level name,
    message and threshold are array lookups by that rank, and the in-row
    ranking is a sum of comparisons — plain codegen'd arithmetic, no
    higher-order functions, no window.
    """
    metrics = [m for m in metrics if m in THRESHOLDS]
    ranked = df.select(*keys, *[F.col(m).alias(f"_v{i}") for i, m in enumerate(metrics)],
                       *[_level_rank_case(m).alias(f"_r{i}") for i, m in enumerate(metrics)])
    by_rank = sorted(LEVEL_RANK.items(), key=lambda kv: kv[1])
    level_names = F.array(*[F.lit(lvl) for lvl, _ in by_rank])
    elems = []
    for i, m in enumerate(metrics):
        r = F.col(f"_r{i}")
        per_level = {lvl: (thr, msg) for thr, lvl, msg in THRESHOLDS[m]}
        msgs = F.array(*[F.lit(per_level[lvl][1]) for lvl, _ in by_rank])
        thrs = F.array(*[F.lit(float(per_level[lvl][0])) for lvl, _ in by_rank])
        ahead = [F.when(F.col(f"_r{j}").isNotNull() & (
            (F.col(f"_r{j}") > r) | ((F.col(f"_r{j}") == r) & F.lit(j < i))), 1).otherwise(0)
            for j in range(len(metrics)) if j != i]
        pos = F.lit(1) + sum(ahead, F.lit(0))
        elems.append(F.when(r.isNotNull(), F.struct(
            F.lit(i).alias("metric_no"), F.lit(m).alias("metric"),
            F.get(level_names, r).alias("level"), r.alias("level_rank"),
            F.get(msgs, r).alias("message"), F.round(F.col(f"_v{i}"), 2).alias("value"),
            F.get(thrs, r).alias("threshold"), pos.alias("alert_rank"))))
    out = ranked.select(*keys, F.inline(F.array(*elems)))
    return out.where(F.col("metric_no").isNotNull())


def top_level_rank(metrics: Sequence[str] = ALERT_METRICS) -> Column:
    """Highest alert level rank in the row (NULL when nothing is crossed)."""
    ranks = [_level_rank_case(m) for m in metrics if m in THRESHOLDS]
    return F.greatest(*ranks) if len(ranks) > 1 else ranks[0]


def alert_count(metrics: Sequence[str] = ALERT_METRICS) -> Column:
    return sum((_level_rank_case(m).isNotNull().cast("int") for m in metrics
                if m in THRESHOLDS), F.lit(0))


def severity_of_rank(rank: Column) -> Column:
    """Top level rank -> Low/Moderate/High/Extreme (no alert -> Low)."""
    labels = [LEVEL_TO_SEVERITY[lvl] for lvl, _ in sorted(LEVEL_RANK.items(), key=lambda kv: kv[1])]
    arr = F.array(*[F.lit(s) for s in labels])
    return F.coalesce(F.get(arr, rank), F.lit(SEVERITY_LABELS[0]))


def overall_severity(df: DataFrame, metrics: Sequence[str] = ALERT_METRICS,
                     keys: Sequence[str] = KEYS) -> DataFrame:
    """L3: overall severity per observation from its most severe alert."""
    top = top_level_rank(metrics)
    return df.select(*keys, top.alias("top_level_rank"),
                     alert_count(metrics).alias("alert_count"),
                     severity_of_rank(top).alias("overall_severity"))


def with_overall_severity(df: DataFrame, name: str = "overall_severity") -> DataFrame:
    return df.withColumn(name, severity_of_rank(top_level_rank()))
