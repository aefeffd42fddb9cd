"""Registered queries (one per SURVEY §2 key) with their DuckDB oracle texts.

Floats that go through engine-dependent summation (avg, stddev, corr, sums of
products) are rounded to 6 places on both sides.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from helio.operators import alerts, risk
from helio.plans.registry import register, sql_num, sql_str, with_obs
from helio.schema import ALERT_METRICS, LEVEL_RANK, LEVEL_TO_SEVERITY, THRESHOLDS
from helio.sources.observations import observations


def thresholds_cte() -> str:
    rows = []
    for i, m in enumerate(ALERT_METRICS):
        for thr, level, msg in THRESHOLDS[m]:
            rows.append(f"({i}, {sql_str(m)}, {sql_num(thr)}, {sql_str(level)}, "
                        f"{LEVEL_RANK[level]}, {sql_str(msg)})")
    return ("th(metric_no, metric, threshold, level, level_rank, message) as (values\n  "
            + ",\n  ".join(rows) + ")")


def metrics_long_cte(cols=ALERT_METRICS, src="obs") -> str:
    parts = [f"select event_id, series_id, timestamp, {i} as metric_no, {sql_str(m)} as metric, "
             f"{m} as value from {src}" for i, m in enumerate(cols)]
    return "m as (\n  " + "\n  union all ".join(parts) + ")"


# Per (observation, metric): the crossed threshold with the highest value.
HITS_CTES = metrics_long_cte() + ",\n" + thresholds_cte() + """,
hits as (
  select * from (
    select m.event_id, m.series_id, m.timestamp, m.metric_no, m.metric, th.level, th.level_rank,
           th.message, round(m.value, 2) as value, th.threshold,
           row_number() over (partition by m.event_id, m.metric_no
                              order by th.threshold desc) as pick
    from m join th on m.metric_no = th.metric_no and m.value >= th.threshold) x
  where pick = 1)"""

SEVERITY_OF_LEVEL_CASE = "case top_level_rank " + " ".join(
    f"when {LEVEL_RANK[lvl]} then {sql_str(sev)}" for lvl, sev in LEVEL_TO_SEVERITY.items()
) + " else 'Low' end"


# ---------------------------------------------------------------------------
# The observation table itself
# ---------------------------------------------------------------------------

@register("scan_observations", with_obs("select * from obs"))
def q_scan_observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return observations(spark, sf_dir)


# ---------------------------------------------------------------------------
# L1–L3
# ---------------------------------------------------------------------------

@register("threshold_alerts", with_obs(
    "select event_id, series_id, timestamp, metric_no, metric, level, level_rank, message, "
    "value, threshold from hits", HITS_CTES))
def q_threshold_alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alerts.threshold_alerts(observations(spark, sf_dir)).drop("alert_rank")


@register("alert_ranking", with_obs(
    """select event_id, series_id, timestamp, metric_no, metric, level, level_rank, message,
       value, threshold,
       row_number() over (partition by event_id order by level_rank desc, metric_no) as alert_rank
from hits""", HITS_CTES))
def q_alert_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alerts.threshold_alerts(observations(spark, sf_dir))


@register("overall_severity", with_obs(
    f"""select event_id, series_id, timestamp, top_level_rank, alert_count,
       {SEVERITY_OF_LEVEL_CASE} as overall_severity
from (select o.event_id, o.series_id, o.timestamp, max(h.level_rank) as top_level_rank,
             cast(count(h.level_rank) as integer) as alert_count
      from obs o left join hits h on o.event_id = h.event_id
      group by o.event_id, o.series_id, o.timestamp) s""", HITS_CTES))
def q_overall_severity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alerts.overall_severity(observations(spark, sf_dir))
