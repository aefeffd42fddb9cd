"""Registered A1–A8 and A10 summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from helio.operators import stats as A
from helio.plans.registry import register, round_sql, sql_str, with_obs
from helio.schema import FLARE_CLASSES, NUMERIC_COLUMNS, SEVERITY_LABELS
from helio.sources.observations import observations


def _long_sql(cols, src="obs", keep="") -> str:
    k = f"{keep}, " if keep else ""
    return "\n  union all ".join(
        f"select {k}{sql_str(c)} as feature, cast({c} as double) as value from {src}" for c in cols)


def _r(x, n=6):
    return round_sql(x, n)


@register("describe", with_obs(
    f"""select feature, count(value) as count, {_r('avg(value)', 2)} as mean,
  {_r('stddev_samp(value)', 2)} as std, {_r('min(value)', 2)} as min,
  {_r('quantile_cont(value, 0.25)', 2)} as p25, {_r('quantile_cont(value, 0.5)', 2)} as p50,
  {_r('quantile_cont(value, 0.75)', 2)} as p75, {_r('max(value)', 2)} as max
from ({_long_sql(NUMERIC_COLUMNS)}) l group by feature"""))
def q_describe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.describe(observations(spark, sf_dir), NUMERIC_COLUMNS)


def _dim_values(labels) -> str:
    return ", ".join(f"({i}, {sql_str(s)})" for i, s in enumerate(labels))


@register("severity_counts", with_obs(
    f"""select d.label_no, c.severity, c.rows,
  {_r('c.rows * 100e0 / sum(c.rows) over ()')} as share_pct
from (select severity, count(*) as rows from obs group by severity) c
left join (values {_dim_values(SEVERITY_LABELS)}) d(label_no, severity) on c.severity = d.severity"""))
def q_severity_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = A.severity_counts(observations(spark, sf_dir))
    return out.withColumn("share_pct", F.round("share_pct", 6))


@register("flare_counts", with_obs(
    "select flare_class, count(*) as rows from obs group by flare_class"))
def q_flare_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.flare_counts(observations(spark, sf_dir))


@register("storm_prob_by_flare", with_obs(
    f"""select d.label_no, d.flare_class, {_r('coalesce(p.m * 100e0, 0e0)')} as storm_prob_pct
from (values {_dim_values(FLARE_CLASSES)}) d(label_no, flare_class)
left join (select flare_class, avg(storm_flag) as m from obs group by flare_class) p
  on d.flare_class = p.flare_class"""))
def q_storm_prob_by_flare(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = A.storm_prob_by_flare(observations(spark, sf_dir))
    return out.withColumn("storm_prob_pct", F.round("storm_prob_pct", 6))


def _corr_sql() -> str:
    cols = A.CORR_COLUMNS
    cells = []
    for a in cols:
        for b in cols:
            cells.append(f"select {sql_str(a)} as col_a, {sql_str(b)} as col_b, "
                         f"{_r(f'corr({a}, {b})')} as corr from obs")
    return "\nunion all ".join(cells)


@register("correlation_matrix", with_obs(_corr_sql()))
def q_correlation_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = A.correlation_matrix(observations(spark, sf_dir))
    return out.withColumn("corr", F.round("corr", 6))


LOWER_COLUMNS = A.CORR_COLUMNS[:10]


def _corr_lower_sql() -> str:
    cols = LOWER_COLUMNS
    return "\nunion all ".join(
        f"select {sql_str(cols[i])} as col_a, {sql_str(cols[j])} as col_b, "
        f"{_r(f'corr({cols[i]}, {cols[j]})')} as corr from obs"
        for i in range(len(cols)) for j in range(i))


@register("correlation_lower", with_obs(_corr_lower_sql()))
def q_correlation_lower(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A5, 10-column form: the strict lower triangle (45 cells)."""
    out = A.correlation_matrix(observations(spark, sf_dir), LOWER_COLUMNS, lower_only=True)
    return out.withColumn("corr", F.round("corr", 6))


@register("lagged_xcorr", with_obs(
    f"""select g.lag,
  {_r('corr(a.kp_index, b.satellite_disruption_risk)')} as xcorr_satellite_disruption_risk,
  {_r('corr(a.kp_index, b.gps_blackout_prob)')} as xcorr_gps_blackout_prob
from (select *, row_number() over (partition by series_id order by timestamp, event_id) as rn
      from obs) a
cross join (select range as lag from range(-14, 15)) g
join (select series_id, satellite_disruption_risk, gps_blackout_prob,
             row_number() over (partition by series_id order by timestamp, event_id) as rn
      from obs) b on a.series_id = b.series_id and b.rn = a.rn + g.lag
group by g.lag"""))
def q_lagged_xcorr(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = A.lagged_xcorr(observations(spark, sf_dir))
    return out.select(F.col("lag").cast("long").alias("lag"),
                      *[F.round(c, 6).alias(c) for c in out.columns if c != "lag"])


_HIST_SQL = """select h.feature, h.bin, {blo} as bin_lo, {bhi} as bin_hi,
  coalesce(c.rows, 0) as rows, {dens} as density
from (select p.*, cast(g.range as integer) as bin
      from (select feature, min(value) as lo,
                   case when max(value) > min(value) then (max(value) - min(value)) / 50e0
                        else 1e0 end as w, count(value) as n
            from ({long}) x group by feature having count(value) > 0) p,
           range(0, 50) g) h
left join (
  select l.feature, least(cast(floor((l.value - p.lo) / p.w) as integer), 49) as bin,
         count(*) as rows
  from ({long}) l
  join (select feature, min(value) as lo,
               case when max(value) > min(value) then (max(value) - min(value)) / 50e0
                    else 1e0 end as w
        from ({long}) x group by feature) p on l.feature = p.feature
  where l.value is not null group by l.feature, 2) c
  on c.feature = h.feature and c.bin = h.bin"""


@register("risk_histogram", with_obs(_HIST_SQL.format(
    blo=_r("h.lo + h.bin * h.w"), bhi=_r("h.lo + (h.bin + 1) * h.w"),
    dens=_r("coalesce(c.rows, 0) / (h.n * h.w)"),
    long=_long_sql(["satellite_disruption_risk", "gps_blackout_prob"]))))
def q_risk_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = A.risk_histogram(observations(spark, sf_dir))
    return out.select("feature", "bin", *[F.round(c, 6).alias(c) for c in
                                         ("bin_lo", "bin_hi")], "rows",
                      F.round("density", 6).alias("density"))


@register("risk_kde", with_obs(
    f"""select l.feature, g.point, {_r('p.lo + g.point * p.step')} as grid_x,
  {_r('sum(exp(-0.5 * ((p.lo + g.point * p.step - l.value) / p.h) * ((p.lo + g.point * p.step - l.value) / p.h)) * p.norm)')} as density
from ({_long_sql(["satellite_disruption_risk", "gps_blackout_prob"])}) l
join (select feature, min(value) as lo, (max(value) - min(value)) / 199e0 as step,
             pow(count(value), -0.2) * stddev_samp(value) as h,
             1e0 / (count(value) * (pow(count(value), -0.2) * stddev_samp(value)) * sqrt(2 * pi())) as norm
      from ({_long_sql(["satellite_disruption_risk", "gps_blackout_prob"])}) x group by feature) p
  on l.feature = p.feature
cross join (select range as point from range(0, 200)) g
where l.value is not null
group by l.feature, g.point, p.lo, p.step"""))
def q_risk_kde(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = A.risk_kde(observations(spark, sf_dir))
    return out.select("feature", F.col("point").cast("long").alias("point"),
                      F.round("grid_x", 6).alias("grid_x"), F.round("density", 6).alias("density"))


@register("date_range", with_obs(
    "select min(timestamp) as first_ts, max(timestamp) as last_ts, count(*) as rows, "
    "21 as columns from obs"))
def q_date_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.date_range(observations(spark, sf_dir))
