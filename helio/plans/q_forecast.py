"""Registered C1–C4 forecasts and R9 storm replay windows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from helio.operators import forecast as C
from helio.operators import risk, select
from helio.plans.registry import register, round_sql, with_obs
from helio.sources.observations import observations

TAIL = ("tl as (select *, row_number() over (partition by series_id "
        "order by timestamp desc, event_id desc) as pos from obs)")
METRICS = list(C.TREND_METRICS)


def _nan_avg_sql(c: str, n: int) -> str:
    return (f"case when count(case when pos <= {n} then 1 end) = "
            f"count(case when pos <= {n} then {c} end) "
            f"then avg(case when pos <= {n} then {c} end) end")


def _clip_sql(x: str, lo: str, hi: str) -> str:
    return f"case when ({x}) is null or ({lo}) is null or ({hi}) is null then null " \
           f"else least(greatest({x}, {lo}), {hi}) end"


@register("mean_forecast_48h", with_obs(
    f"""select series_id, h, last_ts + to_hours(h) as timestamp,
  {round_sql(_clip_sql('kp', '0e0', '9e0'), 2)} as predicted_kp_index,
  {round_sql(_clip_sql('sat', '0e0', '100e0'), 2)} as predicted_satellite_risk,
  {round_sql(_clip_sql('gps', '0e0', '100e0'), 2)} as predicted_gps_risk
from (select series_id, max(timestamp) as last_ts, avg(kp_index) as kp,
             avg(satellite_disruption_risk) as sat, avg(gps_blackout_prob) as gps
      from tl where pos <= 30 group by series_id) b
cross join (select range as h from range(1, 49)) hh""", TAIL))
def q_mean_forecast(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.mean_forecast_48h(observations(spark, sf_dir))


def _trend_base_sql() -> str:
    parts = []
    for m in METRICS:
        parts += [f"{_nan_avg_sql(m, 7)} as {m}_m7", f"{_nan_avg_sql(m, 30)} as {m}_m30",
                  f"max(case when pos = 1 then {m} end) as {m}_last",
                  f"case when count({m}) = count(*) then max({m}) end as {m}_max"]
    return ("tb as (select series_id, max(timestamp) as last_ts, " + ", ".join(parts)
            + " from tl where pos <= 90 group by series_id)")


def _trend_sel(rounded: bool = True) -> str:
    cols = []
    for m in METRICS:
        x = f"{m}_last + h * (({m}_m7 - {m}_m30) / 23e0)"
        v = _clip_sql(x, "0e0", f"{m}_max * 1.1")
        cols.append(f"{round_sql(v) if rounded else v} as forecast_{m}")
    return ", ".join(cols)


TREND_CTES = TAIL + ",\n" + _trend_base_sql() + f""",
fc as (select series_id, h, last_ts + to_hours(h) as timestamp, {_trend_sel(False)}
       from tb cross join (select range as h from range(1, 49)) hh)"""


@register("trend_forecast_48h", with_obs(
    "select series_id, h, timestamp, " + ", ".join(
        f"{round_sql(f'forecast_{m}')} as forecast_{m}" for m in METRICS) + " from fc",
    TREND_CTES))
def q_trend_forecast(spark: SparkSession, sf_dir: str) -> DataFrame:
    fc = C.trend_forecast_48h(observations(spark, sf_dir))
    return fc.select("series_id", "h", "timestamp",
                     *[F.round(f"forecast_{m}", 6).alias(f"forecast_{m}") for m in METRICS])


@register("two_step_trend", with_obs(
    f"""select series_id, step, {round_sql('last_v + step * ((last_v - first_v) / n)')} as forecast_kp_index
from (select series_id, arg_max(kp_index, pos) as first_v, arg_min(kp_index, pos) as last_v,
             count(*) as n from tl where pos <= 14 group by series_id) b
cross join (select range as step from range(1, 3)) s""", TAIL))
def q_two_step_trend(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = C.two_step_trend(observations(spark, sf_dir))
    return out.select("series_id", F.col("step").cast("long").alias("step"),
                      F.round("forecast_kp_index", 6).alias("forecast_kp_index"))


def _peak_case(x: str, cuts) -> str:
    return "case " + " ".join(f"when {x} >= {c} then '{lbl}'" for c, lbl in cuts) + " else 'Low' end"


@register("forecast_peaks", with_obs(
    f"""select series_id, {", ".join(f"{round_sql(f'max_{m}')} as max_{m}" for m in METRICS)},
  {_peak_case('max_kp_index', [(7, 'Extreme'), (5, 'High'), (3, 'Moderate'), (0, 'Low')])} as kp_severity,
  {_peak_case('max_satellite_disruption_risk', [(80, 'Extreme'), (60, 'High'), (40, 'Moderate'), (0, 'Low')])} as sat_severity,
  case when max_kp_index is not null then
    least(100, cast(trunc(max_kp_index / 9e0 * 100e0) as integer)) end as storm_probability
from (select series_id, {", ".join(f"max(forecast_{m}) as max_{m}" for m in METRICS)}
      from fc group by series_id) p""", TREND_CTES))
def q_forecast_peaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    pk = C.forecast_peaks(C.trend_forecast_48h(observations(spark, sf_dir)))
    return pk.select("series_id", *[F.round(f"max_{m}", 6).alias(f"max_{m}") for m in METRICS],
                     "kp_severity", "sat_severity", "storm_probability")


_PERIODS_CTE = """rn_obs as (select *, row_number() over (partition by series_id order by timestamp, event_id) as rn from obs),
isl as (select *, rn - row_number() over (partition by series_id order by rn) as island
        from rn_obs where kp_index >= 5),
periods as (select series_id, row_number() over (partition by series_id order by min(rn)) as period_no,
                   arg_min(timestamp, struct_pack(k := -kp_index, r := rn)) as peak_ts
            from isl group by series_id, island)"""


@register("replay_window", with_obs(
    """select p.series_id, p.period_no, p.peak_ts, o.timestamp,
  cast(floor((epoch_us(o.timestamp) - epoch_us(p.peak_ts - interval 36 hour)) / 3600000000e0) as integer) as hour,
  o.kp_index, o.satellite_disruption_risk, o.gps_blackout_prob
from periods p join obs o on o.series_id = p.series_id
  and o.timestamp >= p.peak_ts - interval 36 hour and o.timestamp < p.peak_ts + interval 36 hour""",
    _PERIODS_CTE))
def q_replay_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = observations(spark, sf_dir)
    peaks = select.storm_periods(o)
    return risk.replay_window(o, peaks)


@register("peak_severity", with_obs(
    f"""select series_id, max_kp, max_sat,
  {_peak_case('max_kp', [(7, 'Extreme'), (5, 'High'), (3, 'Moderate'), (0, 'Low')])} as kp_severity,
  {_peak_case('max_sat', [(80, 'Extreme'), (60, 'High'), (40, 'Moderate'), (0, 'Low')])} as sat_severity
from (select series_id, max(kp_index) as max_kp, max(satellite_disruption_risk) as max_sat
      from obs group by series_id) p"""))
def q_peak_severity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """R7 on the observed peaks of each series."""
    from helio.schema import PEAK_KP_CUTS, PEAK_SAT_CUTS
    pk = observations(spark, sf_dir).groupBy("series_id").agg(
        F.max("kp_index").alias("max_kp"), F.max("satellite_disruption_risk").alias("max_sat"))
    return pk.select("series_id", "max_kp", "max_sat",
                     risk.peak_label_expr(F.col("max_kp"), PEAK_KP_CUTS).alias("kp_severity"),
                     risk.peak_label_expr(F.col("max_sat"), PEAK_SAT_CUTS).alias("sat_severity"))


@register("storm_probability", with_obs(
    """select series_id, max_kp,
  case when max_kp is not null then
    least(100, cast(trunc(max_kp / 9e0 * 100e0) as integer)) end as storm_probability
from (select series_id, max(kp_index) as max_kp from obs group by series_id) p"""))
def q_storm_probability(spark: SparkSession, sf_dir: str) -> DataFrame:
    """R8 on the observed Kp peak of each series (jitter 0)."""
    pk = observations(spark, sf_dir).groupBy("series_id").agg(F.max("kp_index").alias("max_kp"))
    return pk.select("series_id", "max_kp",
                     risk.storm_probability_expr(F.col("max_kp")).alias("storm_probability"))
