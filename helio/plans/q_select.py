"""Registered K1–K8 (latest, tails, storm filters/periods, samples) and A9."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from helio.operators import select as K
from helio.plans.registry import register, with_obs
from helio.sources.observations import observations

W_SERIES_DESC = "partition by series_id order by timestamp desc, event_id desc"
W_SERIES = "partition by series_id order by timestamp, event_id"


@register("latest_observation", with_obs(
    f"""select * exclude (pick) from (
  select *, row_number() over ({W_SERIES_DESC}) as pick from obs) s where pick = 1"""))
def q_latest_observation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.latest_observation(observations(spark, sf_dir))


@register("tail_n", with_obs(
    f"""select * from (
  select *, row_number() over ({W_SERIES_DESC}) as pos from obs) s where pos <= 30"""))
def q_tail_n(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.tail_n(observations(spark, sf_dir), 30)


@register("storm_days", with_obs(
    """select count_if(kp_index >= 5) as storm_rows, count(*) as total_rows,
  count_if(kp_index >= 5) / count(*) as storm_rate from obs"""))
def q_storm_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.storm_days(observations(spark, sf_dir))


@register("storm_periods", with_obs(
    f"""select series_id,
  row_number() over (partition by series_id order by min(rn)) as period_no,
  min(timestamp) as start_ts, max(timestamp) as end_ts, count(*) as rows, max(kp_index) as peak_kp,
  arg_min(timestamp, struct_pack(k := -kp_index, r := rn)) as peak_ts
from (select *, rn - row_number() over (partition by series_id order by rn) as island
      from (select *, row_number() over ({W_SERIES}) as rn from obs) a
      where kp_index >= 5) b
group by series_id, island"""))
def q_storm_periods(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.storm_periods(observations(spark, sf_dir))


@register("dst_severe", with_obs(
    "select *, dst_index <= -100 as severe from obs where dst_index <= -50"))
def q_dst_severe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.dst_severe(observations(spark, sf_dir))


@register("drop_incomplete", with_obs(
    "select * from obs where solar_wind_speed is not null and imf_bz is not null "
    "and xray_flux is not null and proton_flux is not null and dst_index is not null"))
def q_drop_incomplete(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.drop_incomplete(observations(spark, sf_dir))


@register("sample_500", with_obs(
    "select * from obs order by md5(cast(event_id as varchar) || '-42'), event_id limit 500"))
def q_sample_500(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.sample_n(observations(spark, sf_dir), 500, 42)


@register("newest_first_preview", with_obs(
    "select * from obs order by timestamp desc, event_id desc limit 50"))
def q_newest_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.newest_first(observations(spark, sf_dir), 50)


@register("risk_over_time", with_obs(
    f"""select series_id, event_id, timestamp, satellite_disruption_risk, gps_blackout_prob,
  satellite_disruption_risk between 70 and 100 as sat_in_band,
  gps_blackout_prob between 70 and 100 as gps_in_band
from (select *, row_number() over ({W_SERIES_DESC}) as pos from obs) s where pos <= 90"""))
def q_risk_over_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both risks over the recent rows of each series, flagged in the 70–100 band."""
    t = K.tail_n(observations(spark, sf_dir), 90)
    return t.select("series_id", "event_id", "timestamp", "satellite_disruption_risk",
                    "gps_blackout_prob",
                    F.col("satellite_disruption_risk").between(70, 100).alias("sat_in_band"),
                    F.col("gps_blackout_prob").between(70, 100).alias("gps_in_band"))
