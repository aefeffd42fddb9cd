"""Registered projection queries: P1–P14 column functions and R1–R6 risk scores."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from helio.functions import exprs as X
from helio.operators import alerts, risk
from helio.plans.q_alerts import HITS_CTES, SEVERITY_OF_LEVEL_CASE, metrics_long_cte
from helio.plans.registry import register, round_sql, sql_str, with_obs
from helio.schema import (AURORA_REGIONS, INSIGHT_CALM, INSIGHT_EXTREME, INSIGHT_GPS,
                          INSIGHT_SAT, INSIGHT_SEVERITY_PREFIX, INSIGHT_STORM, INSIGHT_WIND,
                          MISSION_SYSTEMS)
from helio.sources.observations import observations


def round2_sql(x: str) -> str:
    return round_sql(x, 2)


def obs(spark, sf_dir):
    return observations(spark, sf_dir)


# -- P1–P3 ---------------------------------------------------------------------

@register("classify_flare", with_obs(
    """select event_id, flare_intensity,
  case when flare_intensity < 1 then 'A' when flare_intensity < 2 then 'B'
       when flare_intensity < 3 then 'C' when flare_intensity < 4 then 'M' else 'X' end as flare_class
from obs"""))
def q_classify_flare(spark: SparkSession, sf_dir: str) -> DataFrame:
    return obs(spark, sf_dir).select("event_id", "flare_intensity",
                                     X.classify_flare("flare_intensity").alias("flare_class"))


_SEV = ("case when {c} < 3 then 'Low' when {c} < 5 then 'Moderate' when {c} < 7 then 'High' "
        "else 'Extreme' end")


@register("severity_label", with_obs(
    f"""select event_id, kp_raw, kp_index, {_SEV.format(c='kp_raw')} as severity_raw,
  {_SEV.format(c='kp_index')} as severity_kp from obs"""))
def q_severity_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    return obs(spark, sf_dir).select("event_id", "kp_raw", "kp_index",
                                     X.severity_label("kp_raw").alias("severity_raw"),
                                     X.severity_label("kp_index").alias("severity_kp"))


@register("storm_flag", with_obs(
    """select event_id, kp_raw, kp_index, cast(coalesce(kp_raw >= 5, false) as integer) as storm_raw,
  cast(coalesce(kp_index >= 5, false) as integer) as storm_kp from obs"""))
def q_storm_flag(spark: SparkSession, sf_dir: str) -> DataFrame:
    return obs(spark, sf_dir).select("event_id", "kp_raw", "kp_index",
                                     X.storm_flag("kp_raw").alias("storm_raw"),
                                     X.storm_flag("kp_index").alias("storm_kp"))


# -- P4, P5, P6 ----------------------------------------------------------------

@register("flare_intensity", with_obs(
    "select event_id, xray_flux, round(log10(xray_flux + 1e-9) + 9, 3) as flare_intensity_x "
    "from obs"))
def q_flare_intensity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return obs(spark, sf_dir).select("event_id", "xray_flux",
                                     X.flare_intensity("xray_flux").alias("flare_intensity_x"))


@register("bounded", with_obs(
    """select event_id,
  case when imf_bz is null then null else greatest(-10e0, least(10e0, imf_bz)) end as bz_clipped,
  case when solar_wind_speed is null then null
       else greatest(300e0, least(700e0, solar_wind_speed)) end as wind_clipped,
  case when dst_index is null then null else least(0e0, dst_index) end as dst_capped
from obs"""))
def q_bounded(spark: SparkSession, sf_dir: str) -> DataFrame:
    return obs(spark, sf_dir).select("event_id",
                                     X.clip("imf_bz", -10.0, 10.0).alias("bz_clipped"),
                                     X.clip("solar_wind_speed", 300.0, 700.0).alias("wind_clipped"),
                                     X.clip("dst_index", hi=0.0).alias("dst_capped"))


@register("encode_categories", with_obs(
    """select event_id, flare_class, severity,
  cast(coalesce(case flare_class when 'A' then 0 when 'B' then 1 when 'C' then 2 when 'M' then 3
                                 when 'X' then 4 end, 0) as integer) as flare_class_enc,
  cast(coalesce(case severity when 'Low' then 0 when 'Moderate' then 1 when 'High' then 2
                              when 'Extreme' then 3 end, 0) as integer) as severity_enc
from obs"""))
def q_encode_categories(spark: SparkSession, sf_dir: str) -> DataFrame:
    return obs(spark, sf_dir).select("event_id", "flare_class", "severity",
                                     X.flare_class_code("flare_class").alias("flare_class_enc"),
                                     X.severity_code("severity").alias("severity_enc"))


# -- P7 safe_float on text columns of the driver's tables --------------------------

@register("safe_float",
          """select event_id, props, event_type,
  coalesce(try_cast(regexp_replace(props, '[^0-9.\\-]', '', 'g') as double), 0e0) as props_num,
  coalesce(try_cast(regexp_replace(event_type, '[^0-9.\\-]', '', 'g') as double), 0e0) as type_num,
  coalesce(try_cast(regexp_replace(cast(user_id as varchar) || 'P', '[^0-9.\\-]', '', 'g')
                    as double), 0e0) as user_num
from events""")
def q_safe_float(spark: SparkSession, sf_dir: str) -> DataFrame:
    from helio.sources.observations import table
    ev = table(spark, sf_dir, "events")
    return ev.select("event_id", "props", "event_type",
                     X.safe_float("props").alias("props_num"),
                     X.safe_float("event_type").alias("type_num"),
                     X.safe_float(F.concat(F.col("user_id").cast("string"), F.lit("P")))
                     .alias("user_num"))


# -- P8–P10 --------------------------------------------------------------------

@register("time_features", with_obs(
    """select event_id, timestamp, cast(dayofyear(timestamp) as integer) as day_of_year,
  cast(month(timestamp) as integer) as month, cast(year(timestamp) as integer) as year,
  round(sin(2 * pi() * dayofyear(timestamp) / 365e0), 6) as day_sin,
  round(cos(2 * pi() * dayofyear(timestamp) / 365e0), 6) as day_cos
from obs"""))
def q_time_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = X.time_features("timestamp")
    return obs(spark, sf_dir).select(
        "event_id", "timestamp", f["day_of_year"].alias("day_of_year"),
        f["month"].alias("month"), f["year"].alias("year"),
        X.round6(f["day_sin"]).alias("day_sin"), X.round6(f["day_cos"]).alias("day_cos"))


@register("interactions", with_obs(
    """select event_id,
  round(solar_wind_speed * (case when imf_bz is null then null else greatest(-imf_bz, 0e0) end), 6)
    as wind_bz_interaction,
  round(pow(solar_wind_speed, 2) * solar_wind_density, 6) as storm_energy,
  round(cast(case flare_class when 'A' then 0 when 'B' then 1 when 'C' then 2 when 'M' then 3
                              when 'X' then 4 else 0 end as double) * kp_index, 6)
    as flare_kp_interaction,
  case when imf_bz is null then null else greatest(-imf_bz, 0e0) end as southward_bz
from obs"""))
def q_interactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = obs(spark, sf_dir).withColumn("flare_class_enc", X.flare_class_code("flare_class"))
    f = X.interactions()
    return o.select("event_id",
                    X.round6(f["wind_bz_interaction"]).alias("wind_bz_interaction"),
                    X.round6(f["storm_energy"]).alias("storm_energy"),
                    X.round6(f["flare_kp_interaction"]).alias("flare_kp_interaction"),
                    f["southward_bz"].alias("southward_bz"))


@register("log_features", with_obs(
    """select event_id, round(ln(1 + xray_flux), 6) as log_xray_flux,
  round(ln(1 + proton_flux), 6) as log_proton_flux from obs"""))
def q_log_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = X.log_features(["xray_flux", "proton_flux"])
    return obs(spark, sf_dir).select("event_id", *[X.round6(v).alias(k) for k, v in f.items()])


# -- P12 parse + sort ------------------------------------------------------------

@register("parse_sort", with_obs(
    """select event_id, time_text, try_strptime(time_text, '%Y-%m-%d %H:%M:%S') as parsed_ts
from (select event_id, strftime(timestamp, '%Y-%m-%d %H:%M:%S') as time_text from obs) s
order by parsed_ts, event_id"""))
def q_parse_sort(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = obs(spark, sf_dir).select(
        "event_id", F.date_format("timestamp", "yyyy-MM-dd HH:mm:ss").alias("time_text"))
    parsed = o.withColumn("parsed_ts", F.try_to_timestamp("time_text",
                                                          F.lit("yyyy-MM-dd HH:mm:ss")))
    return parsed.orderBy("parsed_ts", "event_id")


# -- P13, P14 --------------------------------------------------------------------

@register("display_labels", with_obs(
    """select event_id, metric,
  array_to_string(list_transform(string_split(replace(metric, '_', ' '), ' '),
                  lambda w: upper(w[1]) || lower(w[2:])), ' ') as label,
  coalesce(printf('%.2f', value), 'nan') as value_text
from m""", metrics_long_cte()))
def q_display_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    from helio.schema import ALERT_METRICS
    o = obs(spark, sf_dir)
    long = o.select("event_id", F.inline(F.array(*[
        F.struct(F.lit(m).alias("metric"), F.col(m).alias("value")) for m in ALERT_METRICS])))
    return long.select("event_id", "metric", X.display_label("metric").alias("label"),
                       F.when(F.col("value").isNotNull(), X.fixed_decimals("value"))
                       .otherwise(F.lit("nan")).alias("value_text"))


@register("bubble_size", with_obs(
    "select event_id, abs(coalesce(solar_wind_speed, 1e0)) as bubble_size from obs"))
def q_bubble_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    return obs(spark, sf_dir).select("event_id", X.bubble_size("solar_wind_speed")
                                     .alias("bubble_size"))


# -- R1–R3 -----------------------------------------------------------------------

_COMPOSITE_SQL = """case when raw is null then null else greatest(0e0, least(100e0, raw)) end"""


@register("composite_risk", with_obs(
    f"""select event_id, round({_COMPOSITE_SQL}, 6) as composite_risk from (
  select event_id, 0e0 + 0.30 * (kp_index / 9e0 * 100e0) + 0.25 * satellite_disruption_risk
         + 0.20 * gps_blackout_prob + 0.15 * ((solar_wind_speed - 280e0) / 620e0 * 100e0)
         + 0.10 * (flare_intensity / 5e0 * 100e0) as raw from obs) s"""))
def q_composite_risk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return obs(spark, sf_dir).select("event_id",
                                     X.round6(risk.composite_risk_expr()).alias("composite_risk"))


@register("mission_risk", with_obs(
    """select event_id, round(score, 6) as mission_score,
  case when score >= 80 then 'EXTREME' when score >= 60 then 'HIGH'
       when score >= 40 then 'MODERATE' else 'LOW' end as mission_level,
  case when score >= 80 then 'red' when score >= 60 then 'orange'
       when score >= 40 then 'yellow' else 'green' end as mission_color
from (select event_id, case when raw is null then null else least(raw, 100e0) end as score
      from (select event_id, kp_index * 8 + solar_wind_speed / 30e0 + gps_blackout_prob * 0.9
                   + satellite_disruption_risk * 1.1 as raw from obs) a) b"""))
def q_mission_risk(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = risk.mission_risk(obs(spark, sf_dir))
    return r.select("event_id", X.round6("mission_score").alias("mission_score"),
                    "mission_level", "mission_color")


@register("satellite_failure", with_obs(
    f"""select event_id, score as failure_score,
  case when score < 30 then 'Low' when score < 55 then 'Moderate' when score < 75 then 'High'
       else 'Extreme' end as failure_level
from (select event_id,
        {round2_sql("coalesce(case when raw is null then null else greatest(0e0, least(100e0, raw)) end, 0e0)")}
        as score
      from (select event_id, kp_index * 8
                   + (case when solar_wind_speed is null then null
                           else least(solar_wind_speed / 900e0, 1e0) end) * 25
                   + gps_blackout_prob * 0.35 + satellite_disruption_risk * 0.45 as raw
            from obs) a) b"""))
def q_satellite_failure(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = risk.satellite_failure(obs(spark, sf_dir))
    return r.select("event_id", "failure_score", "failure_level")


# -- R4–R6 -----------------------------------------------------------------------

_SYSTEMS_VALUES = ", ".join(f"({i + 1}, {sql_str(s)})" for i, s in enumerate(MISSION_SYSTEMS))


@register("mission_systems", with_obs(
    f"""select event_id, system_no, system,
  case when system_no = 4 then (case when kp_index > 6 then 'HIGH' else 'MODERATE' end)
       when system_no = 5 and kp_index > 8 then 'EXTREME'
       else level end as risk_level
from (select event_id, kp_index,
        case when score >= 80 then 'EXTREME' when score >= 60 then 'HIGH'
             when score >= 40 then 'MODERATE' else 'LOW' end as level
      from (select event_id, kp_index,
              case when raw is null then null else least(raw, 100e0) end as score
            from (select event_id, kp_index, kp_index * 8 + solar_wind_speed / 30e0
                         + gps_blackout_prob * 0.9 + satellite_disruption_risk * 1.1 as raw
                  from obs) a) b) o
cross join (values {_SYSTEMS_VALUES}) s(system_no, system)"""))
def q_mission_systems(spark: SparkSession, sf_dir: str) -> DataFrame:
    return risk.mission_systems(obs(spark, sf_dir))


_REGION_VALUES = ", ".join(f"({i + 1}, {sql_str(r)})" for i, r in enumerate(AURORA_REGIONS))


@register("aurora_visibility", with_obs(
    f"""select event_id, region_no, region, visibility,
  row_number() over (partition by event_id order by visibility desc, region_no) = 1 as is_best
from (select o.event_id, r.region_no, r.region,
        least(100e0, o.kp_index * 10 + (5 + ((o.event_id * 31 + r.region_no * 17) % 20))) as visibility
      from obs o cross join (values {_REGION_VALUES}) r(region_no, region)) v"""))
def q_aurora_visibility(spark: SparkSession, sf_dir: str) -> DataFrame:
    return risk.aurora_visibility(obs(spark, sf_dir))


def _insight_sql() -> str:
    return f"""concat_ws(' ',
    case when kp_index >= 7 then {sql_str(INSIGHT_EXTREME)}
         when kp_index >= 5 then {sql_str(INSIGHT_STORM)} else {sql_str(INSIGHT_CALM)} end,
    case when solar_wind_speed > 650 then {sql_str(INSIGHT_WIND)} end,
    case when gps_blackout_prob > 60 then {sql_str(INSIGHT_GPS)} end,
    case when satellite_disruption_risk > 60 then {sql_str(INSIGHT_SAT)} end,
    {sql_str(INSIGHT_SEVERITY_PREFIX)} || overall_severity || '.')"""


@register("insight_text", with_obs(
    f"""select event_id, overall_severity, {_insight_sql()} as insight
from (select o.*, {SEVERITY_OF_LEVEL_CASE} as overall_severity
      from (select o.*, t.top_level_rank from obs o
            left join (select event_id, max(level_rank) as top_level_rank from hits
                       group by event_id) t on o.event_id = t.event_id) o) s""", HITS_CTES))
def q_insight_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = alerts.with_overall_severity(obs(spark, sf_dir))
    return o.select("event_id", "overall_severity",
                    risk.insight_expr(F.col("overall_severity")).alias("insight"))
