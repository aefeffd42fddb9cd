"""Registered sources and sinks: S2 round trip, S3–S7 feeds and report, R10 tracking.

Each Spark query lands feed files derived from the observation table in the
shared checkpoint folder and reads them back through the JSON source; the
oracle derives the same records in SQL and applies the same cleaning rules.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from helio.operators import alerts, risk, select
from helio.plans.q_alerts import HITS_CTES, SEVERITY_OF_LEVEL_CASE
from helio.plans.registry import register, round_sql, sql_str, with_obs
from helio.schema import (FULL_OBSERVATION_SCHEMA, ISS_ALTITUDE_KM, ISS_FALLBACK, ISS_NAME,
                          RISK_ZONES)
from helio.session import scratch_path
from helio.sources import feeds as S
from helio.sources.observations import (observations, scan_observations,
                                        scan_with_quarantine, sink_observations)

FEED = "'station-' || cast(series_id as varchar)"
TAG = "strftime(timestamp, '%Y-%m-%dT%H:%M:%S.%f')"
KP_TXT = ("cast(floor(kp_raw) as integer)::varchar || case when kp_raw - floor(kp_raw) >= "
          f"{2 / 3!r} then 'P' when kp_raw - floor(kp_raw) >= {1 / 3!r} then 'Z' else 'M' end")


def _safe(x: str) -> str:
    return f"coalesce(try_cast(regexp_replace({x}, '[^0-9.\\-]', '', 'g') as double), 0e0)"


KP_FEED_CTE = f"""kpf as (select {FEED} as feed, {TAG} as time_tag,
  case when event_id % 17 <> 0 then cast(kp_index as varchar) end as kp_index, {KP_TXT} as kp
  from obs)"""
WIND_FEED_CTE = f"""wf as (select {FEED} as feed, {TAG} as time_tag,
  cast(solar_wind_speed as varchar) || 'km/s' as speed,
  cast(solar_wind_density as varchar) as density from obs)"""


# -- S2 ----------------------------------------------------------------------------

@register("sink_observations", with_obs("select * from obs"))
def q_sink_observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S2 + S1: write the whole table as CSV and scan it back with the explicit schema."""
    path = scratch_path(spark, "observations-csv")
    obs = observations(spark, sf_dir).select(*FULL_OBSERVATION_SCHEMA.fieldNames())
    sink_observations(obs, path, "csv")
    return scan_observations(spark, path, "csv", FULL_OBSERVATION_SCHEMA)


# -- S3–S6 ---------------------------------------------------------------------------

@register("feed_kp", with_obs(
    f"""select feed, max(time_tag) as time_tag,
  arg_max({_safe("coalesce(kp_index, kp, '0')")}, time_tag) as kp_value
from kpf group by feed""", KP_FEED_CTE))
def q_feed_kp(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = S.land(S.kp_records(observations(spark, sf_dir)), spark, "feed-kp")
    return S.feed_kp(S.read_feed(spark, path, S.KP_FEED_SCHEMA))


@register("feed_wind", with_obs(
    f"""select feed, max(time_tag) as time_tag,
  arg_max({_safe("coalesce(speed, '0')")}, time_tag) as speed,
  arg_max({_safe("coalesce(density, '0')")}, time_tag) as density
from wf group by feed""", WIND_FEED_CTE))
def q_feed_wind(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = S.land(S.wind_records(observations(spark, sf_dir)), spark, "feed-wind")
    return S.feed_wind(S.read_feed(spark, path, S.WIND_FEED_SCHEMA))


@register("feed_alerts", with_obs(
    f"""select feed, issue_datetime, product_id, coalesce(message, 'NOAA alert received') as message
from (select {FEED} as feed, {TAG} as issue_datetime, metric || '-' || level as product_id,
             case when level <> 'INFO' then message end as message from hits) a
order by issue_datetime desc, product_id, feed limit 5""", HITS_CTES))
def q_feed_alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    al = alerts.threshold_alerts(observations(spark, sf_dir))
    path = S.land(S.alert_records(al), spark, "feed-alerts")
    return S.feed_alerts(S.read_feed(spark, path, S.ALERT_FEED_SCHEMA))


_POLL = """select *, row_number() over (partition by feed order by time_tag desc) as pos
      from (select feed, time_tag, case when event_id % 997 = 5 then 'n/a'
                   when event_id % 17 <> 0 then cast(kp_index as varchar) end as given
            from (select *, {feed} as feed, {tag} as time_tag from obs) o) f""".format(
    feed=FEED, tag=TAG)


@register("feed_kp_last60", with_obs(
    f"""select feed, pos, strptime(time_tag, '%Y-%m-%dT%H:%M:%S.%f') as timestamp,
  cast(coalesce(given, '0') as double) as kp_index
from (select *, bool_and(try_cast(coalesce(given, '0') as double) is not null)
               over (partition by feed) as holds
      from ({_POLL}) r where pos <= 60) p where holds"""))
def q_feed_kp_last60(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Polls of 60 records; some hold a value that cannot be read, which voids them."""
    obs = observations(spark, sf_dir)
    records = S.kp_records(obs.withColumn("kp_index", F.when(
        F.col("event_id") % 997 == 5, "n/a").otherwise(F.col("kp_index").cast("string"))))
    path = S.land(records, spark, "feed-kp60")
    return S.feed_kp_last60(S.read_feed(spark, path, S.KP_FEED_SCHEMA), 60, "kp_index")


# -- R10 ------------------------------------------------------------------------------

_ZONES = ", ".join(f"({sql_str(n)}, {la!r}, {lo!r}, {sql_str(z)}, {alt})"
                   for n, la, lo, z, alt in RISK_ZONES)


@register("tracked_objects", with_obs(
    f"""select feed, {sql_str(ISS_NAME)} as satellite,
  case when ok then lat else {ISS_FALLBACK[0]!r} end as latitude,
  case when ok then lon else {ISS_FALLBACK[1]!r} end as longitude,
  case when ok then 'Live Tracking' else 'Fallback Position' end as risk_zone,
  {ISS_ALTITUDE_KM} as altitude_km
from (select feed, try_cast(arg_max(latitude, time_tag) as double) as lat,
             try_cast(arg_max(longitude, time_tag) as double) as lon,
             try_cast(arg_max(latitude, time_tag) as double) is not null
             and try_cast(arg_max(longitude, time_tag) as double) is not null as ok
      from pf group by feed) p
union all
select f.feed, z.satellite, z.latitude, z.longitude, z.risk_zone, z.altitude_km
from (select distinct feed from pf) f
cross join (values {_ZONES}) z(satellite, latitude, longitude, risk_zone, altitude_km)""",
    f"""pf as (select {FEED} as feed, {TAG} as time_tag,
  case when event_id % 13 <> 0 then cast(((event_id * 7) % 1800) / 10e0 - 90e0 as varchar)
       else 'n/a' end as latitude,
  cast(((event_id * 11) % 3600) / 10e0 - 180e0 as varchar) as longitude from obs)"""))
def q_tracked_objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = S.land(S.position_records(observations(spark, sf_dir)), spark, "feed-position")
    latest = S.newest(S.read_feed(spark, path, S.POSITION_FEED_SCHEMA))
    return risk.tracked_objects(latest)


# -- S7 -------------------------------------------------------------------------------

_LINES = "\n      union all ".join(
    f"select series_id, {i} as line, {sql_str(label)} as metric, " + (
        column if column in ("flare_class", "overall_severity") else "cast(" + round_sql(
            column if places is None else round_sql(column, places), 3) + " as varchar)")
    + " as value from lo" for i, (label, column, places) in enumerate(S.REPORT_LINES))


@register("report_rows", with_obs(
    f"""select series_id, 'PREDICTIONS' as section, line, null as level, metric, value,
  null as threshold, null as message
from ({_LINES}) p
union all
select h.series_id, 'ACTIVE ALERTS', 100 + row_number() over (partition by h.event_id
         order by h.level_rank desc, h.metric_no), h.level, h.metric, cast(h.value as varchar),
       cast(h.threshold as varchar), h.message
from hits h join lo on h.event_id = lo.event_id""",
    HITS_CTES + """,
lo as (select x.*, case when raw is null then null else greatest(0e0, least(100e0, raw)) end as composite_risk,
              """ + SEVERITY_OF_LEVEL_CASE + """ as overall_severity
       from (select *, row_number() over (partition by series_id order by timestamp desc, event_id desc) as pick,
                    0e0 + 0.30 * (kp_index / 9e0 * 100e0) + 0.25 * satellite_disruption_risk
                    + 0.20 * gps_blackout_prob + 0.15 * ((solar_wind_speed - 280e0) / 620e0 * 100e0)
                    + 0.10 * (flare_intensity / 5e0 * 100e0) as raw from obs) x
       left join (select event_id, max(level_rank) as top_level_rank from hits group by event_id) g
         on g.event_id = x.event_id
       where pick = 1)"""))
def q_report_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per series, the latest observation's report, written as CSV and read back."""
    latest = select.latest_observation(observations(spark, sf_dir)) \
        .withColumn("composite_risk", risk.composite_risk_expr())
    latest = alerts.with_overall_severity(latest)
    out = scratch_path(spark, "report-csv")
    S.write_report(S.report_rows(latest, alerts.threshold_alerts(latest)), out)
    return S.read_report(spark, out)


# -- S1, damaged input ---------------------------------------------------------------------

_DAMAGE = {7: "too few fields", 11: "no number"}


@register("quarantine_observations", with_obs(
    f"""select case when event_id % 50 in ({", ".join(map(str, _DAMAGE))}) then 'quarantine'
         else 'table' end as kept_in, count(*) as rows, sum(event_id) as id_sum,
  sum(case when event_id % 50 in ({", ".join(map(str, _DAMAGE))}) then 0 else 1
      end * cast(kp_index is not null as integer)) as kp_values,
  count(distinct case when event_id % 50 in ({", ".join(map(str, _DAMAGE))})
        then event_id end) as records
from obs group by 1"""))
def q_quarantine_observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every 50th row's line is cut off, another 50th holds a word for a number; the scan
    keeps the other rows as they are and the damaged lines as text."""
    names = ["event_id", *[n for n in FULL_OBSERVATION_SCHEMA.fieldNames() if n != "event_id"]]
    obs = observations(spark, sf_dir).select(*names)
    short, wordy = _DAMAGE
    at = F.col("event_id") % 50
    # text as a writer would leave it: the id, and fields that need no quotes
    fields = [F.coalesce(F.when((at == wordy) & F.lit(n == "kp_index"), "oops").otherwise(
        F.col(n).cast("string")), F.lit("")) for n in names]
    line = F.when(at == short, F.concat_ws(",", *fields[:5])).otherwise(F.concat_ws(",", *fields))
    path = scratch_path(spark, "observations-damaged")
    obs.select(line.alias("value")).write.text(path)
    schema = T.StructType([FULL_OBSERVATION_SCHEMA[n] for n in names])
    good, bad = scan_with_quarantine(spark, path, schema, header=False,
                                     time_format="yyyy-MM-dd HH:mm:ss[.SSSSSS]")
    ids = bad.select(F.split_part("record", F.lit(","), F.lit(1)).cast("long").alias("event_id"),
                     "record")
    every = good.select(F.lit("table").alias("kept_in"), "event_id", "kp_index",
                        F.lit(None).cast("string").alias("record")).unionByName(
        ids.select(F.lit("quarantine").alias("kept_in"), "event_id",
                   F.lit(None).cast("double").alias("kp_index"), "record"))
    return every.groupBy("kept_in").agg(
        F.count(F.lit(1)).alias("rows"), F.sum("event_id").alias("id_sum"),
        F.count("kp_index").alias("kp_values"), F.countDistinct("record").alias("records"))
