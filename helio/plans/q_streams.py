"""Registered T1–T5: streams over feed files landed from the observation table.

Each query lands its input (JSON files derived by Spark from ``events``) in the
shared checkpoint folder, runs the streaming query with ``availableNow`` into
a table, and returns that table.  The oracle is the batch SQL of the same
records: a stream must give the batch answer.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from helio.operators import alerts
from helio.plans.q_alerts import HITS_CTES
from helio.plans.q_feeds import KP_FEED_CTE, _safe
from helio.plans.registry import register, round_sql, with_obs
from helio.schema import FULL_OBSERVATION_SCHEMA
from helio.session import scratch_path
from helio.sources import feeds as S
from helio.sources.observations import observations
from helio.streaming import streams as T


def _land_obs(spark, sf_dir, name) -> str:
    obs = observations(spark, sf_dir).select(*FULL_OBSERVATION_SCHEMA.fieldNames())
    return S.land(obs, spark, name, files=8)


def _ntz(df: DataFrame, col: str = "timestamp") -> DataFrame:
    return df.withColumn(col, F.col(col).cast("timestamp_ntz"))


@register("stream_feed", with_obs(
    "select feed, time_tag, " + _safe("coalesce(kp_index, kp, '0')") + " as kp_value from kpf",
    KP_FEED_CTE))
def q_stream_feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    src = S.land(S.kp_records(observations(spark, sf_dir)), spark, "stream-kp", files=8)
    clean = T.clean_feed_stream(T.read_stream(spark, src, S.KP_FEED_SCHEMA))
    out = T.run_to_table(clean.drop("event_time"), spark, "stream-feed")
    return spark.read.parquet(out)


POLLS = 4
#: Withheld from the first poll and landed after the last: by then the watermark has passed.
_LATE = "event_id % 101 = 7"


@register("stream_dedup", with_obs(
    "select feed, time_tag, " + _safe("coalesce(kp_index, kp, '0')") + f""" as kp_value
from (select k.*, o.event_id, o.us, b.low, b.top
      from (select *, epoch_us(timestamp) as us from obs) o
      join kpe k on k.event_id = o.event_id
      cross join (select min(epoch_us(timestamp)) as low, max(epoch_us(timestamp)) as top
                  from obs) b) p
where not ({_LATE} and us < low + (top - low) // {POLLS})""",
    KP_FEED_CTE.replace("kpf as (select ", "kpe as (select event_id, ")))
def q_stream_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Polls of a quarter of the time each, that begin an hour before the last one's end, and
    a run of the query after each: the state comes from the checkpoint.  Records of the
    first quarter that arrive after the last poll are late and dropped."""
    obs = observations(spark, sf_dir)
    at = F.unix_micros(F.col("timestamp").cast("timestamp"))
    low, top = obs.agg(F.min(at), F.max(at)).first()
    cuts = [low + (top - low) * i // POLLS for i in range(POLLS)] + [top + 1]
    late = F.expr(_LATE) & (at < cuts[1])
    hour = 3_600_000_000
    polls = [obs.where((at >= cuts[i] - hour) & (at < cuts[i + 1]) & ~late)
             for i in range(POLLS)] + [obs.where(late)]
    src, out = scratch_path(spark, "stream-polls"), None
    for poll in polls:
        S.kp_records(poll).write.mode("append").json(src)
        clean = T.clean_feed_stream(T.read_stream(spark, src, S.KP_FEED_SCHEMA))
        out = T.run_to_table(T.dedup_polls(clean).drop("event_time"), spark, "stream-dedup",
                             out=out)
    return spark.read.parquet(out)


@register("stream_alerts", with_obs(
    """select event_id, series_id, timestamp, metric_no, metric, level, level_rank, message,
       value, threshold,
       row_number() over (partition by event_id order by level_rank desc, metric_no) as alert_rank
from hits""", HITS_CTES))
def q_stream_alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    src = _land_obs(spark, sf_dir, "stream-obs-alerts")
    stream = T.read_stream(spark, src, T.OBS_STREAM_SCHEMA)
    out = T.run_to_table(_ntz(T.stream_alerts(stream)), spark, "stream-alerts")
    return spark.read.parquet(out)


_RISK_SQL = f"""select event_id, series_id, timestamp,
  {round_sql("case when cr is null then null else greatest(0e0, least(100e0, cr)) end")} as composite_risk,
  {round_sql("ms")} as mission_score,
  case when ms >= 80 then 'EXTREME' when ms >= 60 then 'HIGH' when ms >= 40 then 'MODERATE' else 'LOW' end as mission_level,
  fs as failure_score,
  case when fs < 30 then 'Low' when fs < 55 then 'Moderate' when fs < 75 then 'High' else 'Extreme' end as failure_level,
  case when flare_intensity < 1 then 'A' when flare_intensity < 2 then 'B' when flare_intensity < 3 then 'C'
       when flare_intensity < 4 then 'M' else 'X' end as flare_class,
  case when kp_index < 3 then 'Low' when kp_index < 5 then 'Moderate' when kp_index < 7 then 'High' else 'Extreme' end as severity_kp,
  cast(coalesce(kp_index >= 5, false) as integer) as storm_kp
from (select *, case when mr is null then null else least(mr, 100e0) end as ms,
        {round_sql("coalesce(case when fr is null then null else greatest(0e0, least(100e0, fr)) end, 0e0)", 2)} as fs
      from (select *, 0e0 + 0.30 * (kp_index / 9e0 * 100e0) + 0.25 * satellite_disruption_risk
                   + 0.20 * gps_blackout_prob + 0.15 * ((solar_wind_speed - 280e0) / 620e0 * 100e0)
                   + 0.10 * (flare_intensity / 5e0 * 100e0) as cr,
                   kp_index * 8 + solar_wind_speed / 30e0 + gps_blackout_prob * 0.9
                   + satellite_disruption_risk * 1.1 as mr,
                   kp_index * 8 + (case when solar_wind_speed is null then null
                                        else least(solar_wind_speed / 900e0, 1e0) end) * 25
                   + gps_blackout_prob * 0.35 + satellite_disruption_risk * 0.45 as fr
            from obs) a) b"""


@register("stream_risk", with_obs(_RISK_SQL))
def q_stream_risk(spark: SparkSession, sf_dir: str) -> DataFrame:
    src = _land_obs(spark, sf_dir, "stream-obs-risk")
    stream = T.read_stream(spark, src, T.OBS_STREAM_SCHEMA)
    scored = T.stream_risk(stream).withColumn("composite_risk", F.round("composite_risk", 6)) \
        .withColumn("mission_score", F.round("mission_score", 6))
    out = T.run_to_table(_ntz(scored), spark, "stream-risk")
    return spark.read.parquet(out)


@register("stream_latest", with_obs(
    f"""select feed, max(time_tag) as time_tag,
  arg_max({_safe("coalesce(kp_index, kp, '0')")}, time_tag) as kp_value
from kpf group by feed""", KP_FEED_CTE))
def q_stream_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    src = S.land(S.kp_records(observations(spark, sf_dir)), spark, "stream-kp-latest", files=8)
    clean = T.clean_feed_stream(T.read_stream(spark, src, S.KP_FEED_SCHEMA, max_files=2))
    out = T.run_to_table(T.stream_latest(clean.drop("event_time")), spark, "stream-latest",
                         mode="update")
    return T.keyed_table(spark, out)
