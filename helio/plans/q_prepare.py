"""Registered M1 (prepare_features) and its oracle text."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from helio.plans.prepare import prepare_features
from helio.plans.q_quality import clip_sql, knn_ctes
from helio.plans.registry import register, round_sql, with_obs
from helio.schema import LAG_COLUMNS, LOG_COLUMNS, NUMERIC_COLUMNS, WINSOR_COLUMNS
from helio.sources.observations import observations

TARGET_COLUMNS = ["satellite_disruption_risk", "gps_blackout_prob", "storm_flag"]


def _feature_list() -> list[str]:
    # numeric observation columns in table order, minus targets and flags
    base = ["sunspot_number", "f107_solar_flux", "solar_wind_speed", "solar_wind_density",
            "imf_bz", "xray_flux", "proton_flux", "kp_index", "dst_index", "flare_intensity",
            "cme_flag", "solar_cycle_phase"]
    derived = ["flare_class_enc", "day_of_year", "month", "day_sin", "day_cos"]
    for c in LAG_COLUMNS:
        derived += [f"{c}_lag1", f"{c}_lag3", f"{c}_roll7", f"{c}_roll30", f"{c}_std7"]
    derived += ["wind_bz_interaction", "storm_energy", "flare_kp_interaction", "southward_bz"]
    derived += [f"log_{c}" for c in LOG_COLUMNS]
    return base + derived


FEATURES = _feature_list()
WIN = "partition by series_id order by timestamp, event_id"


def _prepare_sql() -> str:
    imp_cols = ",\n    ".join(
        f"coalesce(cast(o.{c} as double), ki.c{j}) as {c}" for j, c in enumerate(NUMERIC_COLUMNS))
    pivot = ", ".join(f"max(case when col_no = {j} then value end) as c{j}"
                      for j in range(len(NUMERIC_COLUMNS)))
    win_cols = []
    for c in LAG_COLUMNS:
        win_cols += [f"lag({c}, 1) over ({WIN}) as {c}_lag1",
                     f"lag({c}, 3) over ({WIN}) as {c}_lag3",
                     f"avg({c}) over ({WIN} rows between 6 preceding and current row) as {c}_roll7",
                     f"avg({c}) over ({WIN} rows between 29 preceding and current row) as {c}_roll30",
                     f"coalesce(stddev_samp({c}) over ({WIN} rows between 6 preceding and current row), 0) as {c}_std7"]
    sb = "case when imf_bz is null then null else greatest(-imf_bz, 0e0) end"
    fenc = ("cast(coalesce(case flare_class when 'A' then 0 when 'B' then 1 when 'C' then 2 "
            "when 'M' then 3 when 'X' then 4 end, 0) as integer)")
    ctes = knn_ctes() + f""",
ki as (select event_id, {pivot} from knn_cells group by event_id),
imp as (select o.event_id, o.series_id, o.timestamp, o.flare_class, o.severity,
    {imp_cols}
  from obs o left join ki on o.event_id = ki.event_id),
f1 as (select *, {fenc} as flare_class_enc,
    cast(dayofyear(timestamp) as integer) as day_of_year, cast(month(timestamp) as integer) as month,
    sin({2 * math.pi!r} * dayofyear(timestamp) / 365e0) as day_sin,
    cos({2 * math.pi!r} * dayofyear(timestamp) / 365e0) as day_cos,
    {", ".join(win_cols)},
    solar_wind_speed * ({sb}) as wind_bz_interaction,
    pow(solar_wind_speed, 2) * solar_wind_density as storm_energy,
    {fenc} * kp_index as flare_kp_interaction,
    {sb} as southward_bz,
    {", ".join(f"ln(1 + {c}) as log_{c}" for c in LOG_COLUMNS)}
  from imp),
wb as (select {", ".join(f"quantile_cont({c}, 0.01) as {c}_lo, quantile_cont({c}, 0.99) as {c}_hi" for c in WINSOR_COLUMNS)} from f1),
f2 as (select f1.* replace ({", ".join(f"{clip_sql('f1.' + c, f'wb.{c}_lo', f'wb.{c}_hi')} as {c}" for c in WINSOR_COLUMNS)})
  from f1 cross join wb),
f3 as (select * from f2 where {" and ".join(f"{c} is not null" for c in FEATURES)}),
p as (select {", ".join(f"avg({c}) as {c}_m, coalesce(nullif(stddev_pop({c}), 0), 1) as {c}_s" for c in FEATURES)} from f3)"""
    body = ("select f3.event_id, f3.series_id, " + ", ".join(
        f"{round_sql(f'(f3.{c} - p.{c}_m) / p.{c}_s')} as {c}" for c in FEATURES)
        + ", " + ", ".join(f"f3.{c} as {c}" for c in TARGET_COLUMNS)
        + " from f3 cross join p")
    return with_obs(body, ctes)


@register("prepare_features", _prepare_sql())
def q_prepare_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    prep = prepare_features(observations(spark, sf_dir))
    assert prep.features == FEATURES, prep.features
    f = prep.frame
    return f.select("event_id", "series_id", *[F.round(c, 6).alias(c) for c in FEATURES],
                    *[F.col(c).cast("double").alias(c) for c in TARGET_COLUMNS])
