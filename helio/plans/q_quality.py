"""Registered Q1–Q5 (missing data, KNN imputation, winsorising, scaling)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from helio.operators import quality as Q
from helio.plans.registry import register, round_sql, sql_str, with_obs
from helio.schema import NUMERIC_COLUMNS, WINSOR_COLUMNS
from helio.sources.observations import observations

OBS_ALL_COLUMNS = ["event_id", "series_id", "timestamp", "sunspot_number", "f107_solar_flux",
                   "solar_wind_speed", "solar_wind_density", "imf_bz", "xray_flux", "proton_flux",
                   "kp_index", "kp_raw", "dst_index", "flare_class", "flare_intensity",
                   "satellite_disruption_risk", "gps_blackout_prob", "storm_flag", "cme_flag",
                   "severity", "solar_cycle_phase"]


# -- KNN in SQL: pairwise NaN-Euclidean distance, k nearest per missing cell -----

def _d2_sql(cols, a="r", b="d") -> str:
    s = " + ".join(f"(case when {a}.{c} is not null and {b}.{c} is not null "
                   f"then ({a}.{c} - {b}.{c}) * ({a}.{c} - {b}.{c}) else 0e0 end)" for c in cols)
    n = " + ".join(f"(case when {a}.{c} is not null and {b}.{c} is not null then 1 else 0 end)"
                   for c in cols)
    return f"({len(cols)}e0 / ({n}) * (0e0 + {s}))"


def knn_ctes(cols=NUMERIC_COLUMNS, src="obs", k=5) -> str:
    """CTEs knn_b, knn_r, knn_cells(event_id, col_no, feature, value)."""
    any_null = " or ".join(f"{c} is null" for c in cols)
    parts = []
    for j, c in enumerate(cols):
        parts.append(f"""select m.event_id, {j} as col_no, {sql_str(c)} as feature,
    coalesce(n.imp, (select avg({c}) from knn_b)) as value
  from (select event_id from knn_r where {c} is null) m
  left join (select rid, avg(val) as imp from (
      select r.event_id as rid, d.{c} as val,
             row_number() over (partition by r.event_id order by {_d2_sql(cols)}, d.event_id) as rk
      from knn_r r join knn_b d on r.{c} is null and d.{c} is not null) x
    where rk <= {k} group by rid) n on m.event_id = n.rid""")
    cast_cols = ", ".join(f"cast({c} as double) as {c}" for c in cols)
    return (f"knn_b as (select event_id, {cast_cols} from {src}),\n"
            f"knn_r as (select * from knn_b where {any_null}),\n"
            "knn_cells as (\n  " + "\n  union all ".join(parts) + ")")


@register("knn_impute", with_obs(
    f"select event_id, col_no, feature, {round_sql('value')} as value from knn_cells",
    knn_ctes()))
def q_knn_impute(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = Q.knn_cells(observations(spark, sf_dir), NUMERIC_COLUMNS)
    return cells.withColumn("value", F.round("value", 6))


@register("missing_report", with_obs(
    "select feature, missing, " + round_sql("table_missing_rate") + " as table_missing_rate\n"
    "from (select feature, missing, sum(missing) over () / (n * "
    f"{len(OBS_ALL_COLUMNS)}e0) as table_missing_rate\n"
    "      from (" + "\n union all ".join(
        f"select {sql_str(c)} as feature, count(*) - count({c}) as missing, (select count(*) from obs) as n from obs"
        for c in OBS_ALL_COLUMNS) + ") x) y where missing > 0"))
def q_missing_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = Q.missing_report(observations(spark, sf_dir).select(*OBS_ALL_COLUMNS))
    return out.withColumn("table_missing_rate", F.round("table_missing_rate", 6))


def winsor_sql(cols=WINSOR_COLUMNS, src="obs") -> str:
    """Text of (bounds CTE name 'wb'): per column lower/upper 1 %/99 % quantiles."""
    sel = ", ".join(f"quantile_cont({c}, 0.01) as {c}_lo, quantile_cont({c}, 0.99) as {c}_hi"
                    for c in cols)
    return f"wb as (select {sel} from {src})"


def clip_sql(c, lo, hi) -> str:
    return f"case when {c} is null then null else greatest({lo}, least({hi}, {c})) end"


@register("winsorize", with_obs(
    "select o.event_id, " + ", ".join(
        f"{round_sql(clip_sql('o.' + c, f'wb.{c}_lo', f'wb.{c}_hi'))} as {c}" for c in WINSOR_COLUMNS)
    + " from obs o cross join wb", winsor_sql()))
def q_winsorize(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Q3 (check T: rounded to 6 places on both sides — the interpolated bounds
    can differ in the last binary digit between engines)."""
    o = observations(spark, sf_dir)
    return Q.winsorize(o, WINSOR_COLUMNS).select(
        "event_id", *[F.round(c, 6).alias(c) for c in WINSOR_COLUMNS])


@register("standard_scale", with_obs(
    "select o.event_id, " + ", ".join(
        f"{round_sql(f'(o.{c} - p.{c}_m) / p.{c}_s')} as {c}" for c in NUMERIC_COLUMNS)
    + " from obs o cross join p",
    "p as (select " + ", ".join(
        f"avg({c}) as {c}_m, coalesce(nullif(stddev_pop({c}), 0), 1) as {c}_s"
        for c in NUMERIC_COLUMNS) + " from obs)"))
def q_standard_scale(spark: SparkSession, sf_dir: str) -> DataFrame:
    scaled, _ = Q.standard_scale(observations(spark, sf_dir), NUMERIC_COLUMNS)
    return scaled.select("event_id", *[F.round(c, 6).alias(c) for c in NUMERIC_COLUMNS])


@register("zscore_series", with_obs(
    f"""select o.event_id, o.series_id, {round_sql('(o.kp_index - p.mu) / p.sigma')} as kp_index_z,
  {round_sql('((o.kp_index - p.mu) / p.sigma) * p.sigma + p.mu')} as kp_index_back
from obs o join (select series_id, avg(kp_index) as mu, stddev_pop(kp_index) + 1e-8 as sigma
                 from obs group by series_id) p on o.series_id = p.series_id"""))
def q_zscore_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    z = Q.zscore_series(observations(spark, sf_dir), "kp_index")
    back = F.col("kp_index_z") * F.col("kp_index_sigma") + F.col("kp_index_mu")
    return z.select("event_id", "series_id", F.round("kp_index_z", 6).alias("kp_index_z"),
                    F.round(back, 6).alias("kp_index_back"))
