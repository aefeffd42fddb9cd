"""Observation tables — the derived view over ``events``, CSV/Parquet scan and sink."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from helio.schema import FLOAT_COLUMNS, OBSERVATION_SCHEMA, TIME

# The observation view over the driver's ``events`` table (FIXTURES.md §2).  The
# same text runs in Spark SQL and DuckDB, so both engines derive bit-equal
# doubles: integer arithmetic and one final division.
OBSERVATION_VIEW_SQL = """
with e as (
  select event_id, user_id as series_id, ts,
         cast(round(value * 100) as bigint) as vc,
         cast(regexp_extract(props, '[0-9]+', 0) as int) as k
  from {events}
), t as (
  select *, least(cast(90 as bigint), cast(floor((vc + 100) / 200) as bigint)) as kt,
         vc / 2000e0 as kp_raw0, k / 20e0 as fi
  from e
)
select event_id, series_id, ts as timestamp,
  (event_id * 29 % 2500) / 10e0                                                        as sunspot_number,
  (680 + event_id * 31 % 2320) / 10e0                                                  as f107_solar_flux,
  case when event_id % 50 = 7  then null else (2800 + event_id * 37 % 6200) / 10e0 end as solar_wind_speed,
  (100 + event_id * 17 % 2900) / 100e0                                                 as solar_wind_density,
  case when event_id % 50 = 13 then null else (event_id * 53 % 4000 - 2000) / 100e0 end as imf_bz,
  case when event_id % 50 = 21 then null else (k * k + 1) / 1e9 end                    as xray_flux,
  case when event_id % 50 = 33 then null else (vc % 10007) / 10e0 end                  as proton_flux,
  kt / 10e0                                                                            as kp_index,
  case when kp_raw0 > 9e0 then 9e0 else kp_raw0 end                                    as kp_raw,
  case when event_id % 50 = 41 then null else (500 - kt * 25 - event_id * 13 % 1000) / 10e0 end as dst_index,
  case when fi < 1 then 'A' when fi < 2 then 'B' when fi < 3 then 'C' when fi < 4 then 'M' else 'X' end as flare_class,
  fi                                                                                   as flare_intensity,
  least(cast(1000 as bigint), kt * 8 + event_id * 7 % 300) / 10e0                      as satellite_disruption_risk,
  least(cast(1000 as bigint), kt * 6 + event_id * 11 % 400) / 10e0                     as gps_blackout_prob,
  case when kp_raw0 >= 5 then 1 else 0 end                                             as storm_flag,
  case when event_id % 33 = 0 then 1 else 0 end                                        as cme_flag,
  case when kp_raw0 < 3 then 'Low' when kp_raw0 < 5 then 'Moderate' when kp_raw0 < 7 then 'High' else 'Extreme' end as severity,
  (event_id % 1000) / 1000e0                                                           as solar_cycle_phase
from t
"""


def observation_view_sql(events: str = "events") -> str:
    """The view text with ``{events}`` bound to a table name (used by the oracle)."""
    return OBSERVATION_VIEW_SQL.replace("{events}", events)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the driver's Parquet tables."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The observation table derived from ``events`` (lazy; Catalyst prunes it)."""
    events = table(spark, sf_dir, "events")
    return spark.sql(OBSERVATION_VIEW_SQL, events=events)


def nan_to_null(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """NaN -> NULL for the float columns (Spark orders NaN above every number)."""
    floats = {c for c, kind in df.dtypes if kind in ("double", "float")}
    cols = floats & set(columns or FLOAT_COLUMNS)
    return df.select(*[
        F.nanvl(F.col(c), F.lit(None).cast("double")).alias(c) if c in cols else F.col(c)
        for c in df.columns
    ])


CSV_TIME_FORMAT = "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"


def scan_observations(spark: SparkSession, path: str, fmt: str = "csv",
                      schema=OBSERVATION_SCHEMA) -> DataFrame:
    """Read an observation table written as CSV (header) or Parquet.

    The schema is explicit (no inference pass over the data); ``timestamp`` is
    parsed by the reader and NaN cells become NULL.
    """
    if fmt == "csv":
        df = (spark.read.schema(schema)
              .option("header", True)
              .option("timestampNTZFormat", CSV_TIME_FORMAT)
              .option("nanValue", "NaN")
              .option("mode", "PERMISSIVE")
              .csv(path))
    else:
        df = spark.read.parquet(path)
    return nan_to_null(df)


CORRUPT = "_corrupt_record"


def scan_with_quarantine(spark: SparkSession, path: str, schema=OBSERVATION_SCHEMA,
                         header: bool = True, time_format: str = CSV_TIME_FORMAT):
    """S1 for input that may be damaged: (good rows, quarantined lines) of a CSV table.

    A line that does not fit the schema (a field that cannot be read as its type, too few or
    too many fields) is not half a row of NULLs in the table but a row (file, record) of the
    quarantine, with its text as it stands.  An empty field is NULL and no damage.  The
    lines are parsed once, with all columns, and both parts read the written result.
    """
    from helio.session import materialize
    full = T.StructType([*schema.fields, T.StructField(CORRUPT, T.StringType())])
    lines = materialize(
        spark.read.schema(full).option("header", header)
        .option("timestampNTZFormat", time_format).option("nanValue", "NaN")
        .option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", CORRUPT)
        .csv(path).withColumn("_file", F.input_file_name()), "scanned")
    good = nan_to_null(lines.where(F.col(CORRUPT).isNull()).drop(CORRUPT, "_file"))
    bad = lines.where(F.col(CORRUPT).isNotNull()).select(
        F.col("_file").alias("file"), F.col(CORRUPT).alias("record"))
    return good, bad


def sink_observations(df: DataFrame, path: str, fmt: str = "csv",
                      partition_by: list[str] | None = None) -> None:
    """Write the full table (CSV with header, or Parquet), one task per partition."""
    writer = df.write.mode("overwrite")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    if fmt == "csv":
        writer.option("header", True).option("timestampNTZFormat", CSV_TIME_FORMAT).csv(path)
    else:
        writer.parquet(path)


def col_or_null(df: DataFrame, name: str, dtype: str = "double") -> Column:
    return F.col(name) if name in df.columns else F.lit(None).cast(dtype).alias(name)


def by_time(df: DataFrame) -> DataFrame:
    """Rows in time order (only where order is part of the output)."""
    return df.orderBy(F.col(TIME), *([F.col("event_id")] if "event_id" in df.columns else []))
