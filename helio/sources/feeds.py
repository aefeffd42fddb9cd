"""S3–S7 and R10 inputs: JSON feed sources, feed landing, and the report sink.

The reference polls HTTP endpoints that return JSON arrays.  Here a feed is a
folder of landed JSON files (one record per line, or whole arrays with
``multiLine``) read with an explicit schema; every value is cleaned with P7
(``safe_float``) in one projection.  "Newest record" is ``max_by`` over the
record time (there is no file order in Spark), a partial aggregate.

``land_*`` helpers write feed files derived from the observation table so that
feeds are exercised on the driver's data; they write into the shared
checkpoint folder (``spark.checkpoint.dir``), never a machine-local path.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from helio.functions.exprs import safe_float, strict_float
from helio.schema import DEFAULT_ALERT_MESSAGE, SERIES
from helio.session import scratch_path

TIME_TAG_FORMAT = "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"

KP_FEED_SCHEMA = T.StructType([
    T.StructField("feed", T.StringType()),
    T.StructField("time_tag", T.StringType()),
    T.StructField("kp_index", T.StringType()),
    T.StructField("kp", T.StringType()),
])
WIND_FEED_SCHEMA = T.StructType([
    T.StructField("feed", T.StringType()),
    T.StructField("time_tag", T.StringType()),
    T.StructField("speed", T.StringType()),
    T.StructField("density", T.StringType()),
])
ALERT_FEED_SCHEMA = T.StructType([
    T.StructField("feed", T.StringType()),
    T.StructField("issue_datetime", T.StringType()),
    T.StructField("product_id", T.StringType()),
    T.StructField("message", T.StringType()),
])
POSITION_FEED_SCHEMA = T.StructType([
    T.StructField("feed", T.StringType()),
    T.StructField("time_tag", T.StringType()),
    T.StructField("iss_position", T.StructType([
        T.StructField("latitude", T.StringType()),
        T.StructField("longitude", T.StringType()),
    ])),
])


def feed_name(series: str = SERIES):
    return F.concat(F.lit("station-"), F.col(series).cast("string"))


def time_tag(ts: str = "timestamp"):
    return F.date_format(F.col(ts), TIME_TAG_FORMAT)


def kp_text(kp: str = "kp_raw"):
    """Kp as the feeds spell it: whole part + P (upper third), Z or M (lower third)."""
    whole = F.floor(F.col(kp)).cast("int")
    frac = F.col(kp) - whole
    suffix = F.when(frac >= F.lit(2 / 3), F.lit("P")).when(frac >= F.lit(1 / 3), F.lit("Z")) \
        .otherwise(F.lit("M"))
    return F.concat(whole.cast("string"), suffix)


# -- derived feed records (Spark derives them from the observation table) -----

def kp_records(obs: DataFrame) -> DataFrame:
    """Kp feed records; every 17th record lacks ``kp_index`` (reader falls back to ``kp``)."""
    return obs.select(feed_name().alias("feed"), time_tag().alias("time_tag"),
                      F.when(F.col("event_id") % 17 != 0, F.col("kp_index").cast("string"))
                      .alias("kp_index"),
                      kp_text().alias("kp"))


def wind_records(obs: DataFrame) -> DataFrame:
    """Wind feed records; speed as text with a unit suffix, density as a number or null."""
    return obs.select(feed_name().alias("feed"), time_tag().alias("time_tag"),
                      F.concat(F.col("solar_wind_speed").cast("string"), F.lit("km/s"))
                      .alias("speed"),
                      F.col("solar_wind_density").cast("string").alias("density"))


def alert_records(alerts: DataFrame) -> DataFrame:
    """Agency-style alert records from threshold alerts; INFO alerts carry no message."""
    return alerts.select(feed_name().alias("feed"), time_tag().alias("issue_datetime"),
                         F.concat_ws("-", F.col("metric"), F.col("level")).alias("product_id"),
                         F.when(F.col("level") != "INFO", F.col("message")).alias("message"))


def position_records(obs: DataFrame) -> DataFrame:
    """Position feed records; every 13th latitude is malformed text."""
    lat = ((F.col("event_id") * 7) % 1800) / F.lit(10.0) - F.lit(90.0)
    lon = ((F.col("event_id") * 11) % 3600) / F.lit(10.0) - F.lit(180.0)
    return obs.select(feed_name().alias("feed"), time_tag().alias("time_tag"),
                      F.struct(F.when(F.col("event_id") % 13 != 0, lat.cast("string"))
                               .otherwise(F.lit("n/a")).alias("latitude"),
                               lon.cast("string").alias("longitude")).alias("iss_position"))


def land(records: DataFrame, spark: SparkSession, name: str, files: int | None = None) -> str:
    """Write feed records as JSON lines under the shared checkpoint folder."""
    path = scratch_path(spark, name)
    (records.repartition(files) if files else records).write.mode("overwrite") \
        .option("timestampNTZFormat", TIME_TAG_FORMAT) \
        .option("timestampFormat", TIME_TAG_FORMAT).json(path)
    return path


def read_feed(spark: SparkSession, path: str, schema: T.StructType,
              multiline: bool = False) -> DataFrame:
    return spark.read.schema(schema).option("multiLine", multiline).json(path)


# -- S3–S6 ---------------------------------------------------------------------

def clean_kp(feed: DataFrame) -> DataFrame:
    """P7 on the Kp record: ``kp_index`` if present, else ``kp``, else 0."""
    return feed.select("feed", "time_tag",
                       safe_float(F.coalesce(F.col("kp_index"), F.col("kp"), F.lit("0")))
                       .alias("kp_value"))


def clean_wind(feed: DataFrame) -> DataFrame:
    return feed.select("feed", "time_tag",
                       safe_float(F.coalesce(F.col("speed"), F.lit("0"))).alias("speed"),
                       safe_float(F.coalesce(F.col("density"), F.lit("0"))).alias("density"))


def newest(df: DataFrame, key: str = "feed", order: str = "time_tag") -> DataFrame:
    """Newest record per feed (``max_by``, partial aggregate; ties -> any)."""
    others = [c for c in df.columns if c != key]
    return df.groupBy(key).agg(F.max_by(F.struct(*others), F.col(order)).alias("_r")) \
             .select(key, "_r.*")


def feed_kp(feed: DataFrame) -> DataFrame:
    """S3: newest cleaned Kp per feed."""
    return newest(clean_kp(feed))


def feed_wind(feed: DataFrame) -> DataFrame:
    """Newest cleaned wind (speed, density) per feed."""
    return newest(clean_wind(feed))


def feed_alerts(feed: DataFrame, n: int = 5) -> DataFrame:
    """The first ``n`` alerts (newest first), with the default message text."""
    return (feed.orderBy(F.col("issue_datetime").desc(), F.col("product_id"), F.col("feed"))
                .limit(n)
                .select("feed", "issue_datetime", "product_id",
                        F.coalesce(F.col("message"), F.lit(DEFAULT_ALERT_MESSAGE)).alias("message")))


def feed_kp_last60(feed: DataFrame, n: int = 60, value_col: str = "kp",
                   strict: bool = False) -> DataFrame:
    """The last ``n`` records of each feed (its poll) as (feed, pos, timestamp, kp_index).

    A poll is all or nothing: one value or time that cannot be read voids it, and the feed
    has no rows then.  An absent value is 0; a record without a time, or whose value is
    not a number by name (NaN), is left out of a poll that holds.  (An explicit null reads
    like an absent value here.)  ``strict=True`` fails the job instead of voiding a poll.
    Bounded per feed: ``row_number() <= n`` is planned with a partial group limit, and the
    poll's verdict is taken over the same at most ``n`` rows.  Records of one time stand in
    some order.
    """
    from pyspark.sql import Window
    w = Window.partitionBy("feed").orderBy(F.col("time_tag").desc())
    recent = feed.withColumn("pos", F.row_number().over(w)).where(F.col("pos") <= n)
    given = F.coalesce(F.col(value_col).cast("string"), F.lit("0"))
    if strict:
        recent = recent.withColumn("_given", given)
        return recent.select(
            "feed", "pos", F.to_timestamp("time_tag", F.lit(TIME_TAG_FORMAT)).cast("timestamp_ntz")
            .alias("timestamp"), strict_float("_given").alias("kp_index")).where(
            ~F.isnan("kp_index")).dropna()
    ts = F.try_to_timestamp(F.col("time_tag"), F.lit(TIME_TAG_FORMAT)).cast("timestamp_ntz")
    read = recent.select("feed", "pos", "time_tag", ts.alias("timestamp"),
                         given.try_cast("double").alias("kp_index"))
    fits = F.col("kp_index").isNotNull() & (F.col("time_tag").isNull()
                                            | F.col("timestamp").isNotNull())
    return read.withColumn("_holds", F.min(fits).over(Window.partitionBy("feed"))).where(
        F.col("_holds") & F.col("timestamp").isNotNull() & ~F.isnan("kp_index")).select(
        "feed", "pos", "timestamp", "kp_index")


# -- S7 report sink --------------------------------------------------------------

#: Lines of a report: label, column, and decimals of the value before the report's own 3
#: (None: text, or as it is).  Fixed values.
REPORT_LINES = [
    ("Kp Index", "kp_index", None),
    ("Sunspot Number", "sunspot_number", None),
    ("Solar Wind Speed (km/s)", "solar_wind_speed", None),
    ("IMF Bz (nT)", "imf_bz", None),
    ("Satellite Disruption Risk", "satellite_disruption_risk", None),
    ("GPS Blackout Probability", "gps_blackout_prob", None),
    ("Composite Risk Score", "composite_risk", 2),
    ("Overall Severity", "overall_severity", None),
    ("Flare Class", "flare_class", None),
]
REPORT_SCHEMA = ("section string, line long, level string, metric string, value string, "
                 "threshold string, message string")


def report_rows(predictions: DataFrame, alerts: DataFrame, key: str = SERIES,
                lines: Sequence[tuple] = REPORT_LINES) -> DataFrame:
    """The report as rows — PREDICTIONS (metric, value) in the order of ``lines``, then
    ALERTS (level, metric, value, threshold, message), per ``key``.

    Numbers are rounded to 3 decimals, texts are kept as they are; a missing value is a
    line with NULL.  Every column that ``lines`` names must be there.
    """
    kinds = dict(predictions.dtypes)

    def value(column: str, places: int | None):
        if kinds[column] == "string":
            return F.col(column)
        number = F.col(column).cast("double")
        number = number if places is None else F.round(number, places)
        return F.round(number, 3).cast("string")
    pred = predictions.select(key, F.inline(F.array(*[
        F.struct(F.lit(i).cast("long").alias("line"), F.lit(label).alias("metric"),
                 value(column, places).alias("value"))
        for i, (label, column, places) in enumerate(lines)]))).withColumn(
        "section", F.lit("PREDICTIONS"))
    al = alerts.select(key, (F.lit(100) + F.col("alert_rank")).cast("long").alias("line"), "metric",
                       F.col("value").cast("string").alias("value"), "level",
                       F.col("threshold").cast("string").alias("threshold"), "message") \
               .withColumn("section", F.lit("ACTIVE ALERTS"))
    return pred.unionByName(al, allowMissingColumns=True).select(
        key, "section", "line", "level", "metric", "value", "threshold", "message")


def write_report(rows: DataFrame, path: str, key: str = SERIES) -> None:
    """CSV report sink: the lines of a key stand together, in order, in files as large as
    the partitions (not a folder per key)."""
    rows.repartitionByRange(key, "line").sortWithinPartitions(key, "line").write.mode(
        "overwrite").option("header", True).csv(path)


def read_report(spark: SparkSession, path: str, key: str = SERIES,
                key_type: str = "long") -> DataFrame:
    return spark.read.schema(f"{key} {key_type}, {REPORT_SCHEMA}").option("header", True).csv(path)
