"""Structured Streaming over landed feed files.

* T1 ``stream_feed``: file-source stream with an explicit schema, cleaned with P7.
* T2 ``stream_dedup``: polls are full snapshots, so consecutive files repeat
  records; ``dropDuplicatesWithinWatermark`` keeps the first copy of each
  (feed, time).  The state is carried from trigger to trigger and over restarts, and the
  watermark evicts it; a record that arrives after the watermark has passed it is
  dropped.
* T3 ``stream_alerts``: threshold alerts per record.  The thresholds compile to
  CASE expressions, so this is a stateless projection (append mode) — no
  stream–static join and no state store.
* T4 ``stream_risk``: composite / mission / failure scores and labels (stateless).
* T5 ``stream_latest``: newest reading per feed, ``max_by`` in a grouped
  aggregation (update mode; state is one row per feed).  Its sink is a keyed table: every
  epoch writes a new version with the changed keys replaced, Spark's commit marker makes
  the version the table at one instant, and older versions are removed.

Every query writes through a checkpoint location in the shared checkpoint
folder, so a restarted query resumes exactly where it stopped.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from helio.functions.exprs import classify_flare, safe_float, severity_label, storm_flag
from helio.operators import alerts, risk
from helio.schema import FULL_OBSERVATION_SCHEMA
from helio.session import scratch_path
from helio.sources.observations import nan_to_null

OBS_STREAM_SCHEMA = T.StructType(
    [T.StructField(f.name, T.TimestampType() if f.name == "timestamp" else f.dataType, True)
     for f in FULL_OBSERVATION_SCHEMA.fields])


def read_stream(spark: SparkSession, path: str, schema: T.StructType,
                max_files: int | None = None) -> DataFrame:
    """T1 source: JSON files landing in ``path`` (explicit schema, no inference)."""
    r = spark.readStream.schema(schema) \
        .option("timestampFormat", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
    if max_files:
        r = r.option("maxFilesPerTrigger", max_files)
    return nan_to_null(r.json(path))


def clean_feed_stream(stream: DataFrame) -> DataFrame:
    """Kp records cleaned with P7 and an event time for watermarks."""
    return stream.select(
        "feed", "time_tag",
        F.try_to_timestamp(F.col("time_tag"), F.lit("yyyy-MM-dd'T'HH:mm:ss.SSSSSS"))
        .alias("event_time"),
        safe_float(F.coalesce(F.col("kp_index"), F.col("kp"), F.lit("0"))).alias("kp_value"))


def dedup_polls(clean: DataFrame, delay: str = "2 hours") -> DataFrame:
    """Drop records repeated by overlapping polls (state bounded by the watermark)."""
    return clean.withWatermark("event_time", delay) \
                .dropDuplicatesWithinWatermark(["feed", "time_tag"])


def stream_alerts(obs_stream: DataFrame) -> DataFrame:
    """Threshold alerts on a stream of observations (stateless)."""
    return alerts.threshold_alerts(obs_stream)


def stream_risk(obs_stream: DataFrame) -> DataFrame:
    """T4: risk scores and labels on a stream of observations (stateless)."""
    s = risk.mission_score_expr()
    f = risk.failure_score_expr()
    return obs_stream.select(
        "event_id", "series_id", "timestamp",
        risk.composite_risk_expr().alias("composite_risk"),
        s.alias("mission_score"), risk.mission_level_expr(s).alias("mission_level"),
        f.alias("failure_score"), risk.failure_level_expr(f).alias("failure_level"),
        classify_flare("flare_intensity").alias("flare_class"),
        severity_label("kp_index").alias("severity_kp"),
        storm_flag("kp_index").alias("storm_kp"))


def stream_latest(clean: DataFrame) -> DataFrame:
    """T5: newest cleaned Kp per feed (grouped ``max_by``; one state row per feed)."""
    return clean.groupBy("feed").agg(
        F.max_by(F.struct("time_tag", "kp_value"), F.col("time_tag")).alias("_r")) \
        .select("feed", "_r.time_tag", "_r.kp_value")


def run_to_table(query_df: DataFrame, spark: SparkSession, name: str,
                 mode: str = "append", key: str = "feed", out: str | None = None) -> str:
    """Run a streaming DataFrame until the landed input is consumed
    (``availableNow``) into a Parquet table (append) or a keyed table (update: one
    row per ``key``, see :func:`keyed_table`), and return the table's path.

    ``out`` (a path returned before) carries on a run: the checkpoint beside it says
    what has been consumed, and the state and the table go on from there.
    """
    out = out or scratch_path(spark, f"{name}-out")
    writer = query_df.writeStream.option("checkpointLocation", f"{out}-ckpt").outputMode(mode)
    if mode == "append":
        writer = writer.format("parquet").option("path", out)
    else:
        writer = writer.foreachBatch(lambda batch, epoch: upsert(batch, epoch, out, key))
    q = writer.trigger(availableNow=True).start()
    q.awaitTermination()
    return out


# -- keyed tables --------------------------------------------------------------------

def _versions(spark: SparkSession, path: str) -> dict[int, str]:
    """Committed versions of a keyed table: number -> folder."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    at = jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(conf)
    if not fs.exists(at):
        return {}
    out = {}
    for status in fs.listStatus(at):
        name = status.getPath().getName()
        if name.startswith("version=") and fs.exists(
                jvm.org.apache.hadoop.fs.Path(status.getPath(), "_SUCCESS")):
            out[int(name.split("=")[1])] = str(status.getPath())
    return out


def upsert(batch: DataFrame, epoch: int, path: str, key: str = "feed") -> None:
    """Write version ``epoch`` of a keyed table: the version before it, with the rows of the
    batch's keys replaced.

    The writer's ``_SUCCESS`` file is its commit: readers see the old version until it is
    there, and the whole new one after.  A retried epoch starts from the version before
    it again and gives the same table.  One version is kept besides the newest, for
    readers that are under way and for the retry.
    """
    spark = batch.sparkSession
    found = _versions(spark, path)
    before = max((v for v in found if v < epoch), default=None)
    rows = batch
    if before is not None:
        old = spark.read.parquet(found[before])
        rows = old.join(batch.select(F.col(key).alias("_key")).distinct(),
                        old[key].eqNullSafe(F.col("_key")), "left_anti").unionByName(batch)
    rows.write.mode("overwrite").parquet(f"{path}/version={epoch}")
    conf = spark._jsc.hadoopConfiguration()
    for number, folder in found.items():
        if before is not None and number < before:
            at = spark._jvm.org.apache.hadoop.fs.Path(folder)
            at.getFileSystem(conf).delete(at, True)


def keyed_table(spark: SparkSession, path: str) -> DataFrame:
    """The newest committed version of a keyed table: one row per key."""
    found = _versions(spark, path)
    if not found:
        raise FileNotFoundError(path)
    return spark.read.parquet(found[max(found)])
