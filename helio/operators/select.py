"""K1–K8: latest rows, tails, storm filters, storm periods, samples and previews.

Skew notes
* K1 uses ``max_by`` — a partial (map-side) aggregate, so a hot series costs
  one small buffer per task, not a sort of the series.
* K2 filters ``row_number() <= n``; Spark plans a partial ``WindowGroupLimit``
  before the shuffle, so at most ``n`` rows per series and task are shuffled.
* K7/K8 are ``orderBy(...).limit(n)`` -> ``TakeOrderedAndProject``: a bounded
  per-task top-n, merged on the driver (n rows per task).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from helio.schema import SERIES, STORM_KP, TIME

ORDER = (TIME, "event_id")


def latest_observation(df: DataFrame, series: str | None = SERIES,
                       order: Sequence[str] = ORDER) -> DataFrame:
    """K1: newest row per series (positional last = greatest (ts, id))."""
    others = [c for c in df.columns if c != series]
    key = F.struct(*[F.col(c) for c in order])
    packed = F.max_by(F.struct(*[F.col(c) for c in others]), key).alias("_last")
    grouped = df.groupBy(series).agg(packed) if series else df.agg(packed)
    return grouped.select(*([series] if series else []), "_last.*")


def tail_n(df: DataFrame, n: int, series: str | None = SERIES,
           order: Sequence[str] = ORDER) -> DataFrame:
    """K2: last ``n`` rows of each series (``series=None``: of the whole table).

    Adds ``pos`` = 1 for the newest row.
    """
    if series is None:
        desc = [F.col(c).desc() for c in order]
        top = df.orderBy(*desc).limit(n)
        return top.withColumn("pos", F.row_number().over(Window.orderBy(*desc)))
    w = Window.partitionBy(series).orderBy(*[F.col(c).desc() for c in order])
    return df.withColumn("pos", F.row_number().over(w)).where(F.col("pos") <= n)


def storm_days(df: DataFrame, kp: str = "kp_index", series: str | None = None) -> DataFrame:
    """K3: number and share of rows with Kp >= 5."""
    aggs = [F.count_if(F.col(kp) >= F.lit(STORM_KP)).alias("storm_rows"),
            F.count(F.lit(1)).alias("total_rows")]
    g = df.groupBy(series).agg(*aggs) if series else df.agg(*aggs)
    return g.withColumn("storm_rate", F.col("storm_rows") / F.col("total_rows"))


def storm_periods(df: DataFrame, kp: str = "kp_index", series: str = SERIES,
                  order: Sequence[str] = ORDER, pieces: int | None = None) -> DataFrame:
    """K4: contiguous stretches with Kp >= 5 (gaps and islands).

    Rows are range-partitioned on (series, order) and written once, so a hot series is many
    *pieces*.  Stretches are found inside every piece of a series; a table with one row per
    (series, piece) then says whether a stretch goes on from the piece before, and in which
    piece it began, so that parts of one stretch get one key and are merged by a second
    aggregate.  No window holds more than a piece, or a series' pieces.  Output: series,
    period_no, start/end time, rows, peak Kp and the time of the (first) peak.  A row with
    NULL Kp ends a stretch; a NULL series is a series of its own; rows that tie in ``order``
    stand in some order.
    """
    from helio.session import materialize
    base = df.select(series, *order, kp)
    n = pieces or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = materialize(base.repartitionByRange(n, series, *order).withColumn(
        "_piece", F.spark_partition_id()), "storm-pieces")
    time = F.col(order[0])
    w = Window.partitionBy(series, "_piece").orderBy(*order)
    storm = F.coalesce(F.col(kp) >= F.lit(STORM_KP), F.lit(False))
    rows = placed.withColumn("_storm", storm).withColumn(
        "_begins", F.col("_storm") & ~F.coalesce(F.lag("_storm").over(w), F.lit(False))).withColumns({
            "_island": F.sum(F.col("_begins").cast("int")).over(w),
            "_first": F.row_number().over(w) == 1})

    by_piece = Window.partitionBy(series).orderBy("_piece")
    seen = rows.groupBy(series, "_piece").agg(
        F.max("_island").alias("_n"), F.min("_storm").alias("_all"),
        F.max_by("_storm", F.struct(*order)).alias("_ends"),
        F.max(F.col("_first") & F.col("_storm")).alias("_head"))
    seen = seen.withColumn("_on", F.col("_head") & F.coalesce(
        F.lag("_ends").over(by_piece), F.lit(False)))
    # the piece in which the stretch at a piece's end began
    tail = F.last(F.when(~(F.col("_all") & F.col("_on")), F.col("_piece")),
                  ignorenulls=True).over(by_piece)
    seen = seen.withColumn("_tail", tail).withColumns({
        "_from": F.lag("_tail").over(by_piece),
        "_before": F.coalesce(F.sum(F.col("_n") - F.col("_on").cast("int")).over(
            by_piece.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))})
    seen = seen.select(F.col(series).alias("_s"), F.col("_piece").alias("_p"), "_on", "_from",
                       "_before")

    parts = rows.where("_storm").groupBy(series, "_piece", "_island").agg(
        F.min(time).alias("start_ts"), F.max(time).alias("end_ts"),
        F.count(F.lit(1)).alias("rows"), F.max(kp).alias("peak_kp"),
        F.min_by(F.struct(time.alias("t")), F.struct(-F.col(kp), *order)).alias("_at"))
    goes_on = F.col("_on") & (F.col("_island") == 1)
    parts = parts.join(seen, parts[series].eqNullSafe(seen["_s"]) & (
        F.col("_piece") == F.col("_p"))).withColumns({
            "_no": F.when(~goes_on, F.col("_before") + F.col("_island") - F.col("_on").cast("int")),
            "_start": F.when(goes_on, F.col("_from")).otherwise(F.col("_piece"))})
    # a stretch that goes on carries on the last number given in the piece where it began
    last = seen.select(F.col("_s").alias("_s2"), F.col("_p").alias("_p2"),
                       F.lead("_before").over(Window.partitionBy("_s").orderBy("_p")).alias(
                           "_last"))
    going = parts.join(last, parts[series].eqNullSafe(last["_s2"]) & (
        F.col("_start") == F.col("_p2")), "left")
    number = F.coalesce("_no", "_last").cast("int")
    return going.groupBy(series, number.alias("period_no")).agg(
        F.min("start_ts").alias("start_ts"), F.max("end_ts").alias("end_ts"),
        F.sum("rows").alias("rows"), F.max("peak_kp").alias("peak_kp"),
        F.min_by("_at", F.struct(-F.col("peak_kp"), F.col("_at.t"))).alias("_at")).select(
        series, "period_no", "start_ts", "end_ts", "rows", "peak_kp", F.col("_at.t").alias("peak_ts"))


def dst_severe(df: DataFrame, dst: str = "dst_index") -> DataFrame:
    """K5: rows with Dst <= −50, flagged when below the −100 severe line."""
    return df.where(F.col(dst) <= F.lit(-50.0)).withColumn(
        "severe", (F.col(dst) <= F.lit(-100.0)))


def drop_incomplete(df: DataFrame, subset: Sequence[str] | None = None) -> DataFrame:
    """K6: drop rows with any NULL."""
    return df.dropna(how="any", subset=list(subset) if subset else None)


def sample_n(df: DataFrame, n: int = 500, seed: int = 42, id_col: str = "event_id") -> DataFrame:
    """K7: repeatable sample of min(n, rows) by a hash order (bounded top-n)."""
    h = F.md5(F.concat(F.col(id_col).cast("string"), F.lit(f"-{seed}")))
    return df.orderBy(h, F.col(id_col)).limit(n)


def newest_first(df: DataFrame, n: int = 50, order: Sequence[str] = ORDER) -> DataFrame:
    """K8: last ``n`` rows, newest first."""
    return df.orderBy(*[F.col(c).desc() for c in order]).limit(n)
