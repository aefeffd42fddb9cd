"""48-hour forecasts per series from the recent rows.

All forecasts start from a bounded per-series tail (K2, ``row_number() <= n``,
planned with a partial ``WindowGroupLimit`` so at most n rows per series and
task are shuffled), reduce it with one grouped aggregate, and expand each
series to its 48 (or 2) steps with ``explode(sequence(...))``.

A metric whose tail holds a missing value yields a missing forecast (NumPy's
mean/max of an array with NaN is NaN in the reference).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from helio.functions.exprs import clip
from helio.operators.risk import peak_label_expr, storm_probability_expr
from helio.operators.select import tail_n
from helio.schema import PEAK_KP_CUTS, PEAK_SAT_CUTS, SERIES, TIME

KP, SAT, GPS, WIND = ("kp_index", "satellite_disruption_risk", "gps_blackout_prob",
                      "solar_wind_speed")


def _nan_avg(c: Column, cond: Column | None = None) -> Column:
    """avg that is NULL when any value in scope is NULL (NaN propagation)."""
    v = c if cond is None else F.when(cond, c)
    n_all = F.count(F.lit(1)) if cond is None else F.count_if(cond)
    n_ok = F.count(v)
    return F.when(n_ok == n_all, F.avg(v))


def _nan_max(c: Column) -> Column:
    return F.when(F.count(c) == F.count(F.lit(1)), F.max(c))


def hash_normal(key: Column, i: Column, seed: int) -> Column:
    """Repeatable standard-normal draw from (key, i, seed) (Box–Muller on two
    hash uniforms): recomputing a lost task gives the same numbers."""
    m = F.lit(2 ** 31)
    u1 = (F.pmod(F.xxhash64(key, i, F.lit(seed)), m) + 1) / (m + 1)
    u2 = (F.pmod(F.xxhash64(key, i, F.lit(seed + 1)), m) + 1) / (m + 1)
    return F.sqrt(F.lit(-2.0) * F.log(u1)) * F.cos(F.lit(6.283185307179586) * u2)


def _hours(ts: str, h: str) -> Column:
    return F.col(ts) + F.make_interval(hours=F.col(h))


def mean_forecast_48h(df: DataFrame, series: str = SERIES, n: int = 30, hours: int = 48,
                      noise_scale: float = 0.0, seed: int = 42) -> DataFrame:
    """Mean of the last ``n`` rows (missing readings are skipped) + one noise draw per hour shared by the
    three metrics (scaled 1, 5, 4), clipped to 0–9 / 0–100 / 0–100, rounded to 2."""
    t = tail_n(df, n, series)
    base = t.groupBy(series).agg(F.avg(KP).alias("_kp"), F.avg(SAT).alias("_sat"),
                                 F.avg(GPS).alias("_gps"),
                                 F.max(TIME).alias("_last"))
    out = base.select("*", F.explode(F.sequence(F.lit(1), F.lit(hours))).alias("h"))
    noise = (hash_normal(F.col(series), F.col("h"), seed) * F.lit(noise_scale)
             if noise_scale else F.lit(0.0))
    out = out.withColumn("_z", noise)
    return out.select(series, "h", _hours("_last", "h").alias(TIME),
                      F.round(clip(F.col("_kp") + F.col("_z"), 0.0, 9.0), 2)
                      .alias("predicted_kp_index"),
                      F.round(clip(F.col("_sat") + F.col("_z") * 5, 0.0, 100.0), 2)
                      .alias("predicted_satellite_risk"),
                      F.round(clip(F.col("_gps") + F.col("_z") * 4, 0.0, 100.0), 2)
                      .alias("predicted_gps_risk"))


TREND_METRICS = {KP: 0.3, SAT: 2.0, GPS: 1.5, WIND: 20.0}


def trend_forecast_48h(df: DataFrame, series: str = SERIES, metrics: dict | None = None,
                       hours: int = 48, history: int = 90, noise: bool = False,
                       seed: int = 42) -> DataFrame:
    """trend = (mean of last 7 − mean of last 30) / 23; each step
    ``clip(prev + trend + noise, 0, 1.1 · max of the last 90)``.

    Without noise the iteration has the closed form ``clip(last + h·trend)``.
    With noise the steps are a fold (``aggregate``) over a per-series array of
    normal draws, so the clip is applied after every step as in the reference.
    """
    metrics = metrics or TREND_METRICS
    t = tail_n(df, history, series)
    aggs = [F.max(TIME).alias("_last_ts")]
    for m in metrics:
        aggs += [_nan_avg(F.col(m), F.col("pos") <= 7).alias(f"_{m}_m7"),
                 _nan_avg(F.col(m), F.col("pos") <= 30).alias(f"_{m}_m30"),
                 F.max_by(F.col(m), F.col("pos") == 1).alias(f"_{m}_last"),
                 _nan_max(F.col(m)).alias(f"_{m}_max")]
    base = t.groupBy(series).agg(*aggs)
    cols = {}
    for number, (m, scale) in enumerate(metrics.items()):
        trend = (F.col(f"_{m}_m7") - F.col(f"_{m}_m30")) / F.lit(23.0)
        cap = F.col(f"_{m}_max") * F.lit(1.1)
        if not noise:
            x = clip(F.col(f"_{m}_last") + F.col("h") * trend, 0.0, None)
            cols[m] = F.when(x.isNull() | cap.isNull(), None).otherwise(F.least(x, cap))
        else:
            draws = F.transform(F.sequence(F.lit(1), F.lit(hours)),
                                lambda i: hash_normal(
                                    F.col(series), i, seed + 1000 * number) * F.lit(scale))
            prev = lambda acc: F.coalesce(F.get(acc, F.size(acc) - 1),
                                          F.col(f"_{m}_last"))
            path = F.aggregate(
                draws, F.array().cast("array<double>"),
                lambda acc, z: F.concat(acc, F.array(
                    F.greatest(F.lit(0.0), F.least(cap, prev(acc) + trend + z)))))
            # least and greatest skip NULL: a missing part makes the whole path missing
            known = F.col(f"_{m}_last").isNotNull() & trend.isNotNull() & cap.isNotNull()
            cols[m] = F.when(known, F.get(path, F.col("h") - 1))
    out = base.select("*", F.explode(F.sequence(F.lit(1), F.lit(hours))).alias("h"))
    return out.select(series, "h", _hours("_last_ts", "h").alias(TIME),
                      *[cols[m].alias(f"forecast_{m}") for m in metrics])


def two_step_trend(df: DataFrame, col: str = KP, series: str = SERIES, n: int = 14,
                   steps: int = 2) -> DataFrame:
    """trend = (last − first of the last ``n`` rows) / rows; last + k·trend."""
    t = tail_n(df, n, series)
    base = t.groupBy(series).agg(F.max_by(F.col(col), F.col("pos")).alias("_first"),
                                 F.min_by(F.col(col), F.col("pos")).alias("_last"),
                                 F.count(F.lit(1)).alias("_n"))
    out = base.select("*", F.explode(F.sequence(F.lit(1), F.lit(steps))).alias("step"))
    trend = (F.col("_last") - F.col("_first")) / F.col("_n")
    return out.select(series, "step", (F.col("_last") + F.col("step") * trend).alias(f"forecast_{col}"))


def forecast_peaks(fc: DataFrame, series: str = SERIES, jitter: float = 0.0) -> DataFrame:
    """C4: peak of each forecast metric, R7 labels for Kp and satellite risk, R8."""
    peaks = fc.groupBy(series).agg(*[F.max(f"forecast_{m}").alias(f"max_{m}")
                                     for m in TREND_METRICS])
    return peaks.select(
        "*",
        peak_label_expr(F.col(f"max_{KP}"), PEAK_KP_CUTS).alias("kp_severity"),
        peak_label_expr(F.col(f"max_{SAT}"), PEAK_SAT_CUTS).alias("sat_severity"),
        storm_probability_expr(F.col(f"max_{KP}"), jitter).alias("storm_probability"))
