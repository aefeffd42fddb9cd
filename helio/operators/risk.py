"""Risk scores, lifted from "the latest row" to every row of a table.

All scores are column expressions (one projection).  Fan-outs are bounded by
fixed lists: 5 mission systems per row (R4), 8 aurora regions per row (R5),
72 hourly buckets per storm peak (R9).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from helio.functions.exprs import at_least_label, clip
from helio.schema import (AURORA_REGIONS, COMPOSITE_WEIGHTS, FAILURE_LEVELS, FAILURE_TOP,
                          INSIGHT_CALM, INSIGHT_EXTREME, INSIGHT_GPS, INSIGHT_SAT,
                          INSIGHT_SEVERITY_PREFIX, INSIGHT_STORM, INSIGHT_WIND,
                          ISS_ALTITUDE_KM, ISS_FALLBACK, ISS_NAME, MISSION_BOTTOM,
                          MISSION_LEVELS, MISSION_SYSTEMS, RISK_ZONES)

KP, SAT, GPS, WIND, FLARE = ("kp_index", "satellite_disruption_risk", "gps_blackout_prob",
                             "solar_wind_speed", "flare_intensity")


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


# -- R1 ----------------------------------------------------------------------
def composite_risk_expr(kp=KP, sat=SAT, gps=GPS, wind=WIND, flare=FLARE) -> Column:
    """clip(.30·kp/9·100 + .25·sat + .20·gps + .15·(wind−280)/620·100 + .10·flare/5·100, 0, 100)."""
    norms = [_c(kp) / F.lit(9.0) * F.lit(100.0), _c(sat), _c(gps),
             (_c(wind) - F.lit(280.0)) / F.lit(620.0) * F.lit(100.0),
             _c(flare) / F.lit(5.0) * F.lit(100.0)]
    total = F.lit(0.0)
    for w, v in zip(COMPOSITE_WEIGHTS, norms):
        total = total + F.lit(w) * v
    return clip(total, 0.0, 100.0)


# -- R2 / R4 -------------------------------------------------------------------
def mission_score_expr(kp=KP, wind=WIND, gps=GPS, sat=SAT) -> Column:
    """min(kp·8 + wind/30 + gps·0.9 + sat·1.1, 100); no lower bound; NULL stays NULL."""
    raw = _c(kp) * F.lit(8.0) + _c(wind) / F.lit(30.0) + _c(gps) * F.lit(0.9) + _c(sat) * F.lit(1.1)
    return clip(raw, hi=100.0)


def mission_level_expr(score: Column) -> Column:
    return at_least_label(score, [(c, lvl) for c, lvl, _ in MISSION_LEVELS], MISSION_BOTTOM[0])


def mission_color_expr(score: Column) -> Column:
    return at_least_label(score, [(c, col) for c, _, col in MISSION_LEVELS], MISSION_BOTTOM[1])


def mission_risk(df: DataFrame) -> DataFrame:
    s = mission_score_expr()
    return df.withColumn("mission_score", s) \
             .withColumn("mission_level", mission_level_expr(F.col("mission_score"))) \
             .withColumn("mission_color", mission_color_expr(F.col("mission_score")))


def mission_systems(df: DataFrame, keys=("event_id",)) -> DataFrame:
    """Five rows per observation (system, risk level)."""
    level = mission_level_expr(mission_score_expr())
    kp = F.col(KP)
    per_system = [level, level, level,
                  F.when(kp > F.lit(6.0), F.lit("HIGH")).otherwise(F.lit("MODERATE")),
                  F.when(kp > F.lit(8.0), F.lit("EXTREME")).otherwise(level)]
    arr = F.array(*[F.struct(F.lit(i + 1).alias("system_no"), F.lit(name).alias("system"),
                             lvl.alias("risk_level"))
                    for i, (name, lvl) in enumerate(zip(MISSION_SYSTEMS, per_system))])
    return df.select(*keys, F.inline(arr))


# -- R3 ------------------------------------------------------------------------
def failure_score_expr(kp=KP, wind=WIND, gps=GPS, sat=SAT) -> Column:
    """clip(8·kp + min(wind/900,1)·25 + .35·gps + .45·sat, 0, 100) rounded to 2.

    A missing input makes the score 0 (the reference's max(0, NaN) is 0).
    """
    raw = (_c(kp) * F.lit(8.0)
           + F.when(_c(wind).isNull(), F.lit(None).cast("double"))
              .otherwise(F.least(_c(wind) / F.lit(900.0), F.lit(1.0))) * F.lit(25.0)
           + _c(gps) * F.lit(0.35) + _c(sat) * F.lit(0.45))
    return F.round(F.coalesce(clip(raw, 0.0, 100.0), F.lit(0.0)), 2)


def failure_level_expr(score: Column) -> Column:
    expr = None
    for cut, label in FAILURE_LEVELS:
        cond = score < F.lit(cut)
        expr = F.when(cond, F.lit(label)) if expr is None else expr.when(cond, F.lit(label))
    return expr.otherwise(F.lit(FAILURE_TOP))


def satellite_failure(df: DataFrame) -> DataFrame:
    return df.withColumn("failure_score", failure_score_expr()) \
             .withColumn("failure_level", failure_level_expr(F.col("failure_score")))


# -- R5 ------------------------------------------------------------------------
def aurora_jitter(obs_id: Column, region_no: Column) -> Column:
    """Deterministic stand-in for the reference's unseeded randint(5, 25)."""
    return F.lit(5) + F.pmod(obs_id * F.lit(31) + region_no * F.lit(17), F.lit(20))


def aurora_visibility(df: DataFrame, obs_id: str = "event_id", kp: str = KP) -> DataFrame:
    """Eight region rows per observation with ``is_best`` for the top region.

    The best region is found inside the row (sorted 8-element array), so no
    window or shuffle over observations is needed.
    """
    regions = []
    for i, name in enumerate(AURORA_REGIONS):
        no = F.lit(i + 1)
        vis = F.least(F.lit(100.0), F.col(kp) * F.lit(10.0) + aurora_jitter(F.col(obs_id), no))
        regions.append(F.struct(no.alias("region_no"), F.lit(name).alias("region"),
                                vis.alias("visibility")))
    arr = F.array(*regions)
    best = F.sort_array(F.transform(arr, lambda r: F.struct(
        (-r["visibility"]).alias("k"), r["region_no"].alias("region_no"))))[0]["region_no"]
    return (df.select(F.col(obs_id), arr.alias("regions"), best.alias("best_no"))
              .select(obs_id, "best_no", F.inline("regions"))
              .select(obs_id, "region_no", "region", "visibility",
                      (F.col("region_no") == F.col("best_no")).alias("is_best")))


# -- R6 ------------------------------------------------------------------------
def insight_expr(severity: Column, kp=KP, wind=WIND, gps=GPS, sat=SAT) -> Column:
    """One text per row; optional sentences are skipped (``concat_ws`` drops NULL)."""
    first = (F.when(_c(kp) >= F.lit(7.0), F.lit(INSIGHT_EXTREME))
             .when(_c(kp) >= F.lit(5.0), F.lit(INSIGHT_STORM))
             .otherwise(F.lit(INSIGHT_CALM)))
    return F.concat_ws(
        " ", first,
        F.when(_c(wind) > F.lit(650.0), F.lit(INSIGHT_WIND)),
        F.when(_c(gps) > F.lit(60.0), F.lit(INSIGHT_GPS)),
        F.when(_c(sat) > F.lit(60.0), F.lit(INSIGHT_SAT)),
        F.concat(F.lit(INSIGHT_SEVERITY_PREFIX), severity, F.lit(".")),
    )


# -- R7 / R8 -------------------------------------------------------------------
def peak_label_expr(v: Column, cuts) -> Column:
    """First cut with ``v >= cut`` (most severe first), else Low."""
    return at_least_label(v, cuts, "Low")


def storm_probability_expr(max_kp: Column, jitter: Column | float = 0.0) -> Column:
    """min(100, int(max_kp/9·100 + jitter)), truncating toward zero; NULL for no peak."""
    j = jitter if isinstance(jitter, Column) else F.lit(float(jitter))
    value = (max_kp / F.lit(9.0) * F.lit(100.0) + j).cast("int")
    return F.when(value.isNotNull(), F.least(F.lit(100), value))


# -- R9 ------------------------------------------------------------------------
def replay_window(obs: DataFrame, peaks: DataFrame, hours_before: int = 36,
                  hours_after: int = 36, series: str = "series_id", ts: str = "timestamp",
                  peak_ts: str = "peak_ts", peak_id: str = "period_no") -> DataFrame:
    """Observations in [peak − 36 h, peak + 36 h) of each storm peak, with the hour index.

    Time is cut into buckets as long as the window, so every window lies in two
    neighbouring ones: a peak is two rows, an observation one, and an equi-join on (series,
    bucket) with an exact range filter finds the pairs.  What is shuffled is the
    observations and two rows per peak, whether windows overlap or not, and at most about
    half of the joined pairs are filtered out again.
    """
    span = hours_before + hours_after
    width = F.lit(span * 3_600_000_000)

    def micros(c) -> Column:
        return F.unix_micros(c.cast("timestamp"))
    low = F.col("p_ts") - F.make_interval(hours=F.lit(hours_before))
    p = peaks.select(F.col(series).alias("p_series"), F.col(peak_id).alias("p_id"),
                     F.col(peak_ts).alias("p_ts")).withColumn("p_lo", micros(low))
    first = F.floor(F.col("p_lo") / width)
    p = p.withColumn("_bucket", F.explode(F.array(first, first + 1)))
    o = obs.select(series, ts, *[c for c in (KP, SAT, GPS) if c in obs.columns],
                   F.floor(micros(F.col(ts)) / width).alias("_bucket"))
    j = o.join(p, (o[series] == p["p_series"]) & (o["_bucket"] == p["_bucket"]))
    diff_us = micros(F.col(ts)) - F.col("p_lo")
    j = j.where((diff_us >= 0) & (diff_us < width))
    return j.select(F.col("p_series").alias(series), F.col("p_id").alias(peak_id),
                    F.col("p_ts").alias(peak_ts), F.col(ts),
                    F.floor(diff_us / F.lit(3_600_000_000)).cast("int").alias("hour"),
                    *[F.col(c) for c in (KP, SAT, GPS) if c in obs.columns])


# -- R10 -----------------------------------------------------------------------
def tracked_objects(positions: DataFrame) -> DataFrame:
    """Live position rows (one per feed) ∪ the three fixed risk zones.

    ``positions``: one row per ``feed`` with a struct ``iss_position`` (or plain columns) of
    ``latitude``/``longitude`` strings.  A feed whose newest record is malformed gets the
    fallback position, and so does a table without any feed (feed NULL).
    """
    at = "iss_position." if "iss_position" in positions.columns else ""
    found = positions.select("feed", *[F.col(f"{at}{c}").cast("string").alias(c)
                                       for c in ("latitude", "longitude")])
    none = found.agg(F.count(F.lit(1)).alias("n")).where("n = 0").select(
        *[F.lit(None).cast(f.dataType).alias(f.name) for f in found.schema.fields])
    lat, lon = (F.col(c).try_cast("double") for c in ("latitude", "longitude"))
    ok = lat.isNotNull() & lon.isNotNull()

    def place(name, latitude, longitude, zone, altitude):
        return F.struct(F.lit(name).alias("satellite"), latitude.alias("latitude"),
                        longitude.alias("longitude"), zone.alias("risk_zone"),
                        F.lit(altitude).alias("altitude_km"))
    live = place(ISS_NAME, F.when(ok, lat).otherwise(F.lit(ISS_FALLBACK[0])),
                 F.when(ok, lon).otherwise(F.lit(ISS_FALLBACK[1])),
                 F.when(ok, F.lit("Live Tracking")).otherwise(F.lit("Fallback Position")),
                 ISS_ALTITUDE_KM)
    zones = [place(n, F.lit(la), F.lit(lo), F.lit(z), alt) for n, la, lo, z, alt in RISK_ZONES]
    return found.unionByName(none).select("feed", F.inline(F.array(live, *zones)))
