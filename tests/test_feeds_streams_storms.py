"""Feeds, report, damaged input, streams over several triggers, storm periods, replay, KNN."""

import json
import math
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from helio.operators import quality, risk, select
from helio.schema import NUMERIC_COLUMNS
from helio.session import scratch_path
from helio.sources import feeds as S
from helio.sources import observations as O
from helio.streaming import streams

DAY = datetime(2024, 1, 1)


def tag(minutes):
    return (DAY + timedelta(minutes=minutes)).strftime("%Y-%m-%dT%H:%M:%S.%f")


# ---- S6, S7, S1 ------------------------------------------------------------------------

def poll(spark, rows):
    return spark.createDataFrame([(f, t, k, None) for f, t, k in rows], S.KP_FEED_SCHEMA)


def test_a_poll_is_all_or_nothing(spark):
    rows = [("good", tag(m), str(m)) for m in range(70)]
    rows += [("absent", tag(1), None), ("absent", tag(2), "2.5")]
    rows += [("nameless", None, "3"), ("nameless", tag(2), "4"), ("nan", tag(1), "NaN"),
             ("nan", tag(2), "1")]
    rows += [("bad value", tag(m), "2P" if m == 3 else "2") for m in range(5)]
    rows += [("bad time", tag(1), "2"), ("bad time", "yesterday", "2")]
    rows += [("old damage", tag(m), "n/a" if m == 0 else "1") for m in range(61)]
    got = {}
    for r in S.feed_kp_last60(poll(spark, rows), 60, "kp_index").collect():
        got.setdefault(r["feed"], {})[r["timestamp"]] = r["kp_index"]
    assert set(got) == {"good", "absent", "nameless", "nan", "old damage"}
    assert len(got["good"]) == 60 and min(got["good"].values()) == 10.0
    assert got["absent"] == {DAY + timedelta(minutes=1): 0.0, DAY + timedelta(minutes=2): 2.5}
    assert list(got["nameless"].values()) == [4.0] and list(got["nan"].values()) == [1.0]
    assert len(got["old damage"]) == 60  # what is older than the poll does not void it
    assert S.feed_kp_last60(poll(spark, []), 60, "kp_index").count() == 0
    with pytest.raises(Exception):
        S.feed_kp_last60(poll(spark, rows), 60, "kp_index", strict=True).collect()


def test_report_has_the_nine_lines_and_is_read_back(spark):
    row = {"series_id": 7, "kp_index": 6.12345, "sunspot_number": 12.0, "solar_wind_speed": None,
           "imf_bz": -3.00049, "satellite_disruption_risk": 40.5, "gps_blackout_prob": 1.0,
           "composite_risk": 33.335, "overall_severity": "High", "flare_class": 'M, "x"'}
    kinds = ", ".join(f"{k} {'long' if k == 'series_id' else 'string' if k in ('overall_severity', 'flare_class') else 'double'}"
                      for k in row)
    pred = spark.createDataFrame([tuple(row.values())], kinds)
    alerts = spark.createDataFrame([(7, 1, "kp_index", 6.12, "CRITICAL", 6.0, 'Strong, "G3"')],
                                   "series_id long, alert_rank int, metric string, value double, "
                                   "level string, threshold double, message string")
    path = scratch_path(spark, "report-test")
    S.write_report(S.report_rows(pred, alerts), path)
    got = {r["line"]: r for r in S.read_report(spark, path).collect()}
    assert [(got[i]["metric"], got[i]["value"]) for i in range(9)] == [
        ("Kp Index", "6.123"), ("Sunspot Number", "12.0"), ("Solar Wind Speed (km/s)", None),
        ("IMF Bz (nT)", "-3.0"), ("Satellite Disruption Risk", "40.5"),
        ("GPS Blackout Probability", "1.0"), ("Composite Risk Score", got[6]["value"]),
        ("Overall Severity", "High"), ("Flare Class", 'M, "x"')]
    assert got[6]["value"] in ("33.33", "33.34")
    assert got[101]["message"] == 'Strong, "G3"' and got[101]["threshold"] == "6.0"
    assert got[101]["section"] == "ACTIVE ALERTS" and len(got) == 10


def test_damaged_lines_are_quarantined_whole(spark, tmp_path):
    schema = T.StructType([T.StructField("event_id", T.LongType()),
                           T.StructField("timestamp", T.TimestampNTZType()),
                           T.StructField("kp_index", T.DoubleType()),
                           T.StructField("severity", T.StringType())])
    lines = ["event_id,timestamp,kp_index,severity", "1,2024-01-01T00:00:00.000000,3.5,Low",
             "2,2024-01-01T00:00:00.000000,,", "3,2024-01-01T00:00:00.000000,NaN,Low",
             "4,never,3.5,Low", "5,2024-01-01T00:00:00.000000,three,Low", "6,2024",
             "7,2024-01-01T00:00:00.000000,1.0,Low,more", "x,2024-01-01T00:00:00.000000,1.0,Low"]
    (tmp_path / "a.csv").write_text("\n".join(lines) + "\n")
    good, bad = O.scan_with_quarantine(spark, f"file://{tmp_path}", schema)
    assert {r["event_id"]: r["kp_index"] for r in good.collect()} == {1: 3.5, 2: None, 3: None}
    kept = bad.collect()
    assert sorted(r["record"] for r in kept) == sorted(lines[4:])
    assert all(r["file"].endswith("a.csv") for r in kept)


# ---- T2, T5 ----------------------------------------------------------------------------

def write_poll(folder, number, minutes):
    rows = [{"feed": "station-1", "time_tag": tag(m), "kp_index": str(m % 9), "kp": None}
            for m in minutes]
    (folder / f"poll{number}.json").write_text("\n".join(map(json.dumps, rows)))


def test_dedup_over_triggers_with_a_late_record_and_a_restart(spark, tmp_path):
    """Five files, one a trigger; polls overlap by 50 minutes.  Then the query starts again
    from its checkpoint: known records come again, and one that is too late."""
    src = tmp_path / "polls"
    src.mkdir()

    def run(out=None):
        stream = T2(spark, str(src))
        before = len(epochs)
        out = streams.run_to_table(stream, spark, "dedup-test", out=out)
        return out, len(epochs) - before

    epochs = []

    def T2(spark, path):
        clean = streams.clean_feed_stream(streams.read_stream(
            spark, path, S.KP_FEED_SCHEMA, max_files=1))
        return streams.dedup_polls(clean).drop("event_time")
    for i in range(5):
        write_poll(src, i, range(60 * i, 60 * i + 110))
        import os
        os.utime(src / f"poll{i}.json", (1_700_000_000 + i, 1_700_000_000 + i))
    out, _ = run()
    first = spark.read.parquet(out)
    assert first.count() == first.select("time_tag").distinct().count() == 350
    offsets = scratch_batches(spark, f"{out}-ckpt")
    assert offsets >= 4
    # the watermark is at minute 349 - 120: minute 100 is too late, minute 340 is known
    write_poll(src, 5, [100, *range(340, 420)])
    (src / "late.json").write_text(json.dumps(
        {"feed": "station-1", "time_tag": tag(0.5), "kp_index": "9", "kp": None}))
    again, _ = run(out)
    assert again == out
    rows = spark.read.parquet(out)
    assert rows.count() == rows.select("time_tag").distinct().count() == 420
    assert rows.where(F.col("time_tag") == tag(0.5)).count() == 0
    assert scratch_batches(spark, f"{out}-ckpt") > offsets


def scratch_batches(spark, checkpoint):
    """Micro-batches that a checkpoint has committed."""
    at = spark._jvm.org.apache.hadoop.fs.Path(f"{checkpoint}/commits")
    fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
    return sum(s.getPath().getName().isdigit() for s in fs.listStatus(at))


def keyed(spark, rows):
    return spark.createDataFrame(rows, "feed string, time_tag string, kp_value double")


def test_a_keyed_table_is_replaced_at_one_instant(spark):
    out = scratch_path(spark, "keyed-test")
    with pytest.raises(FileNotFoundError):
        streams.keyed_table(spark, out)
    streams.upsert(keyed(spark, [("a", "1", 1.0), ("b", "1", 2.0), (None, "1", 0.0)]), 0, out)
    streams.upsert(keyed(spark, [("b", "2", 5.0), ("c", "2", 3.0)]), 1, out)
    want = {("a", "1", 1.0), ("b", "2", 5.0), ("c", "2", 3.0), (None, "1", 0.0)}
    assert {tuple(r) for r in streams.keyed_table(spark, out).collect()} == want
    streams.upsert(keyed(spark, [("b", "2", 5.0), ("c", "2", 3.0)]), 1, out)  # a retried epoch
    assert {tuple(r) for r in streams.keyed_table(spark, out).collect()} == want
    # a version that is not committed yet is not the table
    keyed(spark, [("z", "9", 9.0)]).write.parquet(f"{out}/version=2")
    at = spark._jvm.org.apache.hadoop.fs.Path(f"{out}/version=2/_SUCCESS")
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, False)
    assert {tuple(r) for r in streams.keyed_table(spark, out).collect()} == want
    streams.upsert(keyed(spark, [(None, "3", 4.0)]), 2, out)
    rows = [tuple(r) for r in streams.keyed_table(spark, out).collect()]
    assert set(rows) == (want - {(None, "1", 0.0)}) | {(None, "3", 4.0)} and len(rows) == 4
    assert sorted(streams._versions(spark, out)) == [1, 2]  # older ones are gone


def test_the_newest_reading_stays_one_row_per_feed(spark, tmp_path):
    spark.createDataFrame([(f, tag(i), float(i)) for i in range(12) for f in "ab"],
                          "feed string, time_tag string, kp_value double") \
        .repartition(6).write.json(f"{tmp_path}/in")
    src = spark.readStream.schema("feed string, time_tag string, kp_value double") \
        .option("maxFilesPerTrigger", 1).json(f"{tmp_path}/in")
    out = streams.run_to_table(streams.stream_latest(src), spark, "latest-test", mode="update")
    assert {tuple(r) for r in streams.keyed_table(spark, out).collect()} == {
        (f, tag(11), 11.0) for f in "ab"}
    assert len(streams._versions(spark, out)) <= 2


# ---- K4, R9 ----------------------------------------------------------------------------

def brute_periods(rows):
    out = {}
    for s in {r[1] for r in rows}:
        number, now = 0, None
        for r in sorted((r for r in rows if r[1] == s), key=lambda r: (r[2], r[0])):
            if r[3] is None or r[3] < 5:
                now = None
                continue
            if now is None:
                number += 1
                now = out[s, number] = [r[2], r[2], 0, r[3], r[2]]
            now[1], now[2] = r[2], now[2] + 1
            if r[3] > now[3]:
                now[3], now[4] = r[3], r[2]
    return {(s, n): tuple(v) for (s, n), v in out.items()}


@pytest.mark.parametrize("pieces", [1, 3, 25])
def test_periods_across_pieces(spark, pieces):
    """A hot series with storms longer than several pieces, beside short ones."""
    rng = np.random.default_rng(3)
    rows = []
    for s, n in ((1, 400), (2, 9), (3, 1), (None, 30)):
        storm = False
        for t in range(n):
            storm = storm ^ (rng.random() < (0.02 if s == 1 else 0.3))
            kp = float(rng.integers(5, 9) if storm else rng.integers(0, 5))
            rows.append((len(rows), s, DAY + timedelta(hours=t), None if t % 97 == 50 else kp))
    df = spark.createDataFrame(
        rows, "event_id long, series_id long, timestamp timestamp_ntz, kp_index double")
    got = {(r["series_id"], r["period_no"]): tuple(r)[2:]
           for r in select.storm_periods(df.repartition(7), pieces=pieces).collect()}
    assert got == brute_periods(rows)
    assert max(v[2] for v in got.values()) > 400 / 25 * 2
    assert select.storm_periods(df.limit(0), pieces=pieces).count() == 0


def test_replay_of_overlapping_peaks(spark):
    """Windows that overlap, touch and stand alone: every pair once, nothing else joined."""
    rng = np.random.default_rng(6)
    obs = [(i, int(rng.integers(2)), DAY + timedelta(minutes=int(rng.integers(0, 60 * 24 * 20))),
            float(i)) for i in range(500)]
    peaks = [(1, n, DAY + timedelta(hours=int(h))) for n, h in enumerate(
        [0, 1, 2, 36, 72, 100, 101, 300, 460, 479])] + [(2, 1, DAY), (0, 1, DAY + timedelta(hours=9))]
    o = spark.createDataFrame(obs, "event_id long, series_id long, timestamp timestamp_ntz, kp_index double")
    p = spark.createDataFrame(peaks, "series_id long, period_no int, peak_ts timestamp_ntz")
    got = sorted((r["series_id"], r["period_no"], r["timestamp"], r["hour"], r["kp_index"])
                 for r in risk.replay_window(o, p).collect())
    want = []
    for s, n, at in peaks:
        for _, t, ts, kp in obs:
            hours = (ts - at + timedelta(hours=36)) / timedelta(hours=1)
            if s == t and 0 <= hours < 72:
                want.append((s, n, ts, math.floor(hours), kp))
    assert got == sorted(want) and len(want) > 250
    plan = risk.replay_window(o, p)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Generate") == 1 and "sequence(" not in plan  # two rows a peak


# ---- Q1 --------------------------------------------------------------------------------

def brute_cells(x, k):
    out, present = {}, ~np.isnan(x)
    for r, c in zip(*np.nonzero(~present)):
        both = present[r] & present
        with np.errstate(invalid="ignore", divide="ignore"):
            d = np.where(both, (x - x[r]) ** 2, 0).sum(1) * x.shape[1] / both.sum(1)
        usable = np.flatnonzero(present[:, c] & (both.sum(1) > 0))
        near = usable[np.lexsort((usable, d[usable]))][:k]
        out[r, c] = x[near, c].mean() if len(near) else np.nanmean(x[:, c])
    return out


@pytest.mark.parametrize("dims,cell_rows", [(0, 512), (2, 20), (3, 4), (4, 30)])
def test_pruned_imputation_equals_brute_force(spark, dims, cell_rows):
    """Any grid gives the same cells: rows that miss grid columns, hot values, far outliers."""
    rng = np.random.default_rng(8)
    x = rng.normal(size=(260, 5)) * [100, 30, 10, 3, 1]
    x[:90, 0] = 50.0                       # a hot value
    x[100:104, 0] = 1e6                    # far from everything
    x[:, 4] = (x[:, 4] > 0)
    x[rng.random(x.shape) < 0.06] = np.nan
    x[5] = [np.nan, np.nan, np.nan, np.nan, 1.0]
    names = list("abcde")
    df = spark.createDataFrame(
        [(i, *[None if np.isnan(v) else float(v) for v in row]) for i, row in enumerate(x)],
        "event_id long, " + ", ".join(f"{c} double" for c in names))
    report = {}
    got = {(r["event_id"], r["col_no"]): r["value"] for r in quality.knn_cells(
        df, names, 5, dims=dims, cell_rows=cell_rows, report=report).collect()}
    want = brute_cells(x, 5)
    assert set(got) == set(want)
    for cell, value in want.items():
        assert got[cell] == pytest.approx(value, rel=1e-9), cell
    assert report["pairs"] <= report["all_pairs"]
    if not dims:
        assert report["pairs"] == report["all_pairs"]


def test_a_grid_prunes_most_pairs(spark):
    """Observations of sf0.01: the same cells as without a grid, from a part of the pairs."""
    obs = O.observations(spark, "/root/testdata/sf0.01")
    pruned, whole = {}, {}
    a = quality.knn_cells(obs, NUMERIC_COLUMNS, cell_rows=100, report=pruned)
    b = quality.knn_cells(obs, NUMERIC_COLUMNS, dims=0, report=whole)
    assert {tuple(r) for r in a.collect()} == {tuple(r) for r in b.collect()}
    assert whole["pairs"] == whole["all_pairs"] == pruned["all_pairs"]
    assert pruned["pairs"] < 0.2 * pruned["all_pairs"]


def test_column_without_values_and_table_without_gaps(spark):
    rows = [(i, float(i), None, float(i % 3)) for i in range(30)] + [(30, None, None, 1.0)]
    df = spark.createDataFrame(rows, "event_id long, a double, b double, c double")
    got = {(r["event_id"], r["feature"]): r["value"] for r in quality.knn_cells(
        df, ["a", "b", "c"], 3, cell_rows=4).collect()}
    assert got[3, "b"] is None and got[30, "a"] == pytest.approx((1 + 4 + 7) / 3)
    assert quality.knn_cells(df.select("event_id", "c"), ["c"]).count() == 0
