"""Hand-made edge tables (FIXTURES.md §4): cuts, missing inputs, short series, ties."""

import math
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from helio.functions import exprs as X
from helio.operators import alerts, forecast, ml, quality, risk, select, stats, windows
from helio.schema import THRESHOLDS


def _obs_rows(spark, rows, cols):
    return spark.createDataFrame(rows, cols)


def test_threshold_cuts(spark):
    rows, want = [], []
    i = 0
    for metric, levels in THRESHOLDS.items():
        for thr, level, _ in levels:
            for delta, expect in ((0.0, level), (-0.01, None), (0.01, level)):
                vals = {m: None for m in THRESHOLDS}
                vals[metric] = thr + delta
                rows.append((i, 1, datetime(2024, 1, 1) + timedelta(minutes=i), *vals.values()))
                want.append((i, metric, expect, thr + delta))
                i += 1
    df = spark.createDataFrame(rows, "event_id long, series_id long, timestamp timestamp_ntz, "
                               + ", ".join(f"{m} double" for m in THRESHOLDS))
    got = {r["event_id"]: (r["metric"], r["level"]) for r in alerts.threshold_alerts(df).collect()}
    for eid, metric, expect, value in want:
        if expect is None:
            # just below a cut: the next lower level (or none)
            lv = [lvl for t, lvl, _ in THRESHOLDS[metric] if value >= t]
            assert got.get(eid, (metric, None))[1] == (lv[0] if lv else None)
        else:
            assert got[eid] == (metric, expect)


def test_missing_inputs(spark):
    df = spark.createDataFrame(
        [(1, 1, datetime(2024, 1, 1), None, None, None, None, None)],
        "event_id long, series_id long, timestamp timestamp_ntz, kp_index double, "
        "satellite_disruption_risk double, gps_blackout_prob double, solar_wind_speed double, "
        "flare_intensity double")
    assert alerts.threshold_alerts(df).count() == 0
    sev = alerts.overall_severity(df).first()
    assert sev["overall_severity"] == "Low" and sev["alert_count"] == 0
    r = df.select(risk.composite_risk_expr().alias("c"), risk.mission_score_expr().alias("m"),
                  risk.mission_level_expr(risk.mission_score_expr()).alias("ml"),
                  risk.failure_score_expr().alias("f")).first()
    assert r["c"] is None and r["m"] is None and r["ml"] == "LOW" and r["f"] == 0.0


def test_nan_becomes_null(spark):
    from helio.sources.observations import nan_to_null
    df = spark.createDataFrame([(float("nan"),)], "kp_index double")
    assert nan_to_null(df).first()["kp_index"] is None


def test_safe_float_edges(spark):
    texts = ["2P", "2.33", "", "-", "1-2", "1e-5", "-.5", "5.", None, "nan"]
    want = [2.0, 2.33, 0.0, 0.0, 0.0, 0.0, -0.5, 5.0, 0.0, 0.0]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, s string")
    got = [r["v"] for r in df.select("i", X.safe_float("s").alias("v")).orderBy("i").collect()]
    assert got == want


def test_one_row_series_windows(spark):
    df = spark.createDataFrame([(1, 7, datetime(2024, 1, 1), 4.0)],
                               "event_id long, series_id long, timestamp timestamp_ntz, kp_index double")
    out = windows.lag_rolling_features(df, ["kp_index"]).first()
    assert out["kp_index_lag1"] is None and out["kp_index_std7"] == 0.0
    assert out["kp_index_roll7"] == 4.0


@pytest.mark.parametrize("n,pairs", [(2, 0), (31, 0), (32, 1), (40, 9)])
def test_short_series_sequences(spark, n, pairs):
    df = spark.createDataFrame([(i, 1, datetime(2024, 1, 1) + timedelta(hours=i), float(i))
                                for i in range(n)],
                               "event_id long, series_id long, timestamp timestamp_ntz, kp_index double")
    seqs = windows.sequences(df, "kp_index", 30, 2).collect()
    assert len(seqs) == pairs
    for r in seqs:
        assert r["x"] == [float(v) for v in range(r["seq_no"], r["seq_no"] + 30)]
        assert r["y"] == [float(r["seq_no"] + 30), float(r["seq_no"] + 31)]


def test_halo_layout_equals_keyed(spark, obs):
    keyed = windows.lag_rolling_features(obs, ["kp_index", "imf_bz"], layout=windows.KEYED)
    chunked = windows.lag_rolling_features(obs, ["kp_index", "imf_bz"],
                                           layout=windows.Layout("chunked", chunk_rows=32))
    cols = ["event_id", "kp_index_lag3", "kp_index_roll30", "imf_bz_std7", "imf_bz_roll7"]
    a = sorted(tuple(round(v, 9) if isinstance(v, float) else v for v in r)
               for r in keyed.select(cols).collect())
    b = sorted(tuple(round(v, 9) if isinstance(v, float) else v for v in r)
               for r in chunked.select(cols).collect())
    assert a == b


def test_number_rows_skew_safe(spark, obs):
    # one global series numbered without a single-task window: 1..n, no gaps
    n = obs.count()
    out = windows.number_rows(obs.drop("series_id"), None, ("timestamp", "event_id"),
                              layout=windows.Layout("chunked"))
    rns = sorted(r["rn"] for r in out.select("rn").collect())
    assert rns == list(range(1, n + 1))


def test_knn_small_with_tie(spark):
    rows = [(1, 0.0, 0.0, None), (2, 1.0, 0.0, 10.0), (3, -1.0, 0.0, 20.0),
            (4, 0.0, 5.0, 30.0), (5, 0.0, -5.0, 40.0), (6, 9.0, 9.0, 50.0),
            (7, 1.0, 1.0, 60.0), (8, 5.0, 5.0, None)]
    df = spark.createDataFrame(rows, "event_id long, a double, b double, c double")
    cells = {r["event_id"]: r["value"] for r in quality.knn_cells(df, ["a", "b", "c"], k=2).collect()}
    # row 1: nearest with c present: ids 2 and 3 at d2=1.5 (tie) -> mean 15
    assert cells[1] == pytest.approx(15.0)
    # row 8 (5, 5): d2 = 1.5 x squared distance over (a, b): row 4 -> 37.5, rows 6 and 7
    # -> 48 (tie, lower id wins) -> mean of c over rows 4 and 6 = 40
    assert cells[8] == pytest.approx(40.0)
    full = quality.knn_impute(df, ["a", "b", "c"], k=2)
    present = {r["event_id"]: r["c"] for r in full.collect()}
    assert present[2] == 10.0 and present[1] == pytest.approx(15.0)


def test_knn_receivers_that_miss_a_grid_column_are_pruned(spark):
    """Rows without the widest column, without two, and full copies: the values of brute
    force, with a small part of the pairs."""
    import numpy as np
    rng = np.random.default_rng(5)
    x = rng.uniform(0, 1, (6000, 4)) * [1000, 600, 250, 30]
    x[3000:3200] = x[:200]
    x[:900, 0] = x[600:1200, 1] = np.nan
    rows = [(i, *[None if np.isnan(v) else float(v) for v in r]) for i, r in enumerate(x)]
    cols = ["a", "b", "c", "d"]
    df = spark.createDataFrame(rows, "event_id long, a double, b double, c double, d double")
    report = {}
    got = {(r["event_id"], r["feature"]): r["value"] for r in quality.knn_cells(
        df, cols, cell_rows=60, report=report).collect()}
    assert len(got) == 1500 and report["pairs"] < 0.1 * report["all_pairs"]
    for i in range(0, 1200, 37):
        both = ~np.isnan(x) & ~np.isnan(x[i])
        d2 = np.where(both, (np.nan_to_num(x) - np.nan_to_num(x[i])) ** 2, 0).sum(1)
        with np.errstate(divide="ignore"):
            d2 = np.where(both.any(1), d2 * (4 / both.sum(1)), np.inf)
        for j in np.nonzero(np.isnan(x[i]))[0]:
            ids = [n for n in np.lexsort((np.arange(len(x)), d2)) if not np.isnan(x[n, j])][:5]
            assert got[i, cols[j]] == pytest.approx(x[ids, j].mean()), (i, j)


@pytest.mark.parametrize("limited", [False, True])
def test_a_group_compares_only_leaves_within_the_limit(limited):
    """4,000 donors in one group: a part of them is compared, the nearest five are exact."""
    rng = np.random.default_rng(5)
    D, R = rng.random((4000, 4)), rng.random((60, 4))
    D[::20, 3], R[:, 3], R[:9, 0] = np.nan, np.nan, np.nan
    ids = rng.permutation(4000)
    both = ~np.isnan(R)[:, None, :] & ~np.isnan(D)[None, :, :]
    d2 = 4.0 / both.sum(axis=2) * np.where(both, R[:, None, :] - D[None, :, :], 0.0).__pow__(2).sum(axis=2)
    want = {}
    for r, c in zip(*np.nonzero(np.isnan(R))):
        near = np.where(np.isnan(D[:, c]), np.inf, d2[r])
        want[r, c] = sorted(zip(near, ids, strict=True))[:5]
    limit = np.array([max(want[r, c][-1][0] for c in range(4) if (r, c) in want) for r in range(60)])
    r, c, d, ex, pairs = quality._group_nearest(
        R, D, limit * (1 + 1e-9) if limited else np.full(60, np.inf), ids, 5)
    got = {}
    for a, b, i, x in zip(r, c, ids[d], ex, strict=True):
        got.setdefault((a, b), []).append((x, i))
    assert {k: [i for _, i in sorted(v)] for k, v in got.items()} == \
        {k: [i for _, i in v] for k, v in want.items()}
    assert pairs < 0.6 * 60 * 4000


def test_flat_column(spark):
    df = spark.createDataFrame([(i, 3.0, float(i)) for i in range(10)], "event_id long, f double, g double")
    scaled, params = quality.standard_scale(df, ["f", "g"])
    assert {r["f"] for r in scaled.collect()} == {0.0}
    assert params["f"][1] == 1.0
    cm = {(r["col_a"], r["col_b"]): r["corr"] for r in stats.correlation_matrix(df, ["f", "g"]).collect()}
    assert cm[("f", "g")] is None and cm[("g", "g")] == pytest.approx(1.0)


def test_absent_class(spark):
    df = spark.createDataFrame([("A", 1), ("A", 0), ("C", 1)], "flare_class string, storm_flag int")
    got = {r["flare_class"]: r["storm_prob_pct"] for r in stats.storm_prob_by_flare(df).collect()}
    assert got == {"A": 50.0, "B": 0.0, "C": 100.0, "M": 0.0, "X": 0.0}


def test_two_storms(spark):
    kps = [1, 6, 2, 5, 6, 7, 5, 1]
    df = spark.createDataFrame([(i, 1, datetime(2024, 1, 1) + timedelta(hours=i), float(k))
                                for i, k in enumerate(kps)],
                               "event_id long, series_id long, timestamp timestamp_ntz, kp_index double")
    p = select.storm_periods(df).orderBy("period_no").collect()
    assert [(r["rows"], r["peak_kp"]) for r in p] == [(1, 6.0), (4, 7.0)]
    rep = risk.replay_window(df, select.storm_periods(df))
    hours = sorted(r["hour"] for r in rep.where("period_no = 2").collect())
    assert hours == [31, 32, 33, 34, 35, 36, 37, 38]


def test_confusion_sums_and_report(spark, obs):
    conf = ml.severity_confusion(obs, 300)
    assert conf.count() == 16
    assert conf.agg(F.sum("rows")).first()[0] == 300
    rep = {r["label"]: r for r in ml.classification_report(conf).collect()}
    assert rep["accuracy"]["support"] == 300


def test_scale_inverse_identity(spark, obs):
    cols = ["kp_index", "sunspot_number"]
    scaled, params = quality.standard_scale(obs, cols)
    back = quality.inverse_scale(scaled, params)
    a = {r["event_id"]: r["kp_index"] for r in obs.select("event_id", "kp_index").collect()}
    b = {r["event_id"]: r["kp_index"] for r in back.select("event_id", "kp_index").collect()}
    assert all(math.isclose(a[k], b[k], abs_tol=1e-9) for k in a)


def test_trend_noise_fold_matches_closed_form_without_noise(spark, obs):
    closed = forecast.trend_forecast_48h(obs)
    # the fold with zero-scale noise must equal the closed form
    folded = forecast.trend_forecast_48h(obs, metrics={k: 0.0 for k in forecast.TREND_METRICS},
                                         noise=True)
    c = {(r["series_id"], r["h"]): r["forecast_kp_index"] for r in closed.collect()}
    f = {(r["series_id"], r["h"]): r["forecast_kp_index"] for r in folded.collect()}
    for k, v in c.items():
        assert (v is None and f[k] is None) or math.isclose(v, f[k], abs_tol=1e-9)


def test_clip_bounds(spark, obs):
    out = obs.select(X.clip("imf_bz", -5.0, 5.0).alias("c"), "imf_bz").collect()
    for r in out:
        if r["imf_bz"] is None:
            assert r["c"] is None
        else:
            assert -5.0 <= r["c"] <= 5.0


def _rows(df, cols):
    return sorted(tuple(round(v, 9) if isinstance(v, float) else v for v in r)
                  for r in df.select(cols).collect())


def test_the_keyed_window_is_used_only_where_every_series_fits_a_chunk(obs):
    longest = max(r["count"] for r in obs.groupBy("series_id").count().collect())
    assert windows.Layout().mode == windows.CHUNKED.mode == "chunked"
    fits, too_long = (windows.Layout(chunk_rows=longest - i) for i in (0, 1))
    assert windows.measured(obs, "series_id", fits) == windows.KEYED
    assert windows.measured(obs, "series_id", too_long) == too_long
    assert windows.measured(obs, None, fits) == fits  # one series without a key stays cut
    unread = windows.Layout(measure=False)
    assert windows.measured(obs, "series_id", unread) == unread


def test_split_takes_the_number_of_pairs_from_the_numbering(spark, obs):
    seqs = windows.sequences(obs, "kp_index", 30, 2, total="n_seq")
    for r in seqs.groupBy("series_id").agg(F.count("x").alias("n"), F.max("n_seq").alias("m"),
                                           F.min("n_seq").alias("k")).collect():
        assert r["n"] == r["m"] == r["k"]
    parts = windows.chronological_split(seqs).groupBy("series_id").agg(
        F.count_if(F.col("split") == "train").alias("train"), F.count("x").alias("n"))
    assert all(r["train"] == int(r["n"] * 0.85) for r in parts.collect())


def test_storm_periods_chunked_equals_keyed(spark, obs):
    cols = ["series_id", "period_no", "start_ts", "end_ts", "rows", "peak_kp", "peak_ts"]
    a = select.storm_periods(obs, pieces=1)
    b = select.storm_periods(obs, pieces=40)
    assert _rows(a, cols) == _rows(b, cols)


def test_sequences_chunked_equals_keyed(spark, obs):
    a = windows.sequences(obs, "kp_index", 30, 2, layout=windows.KEYED)
    b = windows.sequences(obs, "kp_index", 30, 2, layout=windows.Layout("chunked", chunk_rows=40))
    key = lambda r: (r["series_id"], r["seq_no"])
    ra = sorted(((key(r), r["event_id"], list(r["x"]), list(r["y"])) for r in a.collect()))
    rb = sorted(((key(r), r["event_id"], list(r["x"]), list(r["y"])) for r in b.collect()))
    assert ra == rb


@pytest.mark.parametrize("score,level", [(39.99, "LOW"), (40.0, "MODERATE"), (59.99, "MODERATE"),
                                         (60.0, "HIGH"), (80.0, "EXTREME"), (150.0, "EXTREME")])
def test_mission_cuts(spark, score, level):
    df = spark.createDataFrame([(score,)], "s double")
    assert df.select(risk.mission_level_expr(F.col("s"))).first()[0] == level


@pytest.mark.parametrize("score,level", [(29.99, "Low"), (30.0, "Moderate"), (54.99, "Moderate"),
                                         (55.0, "High"), (74.99, "High"), (75.0, "Extreme")])
def test_failure_cuts(spark, score, level):
    df = spark.createDataFrame([(score,)], "s double")
    assert df.select(risk.failure_level_expr(F.col("s"))).first()[0] == level


def test_failure_missing_wind_is_zero_low(spark):
    df = spark.createDataFrame([(5.0, None, 50.0, 50.0)],
                               "kp_index double, solar_wind_speed double, gps_blackout_prob double, "
                               "satellite_disruption_risk double")
    r = risk.satellite_failure(df).first()
    assert r["failure_score"] == 0.0 and r["failure_level"] == "Low"


def test_overlapping_polls_dedup(spark, tmp_path):
    """Two poll files of 60 minutes sharing 50: 120 records in, 70 distinct out."""
    from helio.sources import feeds as S
    from helio.streaming import streams as T
    base = datetime(2024, 1, 1)

    def poll(start):
        return [{"feed": "station-1",
                 "time_tag": (base + timedelta(minutes=m)).strftime("%Y-%m-%dT%H:%M:%S.000000"),
                 "kp_index": str(m % 9), "kp": f"{m % 9}P"} for m in range(start, start + 60)]
    src = tmp_path / "polls"
    src.mkdir()
    import json
    for i, start in enumerate((0, 10)):
        (src / f"poll{i}.json").write_text("\n".join(json.dumps(r) for r in poll(start)))
    clean = T.clean_feed_stream(T.read_stream(spark, str(src), S.KP_FEED_SCHEMA, max_files=1))
    out = T.run_to_table(T.dedup_polls(clean).drop("event_time"), spark, "test-dedup")
    got = spark.read.parquet(out)
    assert got.count() == 70  # the 50 repeated minutes are dropped
    assert got.select("time_tag").distinct().count() == 70


def test_cluster_conf_sizes_partitions():
    from helio.session import cluster_conf
    conf = cluster_conf(100 * (1 << 40), cores=8000)
    assert int(conf["spark.sql.shuffle.partitions"]) == 409600
    assert int(cluster_conf(1 << 20, cores=8)["spark.sql.shuffle.partitions"]) == 16


def test_feature_columns_rules(spark, obs):
    from helio.plans.prepare import engineer, feature_columns
    eng = engineer(obs, impute=False)
    feats = feature_columns(eng)
    assert len(feats) == 43
    assert "kp_index" in feats and "year" not in feats and "severity_enc" not in feats
    assert not {"event_id", "series_id", "kp_raw", "satellite_disruption_risk",
                "gps_blackout_prob", "storm_flag"} & set(feats)
    assert len(feature_columns(eng, target="kp_index")) == 42


def test_hash_split_is_repeatable(spark, obs):
    a = ml.train_test_split(obs).select("event_id", "split")
    b = ml.train_test_split(obs).select("event_id", "split")
    assert sorted(a.collect()) == sorted(b.collect())
    share = a.where("split = 'test'").count() / a.count()
    assert 0.15 < share < 0.25


def test_knn_block_cols_equals_per_block_brute_force(spark, obs):
    from helio.schema import NUMERIC_COLUMNS
    blocked = {(r["event_id"], r["col_no"]): r["value"]
               for r in quality.knn_cells(obs, NUMERIC_COLUMNS, block_cols=["series_id"],
                                          receiver_block=4, donor_block=16).collect()}
    for sid in [r[0] for r in obs.select("series_id").distinct().limit(3).collect()]:
        one = obs.where(F.col("series_id") == sid)
        alone = {(r["event_id"], r["col_no"]): r["value"]
                 for r in quality.knn_cells(one, NUMERIC_COLUMNS).collect()}
        assert alone, sid
        for key, v in alone.items():
            assert blocked[key] == pytest.approx(v, abs=1e-9)


def test_knn_split_blocks_equal_single_block(spark, obs):
    from helio.schema import NUMERIC_COLUMNS
    a = {(r["event_id"], r["col_no"]): r["value"] for r in quality.knn_cells(obs, NUMERIC_COLUMNS).collect()}
    b = {(r["event_id"], r["col_no"]): r["value"]
         for r in quality.knn_cells(obs, NUMERIC_COLUMNS, receiver_block=7, donor_block=50).collect()}
    assert a.keys() == b.keys()
    assert all(a[k] == pytest.approx(b[k], abs=1e-9) for k in a)


def _series(spark, values, col="kp_index"):
    cols = ["kp_index", "satellite_disruption_risk", "gps_blackout_prob", "solar_wind_speed"]
    rows = [(i, 1, datetime(2024, 1, 1) + timedelta(hours=i),
             *[v if c == col else 10.0 for c in cols]) for i, v in enumerate(values)]
    return spark.createDataFrame(rows, "event_id long, series_id long, timestamp timestamp_ntz, "
                                 + ", ".join(f"{c} double" for c in cols))


@pytest.mark.parametrize("mode", ["keyed", "chunked"])
def test_sequences_keep_nulls_in_place(spark, mode):
    df = _series(spark, [float(i) if i not in (3, 8) else None for i in range(12)])
    got = windows.sequences(df, "kp_index", 4, 2, layout=windows.Layout(mode)).orderBy("seq_no")
    rows = got.collect()
    assert [r["seq_no"] for r in rows] == list(range(7))
    for r in rows:
        want = [float(i) if i not in (3, 8) else None
                for i in range(r["seq_no"], r["seq_no"] + 6)]
        assert r["x"] + r["y"] == want


def test_mean_forecast_skips_missing_readings(spark):
    df = _series(spark, [2.0, None, 4.0])
    row = forecast.mean_forecast_48h(df, hours=1).first()
    assert row["predicted_kp_index"] == 3.0


def test_noisy_trend_needs_every_part(spark):
    df = _series(spark, [300.0] * 40 + [None], "solar_wind_speed")
    rows = forecast.trend_forecast_48h(df, noise=True).collect()
    assert all(r["forecast_solar_wind_speed"] is None for r in rows)
    kp = [r["forecast_kp_index"] - 10.0 for r in rows]
    sat = [r["forecast_satellite_disruption_risk"] - 10.0 for r in rows]
    assert [k > 0 for k in kp] != [s > 0 for s in sat]


def test_storm_probability_of_a_missing_peak(spark):
    df = spark.createDataFrame([(1, 4.5), (2, None), (3, 12.0)], "i long, k double")
    got = {r["i"]: r["p"] for r in df.select(
        "i", risk.storm_probability_expr(F.col("k")).alias("p")).collect()}
    assert got == {1: 50, 2: None, 3: 100}


def test_best_model_ties_take_the_first_name(spark):
    df = spark.createDataFrame([("t", m, 0.5) for m in ("Ridge", "GBT", "Linear")]
                               + [("t", "A", None), ("u", "B", None)],
                               "target string, model string, r2 double")
    got = {r["target"]: r["best_model"] for r in ml.best_by_group(df).collect()}
    assert got == {"t": "GBT", "u": "B"}


def test_histogram_has_every_bin_and_no_column_may_be_empty(spark):
    df = spark.createDataFrame([(0.0, None), (10.0, None), (10.0, None)], "a double, b double")
    rows = {r["bin"]: r["rows"] for r in stats.risk_histogram(df, ("a", "b"), 5).collect()}
    assert rows == {0: 1, 1: 0, 2: 0, 3: 0, 4: 2}
    assert stats.risk_histogram(df.where("a > 99"), ("a", "b")).count() == 0
    assert stats.risk_kde(df, ("b",)).count() == 0


def test_stream_source_turns_nan_into_null(spark, tmp_path):
    from helio.streaming import streams
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.json").write_text(
        '{"event_id":1,"series_id":1,"timestamp":"2024-01-01T00:00:00.000000","kp_index":NaN}\n')
    out = streams.read_stream(spark, str(tmp_path / "in"), streams.OBS_STREAM_SCHEMA)
    q = (streams.stream_alerts(out).writeStream.format("memory").queryName("nan_alerts")
         .option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start())
    q.awaitTermination(60)
    assert spark.table("nan_alerts").count() == 0


def test_a_cluster_needs_a_shared_folder():
    from helio import session

    class None_:
        def isDefined(self):
            return False

    class Fake:
        master = "spark://host:7077"
        sparkContext = conf = _jsc = property(lambda self: self)
        get = lambda self, *a: None
        getConf = sc = lambda self: self
        getCheckpointDir = lambda self: None_()

    with pytest.raises(RuntimeError):
        session.ensure_checkpoint_dir(Fake())


def _line(spark, n=200):
    """y = 3 a − 2 b + 1 with a small fixed wobble."""
    rows = [(i, float(i % 17), float((i * 7) % 23),
             3.0 * (i % 17) - 2.0 * ((i * 7) % 23) + 1.0 + ((i * 13) % 5 - 2) / 10) for i in range(n)]
    return spark.createDataFrame(rows, "event_id long, a double, b double, y double")


SMALL = {"Random Forest": {"numTrees": 5, "maxDepth": 4},
         "Gradient Boosting": {"maxIter": 3, "maxDepth": 3},
         "Gradient Boosting Subsampled": {"maxIter": 3, "maxDepth": 3, "subsamplingRate": 0.8}}


@pytest.fixture(scope="module")
def trained(spark):
    (run,) = ml.train_models(_line(spark), ["a", "b", "y"], ["y"], SMALL)
    return run


def test_linear_and_ridge_equal_the_closed_form(spark, trained):
    import numpy as np
    fitted = trained.models
    assert trained.features == ["a", "b"]
    train, _, _ = ml.split_vectors(_line(spark), ["a", "b"], "y")
    rows = train.collect()
    x = np.array([r["features"].toArray() for r in rows])
    y = np.array([r["label"] for r in rows])
    xc, yc = x - x.mean(0), y - y.mean()
    for name, alpha in (("Linear Regression", 0.0), ("Ridge Regression", 1.0)):
        want = np.linalg.solve(xc.T @ xc + alpha * np.eye(2), xc.T @ yc)
        m = fitted[name]
        assert np.allclose(m.coefficients.toArray(), want, atol=1e-6), name
        assert abs(m.intercept - (y.mean() - x.mean(0) @ want)) < 1e-5


def test_every_model_predicts_every_test_row(spark, trained):
    scores, preds, fitted = trained.scores, trained.predictions, trained.models
    _, test, _ = ml.split_vectors(_line(spark), ["a", "b"], "y")
    n = test.count()
    got = {r["model"]: r["n"] for r in preds.groupBy("model").agg(F.count("yhat").alias("n")).collect()}
    assert got == {m: n for m in ml.MODEL_PARAMS}
    assert {s[0] for s in scores} == set(fitted) == set(ml.MODEL_PARAMS)
    best = ml.regression_metrics(preds).where("model = 'Linear Regression'").first()
    assert best["r2"] > 0.99


def test_importances_sum_to_one_and_are_ranked(spark, trained):
    top = ml.feature_importance_top(trained.models["Random Forest"], ["a", "b"], spark, 20).collect()
    assert abs(sum(r["importance"] for r in top) - 1.0) < 1e-9
    assert top[0]["importance"] >= top[1]["importance"]


def test_model_store_reloads_the_best_model(spark, trained, tmp_path):
    _, test, _ = ml.split_vectors(_line(spark), ["a", "b"], "y")
    base = f"file://{tmp_path}/models"
    for best in ("Linear Regression", "Random Forest", "Gradient Boosting"):
        ml.save_models(trained.models, "y", best, base)
        again = ml.load_best_model(spark, base, "y", best)
        both = ml.predictions({"saved": trained.models[best], "reloaded": again}, test, "y")
        assert both.groupBy("event_id").agg(F.countDistinct("yhat").alias("n")).where("n > 1").count() == 0
    with pytest.raises(FileNotFoundError):
        ml.load_best_model(spark, base, "absent", "Random Forest")


def test_the_model_store_holds_every_target(spark, monkeypatch):
    from helio.plans import q_ml
    from helio.schema import TARGETS
    df = _line(spark).withColumns({t: F.col("y") + i * F.col("a") for i, t in enumerate(TARGETS)})

    def small(spark, sf_dir, targets=TARGETS, models=None):
        return df, ml.train_models(df, ["a", "b"], targets, SMALL, models=models)
    monkeypatch.setattr(q_ml, "_train", small)
    rows = q_ml.q_model_store(spark, "").collect()
    assert {(r["target"], r["model"]) for r in rows} == {(t, m) for t in TARGETS for m in ml.MODEL_PARAMS}
    assert len(rows) == 15 and {r["n"] for r in rows} == {rows[0]["n"]}
    best = {r["target"]: r for r in rows if r["is_best"]}
    assert set(best) == set(TARGETS) and all(r["differs"] == 0 for r in best.values())
    assert all(r["differs"] is None for r in rows if not r["is_best"])
    assert all(r["reloaded"] == best[r["target"]]["reloaded"] for r in rows)


def test_fits_of_several_targets_share_a_pool(spark):
    """Two targets, rows in several partitions: the same models as one by one."""
    df = _line(spark).withColumn("z", F.col("a") - F.col("b"))
    both = ml.train_models(df, ["a", "b", "y", "z"], ["y", "z"], SMALL, rows_per_partition=50,
                           models=["Random Forest", "Ridge Regression"])
    assert [r.target for r in both] == ["y", "z"]
    for run in both:
        assert list(run.models) == ["Ridge Regression", "Random Forest"]
        assert run.features == [c for c in ("a", "b", "y", "z") if c != run.target]
        (alone,) = ml.train_models(df, ["a", "b", "y", "z"], [run.target], SMALL,
                                   rows_per_partition=50, models=["Ridge Regression"])
        a, b = (r.models["Ridge Regression"].coefficients.toArray() for r in (run, alone))
        assert a == pytest.approx(b)
    assert spark.sparkContext._jsc.getPersistentRDDs().size() == 0  # nothing stays cached


def test_a_forest_is_grown_in_groves_and_joined(spark, monkeypatch, tmp_path):
    """12 trees in 3 fits are one forest of 12 trees: the mean of all, saved and loaded whole."""
    import numpy as np
    from pyspark.ml.regression import RandomForestRegressionModel
    monkeypatch.setattr(ml, "GROVE_TREES", 5)
    monkeypatch.setattr(ml, "GROVE_ROWS", 100)
    few = {"Random Forest": {"numTrees": 12, "maxDepth": 3, "minInstancesPerNode": 2}}
    forest = ml.build_estimators(100, 1.0, few)["Random Forest"]
    assert [e.getNumTrees() for e in ml.groves(forest, 99)] == [12]
    parts = ml.groves(forest, 100)
    assert [e.getNumTrees() for e in parts] == [4, 4, 4]
    assert len({e.getSeed() for e in parts}) == 3 and parts[0].getSeed() == forest.getSeed()

    (run,) = ml.train_models(_line(spark), ["a", "b", "y"], ["y"], few, models=["Random Forest"])
    whole = run.models["Random Forest"]
    assert whole.getNumTrees == len(whole.trees) == 12
    assert whole.getOrDefault("maxDepth") == 3
    assert sum(whole.featureImportances.toArray()) == pytest.approx(1.0)
    rows = [r["features"] for r in run.test.collect()]
    got = [whole.predict(x) for x in rows]
    assert got == pytest.approx([np.mean([t.predict(x) for t in whole.trees]) for x in rows])
    assert len({t.toDebugString.split("\n", 1)[1] for t in whole.trees}) > 4  # no grove twice
    path = f"file://{tmp_path}/forest"
    whole.write().save(path)
    again = RandomForestRegressionModel.load(path)
    assert again.getNumTrees == 12 and [again.predict(x) for x in rows] == got


def _preds(run, *names):
    return {(r["model"], r["event_id"]): r["yhat"] for r in run.predictions.collect()
            if not names or r["model"] in names}


def test_a_boosted_chain_is_one_task_and_equals_the_passes(spark):
    """30 trees take a few jobs, not one a level; the trees are those that pyspark.ml grows."""
    sc, name = spark.sparkContext, "Gradient Boosting"
    deep = {name: {"maxIter": 30, "maxDepth": 4, "stepSize": 0.1, "minInstancesPerNode": 6}}
    # uneven labels: of splits that are equally good either may be taken
    df = _line(spark, 600).withColumns({"zero": F.lit(0.0), "a2": F.col("a") * 2,
                                        "y": F.col("y") + F.sin(F.col("event_id") * 1.7)})
    sc.setJobGroup("one-task", "")
    try:
        (run,) = ml.train_models(df, ["zero", "b", "a", "a2"], ["y"], deep, models=[name])
        assert len(sc.statusTracker().getJobIdsForGroup("one-task")) < 30
    finally:
        sc.setLocalProperty("spark.jobGroup.id", None)
    (passes,) = ml.train_models(df, ["zero", "b", "a", "a2"], ["y"], deep, models=[name], task_values=0)
    got, want = _preds(run), _preds(passes)
    assert len(got) > 20 and got == pytest.approx(want, rel=1e-9)
    a, b = run.models[name], passes.models[name]
    assert a.treeWeights == b.treeWeights and a.totalNumNodes == b.totalNumNodes
    assert a.featureImportances.toArray() == pytest.approx(b.featureImportances.toArray(), abs=1e-9)


def test_a_deep_forest_takes_few_jobs(spark):
    """A level is no pass over the table: not a job each."""
    sc, jobs = spark.sparkContext, {}
    deep = {"Random Forest": {"numTrees": 3, "maxDepth": 12}}
    df = _line(spark, 600).withColumn("y", F.col("y") + F.sin(F.col("event_id") * 1.7))
    for task_values in (ml.TASK_VALUES, 0):
        sc.setJobGroup(f"forest-{task_values}", "")
        try:
            (run,) = ml.train_models(df, ["a", "b"], ["y"], deep, models=["Random Forest"],
                                     task_values=task_values)
        finally:
            sc.setLocalProperty("spark.jobGroup.id", None)
        jobs[task_values] = len(sc.statusTracker().getJobIdsForGroup(f"forest-{task_values}"))
        top = ml.feature_importance_top(run.models["Random Forest"], ["a", "b"], spark, 20).collect()
        assert sum(r["importance"] for r in top) == pytest.approx(1.0) and len(top) == 2
    assert jobs[ml.TASK_VALUES] <= 10 < jobs[0]


def test_grown_trees_load_as_models_that_predict_the_same(spark, monkeypatch):
    """Rows dealt in another way give the same trees; so do groves of a forest, joined."""
    monkeypatch.setattr(ml, "GROVE_TREES", 2)
    monkeypatch.setattr(ml, "GROVE_ROWS", 100)
    names = ["Random Forest", "Gradient Boosting Subsampled"]
    df = _line(spark)
    (run,) = ml.train_models(df, ["a", "b"], ["y"], SMALL, models=names)
    (dealt,) = ml.train_models(df.repartition(5, "b"), ["a", "b"], ["y"], SMALL, models=names)
    got = _preds(run)
    assert got == pytest.approx(_preds(dealt), rel=1e-12)
    loaded = ml.predictions(dict(run.models), run.test, "y").collect()
    assert got == pytest.approx({(r["model"], r["event_id"]): r["yhat"] for r in loaded}, rel=1e-12)
    forest = run.models["Random Forest"]
    assert forest.getNumTrees == 5 and len({t.toDebugString.split("\n", 1)[1] for t in forest.trees}) > 2


def test_grown_trees_are_saved_without_the_driver(spark, trained, tmp_path, monkeypatch):
    """A forest's nodes go from table to table; the driver's memory does not hold them."""
    from pyspark.ml.regression import RandomForestRegressionModel
    base = f"file://{tmp_path}/models"
    with monkeypatch.context() as patch:
        patch.setattr(ml.Models, "__getitem__", lambda *_: pytest.fail("loaded to be saved"))
        for _ in range(2):  # the second time over the first
            paths = ml.save_models(trained.models, "y", "Random Forest", base)
    assert set(paths) == {*ml.MODEL_PARAMS, "best"}
    one, best = (RandomForestRegressionModel.load(paths[k]) for k in ("Random Forest", "best"))
    rows = [r["features"] for r in trained.test.collect()]
    assert [one.predict(x) for x in rows] == [best.predict(x) for x in rows]
    got = {r["event_id"]: one.predict(r["features"]) for r in trained.test.collect()}
    assert got == pytest.approx({k[1]: v for k, v in _preds(trained, "Random Forest").items()})


def test_rows_whose_ids_repeat_keep_their_own_predictions(spark, monkeypatch):
    monkeypatch.setattr(ml, "GROVE_TREES", 2)
    monkeypatch.setattr(ml, "GROVE_ROWS", 100)
    df = _line(spark).withColumn("event_id", F.col("event_id") % 50)
    for task_values in (ml.TASK_VALUES, 0):
        (run,) = ml.train_models(df, ["a", "b"], ["y"], SMALL, models=["Random Forest"],
                                 task_values=task_values)
        assert run.predictions.count() == run.test.count() > 20


def test_candidate_splits_lie_at_the_quantiles():
    import numpy as np
    from helio.operators import trees
    x = np.repeat(np.arange(10.0), 3)
    few = trees.candidate_splits(*trees.counted(x, np.ones(len(x))))
    assert list(few) == [i + 0.5 for i in range(9)]
    x = np.random.default_rng(0).normal(size=20_000)
    halves = [trees.counted(h, np.ones(len(h))) for h in (x[:7000], x[7000:])]
    for values, counts in (trees.counted(x, np.ones(len(x))),
                           [np.concatenate(p) for p in zip(*halves)]):
        values, counts = trees.counted(values, counts)
        assert len(values) <= trees.KEPT_VALUES and counts.sum() == len(x)
        many = trees.candidate_splits(values, counts)
        assert len(many) == 31 and np.mean(x[:, None] <= many, axis=0) == pytest.approx(
            np.arange(1, 32) / 32, abs=2e-3)
    assert list(trees.binned(np.array([0.0, 0.5, 0.6, np.nan]), np.array([0.5]))) == [0, 0, 1, 1]


def test_the_registered_models_are_full_size():
    from helio.plans import q_ml
    assert not hasattr(q_ml, "CHECK_PARAMS")
    assert ml.MODEL_PARAMS["Random Forest"]["numTrees"] == 200
    assert ml.MODEL_PARAMS["Gradient Boosting Subsampled"]["maxIter"] == 300


def test_metrics_of_a_constant_target(spark):
    p = spark.createDataFrame([("m", "t", 1.0, 2.0), ("m", "t", 1.0, 0.0), ("m", "t", None, 0.0)],
                              "model string, target string, y double, yhat double")
    r = ml.regression_metrics(p).first()
    assert (r["mae"], r["rmse"], r["r2"], r["n"]) == (1.0, 1.0, None, 2)


def test_model_histograms_have_every_bin(spark):
    p = spark.createDataFrame([("m", "t", float(v), 0.0) for v in (0, 0, 10)],
                              "model string, target string, y double, yhat double")
    h = ml.residual_histogram(p, bins=5).orderBy("bin").collect()
    assert [r["rows"] for r in h] == [2, 0, 0, 0, 1] and h[-1]["bin_hi"] == 10.0
    both = ml.prediction_histograms(p, bins=5)
    assert both.count() == 10 and both.agg(F.sum("rows")).first()[0] == 6
    assert ml.residual_histogram(p.where("false"), bins=5).count() == 0


def test_tracked_objects_nested_flat_and_empty(spark):
    nested = spark.createDataFrame(
        [("a", ("10.5", "-3")), ("b", ("n/a", "4")), ("c", None)],
        "feed string, iss_position struct<latitude:string,longitude:string>")
    got = {r["feed"]: r["risk_zone"] for r in risk.tracked_objects(nested).collect()
           if r["altitude_km"] and r["risk_zone"] in ("Live Tracking", "Fallback Position")}
    assert got == {"a": "Live Tracking", "b": "Fallback Position", "c": "Fallback Position"}
    flat = nested.select("feed", "iss_position.*")
    assert sorted(map(str, risk.tracked_objects(flat).collect())) == \
        sorted(map(str, risk.tracked_objects(nested).collect()))
    empty = risk.tracked_objects(nested.where("false")).collect()
    assert len(empty) == 4 and empty[0]["risk_zone"] == "Fallback Position"
    assert all(r["feed"] is None for r in empty)


def test_targets_may_keep_their_units(spark, obs):
    from helio.plans.prepare import prepare_features
    p = prepare_features(obs, impute=False, scale_target=False)
    assert "kp_index" in p.features and "kp_index" not in p.scaler
    assert p.frame.agg(F.max("kp_index")).first()[0] == p.unscaled.agg(F.max("kp_index")).first()[0]
