"""A1–A10: summaries, counts, correlations, histograms and density estimates.

Scale notes
* Counts, means, stddevs, min/max and correlations are algebraic aggregates:
  partial aggregation per task, one small shuffle.
* Exact quantiles (:mod:`helio.operators.quantiles`) bracket the wanted ranks with a
  sketch and count the values inside the brackets: no sort, no shuffle of rows, no
  written table, and a frequent value is one counter.  ``approx=True`` stops at the
  sketch.
* Correlations are sums of products about a common centre: every task keeps one
  matrix of sums, and only these are shuffled.
* Histogram and KDE parameters (min, max, n, std) come from one aggregate that
  is fetched as a single row of scalars; the per-row work is a bounded fan-out
  (×1 for bins, ×grid points for the KDE) followed by a partial aggregate.
"""

from __future__ import annotations

import math
import sys
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from helio.operators.quantiles import select_quantiles
from helio.operators.windows import CHUNKED, Layout, with_halo
from helio.schema import CORR_COLUMNS, FLARE_CLASSES, SERIES, SEVERITY_LABELS, TIME

# executors need numpy and pyarrow only: the functions of a task travel with it
cloudpickle.register_pickle_by_value(sys.modules[__name__])

ORDER = (TIME, "event_id")


def to_long(df: DataFrame, cols: Sequence[str], name: str = "feature",
            value: str = "value", keep: Sequence[str] = ()) -> DataFrame:
    """Unpivot ``cols`` to (keep..., name, value), values cast to double."""
    return df.select(*keep, *[F.col(c).cast("double").alias(c) for c in cols]) \
             .unpivot(list(keep), list(cols), name, value) if keep else \
        df.select(*[F.col(c).cast("double").alias(c) for c in cols]) \
          .unpivot([], list(cols), name, value)


def safe_corr(a, b) -> Column:
    """Pearson correlation over rows where both are present; NULL for a constant
    column (the built-in ``corr`` raises DIVIDE_BY_ZERO there under ANSI)."""
    a = F.col(a) if isinstance(a, str) else a
    b = F.col(b) if isinstance(b, str) else b
    both = a.isNotNull() & b.isNotNull()
    a2, b2 = F.when(both, a), F.when(both, b)
    return F.try_divide(F.covar_samp(a2, b2), F.stddev_samp(a2) * F.stddev_samp(b2))


# -- quantiles ---------------------------------------------------------------------

def quantile_table(df: DataFrame, cols: Sequence[str], probs: Sequence[float],
                   approx: bool = False, accuracy: int = 10000) -> DataFrame:
    """Quantiles of several columns as (feature, p, q): linearly interpolated (the rule of
    pandas and ``quantile_cont``), NULL values ignored, none for a column of NULLs.

    ``approx`` takes the values of a sketch.  The exact ones are found by a few
    aggregates; as many rows come back as columns and probabilities are asked for.
    """
    if approx:
        aggs = [F.percentile_approx(F.col(c), list(probs), accuracy).alias(c) for c in cols]
        wide = df.agg(*aggs)
        return (wide.select(F.inline(F.array(*[F.struct(F.lit(c).alias("feature"),
                                                      F.col(c).alias("qs")) for c in cols])))
                .select("feature", F.posexplode("qs").alias("i", "q"))
                .select("feature", F.get(F.array(*[F.lit(float(p)) for p in probs]), "i")
                        .alias("p"), "q"))
    found = select_quantiles(df, cols, probs)
    return df.sparkSession.createDataFrame(
        [(c, float(p), q) for c, qs in found.items() for p, q in zip(probs, qs)],
        "feature string, p double, q double")


# -- A1 --------------------------------------------------------------------------

def describe(df: DataFrame, cols: Sequence[str], places: int = 2,
             approx: bool = False) -> DataFrame:
    """A1: count, mean, std, min, 25/50/75 %, max per column, rounded."""
    long = to_long(df, cols)
    base = long.groupBy("feature").agg(
        F.count("value").alias("count"), F.avg("value").alias("mean"),
        F.stddev_samp("value").alias("std"), F.min("value").alias("min"),
        F.max("value").alias("max"))
    qs = quantile_table(df, cols, [0.25, 0.5, 0.75], approx=approx)
    wide = qs.groupBy("feature").pivot("p", [0.25, 0.5, 0.75]).agg(F.first("q"))
    wide = wide.select("feature", *[F.col(f"`{p}`").alias(n) for p, n in
                                   [("0.25", "p25"), ("0.5", "p50"), ("0.75", "p75")]])
    out = base.join(wide, "feature", "left")
    r = lambda c: F.round(F.col(c), places).alias(c)
    return out.select("feature", F.col("count").cast("long").alias("count"), r("mean"), r("std"),
                      r("min"), r("p25"), r("p50"), r("p75"), r("max"))


# -- A2–A4 ----------------------------------------------------------------------

def _label_dim(spark, name: str, labels: Sequence[str]) -> DataFrame:
    return spark.range(1).select(F.inline(F.array(*[
        F.struct(F.lit(i).alias("label_no"), F.lit(s).alias(name)) for i, s in enumerate(labels)])))


def severity_counts(df: DataFrame, col: str = "severity") -> DataFrame:
    """A2: rows per severity with share in %, ordered Low..Extreme (label_no).

    The total is the sum of the label counts, so the table is read once.
    """
    counts = df.groupBy(col).agg(F.count(F.lit(1)).alias("rows"))
    counts = counts.agg(F.collect_list(F.struct(col, "rows")).alias("_per"),
                        F.sum("rows").alias("_total")).select("_total", F.inline("_per"))
    dim = _label_dim(df.sparkSession, col, SEVERITY_LABELS)
    out = counts.join(F.broadcast(dim), col, "left").withColumn(
        "share_pct", F.col("rows") * F.lit(100.0) / F.col("_total"))
    return out.select("label_no", col, "rows", "share_pct")


def flare_counts(df: DataFrame, col: str = "flare_class") -> DataFrame:
    """A3: rows per flare class."""
    return df.groupBy(col).agg(F.count(F.lit(1)).alias("rows"))


def storm_prob_by_flare(df: DataFrame, cls: str = "flare_class",
                        flag: str = "storm_flag") -> DataFrame:
    """A4: mean storm flag x 100 per class in A..X order; absent class -> 0."""
    per = df.groupBy(cls).agg(F.avg(flag).alias("_m"))
    dim = _label_dim(df.sparkSession, cls, FLARE_CLASSES)
    # ``per`` has one row per distinct class in the data: no hint, AQE sizes it
    return (dim.join(per, cls, "left")
               .select("label_no", cls, F.coalesce(F.col("_m") * F.lit(100.0), F.lit(0.0))
                       .alias("storm_prob_pct")))


# -- A5 ----------------------------------------------------------------------------

_SUMS = ("n", "sx", "sy", "sxx", "syy", "sxy")


def _centres(df: DataFrame, cols: Sequence[str]) -> list[float]:
    """One value per column near its mean, to take sums about (one row of scalars)."""
    row = df.agg(*[F.avg(F.col(c).cast("double")) for c in cols]).first()
    return [v if v is not None and math.isfinite(v) else 0.0 for v in row]


def _corr_of_sums() -> Column:
    """Pearson correlation from sums about any centre; NULL if a side does not vary (up to
    rounding) or fewer than two rows have both."""
    n, sx, sy, sxx, syy, sxy = (F.col(c) for c in _SUMS)

    def spread(ss, s):
        left = ss - F.try_divide(s * s, n)
        return F.when(left > ss * 1e-12, left)
    return F.when(n > 1, (sxy - F.try_divide(sx * sy, n)) / (
        F.sqrt(spread(sxx, sx)) * F.sqrt(spread(syy, sy))))


def _pair_sums(centres: Sequence[float]):
    """Batches of k columns to one row of sums per pair of columns and task: products of
    the value matrix and the matrix of present cells give all pairs at once."""
    k = len(centres)

    def run(batches):
        n, s, ss, p = (np.zeros((k, k)) for _ in range(4))
        for batch in batches:
            x = np.stack([c.to_numpy(zero_copy_only=False) for c in batch.columns], axis=1)
            x = x - np.asarray(centres)
            here = ~np.isnan(x)
            x, m = np.where(here, x, 0.0), here.astype(np.float64)
            n += m.T @ m
            s += x.T @ m        # s[i, j]: sum of column i where column j is present
            ss += (x * x).T @ m
            p += x.T @ x
        i, j = np.tril_indices(k)
        yield pa.RecordBatch.from_arrays(
            [pa.array(i, pa.int32()), pa.array(j, pa.int32())] + [
                pa.array(v) for v in (n[i, j], s[i, j], s[j, i], ss[i, j], ss[j, i], p[i, j])],
            names=["i", "j", *_SUMS])
    return run


def correlation_matrix(df: DataFrame, cols: Sequence[str] = CORR_COLUMNS,
                       lower_only: bool = False) -> DataFrame:
    """A5: pairwise-complete Pearson correlations, long form (col_a, col_b, corr).

    Every task keeps the sums and products of its rows for all pairs of columns in four
    ``k x k`` matrices and sends ``k(k+1)/2`` rows, which are added up per pair.  Sums
    are taken about the columns' means, so large offsets cost no digits.
    All ``k²`` cells, or the strict lower triangle when ``lower_only``.  Constant columns
    give NULL; NULL and NaN cells are missing.
    """
    data = df.select(*[F.col(c).cast("double").alias(f"c{i}") for i, c in enumerate(cols)])
    sums = data.mapInArrow(_pair_sums(_centres(df, cols)), "i int, j int, " + ", ".join(
        f"{c} double" for c in _SUMS))
    tri = sums.groupBy("i", "j").agg(*[F.sum(c).alias(c) for c in _SUMS]).select(
        "i", "j", _corr_of_sums().alias("corr"))
    names = F.array(*[F.lit(c) for c in cols])
    cells = tri.select(F.inline(F.array(
        F.struct(F.col("i").alias("a"), F.col("j").alias("b"), F.col("corr")),
        F.when(F.col("i") != F.col("j"),
               F.struct(F.col("j").alias("a"), F.col("i").alias("b"), F.col("corr"))))))
    cells = cells.where(F.col("a").isNotNull())
    if lower_only:
        cells = cells.where(F.col("b") < F.col("a"))
    return cells.select(F.get(names, F.col("a")).alias("col_a"),
                        F.get(names, F.col("b")).alias("col_b"), "corr")


# -- A6 ----------------------------------------------------------------------------

def _lag_sums(max_lag: int, centres: Sequence[float]):
    """Rows (group, number, halo, x, ys...) in order to the sums of x[t], y[t + lag] per lag
    and y.  A pair is counted where its t is not a copy."""
    n_y = len(centres) - 1

    def run(batches):
        sums = np.zeros((2 * max_lag + 1, n_y, len(_SUMS)))
        held = None

        def add(lag, x, ys, use):
            for y in range(n_y):
                both = use & ~np.isnan(x) & ~np.isnan(ys[y])
                a, b = x[both], ys[y][both]
                sums[lag + max_lag, y] += (
                    len(a), a.sum(), b.sum(), (a * a).sum(), (b * b).sum(), (a * b).sum())

        for batch in batches:
            part = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
            part[3:] = [v - c for v, c in zip(part[3:], centres)]
            old = 0 if held is None else len(held[0])
            if old:
                part = [np.concatenate([h, p]) for h, p in zip(held, part)]
            group, number, halo, x, *ys = part
            core = ~halo.astype(bool)
            for lag in range(min(max_lag, len(x) - 1) + 1):
                i = np.arange(max(0, old - lag), len(x) - lag)  # the later row is new
                j = i + lag
                near = (group[i] == group[j]) & (number[j] - number[i] == lag)
                add(lag, x[i], [y[j] for y in ys], near & core[i])
                if lag:
                    add(-lag, x[j], [y[i] for y in ys], near & core[j])
            keep = max(0, len(x) - max_lag)
            held = [p[keep:] for p in part]
        lag, y = (a.ravel() for a in np.indices((2 * max_lag + 1, n_y)))
        yield pa.RecordBatch.from_arrays(
            [pa.array(lag - max_lag, pa.int32()), pa.array(y, pa.int32())] + [
                pa.array(sums[lag, y, s]) for s in range(len(_SUMS))],
            names=["lag", "y", *_SUMS])
    return run


def lagged_xcorr(df: DataFrame, x: str = "kp_index",
                 ys: Sequence[str] = ("satellite_disruption_risk", "gps_blackout_prob"),
                 max_lag: int = 14, series: str | None = SERIES, order: Sequence[str] = ORDER,
                 layout: Layout = CHUNKED) -> DataFrame:
    """corr(x[t], y[t+lag]) for lag in [-max_lag, max_lag], pairs inside a series.

    Rows are dealt to chunks with ``max_lag`` copied rows on both sides.  A task goes
    through its chunks once, adds the products of the rows that are ``lag`` places apart,
    and sends one row of sums per lag and y.  Lags without a pair give NULL.
    """
    cols = [x, *ys]
    slim = df.select(*([series] if series else []), *order,
                     *[F.col(c).cast("double").alias(f"_v{i}") for i, c in enumerate(cols)])
    spread = with_halo(slim, series, order, max_lag, max_lag, layout)
    group = F.xxhash64(*([series] if series else []), F.col("_chunk"))
    rows = spread.select(group.alias("_group"), F.col("_rn").cast("long").alias("_rn"), "_halo",
                         *[f"_v{i}" for i in range(len(cols))])
    sums = rows.repartition("_group").sortWithinPartitions("_group", "_rn").mapInArrow(
        _lag_sums(max_lag, _centres(df, cols)), "lag int, y int, " + ", ".join(
            f"{c} double" for c in _SUMS))
    total = sums.groupBy("lag", "y").agg(*[F.sum(c).alias(c) for c in _SUMS]).withColumn(
        "corr", _corr_of_sums())
    return total.groupBy("lag").agg(*[
        F.max(F.when(F.col("y") == i, F.col("corr"))).alias(f"xcorr_{y}")
        for i, y in enumerate(ys)])


# -- A7, A8 ---------------------------------------------------------------------

def _params(df: DataFrame, cols: Sequence[str]) -> dict[str, dict[str, float]]:
    """One aggregate -> one row of scalars per column (min, max, n, sample std)."""
    aggs = []
    for c in cols:
        aggs += [F.min(c).alias(f"{c}__lo"), F.max(c).alias(f"{c}__hi"),
                 F.count(c).alias(f"{c}__n"), F.stddev_samp(c).alias(f"{c}__sd")]
    row = df.agg(*aggs).first().asDict()
    return {c: {"lo": row[f"{c}__lo"], "hi": row[f"{c}__hi"], "n": row[f"{c}__n"],
                "sd": row[f"{c}__sd"]} for c in cols}


def risk_histogram(df: DataFrame, cols: Sequence[str] = ("satellite_disruption_risk",
                                                         "gps_blackout_prob"),
                   bins: int = 50) -> DataFrame:
    """Density histogram with ``bins`` equal bins between min and max (last bin closed).

    Returns (feature, bin, bin_lo, bin_hi, rows, density) with every bin, empty ones
    with 0 rows; a column without values has no bins.
    """
    prm = _params(df, cols)
    present = [c for c in cols if prm[c]["n"]]
    width = {c: (prm[c]["hi"] - prm[c]["lo"]) / bins if prm[c]["hi"] > prm[c]["lo"] else 1.0
             for c in present}
    every = F.array(*[F.struct(
        F.lit(c).alias("feature"), F.lit(float(prm[c]["lo"])).alias("_lo"),
        F.lit(float(width[c])).alias("_w"), F.lit(float(prm[c]["n"])).alias("_n"),
        F.col(c).cast("double").alias("_x")) for c in present]) if present else None
    edges = df.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"))
    if not present:
        return edges.where(F.lit(False)).select(
            F.lit("").alias("feature"), "bin", *[F.lit(0.0).alias(c) for c in
                                                 ("bin_lo", "bin_hi")],
            F.lit(0).cast("long").alias("rows"), F.lit(0.0).alias("density"))
    long = df.select(F.inline(every)).where(F.col("_x").isNotNull())
    cell = F.least(F.floor((F.col("_x") - F.col("_lo")) / F.col("_w")).cast("int"),
                   F.lit(bins - 1))
    counts = long.groupBy(F.col("feature").alias("_f"), cell.alias("_b")).agg(
        F.count(F.lit(1)).alias("_rows"))
    grid = edges.select("bin", F.inline(F.array(*[F.struct(
        F.lit(c).alias("feature"), F.lit(float(prm[c]["lo"])).alias("_lo"),
        F.lit(float(width[c])).alias("_w"), F.lit(float(prm[c]["n"])).alias("_n"))
        for c in present])))
    rows = F.coalesce(F.col("_rows"), F.lit(0))
    return grid.join(counts, (F.col("feature") == F.col("_f")) & (F.col("bin") == F.col("_b")),
                     "left").select(
        "feature", "bin", (F.col("_lo") + F.col("bin") * F.col("_w")).alias("bin_lo"),
        (F.col("_lo") + (F.col("bin") + 1) * F.col("_w")).alias("bin_hi"),
        rows.alias("rows"), (rows / (F.col("_n") * F.col("_w"))).alias("density"))


def risk_kde(df: DataFrame, cols: Sequence[str] = ("satellite_disruption_risk",
                                                   "gps_blackout_prob"),
             points: int = 200) -> DataFrame:
    """Gaussian KDE (Scott bandwidth n^(-1/5)·sample std) on ``points`` grid points.

    Rows are first reduced to (value, count); each distinct value then
    contributes to every grid point (×points fan-out inside the task, partially
    aggregated before the shuffle: ``points`` rows per task).
    """
    prm = _params(df, cols)
    parts = []
    for c in cols:
        lo, hi, n, sd = prm[c]["lo"], prm[c]["hi"], prm[c]["n"], prm[c]["sd"]
        if not n or not sd:
            continue
        h = n ** (-1.0 / 5.0) * sd
        step = (hi - lo) / (points - 1)
        norm = 1.0 / (n * h * math.sqrt(2 * math.pi))
        grid = F.sequence(F.lit(0), F.lit(points - 1))
        # identical values contribute identically: pre-aggregate to (value, count)
        # before the ×points expansion (exact; fewer rows when values repeat)
        vals = df.where(F.col(c).isNotNull()).groupBy(F.col(c).alias("x")).agg(
            F.count(F.lit(1)).alias("w"))
        g = vals.select("x", "w", F.explode(grid).alias("point"))
        gx = F.lit(lo) + F.col("point") * F.lit(step)
        z = (gx - F.col("x")) / F.lit(h)
        parts.append(g.select(F.lit(c).alias("feature"), "point", gx.alias("grid_x"),
                              (F.col("w") * F.exp(F.lit(-0.5) * z * z) * F.lit(norm)).alias("k")))
    if not parts:  # no column with two different values has a density
        return df.where(F.lit(False)).select(
            F.lit("").alias("feature"), F.lit(0).alias("point"), F.lit(0.0).alias("grid_x"),
            F.lit(0.0).alias("density"))
    long = parts[0]
    for p in parts[1:]:
        long = long.unionByName(p)
    return long.groupBy("feature", "point", "grid_x").agg(F.sum("k").alias("density"))


# -- A10 ---------------------------------------------------------------------------

def date_range(df: DataFrame, ts: str = TIME) -> DataFrame:
    """A10: first and last time, row count and column count."""
    return df.agg(F.min(ts).alias("first_ts"), F.max(ts).alias("last_ts"),
                  F.count(F.lit(1)).alias("rows"),
                  F.lit(len(df.columns)).alias("columns"))
