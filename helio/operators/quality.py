"""Q1–Q5: missing data, KNN imputation, winsorising and scaling.

Parameters (quantiles, means, standard deviations) come from one aggregate
each and are fetched as a single row of scalars — two numbers per column, a
fixed size whatever the table size — then applied as literals in one
projection.

KNN imputation (Q1) is exact and prunes.  The columns that vary most span a grid, cut
at quantiles into bins of like width, with a bin of its own for rows that miss the column.
Receivers that miss columns of it meet the donors on a grid over other columns.  A receiver (a row with
a missing cell) first meets the donors of its own grid cell, which bounds the distance
of its k-th neighbour from above; then only those cells whose distance from it, over the
grid's columns alone, does not exceed that bound (a partial sum of squares is a lower
bound, also after scaling by the share of present columns).  A meeting of a cell's
receivers and donors is one ``cogroup`` task, which lays the donors out in leaves of
at most ``LEAF_ROWS`` rows, computes the NaN-Euclidean distances to the leaves within a
receiver's bound in NumPy and keeps the 5 nearest donors per missing cell.  Hot cells are cut
into blocks of ``receiver_block`` and parts of ``donor_block`` rows, so no
task holds more than one block and one part, nothing goes through the driver,
and the shuffle carries at most 5 candidates per (missing cell, part).
A final ``row_number() <= k`` over (receiver, column) picks the neighbours.  Ties are
broken by donor id.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from helio.operators.stats import quantile_table
from helio.schema import NUMERIC_COLUMNS, SERIES
from helio.session import materialize

# The grouped KNN function runs in executor Python workers, which need not have
# this package installed: pickle this module's functions by value so they are
# shipped with the task (numpy and pandas are imported on the worker).
try:
    import sys as _sys

    from pyspark import cloudpickle as _cloudpickle
    _cloudpickle.register_pickle_by_value(_sys.modules[__name__])
except Exception:  # noqa: BLE001  (older cloudpickle: fall back to by-reference)
    pass


def _any_null(cols: Sequence[str]) -> Column:
    return reduce(lambda a, b: a | b, [F.col(c).isNull() for c in cols])


# -- Q2 ----------------------------------------------------------------------------

def missing_report(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """Q2: NULL count per column (only columns with some), and the mean NULL
    rate over all cells of the table (``table_missing_rate``)."""
    cols = list(cols or df.columns)
    aggs = [F.count_if(F.col(c).isNull()).alias(c) for c in cols] + \
        [F.count(F.lit(1)).alias("_rows")]
    wide = df.agg(*aggs)
    total = reduce(lambda a, b: a + b, [F.col(c) for c in cols])
    rate = total / (F.col("_rows") * F.lit(len(cols)))
    long = wide.select(rate.alias("table_missing_rate"), F.inline(F.array(*[
        F.struct(F.lit(c).alias("feature"), F.col(c).alias("missing")) for c in cols])))
    return long.where(F.col("missing") > 0).select("feature", "missing", "table_missing_rate")


# -- Q3 ----------------------------------------------------------------------------

def winsor_bounds(df: DataFrame, cols: Sequence[str], probs=(0.01, 0.99),
                  approx: bool = False) -> dict[str, tuple[float, float]]:
    q = quantile_table(df, cols, list(probs), approx=approx).collect()
    out: dict[str, list] = {c: [None, None] for c in cols}
    for r in q:
        out[r["feature"]][0 if r["p"] == probs[0] else 1] = r["q"]
    return {c: (v[0], v[1]) for c, v in out.items()}


def winsorize(df: DataFrame, cols: Sequence[str], probs=(0.01, 0.99), approx: bool = False,
              bounds: dict[str, tuple[float, float]] | None = None) -> DataFrame:
    """Q3: clip each column at its lower/upper quantile (NULL stays NULL)."""
    from helio.functions.exprs import clip
    bounds = bounds or winsor_bounds(df, cols, probs, approx)
    return df.withColumns({c: clip(c, bounds[c][0], bounds[c][1]) for c in cols
                           if bounds[c][0] is not None})


# -- Q4 ----------------------------------------------------------------------------

def scaler_params(df: DataFrame, cols: Sequence[str]) -> dict[str, tuple[float, float]]:
    """Mean and population std per column (std 0 or undefined -> 1).

    Long form — unpivot, then one grouped aggregate with a group per column —
    which stays small in generated code however many columns are scaled; the
    result is one row per column, fetched to the driver (fixed size).
    """
    from helio.operators.stats import to_long
    rows = to_long(df, cols).groupBy("feature").agg(
        F.avg("value").alias("m"), F.stddev_pop("value").alias("s")).collect()
    got = {r["feature"]: (r["m"], r["s"]) for r in rows}
    out = {}
    for c in cols:
        m, s = got.get(c, (None, None))
        out[c] = (m, s if s not in (None, 0.0) and not math.isnan(s) else 1.0)
    return out


def standard_scale(df: DataFrame, cols: Sequence[str],
                   params: dict[str, tuple[float, float]] | None = None):
    """Q4: (x − mean) / std_pop per column; returns (scaled frame, params)."""
    params = params or scaler_params(df, cols)
    scaled = df.withColumns({c: (F.col(c) - F.lit(params[c][0])) / F.lit(params[c][1])
                             for c in cols})
    return scaled, params


def inverse_scale(df: DataFrame, params: dict[str, tuple[float, float]]) -> DataFrame:
    return df.withColumns({c: F.col(c) * F.lit(s) + F.lit(m) for c, (m, s) in params.items()
                           if c in df.columns})


# -- Q5 ----------------------------------------------------------------------------

def zscore_series(df: DataFrame, col: str = "kp_index", series: str | None = SERIES,
                  eps: float = 1e-8) -> DataFrame:
    """Q5: (x − mean) / (std_pop + eps) per series, with the parameters kept as
    columns (``{col}_mu``, ``{col}_sigma``) for the inverse transform."""
    aggs = [F.avg(col).alias(f"{col}_mu"), (F.stddev_pop(col) + F.lit(eps)).alias(f"{col}_sigma")]
    if series:
        # one row per series; joined back (AQE splits a skewed series' partition)
        j = df.join(df.groupBy(series).agg(*aggs), series)
    else:
        row = df.agg(*aggs).first()
        j = df.withColumns({f"{col}_mu": F.lit(row[0]), f"{col}_sigma": F.lit(row[1])})
    return j.withColumn(f"{col}_z", (F.col(col) - F.col(f"{col}_mu")) / F.col(f"{col}_sigma"))


# -- Q1 ----------------------------------------------------------------------------

_PARTIAL_SCHEMA = "rid long, col_no int, d2 double, donor long, val double"


def _exact_d2(Rz, Dz, prf, pdf, ri, di, ncol):
    """Exact NaN-Euclidean d² for the pairs (ri[p], di[p]): the fixed column
    order and sequential sum of the SQL form (masked terms add exactly +0.0)."""
    acc = np.zeros(len(ri))
    cnt = np.zeros(len(ri))
    for j in range(ncol):
        diff = Rz[ri, j] - Dz[di, j]
        m = prf[ri, j] * pdf[di, j]
        acc = acc + (diff * diff) * m
        cnt = cnt + m
    with np.errstate(divide="ignore", invalid="ignore"):
        return np.where(cnt > 0, (float(ncol) / cnt) * acc, np.inf)


#: Donors in one leaf of a group's tree, and the receivers from which a tree pays.
LEAF_ROWS = 128
TREE_RECEIVERS = 16


def _leaves(D, rows: int) -> list:
    """Row numbers of ``D`` in leaves of at most ``rows``, those of rows that miss a column apart:
    the widest column that all have is halved again and again."""
    whole = ~np.isnan(D).any(axis=1)
    todo, out = [], []
    for part in (np.nonzero(~whole)[0], np.nonzero(whole)[0]) if len(D) > rows else (np.arange(len(D)),):
        if len(part):
            todo.append((part, np.nonzero(~np.isnan(D[part]).any(axis=0))[0]))
    while todo:
        at, full = todo.pop()
        if len(at) <= rows or len(full) == 0:
            out.append(at)
            continue
        X = D[at][:, full]
        half = len(at) // 2
        order = np.argpartition(X[:, np.nan_to_num(np.ptp(X, axis=0)).argmax()], half)
        todo += [(at[order[half:]], full), (at[order[:half]], full)]
    return out


def _nearest(ri, di, ex, did, pr, pd_, k: int):
    """(row, column, donor, d2) of the ``k`` nearest pairs of every missing cell, by (d2, id)."""
    order = np.lexsort((did[di], ex, ri))
    ri, di, ex = ri[order], di[order], ex[order]
    out = [(ri[:0], np.zeros(0, dtype=np.int32), di[:0], ex[:0])]
    for j in np.nonzero(~pr.all(axis=0))[0]:
        ok = np.nonzero(~pr[ri, j] & pd_[di, j])[0]
        r = ri[ok]
        ok = ok[np.arange(len(r)) - np.searchsorted(r, r) < k]
        out.append((ri[ok], np.full(len(ok), j, dtype=np.int32), di[ok], ex[ok]))
    return [np.concatenate(x) for x in zip(*out)]


def _group_nearest(R, D, limit, did, k: int):
    """(row, column, donor, d2) of the ``k`` nearest donors of every missing cell of ``R``, those
    farther than the row's ``limit`` (squared) left out, and the number of pairs compared.

    The donors lie in leaves; a leaf whose box, over the columns that all its donors have, is
    farther than the limit is not compared.  A row without a limit gets one from its nearest leaf.
    """
    ncol = R.shape[1]
    pr, pd_ = ~np.isnan(R), ~np.isnan(D)
    Rz, Dz = np.where(pr, R, 0.0), np.where(pd_, D, 0.0)
    prf, pdf = pr.astype(np.float64), pd_.astype(np.float64)
    Rz2, Dz2 = Rz * Rz, Dz * Dz
    sq_r, sq_d = Rz2.sum(axis=1), Dz2.sum(axis=1).max()
    err = 1e-12 * float(ncol) * (sq_r + sq_d + 1.0)
    seen = prf.sum(axis=1)
    left = np.hstack([Rz2, prf, -2.0 * Rz])  # times right: the masked squared distance
    right = np.hstack([pdf, Dz2, Dz])
    leaves = _leaves(D, LEAF_ROWS if len(R) >= TREE_RECEIVERS else len(D))
    low = np.zeros((len(R), len(leaves)))  # of the squared distance to any donor of the leaf
    if len(leaves) > 1:
        box_lo = np.array([np.where(pd_[at], D[at], -np.inf).min(axis=0) for at in leaves])
        box_hi = np.array([np.where(pd_[at], D[at], np.inf).max(axis=0) for at in leaves])
        for j in range(ncol):
            gap = np.maximum(np.maximum(box_lo[:, j] - Rz[:, j, None], Rz[:, j, None] - box_hi[:, j]), 0.0)
            low += gap * gap * prf[:, j, None]
        low *= 1 - 1e-9
    limit = limit.copy()
    has = pd_.any(axis=0)
    todo = np.ones(low.shape, dtype=bool)
    near_r, near_d, found, held, pairs = [], [], [], 0, 0

    def reach(bound, rows):
        """The masked squared distance that a donor within the bound does not exceed."""
        known = np.isfinite(bound)
        return np.where(known, np.where(known, bound, 0.0) * (seen[rows] / float(ncol))
                        + 2.0 * err[rows], bound)

    def kth(rows, cand, A):
        """Of each row the distance of its k-th nearest donor here, the largest of its missing
        cells, and if there are k for each of them."""
        cnt = prf[rows] @ pdf[cand].T
        d2 = np.where(cnt > 0, A * (float(ncol) / np.maximum(cnt, 1.0)), np.inf)
        far, sure = np.full(len(rows), -np.inf), np.ones(len(rows), dtype=bool)
        for j in np.nonzero(has & ~pr[rows].all(axis=0))[0]:
            mine, having = np.nonzero(~pr[rows, j])[0], pd_[cand, j]
            n = min(k, int(having.sum()))
            if n:
                of = d2[mine] if having.all() else d2[mine][:, having]
                far[mine] = np.maximum(far[mine], np.partition(of, n - 1, axis=1)[:, n - 1])
            if n < k:
                sure[mine] = False
        return far + 2.0 * ncol * err[rows], sure

    def meet(rows, leaf):
        nonlocal held, pairs
        todo[rows, leaf] = False
        at = leaves[leaf]
        for s in range(0, len(at), step := max(64, 1_000_000 // len(rows))):
            cand = at[s:s + step]
            pairs += len(rows) * len(cand)
            A = left[rows] @ right[cand].T
            far = fars[rows]
            free = np.nonzero(np.isinf(far))[0]
            if len(free):  # without a limit: the nearest of these donors
                near, sure = kth(rows[free], cand, A[free])
                far[free] = reach(near, rows[free])
                sure &= np.isfinite(near)
                limit[rows[free[sure]]] = near[sure]
            i, d = np.divmod(np.flatnonzero(A <= far[:, None]), len(cand))
            near_r.append(rows[i])
            near_d.append(cand[d])
            held += len(i)
            if held > 500_000:
                keep()

    def keep():
        """Of the pairs found, those that are still among the nearest of a cell."""
        nonlocal held
        r, d = (np.concatenate([np.zeros(0, dtype=np.int64), *x]) for x in (near_r, near_d))
        ex = _exact_d2(Rz, Dz, prf, pdf, r, d, ncol)
        ok = np.isfinite(ex)
        found.append((r[ok], d[ok], ex[ok]))
        r, c, d, ex = _nearest(*[np.concatenate(x) for x in zip(*found)], did, pr, pd_, k)
        _, once = np.unique(r * len(D) + d, return_index=True)
        near_r.clear()
        near_d.clear()
        found[:] = [(r[once], d[once], ex[once])]
        held = len(once)
        return r, c, d, ex

    fars = reach(limit, np.arange(len(R)))
    free = np.isinf(limit)
    if len(leaves) > 1 and free.any():
        few = np.array([pd_[at].sum(axis=0) < k for at in leaves])
        lacks = (~pr & has).astype(np.float64) @ few.T.astype(np.float64)
        first = np.where(lacks > 0, np.inf, low).argmin(axis=1)
        for leaf in np.unique(first[free]):
            meet(np.nonzero(free & (first == leaf))[0], leaf)
    fars = reach(limit, np.arange(len(R)))
    todo &= low <= fars[:, None]
    for leaf in range(len(leaves)):
        rows = np.nonzero(todo[:, leaf])[0]
        if len(rows):
            meet(rows, leaf)
    return *keep(), pairs


def _knn_partial_fn(cols: Sequence[str], k: int):
    """Per (receiver block, donor part): the k nearest donors of every missing cell, those
    farther than the receiver's ``_limit`` (squared) left out.

    Candidates are found with BLAS (masked ‖r‖² + ‖d‖² − 2·r·d, one matrix product a leaf);
    every donor whose approximate distance is within a bound on the floating-point error of
    the limit is kept, and only those are recomputed with the exact sequential arithmetic
    (the same doubles as the SQL form) before the final (distance, id) choice.  The bound
    (1e-12 of the squared norms, ~100x the rounding error of a 15-term product sum) makes
    the shortlist contain the exact k nearest, so the result is exact.
    """
    def fn(recv: pd.DataFrame, donors: pd.DataFrame) -> pd.DataFrame:
        if recv.empty or donors.empty:
            r, c, d, d2 = np.zeros((4, 0), dtype=np.int64)
        else:
            r, c, d, d2, _ = _group_nearest(
                recv[list(cols)].to_numpy(dtype=np.float64),
                D := donors[list(cols)].to_numpy(dtype=np.float64),
                recv["_limit"].to_numpy(dtype=np.float64),
                donors["_id"].to_numpy(dtype=np.int64), k)
        return pd.DataFrame({
            "rid": recv["_id"].to_numpy(dtype=np.int64)[r], "col_no": c.astype(np.int32),
            "d2": d2.astype(np.float64), "donor": donors["_id"].to_numpy(dtype=np.int64)[d],
            "val": D[d, c] if len(d) else np.zeros(0)})
    return fn


def _meet(r: DataFrame, d: DataFrame, keys: Sequence[str], cols: Sequence[str], k: int,
          n_parts: int) -> DataFrame:
    """The k nearest donors (per group) of every missing cell of the receivers.

    Both sides are hash partitioned on the same long keys into an explicit number of
    partitions: a group is small in bytes but heavy in CPU, and a user-numbered repartition
    is not coalesced by AQE, so the groups stay spread over the cores instead of being
    packed into a few tasks.  Fresh aliases on the donor side keep the cogroup keys
    distinct attributes (both sides come from one table)."""
    keys = list(keys)
    r = r.select(*keys, "_id", *cols, "_limit").repartition(n_parts, *keys)
    d = d.select(*[F.col(x).alias(x) for x in keys + ["_id", *cols]]).repartition(n_parts, *keys)
    return r.groupBy(*keys).cogroup(d.groupBy(*keys)).applyInPandas(
        _knn_partial_fn(cols, k), _PARTIAL_SCHEMA)


#: Grids for receivers that miss columns of the common grid; each takes a copy of the donors.
MISSED_GRIDS = 4


@dataclass(frozen=True)
class Grid:
    """Cuts per column; bin i of a column holds [cut i-1, cut i), the last bin rows without it."""
    cuts: dict[str, list[float]]

    def bins(self, c: str) -> int:
        return len(self.cuts[c]) + 1

    def bin_of(self, c: str) -> Column:
        place = sum((F.col(c) >= F.lit(x)).cast("int") for x in self.cuts[c]) + F.lit(0)
        return F.when(F.col(c).isNull(), self.bins(c)).otherwise(place)

    def cell(self, bins: dict[str, Column]) -> Column:
        out = F.lit(0).cast("long")
        for c in self.cuts:
            out = out * (self.bins(c) + 1) + bins[c]
        return out

    def gaps(self, c: str) -> Column:
        """Every bin with the squared distance of the row's value from it, 0 if the row or
        the bin has no value."""
        low = [-math.inf, *self.cuts[c]]
        high = [*self.cuts[c], math.inf]
        out = []
        for i in range(self.bins(c)):
            away = F.greatest(F.lit(low[i]) - F.col(c), F.col(c) - F.lit(high[i]), F.lit(0.0))
            out.append(F.struct(F.lit(i).alias("bin"), F.when(
                F.col(c).isNull(), 0.0).otherwise(away * away).alias("gap")))
        out.append(F.struct(F.lit(self.bins(c)).alias("bin"), F.lit(0.0).alias("gap")))
        return F.array(*out)


def _bins(spread: dict[str, float], n: int, dims: int, cell_rows: int,
          without: Sequence[str] = ()) -> dict[str, int]:
    """Bins per column of a grid of up to ``n / cell_rows`` cells over at most ``dims`` columns:
    the column whose bins are widest is cut once more."""
    wide = {c: s for c, s in spread.items() if s and math.isfinite(s) and c not in without}
    bins = dict.fromkeys(sorted(wide, key=lambda c: -wide[c])[:dims], 1)
    while bins:
        widest = max(bins, key=lambda c: wide[c] / bins[c])
        if math.prod(bins.values()) // bins[widest] * (bins[widest] + 1) > n / cell_rows:
            break
        bins[widest] += 1
    return {c: b for c, b in bins.items() if b > 1}


def _grids(base: DataFrame, receivers: DataFrame, spread: dict[str, float], n: int, dims: int,
           cell_rows: int) -> list[tuple[frozenset, Grid]]:
    """The grid of all receivers, and before it one of its own, over other columns, for each of
    the commonest sets of missing grid columns: on the common grid such a receiver would have
    to visit every bin of the columns that it misses."""
    common = _bins(spread, n, dims, cell_rows)
    plans = []
    if common:
        miss = [F.col(c).isNull().alias(c) for c in common]
        for row in sorted(receivers.groupBy(*miss).count().collect(), key=lambda r: -r["count"]):
            missed = frozenset(c for c in common if row[c])
            if len(plans) < MISSED_GRIDS and math.prod(common[c] for c in missed) > 2:
                plans.append((missed, _bins(spread, n, dims, cell_rows, missed)))
    plans.append((frozenset(), common))
    cuts = [F.percentile_approx(c, [i / b for i in range(1, b)], 1000).alias(f"_{g}_{c}")
            for g, (_, bins) in enumerate(plans) for c, b in bins.items()]
    got = base.agg(*cuts).first() if cuts else None
    return [(missed, Grid({c: sorted(set(got[f"_{g}_{c}"])) for c in bins}))
            for g, (missed, bins) in enumerate(plans)]


def _met(visits: DataFrame, donors: DataFrame, cols: Sequence[str], k: int, receiver_block: int,
         donor_block: int, report: dict | None) -> DataFrame:
    """The nearest donors of the receivers in the cells that they visit (column ``_cell``)."""
    sizes = (visits.groupBy("_cell").agg(F.count(F.lit(1)).alias("_nr"))
             .join(donors.groupBy("_cell").agg(F.count(F.lit(1)).alias("_nd")), "_cell")
             .select("_cell", F.ceil(F.col("_nr") / receiver_block).cast("long").alias("_blocks"),
                     F.ceil(F.col("_nd") / donor_block).cast("long").alias("_parts"),
                     (F.col("_nr") * F.col("_nd")).alias("_pairs")))
    sizes = materialize(sizes, "knn-cells")  # one row per cell
    groups, pairs = sizes.agg(F.sum(F.col("_blocks") * F.col("_parts")), F.sum("_pairs")).first()
    if report is not None:
        report["pairs"] = report.get("pairs", 0) + (pairs or 0)
    zero, one = F.lit(0).cast("long"), F.lit(1)
    r = (visits.join(sizes, "_cell").withColumn("_blk", F.pmod(F.xxhash64("_id"), F.col("_blocks")))
         .withColumn("_dp", F.explode(F.sequence(zero, F.col("_parts") - one))))
    d = (donors.join(sizes, "_cell")
         .withColumn("_dp", F.pmod(F.xxhash64("_id", F.lit(7)), F.col("_parts")))
         .withColumn("_blk", F.explode(F.sequence(zero, F.col("_blocks") - one))))
    cores = visits.sparkSession.sparkContext.defaultParallelism
    return _meet(r, d, ["_cell", "_blk", "_dp"], cols, k, max(1, min(groups or 1, max(
        2 * cores, (groups or 1) // 8))))


def _pruned_neighbours(base: DataFrame, cols: Sequence[str], k: int, n_d: int,
                       spread: dict[str, float], have: dict[str, int], receiver_block: int,
                       donor_block: int, dims: int, cell_rows: int,
                       report: dict | None) -> DataFrame:
    """Candidates that hold the ``k`` nearest donors of every missing cell."""
    base = materialize(base, "knn-donors")
    receivers = base.where(_any_null(cols)).withColumn("_limit", F.lit(math.inf))
    grids = _grids(base, receivers, spread, n_d, dims, cell_rows)
    bins = [{c: grid.bin_of(c) for c in grid.cuts} for _, grid in grids]
    number = lambda g, cell: cell * len(grids) + g  # noqa: E731  (cells of all grids)
    donors = base.withColumn("_cell", F.explode(F.array(*[
        number(g, grid.cell(bins[g])) for g, (_, grid) in enumerate(grids)])))
    # the receivers of each grid; the last takes the rest
    own_grid = F.lit(len(grids) - 1)
    for g, (missed, _) in reversed(list(enumerate(grids[:-1]))):
        own_grid = F.when(reduce(lambda a, b: a & b, [
            F.col(c).isNull() == F.lit(c in missed) for c in grids[-1][1].cuts]), g).otherwise(own_grid)
    of = lambda rows, g: rows.where(own_grid == g) if len(grids) > 1 else rows
    sent = ["_id", *cols, "_limit"]
    # a row's own cells: its bins, and every bin that holds values where it has none
    starts = []
    for g, (_, grid) in enumerate(grids):
        own = of(receivers, g)
        for i, c in enumerate(grid.cuts):
            own = own.withColumn(f"_b{i}", F.explode(F.when(
                F.col(c).isNull(), F.sequence(F.lit(0), F.lit(grid.bins(c) - 1))).otherwise(
                F.array(bins[g][c]))))
        placed = {c: F.col(f"_b{i}") for i, c in enumerate(grid.cuts)}
        starts.append(own.select(*sent, number(g, grid.cell(placed)).alias("_cell")))
    first = materialize(_met(reduce(DataFrame.unionByName, starts), donors, cols, k,
                             receiver_block, donor_block, report), "knn-first")
    if not any(grid.cuts for _, grid in grids):
        return first
    w = Window.partitionBy("rid", "col_no").orderBy("d2", "donor")
    kth = first.withColumn("_r", F.row_number().over(w)).where(F.col("_r") == k).groupBy(
        F.col("rid").alias("_id")).agg(F.max("d2").alias("_bound"), F.count(F.lit(1)).alias("_got"))
    # cells of a column without any donor have nothing to find
    wanted = sum(F.col(c).isNull().cast("int") for c in cols if have[c])
    seen = sum(F.col(c).isNotNull().cast("int") for c in cols)
    bounded = receivers.join(kth, "_id", "left").withColumn("_limit", F.when(
        F.col("_got") == wanted, F.col("_bound")).otherwise(F.lit(math.inf)))
    # a distance is at least columns / present columns times the squared gaps; rounding is
    # far below the margin
    limit = F.col("_limit") * (seen / F.lit(float(len(cols)))) * (1 + 1e-9)
    visits = []
    for g, (_, grid) in enumerate(grids):
        more = of(bounded, g).withColumns({"_far": limit, "_sum": F.lit(0.0), "_seen": F.lit(True)})
        for i, c in enumerate(grid.cuts):
            more = more.withColumn("_g", F.explode(grid.gaps(c))).where(
                F.col("_g.gap") + F.col("_sum") <= F.col("_far")).withColumns({
                    f"_b{i}": F.col("_g.bin"), "_sum": F.col("_sum") + F.col("_g.gap"),
                    "_seen": F.col("_seen") & F.when(F.col(c).isNull(), F.col("_g.bin") < grid.bins(
                        c)).otherwise(F.col("_g.bin") == bins[g][c])})
        placed = {c: F.col(f"_b{i}") for i, c in enumerate(grid.cuts)}
        visits.append(more.where(~F.col("_seen")).select(
            *sent, number(g, grid.cell(placed)).alias("_cell")))
    return first.unionByName(_met(materialize(reduce(DataFrame.unionByName, visits), "knn-visits"),
                                  donors, cols, k, receiver_block, donor_block, report))


def knn_cells(df: DataFrame, cols: Sequence[str] = NUMERIC_COLUMNS, k: int = 5,
              id_col: str = "event_id", receiver_block: int = 2048,
              donor_block: int = 32768, block_cols: Sequence[str] | None = None,
              dims: int = 6, cell_rows: int = 8192, report: dict | None = None) -> DataFrame:
    """Imputed value of every missing cell: (id, col_no, feature, value).

    Mean of the ``k`` nearest donors that have the column, by NaN-Euclidean
    distance over the columns present in both rows (scaled by
    columns / present); a cell without any donor gets the column mean.  Up to ``dims`` columns
    span a pruning grid, of about one cell per ``cell_rows`` rows; they do not change the
    result.  ``report`` is filled with ``pairs`` (compared) and ``all_pairs``.

    ``block_cols`` (e.g. ``["series_id"]``): impute each block as its own
    table — donors and the fallback mean come from the receiver's block.  The
    block/part counts are then sized per block (one row per block joined
    back), so a small block is one task and a hot block is split into
    ``receiver_block`` x ``donor_block`` pieces, all pairs of which meet.
    """
    cols = list(cols)
    bc = list(block_cols or [])
    base = df.select(F.col(id_col).cast("long").alias("_id"), *[F.col(b) for b in bc],
                     *[F.col(c).cast("double").alias(c) for c in cols])
    receivers = base.where(_any_null(cols))
    if bc:
        # one row per block: piece counts and the block's column means
        sizes = (base.groupBy(*bc).agg(
                    F.count(F.lit(1)).alias("_n_d"), F.count_if(_any_null(cols)).alias("_n_r"),
                    *[F.avg(c).alias(f"_m{j}") for j, c in enumerate(cols)])
                 .where(F.col("_n_r") > 0)
                 .withColumn("_nb", F.greatest(F.lit(1), F.ceil(F.col("_n_r") / F.lit(receiver_block)))
                             .cast("long"))
                 .withColumn("_nd", F.greatest(F.lit(1), F.ceil(F.col("_n_d") / F.lit(donor_block)))
                             .cast("long")))
        d0 = base.join(sizes, bc)
        r0 = d0.where(_any_null(cols)).withColumn("_limit", F.lit(math.inf))
        r = (r0.withColumn("_blk", F.pmod(F.xxhash64("_id"), F.col("_nb")))
               .withColumn("_dp", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_nd") - 1))))
        d = (d0.withColumn("_dp", F.pmod(F.xxhash64("_id", F.lit(7)), F.col("_nd")))
               .withColumn("_blk", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_nb") - 1))))
        partial = _meet(r, d, bc + ["_blk", "_dp"], cols, k,
                        int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    else:
        one = base.agg(F.count_if(_any_null(cols)), F.count(F.lit(1)),
                       *[f(c) for c in cols for f in (F.avg, F.stddev_samp, F.count)]).first()
        n_r, n_d, means = one[0], one[1], one[2::3]
        if n_r == 0:
            return df.sparkSession.createDataFrame(
                [], f"{id_col} long, col_no int, feature string, value double")
        if report is not None:
            report["all_pairs"] = n_r * n_d
        partial = _pruned_neighbours(
            base, cols, k, n_d, dict(zip(cols, one[3::3])), dict(zip(cols, one[4::3])),
            receiver_block, donor_block, dims, cell_rows, report)
    w = Window.partitionBy("rid", "col_no").orderBy("d2", "donor")
    top = partial.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= k)
    imp = top.groupBy("rid", "col_no").agg(F.avg("val").alias("imp"))
    # every missing cell, with the column mean (of the table or the block) as
    # the no-donor fallback
    cells_of = lambda mean_of: F.inline(F.array(*[
        F.struct(F.lit(j).alias("col_no"), F.lit(c).alias("feature"),
                 F.col(c).isNull().alias("_miss"), mean_of(j, c).cast("double").alias("_mean"))
        for j, c in enumerate(cols)]))
    if bc:
        missing = r0.select("_id", cells_of(lambda j, c: F.col(f"_m{j}"))).where("_miss")
    else:
        missing = receivers.select("_id", cells_of(lambda j, c: F.lit(means[j]))).where("_miss")
    cells = missing.join(imp.withColumnRenamed("rid", "_id"), ["_id", "col_no"], "left")
    return cells.select(F.col("_id").alias(id_col), "col_no", "feature",
                        F.coalesce(F.col("imp"), F.col("_mean")).alias("value"))


def knn_impute(df: DataFrame, cols: Sequence[str] = NUMERIC_COLUMNS, k: int = 5,
               id_col: str = "event_id", **kw) -> DataFrame:
    """Q1: the table with every missing numeric cell filled (present cells unchanged)."""
    cols = list(cols)
    cells = knn_cells(df, cols, k, id_col, **kw)
    wide = cells.groupBy(id_col).pivot("col_no", list(range(len(cols)))).agg(F.first("value"))
    wide = wide.select(id_col, *[F.col(f"`{j}`").alias(f"_imp_{j}") for j in range(len(cols))])
    j = df.join(wide, id_col, "left")
    return j.withColumns({c: F.coalesce(F.col(c).cast("double"), F.col(f"_imp_{i}"))
                          for i, c in enumerate(cols)}).drop(
        *[f"_imp_{i}" for i in range(len(cols))])
