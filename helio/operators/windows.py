"""Ordered-window features per series, keyed or skew-safe.

Two layouts compute the same columns:

``keyed``    ``Window.partitionBy(series).orderBy(ts, id)``.  One shuffle; but a
             series is one task, so it is only for callers who know that every
             series is small.
``chunked``  (default, see below) rows are numbered inside their series without a single-task sort
             (range partitioning on (series, ts, id) + per-partition offsets,
             see :func:`number_rows`), cut into chunks of ``chunk_rows`` rows,
             and each chunk gets copies of the ``behind`` rows before it and
             the ``ahead`` rows after it (the halo).  The window then runs over
             ``partitionBy(series, chunk)``: every task holds at most
             ``chunk_rows + behind + ahead`` rows, whatever the skew.  Halo rows
             are dropped afterwards, so the result equals the keyed one.

A frame of ``rowsBetween(-k, j)`` needs ``behind >= k`` and ``ahead >= j``.

A chunk is the bound on what one window group holds.  Where no series has more rows than
a chunk (one count per series says so, and only the largest comes back), every series
is a chunk already: the keyed window holds the same rows per group without numbering,
and is used then.  ``Layout(measure=False)`` leaves the count out, for inputs that are dear
to read twice.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from helio.schema import SERIES, TIME

ORDER = (TIME, "event_id")
_MID_BITS = 33  # monotonically_increasing_id = partition id << 33 | row index


@dataclass(frozen=True)
class Layout:
    mode: str = "chunked"        # "chunked" | "keyed"
    chunk_rows: int = 1 << 20    # rows per chunk in chunked mode (max rows of a window task)
    partitions: int | None = None  # range partitions for numbering (None: shuffle partitions)
    broadcast_limit: int = 1 << 20  # max rows of the per-partition offset table to broadcast
    measure: bool = True         # look whether every series fits a chunk


KEYED = Layout("keyed")
CHUNKED = Layout()


def _series_cols(series: str | None) -> list[Column]:
    return [F.col(series)] if series else []


def number_rows(df: DataFrame, series: str | None = SERIES, order: Sequence[str] = ORDER,
                name: str = "rn", layout: Layout = CHUNKED, total: str | None = None) -> DataFrame:
    """Row number (1-based) inside each series in ``order``; ``total`` names a column
    for the number of rows of the series.

    ``keyed``: ``row_number()`` over the series window.
    ``chunked``: range-partition on (series, order) so a hot series spans many
    partitions, sort inside partitions, tag rows with
    ``monotonically_increasing_id`` (increasing along the sort), and write the
    tagged rows as a table in the shared checkpoint folder (the range bounds
    are sampled and the ids depend on partitioning, so the tagged table must
    not be recomputed differently after an executor loss).  Every column of
    ``df`` is written: select the needed ones first.
    A per-(partition, series) count table — at most partitions + series rows —
    gives each partition's offset inside its series by a running sum.
    """
    if layout.mode == "keyed":
        w = Window.partitionBy(*_series_cols(series))
        out = df.withColumn(name, F.row_number().over(w.orderBy(*[F.col(c) for c in order])))
        return out.withColumn(total, F.count(F.lit(1)).over(w)) if total else out

    spark = df.sparkSession
    from helio.session import materialize
    n_parts = layout.partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    keys = _series_cols(series) + [F.col(c) for c in order]
    tagged = materialize(df.repartitionByRange(n_parts, *keys)
                           .sortWithinPartitions(*keys)
                           .withColumn("_mid", F.monotonically_increasing_id()),
                         "numbered")
    pid = F.shiftright(F.col("_mid"), _MID_BITS)
    grp = [pid.alias("_pid")] + _series_cols(series)
    stats = tagged.groupBy(*grp).agg(F.min("_mid").alias("_first"),
                                     F.count(F.lit(1)).alias("_n"))
    run = Window.partitionBy(*_series_cols(series)).orderBy("_pid").rowsBetween(
        Window.unboundedPreceding, -1)
    stats = stats.withColumn("_off", F.coalesce(F.sum("_n").over(run), F.lit(0)))
    if total:
        whole = Window.partitionBy(*_series_cols(series))
        stats = stats.withColumn(total, F.sum("_n").over(whole))
    stats = stats.drop("_n")
    n_stats = stats.count()
    side = F.broadcast(stats) if n_stats <= layout.broadcast_limit else stats
    join_keys = ["_pid"] + ([series] if series else [])
    out = tagged.withColumn("_pid", pid).join(side, join_keys)
    out = out.withColumn(name, F.col("_off") + F.col("_mid") - F.col("_first") + F.lit(1))
    return out.drop("_pid", "_mid", "_first", "_off")


def measured(df: DataFrame, series: str | None, layout: Layout) -> Layout:
    """The keyed layout if it is asked for, or if no series is longer than a chunk."""
    if layout.mode == "keyed" or not (layout.measure and series):
        return layout
    longest = df.groupBy(series).agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0]
    return KEYED if (longest or 0) <= layout.chunk_rows else layout


def with_halo(df: DataFrame, series: str | None = SERIES, order: Sequence[str] = ORDER,
              behind: int = 0, ahead: int = 0, layout: Layout = CHUNKED,
              total: str | None = None) -> DataFrame:
    """The rows numbered in their series (``_rn``) and dealt to chunks (``_chunk``), with copies
    (``_halo``) of the ``behind`` rows before and the ``ahead`` rows after each chunk."""
    c_rows = layout.chunk_rows
    if behind > c_rows or ahead > c_rows:
        raise ValueError("halo wider than a chunk; raise chunk_rows")
    layout = measured(df, series, layout)
    numbered = number_rows(df, series, order, "_rn", layout, total)
    if layout.mode == "keyed":
        return numbered.withColumns({"_chunk": F.lit(0).cast("long"), "_halo": F.lit(False)})
    pos = F.col("_rn") - F.lit(1)
    chunk = F.floor(pos / F.lit(c_rows)).cast("long")
    within = F.pmod(pos, F.lit(c_rows))
    # Each row lives in its own chunk; the last `behind` rows of a chunk are
    # copied into the next chunk and the first `ahead` rows into the previous.
    copies = [F.struct(chunk.alias("_chunk"), F.lit(False).alias("_halo"))]
    if behind:
        copies.append(F.when(within >= F.lit(c_rows - behind),
                             F.struct((chunk + 1).alias("_chunk"), F.lit(True).alias("_halo"))))
    if ahead:
        copies.append(F.when((within < F.lit(ahead)) & (chunk > 0),
                             F.struct((chunk - 1).alias("_chunk"), F.lit(True).alias("_halo"))))
    return numbered.select("*", F.inline(F.filter(F.array(*copies), lambda x: x.isNotNull())))


def apply_ordered(df: DataFrame, build: Callable[[WindowSpec], dict[str, Column]],
                  series: str | None = SERIES, order: Sequence[str] = ORDER,
                  behind: int = 0, ahead: int = 0, layout: Layout = CHUNKED,
                  number: str | None = None, total: str | None = None) -> DataFrame:
    """Add the window columns ``build(spec)`` using the chosen layout, and on request
    the row's number in its series and the series' number of rows."""
    if max(behind, ahead) <= layout.chunk_rows:
        layout = measured(df, series, layout)
    if layout.mode == "keyed":
        if number:
            df = number_rows(df, series, order, number, layout, total)
        spec = Window.partitionBy(*_series_cols(series)).orderBy(*[F.col(c) for c in order])
        return df.withColumns(build(spec))
    spread = with_halo(df, series, order, behind, ahead, layout, total)
    if number:
        spread = spread.withColumn(number, F.col("_rn"))
    spec = Window.partitionBy(*_series_cols(series), F.col("_chunk")).orderBy("_rn")
    out = spread.withColumns(build(spec))
    return out.where(~F.col("_halo")).drop("_chunk", "_halo", "_rn")


# -- W1–W3 ---------------------------------------------------------------------

def lag_columns(cols: Sequence[str], lags: Sequence[int] = (1, 3)):
    def build(spec: WindowSpec) -> dict[str, Column]:
        return {f"{c}_lag{n}": F.lag(F.col(c), n).over(spec) for c in cols for n in lags}
    return build


def rolling_mean_columns(cols: Sequence[str], sizes: Sequence[int] = (7, 30)):
    def build(spec: WindowSpec) -> dict[str, Column]:
        return {f"{c}_roll{n}": F.avg(F.col(c)).over(spec.rowsBetween(-(n - 1), 0))
                for c in cols for n in sizes}
    return build


def rolling_std_columns(cols: Sequence[str], size: int = 7):
    def build(spec: WindowSpec) -> dict[str, Column]:
        return {f"{c}_std{size}": F.coalesce(
            F.stddev_samp(F.col(c)).over(spec.rowsBetween(-(size - 1), 0)), F.lit(0.0))
            for c in cols}
    return build


def combine(*builders):
    def build(spec: WindowSpec) -> dict[str, Column]:
        out: dict[str, Column] = {}
        for b in builders:
            out.update(b(spec))
        return out
    return build


def lag_rolling_features(df: DataFrame, cols: Sequence[str], series: str | None = SERIES,
                         order: Sequence[str] = ORDER, layout: Layout = CHUNKED) -> DataFrame:
    """W1–W3 in one window pass, in the reference's column order per input column:
    lag1, lag3, roll7, roll30, std7."""
    def build(spec: WindowSpec) -> dict[str, Column]:
        out: dict[str, Column] = {}
        for c in cols:
            out.update(lag_columns([c])(spec))
            out.update(rolling_mean_columns([c])(spec))
            out.update(rolling_std_columns([c])(spec))
        return out
    return apply_ordered(df, build, series, order, behind=29, ahead=0, layout=layout)


# -- W4, W6 --------------------------------------------------------------------

def sequences(df: DataFrame, col: str, look_back: int = 30, horizon: int = 2,
              series: str | None = SERIES, order: Sequence[str] = ORDER,
              layout: Layout = CHUNKED, keep: Sequence[str] = ("event_id",),
              total: str | None = None) -> DataFrame:
    """Sliding (x = next ``look_back`` values, y = the ``horizon`` after them)
    starting at every row; rows without a full y are dropped (n − look_back −
    horizon + 1 pairs per series).  Adds ``seq_no`` (0-based start position).

    The table is numbered once.  A pair is full by its position, so a plan that does
    not use x and y does not build them; ``total`` names a column for the series'
    number of pairs."""
    def values(spec: WindowSpec, start: int, n: int) -> Column:
        # structs, so that a NULL keeps its place in the window
        rows = F.collect_list(F.struct(F.col(col).alias("v"))).over(
            spec.rowsBetween(start, start + n - 1))
        return F.transform(rows, lambda r: r["v"])

    def build(spec: WindowSpec) -> dict[str, Column]:
        return {"x": values(spec, 0, look_back), "y": values(spec, look_back, horizon)}
    needed = dict.fromkeys([*([series] if series else []), *order, *keep, col])
    out = apply_ordered(df.select(*needed), build, series, order, 0, look_back + horizon - 1,
                        layout, "_seq_rn", "_seq_n")
    pairs = F.col("_seq_n") - F.lit(look_back + horizon - 1)
    out = out.withColumn("seq_no", F.col("_seq_rn") - F.lit(1)) \
             .where(F.col("_seq_rn") <= pairs)
    return out.select(*_series_cols(series), *keep, "seq_no", "x", "y",
                      *([pairs.alias(total)] if total else []))


def chronological_split(seqs: DataFrame, train_fraction: float = 0.85,
                        pos: str = "seq_no", total: str = "n_seq") -> DataFrame:
    """First ``floor(fraction · n)`` sequences of each series are train, with n from
    the column ``total`` that :func:`sequences` adds on request."""
    cut = F.floor(F.col(total) * F.lit(train_fraction))
    return seqs.withColumn("split", F.when(F.col(pos) < cut, F.lit("train"))
                           .otherwise(F.lit("validation"))).drop(total)
