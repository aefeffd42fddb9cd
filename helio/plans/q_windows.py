"""Registered W1–W6 window features."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from helio.operators import windows as W
from helio.plans.registry import register, round_sql, with_obs
from helio.schema import LAG_COLUMNS
from helio.sources.observations import observations

# Chunk size of the skew-safe layout used by the registered W5 query.  Small
# enough that the sf0.01 global series (10,000 rows) spans several chunks, so
# the halo path is what gets checked.
W5_LAYOUT = W.Layout("chunked", chunk_rows=4096)

NEEDED = ("event_id", "series_id", "timestamp", *LAG_COLUMNS)
WIN = "partition by series_id order by timestamp, event_id"
GWIN = "order by timestamp, event_id"


def _lags_sql(win: str) -> str:
    return ",\n  ".join(f"lag({c}, {n}) over ({win}) as {c}_lag{n}"
                        for c in LAG_COLUMNS for n in (1, 3))


def _roll_sql(win: str) -> str:
    return ",\n  ".join(
        f"{round_sql(f'avg({c}) over ({win} rows between {n - 1} preceding and current row)')}"
        f" as {c}_roll{n}" for c in LAG_COLUMNS for n in (7, 30))


def _std_sql(win: str) -> str:
    return ",\n  ".join(
        f"{round_sql(f'coalesce(stddev_samp({c}) over ({win} rows between 6 preceding and current row), 0)')}"
        f" as {c}_std7" for c in LAG_COLUMNS)


def _r6(cols):
    return [F.round(F.col(c), 6).alias(c) for c in cols]


@register("lags", with_obs(f"select event_id, series_id, timestamp,\n  {_lags_sql(WIN)}\nfrom obs"))
def q_lags(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = observations(spark, sf_dir).select(*NEEDED)
    out = W.apply_ordered(o, W.lag_columns(LAG_COLUMNS), behind=3)
    return out.select("event_id", "series_id", "timestamp",
                      *[f"{c}_lag{n}" for c in LAG_COLUMNS for n in (1, 3)])


@register("rolling_means", with_obs(
    f"select event_id, series_id, timestamp,\n  {_roll_sql(WIN)}\nfrom obs"))
def q_rolling_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = observations(spark, sf_dir).select(*NEEDED)
    out = W.apply_ordered(o, W.rolling_mean_columns(LAG_COLUMNS), behind=29)
    return out.select("event_id", "series_id", "timestamp",
                      *_r6([f"{c}_roll{n}" for c in LAG_COLUMNS for n in (7, 30)]))


@register("rolling_std", with_obs(
    f"select event_id, series_id, timestamp,\n  {_std_sql(WIN)}\nfrom obs"))
def q_rolling_std(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = observations(spark, sf_dir).select(*NEEDED)
    out = W.apply_ordered(o, W.rolling_std_columns(LAG_COLUMNS), behind=6)
    return out.select("event_id", "series_id", "timestamp",
                      *_r6([f"{c}_std7" for c in LAG_COLUMNS]))


_SEQ_SQL = f"""select * from (
  select series_id, event_id, row_number() over ({WIN}) - 1 as seq_no,
    list(kp_index) over ({WIN} rows between current row and 29 following) as x,
    list(kp_index) over ({WIN} rows between 30 following and 31 following) as y
  from obs) s where len(y) = 2"""


@register("sequences", with_obs(_SEQ_SQL))
def q_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return W.sequences(observations(spark, sf_dir), "kp_index", 30, 2)


@register("global_rolling", with_obs(
    f"select event_id, timestamp,\n  {_lags_sql(GWIN)},\n  {_roll_sql(GWIN)},\n  "
    f"{_std_sql(GWIN)}\nfrom obs"))
def q_global_rolling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """W1–W3 over the whole table as one series, computed with the skew-safe
    chunk + halo layout (no single-task window)."""
    o = observations(spark, sf_dir).select(*NEEDED).drop("series_id")
    out = W.lag_rolling_features(o, LAG_COLUMNS, series=None, layout=W5_LAYOUT)
    lag_cols = [f"{c}_lag{n}" for c in LAG_COLUMNS for n in (1, 3)]
    roll_cols = [f"{c}_roll{n}" for c in LAG_COLUMNS for n in (7, 30)]
    std_cols = [f"{c}_std7" for c in LAG_COLUMNS]
    return out.select("event_id", "timestamp", *lag_cols, *_r6(roll_cols), *_r6(std_cols))


@register("chronological_split", with_obs(
    f"""select series_id, event_id, seq_no,
  case when seq_no < floor(count(*) over (partition by series_id) * 0.85) then 'train'
       else 'validation' end as split
from ({_SEQ_SQL}) q"""))
def q_chronological_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    seqs = W.sequences(observations(spark, sf_dir), "kp_index", 30, 2, total="n_seq")
    return W.chronological_split(seqs).select("series_id", "event_id", "seq_no", "split")
