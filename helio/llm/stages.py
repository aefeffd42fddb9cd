"""Small shared helpers: written stages, document keys and distributed running totals."""

from __future__ import annotations

from collections.abc import Sequence
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from helio.session import scratch_path

#: Stands for a null document id where ids are compared (smaller than any id).
NO_ID = -(2 ** 63)
#: Bits of the bitmaps that stand in for sets of keys (2 MB).
BITMAP = 1 << 24


#: Bytes and rows of a batch on its way to a Python worker; Spark's own bounds are larger,
#: and a batch is held on both sides.
BATCH = {"spark.sql.execution.arrow.maxBytesPerBatch": str(4 << 20),
         "spark.sql.execution.arrow.maxRecordsPerBatch": "4000"}


@contextmanager
def small_batches(spark: SparkSession):
    """Small batches for the jobs that run inside; the session's settings come back after."""
    before = {k: spark.conf.get(k, None) for k in BATCH}
    try:
        for k, v in BATCH.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            if v is None:
                spark.conf.unset(k)
            else:
                spark.conf.set(k, v)


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a Parquet table in the shared folder of ``spark.checkpoint.dir``."""
    path = scratch_path(df.sparkSession, f"llm-{name}")
    with small_batches(df.sparkSession):
        df.write.parquet(path)
    out = df.sparkSession.read.parquet(path)
    out.stage_path = path
    return out


def discard(*tables: DataFrame) -> None:
    """Remove written tables that nothing reads any more."""
    for table in tables:
        jvm, jsc = table.sparkSession._jvm, table.sparkSession._jsc
        path = jvm.org.apache.hadoop.fs.Path(table.stage_path)
        path.getFileSystem(jsc.hadoopConfiguration()).delete(path, True)


def documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
              *more: str) -> DataFrame:
    """Only the columns an operator needs; a null text is empty."""
    return docs.select(F.col(id_col).cast("long").alias("doc_id"),
                       F.coalesce(F.col(text_col), F.lit("")).alias("text"),
                       *[F.col(c) for c in more])


def null_safe(a: DataFrame, b: DataFrame, cols: Sequence[str]) -> Column:
    """Join condition on ``cols`` in which null equals null."""
    cond = F.lit(True)
    for c in cols:
        cond = cond & a[c].eqNullSafe(b[c])
    return cond


def _bitmap(keys: DataFrame) -> DataFrame:
    """(word, bits): a bitmap of ``BITMAP`` bits with one bit set for each hash in the only
    column of ``keys``.  At most BITMAP / 64 rows, whatever the number of keys."""
    slot = F.pmod(F.col(keys.columns[0]), F.lit(BITMAP))
    return keys.select(slot.alias("slot")).groupBy(F.floor(F.col("slot") / 64).alias("word")).agg(
        F.expr("bit_or(shiftleft(1L, cast(slot % 64 as int)))").alias("bits"))


def _marked(df: DataFrame, key: Column, keys: DataFrame) -> DataFrame:
    """``df`` with ``__helio_key`` and ``__helio_maybe``, true if the key (a hash) may be in
    ``keys``.  The bitmap is broadcast: its size is fixed."""
    tagged = df.withColumn("__helio_key", key).withColumn(
        "__helio_slot", F.pmod("__helio_key", F.lit(BITMAP)))
    words = F.broadcast(_bitmap(keys).toDF("__helio_word", "__helio_bits"))
    bit = F.expr("shiftright(__helio_bits, cast(__helio_slot % 64 as int)) & 1L")
    return tagged.join(
        words, F.floor(F.col("__helio_slot") / 64) == F.col("__helio_word"), "left").withColumn(
        "__helio_maybe", F.coalesce(bit == 1, F.lit(False)))


def may_hold(df: DataFrame, key: Column, keys: DataFrame) -> DataFrame:
    """The rows of ``df`` whose key may be among ``keys`` (a few others pass too), found
    without a shuffle; an exact join of what is left can follow."""
    return _marked(df, key, keys).filter("__helio_maybe").select(*[df[c] for c in df.columns])


def without(df: DataFrame, key: Column, keys: DataFrame) -> DataFrame:
    """The rows of ``df`` whose key (a hash) is not among ``keys``, exactly.  Only rows that
    the bitmap cannot clear are shuffled."""
    marked = _marked(df, key, keys)
    columns = [df[c] for c in df.columns]
    doubt = marked.filter("__helio_maybe").join(keys.toDF("__helio_lost").distinct().hint("merge"),
                                         F.col("__helio_key") == F.col("__helio_lost"), "left_anti")
    return marked.filter("NOT __helio_maybe").select(*columns).unionByName(doubt.select(*columns))


def running_totals(df: DataFrame, group: Sequence[str], order: Sequence[str],
                   value: str, total: str) -> DataFrame:
    """Add ``total``: the sum of ``value`` over the rows before a row in its group.

    A group may be larger than a task: rows are range-partitioned on group and
    order and written with their partition number; sums run inside each
    (group, partition) piece, and a table with one row per piece supplies each
    piece's offset.  Rows that tie in ``order`` get some order among themselves.
    """
    group, order = list(group), list(order)
    placed = written(df.repartitionByRange(*group, *order)
                     .withColumn("_piece", F.spark_partition_id()), "ranges")
    before = Window.partitionBy(*group, "_piece").orderBy(*order).rowsBetween(
        Window.unboundedPreceding, -1)
    local = placed.withColumn("_local", F.coalesce(F.sum(value).over(before), F.lit(0)))
    pieces = placed.groupBy(*group, "_piece").agg(F.sum(value).alias("_sum"))
    earlier = (Window.partitionBy(*group) if group else Window.partitionBy(F.lit(0))).orderBy(
        "_piece").rowsBetween(Window.unboundedPreceding, -1)
    offsets = pieces.select(*[F.col(c).alias(f"_o_{c}") for c in group],
                            F.col("_piece").alias("_o_piece"),
                            F.coalesce(F.sum("_sum").over(earlier), F.lit(0)).alias("_offset"))
    cond = F.col("_piece") == F.col("_o_piece")
    for c in group:
        cond = cond & F.col(c).eqNullSafe(F.col(f"_o_{c}"))
    return (local.join(offsets, cond, "left")
            .withColumn(total, (F.col("_local") + F.col("_offset")).cast("long"))
            .drop("_piece", "_local", "_offset", "_o_piece", *[f"_o_{c}" for c in group]))
