"""Quality classifier by importance resampling with hashed n-gram models.

A text is read as tokens (runs of letters and digits, runs of other marks).  Its
n-grams are hashed into ``BUCKETS`` buckets: words, and runs of one to three token
shapes (kind, letter case, length class, "same as the token before"; marks are shapes
themselves).  Two generative bag-of-n-grams models are counted over the whole corpus,
one of the target texts (labelled good) and one of all raw texts.  A document's log
importance weight is the sum of the log ratios target : raw of all its n-grams.
Documents are then sampled without replacement by Gumbel top-k: the k largest of log
weight + Gumbel noise.  Noise is a hash of seed, id and text, so reruns agree.

k is a parameter.  ``expected_size`` estimates it as the number of documents that may be
like the target: the sum of min(1, weight times e^``doubt``) over all documents.  The
n-grams of a text are not independent, and its own words may be missing from the target's
sample, so a short good text can have a weight below 1; ``doubt`` (in nats) says how much
evidence against a document counts for nothing.  (A text of junk has hundreds.)

Defined results: null and empty texts have no n-grams, weight 1 (log 0) and are sampled
like other undecided texts; a null id hashes like an id of its own; repeated rows get the
same key and stay or go together (a tie at the cut stays whole); texts of any length are
scored whole, in slices of a few MB of other texts at most; without target texts
every log weight is 0 and all documents stay; an empty table gives an empty result; other
columns are not read.
"""

from __future__ import annotations

import sys

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from helio.llm.stages import may_hold, small_batches, without, written
from helio.llm.textscan import byte_values, mix64, separators, text_slices, utf8_buffer

cloudpickle.register_pickle_by_value(sys.modules[__name__])

BUCKETS = 1 << 14
DOUBT = 10.0
_BASE = 0x5851F42D4C957F2D


def tokens(texts: pa.Array):
    """(hash, shape, first): content hash and shape code of every token, and the index of
    each text's first token."""
    data, offsets = utf8_buffer(texts)
    n = len(offsets) - 1
    word, space = ~separators("alnum")[data], separators("space")[data]
    kind = np.where(space, 0, np.where(word, 1, 2)).astype(np.int8)
    if not kind.any():
        return np.zeros(0, np.uint64), np.zeros(0, np.uint64), np.zeros(n + 1, np.int64)
    edge = np.ones(len(kind) + 1, dtype=bool)
    edge[1:-1] = kind[1:] != kind[:-1]
    edge[offsets] = True
    starts = np.flatnonzero(edge[:-1])
    sizes = np.diff(np.append(starts, len(kind)))
    pos = np.arange(len(kind)) - np.repeat(starts, sizes)
    powers = np.full(int(sizes.max()), _BASE, dtype=np.uint64)
    powers[0] = 1
    np.multiply.accumulate(powers, out=powers)
    content = np.add.reduceat(byte_values()[data] * powers[pos], starts)
    upper = np.add.reduceat(((data >= 65) & (data <= 90)).astype(np.int64), starts)
    digit = np.add.reduceat(((data >= 48) & (data <= 57)).astype(np.int64), starts)
    used = kind[starts] > 0
    content, upper, digit, sizes, starts = (
        x[used] for x in (content, upper, digit, sizes, starts))
    first = np.searchsorted(starts, offsets)
    content = mix64(content ^ sizes.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    case = np.where(upper == 0, 0, np.where(upper == 1, 1, 2))
    length = np.searchsorted([1, 2, 4, 8, 16, 32], sizes, side="left")
    same = np.zeros(len(content), dtype=np.int64)
    same[1:] = content[1:] == content[:-1]
    same[first[:-1][first[:-1] < len(content)]] = 0
    is_word = kind[starts] == 1
    shape = np.where(is_word, 1 + case + 3 * length + 24 * (digit > 0) + 48 * same, 0)
    shape = np.where(is_word, mix64(shape.astype(np.uint64)),
                     content ^ same.astype(np.uint64))
    return content, shape, first


def grams(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bucket, text): every n-gram's bucket, and the index of its text."""
    content, shape, first = tokens(texts)
    text = np.repeat(np.arange(len(first) - 1), np.diff(first))
    out, owner, acc = [content], [text], np.zeros(len(shape), dtype=np.uint64)
    for n in (1, 2, 3):
        stop = len(shape) - n + 1
        if stop <= 0:
            break
        acc = mix64(acc[:stop] * np.uint64(31) + shape[n - 1:] + np.uint64(n))
        whole = text[:stop] == text[n - 1:]
        out.append(acc[whole])
        owner.append(text[:stop][whole])
    return ((np.concatenate(out) & np.uint64(BUCKETS - 1)).astype(np.int64),
            np.concatenate(owner))


def gram_counts(texts: DataFrame) -> np.ndarray:
    """n-gram counts of all texts (one column): every task sends ``BUCKETS`` rows."""
    def count(batches):
        total = np.zeros(BUCKETS, dtype=np.int64)
        for batch in batches:
            for piece in text_slices(batch, "text"):
                total += np.bincount(grams(piece.column(0))[0], minlength=BUCKETS)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(BUCKETS)), pa.array(total)],
                                         names=["bucket", "n"])
    with small_batches(texts.sparkSession):
        got = (texts.mapInArrow(count, "bucket long, n long").groupBy("bucket")
               .agg(F.sum("n").alias("n")).toArrow())
    out = np.zeros(BUCKETS, dtype=np.float64)
    out[np.asarray(got.column("bucket"))] = np.asarray(got.column("n"))
    return out


def log_ratio(target: np.ndarray, raw: np.ndarray, smooth: float = 1.0) -> np.ndarray:
    """log p_target - log p_raw per bucket; the raw model backs both up with ``smooth``
    of its own mass per bucket, so a bucket unseen in the target is unlikely, not
    impossible.  All zero without target texts."""
    if not target.sum() or not raw.sum():
        return np.zeros(BUCKETS)
    p_raw = (raw + smooth) / (raw.sum() + smooth * BUCKETS)
    p_target = (target + smooth * BUCKETS * p_raw) / (target.sum() + smooth * BUCKETS)
    return np.log(p_target) - np.log(p_raw)


def weights(docs: DataFrame, ratio, extra: str = "") -> DataFrame:
    """(doc_id, h, log_weight) of every document; h is a hash of its text."""
    def score(batches):
        table = ratio.value
        for batch in batches:
            for piece in text_slices(batch, "text"):
                bucket, owner = grams(piece.column(2))
                total = np.bincount(owner, weights=table[bucket], minlength=piece.num_rows)
                yield pa.RecordBatch.from_arrays(
                    [piece.column(0), piece.column(1), pa.array(total, pa.float64())],
                    names=["doc_id", "h", "log_weight"])
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"),
                       F.xxhash64(F.coalesce("text", F.lit(""))).alias("h"),
                       F.coalesce("text", F.lit("")).alias("text")).mapInArrow(
        score, "doc_id long, h long, log_weight double")


def gumbel(seed: int):
    """Gumbel noise from a hash of seed, id and text hash."""
    u = (F.pmod(F.xxhash64(F.lit(seed), "doc_id", "h"), F.lit(1 << 52)) + F.lit(0.5)) / (1 << 52)
    return -F.log(-F.log(u))


def expected_size(scored: DataFrame, doubt: float = DOUBT) -> int:
    """The number of documents that may be like the target (see the module's text)."""
    like = F.exp(F.least(F.col("log_weight") + F.lit(doubt), F.lit(0.0)))
    return round(scored.agg(F.sum(like)).first()[0] or 0)


def resampled(docs: DataFrame, target: DataFrame, k: int | None = None,
              seed: int = 1) -> DataFrame:
    """(doc_id, h, log_weight, gumbel_key, kept) of every document: ``kept`` marks the ``k``
    of the sample (``expected_size`` documents unless given).

    ``target`` holds the ids (doc_id) of the target texts.
    """
    spark = docs.sparkSession
    wanted = target.select(F.col("doc_id").cast("long").alias("_t")).dropna().distinct()
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"),
                        F.coalesce("text", F.lit("")).alias("text"))
    raw = gram_counts(texts.select("text"))
    near = may_hold(texts, F.xxhash64("doc_id"), wanted.select(F.xxhash64("_t").alias("h")))
    good = gram_counts(near.join(wanted.hint("merge"), F.col("doc_id") == F.col("_t"),
                                 "left_semi").select("text"))
    ratio = spark.sparkContext.broadcast(log_ratio(good, raw))
    scored = written(weights(docs, ratio).withColumn(
        "gumbel_key", F.col("log_weight") + gumbel(seed)), "weights")
    ratio.destroy()
    if k is None:
        k = expected_size(scored)
    return scored.withColumn("kept", F.col("gumbel_key") >= kth_largest(scored, "gumbel_key", k))


def kth_largest(df: DataFrame, column: str, k: int) -> float:
    """The k-th largest value, exactly, without a sort: bracket it by histograms whose
    counts are exact, and narrow the bracket until one value is left in it."""
    if k <= 0:
        return float("inf")
    low, high, n = df.agg(F.min(column), F.max(column), F.count(column)).first()
    if n <= k:
        return float("-inf")
    above = 0  # rows above the bracket
    while low < high:
        width = (high - low) / 1024
        if low + width <= low:  # neighbouring doubles: take them one by one
            values = (df.filter(F.col(column).between(low, high)).groupBy(column).count()
                      .orderBy(F.desc(column)).collect())
            for value, n in values:
                above += n
                if above >= k:
                    return value
        cell = F.least(F.lit(1023), F.floor((F.col(column) - low) / width)).cast("int")
        rows = (df.filter(F.col(column).between(low, high)).groupBy(cell.alias("cell"))
                .agg(F.count(F.lit(1)).alias("n"), F.min(column).alias("low"),
                     F.max(column).alias("high")).collect())
        for row in sorted(rows, key=lambda r: -r["cell"]):
            if above + row["n"] >= k:
                low, high = row["low"], row["high"]
                break
            above += row["n"]
    return low


def sampled_documents(docs: DataFrame, target: DataFrame, **options) -> DataFrame:
    """The documents (all columns) that the resampling keeps."""
    lost = resampled(docs, target, **options).filter("NOT kept").select(
        F.xxhash64("doc_id", "h").alias("key"))
    text = F.xxhash64(F.coalesce("text", F.lit("")))
    return without(docs, F.xxhash64(F.col("doc_id").cast("long"), text), lost)
