"""Spelling variant grouping by blocked Gram matrices of letter counts.

The vocabulary (every word with at least ``min_n`` occurrences) is cut into blocks of
words of one length.  A block is a matrix with one row of letter counts per word; the
product of two such matrices gives all squared distances between their rows.  One
replaced letter moves two counts by one (distance 2), one inserted or deleted letter moves
one count (distance 1), so only pairs at most two apart, of blocks of equal or adjacent
lengths, can be one edit apart.  These are then compared letter by letter.

Within a length, words are ordered by their counts of common letters before they are cut
into blocks.  Every block carries the least and the largest count of each letter, which
bound the distance of any two rows of two blocks from below: pairs of blocks that are
further apart than two are not multiplied.  All other pairs of blocks are, so the work
grows with the square of the vocabulary (not of the text) in the worst case, in units of
bounded size that tasks take independently.  Pairs of words are not emitted: a task keeps,
per word, the number of near words and the best of them.

A word's *form* is its near word with the most occurrences (ties: the smallest in
code-point order) if that has at least ``ratio`` times the word's own; its *root* is the
last word when forms are followed.  Occurrences grow with every step, so forms have no
cycles and a chain has at most log(n) / log(ratio) words.

Words are runs of [A-Za-z\\u00C0-\\u00FF] with A-Z lower-cased.

Defined results: null and empty texts have no words; repeated documents count again; a
very long text is one row of the scan, and its words leave it one by one; very long words
are counted in double precision and make blocks of their own; an empty table gives an
empty result; other columns are not read.
"""

from __future__ import annotations

import sys

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from helio.llm.stages import discard, running_totals, written

cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Letters and their columns in a block: a-z, then U+00C0 to U+00FF.
FIRST, ACCENTED, COLUMNS = 97, 0xC0, 26 + 64
#: Letters whose counts order the words of a length, most useful first.
ORDER = "eaionrtlsu"
#: Letters in a block, and rows of a block that are multiplied at once.
BLOCK_LETTERS, TILE = 1 << 16, 256
#: A longer word's products may not be exact in single precision.
SINGLE = 4000


def runs(text: Column, shortest: int = 1) -> Column:
    """All maximal runs of at least ``shortest`` letters of a text."""
    return F.regexp_extract_all(text, F.lit(f"([A-Za-z\\u00C0-\\u00FF]{{{shortest},}})"), 1)


def lower_ascii(word: Column) -> Column:
    """A-Z lower-cased, nothing else."""
    upper = "".join(map(chr, range(65, 91)))
    return F.when(word.rlike("[A-Z]"), F.translate(word, upper, upper.lower())).otherwise(word)


def vocabulary(words: DataFrame, min_n: int = 5, min_len: int = 6) -> DataFrame:
    """(word, n) of the words (column ``word``) that are long and frequent enough.  Tasks
    count before anything is shuffled, so a frequent word is one row a task."""
    return words.filter(F.length("word") >= min_len).groupBy("word").agg(
        F.count(F.lit(1)).alias("n")).filter(F.col("n") >= min_n)


def letter_rows(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(letters, counts) of words of one length: the column number of every letter, and
    one row of letter counts per word."""
    codes = np.frombuffer("".join(words).encode("utf-32-le"), dtype=np.uint32).astype(np.int64)
    codes = np.where(codes >= ACCENTED, codes - ACCENTED + 26, codes - FIRST)
    letters = codes.reshape(len(words), -1)
    rows = np.arange(len(words))[:, None] * COLUMNS + letters
    counts = np.bincount(rows.ravel(), minlength=len(words) * COLUMNS)
    return letters.astype(np.int8), counts.reshape(len(words), COLUMNS)


def one_edit(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether rows a[i] and b[i] are exactly one edit apart.  Rows of b are as long as
    those of a, or one longer."""
    m = a.shape[1]
    if b.shape[1] == m:
        return (a != b).sum(axis=1) == 1
    head = np.logical_and.accumulate(a == b[:, :m], axis=1).sum(axis=1)
    tail = np.logical_and.accumulate((a == b[:, 1:])[:, ::-1], axis=1).sum(axis=1)
    return head + tail >= m


def _tiles(counts: np.ndarray):
    """(first row, least counts, largest counts) of the tiles of a block."""
    first = np.arange(0, len(counts), TILE)
    return first, np.minimum.reduceat(counts, first), np.maximum.reduceat(counts, first)


def near_pairs(x: list[str], y: list[str] | None = None):
    """Indices (i, j) of the words x[i], y[j] that are one edit apart; y has the length of
    x or is one longer.  Without y, the pairs i < j within x.

    Blocks are multiplied tile by tile, but for tiles whose bounds are more than two apart.
    A row (-2a, |a|^2, 1) times a row (b, 1, |b|^2) is the squared distance of a and b.
    """
    lx, cx = letter_rows(x)
    ly, cy = (lx, cx) if y is None else letter_rows(y)
    used = cx.any(axis=0) | cy.any(axis=0)
    kind = np.float32 if ly.shape[1] < SINGLE else np.float64
    cx, cy = cx[:, used].astype(kind), cy[:, used].astype(kind)
    nx, ny = (c * c for c in (cx, cy))
    nx, ny = nx.sum(axis=1, keepdims=True), ny.sum(axis=1, keepdims=True)
    a = np.concatenate([-2 * cx, nx, np.ones_like(nx)], axis=1)
    b = np.concatenate([cy, np.ones_like(ny), ny], axis=1).T.copy()
    first_x, low_x, top_x = _tiles(cx)
    first_y, low_y, top_y = _tiles(cy)
    left, right = [], []
    for s, low, top in zip(first_x.tolist(), low_x, top_x):
        gap = np.maximum(np.maximum(low - top_y, low_y - top), 0)
        for t in first_y[(gap * gap).sum(axis=1) <= 2].tolist():
            if y is None and t < s:
                continue
            distance = a[s:s + TILE] @ b[:, t:t + TILE]
            flat = np.flatnonzero(distance <= 2)
            flat = flat[distance.ravel()[flat] > 0]  # 0: anagrams, and a word itself
            i, j = np.divmod(flat, distance.shape[1])
            i, j = i + s, j + t
            if t == s and y is None:
                i, j = i[i < j], j[i < j]
            if len(i):
                ok = one_edit(lx[i], ly[j])
                left.append(i[ok])
                right.append(j[ok])
    if not left:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(left), np.concatenate(right)


def _bounds(batches):
    """Blocks with the least and the largest count of each letter."""
    for batch in batches:
        rows = [letter_rows(w)[1] for w in batch.column("words").to_pylist()]
        yield pa.RecordBatch.from_arrays(
            batch.columns + [pa.array([list(r.min(axis=0)) for r in rows], pa.list_(pa.int32())),
                             pa.array([list(r.max(axis=0)) for r in rows], pa.list_(pa.int32()))],
            names=batch.schema.names + ["low", "top"])


def _near(batches):
    """Per word of a pair of blocks: its number of near words there, and the best one."""
    for batch in batches:
        for row in range(batch.num_rows):
            x, nx, y, ny = (batch.column(c)[row].as_py() for c in ("x", "nx", "y", "ny"))
            i, j = near_pairs(x, y)
            sides = [(x, i, y, ny, j), (y, j, x, nx, i)] if y is not None else [
                (x, np.concatenate([i, j]), x, nx, np.concatenate([j, i]))]
            words, counts, best_n, best = [], [], [], []
            for own, at, others, other_n, to in sides:
                found: dict[int, tuple[int, int, str]] = {}
                for a, b in zip(at.tolist(), to.tolist()):
                    c, n, w = found.get(a, (0, -1, ""))
                    n2, w2 = other_n[b], others[b]
                    if n2 > n or n2 == n and w2 < w:
                        n, w = n2, w2
                    found[a] = (c + 1, n, w)
                for a, (c, n, w) in found.items():
                    words.append(own[a])
                    counts.append(c)
                    best_n.append(n)
                    best.append(w)
            yield pa.RecordBatch.from_arrays(
                [pa.array(words, pa.string()), pa.array(counts, pa.int64()),
                 pa.array(best_n, pa.int64()), pa.array(best, pa.string())],
                names=["word", "n_near", "best_n", "best"])


def blocks(words: DataFrame) -> DataFrame:
    """(length, block, words, ns, low, top), written: the vocabulary in blocks."""
    counts = F.concat(*[F.lpad(F.hex(F.length("word") - F.length(F.translate("word", c, ""))),
                               6, "0") for c in ORDER])
    placed = running_totals(words.select(
        "word", "n", F.length("word").alias("length"), counts.alias("place")),
        ["length"], ["place", "word"], "length", "before").withColumn(
        "block", F.floor(F.col("before") / BLOCK_LETTERS))
    grouped = placed.groupBy("length", "block").agg(
        F.sort_array(F.collect_list(F.struct("word", "n"))).alias("w")).select(
        "length", "block", F.col("w.word").alias("words"), F.col("w.n").alias("ns"))
    return written(grouped.mapInArrow(
        _bounds, "length int, block long, words array<string>, ns array<long>, "
                 "low array<int>, top array<int>"), "word-blocks")


def block_pairs(cut: DataFrame) -> DataFrame:
    """Numbers of the blocks that can hold near words of each other: of one length or of
    adjacent ones, and not more than two apart by their bounds.  Blocks only, no words."""
    gap = F.zip_with("alow", "btop", lambda p, q: F.greatest(p - q, F.lit(0)))
    gap = F.zip_with(gap, F.zip_with("blow", "atop", lambda p, q: F.greatest(p - q, F.lit(0))),
                     lambda p, q: F.greatest(p, q).cast("long"))
    apart = F.aggregate(gap, F.lit(0).cast("long"), lambda s, g: s + g * g)
    a = cut.select(F.col("length").alias("la"), F.col("block").alias("i"),
                   F.col("low").alias("alow"), F.col("top").alias("atop"),
                   F.explode(F.array(F.lit(0), F.lit(1))).alias("more")).withColumn(
        "lb", F.col("la") + F.col("more"))
    b = cut.select(F.col("length").alias("lb"), F.col("block").alias("j"),
                   F.col("low").alias("blow"), F.col("top").alias("btop"))
    return a.join(b, "lb").filter("more = 1 OR i <= j").filter(apart <= 2).select(
        "la", "i", "lb", "j")


def near_words(words: DataFrame) -> DataFrame:
    """(word, n_near, best_n, best), written, of the words that have a near word."""
    cut = blocks(words)
    one = cut.select(F.col("length").alias("la"), F.col("block").alias("i"),
                     F.col("words").alias("x"), F.col("ns").alias("nx"))
    two = cut.select(F.col("length").alias("lb"), F.col("block").alias("j"),
                     F.col("words").alias("y"), F.col("ns").alias("ny"))
    same = F.expr("la = lb AND i = j")
    pairs = block_pairs(cut)
    tasks = max(2 * words.sparkSession.sparkContext.defaultParallelism,
                int(words.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    met = pairs.join(one, ["la", "i"]).join(two, ["lb", "j"]).select(
        "x", "nx", F.when(~same, F.col("y")).alias("y"),
        F.when(~same, F.col("ny")).alias("ny")).repartition(
        tasks, F.xxhash64("la", "i", "lb", "j"))
    found = met.mapInArrow(_near, "word string, n_near long, best_n long, best string")
    best = F.min(F.struct((-F.col("best_n")).alias("k"), F.col("best").alias("w")))
    near = written(found.groupBy("word").agg(F.sum("n_near").alias("n_near"), best.alias("b"))
                   .select("word", "n_near", (-F.col("b.k")).alias("best_n"),
                           F.col("b.w").alias("best")), "near-words")
    discard(cut)
    return near


def roots(forms: DataFrame) -> DataFrame:
    """(word, root), written: the ends of the chains of (word, form), by doubling."""
    now = written(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        ahead = now.select(F.col("word").alias("_at"), F.col("root").alias("_next"))
        if not now.join(ahead, F.col("root") == F.col("_at"), "left_semi").take(1):
            return now
        last, now = now, written(
            now.join(ahead, F.col("root") == F.col("_at"), "left").select(
                "word", F.coalesce("_next", "root").alias("root")), "roots")
        discard(last)


def variants(words: DataFrame, min_n: int = 5, min_len: int = 6, ratio: int = 5) -> DataFrame:
    """(word, n, n_near, form, form_n, root) of every frequent word of ``words`` (one row
    per occurrence, column ``word``)."""
    vocab = written(vocabulary(words, min_n, min_len), "vocabulary")
    near = near_words(vocab)
    is_form = F.col("best_n") >= ratio * F.col("n")
    tied = written(vocab.join(near, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        F.when(is_form, F.col("best")).alias("form"),
        F.when(is_form, F.col("best_n")).alias("form_n")), "forms")
    ends = roots(tied.filter("form IS NOT NULL"))
    return tied.join(ends, "word", "left").withColumn("root", F.coalesce("root", "word"))


def damaged_words(docs: DataFrame, every: int = 199, shortest: int = 6) -> DataFrame:
    """One row (``word``) per run of the texts, A-Z lower-cased.  Where ``every`` divides the
    crc32 h of ``<doc_id>:<run>``, the code point h % length is deleted: a repeatable
    spread of misspellings.  A null id counts as an empty text.  Runs shorter than
    ``shortest`` are left out: nothing makes them longer."""
    run = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("_id"),
                      F.explode(runs(F.col("text"), shortest)).alias("_run")).select(
        "_id", lower_ascii(F.col("_run")).alias("_run"))
    h = F.crc32(F.concat(F.col("_id"), F.lit(":"), F.col("_run")).cast("binary"))
    at = F.pmod(F.col("_h"), F.length("_run").cast("long")).cast("int")
    cut = F.concat(F.substring(F.col("_run"), F.lit(1), at),
                   F.substring(F.col("_run"), at + 2, F.length("_run")))
    return run.withColumn("_h", h).select(
        F.when(F.col("_h") % every == 0, cut).otherwise(F.col("_run")).alias("word"))
