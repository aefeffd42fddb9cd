"""Benchmark decontamination with a distributed positional inverted index.

``build_index`` cuts the training texts into segments (a few MB of text each) and
stores, per segment, every distinct term with the ascending list of the positions at
which it stands: postings of all tokens of all documents, delta-coded and compressed
in a written table.  ``probe`` runs benchmark windows against every segment: a window
whose terms are not all in the segment is out; otherwise the posting list of its
rarest term, shifted by the term's offset, gives the possible starts, and the lists of
the other terms are intersected with them from rare to frequent.  What remains are
exact phrase matches (``slop`` 0), or proximity matches: a run of words of one document, as
many as the window has, with every term within ``slop`` places of its own place (the
rarest too, so its postings give starts on both sides).  The benchmark is probed in blocks
of at most about ``block_windows`` windows, one after the other, and a block's matches are
written before the next is fetched, so what the driver and the tasks hold is bounded
however large the benchmark is; matches of all blocks are united per document afterwards.

Words are runs of [0-9a-z] and non-ASCII characters after lower-casing A-Z.  A
window is ``size`` consecutive words of an item; a shorter, non-empty item is one
window.  Words are compared by 64-bit hashes.

Defined results: null and empty texts have no words and no hits; items without words
match nothing; items with a null id hit words but are not listed; rows that share an
item id are one item with the windows of both; repeated documents are separate rows;
a very long text is a segment of its own, whole; equally rare terms are tried in the order
of the window; an empty benchmark leaves every document clean, and without documents the
result is empty; other columns are not read.
"""

from __future__ import annotations

import sys

import numpy as np
import pyarrow as pa
from pyspark import TaskContext, cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from helio.llm.stages import discard, documents, written
from helio.llm.textscan import give_back, text_slices, word_hashes

cloudpickle.register_pickle_by_value(sys.modules[__name__])

BLOCK_WINDOWS = 200_000
_INDEX = "segment long, doc_id array<long>, n_words array<long>, terms binary, postings binary"


def _pack(values: np.ndarray) -> bytes:
    """Byte planes of 32-bit values, compressed."""
    import zstandard
    planes = np.ascontiguousarray(values.astype("<u4").view(np.uint8).reshape(-1, 4).T)
    return zstandard.ZstdCompressor(level=1).compress(planes.tobytes())


def _unpack(data: bytes) -> np.ndarray:
    import zstandard
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), dtype=np.uint8)
    return np.ascontiguousarray(planes.reshape(4, -1).T).view("<u4").reshape(-1)


def encode_postings(hashes: np.ndarray) -> tuple[bytes, bytes]:
    """(terms, postings): sorted distinct terms, and a list of their counts followed by
    the positions by term, each list ascending and delta-coded."""
    order = np.argsort(hashes, kind="stable")
    by_term = hashes[order]
    new = np.ones(len(by_term), dtype=bool)
    new[1:] = by_term[1:] != by_term[:-1]
    first = np.flatnonzero(new)
    counts = np.diff(np.append(first, len(by_term)))
    at = order.astype(np.int64)
    delta = np.diff(at, prepend=0)
    delta[first] = at[first]
    return (by_term[first].tobytes(),
            _pack(np.concatenate([counts, delta]).astype(np.uint32)))


def decode_postings(terms: bytes, postings: bytes):
    """(terms, begin, positions): list i is positions[begin[i]:begin[i + 1]]."""
    names = np.frombuffer(terms, dtype=np.uint64)
    flat = _unpack(postings).astype(np.int64) if len(names) else np.zeros(0, np.int64)
    counts, delta = flat[:len(names)], flat[len(names):]
    begin = np.concatenate(([0], np.cumsum(counts)))
    run = np.cumsum(delta)
    before = np.where(begin[:-1] > 0, run[begin[:-1] - 1], 0) if len(names) else run
    return names, begin, run - np.repeat(before, counts)


def build_index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The written index: one row per segment (see the module's text)."""
    def segments(batches):
        part, n = TaskContext.get().partitionId(), 0
        for batch in batches:
            for piece in text_slices(batch, "text"):
                hashes, first, _, _ = word_hashes(piece.column(1), "alnum")
                terms, postings = encode_postings(hashes)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([(part << 32) | n], pa.int64()),
                     pa.array([piece.column(0).to_pylist()], pa.list_(pa.int64())),
                     pa.array([np.diff(first)], pa.list_(pa.int64())),
                     pa.array([terms], pa.binary()), pa.array([postings], pa.binary())],
                    names=["segment", "doc_id", "n_words", "terms", "postings"])
                n += 1
    return written(documents(docs, id_col, text_col).mapInArrow(segments, _INDEX), "postings")


def windows(benchmark: DataFrame, size: int = 10, id_col: str = "item_id",
            text_col: str = "text") -> DataFrame:
    """(item_id, terms): every window of every item, terms as hashes."""
    def cut(batches):
        for batch in batches:
            for piece in text_slices(batch, "text"):
                hashes, first, _, _ = word_hashes(piece.column(1), "alnum")
                hashes = hashes.view(np.int64)
                for i, item in enumerate(piece.column(0).to_pylist()):
                    own = hashes[first[i]:first[i + 1]]
                    if len(own) == 0:
                        continue
                    width = min(size, len(own))
                    rows = list(np.lib.stride_tricks.sliding_window_view(own, width))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([item] * len(rows), pa.int64()),
                         pa.array(rows, pa.list_(pa.int64()))], names=["item_id", "terms"])
    return (documents(benchmark, id_col, text_col).withColumnRenamed("doc_id", "item_id")
            .mapInArrow(cut, "item_id long, terms array<long>").distinct())


def _match(names, begin, positions, doc_of, tables, slop):
    """(starts, lengths, items) of the windows found in one segment."""
    n = len(positions)
    found_at, found_len, found_item = [], [], []
    if n == 0:
        return found_at, found_len, found_item
    term_at = np.empty(n, dtype=np.int64)  # position -> number of its posting list
    term_at[positions] = np.repeat(np.arange(len(names)), np.diff(begin))
    for items, grid in tables:
        width = grid.shape[1]
        lists = np.searchsorted(names, grid)
        lists[lists == len(names)] = 0
        present = (names[lists] == grid).all(axis=1)
        if not present.any():
            continue
        lists, owner = lists[present], items[present]
        size = begin[lists + 1] - begin[lists]
        order = np.argsort(size, axis=1, kind="stable")  # rarest term first
        rare = order[:, 0]
        rows = np.arange(len(lists))
        count = size[rows, rare]
        which = np.repeat(rows, count)
        place = np.arange(len(which)) - np.repeat(np.cumsum(count) - count, count)
        start = positions[begin[lists[rows, rare]][which] + place] - rare[which]
        if slop:  # the rarest term may be displaced itself
            start = (start[:, None] + np.arange(-slop, slop + 1)).ravel()
            which = np.repeat(which, 2 * slop + 1)
            which, start = np.unique(np.stack([which, start]), axis=1)
        fits = (start >= 0) & (start + width <= n)
        which, start = which[fits], start[fits]
        same = doc_of[start] == doc_of[start + width - 1]
        which, start = which[same], start[same]
        for turn in range(0 if slop else 1, width):
            offset = order[which, turn]
            wanted = lists[which, offset]
            hit = np.zeros(len(which), dtype=bool)
            for d in range(-slop, slop + 1):
                at = np.clip(start + offset + d, 0, n - 1)
                near = doc_of[at] == doc_of[start]
                near &= at == start + offset + d
                hit |= near & (term_at[at] == wanted)
            which, start = which[hit], start[hit]
        found_at.append(start)
        found_len.append(np.full(len(start), width))
        found_item.append(owner[which])
    return found_at, found_len, found_item


def probe(spark: SparkSession, index: DataFrame, benchmark: DataFrame, size: int = 10,
          slop: int = 0, block_windows: int = BLOCK_WINDOWS, id_col: str = "item_id",
          text_col: str = "text") -> DataFrame:
    """(segment, doc_no, doc_id, n_words, spans, item_ids) of every document.

    ``spans`` are the runs [start, stop) of words inside a match; ``item_ids`` the
    distinct items with a match, sorted.
    """
    cut = written(windows(benchmark, size, id_col, text_col), "windows")
    blocks = max(1, -(-cut.count() // block_windows))
    doc = F.arrays_zip(F.col("doc_id").alias("id"), F.col("n_words").alias("n"))
    clean = index.select("segment", F.posexplode(doc).alias("doc_no", "d")).select(
        "segment", "doc_no", "d.id", "d.n").toDF("segment", "doc_no", "doc_id", "n_words")
    none = "array<struct<start:int,stop:int>>"
    results = clean.select("*", F.array().cast(none).alias("spans"),
                           F.array().cast("array<long>").alias("item_ids"))
    for b in range(blocks):
        mine = cut.filter(F.pmod(F.xxhash64("item_id", "terms"), F.lit(blocks)) == b).toArrow()
        items = np.asarray(mine.column("item_id").fill_null(-1)).astype(np.int64)
        known = np.asarray(mine.column("item_id").is_valid())
        terms = mine.column("terms").combine_chunks()
        flat, ends = np.asarray(terms.values).view(np.uint64), np.asarray(terms.offsets)
        width = np.diff(ends)
        tables = []
        for w in np.unique(width):
            rows = np.flatnonzero(width == w)
            tables.append((rows, flat[ends[:-1][rows][:, None] + np.arange(w)]))
        shared = spark.sparkContext.broadcast((items, known, tables))
        part = written(index.mapInArrow(_prober(shared, slop), (
            "segment long, doc_no int, doc_id long, n_words long, "
            f"spans {none}, item_ids array<long>")), "matches")
        shared.destroy()
        results = results.unionByName(part)
    return results.groupBy("segment", "doc_no").agg(
        F.first("doc_id").alias("doc_id"), F.first("n_words").alias("n_words"),
        F.array_sort(F.flatten(F.collect_list("spans"))).alias("spans"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("item_ids")))).alias("item_ids"))


def _prober(shared, slop: int):
    span = pa.struct([("start", pa.int32()), ("stop", pa.int32())])

    def run(batches):
        items, known, tables = shared.value
        for batch in batches:
            for row in range(batch.num_rows):
                segment, ids, sizes, terms, postings = (
                    batch.column(c)[row] for c in range(5))
                ids, sizes = ids.as_py(), np.array(sizes.as_py(), dtype=np.int64)
                names, begin, positions = decode_postings(terms.as_py(), postings.as_py())
                first = np.concatenate(([0], np.cumsum(sizes)))
                doc_of = np.repeat(np.arange(len(sizes)), sizes)
                at, length, which = _match(names, begin, positions, doc_of, tables, slop)
                spans: list = [[] for _ in ids]
                named: list = [[] for _ in ids]
                if at and sum(map(len, at)):
                    at, length, which = map(np.concatenate, (at, length, which))
                    cover = np.zeros(len(positions) + 1, dtype=np.int64)
                    np.add.at(cover, at, 1)
                    np.add.at(cover, at + length, -1)
                    inside = np.cumsum(cover[:-1]) > 0
                    edge = np.ones(len(inside) + 1, dtype=bool)
                    edge[1:-1] = (inside[1:] != inside[:-1]) | (doc_of[1:] != doc_of[:-1])
                    cuts = np.flatnonzero(edge)
                    for s, e in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
                        if inside[s]:
                            d = int(doc_of[s])
                            spans[d].append({"start": s - int(first[d]), "stop": e - int(first[d])})
                    pairs = np.unique(np.stack([doc_of[at], which], axis=1)[known[which]], axis=0)
                    for d, w in pairs.tolist():
                        named[d].append(int(items[w]))
                hit = [d for d, s in enumerate(spans) if s]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([segment.as_py()] * len(hit), pa.int64()),
                     pa.array(hit, pa.int32()), pa.array([ids[d] for d in hit], pa.int64()),
                     pa.array(sizes[hit], pa.int64()),
                     pa.array([spans[d] for d in hit], pa.list_(span)),
                     pa.array([sorted(set(named[d])) for d in hit], pa.list_(pa.int64()))],
                    names=["segment", "doc_no", "doc_id", "n_words", "spans", "item_ids"])
            give_back()
    return run


def covered(spans):
    """Number of words inside sorted spans that may overlap."""
    state = F.struct(F.lit(0).alias("stop"), F.lit(0).cast("long").alias("n"))
    return F.aggregate(spans, state, lambda a, s: F.struct(
        F.greatest(a["stop"], s["stop"]).alias("stop"),
        (a["n"] + F.greatest(F.lit(0), s["stop"] - F.greatest(a["stop"], s["start"])))
        .cast("long").alias("n")), lambda a: a["n"])


def contamination(docs: DataFrame, benchmark: DataFrame, size: int = 10, slop: int = 0,
                  block_windows: int = BLOCK_WINDOWS) -> DataFrame:
    """(doc_id, n_words, n_hit, spans, item_ids) of every document, written; the index is
    removed again (``build_index`` and ``probe`` keep one for several benchmarks)."""
    index = build_index(docs)
    found = written(probe(docs.sparkSession, index, benchmark, size, slop, block_windows)
            .select("doc_id", "n_words", covered(F.col("spans")).alias("n_hit"),
                    "spans", "item_ids"), "contamination")
    discard(index)
    return found
