"""N-gram Jaccard join by rare-first prefix filtering.

Every text becomes its set of distinct k-word shingles (64-bit hashes).  Texts with
equal sets form one class, and only classes are joined.  Within a set, shingles are
ordered from rare to frequent; two sets of Jaccard similarity t must then share a
shingle among the first ``n - ceil(t n) + 1`` of each (prefix filter), their sizes
must be within t of each other (length filter), the shingles left after the shared
one must still suffice (positional filter), and so must the overlaps possible in each
hash class of the rest (suffix filter).  Frequencies come from a count table of fixed
size (``SKETCH`` counters): any fixed order gives the same links, the counts only
decide how much work finds them.

Links inside a group of m near copies number m**2, so components come first.  The
join for them runs in two rounds.  The first takes, from every list of classes that share a
prefix shingle, each class with the list's hub (the one with the fewest edits, by its
prefix) and with its neighbour by that measure: two candidates a row at most.  The
second takes all candidates whose ends the verified links of the first have not
connected yet; no candidate is dropped for any other reason, so the components are
those of all links.  Each pair is verified once a round against whole sets.

A list longer than ``LIST_ROWS`` is cut into parts, so no task gathers it: in the first
round every part also gets the list's hub, in the second every two parts meet (unless
the whole list is one component already).

All links are then counted.  Two linked classes are in one component, so the classes
of a component are ordered by size, cut into blocks of bounded size, and every two
blocks whose sizes allow a link are compared once, whole sets against whole sets (a
matrix product over the shingles that both hold).  Links are summed in the tasks: no
row is made for a pair.

Defined results: a text with fewer than k words is one shingle of all its words; null
texts and texts without words have no shingles and link with nothing; rows that share
an id are one node; a very long text is a set of its own slice, held whole by one task;
equal counts and sizes are ordered by hash; a null id is its own null component and links nothing; an empty
table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import sys

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from helio.llm.components import components
from helio.llm.stages import (discard, documents, may_hold, running_totals, without,
                              written)
from helio.llm.textscan import mix64, shingle_hashes, text_slices, word_hashes

cloudpickle.register_pickle_by_value(sys.modules[__name__])

SKETCH = 1 << 18
SUFFIX_CLASSES = 1024
#: Rows of a shingle's list that stay together; a longer list is cut into parts by hash.
LIST_ROWS = 2048
#: Shingles and classes in a block whose links are counted, and columns of a product.
BLOCK_SHINGLES, BLOCK_CLASSES, COLUMNS = 1 << 16, 1024, 4096


def _sets(batches, k: int):
    """(ids, sorted shingle sets) per slice of a batch."""
    for batch in batches:
        for piece in text_slices(batch, "text"):
            hashes, first, _, _ = word_hashes(piece.column(1), "space")
            yield piece.column(0), [shingle_hashes(hashes[first[i]:first[i + 1]], k)
                                    for i in range(piece.num_rows)]


def _bucket(shingles: np.ndarray) -> np.ndarray:
    return (shingles & np.uint64(SKETCH - 1)).astype(np.int64)


def set_names(shingles: np.ndarray) -> tuple[int, int]:
    """128 bits that name a set, as two signed 64-bit numbers."""
    with np.errstate(over="ignore"):
        one = mix64(shingles).sum(dtype=np.uint64)
        two = mix64(shingles ^ np.uint64(0xA5A5A5A5A5A5A5A5)).sum(dtype=np.uint64)
    both = mix64(np.array([one, two], dtype=np.uint64)).view(np.int64)
    return int(both[0]), int(both[1])


def document_sets(docs: DataFrame, k: int) -> tuple[DataFrame, DataFrame]:
    """One pass over the texts, written: (doc_id, n, c1, c2) per document, and
    (bucket, n) counts per task, which are fixed in number."""
    def scan(batches):
        counts = np.zeros(SKETCH, dtype=np.int64)
        for ids, sets in _sets(batches, k):
            names = [set_names(s) for s in sets]
            counts += np.bincount(_bucket(np.concatenate(sets)), minlength=SKETCH)
            yield pa.RecordBatch.from_arrays(
                [ids, pa.array([len(s) for s in sets], pa.int64()),
                 pa.array([x[0] for x in names], pa.int64()),
                 pa.array([x[1] for x in names], pa.int64()),
                 pa.array([True] * len(sets), pa.bool_())],
                names=["doc_id", "n", "c1", "c2", "is_doc"])
        used = np.flatnonzero(counts)
        none = pa.array(np.zeros(len(used), dtype=np.int64))
        yield pa.RecordBatch.from_arrays(
            [pa.array(used), pa.array(counts[used]), none, none,
             pa.array(np.zeros(len(used), dtype=bool))],
            names=["doc_id", "n", "c1", "c2", "is_doc"])

    out = written(docs.mapInArrow(
        scan, "doc_id long, n long, c1 long, c2 long, is_doc boolean"), "sets")
    return (out.filter("is_doc").drop("is_doc"),
            out.filter("NOT is_doc").select(F.col("doc_id").alias("bucket"), "n"))


def rarity(counts: DataFrame) -> np.ndarray:
    """The fixed-size count table (``SKETCH`` rows at most reach the driver)."""
    table = np.zeros(SKETCH, dtype=np.uint32)
    got = counts.groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()
    table[np.asarray(got.column("bucket"))] = np.minimum(
        np.asarray(got.column("n")), 2 ** 32 - 1)
    return table


def least_overlap(n: int, t: int) -> int:
    """Smallest overlap of a set of n with any partner at t percent."""
    return -(-t * n // 100)


def prefix_rows(docs: DataFrame, k: int, t: int, table) -> DataFrame:
    """(shingle, c1, size_pos, doubt): the rare-first prefix of every set; size_pos holds
    the set's size (high 32 bits) and the shingle's place in the prefix (low 32).  Only
    where ``doubt`` is true can a list be longer than ``LIST_ROWS``."""
    def scan(batches):
        counts = table.value
        for _, sets in _sets(batches, k):
            out, names, packed, doubt = [], [], [], []
            seen = set()
            for s in sets:
                n = len(s)
                if n == 0:
                    continue
                name = set_names(s)[0]
                if name in seen:
                    continue
                seen.add(name)
                keep = n - least_overlap(n, t) + 1
                rare = np.argsort(counts[_bucket(s)], kind="stable")[:keep]
                out.append(s[rare])
                names.append(np.full(keep, name, dtype=np.int64))
                packed.append((np.int64(n) << 32) + np.arange(keep, dtype=np.int64))
                doubt.append(counts[_bucket(s[rare])] > LIST_ROWS)
            if out:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate(out).view(np.int64)),
                     pa.array(np.concatenate(names)), pa.array(np.concatenate(packed)),
                     pa.array(np.concatenate(doubt))],
                    names=["shingle", "c1", "size_pos", "doubt"])
    return docs.mapInArrow(scan, "shingle long, c1 long, size_pos long, doubt boolean")


def cut_lists(rows: DataFrame) -> DataFrame:
    """(shingle, part, size_pos, c1, parts): the lists, those longer than ``LIST_ROWS`` cut
    into parts by a hash of the class; every part of a cut list also holds its hub."""
    doubt = rows.filter("doubt").select("shingle", "c1", "size_pos").distinct()
    place, size = F.expr("size_pos & 4294967295L"), F.shiftright("size_pos", 32)
    long = doubt.groupBy("shingle").agg(
        F.count(F.lit(1)).alias("n"), F.min(F.struct(
            place.alias("place"), size.alias("size"), "c1", "size_pos")).alias("hub")).filter(
        F.col("n") > LIST_ROWS).withColumn(
        "parts", F.ceil(F.col("n") / LIST_ROWS).cast("long"))
    long = written(long, "long-lists")
    columns = ["shingle", "part", "size_pos", "c1", "parts"]
    cut = doubt.join(long.select("shingle", "parts"), "shingle", "left").withColumn(
        "parts", F.coalesce("parts", F.lit(1).cast("long"))).withColumn(
        "part", F.pmod(F.xxhash64("c1"), F.col("parts")))
    hubs = long.select("shingle", F.explode(F.sequence(
        F.lit(0).cast("long"), F.col("parts") - 1)).alias("part"), "hub.size_pos", "hub.c1",
        "parts")
    one = F.lit(1).cast("long")
    short = rows.filter("NOT doubt").select(
        "shingle", (one - 1).alias("part"), "size_pos", "c1", one.alias("parts"))
    return short.unionByName(cut.select(*columns)).unionByName(hubs)


def _groups(batches, keys: int):
    """Sorted batches as arrays, regrouped so that no group of rows that agree in the first
    ``keys`` columns is cut: yields (number of the row's group, columns)."""
    held = None
    for batch in batches:
        part = [np.asarray(c) for c in batch.columns]
        if held is not None:
            part = [np.concatenate([h, p]) for h, p in zip(held, part)]
        if len(part[0]) == 0:
            continue
        number = _numbers(part[:keys])
        cut = np.searchsorted(number, number[-1])  # the last group may go on
        held = [p[cut:] for p in part]
        if cut:
            yield number[:cut], [p[:cut] for p in part]
    if held is not None and len(held[0]):
        yield _numbers(held[:keys]), held


def _numbers(keys) -> np.ndarray:
    new = np.zeros(len(keys[0]), dtype=np.int64)
    for key in keys:
        new[1:] |= key[1:] != key[:-1]
    return np.cumsum(new)


def _shared(number, part):
    """The rows of groups with at least two classes, repeats of a class removed."""
    _, _, packed, c1, _ = part
    fresh = np.ones(len(number), dtype=bool)
    fresh[1:] = ((number[1:] != number[:-1]) | (packed[1:] != packed[:-1])
                 | (c1[1:] != c1[:-1]))
    number, part = number[fresh], [p[fresh] for p in part]
    same = number[1:] == number[:-1]
    keep = np.zeros(len(number), dtype=bool)
    keep[1:] |= same
    keep[:-1] |= same
    return number[keep], [p[keep] for p in part]


def may_link(n_a, p_a, n_b, p_b, t: int):
    """Length and positional filters for a pair first met at places p_a and p_b."""
    need = -(-t * (n_a + n_b) // (100 + t))
    room = 1 + np.minimum(n_a - p_a - 1, n_b - p_b - 1)
    small, large = np.minimum(n_a, n_b), np.maximum(n_a, n_b)
    return (100 * small >= t * large) & (room >= need)


def _first_candidates(t: int):
    def run(batches):
        for rows in _groups(batches, 2):
            number, (shingle, _, packed, c1, parts) = _shared(*rows)
            if len(number) == 0:
                continue
            size, pos = packed >> 32, packed & 0xFFFFFFFF
            head = np.ones(len(shingle), dtype=bool)
            head[1:] = number[1:] != number[:-1]
            # a list's hub: the class whose prefix has the fewest rarer shingles before
            # the shared one, which among copies is the one with the fewest edits
            begin = np.flatnonzero(head)
            number = np.cumsum(head) - 1
            order = np.lexsort((c1, size, pos, number))
            hub = order[begin][number]
            every = np.arange(len(shingle))
            chain = order[1:][number[order[1:]] == number[order[:-1]]]
            before = order[:-1][number[order[1:]] == number[order[:-1]]]
            one = np.concatenate([hub, before])
            two = np.concatenate([every, chain])
            ok = (c1[one] != c1[two]) & may_link(size[one], pos[one], size[two], pos[two], t)
            a, b = np.minimum(c1[one], c1[two])[ok], np.maximum(c1[one], c1[two])[ok]
            pairs = np.unique(np.stack([a, b], axis=1), axis=0)
            yield pa.RecordBatch.from_arrays(
                [pa.array(shingle), pa.array(c1), pa.array(packed), pa.array(parts)],
                names=["a", "b", "size_pos", "parts"])
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.ascontiguousarray(pairs[:, 0])),
                 pa.array(np.ascontiguousarray(pairs[:, 1])),
                 pa.array(np.zeros(len(pairs), dtype=np.int64)),
                 pa.array(np.zeros(len(pairs), dtype=np.int64))],
                names=["a", "b", "size_pos", "parts"])
    return run


def meetings(spread: DataFrame) -> DataFrame:
    """(shingle, low, high, size_pos, c1, comp, part) of lists with their components: short
    lists are one group, and of a cut list every two parts, and every part, are one.
    A cut list that is one component altogether has nothing to add."""
    cut = spread.filter("parts > 1").distinct()
    mixed = cut.groupBy("shingle").agg(
        F.min("comp").alias("least"), F.max("comp").alias("most")).filter(
        "least <> most").select("shingle")
    part, zero = F.pmod(F.xxhash64("c1"), F.col("parts")), F.lit(0).cast("long")
    every = cut.join(mixed, "shingle", "left_semi").withColumn("part", part).withColumn(
        "other", F.explode(F.sequence(zero, F.col("parts") - 1))).select(
        "shingle", F.least("part", "other").alias("low"), F.greatest("part", "other").alias("high"),
        "size_pos", "c1", "comp", "part")
    return spread.filter("parts = 1").select(
        "shingle", zero.alias("low"), zero.alias("high"), "size_pos", "c1", "comp",
        zero.alias("part")).unionByName(every)


def _other_candidates(t: int):
    """All pairs of a group that pass the filters and lie in different components (and, of
    two parts, in different parts)."""
    def run(batches):
        for number, rows in _groups(batches, 3):
            comp = rows[5]
            begin = np.flatnonzero(np.diff(number, prepend=-1))
            mixed = np.minimum.reduceat(comp, begin) != np.maximum.reduceat(comp, begin)
            keep = mixed[number - number[0]]
            if keep.any():
                yield from pairs(number[keep], [r[keep] for r in rows])

    def pairs(number, rows):
        _, low, high, packed, c1, comp, part = rows
        size, pos = packed >> 32, packed & 0xFFFFFFFF
        n = len(number)
        step = 1
        # rows are sorted by group and size: partners of a row follow it directly
        alive = np.arange(n)
        while len(alive):
            alive = alive[alive + step < n]
            other = alive + step
            near = (number[alive] == number[other]) & (
                100 * size[alive] >= t * size[other])
            alive, other = alive[near], other[near]
            ok = (comp[alive] != comp[other]) & may_link(
                size[alive], pos[alive], size[other], pos[other], t)
            ok &= (low[alive] == high[alive]) | (part[alive] != part[other])
            if ok.any():
                a, b = c1[alive[ok]], c1[other[ok]]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], names=["a", "b"])
            step += 1
    return run


def _class_counts(shingles: np.ndarray) -> np.ndarray:
    """Shingles per hash class; a set too large to count in 16 bits rules nothing out."""
    top = np.uint64(64 - SUFFIX_CLASSES.bit_length() + 1)
    counts = np.bincount((shingles >> top).astype(np.int64), minlength=SUFFIX_CLASSES)
    return (counts if counts.max() < 2 ** 15 else np.full(SUFFIX_CLASSES, 2 ** 15 - 1)).astype(
        np.int16)


def class_sets(docs: DataFrame, wanted: DataFrame, k: int) -> DataFrame:
    """(rep, c1, n, classes, shingles) of the documents with the wanted ids (rep), and of a
    few others: a scan that passes over other texts, so that no text is shuffled.
    ``classes`` counts the shingles by hash class, for the suffix filter."""
    def scan(batches):
        for ids, sets in _sets(batches, k):
            yield pa.RecordBatch.from_arrays(
                [ids, pa.array([set_names(s)[0] for s in sets], pa.int64()),
                 pa.array([len(s) for s in sets], pa.int64()),
                 pa.array([_class_counts(s) for s in sets], pa.list_(pa.int16())),
                 pa.array([s.view(np.int64) for s in sets], pa.list_(pa.int64()))],
                names=["rep", "c1", "n", "classes", "shingles"])
    chosen = may_hold(docs.dropna(subset=["doc_id"]), F.xxhash64("doc_id"),
                      wanted.select(F.xxhash64("rep").alias("h")))
    return chosen.mapInArrow(
        scan, "rep long, c1 long, n long, classes array<smallint>, shingles array<long>")


def verified(docs: DataFrame, classes: DataFrame, pairs: DataFrame, k: int, t: int) -> DataFrame:
    """(a, b), written: representatives of the candidate pairs (of handles a, b) whose
    whole sets are similar.  The suffix filter sees counts only; the sets of the pairs
    that it leaves are then compared, once a pair."""
    named = classes.select("c1", "rep")
    ends = written(
        pairs.join(named.toDF("a", "x"), "a").join(named.toDF("b", "y"), "b")
        .filter("x <> y").select("a", "x", "b", "y"), "candidates")
    wanted = ends.select(F.explode(F.array("x", "y")).alias("rep")).distinct()
    sets = written(class_sets(docs, wanted, k), "class-sets")
    counts = sets.select("rep", "c1", "n", "classes")
    bound = F.aggregate(F.zip_with("cx", "cy", lambda x, y: F.least(x, y)),
                        F.lit(0).cast("long"), lambda a, x: a + x.cast("long"))
    close = written(
        ends.join(counts.toDF("x", "a", "nx", "cx"), ["x", "a"])
        .join(counts.toDF("y", "b", "ny", "cy"), ["y", "b"])
        .filter(bound * (100 + t) >= t * (F.col("nx") + F.col("ny")))
        .select("a", "x", "b", "y").distinct(), "close")
    # only sets of pairs that the suffix filter leaves are shuffled
    left = close.select(F.explode(F.array("x", "y")).alias("rep")).select(F.xxhash64("rep"))
    full = may_hold(sets.select("rep", "c1", "n", "shingles"), F.xxhash64("rep"), left)
    both = F.size(F.array_intersect("sx", "sy"))
    links = written(
        close.join(full.toDF("x", "a", "nx", "sx"), ["x", "a"])
        .join(full.toDF("y", "b", "ny", "sy"), ["y", "b"])
        .filter(100 * both >= t * (F.col("nx") + F.col("ny") - both))
        .select(F.col("x").alias("a"), F.col("y").alias("b")), "links")
    discard(ends, sets, close)
    return links


def _overlaps(x: list, y: list) -> np.ndarray:
    """Number of shared shingles of every set of x with every set of y."""
    flat, rows = [], []
    for sets in (x, y):
        flat.append(np.concatenate(sets))
        rows.append(np.repeat(np.arange(len(sets)), [len(s) for s in sets]))
    shared = np.intersect1d(flat[0], flat[1])
    out = np.zeros((len(x), len(y)), dtype=np.int64)
    if len(shared) == 0:
        return out
    for i in (0, 1):
        code = np.minimum(np.searchsorted(shared, flat[i]), len(shared) - 1)
        held = np.flatnonzero(shared[code] == flat[i])
        held = held[np.argsort(code[held], kind="stable")]
        flat[i], rows[i] = code[held], rows[i][held]
    for at in range(0, len(shared), COLUMNS):
        dense = []
        for sets, code, row in zip((x, y), flat, rows):
            lo, hi = np.searchsorted(code, (at, at + COLUMNS))
            part = np.zeros((len(sets), min(COLUMNS, len(shared) - at)), dtype=np.float32)
            part[row[lo:hi], code[lo:hi] - at] = 1
            dense.append(part)
        out += (dense[0] @ dense[1].T).astype(np.int64)
    return out


def _linked_weights(t: int):
    """(c1, c2, n_links) of the classes of a block (its links inside), or of two blocks
    (the links between them)."""
    def run(batches):
        for batch in batches:
            for row in range(batch.num_rows):
                blocks = []
                for column in batch.columns:
                    held = column[row].values
                    blocks.append([np.asarray(held.field(c)) for c in ("c1", "c2", "weight")]
                                  + [[np.asarray(s.values) for s in held.field("shingles")]])
                x, y = blocks[0], blocks[-1]
                both = _overlaps(x[3], y[3])
                size = [np.array([len(s) for s in b[3]]) for b in (x, y)]
                link = 100 * both >= t * (size[0][:, None] + size[1][None, :] - both)
                if len(blocks) == 1:
                    np.fill_diagonal(link, False)
                    sums = [(x, link @ x[2])]
                else:
                    sums = [(x, link @ y[2]), (y, x[2] @ link)]
                for (c1, c2, _, _), n in sums:
                    some = n > 0
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(c1[some]), pa.array(c2[some]), pa.array(n[some], pa.int64())],
                        names=["c1", "c2", "n_links"])
    return run


def link_counts(docs: DataFrame, classes: DataFrame, labels: DataFrame, k: int,
                t: int) -> DataFrame:
    """(c1, c2, n_links): the weights of all classes linked with a class, summed.  Every two
    classes of a component that may link by size are compared once; a component of any
    size is cut into blocks, so no task holds more than two of them."""
    members = classes.join(labels.withColumnRenamed("id", "rep"), "rep").withColumn(
        "cost", F.greatest("n", F.lit(BLOCK_SHINGLES // BLOCK_CLASSES)))
    members = running_totals(members, ["component"], ["n", "c1", "c2"], "cost", "before").select(
        "rep", "c1", "c2", "n", "weight", "component",
        F.floor(F.col("before") / BLOCK_SHINGLES).alias("block"))

    def scan(batches):
        for ids, sets in _sets(batches, k):
            names = [set_names(s) for s in sets]
            yield pa.RecordBatch.from_arrays(
                [ids, pa.array([x[0] for x in names], pa.int64()),
                 pa.array([x[1] for x in names], pa.int64()),
                 pa.array([s.view(np.int64) for s in sets], pa.list_(pa.int64()))],
                names=["rep", "c1", "c2", "shingles"])
    chosen = may_hold(docs.dropna(subset=["doc_id"]), F.xxhash64("doc_id"),
                      members.select(F.xxhash64("rep").alias("h")))
    key = ["rep", "c1", "c2"]
    sets = chosen.mapInArrow(scan, "rep long, c1 long, c2 long, shingles array<long>")
    blocks = written(sets.join(members, key).dropDuplicates(key).groupBy("component", "block").agg(
        F.min("n").alias("low"), F.max("n").alias("top"), F.collect_list(
            F.struct("c1", "c2", "weight", "shingles")).alias("members")), "blocks")
    out = "c1 long, c2 long, n_links long"
    inside = blocks.filter(F.size("members") > 1).select("members").mapInArrow(
        _linked_weights(t), out)
    ends = blocks.select("component", "block", "low", "top")
    pairs = ends.select("component", F.col("block").alias("i"), F.col("top").alias("near")).join(
        ends.withColumnRenamed("block", "j"), "component").filter(
        f"i < j AND 100 * near >= {t} * low").select("component", "i", "j")
    one = blocks.select("component", F.col("block").alias("i"), F.col("members").alias("x"))
    two = blocks.select("component", F.col("block").alias("j"), F.col("members").alias("y"))
    across = pairs.join(one, ["component", "i"]).join(two, ["component", "j"]).select(
        "x", "y").mapInArrow(_linked_weights(t), out)
    counts = written(inside.unionByName(across).groupBy("c1", "c2").agg(
        F.sum("n_links").alias("n_links")), "link-counts")
    discard(blocks)
    return counts


def _labelled(texts: DataFrame, k: int, t: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(documents' sets, classes, components of the classes' representatives)."""
    spark = texts.sparkSession
    named, counts = document_sets(texts, k)
    table = spark.sparkContext.broadcast(rarity(counts))
    classes = written(named.filter("n > 0").dropna(subset=["doc_id"]).groupBy("c1", "c2").agg(
        F.min("doc_id").alias("rep"), F.max("n").alias("n"),
        F.countDistinct("doc_id").alias("weight")), "classes")

    rows = written(prefix_rows(texts, k, t, table), "prefix")
    sorted_rows = cut_lists(rows).repartition("shingle", "part").sortWithinPartitions(
        "shingle", "part", "size_pos", "c1")
    found = written(sorted_rows.mapInArrow(
        _first_candidates(t), "a long, b long, size_pos long, parts long"), "lists")
    discard(rows)
    lists = found.filter("parts > 0").select(F.col("a").alias("shingle"), F.col("b").alias("c1"),
                                             "size_pos", "parts")
    first = found.filter("parts = 0").select("a", "b").distinct()
    labels = components(verified(texts, classes, first, k, t))

    # a handle (c1) stands for its representative
    joined = classes.join(labels.withColumnRenamed("id", "rep"), "rep", "left").groupBy("c1").agg(
        F.min(F.coalesce("component", "rep")).alias("comp"))
    spread = lists.join(joined, "c1").select("shingle", "size_pos", "c1", "comp", "parts")
    group = ["shingle", "low", "high"]
    rest = written(meetings(spread).repartition(*group).sortWithinPartitions(
        *group, "size_pos", "c1").mapInArrow(_other_candidates(t), "a long, b long").distinct(),
        "rest")
    if rest.take(1):
        labels = components(labels.select(F.col("id").alias("a"), F.col("component").alias("b"))
                            .unionByName(verified(texts, classes, rest, k, t)))
    discard(found, rest)
    return named, classes, labels


def _placed(named: DataFrame, classes: DataFrame, labels: DataFrame) -> DataFrame:
    """Every document with its class, its component and ``weight`` (ids in the class)."""
    placed = classes.join(labels.withColumnRenamed("id", "rep"), "rep", "left").select(
        F.col("c1").alias("k1"), F.col("c2").alias("k2"), F.col("rep").alias("class_id"),
        F.coalesce("component", "rep").alias("component_id"), "weight")
    return named.join(placed, (named.c1 == placed.k1) & (named.c2 == placed.k2)
                      & (named.n > 0), "left").select(
        "doc_id", F.col("n").alias("n_shingles"),
        F.coalesce("class_id", "doc_id").alias("class_id"),
        F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id"))
        .alias("component_id"), "weight", "k1", "k2")


def near_documents(docs: DataFrame, k: int = 5, t: int = 80, id_col: str = "doc_id",
                   text_col: str = "text") -> DataFrame:
    """(doc_id, n_shingles, class_id, component_id, n_links) of every document.

    ``class_id`` is the smallest id with the same shingle set, ``component_id`` the
    smallest id reachable by links; two sets link when their Jaccard similarity is at
    least ``t`` percent.  ``n_links`` counts all links of a document: the other pairs of
    id and shingle set whose set is equal or links with its own (0 for a null id).
    """
    texts = documents(docs, id_col, text_col)
    named, classes, labels = _labelled(texts, k, t)
    counts = link_counts(texts, classes, labels, k, t).toDF("k1", "k2", "others")
    return _placed(named, classes, labels).join(counts, ["k1", "k2"], "left").select(
        "doc_id", "n_shingles", "class_id", "component_id",
        F.when(F.col("doc_id").isNull() | F.col("weight").isNull(), 0).otherwise(
            F.col("weight") - 1 + F.coalesce("others", F.lit(0))).cast("long").alias("n_links"))


def one_per_group(docs: DataFrame, k: int = 5, t: int = 80) -> DataFrame:
    """The documents (all columns) that are the smallest id of their component; of rows
    that share that id and have words one stays.  Documents without words or id all stay."""
    near = _placed(*_labelled(documents(docs), k, t))
    key = F.xxhash64(F.col("doc_id").cast("long"))
    lost = near.filter("doc_id <> component_id").select(F.xxhash64("doc_id").alias("key"))
    again = written(near.filter("n_shingles > 0 AND doc_id = component_id").groupBy("doc_id").agg(
        F.count(F.lit(1)).alias("rows")).filter("rows > 1").select(
        F.xxhash64("doc_id").alias("key")), "repeated")
    kept = without(docs, key, lost)
    if not again.take(1):
        return kept
    name = "__helio_same"
    repeated = may_hold(kept, key, again).withColumn(name, key).join(
        again.toDF("__helio_again"), F.col(name) == F.col("__helio_again"), "left_semi")
    return without(kept, key, again).unionByName(
        repeated.dropDuplicates([name]).select(*docs.columns))
