"""Token ids in bit-plane files.

Documents are range-partitioned by id, so each task holds a run of documents in
ascending order, the runs ascend with the partition number, and no id is ever
shuffled.  The task encodes its texts, appends the end id, cuts the stream of ids
into blocks of ``block_ids``, transposes each block into byte or bit planes (plane j
holds byte or bit j of every id) and compresses each plane with zstandard.

File format: a Parquet folder written by Spark's committer, one row per block:

====================  ============================================================
part, block           partition number, block number within it
first, n_ids          ids of the part before this block, ids in the block
kind                  'byte' or 'bit'
planes                zstandard frames, lowest byte or bit first; planes that would
                      be all zero are left out
crc                   crc32 of the block's ids as little-endian unsigned 32-bit
doc_id, doc_no        chunk index: documents with ids in the block, and their
doc_at, doc_len       number within the part; where their ids begin in the block,
                      how many there are
doc_open              true if the document goes on in the next block, or began
                      before this one
====================  ============================================================

Blocks can be read in any order and on any task.  Defined results: null and empty
texts are the end id alone; a very long text spans blocks; null document ids come first; rows that share an id
follow one another, ordered by text; an empty table gives an empty file and an empty
index; other columns are not read.
"""

from __future__ import annotations

import sys
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext, cloudpickle
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from helio.llm.stages import documents, small_batches
from helio.llm.textscan import (MAX_BYTES, byte_values, give_back, mix64, text_slices,
                                utf8_buffer)

cloudpickle.register_pickle_by_value(sys.modules[__name__])

BLOCK_IDS = 65536
CACHE_ENTRIES = 600_000
BLOCK_SCHEMA = ("part int, block int, first long, n_ids int, kind string, planes array<binary>, "
                "crc long, doc_id array<long>, doc_no array<long>, doc_at array<int>, "
                "doc_len array<int>, doc_open array<boolean>")
_BASE = 0x5851F42D4C957F2D
_MARKS = frozenset(b"!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~")
_LETTERS = frozenset(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz")
_LEADS = (b"\xe1", b"\xe2", b"\xe3")


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first ``n`` powers of the hashes' base and of its inverse modulo 2**64: terms that
    are weighed by their place in the slice become sums from a chunk's own start."""
    out = []
    for base in (_BASE, pow(_BASE, -1, 1 << 64)):
        powers = np.full(n, base, dtype=np.uint64)
        powers[:1] = 1
        out.append(np.multiply.accumulate(powers, out=powers))
    return out[0], out[1]


def _runs(ids: np.ndarray, start: np.ndarray, size: np.ndarray, total: np.ndarray) -> np.ndarray:
    """The runs ``ids[start:start + size]`` one after another; ``total``: running sum of sizes."""
    where = np.repeat(start - (total - size), size)
    where += np.arange(len(where))
    return ids[where]


def chunk_starts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Byte positions where a text can be cut without changing its byte-level BPE ids:
    text starts; single spaces and newlines between two bytes that cannot belong to white
    space; and ASCII marks, but for apostrophes, right after an ASCII letter (the
    pre-tokenizer always begins a new piece in these places)."""
    begins = np.zeros(len(data) + 1, dtype=bool)
    if len(data) > 3:
        plain = (data > 0x20) & (data != 0x7F)
        # Unicode spaces begin with these bytes: a cut keeps clear of such characters.
        lead = (data == 0xC2) | (data == 0xE1) | (data == 0xE2) | (data == 0xE3)
        behind = plain.copy()
        behind[1:] &= ~lead[:-1]
        behind[2:] &= ~lead[:-2]
        gap = (data[1:-1] == 0x20) | (data[1:-1] == 0x0A)
        begins[1:-2] = gap & behind[:-2] & (plain & ~lead)[2:]
        letter = ((data | 0x20) - np.uint8(0x61)) < 26  # wraps around below the letters
        mark = plain & (data < 0x7F) & ~letter & ((data - np.uint8(0x30)) > 9) & (data != 0x27)
        begins[1:-1] |= letter[:-1] & mark[1:]
    begins[offsets[:-1]] = True
    return np.flatnonzero(begins[:-1]) if len(data) else np.zeros(0, dtype=np.int64)


def _put(array: np.ndarray, used: int, more: np.ndarray) -> np.ndarray:
    """``array`` with ``more`` behind its first ``used`` values, in a larger array if need be."""
    if used + len(more) > len(array):
        array = np.concatenate([array[:used], np.zeros(max(used, len(more)), array.dtype)])
    array[used:used + len(more)] = more
    return array


class Encoder:
    """Encodes many texts at once: distinct chunks (see ``chunk_starts``) are encoded
    once by the tokenizers library and kept, up to ``CACHE_ENTRIES``.  When these are
    full, the chunks met in several slices stay and the others go.

    Chunks are looked up by hash and compared with the kept bytes.  Entry 0 is the end id."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer
        self.tokenizer = Tokenizer.from_file(path)
        vocab = self.tokenizer.get_vocab(with_added_tokens=True)
        self.n_bytes = np.zeros(max(vocab.values()) + 1, dtype=np.int64)
        for token, i in vocab.items():
            self.n_bytes[i] = len(token)  # one character per byte in a byte-level vocabulary
        self.special = [t.content.encode() for t in
                        self.tokenizer.get_added_tokens_decoder().values()]
        self.powers = _powers(MAX_BYTES)
        self.clear()

    def clear(self) -> None:
        self.hash = np.zeros(0, dtype=np.uint64)  # sorted, with the entry of each
        self.entry = np.zeros(0, dtype=np.int32)
        self.n, self.n_ids, self.n_text = 1, 1, 0
        self.ids = np.zeros(1, dtype=np.uint32)
        self.text = np.zeros(0, dtype=np.uint8)
        self.start = np.zeros(1, dtype=np.int64)     # of its ids, and their number
        self.size = np.ones(1, dtype=np.int32)
        self.text_at = np.zeros(1, dtype=np.int64)   # of its bytes, and their number
        self.length = np.zeros(1, dtype=np.int32)
        self.met = np.zeros(1, dtype=np.int32)       # slices that held it

    def keep_frequent(self) -> None:
        """Drop the chunks met in one slice only, and more until half the entries are free;
        earlier meetings count half from here on."""
        met = self.met[self.entry]
        most = CACHE_ENTRIES // 2
        least = max(2, int(np.partition(met, -most)[-most]) + 1) if len(met) > most else 2
        stay = met >= least
        hashes, old, text, ids = self.hash[stay], self.entry[stay], self.text, self.ids
        start, size, at, length = (x[old] for x in (self.start, self.size, self.text_at, self.length))
        ids = _runs(ids, start, size, np.cumsum(size))
        text = _runs(text, at, length, np.cumsum(length))
        self.clear()
        self._add(hashes, text, length, ids, np.cumsum(size) - size, size, met[stay] // 2)

    def _add(self, hashes, text, length, ids, start, size, met) -> None:
        """New entries: their bytes and ids, and where the ids of each begin among ``ids``."""
        entries = np.arange(self.n, self.n + len(hashes), dtype=np.int32)
        order = np.argsort(hashes)
        at = np.searchsorted(self.hash, hashes[order])
        self.hash = np.insert(self.hash, at, hashes[order])
        self.entry = np.insert(self.entry, at, entries[order])
        self.start = _put(self.start, self.n, self.n_ids + start)
        self.size = _put(self.size, self.n, size)
        self.text_at = _put(self.text_at, self.n, self.n_text + np.cumsum(length) - length)
        self.length = _put(self.length, self.n, length)
        self.met = _put(self.met, self.n, met)
        self.ids = _put(self.ids, self.n_ids, ids)
        self.text = _put(self.text, self.n_text, text)
        self.n, self.n_ids, self.n_text = (
            self.n + len(hashes), self.n_ids + len(ids), self.n_text + len(text))

    def learn(self, chunks: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Encode new chunks in one go and split the ids again by their byte lengths.  What
        goes before a chunk gives it the neighbour that makes its start a cut: a letter
        before a mark, a newline before a letter, nothing before a space or newline.

        Returns ids, and where those of each chunk begin and how many there are."""
        start, size = np.zeros((2, len(chunks)), dtype=np.int64)
        alone, out, used = [], [], 0

        def keep(some: list[int], joined: list[bytes]) -> None:
            nonlocal used
            ids, cut = self._encoded(joined)
            start[some], size[some] = used + cut[0::2], cut[1::2] - cut[0::2]
            out.append(ids)
            used += len(ids)

        for at in range(0, len(chunks), 4096):
            some, joined = [], []
            for i, c in enumerate(chunks[at:at + 4096], at):
                if c[-1] > 0x7F:  # maybe a Unicode space
                    end = c[-2:-1] in (b"", b"\xc2") or c[-3:-2] in _LEADS
                else:
                    end = c[-1] < 0x21
                if not end and c[:1] in (b" ", b"\n") and c[1:2] > b" ":
                    joined += (b"", c)
                elif not end and c[0] in _MARKS:
                    joined += (b" a", c)
                elif not end and c[0] in _LETTERS:
                    joined += (b" a\n", c)
                else:
                    alone.append(i)
                    continue
                some.append(i)
            if some:
                keep(some, joined)
        for i in alone:
            keep([i], [b"", chunks[i]])
        return np.concatenate(out), start, size

    def _encoded(self, joined: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of the joined pieces, and how many there are up to the end of each."""
        ids = np.asarray(self.tokenizer.encode_batch_fast(
            [b"".join(joined).decode("utf-8")], add_special_tokens=False)[0].ids,
            dtype=np.uint32)
        ends = np.cumsum(np.fromiter(map(len, joined), dtype=np.int64, count=len(joined)))
        upto = np.concatenate(([0], np.cumsum(self.n_bytes[ids])))
        cut = np.searchsorted(upto, ends, side="left")
        if not np.array_equal(upto[cut], ends):
            raise ValueError("the vocabulary is not byte-level: ids do not cover the text")
        return ids, cut

    def _entries(self, hashes: np.ndarray, data: np.ndarray, starts: np.ndarray,
                 sizes: np.ndarray) -> np.ndarray:
        """The entries of distinct chunks of a slice; new ones are learnt."""
        def look() -> np.ndarray:
            if not len(self.hash):
                return np.zeros(len(hashes), dtype=np.int32)
            place = np.minimum(np.searchsorted(self.hash, hashes), len(self.hash) - 1)
            return np.where(self.hash[place] == hashes, self.entry[place], 0)

        at = look()
        old = np.flatnonzero(at)
        kept, length = at[old], sizes[old]
        total = np.cumsum(length)
        if not (np.array_equal(self.length[kept], length) and np.array_equal(
                _runs(self.text, self.text_at[kept], length, total),
                _runs(data, starts[old], length, total))):
            self.clear()  # two chunks share a hash: the kept one makes room
            at = look()
        if self.n + np.count_nonzero(at == 0) > CACHE_ENTRIES:
            self.keep_frequent()
            at = look()
            if self.n + np.count_nonzero(at == 0) > CACHE_ENTRIES:
                self.clear()  # one slice may have more than the cache
                at = look()
        new = np.flatnonzero(at == 0)
        if len(new):
            begin, length = starts[new], sizes[new]
            total = np.cumsum(length)
            text = _runs(data, begin, length, total)
            raw = text.tobytes()
            ids, start, size = self.learn(
                [raw[e - n:e] for e, n in zip(total.tolist(), length.tolist())])
            at[new] = np.arange(self.n, self.n + len(new))
            self._add(hashes[new], text, length, ids, start, size, np.zeros(len(new), np.int32))
        self.met[at] += 1
        return at

    def encode(self, texts: pa.Array, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """(ids, counts): the texts' ids one after another, each text's with ``end_id``."""
        data, offsets = utf8_buffer(texts)
        if len(data) == 0:
            return np.full(len(texts), end_id, np.uint32), np.ones(len(texts), np.int64)
        starts = chunk_starts(data, offsets)
        raw = data.tobytes()
        for mark in self.special:  # a text that holds one is encoded in one piece
            at = raw.find(mark)
            while at >= 0:
                text = int(np.searchsorted(offsets, at, side="right")) - 1
                inside = (starts > offsets[text]) & (starts < offsets[text + 1])
                starts = starts[~inside]
                at = raw.find(mark, int(offsets[text + 1]))
        del raw
        sizes = np.diff(np.append(starts, len(data)))
        power, inverse = _powers(len(data)) if len(data) > MAX_BYTES else self.powers
        terms = byte_values()[data]
        terms *= power[:len(data)]
        sums = np.add.reduceat(terms, starts) * inverse[starts]
        del terms, power, inverse
        hashes = mix64(sums ^ sizes.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        found = pa.array(hashes).dictionary_encode()
        code, distinct = found.indices.to_numpy(), found.dictionary.to_numpy()
        sample = np.zeros(len(distinct), dtype=np.int64)
        sample[code] = np.arange(len(code))  # one of the chunks that share a hash
        at = self._entries(distinct, data, starts[sample], sizes[sample])
        first_of_text = np.searchsorted(starts, offsets[1:])
        each = np.insert(at[code], first_of_text, 0)
        self.ids[0] = end_id
        lens = self.size[each]
        total = np.cumsum(lens)
        ids = _runs(self.ids, self.start[each], lens, total)
        ends = total[first_of_text + np.arange(len(texts))]
        return ids, np.diff(ends, prepend=0)


def loaded_encoder(path: str) -> Encoder:
    """The worker's encoder: kept between the tasks of one Python worker."""
    import tokenizers
    kept = tokenizers.__dict__.setdefault("_encoders_by_path", {})
    if path not in kept:
        kept[path] = Encoder(path)
    return kept[path]


def to_planes(ids: np.ndarray, kind: str) -> list[bytes]:
    """Compressed planes of a block, lowest first, without all-zero planes at the top."""
    import zstandard
    raw = np.ascontiguousarray(ids.astype("<u4")).view(np.uint8).reshape(-1, 4)
    if kind == "bit":
        planes = np.packbits(np.unpackbits(raw, axis=1, bitorder="little").T, axis=1)
    else:
        planes = np.ascontiguousarray(raw.T)
    used = np.flatnonzero(planes.any(axis=1))
    pack = zstandard.ZstdCompressor(level=1).compress
    return [pack(p.tobytes()) for p in planes[:used[-1] + 1 if len(used) else 0]]


def from_planes(planes: list[bytes], n: int, kind: str) -> np.ndarray:
    import zstandard
    unpack = zstandard.ZstdDecompressor().decompress
    got = [np.frombuffer(unpack(p), dtype=np.uint8) for p in planes]
    if kind == "bit":
        bits = np.zeros((32, n), dtype=np.uint8)
        for j, p in enumerate(got):
            bits[j] = np.unpackbits(p, count=n)
        raw = np.packbits(np.ascontiguousarray(bits.T), axis=1, bitorder="little")
    else:
        raw = np.zeros((n, 4), dtype=np.uint8)
        for j, p in enumerate(got):
            raw[:, j] = p
    return np.ascontiguousarray(raw).view("<u4").reshape(-1)


def _block_writer(path: str, end_id: int, block_ids: int, kind: str):
    def write(batches):
        encoder, part = loaded_encoder(path), TaskContext.get().partitionId()
        held: list[np.ndarray] = []     # ids not yet in a block
        spans: list[tuple] = []         # (doc_id, doc_no, ids left, begun before)
        state = {"n": 0, "block": 0, "first": 0, "no": 0}

        def block(n: int):
            ids = np.concatenate(held) if len(held) != 1 else held[0]
            mine, rest = ids[:n], ids[n:]
            held[:] = [rest] if len(rest) else []
            doc_id, doc_no, doc_at, doc_len, doc_open = [], [], [], [], []
            at = done = 0
            for name, no, left, begun in spans:
                take = min(left, n - at)
                if take == 0:
                    break
                doc_id.append(name)
                doc_no.append(no)
                doc_at.append(at)
                doc_len.append(take)
                doc_open.append(begun or take < left)
                at += take
                if take < left:
                    spans[done] = (name, no, left - take, True)
                    break
                done += 1
            del spans[:done]
            row = (part, state["block"], state["first"], n, kind, to_planes(mine, kind),
                   zlib.crc32(mine.astype("<u4").tobytes()), doc_id, doc_no, doc_at, doc_len,
                   doc_open)
            state["n"] -= n
            state["block"] += 1
            state["first"] += n
            return row

        for batch in batches:
            for piece in text_slices(batch, "text", MAX_BYTES):
                names = piece.column(0).to_pylist()
                ids, counts = encoder.encode(piece.column(1), end_id)
                held.append(ids)
                state["n"] += len(ids)
                for name, n in zip(names, counts.tolist()):
                    spans.append((name, state["no"], n, False))
                    state["no"] += 1
                while state["n"] >= block_ids:
                    yield _rows([block(block_ids)])
        if state["n"]:
            yield _rows([block(state["n"])])
    return write


_TYPES = pa.schema([
    ("part", pa.int32()), ("block", pa.int32()), ("first", pa.int64()), ("n_ids", pa.int32()),
    ("kind", pa.string()), ("planes", pa.list_(pa.binary())), ("crc", pa.int64()),
    ("doc_id", pa.list_(pa.int64())), ("doc_no", pa.list_(pa.int64())),
    ("doc_at", pa.list_(pa.int32())), ("doc_len", pa.list_(pa.int32())),
    ("doc_open", pa.list_(pa.bool_()))])


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(c, type=f.type) for c, f in zip(zip(*rows), _TYPES)], schema=_TYPES)


def write_planes(docs: DataFrame, out: str, tokenizer: str, end_id: int = 0,
                 block_ids: int = BLOCK_IDS, kind: str = "byte", id_col: str = "doc_id",
                 text_col: str = "text") -> str:
    """Encode every whole text and write the blocks to the folder ``out``.

    ``tokenizer`` is the path of a byte-level BPE file on the executors.
    """
    ordered = documents(docs, id_col, text_col)
    ordered = ordered.repartitionByRange("doc_id", F.xxhash64("text")).sortWithinPartitions(
        "doc_id", "text")
    blocks = ordered.mapInArrow(_block_writer(tokenizer, end_id, block_ids, kind), BLOCK_SCHEMA)
    with small_batches(docs.sparkSession):
        blocks.write.mode("overwrite").option("compression", "none").parquet(out)
    return out


def _blocks(batches):
    """The rows of the blocks' batches as dicts, one at a time: a batch may hold thousands."""
    for batch in batches:
        for i in range(batch.num_rows):
            yield batch.slice(i, 1).to_pylist()[0]
        give_back()


def read_ids(spark: SparkSession, path: str) -> DataFrame:
    """(part, block, ids): the ids of every block, checked against its crc."""
    def decode(batches):
        for r in _blocks(batches):
            got = from_planes(r["planes"], r["n_ids"], r["kind"])
            if zlib.crc32(got.tobytes()) != r["crc"]:
                raise ValueError(f"block {r['part']}/{r['block']} is damaged")
            yield pa.RecordBatch.from_arrays(
                [pa.array([r["part"]], pa.int32()), pa.array([r["block"]], pa.int32()),
                 pa.array([got.astype(np.int64)], type=pa.list_(pa.int64()))],
                names=["part", "block", "ids"])
    return (spark.read.schema(BLOCK_SCHEMA).parquet(path)
            .select("part", "block", "n_ids", "kind", "planes", "crc")
            .mapInArrow(decode, "part int, block int, ids array<long>"))


def crc_join(first: int, second: int, n_second: int) -> int:
    """crc32 of A + B from crc32(A), crc32(B) and the length of B in bytes.

    Appending n zero bytes multiplies the register by x**(8n) modulo the CRC's
    polynomial; powers are taken by squaring."""
    poly = 0xEDB88320

    def times(a: int, b: int) -> int:  # bit 31 is the coefficient of x**0
        out = 0
        while a:
            if a & 0x80000000:
                out ^= b
            a = (a << 1) & 0xFFFFFFFF
            b = (b >> 1) ^ (poly if b & 1 else 0)
        return out

    shift, square, n = 0x80000000, 0x00800000, n_second  # x**0 and x**8
    while n:
        if n & 1:
            shift = times(shift, square)
        square = times(square, square)
        n >>= 1
    return times(first, shift) ^ second


def read_index(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, from the files alone.

    Blocks are decoded where they lie; only documents that span blocks are put
    together, from one (length, crc) row per block they touch.
    """
    def decode(batches):
        types = (pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(),
                 pa.bool_())
        for r in _blocks(batches):
            raw = from_planes(r["planes"], r["n_ids"], r["kind"]).tobytes()
            if zlib.crc32(raw) != r["crc"]:
                raise ValueError(f"block {r['part']}/{r['block']} is damaged")
            view = memoryview(raw)
            cols: list[list] = [[] for _ in range(7)]
            for doc_id, no, at, n, is_open in zip(
                    r["doc_id"], r["doc_no"], r["doc_at"], r["doc_len"], r["doc_open"]):
                values = (r["part"], no, doc_id, r["first"] + at, n,
                          zlib.crc32(view[4 * at:4 * (at + n)]), is_open)
                for c, v in zip(cols, values):
                    c.append(v)
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, type=t) for c, t in zip(cols, types)],
                names=["part", "doc_no", "doc_id", "at", "n", "crc", "is_open"])

    def whole(batches):
        now = None
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                if now and (now["part"], now["doc_no"]) == (r["part"], r["doc_no"]):
                    now["crc"] = crc_join(now["crc"], r["crc"], 4 * r["n"])
                    now["n"] += r["n"]
                    continue
                if now:
                    out.append(now)
                now = r
            if out:
                yield pa.RecordBatch.from_pylist(out, schema=batch.schema)
            names = batch.schema
        if now:
            yield pa.RecordBatch.from_pylist([now], schema=names)

    blocks = spark.read.schema(BLOCK_SCHEMA).parquet(path)
    schema = "part int, doc_no long, doc_id long, at long, n long, crc long, is_open boolean"
    pieces = blocks.mapInArrow(decode, schema)
    docs = pieces.filter(~F.col("is_open")).unionByName(
        pieces.filter("is_open").repartition("part", "doc_no")
        .sortWithinPartitions("part", "doc_no", "at").mapInArrow(whole, schema))
    parts = blocks.groupBy("part").agg(F.sum("n_ids").alias("ids"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = parts.select("part", F.coalesce(F.sum("ids").over(before), F.lit(0)).alias("offset"))
    return docs.join(offsets, "part").select(
        "doc_id", (F.col("offset") + F.col("at")).cast("long").alias("start"),
        F.col("n").alias("n_tokens"), F.col("crc").alias("ids_crc32"))
