"""WARC archives with a two-level capture index.

``write_archives`` writes one record per page: a *response* with the payload, or a *revisit*
that refers to the response with the same payload (the one of the largest page id).
Records are gzip members of their own in files of about ``FILE_BYTES``.  Pages are written
where they are scanned: only digests are shuffled to find equal payloads, revisits are
written without reading the payload again, and of the payloads only those that a bitmap of
fixed size cannot tell from revisits are shuffled.

``build_index`` sorts the captures by their key, the URL with its host reversed
(``com,example)/path``) followed by the page id, over range partitions.  Each partition is a
*shard*: a file of compressed blocks of ``BLOCK_LINES`` lines, followed by the shard's block
directory (the first key, offset and size of every block).  A table with one row per shard
says where it begins and where its directory is.

``lookup`` finds captures by key: the shard by binary search in the shard table, the block
by binary search in the shard's directory, the lines by binary search in the block, which
is fetched by a range read.  ``read_records`` then reads the records found by range reads;
records that lie side by side are fetched by one.

Files get a name of their own for every attempt of a task, and only the attempts whose rows
Spark commits are listed, so a lost executor or a repeated task leaves files that nothing
refers to.  Any store that pyarrow can open will do.

Defined results: null html is an empty payload; null URLs have an empty host; rows that
share page id and payload are one response and revisits of it; a null page id counts as
smaller than any other; a payload of any size is one record, held in memory once; an empty
table gives no files and an empty result; other columns are not read.
"""

from __future__ import annotations

import base64
import bisect
import hashlib
import json
import re
import sys
import uuid
import zlib

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from helio.llm.stages import may_hold, without, written
from helio.session import scratch_path

cloudpickle.register_pickle_by_value(sys.modules[__name__])

FILE_BYTES, BLOCK_LINES = 64 << 20, 1024
#: Records closer than this are read at once, up to this many bytes.
GAP, READ = 64 << 10, 4 << 20
_BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_ENTRY = ("key string, page_id long, file string, offset long, size long, digest string, "
          "record_type string")
_NAMES = [c.split()[0] for c in _ENTRY.split(", ")]


def _entries(rows: list) -> pa.RecordBatch:
    columns = list(zip(*rows)) if rows else [[] for _ in _NAMES]
    return pa.RecordBatch.from_arrays(
        [pa.array(c, pa.int64() if n in ("page_id", "offset", "size") else pa.string())
         for c, n in zip(columns, _NAMES)], names=_NAMES)


# ---- keys and digests ---------------------------------------------------------------

def payload_digest(payload: Column) -> Column:
    """SHA-1 of a binary column in base32 without padding: 20 bits give four letters."""
    digits = "0123456789ABCDEFGHIJKLMNOPQRSTUV"
    code = F.sha1(payload)
    parts = [F.lpad(F.conv(F.substring(code, 1 + 5 * i, 5), 16, 32), 4, "0") for i in range(8)]
    return F.translate(F.concat(*parts), digits, _BASE32)


def sort_key(url: Column, page_id: Column) -> Column:
    """Reversed host, path and query, then the page id in a form that sorts as it counts."""
    after = F.regexp_extract(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.\-]*://(.*)$", 1)
    host = F.regexp_replace(F.regexp_extract(after, r"^([^/?#]*)", 1), r"^.*@|:[0-9]*$", "")
    rest = F.regexp_extract(after, r"^[^/?#]*([^#]*)", 1)
    turned = F.concat_ws(",", F.reverse(F.split(F.lower(host), r"\.")))
    number = F.when(page_id.isNull(), F.lit("-")).otherwise(
        F.lpad(F.hex(page_id.bitwiseXOR(F.lit(-(2 ** 63)))), 16, "0"))
    # blanks and control characters would end a field or a line of the index
    path = F.regexp_replace(rest, r"[\x00-\x20]", "+")
    return F.concat(F.regexp_replace(turned, r"[\x00-\x20]", "+"), F.lit(")"), path, F.lit(" "),
                    number)


# ---- equal payloads -----------------------------------------------------------------

def captures(pages: DataFrame) -> DataFrame:
    """(page_id, url, payload, key, digest, bytes) of every page; payload is binary."""
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    page_id = F.col("page_id").cast("long")
    return pages.select(
        page_id.alias("page_id"), F.col("url").cast("string").alias("url"),
        payload.alias("payload"), sort_key(F.col("url"), page_id).alias("key"),
        payload_digest(payload).alias("digest"),
        F.octet_length(payload).cast("long").alias("bytes"))


def revisits(taken: DataFrame, least: int = 0) -> tuple[DataFrame, DataFrame]:
    """(revisits, repeated) among captures, written.  Of captures with equal payloads of at
    least ``least`` bytes, all but the one of the largest page id are revisits, with that
    one's key and page id as ``refers_key`` and ``refers_to``; ``repeated`` holds the keys
    of rows that are a response and revisits at once.

    The captures are range-partitioned by digest, so copies of one payload may fill
    several partitions; a digest that spans partitions is settled by a table of the
    partitions' last rows.  No key of a join has more rows than a partition of the range.
    """
    order = ["bytes", "digest", "page_id", "key"]
    slim = written(taken.filter(F.col("bytes") >= least).select(
        "page_id", "url", "key", "digest", "bytes").withColumn(
        "_tie", F.monotonically_increasing_id()), "payloads")
    placed = written(slim.repartitionByRange(*order, "_tie").withColumn(
        "_piece", F.spark_partition_id()), "payload-ranges")
    piece = ["bytes", "digest", "_piece"]
    last = F.struct("_piece", "page_id", "key", "_tie")
    best = placed.groupBy(*piece).agg(F.max(last).alias("_best"))
    # pieces are in order, so a digest's last piece holds its largest page id
    spans = best.groupBy("bytes", "digest").agg(
        F.max("_best").alias("_top"), F.count(F.lit(1)).alias("_n")).filter("_n > 1").drop("_n")
    keepers = best.join(spans, ["bytes", "digest"], "left").select(
        *[F.col(c).alias(f"_k{c}") for c in piece], F.coalesce("_top", "_best").alias("_keeper"))
    marked = placed.join(keepers, [F.col(c).eqNullSafe(F.col(f"_k{c}")) for c in piece])
    marked = written(marked.filter(F.col("_keeper._tie") != F.col("_tie")).select(
        "page_id", "url", "key", "digest", "bytes", F.col("_keeper.page_id").alias("refers_to"),
        F.col("_keeper.key").alias("refers_key")), "revisits")
    repeated = written(marked.filter("key = refers_key").select(row_hash()).distinct(), "repeated")
    return marked, repeated


def row_hash() -> Column:
    return F.xxhash64("key", "digest", "bytes").alias("_row")


def records(pages: DataFrame, least: int = 0) -> DataFrame:
    """What to write: (key, page_id, url, payload, digest, bytes, refers_to, refers_key) of
    every page; payload is null for a revisit."""
    taken = captures(pages)
    again, repeated = revisits(taken, least)
    only = again.filter("key <> refers_key").select(row_hash())
    kept = without(taken, row_hash(), only)
    if repeated.take(1):  # rows that repeat a response: one of them is it
        doubt = may_hold(kept, row_hash(), repeated).withColumn("_same", row_hash()).join(
            repeated, F.col("_same") == F.col("_row"), "left_semi")
        kept = without(kept, row_hash(), repeated).unionByName(
            doubt.dropDuplicates(["_same"]).select(*taken.columns))
    columns = ["key", "page_id", "url", "payload", "digest", "bytes"]
    return kept.select(*columns, F.lit(None).cast("long").alias("refers_to"),
                       F.lit(None).cast("string").alias("refers_key")).unionByName(
        again.withColumn("payload", F.lit(None).cast("binary")).select(
            *columns, "refers_to", "refers_key"))


# ---- files --------------------------------------------------------------------------

def store(path: str):
    """(file system, path in it) of a path or URI."""
    from pyarrow import fs
    found = re.match(r"file:/+(.*)", path)
    if found:
        return fs.LocalFileSystem(), "/" + found.group(1)
    if "://" in path:
        return fs.FileSystem.from_uri(path)
    return fs.LocalFileSystem(), path


def record_id(key: str, digest: str) -> str:
    """The record's URI, which depends on its capture alone."""
    name = uuid.uuid5(uuid.NAMESPACE_URL, f"{key} {digest}")
    return f"<urn:uuid:{name}>"


def record(row: dict, date: str) -> bytes:
    """One WARC record.  A line break in a URL is written in its percent form."""
    revisit = row["payload"] is None
    page_id, refers = row["page_id"], row["refers_to"]
    url = re.sub(r"[\x00-\x20\x7f]", lambda m: "%%%02X" % ord(m.group()), row["url"] or "")
    http = ("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
            f"Content-Length: {row['bytes']}\r\n\r\n").encode()
    block = http + (row["payload"] or b"")
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}",
            f"WARC-Record-ID: {record_id(row['key'], row['digest'])}", f"WARC-Date: {date}",
            f"WARC-Target-URI: {url}", f"WARC-Payload-Digest: sha1:{row['digest']}",
            f"X-Page-Id: {'' if page_id is None else page_id}",
            "Content-Type: application/http; msgtype=response"]
    if revisit:
        head += [f"WARC-Profile: {_PROFILE}",
                 f"WARC-Refers-To: {record_id(row['refers_key'], row['digest'])}",
                 f"X-Refers-To-Page-Id: {'' if refers is None else refers}"]
    head.append(f"Content-Length: {len(block)}")
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def packed(data: bytes) -> bytes:
    """One gzip member."""
    c = zlib.compressobj(6, zlib.DEFLATED, 31)
    return c.compress(data) + c.flush()


def parsed(data: bytes) -> dict:
    """The fields of an uncompressed record: warc and http headers, payload."""
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    warc = dict(x.split(": ", 1) if ": " in x else (x.rstrip(":"), "") for x in lines[1:])
    block = rest[:int(warc["Content-Length"])]
    if rest[len(block):] != b"\r\n\r\n":
        raise ValueError("a WARC record is cut off")
    http, _, payload = block.partition(b"\r\n\r\n")
    return {"warc": warc, "payload": payload,
            "http": dict(x.split(": ", 1) for x in http.decode().split("\r\n")[1:])}


def write_archives(pages: DataFrame, folder: str, least: int = 0,
                   date: str = "2020-01-01T00:00:00Z") -> DataFrame:
    """Write the pages' records below ``folder``; the written table of captures (``_ENTRY``)."""
    top = folder

    def run(batches):
        fs, base = store(top)
        out, name, at = None, None, 0
        for batch in batches:
            done = []
            for i in range(batch.num_rows):
                row = {n: batch.column(j)[i].as_py() for j, n in enumerate(batch.schema.names)}
                if out is None or at >= FILE_BYTES:
                    if out is not None:
                        out.close()
                    name, at = f"part-{uuid.uuid4().hex}.warc.gz", 0
                    fs.create_dir(base, recursive=True)
                    out = fs.open_output_stream(f"{base}/{name}", compression=None)
                    at += out.write(packed(
                        b"WARC/1.1\r\nWARC-Type: warcinfo\r\nWARC-Record-ID: "
                        + record_id(name, "").encode() + b"\r\nWARC-Date: " + date.encode()
                        + b"\r\nContent-Type: application/warc-fields\r\nContent-Length: 0"
                        + b"\r\n\r\n\r\n\r\n"))
                data = packed(record(row, date))
                kind = "revisit" if row["payload"] is None else "response"
                out.write(data)
                done.append((row["key"], row["page_id"], name, at, len(data), row["digest"], kind))
                at += len(data)
            yield _entries(done)
        if out is not None:
            out.close()
    return written(records(pages, least).mapInArrow(run, _ENTRY), "captures")


# ---- the two-level index ------------------------------------------------------------

def build_index(entries: DataFrame, folder: str) -> DataFrame:
    """Write the shards below ``folder``; the written shard table (first, file, at, size,
    captures): ``at`` and ``size`` say where the shard's block directory is."""
    top = folder

    def run(batches):
        fs, base = store(top)
        out, name, at, first, n = None, None, 0, None, 0
        lines, directory = [], []

        def block():
            nonlocal at, lines
            data = packed("\n".join(x for _, x in lines).encode())
            out.write(data)
            directory.append((lines[0][0], at, len(data)))
            at += len(data)
            lines = []

        for batch in batches:
            for row in batch.to_pylist():
                if out is None:
                    name = f"shard-{uuid.uuid4().hex}.cdx.gz"
                    fs.create_dir(base, recursive=True)
                    out = fs.open_output_stream(f"{base}/{name}", compression=None)
                    first = row["key"]
                lines.append((row["key"], f"{row['key']} " + json.dumps(
                    [row[c] for c in _NAMES[1:]], separators=(",", ":"))))
                n += 1
                if len(lines) == BLOCK_LINES:
                    block()
        if out is None:
            return
        if lines:
            block()
        data = packed(json.dumps(directory).encode())
        out.write(data)
        out.close()
        yield pa.RecordBatch.from_arrays(
            [pa.array([first]), pa.array([name]), pa.array([at]), pa.array([len(data)]),
             pa.array([n])], names=["first", "file", "at", "size", "captures"])
    order = ["key", "file", "offset"]
    return written(entries.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(
        run, "first string, file string, at long, size long, captures long"), "shards")


class Shard:
    """A shard's directory, and the block that was read last."""

    def __init__(self, fs, path: str, at: int, size: int):
        self.file = fs.open_input_file(path)
        self.directory = json.loads(zlib.decompress(self._range(at, size), 31))
        self.first = [d[0] for d in self.directory]
        self.number, self.lines, self.keys = None, [], []

    def _range(self, at: int, size: int) -> bytes:
        self.file.seek(at)
        return self.file.read(size)

    def _load(self, number: int) -> None:
        if number != self.number:
            _, at, size = self.directory[number]
            self.lines = zlib.decompress(self._range(at, size), 31).decode().split("\n")
            # a key is two words: its URL part holds no blank
            self.keys = [" ".join(x.split(" ", 2)[:2]) for x in self.lines]
            self.number = number

    def find(self, key: str):
        """All captures of a key in the shard: they may go on in the blocks after."""
        block = max(0, bisect.bisect_left(self.first, key) - 1)
        while block < len(self.directory) and self.first[block] <= key:
            self._load(block)
            for i in range(bisect.bisect_left(self.keys, key), len(self.keys)):
                if self.keys[i] != key:
                    return
                yield [key, *json.loads(self.lines[i].split(" ", 2)[2])]
            block += 1


def lookup(spark: SparkSession, folder: str, shards: DataFrame, wanted: DataFrame) -> DataFrame:
    """The captures (``_ENTRY``) whose key is among those of ``wanted`` (column key).

    The shard table has a row per range partition of the index, whatever its captures
    number; it is the upper level that every task searches.
    """
    top = folder
    upper = sorted((r.first, r.file, r.at, r.size) for r in shards.collect())
    shared = spark.sparkContext.broadcast(upper)

    def place(batches):
        firsts = [u[0] for u in shared.value]
        for batch in batches:
            keys = batch.column(0).to_pylist()
            pairs = []
            for k in keys:
                # captures of a key may begin in one shard and go on in the next
                for s in range(max(0, bisect.bisect_left(firsts, k) - 1),
                               bisect.bisect_right(firsts, k)):
                    pairs.append((k, s))
            yield pa.RecordBatch.from_arrays(
                [pa.array([p[0] for p in pairs], pa.string()),
                 pa.array([p[1] for p in pairs], pa.int64())], names=["key", "shard"])

    def search(batches):
        fs, base = store(top)
        held, shard = None, None
        for batch in batches:
            found = []
            for key, number in zip(*(c.to_pylist() for c in batch.columns)):
                if number != held:
                    _, name, at, size = shared.value[number]
                    held, shard = number, Shard(fs, f"{base}/{name}", at, size)
                for entry in shard.find(key):
                    found.append(entry)
                    if len(found) == BLOCK_LINES:
                        yield _entries(found)
                        found = []
            yield _entries(found)
    keys = wanted.select("key").distinct().mapInArrow(place, "key string, shard long")
    # neighbouring keys together: a block is read once, and a shard may be many tasks' work
    return keys.repartitionByRange("shard", "key").sortWithinPartitions("shard", "key").mapInArrow(
        search, _ENTRY)


def read_records(folder: str, found: DataFrame) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to) of the captures found,
    from their records.  Digest and size of a response are those of the payload read (they
    must agree with its headers), of a revisit those that it states."""
    top = folder

    def ranges(rows):
        at = 0
        while at < len(rows):
            to = at + 1
            while to < len(rows) and rows[to][0] == rows[at][0] and (
                    rows[to][1] - (rows[to - 1][1] + rows[to - 1][2]) <= GAP) and (
                    rows[to][1] + rows[to][2] - rows[at][1] <= READ):
                to += 1
            yield rows[at:to]
            at = to

    def run(batches):
        fs, base = store(top)
        held, file = None, None
        for batch in batches:
            rows = list(zip(*(c.to_pylist() for c in batch.columns)))
            for run_ in ranges(rows):
                name, start, _ = run_[0]
                if name != held:
                    held, file = name, fs.open_input_file(f"{base}/{name}")
                file.seek(start)
                data = file.read(run_[-1][1] + run_[-1][2] - start)
                out = []
                for _, offset, size in run_:
                    found = parsed(zlib.decompress(data[offset - start:offset - start + size], 31))
                    warc, payload = found["warc"], found["payload"]
                    stated = warc["WARC-Payload-Digest"].removeprefix("sha1:")
                    length = int(found["http"]["Content-Length"])
                    if warc["WARC-Type"] == "response":
                        code = base64.b32encode(hashlib.sha1(payload).digest()).decode()
                        if code != stated or len(payload) != length:
                            raise ValueError(f"{name} at {offset}: the payload is damaged")
                    refers = warc.get("X-Refers-To-Page-Id", "")
                    out.append((int(warc["X-Page-Id"]) if warc["X-Page-Id"] else None, length,
                                stated, warc["WARC-Type"], int(refers) if refers else None))
                columns = list(zip(*out))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.int64()),
                     pa.array(columns[2], pa.string()), pa.array(columns[3], pa.string()),
                     pa.array(columns[4], pa.int64())],
                    names=["page_id", "payload_bytes", "payload_digest", "record_type",
                           "refers_to"])
    piece = F.floor(F.col("offset") / (4 * READ))
    return found.select("file", "offset", "size").repartition("file", piece).sortWithinPartitions(
        "file", "offset").mapInArrow(
        run, "page_id long, payload_bytes long, payload_digest string, record_type string, "
             "refers_to long")


def archived(pages: DataFrame, folder: str | None = None, least: int = 0) -> DataFrame:
    """Write the pages' archives and their index, look every capture up in the index, and
    read its record back."""
    spark = pages.sparkSession
    folder = folder or scratch_path(spark, "llm-warc")
    entries = write_archives(pages, f"{folder}/archive", least)
    shards = build_index(entries, f"{folder}/index")
    wanted = pages.select(sort_key(F.col("url"), F.col("page_id").cast("long")).alias("key"))
    return read_records(f"{folder}/archive", lookup(spark, f"{folder}/index", shards, wanted))
