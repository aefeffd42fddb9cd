"""Line dedup by range-partitioned hashes, with DataFrame functions only.

Every line long enough becomes a pair of 64-bit hashes of its key.  The hashes are
range-partitioned together with a piece number of the document, and each piece is
sorted by document (largest first) and position, so one pass over the sorted rows
sees the first occurrence of a line in every document.  A line that a third of all
documents hold is spread over pieces of about ``PIECE_LINES`` lines.  Per piece one row goes
on (documents counted, largest document), which a second aggregate sums per line.
Lines found often enough are joined back (a skewed join, which Spark splits) and
each document gets the run-length compressed bitmap of the lines it loses; texts
never travel until ``apply_bitmaps`` is asked for them.

Defined results: a null or empty text is one empty line; a very long text is one row of
the scan, whose lines leave it one by one; a null document id counts
as smaller than every id; rows that agree in id and text are the same document and
get the same bitmap; rows that share an id but not a text count as one document
when documents are counted, and each gets its own bitmap; an empty table gives an
empty result; other columns of the input are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from helio.llm.stages import NO_ID, documents, written

#: Lines of a piece: a line that fills the table is split into pieces of about that many.
PIECE_LINES, LEAST_PIECES = 50_000, 256
_SPACE = " \t\n\x0b\x0c\r"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def line_key(line: Column) -> Column:
    """The line without [\\x20\\x09-\\x0D] at both ends, A-Z lower-cased."""
    return F.translate(F.trim(line, F.lit(_SPACE)), _UPPER, _LOWER)


def _identified(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return documents(docs, id_col, text_col).select(
        F.coalesce("doc_id", F.lit(NO_ID)).alias("doc"), F.xxhash64("text").alias("text_hash"),
        "text")


def line_bitmaps(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                 min_chars: int = 20, min_docs: int = 3) -> DataFrame:
    """(doc, text_hash, dropped, n_dropped) of every document that loses lines.

    Lines whose key has at least ``min_chars`` code points and is found in at least
    ``min_docs`` documents are lost everywhere but in the largest document id that
    holds them.  ``dropped`` is the bitmap of lost lines as runs [start, stop) of
    line positions, ascending; a document that is not listed keeps every line.
    """
    lines = _identified(docs, id_col, text_col).select(
        "doc", "text_hash", F.posexplode(F.split("text", "\n", -1)).alias("pos", "line"))
    # written once: the range bounds and both uses below read hashes, not texts
    keyed = written(
        lines.select("doc", "text_hash", "pos", line_key(F.col("line")).alias("key"))
        .filter(F.length("key") >= min_chars)
        .select("doc", "text_hash", "pos", F.xxhash64("key").alias("h1"),
                F.xxhash64(F.lit("line"), "key").alias("h2")), "lines")
    pieces = max(LEAST_PIECES, keyed.count() // PIECE_LINES)
    ranged = keyed.withColumn("piece", F.pmod(F.xxhash64("doc"), F.lit(pieces))).repartitionByRange(
        "h1", "h2", "piece")
    streamed = Window.partitionBy("h1", "h2", "piece").orderBy(F.desc("doc"), "pos")
    firsts = ranged.withColumn(
        "first", (F.row_number().over(streamed) == 1)
        | (F.lag("doc").over(streamed) != F.col("doc")))
    # written, so that both sides of the join below are shuffles that Spark can split
    common = written(
        firsts.groupBy("h1", "h2")
        .agg(F.sum(F.col("first").cast("long")).alias("n_docs"), F.max("doc").alias("keeper"))
        .filter(F.col("n_docs") >= min_docs).select("h1", "h2", "keeper"), "common-lines")
    lost = (keyed.join(common, ["h1", "h2"]).filter(F.col("doc") != F.col("keeper"))
            .groupBy("doc", "text_hash").agg(F.array_sort(F.collect_set("pos")).alias("at")))
    starts = F.filter("at", lambda x, i: (i == 0) | (F.get("at", i - 1) != x - 1))
    stops = F.transform(
        F.filter("at", lambda x, i: (i == F.size("at") - 1) | (F.get("at", i + 1) != x + 1)),
        lambda x: x + 1)
    return lost.select("doc", "text_hash",
                       F.arrays_zip(starts.alias("start"), stops.alias("stop")).alias("dropped"),
                       F.size("at").cast("long").alias("n_dropped"))


def apply_bitmaps(docs: DataFrame, bitmaps: DataFrame, id_col: str = "doc_id",
                  text_col: str = "text") -> DataFrame:
    """(doc_id, n_lines, n_dropped, kept): every document with its kept lines, joined by
    newlines.  Lines are copied run by run, so the work is linear in the text."""
    found = (_identified(docs, id_col, text_col)
             .join(bitmaps, ["doc", "text_hash"], "left")
             .withColumn("lines", F.split("text", "\n", -1))
             .withColumn("n_lines", F.size("lines").cast("long")))
    none = F.array().cast("array<int>")
    edges = found.withColumn("froms", F.concat(
        F.array(F.lit(0)), F.coalesce(F.col("dropped.stop"), none))).withColumn(
        "tos", F.concat(F.coalesce(F.col("dropped.start"), none),
                        F.array(F.col("n_lines").cast("int"))))
    kept = F.flatten(F.zip_with("froms", "tos",
                                lambda a, b: F.slice("lines", a + 1, b - a)))
    return edges.select(
        F.nullif("doc", F.lit(NO_ID)).alias("doc_id"), "n_lines",
        F.coalesce("n_dropped", F.lit(0)).cast("long").alias("n_dropped"),
        F.when(F.col("n_dropped").isNull(), F.col("text"))
        .otherwise(F.concat_ws("\n", kept)).alias("kept"))
