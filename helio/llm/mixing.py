"""Mixing sources to target weights with distributed prefix sums.

Each document gets a hash-random key; documents are range-sorted by key within
their source, running word counts are taken in that order (``running_totals``: a
source may be far larger than a task), and every source is cut at its exact word
budget.  A budget above the source's size repeats whole epochs first.

Defined results: a null text has no words and is taken 0 times; a null source is a
source of its own, ordered last; a very long text is one row whose words are cut at the budget; a null document id is an id of its own; repeated
rows are separate documents; sources without words get target 0; an empty table
gives an empty mix; other columns are passed over.  Reruns agree, since keys depend
on the seed and the document id only (rows that share an id are ordered by size).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from helio.llm.stages import running_totals, written

_SPACE = " \t\n\x0b\x0c\r"


def word_count(text: Column) -> Column:
    """Number of runs of anything but [\\x20\\x09-\\x0D]; 0 for null."""
    bare = F.trim(text, F.lit(_SPACE))
    return (F.when(bare.isNull() | (bare == ""), 0)
            .otherwise(F.size(F.split(bare, "[\\x20\\x09-\\x0D]+"))).cast("long"))


def source_targets(sized: DataFrame, weights: Sequence[float], share: float,
                   max_epochs: float) -> DataFrame:
    """(source, source_size, weight, target): word targets by weight.

    Sources take the ``weights`` in code-point order, repeating, null last.  They
    share ``share`` times all words; no target exceeds ``max_epochs`` times its
    source's size, and what is cut off is shared again by weight.  Each round of
    sharing is one aggregate over the table of sources that returns three numbers.
    """
    sources = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    ranked = running_totals(
        sources.select("source", "source_size", F.col("source").isNull().alias("last"),
                       F.lit(1).alias("one")), [], ["last", "source"], "one", "place")
    table = F.array(*[F.lit(float(w)) for w in weights])
    ranked = written(ranked.select(
        "source", "source_size",
        F.element_at(table, (F.col("place") % len(weights) + 1).cast("int")).alias("weight"),
        (F.lit(float(max_epochs)) * F.col("source_size")).alias("cap")), "sources")
    words = ranked.agg(F.sum("source_size").alias("n")).first()["n"] or 0
    total, level, capped = float(share) * words, -1.0, -1
    while True:
        at_cap = F.col("cap") <= F.lit(level) * F.col("weight")
        row = ranked.agg(
            F.sum(F.when(at_cap, F.col("cap")).otherwise(0.0)).alias("held"),
            F.sum(F.when(at_cap, 0.0).otherwise(F.col("weight"))).alias("open"),
            F.sum(at_cap.cast("long")).alias("n")).first()
        if row["n"] is None or row["n"] == capped or not row["open"]:
            break
        capped, level = row["n"], (total - row["held"]) / row["open"]
    return ranked.withColumn("target", F.least("cap", F.lit(level) * F.col("weight")))


def mix(sized: DataFrame, weights: Sequence[float] = (3, 1, 2), share: float = 1.5,
        max_epochs: float = 2.0, seed: str = "mix-1") -> DataFrame:
    """(doc_id, source, size, source_size, target, epochs, before, rest, taken).

    ``sized`` has doc_id, source, size and any columns to carry.  ``epochs`` whole
    passes of the source are taken, then the first ``rest`` words of its sorted
    documents; ``before`` is the number of words sorted before the document, and
    ``taken`` the words taken of it, so a source's ``taken`` add up to its target
    rounded to whole words.
    """
    keyed = written(sized.withColumn("_key", F.md5(F.concat_ws(
        "|", F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))))), "sized")
    targets = written(source_targets(keyed, weights, share, max_epochs), "targets")
    placed = running_totals(keyed, ["source"], ["_key", "size"], "size", "before")
    goal = F.floor(F.col("target") + 0.5).cast("long")
    epochs = F.when(F.col("source_size") > 0,
                    F.floor(goal / F.col("source_size")).cast("long")).otherwise(F.lit(0))
    budget = targets.select(
        F.col("source").alias("_source"), "source_size", "target",
        epochs.cast("long").alias("epochs"),
        (goal - epochs * F.col("source_size")).cast("long").alias("rest"))
    cut = F.greatest(F.lit(0), F.least(F.col("size"), F.col("rest") - F.col("before")))
    return (placed.join(budget, F.col("source").eqNullSafe(F.col("_source")))
            .withColumn("taken", (F.col("epochs") * F.col("size") + cut).cast("long"))
            .drop("_source", "_key"))


def mixed_documents(docs: DataFrame, weights: Sequence[float] = (3, 1, 2),
                    share: float = 1.5, max_epochs: float = 2.0,
                    seed: str = "mix-1") -> DataFrame:
    """The mix as documents (the input's columns): each document as many times as the
    mix takes it, whole.  The document at a source's cut is taken once more if at
    least half of its words fit.  Rows that agree in id, source and text (by a 64-bit
    hash) share their copies."""
    key, place = "__helio_row", "__helio_place"
    row = F.xxhash64(F.col("doc_id").cast("long"), F.col("source").isNull(), "source", "text")
    sized = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "source",
                        row.alias("row"), word_count(F.col("text")).alias("size"))
    times = F.col("epochs") + F.when(
        F.col("before") + F.col("size") / 2 <= F.col("rest"), 1).otherwise(0)
    copies = (mix(sized, weights, share, max_epochs, seed)
              .withColumn("n", F.when(F.col("source_size") > 0, times).otherwise(1))
              .groupBy("row").agg(F.sum("n").alias("__helio_n"),
                                  F.count(F.lit(1)).alias("__helio_rows"))
              .withColumnRenamed("row", "__helio_same"))
    same = Window.partitionBy(key).orderBy(F.lit(0))
    own = F.floor((F.col("__helio_n") + F.col("__helio_rows") - F.col(place))
                  / F.col("__helio_rows")).cast("int")
    return (docs.withColumn(key, row).join(copies.hint("merge"),
                                           F.col(key) == F.col("__helio_same"))
            .withColumn(place, F.row_number().over(same)).filter(own > 0)
            .withColumn("__helio_copy", F.explode(F.sequence(F.lit(1), own)))
            .select(*[F.col(f"`{c}`") for c in docs.columns]))
