"""Connected components of a link table, without gathering links anywhere.

Each round hangs every node and its neighbours below the smallest node among them
(first the larger neighbours, then the smaller ones), which keeps components intact
and ends in stars.  Tasks first reduce their own links to a forest, so many links
within a group become at most one per node before anything is shuffled.
"""

from __future__ import annotations

import sys

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from helio.llm.stages import written

cloudpickle.register_pickle_by_value(sys.modules[__name__])


def smallest_labels(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(nodes, labels) of the links (a, b): each node's smallest connected node."""
    nodes, code = np.unique(np.concatenate([a, b]), return_inverse=True)
    u, v = code[:len(a)], code[len(a):]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[u], label[v])
        new = label.copy()
        np.minimum.at(new, label[u], low)
        np.minimum.at(new, label[v], low)
        new = new[new]
        if np.array_equal(new, label):
            return nodes, nodes[label]
        label = new


def _forest(batches):
    for batch in batches:
        a, b = (np.asarray(batch.column(i)) for i in (0, 1))
        keep = a != b
        if keep.any():
            nodes, labels = smallest_labels(a[keep], b[keep])
            rest = nodes != labels
            yield pa.RecordBatch.from_arrays(
                [pa.array(nodes[rest], pa.int64()), pa.array(labels[rest], pa.int64())],
                names=["a", "b"])


def components(links: DataFrame) -> DataFrame:
    """(id, component) of every node of ``links`` (two long columns a and b): the
    smallest node reachable from it.  Self-links and null ends are passed over; nodes
    without links are not listed."""
    now = written(links.select(F.col("a").cast("long"), F.col("b").cast("long"))
                  .dropna().mapInArrow(_forest, "a long, b long").distinct(), "links")
    if not now.take(1):
        return now.select(F.col("a").alias("id"), F.col("b").alias("component"))
    while True:
        # large star: larger neighbours go below the smallest node around
        ends = now.select("a", "b").union(now.select("b", "a")).toDF("u", "v")
        least = ends.groupBy("u").agg(F.min("v").alias("m")).select(
            "u", F.least("u", "m").alias("m"))
        large = (ends.join(least, "u").filter("v > u")
                 .select(F.col("v").alias("u"), F.col("m").alias("v")).distinct())
        # small star: a node and its smaller neighbours go below the smallest of them
        lower = large.filter("v < u")
        least = lower.groupBy("u").agg(F.min("v").alias("m"))
        small = lower.join(least, "u").select(F.explode(F.array(
            F.struct(F.col("v").alias("a"), F.col("m").alias("b")),
            F.struct(F.col("u").alias("a"), F.col("m").alias("b")))).alias("e")).select("e.*")
        now = written(small.filter("a > b").mapInArrow(_forest, "a long, b long").distinct(),
                      "stars")
        # as many links as linked nodes, and no label below another: only stars are left
        n, nodes = now.agg(F.count(F.lit(1)), F.countDistinct("a")).first()
        if n == nodes and not now.join(now.select(F.col("a").alias("b")), "b",
                                       "left_semi").take(1):
            break
    roots = now.select(F.col("b").alias("id"), F.col("b").alias("component")).distinct()
    return written(now.select(F.col("a").alias("id"), F.col("b").alias("component"))
                   .unionByName(roots), "components")
