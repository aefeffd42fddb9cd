"""Embedding near-dedup: an exact metric range join on pivots.

Only vectors of the same label and length are compared.  Cosine c becomes the
Euclidean distance sqrt(2 - 2c) of unit vectors, so the link threshold is a radius r.
Exact copies form one class first, so a vector that a third of the rows repeat is
joined once.  Each label has one pivot per ``CELL`` classes (beyond ``MANY`` pivots, as many
as the root of its classes); a class lives in the cell of its nearest pivot.  If x and y are within r and y lives
in cell j, the triangle inequality gives d(x, p_j) <= d(x, p_home) + 2r, so x is
copied only to the cells (numbered below its own, so each pair meets once) where that
holds and where the cell's radius reaches x.  Cells join independently; a cell larger
than a task is joined in tiles of bounded size.  A task gives, per class, the number
of vectors linked to it, and a forest of the links it found (never the pairs), from
which the components are made.

Defined results: a vector links with nothing if its id, its label, the vector or a
component is null, a component is not finite, or all are zero; vectors of different
length never link; a very long vector is compared whole; a class equally near to two
pivots lives in the first one's cell; rows that repeat an id are separate vectors; an empty table gives
an empty result; other columns are not read.
"""

from __future__ import annotations

import math
import sys

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from helio.llm.components import components, smallest_labels
from helio.llm.stages import written

cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Classes of a cell, as long as a label has not more than MANY cells; beyond, the number
#: of cells grows with the root of the label's classes, which balances distances to pivots
#: against distances inside cells.  BLOCK classes meet all pivots in one task.
CELL, MANY, BLOCK = 2048, 256, 4096
TILE_X, TILE_Y = 2048, 8192
_SLACK = 1e-9


def units(vectors) -> np.ndarray:
    """Unit rows in double precision (scaled first, so no square over- or underflows)."""
    x = np.array([np.asarray(v, dtype=np.float64) for v in vectors])
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def exact_cosine(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (a * b).sum(axis=1) / np.sqrt((a * a).sum(axis=1) * (b * b).sum(axis=1))


def vector_classes(vectors: DataFrame, id_col: str, vec_col: str, label_col: str) -> DataFrame:
    """All rows with their class key (null where a vector links with nothing)."""
    v = vectors.select(F.col(id_col).cast("long").alias("vec_id"),
                       F.col(vec_col).cast("array<double>").alias("v"),
                       F.col(label_col).alias("label"))
    fine = (F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("v").isNotNull()
            & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x)
                       & (F.abs(x) < F.lit(float("inf"))))
            & F.exists("v", lambda x: x != 0))
    fine = F.coalesce(fine, F.lit(False))
    return v.select("vec_id", "v", "label", F.size("v").alias("dim"),
                    F.when(fine, F.xxhash64("label", "v")).alias("h1"),
                    F.when(fine, F.xxhash64(F.lit(7), "v", "label")).alias("h2"))


def _assign(radius: float):
    """Cells of one block of classes: the home cell, and copies to lower cells."""
    def run(_, rows: pd.DataFrame, pivots: pd.DataFrame) -> pd.DataFrame:
        cols = ["label", "dim", "cell", "inner", "rep", "mult", "away", "v"]
        if not len(rows):
            return pd.DataFrame({c: [] for c in cols})
        pivots = pivots.sort_values("cell")
        x, p = units(rows["v"]), units(pivots["v"])
        d = np.sqrt(np.maximum(0.0, 2.0 - 2.0 * (x @ p.T)))
        home = d.argmin(axis=1)
        near = d[np.arange(len(d)), home]
        lower = np.arange(len(p))[None, :] < home[:, None]
        at, cell = np.nonzero(lower & (d <= near[:, None] + 2 * radius + _SLACK))
        at = np.concatenate([np.arange(len(x)), at])
        inner = np.arange(len(at)) < len(x)
        cell = np.concatenate([home, cell])
        out = rows.iloc[at][["label", "dim", "rep", "mult", "v"]].copy()
        out["cell"], out["inner"], out["away"] = cell, inner, d[at, cell]
        return out[cols]
    return run


def _join(cosine: float):
    """Links of one tile: per class the vectors linked to it, and a forest."""
    def run(_, one: pd.DataFrame, two: pd.DataFrame) -> pd.DataFrame:
        if not len(one) or not len(two):
            return pd.DataFrame({"a": [], "b": [], "n": []})
        x, y = units(one["v"]), units(two["v"])
        xi, yi = one["rep"].to_numpy(np.int64), two["rep"].to_numpy(np.int64)
        xm, ym = one["mult"].to_numpy(np.int64), two["mult"].to_numpy(np.int64)
        inner = two["inner"].to_numpy(bool)
        xn, yn = np.zeros(len(x), np.int64), np.zeros(len(y), np.int64)
        ends: list = []
        for s in range(0, len(x), 256):
            sl = slice(s, s + 256)
            sim = x[sl] @ y.T
            link = sim >= cosine
            edge = np.abs(sim - cosine) < 1e-12
            if edge.any():
                i, j = np.nonzero(edge)
                link[i, j] = exact_cosine(x[sl][i], y[j]) >= cosine
            link &= ~inner[None, :] | (yi[None, :] > xi[sl][:, None])
            i, j = np.nonzero(link)
            xn[sl] += np.bincount(i, weights=ym[j], minlength=len(sim)).astype(np.int64)
            yn += np.bincount(j, weights=xm[sl][i], minlength=len(y)).astype(np.int64)
            if len(i):
                nodes, labels = smallest_labels(xi[sl][i], yi[j])
                ends.append(np.stack([nodes, labels])[:, nodes != labels])
        out = [pd.DataFrame({"a": ids[n > 0], "b": -1, "n": n[n > 0]})
               for ids, n in ((xi, xn), (yi, yn))]
        for a, b in ends:
            out.append(pd.DataFrame({"a": a, "b": b, "n": 0}))
        return pd.concat(out, ignore_index=True)
    return run


def near_vectors(vectors: DataFrame, cosine: float = 0.93, id_col: str = "vec_id",
                 vec_col: str = "embedding", label_col: str = "label",
                 report: dict | None = None) -> DataFrame:
    """(vec_id, class_id, n_links, component_id, kept) of every row: vectors with cosine
    at least ``cosine`` link.  ``class_id`` is the smallest id with the same vector and
    label; ``kept`` is true for the smallest id of each component.  ``report`` is filled
    with the numbers of ``classes``, of their ``copies`` in other cells, and of ``pairs``
    compared."""
    radius = math.sqrt(max(0.0, 2.0 - 2.0 * cosine))
    rows = vector_classes(vectors, id_col, vec_col, label_col)
    key = ["label", "dim"]
    classes = written(rows.filter("h1 IS NOT NULL").groupBy(*key, "h1", "h2").agg(
        F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("mult"),
        F.first("v").alias("v")), "vectors")
    n = F.col("n")
    cells = F.least(F.ceil(n / CELL), F.greatest(F.lit(MANY), F.ceil(F.sqrt(n))))
    sizes = written(classes.groupBy(*key).agg(F.count(F.lit(1)).alias("n")).select(
        *key, "n", cells.cast("int").alias("cells"),
        F.ceil(n / BLOCK).cast("int").alias("blocks")), "labels")
    # pivots: the classes with the smallest hashes.  The share of the hash's range that
    # holds about twice as many as are wanted is cut out first, so no window sees a label
    share = F.pmod(F.xxhash64("rep"), F.lit(1 << 40)) / (1 << 40)
    place = F.row_number().over(Window.partitionBy(*key).orderBy("_share", "rep"))
    few = classes.join(sizes, key).withColumn("_share", share)
    near = few.filter(F.col("_share") * F.col("n") < 2 * F.col("cells") + 64)
    pivots = (near.withColumn("place", place).filter(F.col("place") <= F.col("cells"))
              .select(*key, F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"),
                      (F.col("place") - 1).alias("cell"), "v")
              .toDF(*key, "block", "cell", "v"))
    blocked = classes.join(sizes, key).select(
        *key, F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int").alias("block"),
        "rep", "mult", "v")
    label_type = dict(classes.dtypes)["label"]
    cells = written(
        blocked.groupBy(*key, "block").cogroup(pivots.groupBy(*key, "block")).applyInPandas(
            _assign(radius), f"label {label_type}, dim int, cell int, inner boolean, rep long, "
            "mult long, away double, v array<double>"), "cells")
    cell = [*key, "cell"]
    reach = cells.groupBy(*cell).agg(
        F.max(F.when(F.col("inner"), F.col("away"))).alias("reach"),
        F.sum(F.col("inner").cast("int")).alias("nx"), F.count(F.lit(1)).alias("ny"))
    placed = (cells.join(reach.select(
        *cell, "reach", F.ceil(F.col("nx") / TILE_X).cast("int").alias("tx"),
        F.ceil(F.col("ny") / TILE_Y).cast("int").alias("ty")), cell)
        .filter(F.col("inner") | (F.col("away") <= F.col("reach") + radius + _SLACK)))
    if report is not None:
        met = placed.groupBy(*cell).agg(F.count_if("inner").alias("x"),
                                        F.count(F.lit(1)).alias("y")).agg(
            F.sum("x"), F.sum("y"), F.sum(F.col("x") * F.col("y"))).first()
        report.update(classes=met[0] or 0, copies=(met[1] or 0) - (met[0] or 0),
                      pairs=met[2] or 0)
    own = [*cell, F.pmod(F.xxhash64("rep", F.lit(1)), "tx").cast("int").alias("x"),
           F.explode(F.sequence(F.lit(0), F.col("ty") - 1)).alias("y"), "rep", "mult", "v"]
    others = [*cell, F.explode(F.sequence(F.lit(0), F.col("tx") - 1)).alias("x"),
              F.pmod(F.xxhash64("rep", F.lit(2)), "ty").cast("int").alias("y"),
              "rep", "mult", "inner", "v"]
    tile = [*cell, "x", "y"]
    found = written(
        placed.filter("inner").select(*own).groupBy(*tile).cogroup(
            placed.filter("tx > 0").select(*others).toDF(
                *tile, "rep", "mult", "inner", "v").groupBy(*tile)).applyInPandas(
            _join(cosine), "a long, b long, n long"), "vector-links")
    labels = components(found.filter("n = 0").select("a", "b"))
    counts = found.filter("n > 0").groupBy("a").agg(F.sum("n").alias("n"))
    result = (classes.select("label", "h1", "h2", "rep", "mult")
              .join(counts, F.col("rep") == F.col("a"), "left")
              .join(labels, F.col("rep") == F.col("id"), "left")
              .select("h1", "h2", F.col("rep").alias("class_id"),
                      (F.coalesce("n", F.lit(0)) + F.col("mult") - 1).alias("n_links"),
                      F.coalesce("component", "rep").alias("component_id")))
    return rows.select("vec_id", "h1", "h2").join(result, ["h1", "h2"], "left").select(
        "vec_id", F.coalesce("class_id", "vec_id").alias("class_id"),
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        F.coalesce("component_id", "vec_id").alias("component_id"),
        F.col("vec_id").eqNullSafe(F.coalesce("component_id", "vec_id")).alias("kept"))
