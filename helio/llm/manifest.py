"""Merkle dataset manifest with incremental witnesses.

Every row is a leaf, the hash of its fields.  The leaves of a group are numbered in order
and appended, one after the other, to *open subtrees*: complete trees of falling height, as
many as the number of leaves has one-bits.  A leaf starts with an empty witness; whenever
two open subtrees of one height meet, the witnesses of the left one are extended by the
root of the right one and the reverse, and the two become one subtree a level higher.  So
a witness is always complete up to the subtree that holds its leaf, and each later sibling
extends it.

The appends are aligned: a block is ``BLOCK`` (a power of two) consecutive leaves of a group,
and tasks take blocks independently, so no task sees a whole group.  The root of a block
is then itself a leaf of the next tier, and is appended in the same way with the other
blocks of its group, until every group is one root; the roots of the groups are the leaves
of the last tree.  The witness of a row is its own in its block, followed by those of its
block, tier by tier.

A node is the SHA-256 (lower-case hex) of its children's digests as hex text; the last node
of a level without a sibling is hashed alone, unless it is the only node of its tree.

Defined results: null fields hash as ``-``; rows of one group stand in order of id (null
first), repeated rows side by side (their digests are equal, their witnesses differ); null
groups come first; texts of any length are hashed in the scan and never shuffled; an empty
table gives an empty manifest; other columns are not read.
"""

from __future__ import annotations

import hashlib
import itertools
import sys

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from helio.llm.stages import running_totals, written

cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Leaves in a block; a power of two.
BLOCK = 1 << 12
_STEPS = "array<struct<side:string,digest:binary>>"


def digest(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def fields_digest(*fields: Column) -> Column:
    """The hash of a row's fields: each ``-`` if null, else its size in UTF-8 bytes, a colon
    and its text."""
    return F.sha2(F.concat(*[
        F.when(f.isNull(), F.lit("-")).otherwise(
            F.concat(F.octet_length(f.cast("string")).cast("string"), F.lit(":"),
                     f.cast("string")))
        for f in fields]), 256)


class Appender:
    """Open subtrees of one block, with the partial witnesses of their leaves."""

    def __init__(self):
        self.open: list[tuple[int, str, list]] = []  # (height, root, witnesses)
        self.size = 0

    def append(self, leaf: str) -> None:
        self.size += 1
        height, root, held = 0, leaf, [[]]
        while self.open and self.open[-1][0] == height:
            height, root, held = self._joined(self.open.pop(), (height, root, held))
        self.open.append((height, root, held))

    @staticmethod
    def _joined(left, right):
        for witness in left[2]:
            witness.append(("R", right[1]))
        for witness in right[2]:
            witness.append(("L", left[1]))
        return left[0] + 1, digest(left[1] + right[1]), left[2] + right[2]

    @staticmethod
    def _alone(tree):
        for witness in tree[2]:
            witness.append((".", ""))
        return tree[0] + 1, digest(tree[1]), tree[2]

    def close(self, height: int = 0) -> tuple[str, list]:
        """(root, witnesses) of all leaves.  Lone last nodes are hashed alone up to the
        level where they meet a sibling, and the root up to ``height``."""
        right = self.open.pop()
        while self.open:
            left = self.open.pop()
            while right[0] < left[0]:
                right = self._alone(right)
            right = self._joined(left, right)
        while right[0] < height:
            right = self._alone(right)
        return right[1], right[2]


def _appended(batches):
    """Rows (grp, block, pos, digest) in order, to (grp, block, pos, root, path)."""
    step = pa.struct([("side", pa.string()), ("digest", pa.binary())])
    state, key, places = None, None, []

    def closed():
        # a block after the first is part of a larger tree: raise it to a block's level
        root, witnesses = state.close(BLOCK.bit_length() - 1 if key[1] else 0)
        for at in range(0, len(witnesses), 512):  # witnesses leave in small batches
            part = witnesses[at:at + 512]
            n = len(part)
            flat = [s for w in part for s in w]
            steps = pa.StructArray.from_arrays(
                [pa.array([s for s, _ in flat], pa.string()),
                 pa.array([bytes.fromhex(d) for _, d in flat], pa.binary())], fields=list(step))
            ends = pa.array([0, *itertools.accumulate(map(len, part))], pa.int32())
            yield pa.RecordBatch.from_arrays(
                [pa.array([key[0]] * n, pa.string()), pa.array([key[1]] * n, pa.int64()),
                 pa.array(places[at:at + n], pa.int64()),
                 pa.array([bytes.fromhex(root)] * n, pa.binary()),
                 pa.ListArray.from_arrays(ends, steps)],
                names=["grp", "block", "pos", "root", "path"])

    for batch in batches:
        for grp, block, pos, leaf in zip(*(c.to_pylist() for c in batch.columns)):
            if (grp, block) != key:
                if state is not None:
                    yield from closed()
                state, key, places = Appender(), (grp, block), []
            state.append(leaf)
            places.append(pos)
    if state is not None:
        yield from closed()


def tiers(leaves: DataFrame) -> list[DataFrame]:
    """Written tables (grp, block, pos, root, path) of the leaves (grp, pos, digest), which
    are numbered from 0 in every group: the root of a leaf's block and the leaf's witness
    in it, then the same of the blocks, until every group is one block."""
    out, now = [], leaves
    while True:
        placed = now.select("grp", F.floor(F.col("pos") / BLOCK).alias("block"), "pos", "digest")
        tier = written(placed.repartition("grp", "block").sortWithinPartitions(
            "grp", "block", "pos").mapInArrow(
            _appended, f"grp string, block long, pos long, root binary, path {_STEPS}"), "tier")
        out.append(tier)
        if not tier.filter("block > 0").take(1):
            return out
        now = tier.filter(F.col("pos") == F.col("block") * BLOCK).select(
            "grp", F.col("block").alias("pos"), hex_text(F.col("root")).alias("digest"))


def continued(tier: DataFrame, above: DataFrame, *carried: str) -> DataFrame:
    """(grp, pos, path, carried columns) of a tier whose leaves' witnesses go on with those
    of their blocks, ``above``."""
    up = above.select("grp", F.col("pos").alias("block"), F.col("path").alias("_above"), *carried)
    return tier.select("grp", "block", "pos", "path").join(up, ["grp", "block"]).select(
        "grp", "pos", F.concat("path", "_above").alias("path"), *carried)


def hex_text(value: Column) -> Column:
    return F.lower(F.hex(value))


def folded(leaf: Column, path: Column) -> Column:
    """The root that a leaf and a witness give."""
    def step(node, s):
        other = hex_text(s["digest"])
        return F.sha2(F.when(s["side"] == "L", F.concat(other, node)).otherwise(
            F.concat(node, other)), 256)
    return F.aggregate(path, leaf, step)


def manifest(leaves: DataFrame, group: str, order: str) -> DataFrame:
    """All columns of ``leaves`` (one column ``leaf`` holds the digests) with ``subroot`` (the
    group's root), ``root`` (of all groups) and ``path``: the witness from leaf to root, an
    array of (side of the sibling, "." for none; digest).  ``leaves`` has none of the names
    grp, pos, path, subroot, root."""
    mark = F.when(F.col(group).isNull(), F.lit("")).otherwise(F.concat(F.lit("="), F.col(group)))
    rows = written(leaves.withColumn("grp", mark).withColumn("_one", F.lit(1)).withColumn(
        "_tie", F.monotonically_increasing_id()), "leaves")  # repeated rows split too
    placed = running_totals(rows, ["grp"], [order, "leaf", "_tie"], "_one", "pos")
    own = tiers(placed.select("grp", "pos", F.col("leaf").alias("digest")))

    # the groups' roots, in order of their names (bytes, null first), are the last tree
    tops = own[-1].filter("pos = 0").select("grp", "root").withColumn("_one", F.lit(1))
    tops = written(running_totals(tops, [], ["grp"], "_one", "pos").drop("_one"), "tops")
    last = tiers(tops.select(F.lit("").alias("grp"), "pos",
                             hex_text(F.col("root")).alias("digest")))
    done = last.pop().select("grp", "pos", "path", F.col("root").alias("_root"))
    while last:
        done = continued(last.pop(), done, "_root")
    # down again: the top block of a group goes on with the last tree, its leaves with it
    done = tops.join(done.select("pos", "path", "_root"), "pos").select(
        "grp", F.lit(0).cast("long").alias("pos"), "path", "_root", F.col("root").alias("_sub"))
    while own:
        done = continued(own.pop(), done, "_root", "_sub")
        if own:
            done = written(done, "witnesses")
    return placed.join(done, ["grp", "pos"]).select(
        *leaves.columns, hex_text(F.col("_sub")).alias("subroot"),
        hex_text(F.col("_root")).alias("root"), "path")


def proof_digest(path: Column) -> Column:
    """The hash of a witness: all siblings from leaf to root."""
    return F.sha2(F.concat_ws("", F.transform(path, lambda s: hex_text(s["digest"]))), 256)


def document_manifest(docs: DataFrame, tampered: Column) -> DataFrame:
    """(doc_id, leaf, subroot, root, proof_sha256, folded_root, verified) of every document,
    by lang.  Where ``tampered`` is true, the row to verify has one more in n_chars."""
    def leaf(n_chars):
        return fields_digest(F.col("doc_id"), F.col("source"), F.col("lang"), n_chars,
                             F.col("text"))
    seen = F.when(tampered, leaf(F.col("n_chars") + 1))
    leaves = docs.select("doc_id", "lang", leaf(F.col("n_chars")).alias("leaf"),
                         seen.alias("seen"))
    return manifest(leaves, "lang", "doc_id").withColumn(
        "folded_root", folded(F.coalesce("seen", "leaf"), F.col("path"))).select(
        "doc_id", "leaf", "subroot", "root", proof_digest(F.col("path")).alias("proof_sha256"),
        "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))
