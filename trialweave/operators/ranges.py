"""Where two versions of a table differ: hashes of key ranges compared level by level."""
from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from .lineage import checkpointed

#: Children of a node of the tree, as bits of the key's hash, and levels below the root.
FAN_BITS, LEVELS = 8, 3
#: Bits of the key's hash that name a leaf.
DEPTH = FAN_BITS * LEVELS


def row_digests(df: DataFrame, keys: list[str], columns: list[str] | None = None) -> DataFrame:
    """Per row: ``leaf``, the first ``DEPTH`` bits of the hash of its key, and a 64-bit digest ``d``.

    Cells are compared as text; null and the empty text differ. Columns are taken by name.
    """
    names = sorted(c for c in (columns or df.columns) if c not in keys)
    cell = lambda c: F.coalesce(F.concat(F.lit("="), F.col(f"`{c}`").cast("string")), F.lit("-"))
    key = F.xxhash64(*[cell(c) for c in keys])
    return df.select(F.shiftrightunsigned(key, 64 - DEPTH).alias("leaf"),
                     F.xxhash64(*[cell(c) for c in [*keys, *names]]).alias("d"))


def leaf_hashes(df: DataFrame, keys: list[str], columns: list[str] | None = None) -> DataFrame:
    """The leaves of a table's tree: ``leaf``, ``n`` rows, and two folds of their digests that do not
    depend on the order (``x`` by exclusive or, ``s`` by a sum). At most 2 ** ``DEPTH`` rows whatever the
    table's size, so it can be stored beside the table and compared without reading it again."""
    mixed = F.xxhash64("d", F.lit(1))
    return row_digests(df, keys, columns).groupBy("leaf").agg(
        F.count(F.lit(1)).alias("n"), F.bit_xor("d").alias("x"),
        F.sum(mixed.cast("decimal(20,0)")).alias("s"))


def level(leaves: DataFrame, depth: int) -> DataFrame:
    """The nodes of one level, 0 being the root, out of the leaves."""
    return leaves.groupBy(F.shiftrightunsigned("leaf", DEPTH - depth * FAN_BITS).alias("node")).agg(
        F.sum("n").alias("n"), F.bit_xor("x").alias("x"), F.sum("s").alias("s"))


def _unlike(a: DataFrame, b: DataFrame, on: str) -> DataFrame:
    """The nodes whose hashes differ, and those that only one side has."""
    names = ("n", "x", "s")
    right = b.select(F.col(on).alias("_on"), *[F.col(c).alias(f"_{c}") for c in names])
    same = reduce(lambda p, q: p & q, [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in names])
    return a.join(right, F.col(on) == F.col("_on"), "full_outer").where(~same).select(
        F.coalesce(on, "_on").alias(on))


def changed_leaves(before: DataFrame, after: DataFrame) -> DataFrame:
    """Leaves that differ, going down from the root: a node whose hash is equal on both sides is not
    opened, so of equal tables only the two roots are compared. Takes two results of ``leaf_hashes``."""
    found = checkpointed(_unlike(level(before, 0), level(after, 0), "node"))
    for depth in range(1, LEVELS + 1):
        inside = lambda side: level(side, depth).join(
            found.withColumnRenamed("node", "_parent"),
            F.shiftrightunsigned("node", FAN_BITS) == F.col("_parent"), "left_semi")
        found = checkpointed(_unlike(inside(before), inside(after), "node"))
    return found.withColumnRenamed("node", "leaf")


def rows_in(df: DataFrame, keys: list[str], leaves: DataFrame) -> DataFrame:
    """The rows of a table that lie in the given leaves, all columns as they are."""
    cell = lambda c: F.coalesce(F.concat(F.lit("="), F.col(f"`{c}`").cast("string")), F.lit("-"))
    at: Column = F.shiftrightunsigned(F.xxhash64(*[cell(c) for c in keys]), 64 - DEPTH)
    return df.join(leaves.select(F.col("leaf").alias("_leaf")), at == F.col("_leaf"), "left_semi")


def changed_ranges(before: DataFrame, after: DataFrame, keys: list[str],
                   columns: list[str] | None = None) -> DataFrame:
    """Rows found on one side only, with ``side`` (``before`` or ``after``), repeats counted.

    Only rows of leaves whose hashes differ are compared cell by cell. Folds of two 64-bit hashes and
    a count stand for equal leaves. Where one of the tables is stored with its ``leaf_hashes``, go
    through ``changed_leaves`` and ``rows_in`` instead, and only the other one is hashed.
    """
    names = [*keys, *sorted(c for c in (columns or before.columns) if c not in keys)]
    leaves = checkpointed(changed_leaves(*[
        checkpointed(leaf_hashes(t, keys, columns)) for t in (before, after)]))
    a, b = [rows_in(t.select(*[F.col(f"`{c}`") for c in names]), keys, leaves) for t in (before, after)]
    return a.exceptAll(b).withColumn("side", F.lit("before")).unionByName(
        b.exceptAll(a).withColumn("side", F.lit("after")))
