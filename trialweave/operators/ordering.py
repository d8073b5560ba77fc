"""Numbering and running totals over a total order, without one task holding a whole group.

A plain window puts a whole group, or the whole table, into one task. Here the order is cut into
ranges; every slice is numbered on its own and shifted by the totals of the slices before it.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from .lineage import checkpointed


def last_per_key(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The last row of each key. An aggregate, so each task sends one row per key at most."""
    return _edge_per_key(df, keys, order, F.max)


def first_per_key(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first row of each key."""
    return _edge_per_key(df, keys, order, F.min)


def _edge_per_key(df, keys, order, pick):
    rest = [c for c in df.columns if c not in keys and c not in order]
    row = pick(F.struct(*order, *rest)).alias("_row")
    return df.groupBy(*keys).agg(row).select(
        *[F.col(f"_row.{c}").alias(c) if c not in keys else F.col(c) for c in df.columns])


def running_total(df: DataFrame, order: list[str], totals: dict[str, str],
                  group: list[str] | None = None, slices: int | None = None) -> DataFrame:
    """Add inclusive running totals of columns: ``totals`` maps a new column to its weight.

    ``order`` must be a total order inside each group. Nulls sort first. The input is evaluated
    once: it is dealt into ranges of the order, by default as many as the session shuffles into,
    and kept in a checkpoint, so slices shrink as the cluster grows and a retry finds the same ones.
    """
    group = list(group or [])
    slices = slices or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    cut = checkpointed(df.repartitionByRange(slices, *group, *order)
                       .withColumn("_slice", F.spark_partition_id()))
    per_slice = cut.groupBy(*group, "_slice").agg(
        *[F.sum(w).alias(f"_sum_{name}") for name, w in totals.items()])
    before = Window.partitionBy(*group).orderBy("_slice").rowsBetween(
        Window.unboundedPreceding, -1)
    shifts = per_slice.select(*group, "_slice", *[
        F.coalesce(F.sum(f"_sum_{name}").over(before), F.lit(0)).alias(f"_before_{name}")
        for name in totals])
    inside = Window.partitionBy(*group, "_slice").orderBy(*order).rowsBetween(
        Window.unboundedPreceding, Window.currentRow)
    local = cut.select("*", *[F.sum(w).over(inside).alias(f"_here_{name}")
                              for name, w in totals.items()])
    keys = group + ["_slice"]
    left, right = local, shifts
    for k in keys:
        right = right.withColumnRenamed(k, f"_g_{k}")
    on = [left[k].eqNullSafe(right[f"_g_{k}"]) for k in keys]
    # without groups there is one row for each slice
    joined = left.join(F.broadcast(right) if not group else right, on)
    return joined.select(
        *[F.col(c) for c in df.columns],
        *[(F.col(f"_here_{n}") + F.col(f"_before_{n}")).alias(n) for n in totals])


def numbered(df: DataFrame, order: list[str], name: str = "position",
             group: list[str] | None = None, slices: int | None = None) -> DataFrame:
    """Row numbers from 1 over a total order, over all rows or inside each group."""
    out = running_total(df.withColumn("_one", F.lit(1).cast("long")), order, {name: "_one"},
                        group, slices)
    return out.drop("_one")


def smallest_per_key(df: DataFrame, keys: list[str], order: list[Column], n: int) -> DataFrame:
    """The first ``n`` rows of each key; Spark keeps ``n`` per key on each task before it shuffles."""
    window = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rank", F.row_number().over(window)).where(F.col("_rank") <= n)
