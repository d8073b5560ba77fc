"""JSON payloads whose columns nobody named: parsed to VARIANT, cells found by exploding it."""
from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def _parsed(df: DataFrame, payload: str) -> DataFrame:
    """The frame with ``_v``, the payload as a variant if it is a JSON object, and null else."""
    found = df.withColumn("_v", F.try_parse_json(F.col(payload)))
    return found.withColumn("_v", F.when(F.schema_of_variant("_v").startswith("OBJECT"), F.col("_v")))


def _exploded(df: DataFrame, keep: list[str], payload: str) -> DataFrame:
    known = _parsed(df, payload).where(F.col("_v").isNotNull()).select(
        *[F.col(c).alias(f"_k{i}") for i, c in enumerate(keep)], "_v")
    return known.lateralJoin(known.sparkSession.tvf.variant_explode(F.col("_v").outer())).select(
        *[F.col(f"_k{i}").alias(c) for i, c in enumerate(keep)], F.col("key").alias("field"), F.col("value").alias("_c"))


def _text(cell):
    """A cell as text: texts as they are, numbers and flags as JSON writes them, nested ones as JSON."""
    return F.when(F.schema_of_variant(cell) == "STRING", F.try_variant_get(cell, "$", "string")) \
        .otherwise(F.to_json(cell))


def cells_of(df: DataFrame, id_cols: list[str], payload: str = "payload",
             keep_blank: bool = False) -> DataFrame:
    """S3, K8: one row (ids, ``field``, ``value``) for each key of each payload, whatever the keys are.

    Nulls are no cells, blank ones are left out unless asked for, nested values stay JSON text. Payloads
    that are null or no JSON object give no cells; see ``unreadable``. One narrow pass.
    """
    cells = _exploded(df, id_cols, payload).where(~F.is_variant_null("_c")).select(
        *id_cols, "field", _text(F.col("_c")).alias("value"))
    return cells if keep_blank else cells.where("value <> ''")


def fields_of(df: DataFrame, payload: str = "payload") -> DataFrame:
    """The columns that the payloads have: ``field``, its ``types`` (sorted, comma-joined),
    ``records`` that hold it and those where it is ``filled``. One aggregate."""
    cells = _exploded(df, [], payload).where(~F.is_variant_null("_c"))
    return cells.groupBy("field").agg(
        F.array_join(F.array_sort(F.collect_set(F.schema_of_variant("_c"))), ", ").alias("types"),
        F.count(F.lit(1)).alias("records"), F.count_if(_text(F.col("_c")) != "").alias("filled"))


def unreadable(df: DataFrame, payload: str = "payload") -> DataFrame:
    """The rows whose payload is no JSON object; null payloads are none of them."""
    return _parsed(df, payload).where(F.col("_v").isNull() & F.col(payload).isNotNull()).drop("_v")
