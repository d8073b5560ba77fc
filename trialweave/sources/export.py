"""Exports: filters, raw or labelled values, wide to entity-attribute-value and back."""
from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions.cells import strip
from ..functions.text import decode
from ..plans.dictionary import CODED, Dictionary


def export_records(records: DataFrame, dictionary: Dictionary, forms: list[str] | None = None,
                   fields: list[str] | None = None, ids: DataFrame | list | None = None,
                   events: list[str] | None = None, event_col: str = "redcap_event_name",
                   modified: tuple | None = None, modified_col: str = "last_modified",
                   labels: bool = False, keep: list[str] = ()) -> DataFrame:
    """K6 and K7: chosen records and fields, as codes or labels.

    ``ids`` is a list or a one-column frame; ``modified`` is an inclusive (from, to) pair, either
    end may be None. The id column is always kept, and so are the columns in ``keep``.
    """
    out = records
    if events is not None:
        out = out.where(F.col(event_col).isin(*events))
    if modified is not None:
        low, high = modified
        stamp = F.col(modified_col)
        if low is not None:
            out = out.where(stamp >= F.lit(low).cast(records.schema[modified_col].dataType))
        if high is not None:
            out = out.where(stamp <= F.lit(high).cast(records.schema[modified_col].dataType))
    rid = dictionary.id_field
    if isinstance(ids, DataFrame):
        wanted = ids.select(strip(ids.columns[0]).alias("_id")).distinct()
        out = out.join(wanted, strip(out[rid]) == wanted["_id"], "left_semi")
    elif ids is not None:
        out = out.where(strip(rid).isin([str(i) for i in ids]))
    names = [f.field_name for f in dictionary.fields]
    if forms is not None or fields is not None:
        chosen = set(fields or ()) | set(dictionary.fields_of(forms or ()))
        names = [n for n in names if n in chosen]
    columns = dictionary.columns_for(names, records.columns)
    head = list(dict.fromkeys([rid, *keep]))
    cols = [*head, *[c for c in columns if c not in head]]
    return out.select(*[labelled(dictionary, c) if labels else F.col(f"`{c}`") for c in cols])


def labelled(dictionary: Dictionary, column: str):
    """One column as labels: choices decoded, checkbox bits as Checked or Unchecked."""
    value = F.col(f"`{column}`")
    field = dictionary.get(dictionary.base_name(column))
    if field is None:
        return value
    if field.is_checkbox and column != field.field_name:
        return F.when(strip(value) == "1", "Checked").when(strip(value) == "0", "Unchecked") \
            .otherwise(value).alias(column)
    if field.field_type in CODED and field.choices:
        return decode(value, field.choices).alias(column)
    return value


def to_eav(records: DataFrame, id_cols: list[str], fields: list[str] | None = None,
           keep_blank: bool = False) -> DataFrame:
    """K8: one row per cell; blank cells are left out unless asked for."""
    names = fields or [c for c in records.columns if c not in id_cols]
    long = records.select(*id_cols, *[F.col(f"`{n}`") for n in names]).unpivot(
        id_cols, names, "field", "value")
    return long if keep_blank else long.where(F.coalesce("value", F.lit("")) != "")


def from_eav(cells: DataFrame, id_cols: list[str], fields: list[str]) -> DataFrame:
    """K8 back: one row per id over the named fields, blank where there was no cell."""
    wide = cells.groupBy(*id_cols).agg(*[
        F.max(F.when(F.col("field") == f, F.col("value"))).alias(f) for f in fields])
    return wide.fillna("", fields)


def overview(records: DataFrame, dictionary: Dictionary) -> DataFrame:
    """K9: record, field and form counts."""
    return records.agg(F.count(F.lit(1)).alias("records")).select(
        "records", F.lit(len(dictionary.fields)).cast("long").alias("fields"),
        F.lit(len(dictionary.forms())).cast("long").alias("forms"))


def dictionary_changes(local: DataFrame, remote: DataFrame) -> DataFrame:
    """Dictionary rows found on one side only, duplicates counted."""
    columns = [c for c in local.columns if c in remote.columns and c != "pos"]
    a, b = local.select(*columns), remote.select(*columns)
    return a.exceptAll(b).withColumn("side", F.lit("local")).unionByName(
        b.exceptAll(a).withColumn("side", F.lit("remote")))
