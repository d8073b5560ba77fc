"""What a set of staged updates would change, in words, grouped for a site."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.cells import strip
from ..functions.text import decode
from ..plans.dictionary import Dictionary


def _split(dictionary: Dictionary, column: str) -> tuple[str, str | None]:
    if column in dictionary:
        return column, None
    base, mark, tail = column.partition("___")
    if not mark or not tail:
        return column, None
    return base, ("-" + tail[1:] if tail.startswith("_") else tail)


def render_change(dictionary: Dictionary, column: str) -> Column:
    """one cell's change: ``label: → `code` (choice)`` or ``label: checked: `code` (choice)``.

    Null when the cell is blank.
    """
    value = F.col(f"`{column}`")
    base, code = _split(dictionary, column)
    field = dictionary.get(base)
    tick = lambda v: F.concat(F.lit("`"), v, F.lit("`"))
    if field is None:
        text = F.concat(F.lit(f"`{column}` → "), tick(value), F.lit(" (field not in dictionary)"))
    elif code is None:
        text = F.concat(F.lit(f"{field.label}: → "), tick(value))
        if field.field_type in ("radio", "dropdown", "yesno", "truefalse"):
            text = F.concat(text, F.lit(" ("), decode(value, field.choices), F.lit(")"))
    else:
        label = field.choices.get(code, code)
        verb = F.when(value == "1", "checked").when(value == "0", "unchecked") \
            .otherwise(F.concat(F.lit("set to "), value))
        text = F.concat(F.lit(f"{field.label}: "), verb, F.lit(f": `{code}` ({label})"))
    return F.when(strip(value) != "", text)


def primary_field(dictionary: Dictionary, columns: list[str]) -> Column:
    """The field of the first filled column."""
    return F.coalesce(*[
        F.when(strip(F.col(f"`{c}`")) != "", F.lit(_split(dictionary, c)[0])) for c in columns],
        F.lit(""))


def change_details(drafts: DataFrame, dictionary: Dictionary, id_field: str,
                   group: tuple[str, ...] = ("site", "workbook")) -> DataFrame:
    """A15, record level: the changes of each draft row as an array of lines."""
    columns = [c for c in drafts.columns if c not in (id_field, *group)]
    lines = F.array_compact(F.array(*[render_change(dictionary, c) for c in columns]))
    return drafts.where(strip(id_field) != "").select(
        *group, strip(id_field).alias("record_id"),
        primary_field(dictionary, columns).alias("primary_field"), lines.alias("changes")) \
        .where(F.size("changes") > 0)


def change_groups(details: DataFrame, group: tuple[str, ...] = ("site", "workbook")) -> DataFrame:
    """Records per site, workbook and primary field; order with :func:`largest_first`."""
    return details.groupBy(*group, "primary_field").agg(
        F.count(F.lit(1)).alias("records"), F.sum(F.size("changes")).alias("changes"))


def largest_first(groups: DataFrame, group: tuple[str, ...] = ("site", "workbook")) -> DataFrame:
    """O4."""
    return groups.orderBy(*group, F.desc("records"), "primary_field")


def first_operations(operations: DataFrame, order: list[str], n: int | None) -> DataFrame:
    """The first ``n`` operations of an explicit total order, all of them without ``n``.

    Spark keeps ``n`` rows on each task and merges those.
    """
    ordered = operations.orderBy(*order)
    return ordered if n is None else ordered.limit(n)
