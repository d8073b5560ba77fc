"""Typed answers back to codes. What cannot be mapped with certainty is reported, never guessed."""
from __future__ import annotations

import re

from pyspark.sql import DataFrame, functions as F

from ..functions import constants as K
from ..functions.cells import strip, whole_as_integer
from ..functions.dates import parse_any
from ..functions.text import clean_label, is_missing_phrase, text_key
from ..plans.dictionary import CODED, Dictionary
from .lineage import lookup

UNKNOWN_HEADER = "unknown heading"


def _key(text) -> str:
    return re.sub(r"\s+", " ", str(text or "").strip().lower())


def header_key(c):
    """The one key of a heading: of a field's label and of what a sheet calls it."""
    return text_key(clean_label(c))


def label_table(spark, dictionary: Dictionary) -> DataFrame:
    """J12 with W2: normalised label to field; the first field under a label owns it."""
    owner: dict[str, str] = {}
    rows = []
    for f in dictionary.fields:
        key = _key(re.sub(r"\s+", " ", f.field_label).strip().rstrip(" ?.:;"))
        if key and owner.setdefault(key, f.field_name) == f.field_name:
            rows.append((key, f.field_name, f.field_type, f.is_date))
    return lookup(spark.createDataFrame(
        rows, "label_key string, field string, field_type string, is_date boolean"), rows)


def label_clashes(spark, dictionary: Dictionary) -> DataFrame:
    """Fields whose label another field already owns; a finding."""
    owner, rows = {}, []
    for f in dictionary.fields:
        key = _key(f.label)
        if owner.setdefault(key, f.field_name) != f.field_name:
            rows.append((f.field_name, f.label, owner[key], "warn"))
    return spark.createDataFrame(
        rows, "field string, label string, owner string, severity string")


def answer_table(spark, dictionary: Dictionary, aliases: dict | None = None) -> DataFrame:
    """(field, answer) to code: choice labels first, then site phrases that resolve to one.

    Of phrases with one key the last counts.
    """
    codes: dict[tuple[str, str], str] = {}
    for f in dictionary.fields:
        by_label = {_key(label): code for code, label in f.choices.items()}
        codes.update(((f.field_name, k), c) for k, c in by_label.items())
        for phrase, target in ((aliases or {}).get(f.field_name) or {}).items():
            key = _key(phrase)
            if key not in by_label:
                codes[f.field_name, key] = by_label.get(_key(target), str(target))
    rows = [(field, key, code) for (field, key), code in codes.items()]
    return lookup(spark.createDataFrame(
        rows, "field string, answer_key string, code string"), rows)


def changed_answers(answers: DataFrame, sent: DataFrame) -> DataFrame:
    """The answers that differ from what was sent; cells that were never sent stay in.

    Both frames are (record_id, header, value). A cell that was sent several times counts once, with
    its greatest value.
    """
    before = sent.groupBy("record_id", "header").agg(F.max(strip("value")).alias("_sent"))
    return answers.join(before, ["record_id", "header"], "left").where(
        F.col("_sent").isNull() | (strip("value") != F.col("_sent"))).drop("_sent")


def unknown_headers(answers: DataFrame, dictionary: Dictionary) -> DataFrame:
    """Headers that no field's label matches."""
    labels = label_table(answers.sparkSession, dictionary).select("label_key")
    return answers.select("header", header_key("header").alias("label_key")).distinct() \
        .join(labels, "label_key", "left_anti").select("header").distinct()


def translate_cells(answers: DataFrame, dictionary: Dictionary,
                    aliases: dict | None = None) -> DataFrame:
    """Every non-blank answer as a coded cell or an issue.

    ``answers`` is (record_id, header, value). The result has ``column`` and ``code`` where the
    answer maps, and ``issue`` where it does not, an unknown heading included. Order of trial: 'not
    in the chart' phrases, checkbox parts, choice labels then site phrases, dates, plain text.
    Look-up tables of a dictionary's size are broadcast, so answers are not shuffled.
    """
    spark = answers.sparkSession
    labels = label_table(spark, dictionary)
    codes = answer_table(spark, dictionary, aliases)
    typed = answers.select(
        strip("record_id").alias("record_id"), "header", strip("value").alias("value"),
        header_key("header").alias("label_key")).where(F.col("value") != "")
    known = typed.join(labels, "label_key", "left").drop("label_key")
    checkbox = F.col("field_type") == "checkbox"
    coded = F.col("field_type").isin(*CODED)
    keyed = known.withColumn("_text", text_key("value", trimmed=True)).withColumn(
        "_phrase", is_missing_phrase("_text", keyed=True))
    parted = keyed.withColumn("_parts", F.when(
        checkbox & ~F.col("_phrase"), F.split("value", ",")).otherwise(F.array("value")))
    split = parted.select("record_id", "header", "field", "field_type", "is_date", "value",
                          "_phrase", "_text", F.explode("_parts").alias("_part"))
    split = split.withColumn(
        "answer_key", F.when(checkbox, text_key("_part")).when(coded, F.col("_text"))) \
        .where(F.coalesce(F.col("answer_key") != "", F.lit(True)))
    dated = split.withColumn("_date", F.when(
        F.col("is_date") & ~F.col("_phrase"), parse_any("_text", keyed=True)))
    found = dated.join(codes, ["field", "answer_key"], "left")

    def option(code):
        negative = F.substring(code, 2, 100)
        return F.when(code.startswith("-"), F.concat(F.col("field"), F.lit("____"), negative)) \
            .otherwise(F.concat(F.col("field"), F.lit("___"), code))

    column = (
        F.when(checkbox, option(F.when(F.col("_phrase"), K.NOT_IN_NOTES_CODE)
                                .otherwise(F.col("code"))))
        .otherwise(F.col("field")))
    code = (
        F.when(F.col("field").isNull(), None)
        .when(F.col("_phrase"),
               F.when(checkbox, "1").when(F.col("is_date"), K.NOT_IN_NOTES_DATE)
               .otherwise(K.NOT_IN_NOTES_CODE))
        .when(checkbox, F.when(F.col("code").isNotNull(), "1"))
        .when(coded, F.col("code"))
        .when(F.col("is_date"), F.col("_date"))
        .when(F.col("field").isNotNull(), whole_as_integer("value")))
    issue = (
        F.when(F.col("field").isNull(), UNKNOWN_HEADER)
        .when(checkbox, F.concat(F.lit("checkbox option '"), strip("_part"),
                                  F.lit("' not a choice")))
        .when(coded, "value not in choice list")
        .otherwise("unparseable date"))
    out = found.select("record_id", "header", "field", "value", column.alias("_column"),
                       code.alias("code"), issue.alias("_issue"))
    mapped = F.col("code").isNotNull()
    return out.select("record_id", "header", "field", "value",
                      F.when(mapped, F.col("_column")).alias("column"), "code",
                      F.when(~mapped, F.col("_issue")).alias("issue"))


def _by_cell(translated: DataFrame) -> DataFrame:
    return translated.where(F.col("issue").isNull()).groupBy("record_id", "column")


def payload(translated: DataFrame) -> DataFrame:
    """Mapped cells (record_id, column, code), one per cell.

    A cell whose answers say different things is left out: see ``contradictions``.
    """
    return _by_cell(translated).agg(F.min("code").alias("code"), F.max("code").alias("_most")).where(
        F.col("code") == F.col("_most")).drop("_most")


def contradictions(translated: DataFrame) -> DataFrame:
    """Cells that were answered with different codes: ``record_id``, ``column``, the least and the
    greatest code and the number of ``answers``. Whatever number of answers a cell has, each task
    sends one row for it."""
    return _by_cell(translated).agg(
        F.min("code").alias("least"), F.max("code").alias("greatest"),
        F.count(F.lit(1)).alias("answers")).where(F.col("least") != F.col("greatest"))


def issues(translated: DataFrame) -> DataFrame:
    return translated.where(F.col("issue").isNotNull()).select(
        "record_id", "header", "value", "issue")


def payload_wide(translated: DataFrame, dictionary: Dictionary,
                 id_field: str | None = None) -> DataFrame:
    """The payload as one row per record over the dictionary's columns, blank where unanswered."""
    columns = [c for c in dictionary.expected_columns() if c != dictionary.id_field]
    cells = payload(translated).groupBy("record_id").agg(F.map_from_entries(
        F.collect_list(F.struct("column", "code"))).alias("_cells"))  # at most one for each column
    return cells.select(F.col("record_id").alias(id_field or dictionary.id_field), *[
        F.coalesce(F.col("_cells")[c], F.lit("")).alias(c) for c in columns])
