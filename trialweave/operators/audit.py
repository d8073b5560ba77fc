"""Returned worklists: what was answered, what was edited out of scope, what is only a note."""
from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions.cells import strip

RESPONSE_WORDS = ("response", "comment", "note")
#: Outcomes of edits that nobody asked for.
UNASKED = ("out_of_scope", "not_sent")


def response_columns(columns, name: str = "RESPONSE", loose: bool = False) -> list[str]:
    """the note columns of a sheet: the exact name, or any header holding a response word."""
    if loose:
        return [c for c in columns if any(w in c.lower() for w in RESPONSE_WORDS)]
    return [c for c in columns if c == name]


def sheet_cells(sheet: DataFrame, id_cols: list[str], response: str = "RESPONSE") -> DataFrame:
    """A wide sheet as (record_id, field, value); the first id column identifies the record."""
    names = [c for c in sheet.columns if c not in id_cols and c != response]
    texts = sheet.select(strip(sheet[id_cols[0]]).alias("record_id"),
                         *[strip(F.col(f"`{c}`")).alias(c) for c in names])
    return texts.where(F.col("record_id") != "").unpivot(
        ["record_id"], names, "field", "value")


def sheet_notes(sheet: DataFrame, id_cols: list[str], response: str = "RESPONSE") -> DataFrame:
    return sheet.select(strip(sheet[id_cols[0]]).alias("record_id"),
                        strip(sheet[response]).alias("note")).where(F.col("record_id") != "")


def returned_audit(sent: DataFrame, returned: DataFrame, unique: bool = False) -> DataFrame:
    """Every cell that came back different from what was sent.

    ``sent`` is (record_id, field, value, flag) over all shown cells, flag null where nothing was
    asked; ``returned`` is (record_id, field, value). The outcome is ``answer`` for a flagged gap,
    ``uncertain_answer`` where it was unclear whether the field applies, ``out_of_scope`` for an
    edit to a cell that was never flagged, and ``not_sent`` for a filled cell of a record or column
    that the site added. A blank reply to a flagged cell is no change.
    A cell that occurs twice on a side counts once, with its greatest value; ``unique`` says that
    none does.
    """
    back = returned.select("record_id", "field", strip("value").alias("returned"))
    seen = sent.select("record_id", "field", strip("value").alias("sent"), "flag")
    if not unique:
        back = back.groupBy("record_id", "field").agg(F.max("returned").alias("returned"))
        seen = seen.groupBy("record_id", "field").agg(
            F.max(F.struct("sent", "flag")).alias("_s")).select("record_id", "field", "_s.*")
    added = F.col("sent").isNull()
    changed = (F.col("returned") != F.col("sent")) & (
        (F.col("returned") != "") | F.col("flag").isNull())
    return back.join(seen, ["record_id", "field"], "left").where(
        F.when(added, F.col("returned") != "").otherwise(changed)
    ).select("record_id", "field", "sent", "flag", "returned").withColumn(
        "outcome",
        F.when(added, "not_sent").when(F.col("flag") == "gap", "answer")
        .when(F.col("flag") == "uncertain", "uncertain_answer")
        .otherwise("out_of_scope"))


def note_only(notes: DataFrame, changes: DataFrame) -> DataFrame:
    """T5: records with a note and no answered cell."""
    answered = changes.where(~F.col("outcome").isin(*UNASKED)).select("record_id").distinct()
    return notes.where(F.col("note") != "").join(answered, "record_id", "left_anti")


def audit_counts(changes: DataFrame) -> DataFrame:
    return changes.groupBy("outcome").agg(F.count(F.lit(1)).alias("cells"))


def triage(changes: DataFrame, unmapped: DataFrame, notes_alone: DataFrame) -> DataFrame:
    """Q7: READY, QUESTION, VERIFY or NO_ACTION per answer.

    ``unmapped`` is (record_id, field) of answers that no code could be found for. A note without
    an answer is VERIFY when it says RESOLVED and NO_ACTION otherwise.
    """
    asked = unmapped.select("record_id", "field").distinct().withColumn("_open", F.lit(True))
    cells = changes.where(~F.col("outcome").isin(*UNASKED)) \
        .join(asked, ["record_id", "field"], "left").select(
        "record_id", "field",
        F.when(F.col("_open"), "QUESTION").otherwise("READY").alias("bucket"))
    alone = notes_alone.select(
        "record_id", F.lit("").alias("field"),
        F.when(F.upper("note").contains("RESOLVED"), "VERIFY").otherwise("NO_ACTION")
        .alias("bucket"))
    return cells.unionByName(alone)
