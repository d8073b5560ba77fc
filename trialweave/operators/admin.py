"""Study set-up data: repeated columns to rows, recodes, intake checks, migrations."""
from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import constants as K
from ..functions.cells import lookup, strip
from ..functions.dates import site_dates
from ..functions.text import literal_parts


def repeated_to_rows(df: DataFrame, id_cols: list[str], prefix: str,
                     name: str = "value") -> DataFrame:
    """The filled columns that start with a prefix, one row each, in column order."""
    cols = sorted(c for c in df.columns if c.startswith(prefix))
    cells = F.array_compact(F.array(*[
        F.when(strip(F.col(f"`{c}`")) != "", F.struct(
            F.lit(c).alias("column"), strip(F.col(f"`{c}`")).alias(name))) for c in cols]))
    return df.select(*id_cols, F.explode(cells).alias("c")).select(*id_cols, "c.*")


def attachments(df: DataFrame, id_col: str, marks=K.ATTACHMENT_MARKS) -> DataFrame:
    """Attached documents: columns that hold a file name rather than a 0, 1 or 2 answer."""
    cols = [c for c in df.columns if any(m in c for m in marks)]
    cells = F.array_compact(F.array(*[
        F.when(~strip(F.col(f"`{c}`")).isin("", "0", "1", "2"), F.struct(
            F.lit(c).alias("column"), strip(F.col(f"`{c}`")).alias("file"),
            F.lit("IRB and Ethics" if "irb_file" in c or "consent" in c else "Study Documents")
            .alias("folder"))) for c in cols]))
    return df.select(id_col, F.explode(cells).alias("c")).select(id_col, "c.*")


def personnel(df: DataFrame, id_col: str, roles: list[tuple[str, str, str]]) -> DataFrame:
    """(name column, email column, role) triples as rows; people without a name are left out."""
    rows = F.array_compact(F.array(*[
        F.when(strip(n) != "", F.struct(strip(n).alias("name"), strip(e).alias("email"),
                                        F.lit(role).alias("role"))) for n, e, role in roles]))
    return df.select(id_col, F.explode(rows).alias("p")).select(id_col, "p.*")


def recode(c, synonyms: dict[str, str], fold_case: bool = True) -> Column:
    """R2: a synonym table; null when the text is not listed."""
    value = strip(c)
    table = {k.upper() if fold_case else k: v for k, v in synonyms.items()}
    return lookup(table, F.upper(value) if fold_case else value)


def tracker_payload(rows: DataFrame, id_col: str, copied: list[str] = (), flags: list[str] = (),
                    recodes: dict[str, tuple[str, dict]] | None = None,
                    status: str | None = "study_status", production: str = "study_production",
                    status_override: Column | None = None,
                    dated_sites: str | None = None, slots: int = 10) -> DataFrame:
    """A spreadsheet row as a tracker row: copied, 0/1-checked, recoded and derived columns.

    ``recodes`` maps a target column to (source column, synonym table). A numeric status of 2 or
    more sets ``production``. ``dated_sites`` names free text with ``Site: date`` lines, spread
    over ``slots`` numbered site and expiry columns. ``irb_site_count`` counts all entries and
    ``irb_sites_over`` those beyond the slots; text that needs a look, such entries included, goes
    to ``build_notes``.
    """
    out = [F.col(id_col)]
    out += [strip(c).alias(c) for c in copied]
    out += [F.when(strip(c).isin("0", "1"), strip(c)).otherwise("").alias(c) for c in flags]
    for target, (source, table) in (recodes or {}).items():
        out.append(F.coalesce(recode(source, table), F.lit("")).alias(target))
    if status:
        value = strip(status)
        if status_override is not None:
            value = F.coalesce(status_override, value)
        out += [value.alias(status),
                F.when(F.coalesce(value.try_cast("int") >= 2, F.lit(False)), "1").otherwise("")
                .alias(production)]
    if not dated_sites:
        return rows.select(*out)
    raw = strip(dated_sites)
    table = rows.withColumn("_sites", site_dates(dated_sites))
    entry = lambda i, part: F.coalesce(F.get("_sites", F.lit(i))[part], F.lit(""))
    n = F.size("_sites")
    out += [F.when(n > 0, n.cast("string")).otherwise("").alias("irb_site_count"),
            F.when(n > slots, (n - slots).cast("string")).otherwise("").alias("irb_sites_over")]
    for i in range(slots):
        out += [entry(i, "site").alias(f"irb_site_{i + 1}"),
                entry(i, "date").alias(f"irb_site_{i + 1}_expiry")]
    unsure = (raw != "") & ((n == 0) | (n > slots) | raw.contains("\n"))
    out.append(F.when(unsure, F.concat(F.lit("IRB expiry raw (verify): "), raw)).otherwise("")
               .alias("build_notes"))
    return table.select(*out)


def ready_to_build(required: list[str]) -> Column:
    """Every required intake column is filled."""
    return F.forall(F.array(*[strip(c) for c in required]), lambda v: v != "")


def migration_candidates(records: DataFrame, id_col: str, source: str, targets: list[str],
                         separator: str = ",", codes=K.SENTINELS) -> DataFrame:
    """Legacy text to split into new columns, with the source kept for audit.

    A record qualifies when the source is filled and every target is still blank. The split is
    literal; sources that hold only a missing code, and splits that fill nothing, are left out.
    """
    blank = reduce(lambda a, b: a & b, [strip(t) == "" for t in targets])
    chosen = records.where((strip(source) != "") & blank & ~strip(source).isin(*codes))
    split = chosen.select(F.col(id_col), F.col(source).alias("source_raw"),
                          *literal_parts(source, targets, separator))
    return split.where(F.concat_ws("", *targets) != "")


def to_json_payload(df: DataFrame, id_col: str) -> DataFrame:
    """Each row as a JSON text."""
    return df.select(id_col, F.to_json(F.struct(*df.columns)).alias("payload"))


def from_json_payload(df: DataFrame, columns: list[str], payload: str = "payload") -> DataFrame:
    """R5 back: named string columns out of a JSON text."""
    schema = ", ".join(f"`{c}` string" for c in columns)
    return df.select(F.from_json(payload, schema).alias("_j")).select("_j.*")


def with_missing_codes(rows: DataFrame, project: str = "project_id") -> DataFrame:
    """R4 over many dictionaries at once: missing-code choices or notes where the field type asks.

    ``rows`` are dictionary rows with ``pos``; a project's first row, exempt types and exempt fields
    stay as they are. Choices that are there already are not added again, and a note is only written
    where there is none.
    """
    first = rows.groupBy(F.col(project).alias("_project")).agg(F.min("pos").alias("_first"))
    kind, choices = F.col("field_type"), "select_choices_or_calculations"
    due = ((F.col("pos") != F.col("_first")) & ~kind.isin(*K.MISSING_EXEMPT_TYPES)
           & ~F.col("field_name").isin(*K.MISSING_EXEMPT_FIELDS))
    have = strip(choices)
    lacking = F.filter(F.array(*[F.lit(t) for t in K.MISSING_CHOICE_TEXT]),
                       lambda t: ~have.contains(t))
    note = F.when(F.col("text_validation_type_or_show_slider_number").startswith("date"),
                  K.DATE_MISSING_NOTE).otherwise(K.TEXT_MISSING_NOTE)
    return rows.join(first, F.col(project).eqNullSafe(F.col("_project"))).withColumns({
        choices: F.when(due & kind.isin("radio", "dropdown", "checkbox"), F.array_join(
            F.filter(F.concat(F.array(have), lacking), lambda t: t != ""), " | "))
        .otherwise(F.col(choices)),
        "field_note": F.when(due & kind.isin("text", "notes") & (strip("field_note") == ""), note)
        .otherwise(F.col("field_note"))}).drop("_project", "_first")
